"""Reducing token log-probabilities to scores of variants and sequences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixbench.functions.expressions import mutation_parts, to_rna


def log_softmax(logits: DataFrame, keys: Sequence[str], logit: str = "logit") -> DataFrame:
    """``logits`` with ``logp``: x - max - ln(sum(exp(x - max))) over the keys."""
    group = Window.partitionBy(*keys)
    x = F.col(logit) - F.max(logit).over(group)
    return logits.withColumn("_x", x).withColumn("logp", F.col("_x") - F.log(F.sum(F.exp("_x")).over(group))).drop("_x")


def exploded(variants: DataFrame) -> DataFrame:
    """(dms_id, mutant, old, pos, new) for each mutation of each distinct variant."""
    rows = variants.where("mutant is not null").select("dms_id", "mutant").distinct()
    return rows.select("dms_id", "mutant", F.explode(F.split(to_rna(F.col("mutant")), ",")).alias("m")).select("dms_id", "mutant", *mutation_parts(F.col("m")))


def _difference(parts: DataFrame, logp: DataFrame, on: Sequence[str], old: str = "old") -> DataFrame:
    """Sums logp(new) - logp(old) over each variant's mutations, in one join on the position. A base without a
    log-probability, or a flagged mutation, makes the variant's score null."""
    both = parts.join(logp, list(on), "left").where(F.col("base").isNull() | (F.col("base") == F.col("new")) | (F.col("base") == F.col(old)))
    each = both.groupBy("dms_id", "mutant", "pos", "new", old).agg(
        F.max("bad").alias("bad"), F.max(F.when(F.col("base") == F.col("new"), F.col("logp"))).alias("n"), F.max(F.when(F.col("base") == F.col(old), F.col("logp"))).alias("o"), F.max("times").alias("times")
    )
    whole = ~F.max("bad") & (F.count(F.lit(1)) == F.count(F.col("n") - F.col("o")))
    return each.groupBy("dms_id", "mutant").agg(F.when(whole, F.sum((F.col("n") - F.col("o")) * F.col("times"))).alias("score"), F.max("bad").alias("mismatch"))


def wildtype_marginal(variants: DataFrame, constructs: DataFrame, logp: DataFrame) -> DataFrame:
    """(dms_id, mutant, score, mismatch): logp(new) - logp(old) over the mutations, one table of (dms_id, pos, base)
    for each assay. Where the old letter is not the construct's, ``mismatch`` is true and the score null."""
    parts = exploded(variants).join(F.broadcast(constructs.select("dms_id", to_rna(F.col("construct")).alias("wt"))), "dms_id", "left")
    bad = ~F.coalesce(F.substring("wt", F.col("pos"), F.lit(1)) == F.col("old"), F.lit(False))
    parts = parts.groupBy("dms_id", "mutant", "old", "pos", "new").agg(F.max(bad).alias("bad"), F.count(F.lit(1)).alias("times"))
    return _difference(parts, logp, ["dms_id", "pos"])


def masked_marginal(variants: DataFrame, constructs: DataFrame, logp: DataFrame, strip_n: bool = False) -> DataFrame:
    """(dms_id, mutant, score): the same difference, the old base being the construct's at the position and the
    table, keyed by (dms_id, mutant, pos, base), made with that position masked. ``strip_n`` takes N out of the
    construct before the position is looked up."""
    wt = to_rna(F.col("construct"))
    wt = F.replace(wt, F.lit("N"), F.lit("")) if strip_n else wt
    parts = exploded(variants).join(F.broadcast(constructs.select("dms_id", wt.alias("wt"))), "dms_id", "left")
    parts = parts.withColumn("own", F.substring("wt", F.col("pos"), F.lit(1)))
    parts = parts.groupBy("dms_id", "mutant", "own", "pos", "new").agg(F.lit(False).alias("bad"), F.count(F.lit(1)).alias("times"))
    return _difference(parts, logp, ["dms_id", "mutant", "pos"], "own").drop("mismatch")


def mean_loglik(tokens: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, mean_logp, n_tokens) over tokens that are not padding."""
    return tokens.where("not padding").groupBy(*keys).agg(F.avg("logp").alias("mean_logp"), F.count("*").alias("n_tokens"))


def sum_cross_entropy(tokens: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, loss, n_tokens): sums of -logp and of the mask."""
    return tokens.groupBy(*keys).agg(F.sum(-F.col("logp") * F.col("mask")).alias("loss"), F.sum("mask").alias("n_tokens"))
