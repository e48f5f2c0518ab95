"""Joining variants with model scores under a completeness gate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixbench.functions.expressions import standard_mutation


def first_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key (null is a key) under an explicit order, nulls first. An aggregate, so that rows of
    one key are combined where they lie and no task sorts them."""
    rest = [c for c in df.columns if c not in keys]
    least = F.min_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(least).select(*keys, "_row.*").select(*df.columns)


def standardized(df: DataFrame) -> DataFrame:
    """Rows with a mutation, in the RNA alphabet."""
    return df.where("mutant is not null").withColumn("mutant", standard_mutation(F.col("mutant")))


def _joined(variants: DataFrame, predictions: DataFrame, models: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Variants and predictions side by side, a row for each (dms_id, mutant) of either and for each of its variants:
    ``v`` tells variants, column i has the score of model i, wrapped so that a missing score differs from a missing
    row. Both sides are read once and joined once, whatever the number of models."""
    ranked = F.struct(*order)
    own = lambda m: F.min_by(F.when(F.col("model") == m, F.struct("score")), F.when(F.col("model") == m, ranked))
    wanted = predictions.where(F.col("model").isin(list(models))).withColumn("mutant", standard_mutation(F.col("mutant")))
    scores = wanted.groupBy("dms_id", "mutant").agg(*(own(m).alias(f"_{i}") for i, m in enumerate(models)))
    rows = standardized(variants).select("dms_id", "mutant", "dms_score", F.lit(True).alias("v"))
    return rows.join(scores, ["dms_id", "mutant"], "full")


def loss_report(variants: DataFrame, predictions: DataFrame, models: Sequence[str]) -> DataFrame:
    """(dms_id, model, n_variants, n_lost, has_file) for each assay with variants and each requested model."""
    rows = _joined(variants, predictions, models, ["score"])
    known = [F.col(f"_{i}").isNotNull() for i in range(len(models))]
    counts = rows.groupBy("dms_id").agg(
        F.count("v").alias("n_variants"),
        F.array(*(F.struct(F.lit(m).alias("model"), F.count_if(F.col("v") & ~k).alias("n_lost"), F.max(k).alias("has_file")) for m, k in zip(models, known, strict=True))).alias("each"),
    )
    return counts.where("n_variants > 0").select("dms_id", "n_variants", F.inline("each")).select("dms_id", "model", "n_variants", "n_lost", "has_file")


def complete_assays(report: DataFrame) -> DataFrame:
    """(dms_id): assays of which every requested model has a file and scores every variant."""
    return report.groupBy("dms_id").agg(F.bool_and(F.col("has_file") & (F.col("n_lost") == 0)).alias("ok"), F.max("n_variants").alias("n")).where("ok and n > 0").select("dms_id")


def merge_wide(variants: DataFrame, predictions: DataFrame, models: Sequence[str], order: Sequence[str]) -> DataFrame:
    """(dms_id, mutant, dms_score, <model>_score ...): the variants of complete assays with the score of each requested
    model in a column of its own; of several scores for a key the first under ``order`` counts."""
    rows = _joined(variants, predictions, models, order).where("v")
    whole = [F.bool_and(F.col(f"_{i}").isNotNull()).over(Window.partitionBy("dms_id")) for i in range(len(models))]
    kept = rows.withColumn("_ok", F.array_min(F.array(*whole))).where("_ok")
    return kept.select("dms_id", "mutant", "dms_score", *(F.col(f"_{i}.score").alias(f"{m}_score") for i, m in enumerate(models)))


def merge(variants: DataFrame, predictions: DataFrame, models: Sequence[str], order: Sequence[str]) -> DataFrame:
    """(dms_id, mutant, dms_score, model, score): the same in long form."""
    rows = merge_wide(variants, predictions, models, order)
    each = F.inline(F.array(*(F.struct(F.lit(m).alias("model"), F.col(f"{m}_score").alias("score")) for m in models)))
    return rows.select("dms_id", "mutant", "dms_score", each)
