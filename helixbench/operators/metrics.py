"""Rank and confusion metrics by group, and pooled position metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixbench.functions.expressions import clip, ratio, ratio_or_zero


def average_rank(value: str, keys: Sequence[str]) -> Column:
    """Rank from 1 within the keys; ties get their mean rank."""
    ties = F.count(F.lit(1)).over(Window.partitionBy(*keys, value))
    return F.rank().over(Window.partitionBy(*keys).orderBy(value)) + (ties - 1) / 2


def assay_metrics(df: DataFrame, keys: Sequence[str], truth: str = "dms_score", score: str = "score", parts: int | None = None) -> DataFrame:
    """(keys, spearman, auc, mcc) over the rows where truth and score are known: absolute rank correlation, AUC of the
    score against truth > median in the better direction, absolute Matthews correlation of both halves.

    Truth without two halves (all its values equal) makes all three null; a constant score gives (null, 0.5, 0).
    One shuffle on the keys serves ranks, medians and the final aggregation. Its tasks sort their rows three times, at
    about 600 bytes a row; ``parts`` is their number, else the session's.
    """
    rows = df.where(F.col(truth).isNotNull() & F.col(score).isNotNull())
    rows = rows.select(*keys, truth, score).repartition(parts, *keys) if parts else rows
    group = Window.partitionBy(*keys)
    ranked = rows.select(
        *keys,
        average_rank(truth, keys).alias("rt"),
        average_rank(score, keys).alias("rs"),
        (F.col(truth) > F.median(truth).over(group)).alias("t"),
        (F.col(score) > F.median(score).over(group)).alias("s"),
    )
    t, s = F.col("t"), F.col("s")
    sums = ranked.groupBy(*keys).agg(
        F.covar_pop("rt", "rs").alias("cov"),
        (F.stddev_pop("rt") * F.stddev_pop("rs")).alias("dev"),
        F.sum(F.when(t, F.col("rs"))).alias("above"),
        F.count_if(t & s).cast("double").alias("tp"),
        F.count_if(~t & s).cast("double").alias("fp"),
        F.count_if(t & ~s).cast("double").alias("fn"),
        F.count_if(~t & ~s).cast("double").alias("tn"),
    )
    p, n = F.col("tp") + F.col("fn"), F.col("fp") + F.col("tn")
    auc = ratio(F.col("above") - p * (p + 1) / 2, p * n)
    two = (p > 0) & (n > 0)
    return sums.select(
        *keys,
        F.when(two, F.abs(ratio(F.col("cov"), F.col("dev")))).alias("spearman"),
        F.when(two, F.greatest(auc, 1 - auc)).alias("auc"),
        F.when(two, F.abs(matthews(*map(F.col, ("tp", "fp", "fn", "tn"))))).alias("mcc"),
    )


def matthews(tp: Column, fp: Column, fn: Column, tn: Column) -> Column:
    """Matthews correlation; 0 where a margin is empty."""
    return ratio_or_zero(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)))


def on_grid(metrics: DataFrame, assays: DataFrame, models: DataFrame) -> DataFrame:
    """A row for each assay and model; pairs without rows have null metrics. Both sides are small dimensions."""
    return assays.join(F.broadcast(models)).join(metrics, ["dms_id", "model"], "left")


def median_bins(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """``df`` with ``<column>_bin``: value above the group's median, strictly; false for a null value."""
    group = Window.partitionBy(*keys)
    return df.select("*", *(F.coalesce(F.col(c) > F.median(c).over(group), F.lit(False)).alias(f"{c}_bin") for c in columns))


#: Ranges of scores in a pooled area, as a power of two.
_RANGE_BITS = 10


def _range_of(cuts: Column, x: Column) -> Column:
    """How many of the rising cuts are less than x, by halving."""
    steps = F.array(*(F.lit(1 << bit) for bit in range(_RANGE_BITS - 1, -1, -1)))
    return F.aggregate(steps, F.lit(0), lambda low, step: low + F.when(F.get(cuts, low + step - 1) < x, step).otherwise(0))


def pooled_auc(df: DataFrame, positive: Column, score: str, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, auc): signed AUC over all rows of the keys, ties counted half.

    Rows shrink to a histogram of scores where they lie. A quantile sketch of the scores names about a thousand ranges
    (where they meet has no influence on the result); areas within a range come from running sums, and a range's
    positives times the negatives of the ranges before it is the rest, so that no task holds all scores and a key's
    last step has a row for each range."""
    rows = df.where(F.col(score).isNotNull()).select(*keys, F.col(score).alias("_x"), positive.alias("_y"))
    shares = [i / (1 << _RANGE_BITS) for i in range(1, 1 << _RANGE_BITS)]
    cuts = rows.agg(F.percentile_approx("_x", shares, 1 << (_RANGE_BITS + 2))).scalar()
    hist = rows.groupBy(*keys, "_x").agg(F.count_if("_y").alias("p"), F.count_if(~F.col("_y")).alias("n"))
    ranged = hist.withColumn("_cuts", cuts).select(*keys, "_x", "p", "n", _range_of(F.col("_cuts"), F.col("_x")).alias("_range"))
    within = Window.partitionBy(*keys, "_range").orderBy("_x").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inner = ranged.select(*keys, "_range", "p", "n", (F.col("p") * (F.sum("n").over(within) - F.col("n") / 2)).alias("a"))
    parts = inner.groupBy(*keys, "_range").agg(F.sum("a").alias("a"), F.sum("p").alias("p"), F.sum("n").alias("n"))
    start = F.struct(F.lit(0.0).alias("area"), F.lit(0).cast("long").alias("p"), F.lit(0).cast("long").alias("n"))
    add = lambda s, x: F.struct((s["area"] + x["a"] + x["p"].cast("double") * s["n"]).alias("area"), (s["p"] + x["p"]).alias("p"), (s["n"] + x["n"]).alias("n"))
    total = parts.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_range", "a", "p", "n"))).alias("parts"))
    total = total.select(*keys, F.aggregate("parts", start, add).alias("t"))
    return total.select(*keys, ratio(F.col("t.area"), F.col("t.p").cast("double") * F.col("t.n")).alias("auc"))


def position_metrics(df: DataFrame, truth: str, prediction: str, keys: Sequence[str] = ("model",)) -> DataFrame:
    """(keys, auc, mcc, mae, f1) of binned and clipped columns: signed AUC of the prediction against the truth's
    bins, signed Matthews correlation of the bins, mean absolute difference, mean F1 of the classes that occur."""
    t, p = F.col(f"{truth}_bin"), F.col(f"{prediction}_bin")
    sums = df.groupBy(*keys).agg(
        F.avg(F.abs(F.col(truth) - F.col(prediction))).alias("mae"),
        *(F.count_if(c).cast("double").alias(n) for n, c in (("tp", t & p), ("fp", ~t & p), ("fn", t & ~p), ("tn", ~t & ~p))),
    )
    tp, fp, fn, tn = map(F.col, ("tp", "fp", "fn", "tn"))
    f1 = lambda a, b, c: F.when(a + b + c > 0, 2 * a / (2 * a + b + c))
    one, zero = f1(tp, fp, fn), f1(tn, fn, fp)
    both = (F.coalesce(one, F.lit(0.0)) + F.coalesce(zero, F.lit(0.0))) / F.greatest(one.isNotNull().cast("int") + zero.isNotNull().cast("int"), F.lit(1))
    rest = sums.select(*keys, matthews(tp, fp, fn, tn).alias("mcc"), "mae", both.alias("f1"))
    return rest.join(pooled_auc(df, t, prediction, keys), list(keys)) if keys else rest.join(F.broadcast(pooled_auc(df, t, prediction)))


def clipped(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: clip(F.col(c)) for c in columns})
