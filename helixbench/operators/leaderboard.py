"""Leaderboards by assay type and mutation depth, best models, long and wide forms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

METRICS = ("spearman", "auc", "mcc")


def by_type(metrics: DataFrame) -> DataFrame:
    """(model, rna_type, means): mean over the assays of each type, and ``All`` over all assays; missing skipped."""
    sets = metrics.groupingSets([["model", "rna_type"], ["model"]], "model", "rna_type")
    means = sets.agg(F.grouping("rna_type").alias("g"), *(F.avg(m).alias(m) for m in METRICS))
    return means.select("model", F.when(F.col("g") == 1, "All").otherwise(F.col("rna_type")).alias("rna_type"), *METRICS)


def wide(long: DataFrame, types: Sequence[str], values: Sequence[str] = METRICS, suffix: str = "Mean") -> DataFrame:
    """A row for each model with columns ``<metric>_<type>_<suffix>``, types in the given order and ``All`` last."""
    order = [*types, "All"]
    turned = long.groupBy("model").pivot("rna_type", order).agg(*(F.first(v).alias(v) for v in values))
    return turned.select("model", *(F.col(f"`{t}_{v}`" if len(values) > 1 else f"`{t}`").alias(f"{v}_{t}_{suffix}") for v in values for t in order))


def by_depth(metrics: DataFrame) -> DataFrame:
    """(depth, model, means): mean over assays within each depth; ``All`` is the mean of the depths' means."""
    means = metrics.groupBy("model", "depth").agg(*(F.avg(m).alias(m) for m in METRICS))
    every = means.groupBy("model").agg(*(F.avg(m).alias(m) for m in METRICS)).withColumn("depth", F.lit("All"))
    return means.unionByName(every).select("depth", "model", *METRICS)


def long_metrics(metrics: DataFrame, keys: Sequence[str] = ("dms_id", "rna_type", "model")) -> DataFrame:
    """One row for each assay, model and metric."""
    return metrics.unpivot(list(keys), list(METRICS), "metric", "value")


def combined_error(single: Column, multiple: Column) -> Column:
    return F.sqrt((single * single + multiple * multiple) / 2)


def with_errors(means: DataFrame, errors: DataFrame, types: Sequence[str]) -> DataFrame:
    """The wide leaderboard: ``<metric>_<type>_Mean`` and ``<metric>_<type>_SE`` side by side, types in the given order
    and ``All`` last. ``means``: as ``by_type`` gives them; ``errors``: (metric, rna_type, model, se)."""
    long = means.unpivot(["model", "rna_type"], list(METRICS), "metric", "mean").join(errors, ["metric", "rna_type", "model"], "left")
    order = [*types, "All"]
    cell = lambda m, t, v: F.max(F.when((F.col("metric") == m) & (F.col("rna_type") == t), F.col(v)))
    return long.groupBy("model").agg(*(cell(m, t, v).alias(f"{m}_{t}_{name}") for m in METRICS for t in order for v, name in (("mean", "Mean"), ("se", "SE"))))


def depth_with_errors(means: DataFrame, errors: DataFrame) -> DataFrame:
    """(depth, model, <metric>_Mean, <metric>_SE ...) from ``by_depth`` and the errors of each depth (metric, depth,
    model, se); the error of ``All`` combines those of the two depths."""
    pair = errors.groupBy("metric", "model").agg(*(F.max(F.when(F.col("depth") == d, F.col("se"))).alias(d) for d in ("single", "multiple")))
    every = pair.select("metric", F.lit("All").alias("depth"), "model", combined_error(F.col("single"), F.col("multiple")).alias("se"))
    long = means.unpivot(["depth", "model"], list(METRICS), "metric", "mean").join(errors.unionByName(every), ["metric", "depth", "model"], "left")
    cell = lambda m, v: F.max(F.when(F.col("metric") == m, F.col(v)))
    return long.groupBy("depth", "model").agg(*(cell(m, v).alias(f"{m}_{name}") for m in METRICS for v, name in (("mean", "Mean"), ("se", "SE"))))


def best_models(long: DataFrame, order: Sequence[str] | None = None) -> DataFrame:
    """(metric, rna_type, model): the model of the highest mean for each metric and type, ``All`` included; missing
    means never win, ties go to the model that ``order`` lists first (else the first by name)."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col("model")) if order else F.col("model")
    means = long.groupingSets([["metric", "rna_type", "model"], ["metric", "model"]], "metric", "rna_type", "model").agg(F.grouping("rna_type").alias("g"), F.avg("value").alias("mean"))
    means = means.select("metric", F.when(F.col("g") == 1, "All").otherwise(F.col("rna_type")).alias("rna_type"), "model", "mean").where("mean is not null")
    top = Window.partitionBy("metric", "rna_type").orderBy(F.desc("mean"), place)
    return means.withColumn("at", F.row_number().over(top)).where("at = 1").select("metric", "rna_type", "model", "mean")
