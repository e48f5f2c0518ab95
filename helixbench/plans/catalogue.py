"""Queries over the driver's tables, with the SQL that DuckDB runs for the same rows."""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixbench.functions.expressions import depth, mutation_count, parse_mutations, rounded
from helixbench.operators import bootstrap, leaderboard, logprob, merge, metrics, mutations, pairs, scoring, splits, structure
from helixbench.operators.durable import checkpointed, shared_folder
from helixbench.plans.fixtures import fixture, parts, with_views
from helixbench.schema import models
from helixbench.sources import files

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
MODELS = ["m1", "m2", "m3", "m4"]


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = with_views(sql)
        return f

    return register


# ---------------------------------------------------------------- assay metrics and leaderboards


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = fixture(spark, sf_dir, "fx_variants").where("mutant is not null").select("dms_id", "mutant", "dms_score")
    p = fixture(spark, sf_dir, "fx_predictions").where("mutant is not null").select("model", "dms_id", F.replace("mutant", F.lit("T"), F.lit("U")).alias("mutant"), "score")
    on, n = ["dms_id", "mutant"], parts(spark, sf_dir, len(MODELS))
    return v.repartition(n, *on).join(p.repartition(n, *on), on)


def _metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.assay_metrics(_scored(spark, sf_dir), ["dms_id", "model"], parts=parts(spark, sf_dir, len(MODELS)))


def _depth_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _scored(spark, sf_dir).withColumn("depth", depth(F.col("mutant")))
    return metrics.assay_metrics(rows, ["dms_id", "model", "depth"], parts=parts(spark, sf_dir, len(MODELS)))


def _assay_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _metrics(spark, sf_dir)
    return found.join(F.broadcast(fixture(spark, sf_dir, "fx_assays").select("dms_id", "rna_type")), "dms_id")


def _metrics_sql(keys: str, extra: str = "") -> str:
    """CTE m (keys, spearman, auc, mcc)."""
    return f"""
v AS (SELECT dms_id, mutant, dms_score FROM fx_variants WHERE mutant IS NOT NULL),
s AS (SELECT p.model, v.dms_id, v.dms_score AS y, p.score AS x {extra} FROM v
      JOIN fx_predictions p ON p.dms_id = v.dms_id AND replace(p.mutant, 'T', 'U') = v.mutant WHERE p.score IS NOT NULL),
r AS (SELECT *, rank() OVER (PARTITION BY {keys} ORDER BY y) + (count(*) OVER (PARTITION BY {keys}, y) - 1) / 2.0 AS ry,
        rank() OVER (PARTITION BY {keys} ORDER BY x) + (count(*) OVER (PARTITION BY {keys}, x) - 1) / 2.0 AS rx,
        y > median(y) OVER (PARTITION BY {keys}) AS t, x > median(CAST(x AS DOUBLE)) OVER (PARTITION BY {keys}) AS b FROM s),
g AS (SELECT {keys}, covar_pop(CAST(rx AS DOUBLE), CAST(ry AS DOUBLE)) AS cov, stddev_pop(CAST(rx AS DOUBLE)) * stddev_pop(CAST(ry AS DOUBLE)) AS dev,
        CAST(sum(CASE WHEN t THEN rx END) AS DOUBLE) AS above, CAST(count(*) FILTER (t AND b) AS DOUBLE) AS tp, CAST(count(*) FILTER (NOT t AND b) AS DOUBLE) AS fp,
        CAST(count(*) FILTER (t AND NOT b) AS DOUBLE) AS fn, CAST(count(*) FILTER (NOT t AND NOT b) AS DOUBLE) AS tn FROM r GROUP BY {keys}),
a AS (SELECT *, tp + fn AS np, fp + tn AS nn, sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)) AS md FROM g),
m AS (SELECT {keys}, CASE WHEN np > 0 AND nn > 0 AND dev > 0 THEN abs(cov / dev) END AS spearman,
        CASE WHEN np > 0 AND nn > 0 THEN greatest((above - np * (np + 1) / 2) / (np * nn), 1 - (above - np * (np + 1) / 2) / (np * nn)) END AS auc,
        CASE WHEN np > 0 AND nn > 0 THEN CASE WHEN md > 0 THEN abs((tp * tn - fp * fn) / md) ELSE 0 END END AS mcc FROM a)"""


_M = "WITH " + _metrics_sql("dms_id, model").strip()
_TYPED = _M + ",\nty AS (SELECT m.*, rna_type FROM m JOIN fx_assays USING (dms_id))"
_LONG = _TYPED + """,
lo AS (SELECT dms_id, rna_type, model, 'spearman' AS metric, spearman AS value FROM ty UNION ALL SELECT dms_id, rna_type, model, 'auc', auc FROM ty
       UNION ALL SELECT dms_id, rna_type, model, 'mcc', mcc FROM ty),
ki AS (SELECT dms_id, rna_type AS kind, model, metric, value FROM lo UNION ALL SELECT dms_id, 'All', model, metric, value FROM lo),
me AS (SELECT metric, kind, model, avg(value) AS mean FROM ki GROUP BY metric, kind, model),
be AS (SELECT metric, kind, model, mean FROM (SELECT *, row_number() OVER (PARTITION BY metric, kind ORDER BY round(mean, 9) DESC, model) AS pl FROM me WHERE mean IS NOT NULL) WHERE pl = 1)"""
_ROUNDED = "round(spearman, 6) AS spearman, round(auc, 6) AS auc, round(mcc, 6) AS mcc"


@query(_TYPED + f"\nSELECT dms_id, rna_type, model, {_ROUNDED} FROM ty")
def assay_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _assay_metrics(spark, sf_dir).select("dms_id", "rna_type", "model", *rounded(*leaderboard.METRICS))


TYPES = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
_WIDE = ", ".join(f"round(avg({m}){'' if t == 'All' else f' FILTER (rna_type = {t!r})'}, 6) AS \"{m}_{t}_Mean\"" for m in leaderboard.METRICS for t in [*TYPES, "All"])


@query(_TYPED + f"\nSELECT model, {_WIDE} FROM ty GROUP BY model")
def leaderboard_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = leaderboard.wide(leaderboard.by_type(_assay_metrics(spark, sf_dir)), TYPES)
    return table.select("model", *(F.round(f"`{c}`", 6).alias(c) for c in table.columns[1:]))


@query(
    "WITH " + _metrics_sql("dms_id, model, depth", ", CASE WHEN len(string_split(v.mutant, ',')) = 1 THEN 'single' ELSE 'multiple' END AS depth").strip()
    + f""",
d AS (SELECT depth, model, avg(spearman) AS spearman, avg(auc) AS auc, avg(mcc) AS mcc FROM m GROUP BY depth, model)
SELECT depth, model, {_ROUNDED} FROM (SELECT * FROM d UNION ALL SELECT 'All', model, avg(spearman), avg(auc), avg(mcc) FROM d GROUP BY model)"""
)
def leaderboard_by_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaderboard.by_depth(_depth_metrics(spark, sf_dir)).select("depth", "model", *rounded(*leaderboard.METRICS)).orderBy("depth", "model")


@query(_LONG + "\nSELECT dms_id, rna_type, model, metric, round(value, 6) AS value FROM lo")
def assay_level_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaderboard.long_metrics(_assay_metrics(spark, sf_dir)).withColumn("value", F.round("value", 6))


@query(_LONG + "\nSELECT metric, kind AS rna_type, model, round(mean, 6) AS mean FROM be")
def best_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaderboard.best_models(leaderboard.long_metrics(_assay_metrics(spark, sf_dir))).withColumn("mean", F.round("mean", 6))


_BOOT = _LONG + """,
ids AS (SELECT dms_id, row_number() OVER (ORDER BY dms_id) - 1 AS pl FROM (SELECT DISTINCT dms_id FROM lo)),
n AS (SELECT count(*) AS n FROM ids),
dr AS (SELECT r.replicate, CAST(concat('0x', substr(md5(concat('42|', r.replicate, '|', k.k)), 1, 8)) AS BIGINT) % n.n AS pl
       FROM n, (SELECT unnest(range({r})) AS replicate) r, (SELECT unnest(range((SELECT n FROM n))) AS k) k),
di AS (SELECT a.metric, a.kind, a.model, a.dms_id, a.value - b.value AS d FROM ki a JOIN be USING (metric, kind) JOIN lo b ON b.metric = a.metric AND b.dms_id = a.dms_id AND b.model = be.model),
mr AS (SELECT metric, kind, model, replicate, avg(d) AS mean FROM dr JOIN ids USING (pl) JOIN di USING (dms_id) WHERE d IS NOT NULL GROUP BY metric, kind, model, replicate)
"""


@query(_BOOT.replace("{r}", str(bootstrap.REPLICATES)) + "SELECT metric, kind AS rna_type, model, round(stddev_samp(mean), 6) AS se FROM mr GROUP BY metric, kind, model")
def bootstrap_se(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = leaderboard.long_metrics(_assay_metrics(spark, sf_dir))
    return bootstrap.bootstrap_errors(long).withColumn("se", F.round("se", 6))


_SE = _BOOT.replace("{r}", "100").rstrip() + ",\nse AS (SELECT metric, kind, model, stddev_samp(mean) AS se FROM mr GROUP BY metric, kind, model)"
_WIDE_SE = ", ".join(f"round(max(CASE WHEN metric = {m!r} AND kind = {t!r} THEN {v} END), 6) AS \"{m}_{t}_{n}\"" for m in leaderboard.METRICS for t in [*TYPES, "All"] for v, n in (("mean", "Mean"), ("se", "SE")))


@query(_SE + f"\nSELECT model, {_WIDE_SE} FROM me LEFT JOIN se USING (metric, kind, model) GROUP BY model")
def leaderboard_with_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = checkpointed(_assay_metrics(spark, sf_dir))
    errors = bootstrap.bootstrap_errors(leaderboard.long_metrics(found), 100)
    table = leaderboard.with_errors(leaderboard.by_type(found), errors, TYPES)
    return table.select("model", *(F.round(f"`{c}`", 6).alias(c) for c in table.columns[1:]))


def _depth_boot(d: str) -> str:
    """CTE se_<d> (metric, model, se) over the assays that have the depth."""
    return f"""
lo_{d} AS (SELECT dms_id, model, 'spearman' AS metric, spearman AS value FROM m WHERE depth = '{d}' UNION ALL SELECT dms_id, model, 'auc', auc FROM m WHERE depth = '{d}'
       UNION ALL SELECT dms_id, model, 'mcc', mcc FROM m WHERE depth = '{d}'),
me_{d} AS (SELECT metric, model, avg(value) AS mean FROM lo_{d} GROUP BY metric, model),
be_{d} AS (SELECT metric, model FROM (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY round(mean, 9) DESC, model) AS pl FROM me_{d} WHERE mean IS NOT NULL) WHERE pl = 1),
ids_{d} AS (SELECT dms_id, row_number() OVER (ORDER BY dms_id) - 1 AS pl FROM (SELECT DISTINCT dms_id FROM lo_{d})),
n_{d} AS (SELECT count(*) AS n FROM ids_{d}),
dr_{d} AS (SELECT r.replicate, CAST(concat('0x', substr(md5(concat('42|', r.replicate, '|', k.k)), 1, 8)) AS BIGINT) % n.n AS pl
       FROM n_{d} n, (SELECT unnest(range({bootstrap.REPLICATES})) AS replicate) r, (SELECT unnest(range((SELECT n FROM n_{d}))) AS k) k),
di_{d} AS (SELECT a.metric, a.model, a.dms_id, a.value - b.value AS d FROM lo_{d} a JOIN be_{d} be ON be.metric = a.metric JOIN lo_{d} b ON b.metric = a.metric AND b.dms_id = a.dms_id AND b.model = be.model),
mr_{d} AS (SELECT metric, model, replicate, avg(d) AS mean FROM dr_{d} JOIN ids_{d} USING (pl) JOIN di_{d} USING (dms_id) WHERE d IS NOT NULL GROUP BY metric, model, replicate),
se_{d} AS (SELECT metric, model, stddev_samp(mean) AS se FROM mr_{d} GROUP BY metric, model)"""


_DEPTHS = _metrics_sql("dms_id, model, depth", ", CASE WHEN len(string_split(v.mutant, ',')) = 1 THEN 'single' ELSE 'multiple' END AS depth").strip()
_DEPTH_SE = ", ".join(f"round({m}, 6) AS {m}_Mean, round((SELECT max(se) FROM er WHERE er.metric = '{m}' AND er.depth = l.depth AND er.model = l.model), 6) AS {m}_SE" for m in leaderboard.METRICS)


@query(f"""WITH {_DEPTHS},{_depth_boot("single")},{_depth_boot("multiple")},
er AS (SELECT 'single' AS depth, metric, model, se FROM se_single UNION ALL SELECT 'multiple', metric, model, se FROM se_multiple
       UNION ALL SELECT 'All', s.metric, s.model, sqrt((s.se * s.se + t.se * t.se) / 2) FROM se_single s JOIN se_multiple t USING (metric, model)),
d AS (SELECT depth, model, avg(spearman) AS spearman, avg(auc) AS auc, avg(mcc) AS mcc FROM m GROUP BY depth, model),
l AS (SELECT * FROM d UNION ALL SELECT 'All', model, avg(spearman), avg(auc), avg(mcc) FROM d GROUP BY model)
SELECT depth, model, {_DEPTH_SE} FROM l""")
def depth_with_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = checkpointed(_depth_metrics(spark, sf_dir))
    errors = bootstrap.depth_errors(leaderboard.long_metrics(found, ("dms_id", "depth", "model")))
    table = leaderboard.depth_with_errors(leaderboard.by_depth(found), errors)
    return table.select("depth", "model", *rounded(*table.columns[2:]))


@query(_M + ",\nmo AS (SELECT DISTINCT model FROM fx_predictions)\nSELECT a.dms_id, mo.model, round(auc, 6) AS auc FROM fx_assays a CROSS JOIN mo LEFT JOIN m ON m.dms_id = a.dms_id AND m.model = mo.model")
def metrics_on_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    assays = fixture(spark, sf_dir, "fx_assays").select("dms_id")
    return metrics.on_grid(_metrics(spark, sf_dir), assays, spark.createDataFrame([(m,) for m in MODELS], "model string")).select("dms_id", "model", F.round("auc", 6).alias("auc"))


def _stored_variants(spark: SparkSession, sf_dir: str) -> str:
    """The variants in a table of their own, for a query that reads them several times."""
    path = _place(spark, "variants")
    fixture(spark, sf_dir, "fx_variants").write.parquet(path)
    return path


# ---------------------------------------------------------------- merge


def _predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture(spark, sf_dir, "fx_predictions")


_LOSS = """WITH v AS (SELECT dms_id, mutant, dms_score FROM fx_variants WHERE mutant IS NOT NULL),
w AS (SELECT dms_id, model, mutant FROM v, (SELECT unnest(['m1', 'm2', 'm3', 'm4']) AS model)),
p AS (SELECT DISTINCT model, dms_id, replace(mutant, 'T', 'U') AS mutant FROM fx_predictions WHERE mutant IS NOT NULL),
f AS (SELECT DISTINCT model, dms_id FROM fx_predictions),
loss AS (SELECT w.dms_id, w.model, count(*) AS n_variants, count(*) - count(p.mutant) AS n_lost, max(f.model) IS NOT NULL AS has_file
         FROM w LEFT JOIN p ON p.model = w.model AND p.dms_id = w.dms_id AND p.mutant = w.mutant LEFT JOIN f ON f.model = w.model AND f.dms_id = w.dms_id GROUP BY w.dms_id, w.model)"""


@query(_LOSS + "\nSELECT dms_id, model, n_variants, n_lost, has_file FROM loss")
def merge_loss_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.loss_report(fixture(spark, sf_dir, "fx_variants"), _predictions(spark, sf_dir), MODELS)


@query(
    _LOSS + """,
ok AS (SELECT dms_id FROM loss GROUP BY dms_id HAVING bool_and(has_file AND n_lost = 0)),
q AS (SELECT model, dms_id, replace(mutant, 'T', 'U') AS mutant, min(score) AS score FROM fx_predictions WHERE mutant IS NOT NULL GROUP BY ALL)
SELECT v.dms_id, v.mutant, v.dms_score, q.model, round(q.score, 6) AS score FROM v JOIN ok USING (dms_id) JOIN q ON q.dms_id = v.dms_id AND q.mutant = v.mutant"""
)
def merge_complete_assays(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = merge.merge(fixture(spark, sf_dir, "fx_variants"), _predictions(spark, sf_dir), MODELS, ["score"])
    return rows.withColumn("score", F.round("score", 6))


_OK = _LOSS + """,
ok AS (SELECT dms_id FROM loss GROUP BY dms_id HAVING bool_and(has_file AND n_lost = 0))"""


@query(_OK + """,
q AS (SELECT dms_id, replace(mutant, 'T', 'U') AS mutant, """ + ", ".join(f"min(score) FILTER (model = '{m}') AS {m}" for m in MODELS) + """ FROM fx_predictions WHERE mutant IS NOT NULL GROUP BY ALL)
SELECT v.dms_id, v.mutant, v.dms_score, """ + ", ".join(f"round({m}, 6) AS {m}_score" for m in MODELS) + " FROM v JOIN ok USING (dms_id) JOIN q ON q.dms_id = v.dms_id AND q.mutant = v.mutant")
def combined_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = merge.merge_wide(fixture(spark, sf_dir, "fx_variants"), _predictions(spark, sf_dir), MODELS, ["score"])
    return rows.select("dms_id", "mutant", "dms_score", *rounded(*(f"{m}_score" for m in MODELS)))


@query("SELECT a.dms_id, m.model FROM fx_assays a, (SELECT DISTINCT model FROM fx_predictions) m WHERE NOT EXISTS (SELECT 1 FROM fx_predictions p WHERE p.dms_id = a.dms_id AND p.model = m.model)")
def manifest_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _predictions(spark, sf_dir).select("dms_id", "model").distinct()
    sheet = fixture(spark, sf_dir, "fx_assays").select("dms_id")
    return sheet.join(F.broadcast(spark.createDataFrame([(m,) for m in MODELS], "model string"))).join(p, ["dms_id", "model"], "left_anti")


# ---------------------------------------------------------------- structure


def _attached(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.attach_ranges(fixture(spark, sf_dir, "fx_labels"), fixture(spark, sf_dir, "fx_ranges"))


_AT = "WITH pl AS (SELECT l.id, l.reactivity, l.usage, r.sequence_id, r.id_min FROM fx_labels l LEFT JOIN fx_ranges r ON l.id BETWEEN r.id_min AND r.id_max)"
_NUM = _AT + ",\nnum AS (SELECT *, CASE WHEN sequence_id IS NOT NULL THEN CAST(row_number() OVER (PARTITION BY sequence_id ORDER BY id) - 1 AS INT) END AS position_id FROM pl)"


@query(_AT + "\nSELECT id, usage, round(reactivity, 6) AS reactivity, CAST(sequence_id AS VARCHAR) AS sequence_id FROM pl")
def range_attach(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _attached(spark, sf_dir).select("id", "usage", F.round("reactivity", 6).alias("reactivity"), F.col("sequence_id").cast("string"))


@query(_NUM + "\nSELECT id, CAST(sequence_id AS VARCHAR) AS sequence_id, CAST(position_id AS VARCHAR) AS position_id FROM num")
def position_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.number_positions(_attached(spark, sf_dir)).orderBy("sequence_id", "id").select("id", F.col("sequence_id").cast("string"), F.col("position_id").cast("string"))


_EVAL = """WITH pl AS (SELECT l.id, l.reactivity, l.usage, r.sequence_id, r.sequence FROM fx_labels l LEFT JOIN fx_ranges r ON l.id BETWEEN r.id_min AND r.id_max),
ev AS (SELECT *, CAST(row_number() OVER (PARTITION BY sequence_id ORDER BY id) - 1 AS INT) AS position_id FROM pl WHERE sequence IN (SELECT sequence FROM pl WHERE usage = 'Private'))"""


def _evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.evaluation_set(fixture(spark, sf_dir, "fx_labels"), fixture(spark, sf_dir, "fx_ranges"))


@query(_EVAL + "\nSELECT id, sequence_id, sequence, position_id, usage, round(reactivity, 6) AS reactivity FROM ev")
def eval_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _evaluation(spark, sf_dir).select("id", "sequence_id", "sequence", "position_id", "usage", F.round("reactivity", 6).alias("reactivity"))


@query(_EVAL + "\nSELECT id, round(prediction, 6) AS prediction FROM fx_id_predictions WHERE id IN (SELECT id FROM ev)")
def eval_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = structure.predictions_of(fixture(spark, sf_dir, "fx_id_predictions"), _evaluation(spark, sf_dir))
    return rows.select("id", F.round("prediction", 6).alias("prediction"))


@query(_EVAL + """,
fr AS (SELECT sequence, min(id) AS id FROM pl WHERE usage = 'Private' GROUP BY sequence)
SELECT pl.id, pl.sequence, CAST(pl.sequence_id AS VARCHAR) AS sequence_id, round(reactivity, 6) AS reactivity FROM fr JOIN pl ON pl.id = fr.id""")
def private_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = structure.first_of_each(fixture(spark, sf_dir, "fx_labels"), fixture(spark, sf_dir, "fx_ranges"))
    return rows.select("id", "sequence", F.col("sequence_id").cast("string"), F.round("reactivity", 6).alias("reactivity"))


#: Only ranges whose ids are all there: the labels of an order with fewer lines than its range has ids are left out.
_GAPLESS = _AT + """,
wh AS (SELECT r.sequence_id FROM fx_ranges r JOIN pl ON pl.sequence_id = r.sequence_id GROUP BY r.sequence_id, r.id_min, r.id_max HAVING count(DISTINCT pl.id) = r.id_max - r.id_min + 1)"""


@query(_GAPLESS + "\nSELECT id, CAST(sequence_id AS VARCHAR) AS sequence_id, CAST(id - id_min AS INT) AS position_id FROM pl WHERE sequence_id IN (SELECT sequence_id FROM wh)")
def gap_free_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions by distance, where it was checked that no range has a gap; else they are counted."""
    ranges, rows = fixture(spark, sf_dir, "fx_ranges"), _attached(spark, sf_dir)
    whole = structure.ranges_without_gaps(rows, ranges)
    kept = structure.attach_ranges(fixture(spark, sf_dir, "fx_labels"), whole, inner=True)
    numbered = structure.number_positions(kept, gap_free=structure.without_gaps(kept, whole), all_known=True)
    return numbered.select("id", F.col("sequence_id").cast("string"), "position_id")


@query(_AT + "\nSELECT count(*) AS n_shared FROM (SELECT sequence_id FROM pl WHERE usage = 'Private' INTERSECT SELECT sequence_id FROM pl WHERE usage = 'Public')")
def usage_disjoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _attached(spark, sf_dir)
    return structure.overlap(structure.of_usage(rows, "Private"), structure.of_usage(rows, "Public"), "sequence_id")


def _binned(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = structure.not_ignored(structure.number_positions(_attached(spark, sf_dir)))
    rows = structure.align(labels, fixture(spark, sf_dir, "fx_position_predictions"))
    return metrics.median_bins(metrics.clipped(rows, ["reactivity", "prediction"]), ["sequence_id"], ["reactivity", "prediction"])


_BIN = _NUM + """,
al AS (SELECT num.id, num.sequence_id, num.position_id, least(greatest(reactivity, 0), 1) AS y, least(greatest(prediction, 0), 1) AS x
       FROM num JOIN fx_position_predictions p ON p.sequence_id = num.sequence_id AND p.position_id = num.position_id WHERE usage IS DISTINCT FROM 'Ignored' AND prediction IS NOT NULL),
bi AS (SELECT *, y > median(y) OVER (PARTITION BY sequence_id) AS t, x > median(x) OVER (PARTITION BY sequence_id) AS b FROM al)"""


@query(_BIN + "\nSELECT id, round(y, 6) AS reactivity, round(x, 6) AS prediction, t AS reactivity_bin, b AS prediction_bin FROM bi")
def structure_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _binned(spark, sf_dir).select("id", *rounded("reactivity", "prediction"), "reactivity_bin", "prediction_bin")


@query(
    _BIN + """,
h AS (SELECT x, count(*) FILTER (t) AS p, count(*) FILTER (NOT t) AS n FROM bi GROUP BY x),
c AS (SELECT *, sum(n) OVER (ORDER BY x) - n AS before FROM h),
g AS (SELECT avg(abs(y - x)) AS mae, CAST(count(*) FILTER (t AND b) AS DOUBLE) AS tp, CAST(count(*) FILTER (NOT t AND b) AS DOUBLE) AS fp,
        CAST(count(*) FILTER (t AND NOT b) AS DOUBLE) AS fn, CAST(count(*) FILTER (NOT t AND NOT b) AS DOUBLE) AS tn FROM bi)
SELECT round((SELECT CAST(sum(p * (before + n / 2.0)) AS DOUBLE) / (CAST(sum(p) AS DOUBLE) * sum(n)) FROM c), 6) AS auc,
  round((tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 6) AS mcc, round(mae, 6) AS mae,
  round((2 * tp / (2 * tp + fp + fn) + 2 * tn / (2 * tn + fn + fp)) / 2, 6) AS f1 FROM g"""
)
def structure_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.position_metrics(_binned(spark, sf_dir), "reactivity", "prediction", []).select(*rounded("auc", "mcc", "mae", "f1"))


@query("SELECT seq_id, i, round(product(1 - p), 6) AS p_unpaired FROM fx_pair_probs GROUP BY seq_id, i")
def unpaired_probability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.unpaired_probability(fixture(spark, sf_dir, "fx_pair_probs")).withColumn("p_unpaired", F.round("p_unpaired", 6))


# ---------------------------------------------------------------- base pairs

_PAIRS = """WITH ch AS (SELECT seq_id, method, unnest(range(len(dotbracket))) AS pl, unnest(string_split(dotbracket, '')) AS c FROM fx_structures),
mk AS (SELECT seq_id, method, pl, CASE WHEN c IN ('(', ')') THEN 0 WHEN c IN ('[', ']') THEN 1 WHEN c IN ('<', '>') THEN 2 WHEN c IN ('{', '}') THEN 3 END AS fam, c IN ('(', '[', '<', '{') AS o FROM ch),
lv AS (SELECT *, sum(CASE WHEN o THEN 1 ELSE -1 END) OVER (PARTITION BY seq_id, method, fam ORDER BY pl) + CASE WHEN o THEN 0 ELSE 1 END AS lvl FROM mk WHERE fam IS NOT NULL),
nx AS (SELECT *, lead(pl) OVER w AS j, lead(o) OVER w AS no FROM lv WINDOW w AS (PARTITION BY seq_id, method, fam, lvl ORDER BY pl)),
pr AS (SELECT seq_id, method, CAST(pl AS INT) AS i, CAST(j AS INT) AS j FROM nx WHERE o AND NOT no),
cx AS (SELECT a.seq_id, a.method, a.i AS ai, a.j AS aj, b.i AS bi, b.j AS bj FROM pr a JOIN pr b ON a.seq_id = b.seq_id AND a.method = b.method AND a.i < b.i AND b.i < a.j AND a.j < b.j),
cr AS (SELECT seq_id, method, ai AS i, aj AS j FROM cx UNION SELECT seq_id, method, bi, bj FROM cx)"""


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.dotbracket_pairs(fixture(spark, sf_dir, "fx_structures"))


@query(_PAIRS + "\nSELECT seq_id, method, i, j FROM pr")
def dotbracket_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir)


@query(_PAIRS + "\nSELECT seq_id, method, i, j FROM cr")
def crossing_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    arrays = pairs.pair_arrays(fixture(spark, sf_dir, "fx_structures"))
    return pairs.listed(arrays.select("seq_id", "method", pairs.crossing(F.col("pairs")).alias("pairs")))


@query(
    _PAIRS + """,
grid AS (SELECT s.seq_id, s.method FROM fx_structures s WHERE s.method <> 'truth' AND s.seq_id IN (SELECT seq_id FROM cr WHERE method = 'truth')),
f AS (SELECT g.seq_id, g.method,
  (SELECT count(*) FROM pr x WHERE x.seq_id = g.seq_id AND x.method = g.method) AS said, (SELECT count(*) FROM pr x WHERE x.seq_id = g.seq_id AND x.method = 'truth') AS real,
  (SELECT count(*) FROM pr x JOIN pr y ON x.seq_id = y.seq_id AND x.i = y.i AND x.j = y.j WHERE y.method = 'truth' AND x.seq_id = g.seq_id AND x.method = g.method) AS hit,
  (SELECT count(*) FROM cr x WHERE x.seq_id = g.seq_id AND x.method = g.method) AS said_x, (SELECT count(*) FROM cr x WHERE x.seq_id = g.seq_id AND x.method = 'truth') AS real_x,
  (SELECT count(*) FROM cr x JOIN cr y ON x.seq_id = y.seq_id AND x.i = y.i AND x.j = y.j WHERE y.method = 'truth' AND x.seq_id = g.seq_id AND x.method = g.method) AS hit_x FROM grid g)
SELECT seq_id, method, round(CASE WHEN said + real > 0 THEN 2.0 * hit / (said + real) ELSE 0 END, 6) AS f1,
  round(CASE WHEN said_x + real_x > 0 THEN 2.0 * hit_x / (said_x + real_x) ELSE 0 END, 6) AS crossed_f1 FROM f"""
)
def pair_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    arrays = pairs.pair_arrays(fixture(spark, sf_dir, "fx_structures"))
    return pairs.array_scores(arrays).select("seq_id", "method", *rounded("f1", "crossed_f1"))


@query()
def structure_scores_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = pairs.wide_scores(pair_f1(spark, sf_dir), ["p1", "p2"])
    return wide.select("seq_id", *(F.col(f"{m}.{v}").alias(f"{m}_{v}") for m in ("p1", "p2") for v in ("f1", "crossed_f1")))


ORACLE_SQL["structure_scores_wide"] = "SELECT seq_id, " + ", ".join(f"max({v}) FILTER (method = '{m}') AS {m}_{v}" for m in ("p1", "p2") for v in ("f1", "crossed_f1")) + f" FROM ({ORACLE_SQL['pair_f1']}) GROUP BY seq_id"


@query("SELECT seq_id FROM fx_structures WHERE method = 'truth' AND seq_id NOT IN (SELECT seq_id FROM fx_structures WHERE method = 'p1' AND seq_id % 7 <> 0)")
def structures_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixture(spark, sf_dir, "fx_structures").select("seq_id", "method")
    return pairs.missing_predictions(rows.where("method = 'truth'").select("seq_id"), rows.where("method = 'p1' and seq_id % 7 <> 0"), "seq_id")


@query(_PAIRS + "\nSELECT seq_id FROM (SELECT DISTINCT seq_id FROM fx_structures) WHERE seq_id NOT IN (SELECT seq_id FROM cr WHERE method = 'truth')")
def structures_without_crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.arrays_without_crossings(pairs.pair_arrays(fixture(spark, sf_dir, "fx_structures")))


@query(_PAIRS + "\nSELECT seq_id, i, j FROM pr WHERE method = 'truth'")
def ct_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connect-table lines made of the stand-in's structures, parsed."""
    rows = fixture(spark, sf_dir, "fx_structures").where("method = 'truth'")
    ends = lambda p: F.array(*(F.struct(x.alias("at"), (y + 1).alias("partner")) for x, y in (pairs.ends(p), pairs.ends(p)[::-1])))
    arrays = pairs.pair_arrays(rows, ["seq_id"]).select("seq_id", F.map_from_entries(F.flatten(F.transform("pairs", ends))).alias("partners"))
    # Partners are looked up within the row: a join would be planned by the size of the table that they are parsed from.
    cells = arrays.select("seq_id", "partners", F.posexplode(F.split(F.md5(F.col("seq_id").cast("string").cast("binary")), "")).alias("at", "base"))
    line = F.concat_ws(" ", F.col("at") + 1, "base", "at", F.col("at") + 2, F.coalesce(F.element_at("partners", F.col("at")), F.lit(0)), F.col("at") + 1)
    lines = cells.select("seq_id", line.alias("value")).unionByName(rows.select("seq_id", F.lit("32 a structure").alias("value")))
    return files.parse_ct(lines.withColumnRenamed("seq_id", "path"))[1].select(F.col("path").alias("seq_id"), "i", "j")


# ---------------------------------------------------------------- mutations and log-probabilities


@query("""WITH v AS (SELECT DISTINCT dms_id, mutant FROM fx_variants WHERE mutant IS NOT NULL),
p AS (SELECT dms_id, mutant, len(string_split(mutant, ',')) AS n, unnest(string_split(mutant, ',')) AS m FROM v)
SELECT dms_id, mutant, CAST(n AS INT) AS n_mutations, CASE WHEN n = 1 THEN 'single' ELSE 'multiple' END AS depth,
  substr(m, 1, 1) AS old, CAST(substr(m, 2, length(m) - 2) AS INT) AS pos, substr(m, length(m), 1) AS new FROM p""")
def mutation_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixture(spark, sf_dir, "fx_variants").select("dms_id", "mutant").dropna("any").distinct()
    parsed = rows.select("dms_id", "mutant", mutation_count(F.col("mutant")).alias("n_mutations"), depth(F.col("mutant")).alias("depth"), F.explode(parse_mutations(F.col("mutant"))).alias("m"))
    return parsed.select("dms_id", "mutant", "n_mutations", "depth", "m.*")


def _step_sql(mode: str, k: int) -> str:
    """CTE f<k>: mutation k applied to the sequence and reason of f<k-1>."""
    letters = "'A', 'U', 'C', 'G', 'N'" if mode == "substitute" else "'A', 'T', 'C', 'G', 'N'"
    unchecked = "FALSE" if mode == "fill" else "o = 'N'"
    behind = "WHEN o = 'N' THEN concat(substr(s, 1, p), put, substr(s, p + 1))" if mode == "insert" else ""
    return f"""
o{k} AS (SELECT *, ms[{k}] AS m, substr(ms[{k}], 1, 1) AS o, TRY_CAST(substr(ms[{k}], 2, greatest(length(ms[{k}]) - 2, 0)) AS INT) AS p, right(ms[{k}], 1) AS n FROM f{k - 1}),
r{k} AS (SELECT *, CASE WHEN n = '-' THEN '' ELSE n END AS put, CASE WHEN m IS NULL OR r IS NOT NULL THEN r WHEN p IS NULL THEN 'position'
        WHEN o NOT IN ({letters}) OR n NOT IN ({letters}, '-') THEN 'letter' WHEN p < 1 OR p > length(s) THEN 'outside' WHEN NOT ({unchecked}) AND substr(s, p, 1) <> o THEN 'mismatch' END AS r2 FROM o{k}),
f{k} AS (SELECT dms_id, mutant, ms, CASE WHEN m IS NULL OR r2 IS NOT NULL THEN s {behind} ELSE concat(substr(s, 1, p - 1), put, substr(s, p + 1)) END AS s, r2 AS r FROM r{k})"""


def _edited_sql(mode: str) -> str:
    own = lambda x: f"translate(upper({x}), {chr(39) + 'T' + chr(39) if mode == 'substitute' else chr(39) + 'U' + chr(39)}, {chr(39) + 'U' + chr(39) if mode == 'substitute' else chr(39) + 'T' + chr(39)})"
    end = "replace(s, 'N', '')" if mode == "fill" else "s"
    return f"""WITH f0 AS (SELECT e.dms_id, e.mutant, string_split({own("e.mutant")}, ',') AS ms, {own("construct")} AS s, CAST(NULL AS VARCHAR) AS r FROM fx_edits e JOIN fx_constructs c ON c.dms_id = e.dms_id),{_step_sql(mode, 1)},{_step_sql(mode, 2)},{_step_sql(mode, 3)}
SELECT dms_id, mutant, CASE WHEN r IS NULL THEN {end} END AS mutated_sequence, r AS reason FROM f3"""


def _edited(spark: SparkSession, sf_dir: str, mode: str) -> DataFrame:
    return mutations.mutated_sequences(fixture(spark, sf_dir, "fx_edits"), fixture(spark, sf_dir, "fx_constructs"), mode)


@query(_edited_sql("insert"))
def mutated_sequences_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edited(spark, sf_dir, "insert")


@query(_edited_sql("fill"))
def mutated_sequences_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edited(spark, sf_dir, "fill")


@query(_edited_sql("substitute"))
def mutated_sequences_substitute(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edited(spark, sf_dir, "substitute")


def _mutated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants of the plain stand-in that could be made, with their RNA sequences. The stand-in is grouped by assay and
    mutant already, within the parts that it is dealt into by assay: no shuffle for their distinct pairs."""
    rows = fixture(spark, sf_dir, "fx_variants").select("dms_id", "mutant")
    return mutations.mutated_sequences(rows, fixture(spark, sf_dir, "fx_assays"), "substitute").where("reason is null")


_MUTATED = """WITH v AS (SELECT DISTINCT v.dms_id, mutant, construct AS c, string_split(mutant, ',') AS ms FROM fx_variants v JOIN fx_assays USING (dms_id) WHERE mutant IS NOT NULL),
f AS (SELECT dms_id, mutant, c AS s0, len(ms) AS n, substr(ms[1], 1, 1) AS o1, CAST(substr(ms[1], 2, length(ms[1]) - 2) AS INT) AS p1, right(ms[1], 1) AS n1,
  CASE WHEN len(ms) > 1 THEN substr(ms[2], 1, 1) END AS o2, CASE WHEN len(ms) > 1 THEN CAST(substr(ms[2], 2, length(ms[2]) - 2) AS INT) END AS p2, CASE WHEN len(ms) > 1 THEN right(ms[2], 1) END AS n2 FROM v),
g AS (SELECT *, substr(s0, p1, 1) = o1 AS ok1, concat(substr(s0, 1, p1 - 1), n1, substr(s0, p1 + 1)) AS s1 FROM f),
mu AS (SELECT dms_id, mutant, CASE WHEN n = 1 THEN s1 ELSE concat(substr(s1, 1, p2 - 1), n2, substr(s1, p2 + 1)) END AS sequence FROM g WHERE ok1 AND (n = 1 OR substr(s1, p2, 1) = o2))"""


@query(_MUTATED + """,
li AS (SELECT DISTINCT sequence AS seqs, CAST(ascii(substr(md5(sequence), 2, 1)) AS DOUBLE) AS scores FROM mu WHERE substr(md5(sequence), 1, 1) < '8')
SELECT dms_id, mutant, sequence, scores FROM mu LEFT JOIN li ON seqs = sequence""")
def likelihood_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _mutated(spark, sf_dir).select("dms_id", "mutant", "mutated_sequence")
    digest = F.md5(F.col("mutated_sequence").cast("binary"))
    scores = F.ascii(F.substring(digest, 2, 1)).cast("double")
    known = rows.where(F.substring(digest, 1, 1) < "8").select(F.col("mutated_sequence").alias("seqs"), scores.alias("scores")).distinct()
    return mutations.with_likelihoods(rows, known).withColumnRenamed("mutated_sequence", "sequence")


@query("SELECT dms_id, substr(construct, 1, 10) AS start FROM fx_assays WHERE dms_id NOT LIKE '%S1%'")
def truncated_constructs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mutations.without_assays(fixture(spark, sf_dir, "fx_assays"), "S1")
    return rows.select("dms_id", mutations.truncated(F.col("construct"), 10).alias("start"))


def _marginal_sql(table: str, keys: str, own: str) -> str:
    """CTE s (dms_id, mutant, d, bad): for each mutation the difference to the letter ``own``, null without both."""
    return f"""WITH v AS (SELECT DISTINCT dms_id, mutant FROM fx_variants WHERE mutant IS NOT NULL),
p AS (SELECT dms_id, mutant, unnest(string_split(mutant, ',')) AS m FROM v),
x AS (SELECT p.dms_id, p.mutant, substr(m, 1, 1) AS old, CAST(substr(m, 2, length(m) - 2) AS INT) AS pos, substr(m, length(m), 1) AS new, construct FROM p JOIN fx_constructs USING (dms_id)),
o AS (SELECT *, {own} AS own, substr(construct, pos, 1) <> old AS bad FROM x),
s AS (SELECT o.dms_id, o.mutant, a.logp - b.logp AS d, bad FROM o LEFT JOIN {table} a ON {keys.format("a")} AND a.base = o.new LEFT JOIN {table} b ON {keys.format("b")} AND b.base = o.own)"""


@query(_marginal_sql("fx_logp", "{0}.dms_id = o.dms_id AND {0}.pos = o.pos", "old") + "\nSELECT dms_id, mutant, CASE WHEN NOT bool_or(bad) AND count(*) = count(d) THEN sum(d) END AS score, bool_or(bad) AS mismatch FROM s GROUP BY dms_id, mutant")
def wildtype_marginal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Constructs of which every third has an N, so that some variants name another letter than is there."""
    return logprob.wildtype_marginal(fixture(spark, sf_dir, "fx_variants"), fixture(spark, sf_dir, "fx_constructs"), fixture(spark, sf_dir, "fx_logp"))


@query(_marginal_sql("fx_masked", "{0}.dms_id = o.dms_id AND {0}.mutant = o.mutant AND {0}.pos = o.pos", "substr(replace(construct, 'N', ''), pos, 1)") + "\nSELECT dms_id, mutant, CASE WHEN count(*) = count(d) THEN sum(d) END AS score FROM s GROUP BY dms_id, mutant")
def masked_marginal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each variant has a table of its own; N is taken out of the constructs, which moves the letters behind it."""
    stored = _stored_variants(spark, sf_dir)
    masked = fixture(spark, sf_dir, "fx_masked", stored)
    return logprob.masked_marginal(fixture(spark, sf_dir, "fx_variants", stored), fixture(spark, sf_dir, "fx_constructs"), masked, strip_n=True)


_TOKENS = """WITH t AS (SELECT l.dms_id, l.pos, l.logp, substr(construct, l.pos, 1) = l.base AS own, l.pos % 5 = 0 AS padding FROM fx_logp l JOIN fx_assays USING (dms_id))
SELECT dms_id, """


def _tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixture(spark, sf_dir, "fx_logp").join(fixture(spark, sf_dir, "fx_assays").select("dms_id", "construct"), "dms_id")
    own = rows.where(F.substring("construct", F.col("pos"), F.lit(1)) == F.col("base"))
    return own.select("dms_id", "pos", "logp", (F.col("pos") % 5 == 0).alias("padding"), F.when(F.col("pos") % 5 == 0, 0).otherwise(1).alias("mask"))


@query(_TOKENS + "round(avg(logp), 6) AS mean_logp, count(*) AS n_tokens FROM t WHERE own AND NOT padding GROUP BY dms_id")
def mean_loglik(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logprob.mean_loglik(_tokens(spark, sf_dir), ["dms_id"]).withColumn("mean_logp", F.round("mean_logp", 6))


@query(_TOKENS + "round(sum(CASE WHEN padding THEN 0 ELSE -logp END), 6) AS loss, count(*) FILTER (NOT padding) AS n_tokens FROM t WHERE own GROUP BY dms_id")
def sum_cross_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logprob.sum_cross_entropy(_tokens(spark, sf_dir), ["dms_id"]).withColumn("loss", F.round("loss", 6))


@query("""SELECT dms_id, pos, base, round(logp - max(logp) OVER w - ln(sum(exp(logp - m)) OVER w), 6) AS logp
FROM (SELECT *, max(logp) OVER (PARTITION BY dms_id, pos) AS m FROM fx_logp) WINDOW w AS (PARTITION BY dms_id, pos)""")
def log_softmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    logits = fixture(spark, sf_dir, "fx_logp").withColumnRenamed("logp", "logit")
    return logprob.log_softmax(logits, ["dms_id", "pos"]).select("dms_id", "pos", "base", F.round("logp", 6).alias("logp"))


@query("SELECT dms_id, CAST(max(length(construct)) AS INT) AS longest, max(length(construct)) > 24 AS too_long FROM fx_assays GROUP BY dms_id")
def length_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mutations.too_long(fixture(spark, sf_dir, "fx_assays"), "construct", 24)


# ---------------------------------------------------------------- splits and scoring


@query("""WITH v AS (SELECT DISTINCT dms_id, mutant FROM fx_variants WHERE mutant IS NOT NULL),
o AS (SELECT *, row_number() OVER (PARTITION BY dms_id ORDER BY md5(concat('42|', dms_id, '|', mutant))) AS pl, count(*) OVER (PARTITION BY dms_id) AS n FROM v)
SELECT dms_id, mutant, CASE WHEN pl <= ceil(CAST(0.2 AS DOUBLE) * n) THEN 'val' ELSE 'train' END AS fold FROM o""")
def random_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixture(spark, sf_dir, "fx_variants").where("mutant is not null").select("dms_id", "mutant").distinct()
    return splits.random_split(rows, ["dms_id", "mutant"])


@query("""WITH v AS (SELECT DISTINCT dms_id, mutant FROM fx_variants WHERE mutant IS NOT NULL),
o AS (SELECT *, row_number() OVER (PARTITION BY dms_id ORDER BY md5(concat('42|', dms_id, '|', mutant))) AS pl, count(*) OVER (PARTITION BY dms_id) AS n FROM v)
SELECT dms_id, CASE WHEN pl <= ceil(CAST(0.2 AS DOUBLE) * n) THEN 'val' ELSE 'train' END AS fold, count(*) AS n FROM o GROUP BY ALL""")
def split_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.split_sizes(random_split(spark, sf_dir))


#: Common subsequences by bit vectors: a list step for each letter of the second sequence.
_LINKS = _MUTATED + """,
se AS (SELECT DISTINCT dms_id, sequence AS s FROM mu),
bi AS (SELECT dms_id, s, CAST(length(s) AS BIGINT) AS n, (CAST(1 AS BIGINT) << length(s)) - 1 AS whole,
  list_transform(['A', 'C', 'G', 'U'], lambda l: list_sum(list_transform(range(length(s)), lambda i: CASE WHEN substr(s, CAST(i + 1 AS INT), 1) = l THEN CAST(1 AS BIGINT) << i ELSE 0 END))::BIGINT) AS mask,
  list_transform(string_split(s, ''), lambda c: position(c IN 'ACGU')) AS codes FROM se),
pa AS (SELECT a.dms_id, a.s AS a, b.s AS b, greatest(a.n, b.n) AS longer, a.n - bit_count(list_reduce(list_prepend(a.whole, list_transform(b.codes, lambda c: a.mask[c])), lambda v, m: ((v + (v & m)) | (v - (v & m))) & a.whole)) AS common
       FROM bi a JOIN bi b ON a.dms_id = b.dms_id AND a.s < b.s),
li AS (SELECT dms_id, a, b FROM pa WHERE common > 0.8 * longer),
nl AS (SELECT dms_id, s, count(*) AS n FROM (SELECT dms_id, a AS s FROM li UNION ALL SELECT dms_id, b FROM li) GROUP BY dms_id, s)"""


@query(_LINKS + "\nSELECT se.dms_id, se.s AS sequence, coalesce(n, 0) AS n_links FROM se LEFT JOIN nl USING (dms_id, s)")
def similarity_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.similarity_classes(_mutated(spark, sf_dir), "dms_id", "mutated_sequence").drop("class")


#: Classes by labels that spread along the links until none falls.
_CLASSES = _LINKS + """,
ed AS (SELECT dms_id, a, b FROM li UNION ALL SELECT dms_id, b, a FROM li),
lab(dms_id, s, c) USING KEY (dms_id, s) AS (SELECT dms_id, s, s FROM se UNION
  SELECT e.dms_id, e.b, min(l.c) FROM lab l JOIN ed e ON e.dms_id = l.dms_id AND e.a = l.s JOIN recurring.lab r ON r.dms_id = e.dms_id AND r.s = e.b WHERE l.c < r.c GROUP BY e.dms_id, e.b)"""


@query(_CLASSES + "\nSELECT lab.dms_id, lab.s AS sequence, c AS class, coalesce(n, 0) AS n_links FROM lab LEFT JOIN nl USING (dms_id, s)")
def similarity_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.similarity_classes(_mutated(spark, sf_dir), "dms_id", "mutated_sequence")


def _gains(k: str, folds: str) -> str:
    """CTE g<k>: links of each sequence to val (members: ``folds``) and across, and what moving it would gain."""
    return f"""
x{k} AS (SELECT dms_id, s, count(*) AS cr FROM (SELECT li.dms_id, li.a AS s FROM li JOIN {folds} f ON f.dms_id = li.dms_id AND f.s = li.b UNION ALL SELECT li.dms_id, li.b FROM li JOIN {folds} f ON f.dms_id = li.dms_id AND f.s = li.a) GROUP BY dms_id, s),
y{k} AS (SELECT de.*, f.s IS NOT NULL AS iv, CASE WHEN f.s IS NOT NULL THEN deg - coalesce(cr, 0) ELSE coalesce(cr, 0) END AS ac FROM de LEFT JOIN x{k} x ON x.dms_id = de.dms_id AND x.s = de.s LEFT JOIN {folds} f ON f.dms_id = de.dms_id AND f.s = de.s),
g{k} AS (SELECT *, 2 * ac - deg AS gain, sum(CASE WHEN iv THEN ac ELSE 0 END) OVER (PARTITION BY dms_id) AS cut FROM y{k})"""


def _swap(k: int) -> str:
    """CTEs of a round: the folds of g<k-1> after swaps, and of each assay the better ones as g<k>."""
    o = "g0" if k == 1 else f"b{k - 1}"
    return f"""
k{k} AS (SELECT *, row_number() OVER (PARTITION BY dms_id, iv ORDER BY gain DESC, h) AS pl FROM {o}),
m{k} AS (SELECT *, sum(gain) OVER (PARTITION BY dms_id, pl) > 2 AND count(*) OVER (PARTITION BY dms_id, pl) = 2 AND pl <= ceil(CAST(0.05 AS DOUBLE) * total) AS mv FROM k{k}),
f{k} AS (SELECT dms_id, s FROM m{k} WHERE iv <> mv),{_gains(str(k), f"f{k}")},
b{k} AS (SELECT n.* FROM g{k} n JOIN {o} o ON o.dms_id = n.dms_id AND o.s = n.s WHERE n.cut < o.cut UNION ALL SELECT o.* FROM g{k} n JOIN {o} o ON o.dms_id = n.dms_id AND o.s = n.s WHERE NOT n.cut < o.cut)"""


_SPLIT = _CLASSES + f""",
sz AS (SELECT dms_id, c, count(*) AS n FROM lab GROUP BY dms_id, c),
fi AS (SELECT dms_id, c, sum(n) OVER (PARTITION BY dms_id) AS total, sum(n) OVER (PARTITION BY dms_id ORDER BY n, md5(concat('42|', dms_id, '|', c)), c ROWS UNBOUNDED PRECEDING) AS filled FROM sz),
ne AS (SELECT *, ceil(CAST(0.2 AS DOUBLE) * total) AS need, max(CASE WHEN filled <= ceil(CAST(0.2 AS DOUBLE) * total) THEN filled ELSE 0 END) OVER (PARTITION BY dms_id) AS base FROM fi),
de AS (SELECT lab.dms_id, lab.s, lab.c, coalesce(nl.n, 0) AS deg, md5(concat('42|', lab.dms_id, '|', lab.s)) AS h, total, need, base, filled <= need AS whole
       FROM lab JOIN ne ON ne.dms_id = lab.dms_id AND ne.c = lab.c LEFT JOIN nl ON nl.dms_id = lab.dms_id AND nl.s = lab.s),
f0 AS (SELECT dms_id, s FROM (SELECT *, row_number() OVER (PARTITION BY dms_id, whole ORDER BY deg, h) AS pl FROM de) WHERE whole OR pl <= need - base),{_gains("0", "f0")},{_swap(1)},{_swap(2)}"""


@query(_SPLIT + "\nSELECT dms_id, s AS sequence, c AS class, CASE WHEN iv THEN 'val' ELSE 'train' END AS fold, deg AS n_links, ac AS n_across FROM b2")
def similarity_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.similarity_split(_mutated(spark, sf_dir), "dms_id", "mutated_sequence")


@query(_SPLIT + "\nSELECT dms_id, count(*) FILTER (iv) AS n_val, count(*) FILTER (NOT iv) AS n_train, CAST(max(cut) AS BIGINT) AS n_across FROM b2 GROUP BY dms_id")
def split_leftovers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.split_leftovers(similarity_split(spark, sf_dir))


def gc_share(sequences: list[str]) -> list[list[float]]:
    """A stand-in for a model: at each position the share of G and C so far."""
    return [[round(sum(x in "GC" for x in s[: i + 1]) / (i + 1), 6) for i in range(len(s))] for s in sequences]


@query("""WITH d AS (SELECT DISTINCT sequence_id, sequence FROM fx_ranges WHERE sequence IS NOT NULL),
p AS (SELECT sequence_id, sequence, unnest(range(length(sequence))) AS k FROM d)
SELECT sequence_id, sequence, CAST(k AS INT) AS position_id, round((length(substr(sequence, 1, k + 1)) - length(replace(replace(substr(sequence, 1, k + 1), 'G', ''), 'C', ''))) / (k + 1), 6) AS prediction FROM p""")
def batch_score_stub(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.score_sequences(fixture(spark, sf_dir, "fx_ranges"), gc_share)


# ---------------------------------------------------------------- files: the stand-ins written, and read back


def _place(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query("SELECT dms_id, mutant, dms_score FROM fx_variants")
def assay_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assays written one by one, half of them with another name for the mutations, and read as one table."""
    folder = _place(spark, "assays")
    rows = fixture(spark, sf_dir, "fx_variants").select("dms_id", "s_suppkey", "mutant", "dms_score")
    files.write_assays(rows.where("s_suppkey % 2 = 0").drop("s_suppkey"), folder)
    files.write_assays(rows.where("s_suppkey % 2 = 1").select("dms_id", F.col("dms_score").alias("DMS_score"), F.col("mutant").alias("Mutation")), folder, mode="append")
    return files.read_assays(spark, folder).select("dms_id", "mutant", "dms_score")


@query("SELECT CASE model WHEN 'm1' THEN 'Evo' ELSE 'RNA_FM' END AS model, dms_id, mutant, score FROM fx_predictions WHERE model IN ('m1', 'm2')")
def prediction_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions of two models in their own layouts; a third one, asked for, has no files."""
    folder, stored = _place(spark, "predictions"), _stored_variants(spark, sf_dir)
    for name, model, score in (("m1", "Evo", "scores"), ("m2", "RNA_FM", "RNA_FM_scores")):
        rows = fixture(spark, sf_dir, "fx_predictions", stored).where(F.col("model") == name)
        files.write_assays(rows.select("dms_id", "mutant", F.col("score").alias(score)), f"{folder}/{model}")
    return files.read_predictions(spark, folder, ["Evo", "GenSLM", "RNA_FM"])


@query(_AT + "\nSELECT id, usage, round(reactivity, 6) AS reactivity, CAST(sequence_id AS VARCHAR) AS sequence_id FROM pl")
def label_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels from Parquet and ranges from CSV under the files' own names, attached."""
    folder = _place(spark, "labels")
    labels = fixture(spark, sf_dir, "fx_labels").select("id", F.col("usage").alias("Usage"), F.col("reactivity").alias("reactivity_DMS_MaP"))
    labels.write.parquet(f"{folder}/labels.parquet")
    files.write_result(fixture(spark, sf_dir, "fx_ranges"), f"{folder}/ranges.csv")
    rows = structure.attach_ranges(files.read_labels(spark, f"{folder}/labels.parquet"), files.read_ranges(spark, f"{folder}/ranges.csv"))
    return rows.select("id", "usage", F.round("reactivity", 6).alias("reactivity"), "sequence_id")


@query("SELECT CAST(p.sequence_id AS VARCHAR) AS sequence_id, CAST(position_id AS INT) AS position_id, sequence, prediction FROM fx_position_predictions p JOIN fx_ranges r USING (sequence_id)")
def position_prediction_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _place(spark, "positions") + ".csv"
    rows = fixture(spark, sf_dir, "fx_position_predictions").join(fixture(spark, sf_dir, "fx_ranges").select("sequence_id", "sequence"), "sequence_id")
    files.write_result(rows.withColumnRenamed("prediction", "prediction_stub"), path)
    return files.read_position_predictions(spark, path, "stub").select("sequence_id", "position_id", "sequence", "prediction")


@query("""SELECT dms_id, rna_type, construct AS raw_construct_seq, CAST(2000 + s_suppkey % 20 AS INT) AS year, CAST(NULL AS VARCHAR) AS pdb_structure FROM fx_assays WHERE s_suppkey % 2 = 0
UNION ALL SELECT dms_id, rna_type, construct, CAST(2000 + s_suppkey % 20 AS INT), NULL FROM fx_assays WHERE s_suppkey % 2 = 1""")
def sheet_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the assays in a sheet of today's layout, half in one of the older layout, both read as one sheet."""
    folder = _place(spark, "sheets")
    rows = fixture(spark, sf_dir, "fx_assays").withColumn("year", 2000 + F.col("s_suppkey") % 20)
    new = rows.where("s_suppkey % 2 = 0").select(F.col("dms_id").alias("DMS_ID"), F.col("year").alias("YEAR"), F.col("rna_type").alias("RNA_TYPE"), F.col("construct").alias("RAW_CONSTRUCT_SEQ"))
    old = rows.where("s_suppkey % 2 = 1").select(F.col("dms_id").alias("fitness filename"), F.col("construct").alias("Raw Construct Sequence"), F.col("year").alias("Year"), F.col("rna_type").alias("Molecule Type"))
    files.write_result(new, f"{folder}/new")
    files.write_result(old, f"{folder}/old")
    both = files.read_sheet(spark, f"{folder}/new").unionByName(files.read_sheet(spark, f"{folder}/old"))
    return both.select("dms_id", "rna_type", "raw_construct_seq", "year", "pdb_structure")


def _assay_folder(spark: SparkSession, sf_dir: str, rows: str) -> str:
    folder = _place(spark, "manifest")
    files.write_assays(fixture(spark, sf_dir, "fx_variants").where(rows).select("dms_id", "mutant", "dms_score"), folder)
    return folder


@query("SELECT dms_id, count(*) AS n FROM fx_variants WHERE s_suppkey % 3 <> 0 AND s_suppkey % 5 <> 0 GROUP BY dms_id UNION ALL SELECT dms_id, 0 FROM fx_assays WHERE s_suppkey % 5 <> 0 AND dms_id NOT IN (SELECT dms_id FROM fx_variants WHERE s_suppkey % 3 <> 0)")
def manifest_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assays of a sheet that lists some without a file, from a folder that has some beside the sheet."""
    assays = files.read_assays(spark, _assay_folder(spark, sf_dir, "s_suppkey % 3 <> 0"))
    sheet = fixture(spark, sf_dir, "fx_assays").where("s_suppkey % 5 <> 0").select("dms_id")
    rows, missing = files.by_manifest(assays, sheet, strict=False)
    return rows.groupBy("dms_id").agg(F.count("*").alias("n")).unionByName(missing.select("dms_id", F.lit(0).cast("long").alias("n")))


@query(_MUTATED + """,
li AS (SELECT DISTINCT sequence AS seqs, CAST(ascii(substr(md5(sequence), 2, 1)) AS DOUBLE) AS scores FROM mu WHERE substr(md5(sequence), 1, 1) < '8')
SELECT dms_id, mutant, sequence, scores FROM mu LEFT JOIN li ON seqs = sequence""")
def likelihood_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The likelihoods of an external scorer, a file of two columns behind tabs, joined to the variants."""
    path = _place(spark, "likelihoods")
    rows = checkpointed(_mutated(spark, sf_dir).select("dms_id", "mutant", "mutated_sequence"))
    digest = F.md5(F.col("mutated_sequence").cast("binary"))
    known = rows.where(F.substring(digest, 1, 1) < "8").select(F.col("mutated_sequence").alias("seqs"), F.ascii(F.substring(digest, 2, 1)).cast("double").alias("scores")).distinct()
    known.write.option("header", True).option("sep", "\t").csv(path)
    return mutations.with_likelihoods(rows, files.read_likelihoods(spark, path)).withColumnRenamed("mutated_sequence", "sequence")


@query(_PAIRS + """,
sq AS (SELECT DISTINCT seq_id, md5(concat('s', seq_id)) AS sequence FROM fx_structures)
SELECT sequence, CAST(count(i) AS BIGINT) AS n_pairs, FALSE AS missing FROM sq LEFT JOIN pr ON pr.seq_id = sq.seq_id AND method = 'p1' WHERE sq.seq_id % 7 <> 0 GROUP BY sequence
UNION ALL SELECT sequence, 0, TRUE FROM sq WHERE seq_id % 7 = 0""")
def structure_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structures of a method keyed by sequence, from a table that lacks some: pairs of those there, and the others."""
    path = _place(spark, "structures")
    rows = fixture(spark, sf_dir, "fx_structures").withColumn("sequence", F.md5(F.concat(F.lit("s"), F.col("seq_id").cast("string")).cast("binary")))
    rows.where("method = 'p1' AND seq_id % 7 <> 0").select("sequence", "method", "dotbracket", "seq_id").write.parquet(path)
    said = files.read_structures(spark, path)
    there = pairs.pair_arrays(said, ["sequence"]).select("sequence", F.size("pairs").cast("long").alias("n_pairs"), F.lit(False).alias("missing"))
    absent = pairs.missing_predictions(rows.select("sequence").distinct(), said)
    return there.unionByName(absent.select("sequence", F.lit(0).cast("long").alias("n_pairs"), F.lit(True).alias("missing")))


@query("SELECT CASE model WHEN 'm1' THEN 'PSSM' ELSE 'EVmutation' END AS model, dms_id, mutant, score FROM fx_predictions WHERE model IN ('m1', 'm2')")
def alignment_prediction_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both models that need an alignment, whose score columns lie in files of one layout, under odd and repeated
    column names."""
    folder = _place(spark, "alignments")
    p = fixture(spark, sf_dir, "fx_predictions", _stored_variants(spark, sf_dir))
    for name, model, score in (("m1", "PSSM", "prediction_independent"), ("m2", "EVmutation", "Prediction_Epistatic")):
        rows = p.where(F.col("model") == name).select("dms_id", F.col("mutant").alias("mutations"), F.lit("x").alias("Mutant"), F.col("score").alias(score))
        files.write_assays(rows, f"{folder}/{model}")
    return files.read_predictions(spark, folder, models(with_alignments_only=True))


@query("SELECT dms_id, mutant, dms_score FROM fx_variants WHERE mutant IS NOT NULL")
def lower_case_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixture(spark, sf_dir, "fx_variants").select(F.col("dms_id").alias("DMS_ID"), F.col("mutant").alias("Mutant"), F.col("dms_score").alias("DMS_score"))
    return files.lower_columns(rows).dropna(subset=["mutant"])


@query("""WITH v AS (SELECT DISTINCT dms_id, mutant, dms_score FROM fx_variants WHERE mutant IS NOT NULL),
o AS (SELECT *, row_number() OVER (PARTITION BY dms_id ORDER BY md5(concat('42|', dms_id, '|', mutant))) AS pl, count(*) OVER (PARTITION BY dms_id) AS n FROM v)
SELECT dms_id, mutant, dms_score, CASE WHEN pl <= ceil(CAST(0.2 AS DOUBLE) * n) THEN 'val' ELSE 'train' END AS fold FROM o""")
def split_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A split written twice under its files' names, and read back."""
    folder = _place(spark, "splits")
    rows = fixture(spark, sf_dir, "fx_variants").where("mutant is not null").select("dms_id", "mutant", "dms_score").distinct()
    split = checkpointed(splits.random_split(rows, ["dms_id", "mutant"]))
    for _ in range(2):
        files.write_split(split, folder, "random")
    return files.read_split(spark, folder, "random", "mutant string, dms_score double")


@query(_TYPED + f"\nSELECT 'first' AS run, model, count(*) AS n FROM ty GROUP BY model UNION ALL SELECT 'second', model, count(*) FROM ty WHERE rna_type <> 'ASIA' GROUP BY model")
def appended_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of two runs appended to one table, one of them twice."""
    folder = _place(spark, "results")
    found = checkpointed(_assay_metrics(spark, sf_dir))
    for run in ("first", "second", "first"):
        rows = found if run == "first" else found.where("rna_type <> 'ASIA'")
        files.append_result(rows.groupBy("model").agg(F.count("*").alias("n")), folder, run)
    return files.read_results(spark, folder)


@query("""WITH d AS (SELECT DISTINCT sequence_id, sequence FROM fx_ranges WHERE sequence IS NOT NULL),
p AS (SELECT sequence_id, sequence, unnest(range(length(sequence))) AS k FROM d)
SELECT sequence_id, sequence, CAST(k AS INT) AS position_id, round((length(substr(sequence, 1, k + 1)) - length(replace(replace(substr(sequence, 1, k + 1), 'G', ''), 'C', ''))) / (k + 1), 6) AS prediction FROM p
WHERE sequence_id IN (SELECT min(sequence_id) FROM d GROUP BY sequence)""")
def score_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences that come in two loads, the second with those of the first: each is scored once."""
    path = _place(spark, "scored")
    rows = fixture(spark, sf_dir, "fx_ranges").groupBy("sequence").agg(F.min("sequence_id").alias("sequence_id"))
    scoring.scored_once(spark, rows.where("length(sequence) < 4"), path, "gc", gc_share)
    return scoring.scored_once(spark, rows, path, "gc", gc_share).drop("model")


def _with_header(header: str):
    def lines(batches):
        for column in itertools.chain([pa.array([header], pa.string())], (batch.column("value") for batch in batches)):
            yield pa.RecordBatch.from_arrays([column], ["value"])

    return lines


@query("""SELECT 'id_max' AS "column", concat('x', sequence_id) AS value, count(*) AS n FROM fx_ranges WHERE sequence_id % 50 = 0 GROUP BY sequence_id
UNION ALL SELECT NULL, concat(sequence_id, ',', sequence), count(*) FROM fx_ranges WHERE sequence_id % 50 = 1 GROUP BY sequence_id, sequence""")
def rejected_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of ranges with cells that are no number and with lines that are cut short: both are reported."""
    path = _place(spark, "ranges") + ".csv"
    rows = fixture(spark, sf_dir, "fx_ranges")
    end = F.when(F.col("sequence_id") % 50 == 0, F.concat(F.lit("x"), F.col("sequence_id").cast("string"))).otherwise(F.col("id_max").cast("string"))
    line = F.concat_ws(",", F.col("sequence_id").cast("string"), "sequence", F.when(F.col("sequence_id") % 50 != 1, F.concat_ws(",", F.col("id_min").cast("string"), end)))
    # Each file begins with the header, however many there are.
    rows.select(line.alias("value")).mapInArrow(_with_header("sequence_id,sequence,id_min,id_max"), "value string").write.text(path)
    return files.range_rejects(spark, path).groupBy("column", "value").agg(F.count("*").alias("n"))
