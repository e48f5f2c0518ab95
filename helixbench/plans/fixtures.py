"""Stand-ins for the benchmark's inputs, derived from the driver's tables by SQL that Spark and DuckDB both run."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    # supplier = assay, region = type, a construct of 32 letters
    "fx_assays": """
SELECT concat('S', s_suppkey) AS dms_id, s_suppkey, r_name AS rna_type,
       translate(md5(concat('wt', s_suppkey)), '0123456789abcdef', 'ACGUACGUACGUACGU') AS construct
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    # a row for each (assay, mutant); line number 1 is a single mutation, 7 the wild type without one
    "fx_variants": """
SELECT dms_id, s_suppkey, mutant, max(l_extendedprice) AS dms_score, max(l_quantity) AS q, max(l_discount) AS d, max(l_tax) AS t
FROM (SELECT dms_id, s_suppkey, l_extendedprice, l_quantity, l_discount, l_tax,
        CASE WHEN l_linenumber = 7 THEN NULL
             WHEN l_linenumber = 1 OR p1 = p2 THEN concat(substr(construct, p1, 1), p1, n1)
             ELSE concat(substr(construct, p1, 1), p1, n1, ',', substr(construct, p2, 1), p2, n2) END AS mutant
      FROM (SELECT l.*, dms_id, s_suppkey, construct,
              CAST(1 + l_partkey % 32 AS INT) AS p1, CAST(1 + l_orderkey % 32 AS INT) AS p2,
              substr('ACGU', CAST(1 + l_orderkey % 4 AS INT), 1) AS n1, substr('ACGU', CAST(1 + l_partkey % 4 AS INT), 1) AS n2
            FROM lineitem l JOIN fx_assays ON l_suppkey = s_suppkey) a) b
GROUP BY dms_id, s_suppkey, mutant""",
    # every third construct has an N; edits with N as old or new letter, deletions, no number, outside, three in one
    "fx_constructs": """
SELECT dms_id, s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN concat(substr(construct, 1, 4), 'N', substr(construct, 6)) ELSE construct END AS construct FROM fx_assays""",
    "fx_edits": """
SELECT DISTINCT dms_id, CASE k WHEN 0 THEN concat('N', substr(mutant, 2)) WHEN 1 THEN concat(substr(mutant, 1, length(mutant) - 1), '-') WHEN 2 THEN concat(mutant, ',N5A')
         WHEN 3 THEN concat(substr(mutant, 1, length(mutant) - 1), 'N') WHEN 4 THEN concat(mutant, ',N3-') WHEN 5 THEN concat(substr(mutant, 1, 1), 'x', substr(mutant, 2))
         WHEN 6 THEN concat(substr(mutant, 1, 1), '9', substr(mutant, 2)) ELSE mutant END AS mutant
FROM (SELECT dms_id, mutant, ascii(substr(md5(concat(dms_id, mutant)), 1, 1)) % 10 AS k FROM fx_variants WHERE mutant IS NOT NULL) e""",
    # m1 correlated, m2 tied, m3 in DNA letters and absent for each tenth assay, m4 constant for each seventh
    "fx_predictions": """
SELECT 'm1' AS model, dms_id, mutant, dms_score * 0.0001 + q AS score FROM fx_variants
UNION ALL SELECT 'm2', dms_id, mutant, d FROM fx_variants
UNION ALL SELECT 'm3', dms_id, replace(mutant, 'U', 'T'), t FROM fx_variants WHERE s_suppkey % 10 <> 0
UNION ALL SELECT 'm4', dms_id, mutant, CASE WHEN s_suppkey % 7 = 0 THEN 1.0 ELSE q END FROM fx_variants""",
    # order = sequence of length 1 to 7, disjoint ranges of ids
    "fx_ranges": """
SELECT o_orderkey AS sequence_id, o_orderkey * 10 AS id_min, o_orderkey * 10 + o_custkey % 7 AS id_max,
       substr(translate(md5(concat('q', o_orderkey % 997)), '0123456789abcdef', 'ACGUACGUACGUACGU'), 1, CAST(1 + o_custkey % 7 AS INT)) AS sequence
FROM orders""",
    # some ids lie outside every range
    "fx_labels": """
SELECT l_orderkey * 10 + l_linenumber - 1 AS id, max(l_discount) * 15 - 0.1 AS reactivity,
       CASE WHEN l_linenumber = 1 THEN 'Ignored' WHEN l_orderkey % 3 = 0 THEN 'Private' WHEN l_orderkey % 3 = 1 THEN 'Public' END AS usage
FROM lineitem GROUP BY l_orderkey, l_linenumber""",
    "fx_position_predictions": """
SELECT l_orderkey AS sequence_id, l_linenumber - 1 AS position_id, max(l_tax) * 14 - 0.05 AS prediction
FROM lineitem WHERE l_quantity > 5 GROUP BY l_orderkey, l_linenumber""",
    # the same kind of predictions keyed by the labels' ids; some ids have no label
    "fx_id_predictions": """
SELECT l_orderkey * 10 + l_linenumber - 1 + CASE WHEN l_linenumber = 6 THEN 3 ELSE 0 END AS id, max(l_tax) * 14 - 0.05 AS prediction
FROM lineitem WHERE l_quantity > 5 GROUP BY l_orderkey, l_linenumber""",
    # truth and two predictions, of which p1 shares the first half with the truth
    "fx_structures": """
SELECT p_partkey AS seq_id, 'truth' AS method, translate(md5(concat('a', p_partkey)), '0123456789abcdef', '((([[......)))]]') AS dotbracket FROM part
UNION ALL SELECT p_partkey, 'p1', translate(concat(substr(md5(concat('a', p_partkey)), 1, 16), substr(md5(concat('b', p_partkey)), 17, 16)), '0123456789abcdef', '((([[......)))]]') FROM part
UNION ALL SELECT p_partkey, 'p2', translate(md5(concat('c', p_partkey)), '0123456789abcdef', '((([[......)))]]') FROM part""",
    # in quarters, so that products are exact in any order
    "fx_pair_probs": """
SELECT l_partkey AS seq_id, l_linenumber AS i, CAST(l_suppkey % 8 AS INT) AS j, CAST(max(l_suppkey % 5) AS DOUBLE) / 4 AS p
FROM lineitem GROUP BY l_partkey, l_linenumber, l_suppkey % 8""",
    "fx_logp": """
SELECT dms_id, pos, base, (0 - 1 - ascii(substr(md5(concat(dms_id, pos, base)), 1, 1)) % 16) * CAST(0.25 AS DOUBLE) AS logp
FROM fx_assays CROSS JOIN (SELECT DISTINCT CAST(1 + l_partkey % 32 AS INT) AS pos FROM lineitem) p
CROSS JOIN (VALUES ('A'), ('C'), ('G'), ('U')) AS b(base)""",
    # the same with a variant's position masked: each variant has values of its own
    "fx_masked": """
SELECT p.dms_id, p.mutant, p.pos, l.base, l.logp - (ascii(substr(md5(concat(p.mutant, p.pos, l.base)), 1, 1)) % 8) * CAST(0.25 AS DOUBLE) AS logp
FROM (SELECT DISTINCT dms_id, mutant, TRY_CAST(substr(m, 2, length(m) - 2) AS INT) AS pos
      FROM (SELECT dms_id, mutant, split_part(mutant, ',', 1) AS m FROM fx_variants WHERE mutant IS NOT NULL
            UNION ALL SELECT dms_id, mutant, split_part(mutant, ',', 2) FROM fx_variants WHERE mutant LIKE '%,%') t) p
JOIN fx_logp l ON l.dms_id = p.dms_id AND l.pos = p.pos""",
}


def _needed(sql: str) -> list[str]:
    """Views that a statement uses, directly or through others, in the order of their definitions."""
    found: set[str] = set()
    work = [sql]
    while work:
        for name in re.findall(r"\bfx_\w+", work.pop()):
            if name not in found:
                found.add(name)
                work.append(VIEWS[name])
    return [name for name in VIEWS if name in found]


def with_views(sql: str) -> str:
    """A statement for DuckDB: the views that it uses in front."""
    parts = [f"{name} AS ({VIEWS[name]}\n)" for name in _needed(sql)]
    body = sql.strip()
    if body.upper().startswith("WITH "):
        kind = "WITH RECURSIVE " if "USING KEY" in body else "WITH "
        return kind + ",\n".join([*parts, body[5:]])
    return "WITH " + ",\n".join(parts) + "\n" + body if parts else body


#: Views that ``keep`` has written, by folder of tables and name.
_KEPT: dict[tuple[str, str], str] = {}


def keep(spark: SparkSession, sf_dir: str, folder: str) -> None:
    """Write every view over a folder of tables once; ``fixture`` then reads it from there in this process."""
    for name in VIEWS:
        fixture(spark, sf_dir, name).write.parquet(f"{folder}/{name}")
        _KEPT[sf_dir, name] = f"{folder}/{name}"


#: Rows of lineitem that a task takes where they meet by assay, and as many of the four models' scores where those do.
TASK_ROWS = 300_000


def parts(spark: SparkSession, sf_dir: str, times: int = 1) -> int:
    """Into how many parts rows go that are ``times`` those of lineitem: one for each core, more where a part would
    have over ``TASK_ROWS``. Short rows pack so well that a target in shuffled bytes, or a fixed number, lets a task's
    memory grow with the table."""
    rows = times * spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    return max(spark.sparkContext.defaultParallelism, -(-rows // TASK_ROWS))


def fixture(spark: SparkSession, sf_dir: str, name: str, variants: str | None = None) -> DataFrame:
    """One of the views over a folder of tables. The four models' scores come from one pass over the variants.
    ``variants``: where a query has stored ``fx_variants`` in Parquet, to read them there instead of making them again
    (and their mutations again in each filter on them)."""
    if name == "fx_variants" and variants:
        return spark.read.parquet(variants)
    if (sf_dir, name) in _KEPT:
        return spark.read.parquet(_KEPT[sf_dir, name])
    if name == "fx_predictions":
        scores = ["'m1', mutant, dms_score * 0.0001 + q", "'m2', mutant, d", "'m3', replace(mutant, 'U', 'T'), t", "'m4', mutant, CASE WHEN s_suppkey % 7 = 0 THEN 1.0 ELSE q END"]
        rows = fixture(spark, sf_dir, "fx_variants", variants).selectExpr("s_suppkey", "dms_id", f"stack(4, {', '.join(scores)}) AS (model, mutant, score)")
        return rows.where("model <> 'm3' OR s_suppkey % 10 <> 0").select("model", "dms_id", "mutant", "score")
    views = [*_needed(VIEWS[name]), name]
    tables = sorted({t for v in views for t in ("supplier", "nation", "region", "lineitem", "orders", "part") if re.search(rf"\b{t}\b", VIEWS[v])})
    # A part makes three structures of many letters: a file that is too small to be cut is dealt out first.
    spread = {"part": f"/*+ REPARTITION({4 * spark.sparkContext.defaultParallelism}) */ "}
    base = [f"{t} AS (SELECT {spread.get(t, '')}* FROM parquet.`{sf_dir}/{t}.parquet`)" for t in tables]
    by_assay = "FROM lineitem l JOIN fx_assays"
    dealt = f"FROM (SELECT /*+ REPARTITION({parts(spark, sf_dir)}, l_suppkey) */ * FROM lineitem) l JOIN fx_assays" if any(by_assay in VIEWS[v] for v in views) else by_assay
    sql = VIEWS | ({"fx_variants": f"SELECT * FROM parquet.`{variants}`"} if variants else {})
    defined = [f"{v} AS ({sql[v].replace(by_assay, dealt)}\n)" for v in VIEWS if v in views]
    return spark.sql("WITH " + ",\n".join([*base, *defined]) + f"\nSELECT * FROM {name}")
