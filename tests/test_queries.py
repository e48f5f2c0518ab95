"""Every query of the catalogue against DuckDB on the same small tables."""

import duckdb
import pytest

from helixbench.plans import catalogue
from tests.conftest import SF

TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    return list(frame.columns), sorted(map(repr, frame.where(frame.notna(), None).itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    got, want = catalogue.QUERIES[name](spark, SF).toPandas(), duck.execute(catalogue.ORACLE_SQL[name]).df()
    assert len(got) and rows(got) == rows(want)


def test_entry_points_without_the_optional_parts(monkeypatch):
    import importlib.util

    import __spark_entry__ as entry

    found = importlib.util.find_spec
    monkeypatch.setattr(importlib.util, "find_spec", lambda n, *a: None if n in ("helixbench.llm", "corpus_pipeline") else found(n, *a))
    assert set(entry.queries()) == set(catalogue.QUERIES) and set(entry.oracle_sql()) == set(catalogue.ORACLE_SQL)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["dms_id", "rna_type", "model", "spearman", "auc", "mcc"]


def test_variants_are_not_shuffled_again_for_their_distinct_mutants(spark):
    """The stand-in meets by assay, as it does where it is too large to be broadcast; its pairs are distinct there."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = catalogue._mutated(spark, SF).select("dms_id", "mutant")
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert rows.count() == rows.distinct().count() > 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "HashAggregate" in plan or "SortAggregate" in plan
    assert "hashpartitioning(dms_id" not in plan
