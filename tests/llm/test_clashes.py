"""Extra columns whose names the operators and stages use themselves come out as they went in."""

import corpus_pipeline
from helixbench.llm import common, language_id, mixing, toxicity

CLASHES = {"_lang": "keep", "_score": 2.5, "_hash": 7, "_s": "s", "_cut": 3, "_judged": "j", "text_hash": 5, "h": 1, "k": "k", "first": "f", "slot": 9}


def docs(spark, n=60):
    words = {"en": "the house of the river and the hill", "de": "das haus und der fluss ist nicht weit", "fr": "la maison est dans le village avec", "es": "la casa de los amigos y el pueblo"}
    rows = [(i, f"{words[lang]} {'abcdefgh'[i % 8] * 3} {i} {words[lang]} w{i}", lang, f"src{i % 5}", 10) for i in range(n) for lang in [list(words)[i % 4]]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.selectExpr("*", *(f"{v!r} AS `{c}`" for c, v in CLASHES.items()))


def untouched(out):
    rows = out.select(*CLASHES).distinct().collect()
    assert [{c: (float(x) if c == "_score" else x) for c, x in r.asDict().items()} for r in rows] == [CLASHES]


def test_stages_keep_columns_of_any_name(spark, tmp_path):
    df = docs(spark)
    spark.createDataFrame([(1, " ".join(f"b{i}" for i in range(20)))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, str(tmp_path))
        assert out.columns == df.columns and out.count(), name
        untouched(out)
    assert corpus_pipeline.STAGES[-1][1](spark, df, str(tmp_path)).count() == 60


def test_operators_keep_columns_of_any_name(spark):
    df = docs(spark, 8)
    untouched(language_id.identify(df, None, into=("found", "share")))
    untouched(toxicity.score(df, None, into=("found", "share")))
    untouched(mixing.mix(df))


def test_names_that_no_column_has(spark):
    df = spark.createDataFrame([(1, 2, 3)], "_S int, _s_ int, x int")
    assert common.fresh(df, "_s", "x", "x", "y") == ["_s__", "x_", "x__", "y"]


def test_samples_stay_bounded_in_huge_tables(spark):
    """The share of hashes that pass follows the table's size without a floor."""
    df = spark.range(200_000).selectExpr("id % 2 AS g", "xxhash64(id) AS h")
    got = {r.g: r.n for r in common.sampled(df, "g", 50).groupBy("g").count().withColumnRenamed("count", "n").collect()}
    assert got == {0: 50, 1: 50}
