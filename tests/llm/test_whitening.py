import math

import numpy as np

from helixbench.llm import queries, whitening


def plain(rows, most=32):
    """{row number: (deviation, whitened up to sign)} and the explained shares, from all rows at once."""
    good = [(i, v) for i, (_, v) in enumerate(rows) if v and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array([[math.floor(64 * c) + 1_000_000 for c in v] for _, v in good], object)
    n, total = len(x), x.sum(axis=0)
    deviation = [sum((n * a - s) ** 2 for a, s in zip(r, total, strict=True)) for r in x]
    centred = np.array([[(n * a - s) / n for a, s in zip(r, total, strict=True)] for r in x], float)
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = min(most, int((values > 1e-12 * values[0]).sum()))
    return [i for i, _ in good], deviation, centred @ vectors[:, :k] / np.sqrt(values[:k]), values[:k] / values.sum()


def check(rows, out, most=32):
    order, deviation, white, share = plain(rows, most)
    by = {}
    for r in out:
        by.setdefault(r.component, []).append(r)
    assert sorted(by) == list(range(1, white.shape[1] + 1))
    ids = [rows[i][0] for i in order]
    for c, found in by.items():
        assert len(found) == len(order) and all(r.n == len(order) for r in found)
        assert sorted((r.vec_id is None, r.vec_id or 0, r.deviation) for r in found) == sorted((k is None, k or 0, d) for k, d in zip(ids, deviation, strict=True))
        assert all(abs(r.explained - share[c - 1]) <= 1e-4 * share[c - 1] for r in found)
        assert len({r.identity_error for r in found}) == 1 and found[0].identity_error <= 1e-4
        got = {r.vec_id: r.whitened for r in found}
        want = dict(zip(ids, white[:, c - 1], strict=True))
        sign = np.sign(sum(got[k] * want[k] for k in got))
        assert max(abs(got[k] * sign - want[k]) for k in got) < 1e-6


def test_against_numpy(spark, monkeypatch):
    rng = np.random.default_rng(3)
    monkeypatch.setattr(whitening, "ROWS", 16)
    monkeypatch.setattr(whitening, "TOGETHER", 2)
    base = rng.normal(size=(150, 6)) @ rng.normal(size=(6, 6))
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(base)]
    rows += [(900, None), (901, []), (902, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (903, [math.nan] * 6), (904, [math.inf] + [0.0] * 5), (905, [1.0] * 5), (None, [0.5] * 6)]
    df = spark.createDataFrame([(*r, 1, 2.0) for r in rows], "vec_id long, embedding array<float>, n int, whitened double").repartition(5)
    check([r for r in rows if r[0] != 905], whitening.whiten(df).collect())
    check([r for r in rows if r[0] != 905], whitening.whiten(df, most=2).collect(), 2)


def test_flat_directions_and_small_tables(spark):
    schema = "vec_id long, embedding array<double>"
    flat = [(i, [float(i % 5), 2.0 * (i % 5), 7.0]) for i in range(20)]
    out = whitening.whiten(spark.createDataFrame(flat, schema)).collect()
    check(flat, out)
    assert {r.component for r in out} == {1}
    for few in ([], [(1, [1.0, 2.0])], [(1, [1.0, 2.0])] * 3, [(1, None)]):
        assert whitening.whiten(spark.createDataFrame(few, schema)).count() == 0


def test_deviation_beyond_a_long(spark):
    rows = [(1, [1e12]), (2, [-1e12]), (3, [0.0])]
    out = {r.vec_id: r.deviation for r in whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert out == {1: None, 2: None, 3: 0}


def test_query_over_the_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    check(rows, queries.QUERIES["op12_whitening"](spark, sf).collect())
