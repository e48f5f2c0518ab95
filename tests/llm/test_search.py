import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from helixbench.llm import queries, search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, k):
    """{item: [(score, key)]} by scoring every document."""
    counts = [(key, Counter(words(t))) for key, t in docs]
    counts = [(key, c, sum(c.values())) for key, c in counts if c]
    total, length = len(counts), sum(n for _, _, n in counts)
    df = Counter(t for _, c, _ in counts for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(words(t))
    out = {}
    for i, own in asked.items():
        scores = []
        for key, c, n in counts:
            m = 10 + (90 * n * total) // length
            score = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in own if c[t])
            if score > 0:
                scores.append((-score, key is None, key or 0))
        if scores:
            out[i] = [(-s, None if none else key) for s, none, key in sorted(scores)[:k]]
    return out


def got(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: r["rank"]):
        out.setdefault(r.item_id, []).append((r.score, r.doc_id))
        assert r["rank"] == len(out[r.item_id])
    return out


@pytest.mark.parametrize("batch, block, first", [(64, 100, 4), (8192, 5, 16), (50, 3, 1)])
def test_against_all_scores(spark, monkeypatch, batch, block, first):
    for name, value in (("BATCH", batch), ("BLOCK", block), ("FIRST", first), ("LEAF", 4), ("FAN", 3), ("ITEMS", 2)):
        monkeypatch.setattr(search, name, value)
    rng = random.Random(17)
    text = lambda n: " ".join(f"W{int(rng.expovariate(0.08))}{rng.choice(['', ', é', '!'])}" for _ in range(n))
    docs = [(i, text(rng.choice([0, 1, 5, 30, 80]))) for i in range(400)]
    docs += [(i, docs[i % 7][1]) for i in range(400, 460)]  # copies: equal scores go by id
    docs += [(None, "w1 w2"), (None, "w1 w2"), (7, "w3"), (500, None), (501, "..."), (502, "w1 " * 50_000)]
    items = [(i, text(rng.choice([1, 3, 8, 20]))) for i in range(12)] + [(50, None), (51, "?"), (52, "unheard"), (3, "w0 w5"), (None, "w2")]
    rng.shuffle(docs)
    df = spark.createDataFrame([(*d, 1, "r") for d in docs], "doc_id long, text string, score long, rank string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert got(search.search(df, bench)) == plain(docs, items, 10)
    assert got(search.search(df, bench, k=1)) == plain(docs, items, 1)
    for empty in (search.search(df.limit(0), bench), search.search(df, bench.limit(0))):
        assert empty.count() == 0 and empty.columns == ["item_id", "rank", "doc_id", "score"]


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(2)
    rows = []
    for i in range(600):
        cols = np.unique(np.concatenate([rng.integers(0, 20, 3), 20 + (i % 12) * 10 + rng.integers(0, 10, 4)]))
        rows.append((cols, rng.integers(1, 1000, len(cols))))
    lists = search._lists(rows)
    order = search.in_order(lists)
    tree = search.grow(search._lists([lists.row(i) for i in order]), 8, 4)
    for level, width in zip(tree.levels, [8, 32, 128, 512, 2048], strict=False):
        for node in range(len(level.at) - 1):
            cols, most = level.row(node)
            for i in range(node * width, min(600, (node + 1) * width)):
                own, vals = tree.rows.row(i)
                assert set(own) <= set(cols) and all(most[np.searchsorted(cols, own)] >= vals)
    words_ = [(i, [str(c).encode() for c in range(20 + i * 10, 26 + i * 10)]) for i in range(12)]
    items = search.items_tree(words_, {}, 1000)
    # The places of the items' terms are their numbers in the documents.
    number = {t: int(t) for t in items.vocabulary}
    renamed = search._lists([(np.sort([number[list(items.vocabulary)[c]] for c in items.tree.rows.row(i)[0]]), items.tree.rows.row(i)[1]) for i in range(12)])
    items = items._replace(tree=search.grow(renamed, search.ITEMS, 2), weights=np.full(140, items.weights[0]))
    found = search.Search(items, tree, 5, np.zeros(12, np.int64), np.arange(600))
    found.run()
    assert 0 < found.looked < 12 * 600 / 3
    for i in range(12):
        cols, weights = items.tree.rows.row(i)
        weight = dict(zip(cols, weights, strict=True))
        scores = sorted(((sum(weight.get(c, 0) * v for c, v in zip(*tree.rows.row(d), strict=True)), -d) for d in range(600)), reverse=True)[:5]
        assert [(s, t) for s, t, _ in found.found[i]] == [(s, t) for s, t in scores if s > 0]


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.execute(queries.ORACLE_SQL["op13_search"]).df()
    out = queries.QUERIES["op13_search"](spark, sf).toPandas()[list(want.columns)]
    assert sorted(map(tuple, out.to_numpy().tolist())) == sorted(map(tuple, want.to_numpy().tolist())) and len(out) > 100
