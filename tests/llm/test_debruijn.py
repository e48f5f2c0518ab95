import hashlib
import random

import duckdb

from helixbench.llm import debruijn, queries


def plain(rows, k=13):
    first = {}
    for doc, text in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        words = (text or "").encode().split()
        for i in range(len(words) - k + 1):
            first.setdefault(tuple(words[i : i + k]), doc)
    out = []
    for doc, text in rows:
        words = (text or "").encode().split()
        gone = set()
        for i in range(len(words) - k + 1):
            if doc is not None and first[tuple(words[i : i + k])] < doc:
                gone.update(range(i, i + k))
        kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
        out.append((doc, len(words), len(gone), hashlib.sha256(kept).hexdigest(), kept.decode()))
    return sorted(out, key=str)


def check(spark, rows, k=13):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, m string, pos int")
    assert sorted((tuple(r) for r in debruijn.drop_repeats(df, k=k).collect()), key=str) == plain(rows, k)
    return df


def test_against_all_windows(spark):
    rng = random.Random(1)
    passage = [f"p{i}" for i in range(60)]
    rows = []
    for i in range(60):
        words = [f"w{rng.randrange(40)}" for _ in range(rng.randrange(0, 90))]
        at = rng.randrange(50)
        words[5:5] = passage[at : at + rng.randrange(30)]
        rows.append((rng.randrange(1000) * 100 + i, (" ", "\n", "\t ")[i % 3].join(words)))
        if i % 5 == 0:
            rows.append((rows[-1][0] + 7, rows[-1][1]))
    rows += [(-3, "a " * 40), (999999, "a " * 13 + "b"), (12, None), (13, ""), (None, " ".join(passage)), (14, "x y z")]
    df = check(spark, rows)
    words = {d: (t or "").split() for d, t in rows if d is not None}
    for s in debruijn.repeated_spans(df).collect():
        assert s.src_doc < s.doc_id
        assert words[s.doc_id][s.start : s.start + s.n_words] == words[s.src_doc][s.src_start : s.src_start + s.n_words]


def test_short_windows_and_branches(spark):
    rng = random.Random(2)
    check(spark, [(i, " ".join(rng.choice("abc") for _ in range(rng.randrange(12)))) for i in range(40)], k=3)


def test_repeated_keys_and_empty(spark):
    same = " ".join(f"v{i}" for i in range(20))
    rows = [(1, same), (1, same), (2, same + " more"), (2, "less " + same), (2, "other")]
    check(spark, rows)
    assert debruijn.drop_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_texts_of_equal_checksums_under_one_key(spark):
    """Two texts of one key that crc32 does not tell apart, both with words that smaller documents have."""
    import zlib
    from itertools import count

    words, seen = [f"q{i}" for i in range(14)], {}
    for i in count():
        text = " ".join([*words, f"z{i}"]) if i % 2 else " ".join([f"z{i}", *words[1:], "end"])
        other = seen.setdefault(zlib.crc32(text.encode()) & 0xFFFF, text)
        if other != text and other.split()[0] != text.split()[0]:
            break
    check(spark, [(5, text), (5, other), (1, " ".join(words)), (2, other)])


def test_branches_rings_and_paths_over_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(debruijn, "PART", 4)
    rng = random.Random(31)
    a, b, c = ([f"{x}{i}" for i in range(40)] for x in "abc")
    ring = [f"r{i}" for i in range(5)]
    rows = [(i, " ".join(a[: rng.randrange(10, 40)] + rng.choice([b, c])[rng.randrange(10) :])) for i in range(12)]
    rows += [(100 + i, " ".join(ring * (4 + i))) for i in range(4)] + [(200, " ".join(a + c + a)), (201, " ".join(b + a + b))]
    df = check(spark, rows, 5)
    words = {d: t.split() for d, t in rows}
    spans = debruijn.repeated_spans(df, k=5).collect()
    for s in spans:
        assert s.src_doc < s.doc_id and words[s.doc_id][s.start : s.start + s.n_words] == words[s.src_doc][s.src_start : s.src_start + s.n_words]
    assert max(s.n_words for s in spans) > 30


def test_compaction_against_a_walk(spark, monkeypatch):
    """Every edge of a path of nodes that do not branch has the path's last edge, and places that rise by one."""
    monkeypatch.setattr(debruijn, "PART", 3)
    rng = random.Random(6)
    nodes = [(rng.randrange(60), rng.randrange(60)) for _ in range(70)] + [(100 + i, 101 + i) for i in range(50)] + [(300, 301), (301, 300)]
    edges = {1000 + i: n for i, n in enumerate(dict.fromkeys(nodes))}
    df = spark.createDataFrame([(e, left, right, rng.randrange(5), 0, 0) for e, (left, right) in edges.items()], "edge long, left long, right long, src_doc long, src_row long, src_pos int")
    got = {r.edge: (r.path, r.place) for r in debruijn.compacted(df).collect()}
    nexts = {}
    for e, (_, right) in edges.items():
        into, out = [x for x, n in edges.items() if n[1] == right], [x for x, n in edges.items() if n[0] == right]
        if len(into) == len(out) == 1 and out[0] != e:
            nexts[e] = out[0]
    assert len(set(got.values())) == len(edges)
    for e in edges:
        path = [e]
        while path[-1] in nexts and nexts[path[-1]] not in path:
            path.append(nexts[path[-1]])
        if path[-1] not in nexts:  # rings are cut somewhere
            assert got[e] == (path[-1], 1 - len(path))


def test_a_passage_that_a_third_of_all_documents_have(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, f"w{i} x{i} " * 8 + (passage if i % 3 == 0 else "") + f" y{i} z{i}" * 5) for i in range(300)]
    check(spark, rows)


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = con.execute(queries.ORACLE_SQL["op5_debruijn_dedup"]).df()
    got = queries.QUERIES["op5_debruijn_dedup"](spark, sf).toPandas()[list(want.columns)]
    assert sorted(map(tuple, got.to_numpy().tolist())) == sorted(map(tuple, want.to_numpy().tolist())) and (want.n_removed > 0).any()


def test_a_megabyte_of_text(spark):
    long = " ".join(f"v{i % 30_011}" for i in range(200_000))
    check(spark, [(1, long), (2, "new " + long), (3, "the " * 200_000)])
