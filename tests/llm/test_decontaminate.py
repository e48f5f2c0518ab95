import random
import re

import pytest

from helixbench.llm import decontaminate


def plain(docs, items):
    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    found = {}
    for doc, text in docs:
        d = words(text)
        for item, other in items:
            b = words(other)
            for diag in range(-len(b), len(d)):
                for j in range(max(0, -diag), min(len(b), len(d) - diag) - 12):
                    if sum(d[j + diag + x] == b[j + x] for x in range(13)) >= 11:
                        low, high = found.get((doc, item), (1 << 60, -1))
                        found[doc, item] = min(low, j + diag), max(high, j + diag + 12)
    return found


@pytest.mark.parametrize("limit", [decontaminate.BROADCAST_SEEDS, 0])
def test_against_all_alignments(spark, monkeypatch, limit):
    monkeypatch.setattr(decontaminate, "BROADCAST_SEEDS", limit)
    rng = random.Random(8)
    items = [(i, " ".join(f"b{rng.randrange(60)}" for _ in range(rng.choice([5, 13, 20, 40])))) for i in range(12)]
    items += [(50, None), (51, ""), (52, "of the " * 10)]
    docs = []
    for i in range(50):
        text = [f"w{rng.randrange(100)}" for _ in range(rng.randrange(60))]
        passage = items[rng.randrange(12)][1].split()
        cut = passage[rng.randrange(4) : len(passage) - rng.randrange(4)]
        for _ in range(rng.randrange(6)):
            if cut:
                cut[rng.randrange(len(cut))] = rng.choice(["Sub", cut[0].upper()])
        at = rng.randrange(len(text) + 1)
        docs.append((i, ", ".join(text[:at] + cut + text[at:])))
    docs += [(100, None), (101, ""), (102, items[3][1].upper()), (103, "of the " * 500), (104, "short text")]
    df = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, item long, iw string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.first_word, r.last_word) for r in decontaminate.overlaps(df, bench).collect()}
    want = plain(docs, items)
    assert got == want and want
    kept = {r.doc_id for r in decontaminate.decontaminate(df, bench).collect()}
    assert kept == {d for d, _ in docs} - {d for d, _ in want}


def test_masks_meet_every_window_with_two_substitutions():
    for a in range(13):
        for b in range(13):
            assert any(all(m[j - o] == "0" for j in (a, b) if o <= j < o + len(m)) for m in decontaminate.MASKS for o in range(14 - len(m)))


def test_null_keys_repeats_and_empty_tables(spark):
    passage = " ".join(f"p{i}" for i in range(20))
    df = spark.createDataFrame([(None, passage), (1, passage), (1, passage)], "doc_id long, text string")
    bench = spark.createDataFrame([(7, passage), (7, passage)], "item_id long, text string")
    got = sorted(map(tuple, decontaminate.overlaps(df, bench).collect()), key=str)
    assert got == [(1, 7, 0, 19), (None, 7, 0, 19)]
    assert [r.doc_id for r in decontaminate.decontaminate(df, bench).collect()] == [None]
    assert decontaminate.overlaps(df, bench.limit(0)).count() == decontaminate.overlaps(df.limit(0), bench).count() == 0


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "a")], "item_id long, text string")
    plan = decontaminate.overlaps(df, bench)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_one_word_over_and_over(spark):
    df = spark.createDataFrame([(1, "the " * 4000), (2, "of " * 30 + "a " * 300_000)], "doc_id long, text string")
    bench = spark.createDataFrame([(7, "the " * 200), (8, "of " * 12 + "it")], "item_id long, text string")
    assert sorted(map(tuple, decontaminate.overlaps(df, bench).collect())) == [(1, 7, 0, 3999), (2, 8, 0, 31)]


def test_two_hundred_thousand_repeated_words(spark):
    """A row of the comparison holds a document's words once, however many diagonals have a hit."""
    df = spark.createDataFrame([(1, "the " * 200_000)], "doc_id long, text string")
    bench = spark.createDataFrame([(7, "the " * 60)], "item_id long, text string")
    assert sorted(map(tuple, decontaminate.overlaps(df, bench).collect())) == [(1, 7, 0, 199_999)]
