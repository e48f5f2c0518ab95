import random

import numpy as np
from pyspark.sql import functions as F

from helixbench.llm import toxicity


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_automaton_against_edit_distances():
    rng = random.Random(6)
    terms = {"".join(rng.choice("abc") for _ in range(n)): 1.0 for n in (2, 3, 4, 5, 6, 8, 9, 10, 12) for _ in range(4)}
    exact = frozenset(list(terms)[::7])
    lexicon = toxicity.Lexicon(terms, exact)
    for _ in range(3000):
        word = rng.choice(list(terms)) if rng.random() < 0.7 else ""
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(word) + 1)
            word = rng.choice([word[:at] + word[at + 1 :], word[:at] + rng.choice("abcd") + word[at:], word[:at] + "d" + word[at + 1 :]])
        near = [(distance(word, t), t) for t in terms if distance(word, t) <= lexicon.edits(t)]
        got = lexicon.match(word)
        assert got == (min(near)[::-1] if near else None), word


def test_quotation_counts_less_than_abuse():
    lexicon = toxicity.Lexicon({"stupid": 3.0, "pathetic": 3.0})
    model = toxicity.Model(lexicon, np.array([1.0, 0.7, -0.2, 0.5, 0.3, 0.3, -3]))
    assert model.score("you are a stupid person") > model.score('they used the word "stupid" in it') < 0.3
    assert model.score("you are a stupd person") > 0.3 > model.score("a kind person") == model.score("") == model.score(None)
    assert model.score("that one said stupid things") < model.score("those are stupid things")


def test_held_out_accuracy_and_defined_results(spark):
    rng = random.Random(9)
    bad = ["grobian", "halunke", "schurke"]
    rows, labels = [], []
    for i in range(400):
        words = [f"w{rng.randrange(300)}" for _ in range(40)]
        y = i % 4 == 0
        if y:
            for _ in range(3):
                words[rng.randrange(40)] = rng.choice(bad)
        rows.append((i, " ".join(words), 0.5))
        labels.append((i, int(y)))
    rows += [(1000, None, 0.5), (1001, "", 0.5), (1002, "ein grobjan", 0.5), (None, "x", 0.5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score double")
    marks = spark.createDataFrame([*labels, (3, None)], "doc_id long, toxic int")
    model = toxicity.train(df, marks, F.col("doc_id") % 2 == 0)
    assert set(model.lexicon.terms) == set(bad)
    got = {r.doc_id: r for r in toxicity.score(df, model).collect()}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())
    assert all(got[i].predicted == y for i, y in labels)
    assert got[1000].score == got[1001].score < 0.3 and got[1002].predicted == 1
    assert toxicity.train(df, marks.limit(0), F.lit(True)) is None
    assert [r.score for r in toxicity.score(df.limit(2), None).collect()] == [0.0, 0.0]
    assert toxicity.score(df.limit(0), model).count() == 0


def test_marks_enclose_in_pairs():
    tokens = toxicity._TOKEN.findall('"hi" you are stupid "bye" «a „b” c» open " \n end "')
    got = [t for t, q in zip(tokens, toxicity.quoted(tokens), strict=True) if q and t.isalpha()]
    assert got == ["hi", "bye", "a", "b", "c"]


def test_forgetting_changes_nothing(monkeypatch):
    lexicon = toxicity.Lexicon({"abcdef": 1.0, "uvwxyz": 1.0})
    words = ["abcdef", "abcdf", "uvwxyyz", "nothing", "abcxef"]
    want = [lexicon.match(w) for w in words]
    monkeypatch.setattr(toxicity, "REMEMBERED", 1), monkeypatch.setattr(toxicity, "STATES", 1)
    assert [lexicon.remembered({w}).get(w) for w in words] == want


def test_samples_are_bounded_whatever_repeats(spark):
    rows = [(1, "schurke im text", 1)] * 3000 + [(i, f"text {i} schurke w{i}", i % 2) for i in range(2, 900)] + [(None, "halunke", 1)]
    df = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), *((i, i % 2) for i in range(2, 900))], "doc_id long, toxic int")
    got, sizes = toxicity._sample(df, labels, F.lit(True), "doc_id", "text", "toxic", 50)
    n = {r.y: r.n for r in got.groupBy("y").agg(F.count("*").alias("n")).collect()}
    assert sizes == {1: 3449, 0: 449} and all(20 <= x <= 50 for x in n.values())


def test_terms_behind_a_long_beginning(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(f"w{rng.randrange(50_000)}" for _ in range(8000)) + (" grobian halunke" if i % 2 else "")) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    assert {"grobian", "halunke"} <= set(toxicity.train(df, labels, F.lit(True)).lexicon.terms)
