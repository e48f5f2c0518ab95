import random
import re
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from helixbench.functions import expressions as E
from helixbench.operators import bootstrap, durable, leaderboard, logprob, merge, metrics, mutations, pairs, scoring, splits, structure


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


# ---------------------------------------------------------------- metrics


def plain_auc(y, x):
    pos, neg = [b for a, b in zip(y, x, strict=True) if a], [b for a, b in zip(y, x, strict=True) if not a]
    return sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg))


def test_assay_metrics_by_hand(spark):
    rng = random.Random(1)
    rows = [(a, "m", float(rng.randrange(8)), float(rng.randrange(6))) for a in ("a", "b") for _ in range(41)]
    rows += [("const score", "m", float(i), 1.0) for i in range(6)] + [("const truth", "m", 2.0, float(i)) for i in range(6)] + [("nulls", "m", None, 1.0)]
    got = {r.dms_id: r for r in metrics.assay_metrics(frame(spark, rows, "dms_id string, model string, dms_score double, score double"), ["dms_id", "model"]).collect()}
    for a in ("a", "b"):
        y, x = (np.array([r[i] for r in rows if r[0] == a]) for i in (2, 3))
        t, s = y > np.median(y), x > np.median(x)
        auc = plain_auc(t, x)
        assert abs(got[a].spearman - abs(pd.Series(y).rank().corr(pd.Series(x).rank()))) < 1e-9
        assert abs(got[a].auc - max(auc, 1 - auc)) < 1e-9
        assert abs(got[a].mcc - abs(np.corrcoef(t, s)[0, 1])) < 1e-9
    assert (got["const score"].spearman, got["const score"].auc, got["const score"].mcc) == (None, 0.5, 0.0)
    assert (got["const truth"].spearman, got["const truth"].auc, got["const truth"].mcc) == (None, None, None)
    assert "nulls" not in got
    grid = metrics.on_grid(metrics.assay_metrics(frame(spark, rows, "dms_id string, model string, dms_score double, score double"), ["dms_id", "model"]), frame(spark, [("nulls",), ("a",)], "dms_id string"), frame(spark, [("m",)], "model string"))
    assert {r.dms_id: r.auc is None for r in grid.collect()} == {"nulls": True, "a": False}


def test_pooled_auc(spark):
    rng = random.Random(2)
    rows = [(rng.choice("kl"), rng.random() < 0.4, round(rng.random(), 2)) for _ in range(400)]
    df = frame(spark, rows, "k string, y boolean, x double")
    got = {r.k: r.auc for r in metrics.pooled_auc(df, F.col("y"), "x", ["k"]).collect()}
    flipped = metrics.pooled_auc(df.withColumn("x", -F.col("x")), F.col("y"), "x").first().auc
    for k in "kl":
        assert abs(got[k] - plain_auc([r[1] for r in rows if r[0] == k], [r[2] for r in rows if r[0] == k])) < 1e-9
    assert abs(metrics.pooled_auc(df, F.col("y"), "x").first().auc + flipped - 1) < 1e-9
    assert metrics.pooled_auc(df.limit(0), F.col("y"), "x").first().auc is None and metrics.pooled_auc(df.limit(0), F.col("y"), "x", ["k"]).count() == 0


def test_pooled_auc_over_many_ranges_and_a_heavy_tie(spark):
    """More distinct scores than ranges, and one score that half of all rows have."""
    df = spark.range(20_000).selectExpr("pmod(xxhash64(id), 3) = 0 AS y", "CASE WHEN id % 2 = 0 THEN 0.0D ELSE pmod(xxhash64(1, id), 9000) / 9000D END AS x")
    rows = df.collect()
    got = metrics.pooled_auc(df, F.col("y"), "x")
    assert abs(got.first().auc - plain_auc([r.y for r in rows], [r.x for r in rows])) < 1e-9


def test_position_metrics_edge_cases(spark):
    rows = [(1, 0.2, 0.2), (1, 0.9, 0.1), (1, None, 0.5), (2, 1.7, -3.0)]
    df = metrics.median_bins(metrics.clipped(frame(spark, rows, "s int, y double, x double"), ["y", "x"]), ["s"], ["y", "x"])
    got = sorted((r.s, r.y, r.x, r.y_bin, r.x_bin) for r in df.where("y is not null").collect())
    assert got == [(1, 0.2, 0.2, False, False), (1, 0.9, 0.1, True, False), (2, 1.0, 0.0, False, False)]
    assert not df.where("y is null").first().y_bin
    one = metrics.position_metrics(df.where("s = 2"), "y", "x", []).first()
    assert (one.auc, one.mcc, one.mae, one.f1) == (None, 0.0, 1.0, 1.0)


# ---------------------------------------------------------------- leaderboards and bootstrap


def test_leaderboards(spark):
    rows = [("a", "t1", "m1", "single", 0.1, 0.2, None), ("b", "t1", "m1", "single", 0.3, 0.4, 0.5), ("c", "t2", "m1", "multiple", 0.8, 0.6, 0.7)]
    df = frame(spark, rows, "dms_id string, rna_type string, model string, depth string, spearman double, auc double, mcc double")
    types = {r.rna_type: r for r in leaderboard.by_type(df).collect()}
    assert abs(types["t1"].spearman - 0.2) < 1e-12 and types["t1"].mcc == 0.5 and abs(types["All"].spearman - 0.4) < 1e-12
    depths = {r.depth: r for r in leaderboard.by_depth(df).collect()}
    assert abs(depths["All"].spearman - 0.5) < 1e-12
    wide = leaderboard.wide(leaderboard.by_type(df), ["t2", "t1"])
    assert wide.columns[:4] == ["model", "spearman_t2_Mean", "spearman_t1_Mean", "spearman_All_Mean"]
    assert spark.range(1).select(leaderboard.combined_error(F.lit(3.0), F.lit(4.0)).alias("e")).first().e == np.sqrt(12.5)


def test_best_model_ties_and_nulls(spark):
    rows = [("a", "t", m, "auc", v) for m, v in [("z", 0.5), ("y", 0.5), ("x", None)]]
    df = frame(spark, rows, "dms_id string, rna_type string, model string, metric string, value double")
    assert {r.model for r in leaderboard.best_models(df, ["x", "z", "y"]).collect()} == {"z"}
    assert {r.model for r in leaderboard.best_models(df).collect()} == {"y"}


def test_bootstrap_by_hand(spark):
    import hashlib

    rng = random.Random(3)
    rows = [(f"a{i}", "t1" if i < 4 else "t2", m, "auc", rng.random()) for i in range(7) for m in ("m1", "m2")]
    df = frame(spark, rows, "dms_id string, rna_type string, model string, metric string, value double")
    got = {(r.rna_type, r.model): r.se for r in bootstrap.bootstrap_errors(df, 20).collect()}
    value = {(r[0], r[2]): r[4] for r in rows}
    kind = {r[0]: r[1] for r in rows}
    for k in ("t1", "t2", "All"):
        own = [a for a in kind if k in (kind[a], "All")]
        best = max(("m1", "m2"), key=lambda m: sum(value[a, m] for a in own))
        for m in ("m1", "m2"):
            means = []
            for rep in range(20):
                drawn = [f"a{int(hashlib.md5(f'42|{rep}|{i}'.encode()).hexdigest()[:8], 16) % 7}" for i in range(7)]
                diffs = [value[a, m] - value[a, best] for a in drawn if a in own]
                if diffs:
                    means.append(np.mean(diffs))
            assert abs(got[k, m] - np.std(means, ddof=1)) < 1e-9


def test_draws_are_counted_in_blocks(spark, monkeypatch):
    """Texts of all lengths hash as hashlib has them; the draws of 5,000 assays come as counts in blocks."""
    import hashlib

    numbers = np.array([0, 9, 10, 99, 100, 4095, 123_456, 10_000_000])
    for prefix in (b"42|7|", b"42|9999|", b"x" * 40):
        assert bootstrap.first_words(prefix, numbers).tolist() == [int(hashlib.md5(prefix + str(k).encode()).hexdigest()[:8], 16) for k in numbers]
    rows = bootstrap.draws(spark, 5000, 3).collect()
    assert sorted((r.replicate, r.block) for r in rows) == [(k, b) for k in range(3) for b in (0, 1)]
    want = np.bincount([int(hashlib.md5(f"42|1|{k}".encode()).hexdigest()[:8], 16) % 5000 for k in range(5000)], minlength=5000)
    assert sum((list(r.times) for r in sorted(rows, key=lambda r: r.block) if r.replicate == 1), []) == want.tolist()


# ---------------------------------------------------------------- merge


def test_completeness_gate(spark):
    variants = frame(spark, [("a", "A1T", 1.0), ("a", "C2G", 2.0), ("a", None, 0.0), ("b", "A1G", 3.0), ("c", "A1G", 3.0)], "dms_id string, mutant string, dms_score double")
    scores = [("m", "a", "A1U", 0.5, 2), ("m", "a", "A1U", 0.4, 1), ("m", "a", "C2G", 0.7, 3), ("n", "a", "A1T", 0.1, 4), ("n", "a", "C2G", 0.2, 5), ("m", "b", "A1G", 0.3, 6), ("m", "c", "A1G", 0.3, 7), ("n", "c", "A9G", 0.3, 8)]
    predictions = frame(spark, scores, "model string, dms_id string, mutant string, score double, row int")
    got = sorted(map(tuple, merge.merge(variants, predictions, ["m", "n"], ["row"]).collect()))
    assert got == [("a", "A1U", 1.0, "m", 0.4), ("a", "A1U", 1.0, "n", 0.1), ("a", "C2G", 2.0, "m", 0.7), ("a", "C2G", 2.0, "n", 0.2)]
    report = {(r.dms_id, r.model): (r.n_variants, r.n_lost, r.has_file) for r in merge.loss_report(variants, predictions, ["m", "n"]).collect()}
    assert report[("b", "n")] == (1, 1, False) and report[("c", "n")] == (1, 1, True) and report[("a", "m")] == (2, 0, True)


# ---------------------------------------------------------------- structure


def test_range_join_equals_between(spark):
    rng = random.Random(4)
    ranges, at = [], 0
    for i in range(40):
        at += rng.randrange(1, 30)
        ranges.append((f"s{i}", at, at + rng.randrange(0, 400)))
        at = ranges[-1][2] + 1
    ids = [rng.randrange(-50, at + 50) for _ in range(500)] + [None]
    df = structure.attach_ranges(frame(spark, [(i,) for i in ids], "id long"), frame(spark, ranges, "sequence_id string, id_min long, id_max long"), width=64)
    got = sorted(((r.id, r.sequence_id) for r in df.collect()), key=str)
    assert got == sorted(((i, next((s for s, a, b in ranges if i is not None and a <= i <= b), None)) for i in ids), key=str)


def test_numbering_with_and_without_gaps(spark):
    ranges = frame(spark, [("s", 10, 12), ("t", 20, 21)], "sequence_id string, id_min long, id_max long")
    full = structure.attach_ranges(frame(spark, [(10,), (11,), (12,), (20,), (21,)], "id long"), ranges)
    gaps = structure.attach_ranges(frame(spark, [(10,), (12,), (20,), (99,)], "id long"), ranges)
    assert structure.without_gaps(full, ranges) and not structure.without_gaps(gaps, ranges)
    number = lambda df, **k: {r.id: r.position_id for r in structure.number_positions(df, **k).collect()}
    assert number(full) == number(full, gap_free=True) == {10: 0, 11: 1, 12: 2, 20: 0, 21: 1}
    assert number(gaps) == {10: 0, 12: 1, 20: 0, 99: None}


def test_usage_filters(spark):
    df = frame(spark, [("Ignored",), (None,), ("Private",)], "usage string")
    assert structure.not_ignored(df).count() == 2 and structure.of_usage(df, "Private").count() == 1
    assert structure.overlap(df, df, "usage").first().n_shared == 3


def test_unpaired_probability_keeps_certain_pairs(spark):
    df = frame(spark, [(1, 0, 1, 0.5), (1, 0, 2, 1.0), (1, 1, 0, 0.2)], "seq_id int, i int, j int, p double")
    assert {r.i: r.p_unpaired for r in structure.unpaired_probability(df).collect()} == {0: 0.0, 1: 0.8}


# ---------------------------------------------------------------- base pairs


def stack_pairs(text):
    out, stacks = set(), {f: [] for f in pairs.FAMILIES}
    for i, c in enumerate(text):
        for f in pairs.FAMILIES:
            if c == f[0]:
                stacks[f].append(i)
            elif c == f[1] and stacks[f]:
                out.add((stacks[f].pop(), i))
    return out


def test_pairs_crossings_and_scores(spark):
    rng = random.Random(5)
    texts = {(s, m): "".join(rng.choice("(([<{..)]>}") for _ in range(rng.randrange(30))) for s in range(40) for m in ("truth", "p", "q")}
    df = frame(spark, [(s, m, t) for (s, m), t in texts.items()], "seq_id int, method string, dotbracket string")
    table = pairs.dotbracket_pairs(df)
    want = {k: stack_pairs(t) for k, t in texts.items()}
    assert {(r.seq_id, r.method, r.i, r.j) for r in table.collect()} == {(*k, *p) for k, ps in want.items() for p in ps}
    crossed = {k: {x for x in ps for y in ps if x[0] < y[0] < x[1] < y[1] or y[0] < x[0] < y[1] < x[1]} for k, ps in want.items()}
    assert {(r.seq_id, r.method, r.i, r.j) for r in pairs.crossing_pairs(table).collect()} == {(*k, *p) for k, ps in crossed.items() for p in ps}
    f1 = lambda a, b: 2 * len(a & b) / (len(a) + len(b)) if a or b else 0.0
    got = {(r.seq_id, r.method): (r.f1, r.crossed_f1) for r in pairs.structure_scores(table, df).collect()}
    assert got.keys() == {(s, m) for s in range(40) if crossed[s, "truth"] for m in ("p", "q")}
    for (s, m), (a, b) in got.items():
        assert abs(a - f1(want[s, m], want[s, "truth"])) < 1e-12 and abs(b - f1(crossed[s, m], crossed[s, "truth"])) < 1e-12
    assert {r.seq_id for r in pairs.without_crossings(table, df).collect()} == {s for s in range(40) if not crossed[s, "truth"]}
    wide = pairs.wide_scores(pairs.structure_scores(table, df), ["p", "q"])
    assert wide.columns == ["seq_id", "p", "q"]


# ---------------------------------------------------------------- mutations and log-probabilities


@pytest.mark.parametrize(
    "mode, mutant, want",
    [
        ("insert", "A1G", ("GCTN", None)),
        ("insert", "U3A,A1-", ("CAN", None)),
        ("insert", "N2G", ("ACGTN", None)),
        ("insert", "G1A", (None, "mismatch")),
        ("insert", "A9G", (None, "outside")),
        ("insert", "AxG", (None, "position")),
        ("insert", "A12", (None, "letter")),
        ("insert", "A1G, C2T", ("GTTN", None)),
        ("fill", "N4A", ("ACTA", None)),
        ("fill", "A1G", ("GCT", None)),
        ("fill", "A1N", ("CT", None)),
        ("fill", "N1G", (None, "mismatch")),
        ("substitute", "T3A", ("ACAN", None)),
        ("substitute", "N1G", ("GCUN", None)),
        ("substitute", "X1G", (None, "letter")),
    ],
)
def test_mutation_modes(spark, mode, mutant, want):
    variants = frame(spark, [("a", mutant), ("a", None)], "dms_id string, mutant string")
    constructs = frame(spark, [("a", "acUn")], "dms_id string, construct string")
    got = mutations.mutated_sequences(variants, constructs, mode).collect()
    assert [(r.mutated_sequence, r.reason) for r in got] == [want]


def test_variants_are_folded_batch_by_batch(spark):
    """An expression folded in the plan took a tenth of a millisecond for each variant."""
    import time

    rows = spark.range(200_000).select(F.lit("a").alias("dms_id"), F.concat(F.lit("A1G,C"), F.col("id") % 40 + 1, F.lit("U,U"), F.col("id") % 7, F.lit("-")).alias("mutant"))
    for mode in mutations.MODES:
        made = mutations.mutated_sequences(rows, frame(spark, [("a", "ACGU" * 8)], "dms_id string, construct string"), mode)
        assert "aggregate(" not in made._jdf.queryExecution().optimizedPlan().toString()
    start = time.monotonic()
    got = {(r.reason, r.n) for r in made.groupBy("reason").agg(F.count("*").alias("n")).collect()}
    assert time.monotonic() - start < 15
    want = {}
    for i in range(280):
        at, gone = i % 40 + 1, i % 7
        seq = "GCGU" + "ACGU" * 7
        reason = "outside" if at > 32 else "mismatch" if seq[at - 1] != "C" else "outside" if gone < 1 else "mismatch" if (seq[: at - 1] + "U" + seq[at:])[gone - 1] != "U" else None
        want[reason] = want.get(reason, 0) + sum(1 for _ in range(i, 200_000, 280))
    assert got == set(want.items())


def test_unknown_construct_and_whole_assays(spark):
    variants = frame(spark, [("a", "A1G"), ("b", "A1G"), ("a", "C1G")], "dms_id string, mutant string")
    got = mutations.mutated_sequences(variants, frame(spark, [("a", "A")], "dms_id string, construct string"), "insert")
    assert {(r.dms_id, r.reason) for r in got.collect()} == {("a", None), ("b", "construct"), ("a", "mismatch")}
    assert mutations.whole_assays(got).count() == 0


def test_marginal_scores(spark):
    logp = frame(spark, [("a", p, b, -float(p) - 0.25 * i) for p in (1, 2, 3) for i, b in enumerate("ACGU")], "dms_id string, pos int, base string, logp double")
    variants = frame(spark, [("a", "A1G"), ("a", "A1G,C2U"), ("a", "C1G"), ("a", "A9G"), ("a", None)], "dms_id string, mutant string")
    constructs = frame(spark, [("a", "ACG")], "dms_id string, construct string")
    got = {r.mutant: (r.score, r.mismatch) for r in logprob.wildtype_marginal(variants, constructs, logp).collect()}
    assert got == {"A1G": (-0.5, False), "A1G,C2U": (-1.0, False), "C1G": (None, True), "A9G": (None, True)}
    masked = logprob.exploded(variants).select("dms_id", "mutant", "pos").join(logp, ["dms_id", "pos"])
    got = {r.mutant: r.score for r in logprob.masked_marginal(variants, constructs, masked).collect()}
    assert got == {"A1G": -0.5, "A1G,C2U": -1.0, "C1G": -0.5, "A9G": None}


def test_log_softmax_sums_to_one(spark):
    df = frame(spark, [(k, float(x)) for k in (1, 2) for x in (1, 2, 700)], "k int, logit double")
    sums = logprob.log_softmax(df, ["k"]).groupBy("k").agg(F.sum(F.exp("logp")).alias("s")).collect()
    assert all(abs(r.s - 1) < 1e-12 for r in sums)


def test_expressions(spark):
    row = spark.createDataFrame([(None, float("nan"), " acTy ", "A1G,C2U")], "x double, y double, s string, m string")
    got = E.nan_to_null(row).select(E.clip(F.col("x")).alias("c"), "y", E.to_rna(F.col("s")).alias("r"), E.to_dna(F.lit("AUC")).alias("d"), E.pyrimidine_to_c(F.lit("TY")).alias("p"), E.depth(F.col("m")).alias("z")).first()
    assert tuple(got) == (None, None, "ACUY", "ATC", "UC", "multiple")


# ---------------------------------------------------------------- splits and scoring


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b, 1):
            new.append(row[j - 1] + 1 if x == y else max(new[-1], row[j]))
        row = new
    return row[-1]


def test_common_lengths():
    rng = random.Random(6)
    word = lambda n: "".join(rng.choice("ACGU") for _ in range(n))
    a, b = ([word(rng.choice([1, 5, 20, 63, 64, 90])) for _ in range(120)] for _ in range(2))
    assert splits.common_lengths(a, b, np.arange(120), np.arange(120)).tolist() == [lcs(x, y) for x, y in zip(a, b, strict=True)]


def test_similarity_classes_and_split(spark, monkeypatch):
    monkeypatch.setattr(splits, "PART", 5)
    rng = random.Random(7)
    seqs = set()
    for _ in range(9):
        base = [rng.choice("ACGU") for _ in range(rng.choice([20, 30, 70]))]
        for _ in range(4):
            s = list(base)
            for _ in range(rng.randrange(4)):
                s[rng.randrange(len(s))] = rng.choice("ACGU")
            seqs.add("".join(s))
    df = frame(spark, [("a", s) for s in seqs] + [("a", None), ("b", "A"), ("b", "")], "dms_id string, sequence string")
    near = lambda x, y: lcs(x, y) > 0.8 * max(len(x), len(y))
    similar = splits.similarity_classes(df)
    got = {r.sequence: r for r in similar.where("dms_id = 'a'").collect()}
    assert set(got) == seqs
    for s in seqs:
        assert got[s].n_links == sum(near(s, o) for o in seqs if o != s)
        assert all(got[s]["class"] == got[o]["class"] for o in seqs if near(s, o))
        assert got[s]["class"] <= s
    split = splits.similarity_split(df)
    for g in ("a", "b"):
        rows = split.where(F.col("dms_id") == g).collect()
        fold = {r.sequence: r.fold for r in rows}
        assert sum(f == "val" for f in fold.values()) == -(-len(fold) // 5)
        for r in rows:
            assert r.n_across == sum(near(r.sequence, o) and fold[o] != r.fold for o in fold if o != r.sequence)
    left = {r.dms_id: r.n_across for r in splits.split_leftovers(split).collect()}
    assert left["b"] == 0 and left["a"] < 8


def library(rng, n, size, families=1, most=3):
    """Variants of few families: some letters changed, put in or taken out."""
    out = set()
    bases = [[rng.choice("ACGU") for _ in range(size)] for _ in range(families)]
    while len(out) < n:
        s = list(rng.choice(bases))
        for _ in range(rng.randrange(most + 1)):
            at = rng.randrange(len(s))
            s[at : at + rng.choice([1, 1, 0])] = [rng.choice("ACGU")] * rng.choice([1, 1, 0])
        out.add("".join(s))
    return sorted(out)


def test_index_dismisses_nothing_and_compares_few(spark, monkeypatch):
    monkeypatch.setattr(splits, "PART", 16)
    rng = random.Random(21)
    groups = {"one": library(rng, 60, 40), "few": library(rng, 60, 40, 3), "many": library(rng, 40, 24, 12, 9), "long": library(rng, 20, 80, 2)}
    df = frame(spark, [(g, s) for g, ss in groups.items() for s in ss], "dms_id string, sequence string")
    index = splits.similarity_index(df)
    got = {(r.dms_id, r.sequence): r for r in splits._classed(index).collect()}
    marked = df.where(F.length("sequence") % 2 == 0).withColumnRenamed("sequence", "s")
    to = {(r.dms_id, r.s): r.n for r in splits.indexed_links(index, marked).where("other is null").groupBy("dms_id", "s").agg(F.sum("n").alias("n")).collect()}
    for g, ss in groups.items():
        links = {s: {o for o in ss if o != s and lcs(s, o) > 0.8 * max(len(s), len(o))} for s in ss}
        label = {s: s for s in ss}
        while changed := {s: min([label[s], *(label[o] for o in links[s])]) for s in ss} != label and {s: min([label[s], *(label[o] for o in links[s])]) for s in ss}:
            label = changed
        for s in ss:
            assert got[g, s].n_links == len(links[s]) and got[g, s]["class"] == label[s]
            assert to.get((g, s), 0) == sum(len(o) % 2 == 0 for o in links[s])
    compared = {r.dms_id: (r.n_pairs, r.n_compared) for r in splits.compared_pairs(index).collect()}
    assert compared["one"][0] == 60 * 59 // 2 and compared["one"][1] * 10 <= compared["one"][0] and compared["few"][1] * 10 <= compared["few"][0]


def test_swaps_lower_the_links_across(spark):
    """Two halves joined by few links: neither fits the share, so one is cut, and the cut is no worse than a plain one."""
    rng = random.Random(5)
    df = frame(spark, [("a", s) for s in library(rng, 80, 20, 5, 6)], "dms_id string, sequence string")
    first = splits.split_leftovers(splits.similarity_split(df, rounds=0)).first()
    last = splits.split_leftovers(splits.similarity_split(df, rounds=4)).first()
    assert first.n_val == last.n_val == 16 and last.n_across <= first.n_across


def test_small_groups_are_judged_like_large_ones(spark, monkeypatch):
    """What one task makes of whole groups is what the same groups give when they are spread over tasks."""
    rng = random.Random(31)
    groups = {"one": library(rng, 60, 40), "few": library(rng, 60, 40, 3), "many": library(rng, 90, 24, 12, 9), "long": library(rng, 20, 80, 2), "mixed": library(rng, 50, 20, 5, 6), "single": ["A"]}
    df = frame(spark, [(g, s) for g, ss in groups.items() for s in ss] * 2 + [("one", None), ("one", ""), (None, "ACGU")], "dms_id string, sequence string")
    got = []
    for bound in (1024, 55, 0):
        monkeypatch.setattr(splits, "SMALL", bound)
        split, similar = splits.similarity_split(df), splits.similarity_classes(df)
        got.append((sorted(map(tuple, split.collect())), sorted(map(tuple, similar.select("dms_id", "sequence", "class", "n_links").collect()))))
    assert got[0] == got[1] == got[2] and len(got[0][0]) == sum(map(len, groups.values()))
    assert any(r[-1] for r in got[0][0])


def test_a_split_of_small_groups_keeps_few_bytes(spark):
    """Sequences of small groups are shuffled and stored once, not once for each step."""
    rng = random.Random(32)
    rows = [(f"g{g}", s) for g in range(40) for s in library(rng, 60, 32, 1, 2)]
    df = frame(spark, rows, "dms_id string, sequence string")
    folder = durable.shared_folder(spark).removeprefix("file://")
    size = lambda: sum(f.stat().st_size for f in Path(folder).rglob("*") if f.is_file())
    before = size()
    assert splits.similarity_split(df).count() == len(rows)
    assert size() - before < 60 * len(rows)


def test_random_split_sizes(spark):
    df = frame(spark, [("a", i) for i in range(11)] + [("b", 1)], "dms_id string, i int")
    got = {(r.dms_id, r.fold): r.n for r in splits.split_sizes(splits.random_split(df, ["dms_id", "i"])).collect()}
    assert got == {("a", "val"): 3, ("a", "train"): 8, ("b", "val"): 1}


def test_scoring_and_reuse(spark, tmp_path):
    df = frame(spark, [(1, "AC"), (1, "AC"), (2, "GGG"), (3, None)], "sequence_id int, sequence string")
    score = lambda seqs: [[float(len(s))] * len(s) for s in seqs]
    got = sorted(map(tuple, scoring.score_sequences(df, score, batch=1, limit=2).collect()))
    assert got == [("AC", 1, 0, 2.0), ("AC", 1, 1, 2.0), ("GG", 2, 0, 2.0), ("GG", 2, 1, 2.0)]
    path = str(tmp_path / "stored")
    assert scoring.scored_once(spark, df.limit(2), path, "m", score).count() == 2
    assert scoring.scored_once(spark, df, path, "m", score).count() == 5
    assert scoring.scored_once(spark, df, path, "m", score).count() == 5


def test_numbering_reads_its_input_once(spark):
    labels = frame(spark, [(i, "Private" if i == 3 else None) for i in range(12)], "id long, usage string")
    ranges = frame(spark, [("a", "ACGU", 2, 5), ("b", "AC", 8, 9)], "sequence_id string, sequence string, id_min long, id_max long")
    numbered = structure.number_positions(structure.attach_ranges(labels, ranges))
    assert {r.id: r.position_id for r in numbered.collect()} == {i: None for i in range(12)} | {2: 0, 3: 1, 4: 2, 5: 3, 8: 0, 9: 1}


def test_evaluation_sets_go_by_sequence(spark):
    labels = frame(spark, [(i, "Private" if i in (3, 40) else None, i / 10) for i in range(20)] + [(40, "Private", 1.0)], "id long, usage string, x double")
    ranges = frame(spark, [("a", "ACGU", 2, 5), ("b", "ACGU", 8, 11), ("c", "AC", 13, 14), ("d", None, 15, 16)], "sequence_id string, sequence string, id_min long, id_max long")
    got = structure.evaluation_set(labels, ranges)
    assert {(r.id, r.sequence_id, r.position_id) for r in got.collect()} == {(i, "a", i - 2) for i in range(2, 6)} | {(i, "b", i - 8) for i in range(8, 12)}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window") == 1
    predictions = frame(spark, [(3, 0.5), (13, 0.5), (99, 0.5), (None, 1.0)], "id long, prediction double")
    assert [r.id for r in structure.predictions_of(predictions, got).collect()] == [3]
    firsts = structure.first_of_each(labels.unionAll(labels), ranges)
    assert sorted((r.id, r.sequence) for r in firsts.collect()) == [(3, "ACGU"), (40, None)]


def test_pairs_stay_in_their_rows(spark):
    df = frame(spark, [(1, "truth", "([)]"), (1, "p", "(.)."), (2, "truth", None), (2, "p", "((("), (3, "truth", ""), (3, "p", "()")], "seq_id int, method string, dotbracket string")
    arrays = pairs.pair_arrays(df)
    for out in (pairs.dotbracket_pairs(df), arrays.select(pairs.crossing(F.col("pairs")))):
        assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    scores = pairs.array_scores(arrays)
    assert scores._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") <= 2
    assert [(r.seq_id, r.precision, r.recall, r.f1, r.crossed_f1) for r in scores.collect()] == [(1, 1.0, 0.5, 2 / 3, 0.0)]
    assert [(r.i, r.j) for r in pairs.dotbracket_pairs(df.where("method = 'truth'"), ["seq_id"]).collect()] == [(0, 2), (1, 3)]


def test_crossings_of_places_with_several_partners(spark):
    rng = random.Random(12)
    rows = {k: {tuple(sorted(rng.sample(range(40), 2))) for _ in range(rng.randrange(12))} for k in range(60)}
    df = frame(spark, [(k, *p) for k, ps in rows.items() for p in ps], "seq_id int, i int, j int")
    got = {(r.seq_id, r.i, r.j) for r in pairs.crossing_pairs(df, ["seq_id"]).collect()}
    assert got == {(k, *x) for k, ps in rows.items() for x in ps for y in ps if x[0] < y[0] < x[1] < y[1] or y[0] < x[0] < y[1] < x[1]}


def test_a_long_structure_is_parsed_and_judged_in_time(spark):
    """A bracket for most of 40,000 places, beside short structures: neither steps nor copies grow with the square."""
    import time

    rng = random.Random(8)
    texts = ["".join(rng.choice("([)]") for _ in range(n)) for n in (40_000, 0, 7, 50, 300)] + [None, "(" * 300 + ")" * 300, "([)]"]
    df = frame(spark, [(k, "truth", x) for k, x in enumerate(texts)], "seq_id int, method string, dotbracket string")
    start = time.monotonic()
    arrays = pairs.pair_arrays(df)
    got = {r.seq_id: (r.pairs, set(r.crossed)) for r in arrays.select("seq_id", "pairs", pairs.crossing(F.col("pairs")).alias("crossed")).collect()}
    assert time.monotonic() - start < 30
    for k, text in enumerate(texts):
        want = stack_pairs(text or "")
        assert [(p >> 32, p & 0xFFFFFFFF) for p in got[k][0]] == sorted(want, key=lambda p: p[1])
        if k:
            assert got[k][1] == {i << 32 | j for i, j in want if any(x < i < y < j or i < x < j < y for x, y in want)}
    assert {r.seq_id for r in pairs.arrays_without_crossings(arrays).collect()} == {k for k in got if not got[k][1]}


def test_parsed_pairs_are_no_broadcast(spark):
    """The size of the table that structures are made from says nothing of their pairs."""
    from helixbench.plans import catalogue
    from tests.conftest import SF

    for name in ("ct_pairs", "pair_f1", "structures_without_crossings"):
        assert "BroadcastExchange" not in catalogue.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_wide_and_long_merge_agree_and_join_once(spark):
    variants = frame(spark, [("a", "A1T", 1.0), ("a", "C2G", 2.0), ("b", "A1G", 3.0)], "dms_id string, mutant string, dms_score double")
    scores = [("m", "a", "A1U", None), ("m", "a", "C2G", 0.7), ("n", "a", "A1T", 0.1), ("n", "a", "C2G", 0.2), ("n", "b", None, 0.3)]
    predictions = frame(spark, scores, "model string, dms_id string, mutant string, score double")
    wide = merge.merge_wide(variants, predictions, ["m", "n"], ["score"])
    assert sorted(map(tuple, wide.collect())) == [("a", "A1U", 1.0, None, 0.1), ("a", "C2G", 2.0, 0.7, 0.2)]
    assert wide._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
    report = {(r.dms_id, r.model): (r.n_variants, r.n_lost, r.has_file) for r in merge.loss_report(variants, predictions, ["m", "n"]).collect()}
    assert report == {("a", "m"): (2, 0, True), ("a", "n"): (2, 0, True), ("b", "m"): (1, 1, False), ("b", "n"): (1, 1, True)}


def test_parts_of_assays_grow_with_their_rows(spark, monkeypatch):
    from helixbench.plans import catalogue, fixtures
    from tests.conftest import SF

    monkeypatch.setattr(fixtures, "TASK_ROWS", 500)
    n = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    few, many = -(-n // 500), -(-4 * n // 500)
    plan = catalogue.QUERIES["assay_metrics"](spark, SF)._jdf.queryExecution().toString()
    physical = plan[plan.index("== Physical Plan ==") :]
    assert re.search(rf"hashpartitioning\(dms_id#\d+, model#\d+, {many}\)", physical) and len(re.findall(rf"hashpartitioning\(dms_id#\d+, mutant#\d+, {many}\)", physical)) == 2
    assert re.search(rf"hashpartitioning\(l_suppkey#\d+L?, {few}\)", physical)


def test_positions_are_read_as_in_spark(spark):
    texts = ["A12G", "A 3G", "A+3G", "A-3G", "A\t7 G", "A1_2G", "A٣G", "A2147483647G", "A2147483648G", "A3.0G", "AG", "A", "", "A99999999999999G", "A007G", ",A1G"]
    rows = frame(spark, [(t,) for t in texts], "t string").select("t", F.posexplode(E.parse_mutations(F.col("t"))).alias("k", "m")).select("t", "k", "m.*").collect()
    for r in rows:
        m = r.t.split(",")[r.k]
        assert (r.old, r.pos, r.new) == (m[:1], mutations._position(m[1:-1]), m[-1:]), r
    made = mutations.mutated_sequences(frame(spark, [("a", t) for t in texts], "dms_id string, mutant string"), frame(spark, [("a", "ACGA")], "dms_id string, construct string"), "substitute")
    assert {r.mutant: r.reason for r in made.collect()} | {"A+3G": "mismatch", "A3.0G": "position", ",A1G": "position"} == {r.mutant: r.reason for r in made.collect()}


def test_variants_are_made_once_for_their_masked_tables(spark):
    from helixbench.plans import catalogue
    from tests.conftest import SF

    for name, scans in (("masked_marginal", 0), ("likelihood_files", 0)):
        plan = catalogue.QUERIES[name](spark, SF)._jdf.queryExecution().toString()
        physical = plan[plan.index("== Physical Plan ==") :]
        assert len(re.findall(r"FileScan parquet [^\n]*l_suppkey", physical)) == scans, name


def test_rejected_ranges_are_written_in_parts(spark, monkeypatch):
    from helixbench.plans import catalogue
    from tests.conftest import SF

    seen = []
    monkeypatch.setattr(catalogue.files, "range_rejects", lambda s, path: seen.append(path) or s.createDataFrame([], "column string, value string"))
    monkeypatch.setattr(catalogue, "fixture", lambda s, d, name, found=catalogue.fixture: found(s, d, name).repartition(3, "sequence_id"))
    catalogue.QUERIES["rejected_ranges"](spark, SF)
    parts = [r.value.split("\n") for r in spark.read.text(seen[0], wholetext=True).collect()]
    assert len(parts) == 3 and all(p[0] == "sequence_id,sequence,id_min,id_max" and not any("sequence_id" in x for x in p[1:]) for p in parts)
