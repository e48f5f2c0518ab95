import random
from fractions import Fraction

from helixbench.llm import mixing


def test_every_block_runs_in_its_window():
    rng = random.Random(3)
    for _ in range(30):
        shares = {f"s{i}": 1 + int(rng.random() ** 3 * rng.choice([3, 40, 900])) for i in range(rng.randrange(1, 12))}
        plan = mixing.period(shares)
        total = sum(shares.values())
        assert len(plan) == total
        done = dict.fromkeys(shares, 0)
        for t, (s, i) in enumerate(plan, 1):
            assert i == done[s]
            done[s] += 1
            assert all(abs(done[x] - Fraction(shares[x] * t, total)) < 1 for x in shares)


def test_three_hundred_sources_stay_within_a_block():
    rng = random.Random(8)
    shares = {f"s{i}": 1 + int(rng.paretovariate(0.6)) % 500 for i in range(300)}
    total, done = sum(shares.values()), dict.fromkeys(shares, 0)
    for t, (s, _) in enumerate(mixing.period(shares), 1):
        done[s] += 1
        # Only the one that ran and those that were due can be at the edge; all are looked at in steps.
        assert abs(done[s] * total - shares[s] * t) < total
        if t % 97 == 0:
            assert all(abs(done[x] * total - shares[x] * t) < total for x in shares)
    assert done == shares


def docs(spark, sizes):
    rows = [(i, f"t{i}", s) for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def check(got, sizes, kept, block):
    """Rows of ``schedule``: what is kept, whole slots, and at every slot each source within a block of its share."""
    assert len(got) == sum(sizes.values())
    assert {s: sum(r.in_mix for r in got if r.source == s) for s in sizes} == kept
    slots = {}
    for r in got:
        assert (r.slot is None) == (not r.in_mix) and 0 <= r.place < block
        if r.in_mix:
            slots.setdefault(r.slot, set()).add((r.source, r.block))
    assert all(len(x) == 1 for x in slots.values()) and sorted(slots) == list(range(len(slots)))
    blocks, done = {s: -(-n // block) for s, n in kept.items()}, dict.fromkeys(sizes, 0)
    assert len(slots) == sum(blocks.values())
    for t in range(len(slots)):
        ((s, i),) = slots[t]
        assert i == done[s]
        done[s] += 1
        assert all(abs(done[x] - Fraction(blocks[x] * (t + 1), len(slots))) < 1 for x in sizes)
    assert len({(r.source, r.block, r.place) for r in got}) == len(got)


def test_by_default_all_rows_are_mixed_in_proportion(spark):
    sizes = {"hot": 900, "one": 1, None: 1, **{f"s{i}": 60 + i for i in range(5)}}
    df = docs(spark, sizes)
    check(mixing.schedule(df, block=4).collect(), sizes, sizes, 4)
    assert mixing.mix(df, block=4).count() == sum(sizes.values())


def test_given_weights_cut_the_others_to_the_first_that_runs_out(spark):
    sizes = {"a": 300, "b": 120, "c": 31, None: 7}
    weights = {"a": 0.5, "b": 0.3, "c": 0.15, "\0": 0.05}
    df = docs(spark, sizes)
    kept = {"a": 70, "b": 42, "c": 21, None: 7}
    check(mixing.schedule(df, weights=weights, block=4).collect(), sizes, kept, 4)
    assert {r.source for r in mixing.mix(df, weights=weights, block=4).collect()} == set(sizes)
    check(mixing.schedule(docs(spark, {"a": 500, "b": 500, "c": 2}), weights={"a": 0.498, "b": 0.498, "c": 0.004}, block=2).collect(), {"a": 500, "b": 500, "c": 2}, {"a": 249, "b": 249, "c": 2}, 2)


def test_blocks_grow_where_the_slots_do_not_suffice(spark):
    sizes = {"a": 500, "b": 100, "c": 1}
    got = mixing.schedule(docs(spark, sizes), block=2, slots=50).collect()
    check(got, sizes, sizes, -(-601 // 47))


def test_the_mix_has_the_rows_of_the_schedule(spark):
    df = docs(spark, {"a": 60, "b": 30, "c": 10})
    for weights in (None, {"a": 0.5, "b": 0.5}, {"a": 0.2, "b": 0.3, "c": 0.5}):
        placed = {r.doc_id for r in mixing.schedule(df, weights=weights, block=3).where("in_mix").collect()}
        assert {r.doc_id for r in mixing.mix(df, weights=weights, block=3).collect()} == placed
    assert "text" not in mixing.schedule(df).columns


def test_repeats_empty_and_unknown_sources(spark):
    df = docs(spark, {"a": 10})
    assert mixing.mix(df.unionAll(df)).count() == 20
    assert mixing.mix(df.limit(0)).count() == mixing.schedule(df.limit(0)).count() == 0
    none = mixing.schedule(df, weights={"b": 1.0}).collect()
    assert len(none) == 10 and not any(r.in_mix for r in none) and {r.slot for r in none} == {None}
    assert mixing.mix(df, weights={"b": 1.0}).count() == 0
    keyless = spark.createDataFrame([(None, "t", "a"), (None, "u", "a"), (1, None, None)], "doc_id long, text string, source string")
    assert mixing.mix(keyless).count() == 3


def test_capped_weights():
    assert mixing.capped({"a": 1}) == {"a": 1.0}
    assert mixing.capped({"a": 80, "b": 5, "c": 5, "d": 5, "e": 5}) == {"a": Fraction(1, 4), **{s: Fraction(3, 16) for s in "bcde"}}
