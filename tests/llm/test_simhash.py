import random

import xxhash
from pyspark.sql import functions as F

from helixbench.llm import simhash
from helixbench.llm.components import components


def plain_print(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_classes(prints):
    """Smallest key reachable over at most three differing bits, by comparing all pairs."""
    least = {k: k for k in prints}

    def root(k):
        while least[k] != k:
            k = least[k]
        return k

    keys = sorted(prints)
    for i, x in enumerate(keys):
        for y in keys[i + 1 :]:
            if (prints[x] ^ prints[y]).bit_count() <= 3:
                a, b = root(x), root(y)
                least[max(a, b)] = min(a, b)
    return {k: root(k) for k in keys}


def check(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string, component string")
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(df).collect()}
    prints = {r[0]: plain_print(r[1]) for r in rows}
    classes = plain_classes(prints)
    assert got == {k: (f"{v:016x}", classes[k]) for k, v in prints.items()}


def test_against_all_pairs(spark):
    rng = random.Random(3)
    rows = []
    for i in range(60):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([1, 2, 3, 40, 300]))]
        for _ in range(rng.choice([1, 1, 2, 4])):
            rows.append((len(rows), " ".join(words), "x", "y"))
            words = list(words)
            words[rng.randrange(len(words))] = "Changed"
    rows += [(1000, None, "x", "y"), (1001, " \n\t", "x", "y"), (1002, "", "x", "y"), (1003, "ÄB ÄB\x0bab AB", "x", "y")]
    check(spark, rows)


def test_cells_larger_than_a_part(spark, monkeypatch):
    monkeypatch.setattr(simhash, "PART", 3)
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(3)]
    prints = {b ^ sum(1 << x for x in rng.sample(range(64), rng.randrange(4))) for b in base for _ in range(40)}
    keys = {i: p for i, p in enumerate(sorted(prints))}
    signed = lambda p: p - (1 << 64) if p >> 63 else p
    df = spark.createDataFrame([(signed(p),) for p in prints], "fp long")
    found = components(simhash.fingerprint_links(df)).collect()
    label = {p: p for p in map(signed, prints)} | {r.node: r.component for r in found}
    groups = plain_classes(keys)
    by = {}
    for k, p in keys.items():
        by.setdefault(label[signed(p)], set()).add(groups[k])
    assert all(len(x) == 1 for x in by.values()) and len(by) == len(set(groups.values()))


def test_native_hash_agrees(spark):
    text = "one Two ÄÖ three"
    joined = F.concat_ws(" ", F.lit("one"), F.lit("two"), F.lit("ÄÖ"))
    want = spark.range(1).select(F.xxhash64(joined)).first()[0]
    assert xxhash.xxh64_intdigest("one two ÄÖ".encode(), 42) == want % (1 << 64)
    assert simhash.fingerprint("one Two ÄÖ") == xxhash.xxh64_intdigest("one two ÄÖ".encode(), 42)
    assert simhash.fingerprint(text) == plain_print(text)


def test_empty_and_repeated_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(empty).count() == 0
    rows = spark.createDataFrame([(1, "a b c d"), (1, "a b c d"), (None, "a b c d")], "doc_id long, text string")
    assert [r.component_id for r in simhash.near_duplicates(rows).collect()] == [1, 1, 1]


def test_components_of_a_chain_and_a_hub(spark):
    chain = [(i + 1, i) for i in range(40)] + [(100, x) for x in range(101, 160)] + [(7, 7), (3, 2)]
    got = {r.node: r.component for r in components(spark.createDataFrame(chain, "x long, y long")).collect()}
    assert set(got) == {*range(41), *range(100, 160)}
    assert len({got[i] for i in range(41)}) == len({got[i] for i in range(100, 160)}) == 1 and got[0] in range(41) and got[100] in range(100, 160)
