"""Mixing sources to target weights by Pfair scheduling of blocks.

The rows that each source gives to the mix are cut into blocks. With n blocks of a source among N in all, its i-th
block (i from 1) is released at slot floor((i-1) N / n) and due at ceil(i N / n); in each slot the released block with
the earliest deadline runs. Every block then runs between its release and its deadline, so that at any slot a source
has had its share of the blocks to within less than one, from the first slot to the last, however rare it is.

The schedule is made once, for at most ``SLOTS`` blocks: where that many of ``BLOCK`` rows do not hold the mix, blocks
have more rows. So it has the same fineness over any corpus, and a bounded size.
"""

from __future__ import annotations

import heapq
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixbench.llm.common import fresh, sized

BLOCK, SLOTS, LARGEST = 64, 1 << 18, 0.25
_BUCKET_BITS = 12
_NO_SOURCE = "\0"


def capped(sizes: dict[str, int], largest: float = LARGEST) -> dict[str, Fraction]:
    """Target weights that follow the sources' sizes, but give none more than ``largest`` (or an equal share, where
    there are too few sources for that); what is cut off goes to the others in proportion. The weights are exact."""
    largest = max(Fraction(largest), Fraction(1, max(1, len(sizes))))
    total = sum(sizes.values())
    weights = {s: Fraction(n, total) for s, n in sizes.items()}
    fixed: set[str] = set()
    while over := {s for s, w in weights.items() if w > largest and s not in fixed}:
        fixed |= over
        rest = sum(sizes[s] for s in sizes if s not in fixed)
        left = 1 - largest * len(fixed)
        weights = {s: largest if s in fixed else Fraction(sizes[s], rest) * left for s in sizes}
    return weights


def period(shares: dict[str, int]) -> list[tuple[str, int]]:
    """(source, number of its block within the period) of each slot, earliest deadline first."""
    slots = sum(shares.values())
    waiting = [(0, s, 0) for s in shares]
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int]] = []
    out = []
    for slot in range(slots):
        while waiting and waiting[0][0] <= slot:
            _, s, i = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(i + 1) * slots // shares[s]), s, i))
        due, s, i = heapq.heappop(ready)
        if due <= slot:
            raise AssertionError("a deadline was missed")
        out.append((s, i))
        if i + 1 < shares[s]:
            heapq.heappush(waiting, ((i + 1) * slots // shares[s], s, i + 1))
    return out


def _ranked(df: DataFrame, key: str, source: str) -> DataFrame:
    """(source, k, h, rank): the place of each distinct key in its source's random order. A source is numbered in
    buckets of the hash, so that no task holds a whole source; the buckets' sizes are added up apart."""
    rows = df.select(F.coalesce(F.col(source).cast("string"), F.lit(_NO_SOURCE)).alias("source"), F.col(key).alias("k")).distinct()
    rows = rows.withColumn("h", _hash(F.col("k"))).withColumn("bucket", F.shiftrightunsigned("h", 64 - _BUCKET_BITS))
    within = rows.withColumn("at", F.row_number().over(Window.partitionBy("source", "bucket").orderBy("h", "k")))
    sizes = rows.groupBy("source", "bucket").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("source").orderBy("bucket")) - F.col("n")
    return within.join(sizes.select("source", "bucket", before.alias("before")), ["source", "bucket"]).select("source", "k", "h", (F.col("before") + F.col("at") - 1).alias("rank"))


def _hash(key: Column) -> Column:
    return F.xxhash64(F.lit(9), key)


def targets(sizes: dict[str, int], weights: dict[str, float]) -> dict[str, int]:
    """Rows of each source in the largest mix that has the weights exactly: no source is asked for more than it has,
    and at least one has all its rows in the mix. A source with a positive weight has a row at least. Decimal fractions
    count as they are written."""
    exact = {s: Fraction(str(w)) for s, w in weights.items() if w > 0}
    total = min((sizes[s] / w for s, w in exact.items()), default=0)
    return {s: max(1, int(w * total)) for s, w in exact.items()}


class Plan:
    """What each source gives to the mix, and when its blocks run.

    ``kept`` has the rows of each source in the mix, ``block`` the rows of a block (a source's last one may have
    fewer), ``blocks`` the sources' numbers of them, ``places`` (source, number of the block from 0, slot)."""

    def __init__(self, df: DataFrame, source: str, key: str, weights: dict[str, float] | None, block: int, slots: int):
        named = F.coalesce(F.col(source).cast("string"), F.lit(_NO_SOURCE))
        counted = df.select(named.alias("s"), F.col(key).alias("k")).distinct().groupBy("s").agg(F.count("*").alias("n"))
        sizes = {r.s: r.n for r in counted.collect()}
        wanted = sizes if weights is None else {s: w for s, w in weights.items() if s in sizes and w > 0}
        self.kept = targets(sizes, wanted)
        self.block = max(block, -(-sum(self.kept.values()) // max(1, slots - len(self.kept))))
        self.blocks = {s: -(-n // self.block) for s, n in self.kept.items()}
        self.places = [(s, i, slot) for slot, (s, i) in enumerate(period(self.blocks))]


def schedule(df: DataFrame, key: str = "doc_id", source: str = "source", weights: dict[str, float] | None = None, block: int = BLOCK, slots: int = SLOTS) -> DataFrame:
    """(key, source, block, place, slot, in_mix), one row for each distinct (source, key): the number of the row's
    block in its source, its place in the block, the slot in which the block runs, and whether the row is in the mix.
    Reading by (slot, place) gives the mixture. Rows that are not in the mix have no slot.

    ``weights`` name their sources (null is named "\\0"); by default they are the sources' sizes, and every row is in
    the mix. With weights the mix is the largest that has them: it ends where the first source has run out, and rows
    of the others beyond their share, and of sources without a weight, are left out. Within a source the order is a
    hash's. ``block`` is the least size of a block, ``slots`` about the most blocks (more only with more sources). The
    driver sees the sources' sizes and the schedule of the slots, which is broadcast."""
    plan = Plan(df, source, key, weights, block, slots)
    spark = df.sparkSession
    numbered = _ranked(df, key, source).withColumn("block", F.floor(F.col("rank") / plan.block)).withColumn("place", (F.col("rank") % plan.block).cast("int"))
    table = spark.createDataFrame(plan.places, "source string, block long, slot long")
    kept = spark.createDataFrame(list(plan.kept.items()), "source string, kept long")
    placed = numbered.join(F.broadcast(kept), "source", "left").withColumn("in_mix", F.coalesce(F.col("rank") < F.col("kept"), F.lit(False)))
    placed = placed.join(F.broadcast(table), ["source", "block"], "left")
    named = F.when(F.col("source") != _NO_SOURCE, F.col("source"))
    return placed.select(F.col("k").alias(key), named.alias(source), "block", "place", F.when(F.col("in_mix"), F.col("slot")).alias("slot"), "in_mix")


def mix(df: DataFrame, key: str = "doc_id", source: str = "source", weights: dict[str, float] | None = None, block: int = BLOCK, slots: int = SLOTS) -> DataFrame:
    """The rows of ``df`` that ``schedule`` puts in the mix, columns unchanged; rows that share source and key stay
    or go together. The texts are not shuffled: a source's cut is the hash of its last key in the mix, one row for
    each source, sent to all tasks where there are few and joined else."""
    plan = Plan(df, source, key, weights, block, slots)
    of, cut = fresh(df, "_s", "_cut")
    ends = df.sparkSession.createDataFrame([(s, n - 1) for s, n in plan.kept.items()], "source string, rank long")
    last = _ranked(df, key, source).join(ends, ["source", "rank"])
    cuts, _ = sized(last.select(F.col("source").alias(of), F.struct("h", "k").alias(cut)), "cuts")
    named = F.coalesce(F.col(source).cast("string"), F.lit(_NO_SOURCE))
    own = F.struct(_hash(F.col(key)).alias("h"), F.col(key).alias("k"))
    unsigned = lambda c: F.struct(c["h"] < 0, c["h"], c["k"])
    return df.join(cuts, (named == F.col(of)) & (unsigned(own) <= unsigned(F.col(cut)))).select(*(df[c] for c in df.columns))
