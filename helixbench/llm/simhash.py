"""SimHash near-duplicates through a segment-popcount embedding.

A 64-bit fingerprint is cut into 32 segments of two bits; its point is the vector of the segments' bit counts. The
Manhattan distance of two points never exceeds the Hamming distance of their fingerprints, so a range join of the
points within the distance finds every pair of fingerprints within it. The grid of that join: the 32 coordinates
form six blocks; two points within distance 3 agree on at least three whole blocks, so each point goes to the 20
cells that three blocks' coordinates name, and points that share a cell are compared. Links are verified on the
fingerprints themselves.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixbench.llm.common import stored
from helixbench.llm.components import components, forest

RADIUS, BLOCKS = 3, 6
#: Points of a cell that one task compares with each other; larger cells are dealt out in pairs of such parts.
PART = 512


def fingerprint(text: str | None, width: int = 3) -> int:
    """Majority bits of XXH64 (seed 42) over the ``width``-word shingles of a text, A-Z lower-cased."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) <= width:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), 42)]
    else:
        joined = b" ".join(words)
        at, starts = 0, []
        for word in words:
            starts.append(at)
            at += len(word) + 1
        ends = starts[width:] + [at]
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[i : j - 1], 42) for i, j in zip(starts, ends, strict=False)]
    return _majority(np.array(hashes, np.uint64))


def _majority(hashes: np.ndarray) -> int:
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].astype(">u8").view(np.uint8)
        total += np.unpackbits(part.reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > len(hashes)).tobytes(), "big")


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """(key, fp): ``fp`` holds the fingerprint's 64 bits as a signed long. A null or wordless text has 0."""
    name = f"k {df.schema[key].dataType.simpleString()}, fp long"

    def run(batches):
        for batch in batches:
            prints = np.fromiter((fingerprint(x.as_py(), width) for x in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], names=["k", "fp"])

    return df.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t")).mapInArrow(run, name).select(F.col("k").alias(key), "fp")


def _point(fp):
    """The bit counts of the 32 two-bit segments, each in its segment's place of one long: 0, 1, 2 are written 00,
    01, 11, so that the Manhattan distance of two points is the number of bits in which they differ."""
    odd = F.lit(0x5555555555555555)
    upper = F.shiftrightunsigned(fp, 1)
    return fp.bitwiseOR(upper).bitwiseAND(odd).bitwiseOR(F.shiftleft(fp.bitwiseAND(upper).bitwiseAND(odd), 1))


def _cells(point):
    """For each choice of three blocks of coordinates: the choice and the coordinates there."""
    edges = [round(i * 32 / BLOCKS) for i in range(BLOCKS + 1)]
    masks = [sum(3 << (2 * s) for s in range(edges[i], edges[i + 1])) for i in range(BLOCKS)]
    signed = lambda x: x - (1 << 64) if x >= 1 << 63 else x
    return F.array(*(F.struct(F.lit(i).cast("byte").alias("choice"), point.bitwiseAND(F.lit(signed(sum(c)))).alias("at")) for i, c in enumerate(combinations(masks, BLOCKS - RADIUS))))


def _compare(batches):
    """Rows (cell, part pair, side, point) sorted by cell and pair: spanning links of those within the radius."""
    tail = None
    for batch in batches:
        cols = [batch.column(i).to_numpy() for i in range(4)]
        if tail is not None:
            cols = [np.concatenate(x) for x in zip(tail, cols, strict=True)]
        group = cols[0]
        cut = np.flatnonzero(group[1:] != group[:-1]) + 1
        bounds = np.concatenate([[0], cut])
        tail = [c[bounds[-1] :] for c in cols]
        for i, j in zip(bounds[:-1], bounds[1:], strict=True):
            yield from _links(cols[1][i:j], cols[2][i:j], cols[3][i:j])
    if tail is not None:
        yield from _links(*tail[1:])


def _links(side: np.ndarray, fps: np.ndarray, points: np.ndarray):
    """Links between the rows of side 0 and those of side 1 (2: of both), as a spanning forest."""
    first, second = side != 1, side != 0
    a, b = fps[first].view(np.uint64), fps[second].view(np.uint64)
    pa_, pb = points[first].view(np.uint64), points[second].view(np.uint64)
    near = np.bitwise_count(pa_[:, None] ^ pb[None, :]) <= RADIUS
    i, j = np.nonzero(near)
    real = np.bitwise_count(a[i] ^ b[j]) <= RADIUS
    i, j = i[real], j[real]
    apart = a[i] != b[j]
    if apart.any():
        x, y = forest(a[i[apart]].view(np.int64), b[j[apart]].view(np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], names=["a", "b"])


def fingerprint_links(prints: DataFrame) -> DataFrame:
    """(a, b): links between distinct fingerprints ``fp`` within the radius, at least a spanning forest of each
    cell's links, so that the components are those of all links. Fingerprints come as signed longs.

    Cells of up to ``PART`` points are joined with themselves on the cell. In larger ones the points are dealt into
    parts by a hash, and each pair of parts is a group of its own of at most a few times ``PART`` rows, compared in
    blocks; it yields a spanning forest, never all its pairs.
    """
    points = prints.select("fp").distinct().withColumn("point", _point(F.col("fp")))
    rows = points.select("fp", "point", F.explode(_cells(F.col("point"))).alias("c")).select("c.choice", "c.at", "fp", "point")
    sizes = rows.groupBy("choice", "at").agg(F.count("*").alias("n")).where("n > 1")
    shared = stored(rows.join(sizes, ["choice", "at"]), "cells")
    small = shared.where(f"n <= {PART}")
    x, y = small.alias("x"), small.alias("y")
    near = F.bit_count(F.col("x.point").bitwiseXOR(F.col("y.point"))) <= RADIUS
    exact = F.bit_count(F.col("x.fp").bitwiseXOR(F.col("y.fp"))) <= RADIUS
    pairs = x.join(y, (F.col("x.choice") == F.col("y.choice")) & (F.col("x.at") == F.col("y.at")) & (F.col("x.fp") < F.col("y.fp")) & near & exact)
    pairs = pairs.select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"))
    parts = F.ceil(F.col("n") / PART).cast("int")
    own = F.pmod(F.xxhash64("fp", "choice"), parts).cast("int")
    large = shared.where(f"n > {PART}").withColumn("parts", parts).withColumn("own", own)
    large = large.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    pair = F.xxhash64("choice", "at", F.least("own", "other"), F.greatest("own", "other"))
    side = F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1)
    dealt = large.select(pair.alias("pair"), side.cast("int").alias("side"), "fp", "point").repartition("pair").sortWithinPartitions("pair")
    return pairs.unionAll(dealt.mapInArrow(_compare, "a long, b long"))


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """(key, fingerprint, component_id), one row for each input row. ``fingerprint``: 16 lowercase hex digits;
    ``component_id``: the smallest key that is reachable over fingerprints of at most three differing bits, the
    row itself included. Wordless and null texts have fingerprint zero and link like any other. Rows with a null
    key have a fingerprint and a class too, the smallest non-null key of it. Repeated rows stay.

    Equal fingerprints collapse first, so copies cost one aggregated row; what is joined are distinct fingerprints.
    """
    docs = stored(fingerprints(df, key, text, width), "prints")
    distinct = docs.groupBy("fp").agg(F.min(key).alias("least"))
    found = components(fingerprint_links(docs))
    labelled = distinct.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("label"))
    classes = labelled.groupBy("label").agg(F.min("least").alias("component_id"))
    by_print = labelled.join(classes, "label").select("fp", "component_id")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return docs.join(by_print, "fp").select(key, hexed.alias("fingerprint"), "component_id")
