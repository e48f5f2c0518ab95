"""Bootstrap standard errors over assays with draws that a hash fixes."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helixbench.operators.durable import checkpointed
from helixbench.operators.leaderboard import best_models

#: Replicates of an error where the caller names no number.
REPLICATES = 10_000


#: Assays whose draws are added up together, over all replicates; replicates that are held as numbers at a time.
BLOCK, STEP = 4096, 256
_TURNS = [7, 12, 17, 22] * 4 + [5, 9, 14, 20] * 4 + [4, 11, 16, 23] * 4 + [6, 10, 15, 21] * 4
_SINES = [np.uint32(int(abs(math.sin(i + 1)) * 2**32)) for i in range(64)]


def first_words(prefix: bytes, numbers: np.ndarray) -> np.ndarray:
    """The first eight hexadecimal digits of md5(prefix + number), as numbers, of all numbers at once; the text has at
    most 55 bytes."""
    out = np.zeros(len(numbers), np.uint32)
    digits = np.searchsorted(10 ** np.arange(1, 19), numbers, side="right") + 1
    for width in np.unique(digits):
        at = np.flatnonzero(digits == width)
        size = len(prefix) + int(width)
        used = size // 4 + 1  # words of the block that are not zero, but for the length
        text = np.zeros((4 * used, len(at)), np.uint32)
        text[: len(prefix)] = np.frombuffer(prefix, np.uint8)[:, None]
        rest = numbers[at].astype(np.uint64)
        for k in range(int(width)):
            rest, digit = np.divmod(rest, np.uint64(10))
            text[size - 1 - k] = digit + np.uint64(48)
        text[size] = 128
        words = text[0::4] | text[1::4] << np.uint32(8) | text[2::4] << np.uint32(16) | text[3::4] << np.uint32(24)
        a, b, c, d = (np.full(len(at), x, np.uint32) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476))
        for i in range(64):
            f, g = _round(i, b, c, d)
            f = f + a + (_SINES[i] if g % 16 != 14 else np.uint32((int(_SINES[i]) + 8 * size) & 0xFFFFFFFF))
            if g % 16 < used:
                f += words[g % 16]
            a, d, c, b = d, c, b, b + (f << np.uint32(_TURNS[i]) | f >> np.uint32(32 - _TURNS[i]))
        out[at] = (a + np.uint32(0x67452301)).byteswap()
    return out


def _round(i: int, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, int]:
    if i < 16:
        return d ^ b & (c ^ d), i
    if i < 32:
        return c ^ d & (b ^ c), 5 * i + 1
    return (b ^ c ^ d, 3 * i + 5) if i < 48 else (c ^ (b | ~d), 7 * i)


def draws(spark: SparkSession, n: int, replicates: int, seed: int = 42) -> DataFrame:
    """(block, replicate, times): how often each replicate draws each of n assays, n of n with replacement: of a block
    of ``BLOCK`` assays the numbers lie one behind the other in ``times``. Draw k of a replicate is the assay of number
    md5(seed|replicate|k) mod n; one set serves all metrics. A replicate's draws are made and counted in one place, so
    that only counts are shuffled, about a byte for each assay and replicate."""

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for replicate in batch["replicate"]:
                times = np.zeros(n, np.int64)
                for low in range(0, n, 1 << 15):
                    words = first_words(f"{seed}|{replicate}|".encode(), np.arange(low, min(n, low + (1 << 15))))
                    times += np.bincount(words.astype(np.int64) % n, minlength=n)
                small = times.astype(np.min_scalar_type(int(times.max())))
                yield pd.DataFrame([(k // BLOCK, replicate, small[k : k + BLOCK].tobytes()) for k in range(0, n, BLOCK)], columns=["block", "replicate", "times"])

    grid = spark.range(0, replicates if n else 0, 1, max(1, min(replicates, 8 * spark.sparkContext.defaultParallelism))).select(F.col("id").cast("int").alias("replicate"))
    return grid.mapInPandas(counted, "block int, replicate int, times binary")


def _added(cells: pd.DataFrame, drawn: pd.DataFrame) -> pd.DataFrame:
    """(metric, kind, model, replicate, total, n) of a block: sums of differences and their numbers in each replicate."""
    if not len(cells) or not len(drawn):
        return pd.DataFrame({"metric": [], "kind": [], "model": [], "replicate": [], "total": [], "n": []})
    keys = cells[["metric", "kind", "model"]].drop_duplicates().reset_index(drop=True)
    column = cells.merge(keys.reset_index(), on=["metric", "kind", "model"], how="left")["index"].to_numpy()
    width, out = int(cells["width"].iloc[0]), []
    value, there = np.zeros((2, width, len(keys)))
    np.add.at(value, (cells["at"].to_numpy(), column), cells["d"].to_numpy())
    np.add.at(there, (cells["at"].to_numpy(), column), 1.0)
    for low in range(0, len(drawn), STEP):
        part = drawn.iloc[low : low + STEP]
        times = np.stack([np.frombuffer(x, f"u{len(x) // width}") for x in part["times"]]).astype(float)
        rows = keys.loc[np.tile(np.arange(len(keys)), len(part))].reset_index(drop=True)
        out.append(rows.assign(replicate=np.repeat(part["replicate"].to_numpy(), len(keys)), total=(times @ value).ravel(), n=(times @ there).ravel()))
    return pd.concat(out, ignore_index=True)


def bootstrap_errors(long: DataFrame, replicates: int = REPLICATES, seed: int = 42) -> DataFrame:
    """(metric, rna_type, model, se): over the replicates, the sample standard deviation of the mean difference to
    the best model of the type, ``All`` included; null with fewer than two replicates that have a value.

    ``long``: (dms_id, rna_type, model, metric, value). Differences and draws meet by blocks of assays, where the sums
    of all replicates are a product of two small matrices; rows do not multiply with the replicates.
    """
    long = checkpointed(long)  # a small table that is read several times
    best = best_models(long).select("metric", F.col("rna_type").alias("kind"), F.col("model").alias("best"))
    kinds = long.withColumn("kind", F.explode(F.array(F.col("rna_type"), F.lit("All"))))
    top = long.select("metric", "dms_id", F.col("model").alias("best"), F.col("value").alias("top"))
    numbered = checkpointed(long.select("dms_id").distinct().withColumn("at", F.row_number().over(Window.orderBy("dms_id")) - 1))
    n = numbered.count()
    apart = kinds.join(best, ["metric", "kind"]).join(top, ["metric", "dms_id", "best"]).join(numbered, "dms_id")
    block = F.floor(F.col("at") / BLOCK).cast("int")
    cells = apart.select(block.alias("block"), F.least(F.lit(BLOCK), F.lit(n) - block * BLOCK).alias("width"), (F.col("at") % BLOCK).alias("at"), "metric", "kind", "model", (F.col("value") - F.col("top")).alias("d")).where("d is not null")
    drawn = draws(long.sparkSession, n, replicates, seed)
    sums = cells.groupBy("block").cogroup(drawn.groupBy("block")).applyInPandas(_added, "metric string, kind string, model string, replicate int, total double, n double")
    each = sums.groupBy("metric", "kind", "model", "replicate").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    mean = F.when(F.col("n") > 0, F.col("total") / F.col("n"))
    return each.groupBy("metric", "kind", "model").agg(F.stddev_samp(mean).alias("se")).withColumnRenamed("kind", "rna_type")


def depth_errors(long: DataFrame, replicates: int = REPLICATES, seed: int = 42) -> DataFrame:
    """(metric, depth, model, se): the same for each mutation depth by itself, over the assays that have it. ``long``:
    (dms_id, depth, model, metric, value)."""
    long = checkpointed(long)
    out = None
    for depth in ("single", "multiple"):
        rows = long.where(F.col("depth") == depth).withColumnRenamed("depth", "rna_type")
        found = bootstrap_errors(rows, replicates, seed).where(F.col("rna_type") == depth).withColumnRenamed("rna_type", "depth")
        out = found if out is None else out.unionByName(found)
    return out
