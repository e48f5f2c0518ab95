"""Base pairs of secondary structures: parsing, crossing pairs, precision and recall.

A structure's pairs are one array of longs, ``i << 32 | j`` with i < j, in one row, so that parsing, crossing tests
and comparisons work within rows and only the truth and its predictions meet in a shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixbench.functions.expressions import ratio_or_zero

#: Families of brackets.
FAMILIES = ("()", "[]", "<>", "{}")
KEYS = ("seq_id", "method")


def code(i: Column, j: Column) -> Column:
    return F.shiftleft(i.cast("long"), 32) + j.cast("long")


def ends(pair: Column) -> tuple[Column, Column]:
    return F.shiftright(pair, 32).cast("int"), pair.bitwiseAND(F.lit(0xFFFFFFFF)).cast("int")


def _partners(text: str, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, i, j) of the pairs of texts that lie one behind the other. In one family of a row, an open bracket's
    partner is the next bracket of its depth, if that one closes."""
    letters = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    row = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    found = []
    for left, right in FAMILIES:
        at = np.flatnonzero((letters == ord(left)) | (letters == ord(right)))
        if not len(at):
            continue
        opens = letters[at] == ord(left)
        depth = np.cumsum(np.where(opens, 1, -1)) + ~opens
        order = np.lexsort((at, depth, row[at]))
        near, far = order[:-1], order[1:]
        good = opens[near] & ~opens[far] & (depth[near] == depth[far]) & (row[at[near]] == row[at[far]])
        found.append((at[near[good]], at[far[good]]))
    i, j = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in (0, 1))
    order = np.argsort(j, kind="stable")  # by closing bracket, as a stack finds them
    i, j = i[order], j[order]
    return row[i], i - starts[row[i]], j - starts[row[j]]


def _lists(row: np.ndarray, values: np.ndarray, n: int) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n))])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.int64()))


def parsed(dotbracket: Column) -> Column:
    """The pairs of a structure, by families of brackets, so that pseudoknots survive; a closing bracket pairs with
    its family's last open one, and brackets without a partner are ignored. All structures of a batch are parsed at
    once; a null one has no pairs."""

    @F.arrow_udf("array<long>")
    def parse(texts: pa.Array) -> pa.Array:
        known = [x or "" for x in texts.to_pylist()]
        row, i, j = _partners("".join(known), np.concatenate([[0], np.cumsum([len(x) for x in known], dtype=np.int64)]))
        return _lists(row, i << 32 | j, len(known))

    return parse(dotbracket)


def _crossed(row: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """Which of the pairs another one of their row crosses. Places that have a partner are numbered, row by row; the
    least and the greatest partner of 2^k places from each on are a floor of two tables, of which only one is held."""
    i, j = pairs >> 32, pairs & 0xFFFFFFFF
    places, at = np.unique(np.concatenate([row << 32 | i, row << 32 | j]), return_inverse=True)
    a, b = np.split(at, 2)
    low, high = np.full(len(places), len(places)), np.full(len(places), -1)
    for x, y in ((a, b), (b, a)):
        np.minimum.at(low, x, y)
        np.maximum.at(high, x, y)
    inside, out = b - a - 1, np.zeros(len(pairs), bool)
    k = np.where(inside > 0, np.frexp(np.maximum(inside, 1))[1] - 1, -1)
    for floor in range(int(k.max(initial=-1)) + 1):
        now = np.flatnonzero(k == floor)
        first, second = a[now] + 1, b[now] - (1 << floor)
        out[now] = (np.minimum(low[first], low[second]) < a[now]) | (np.maximum(high[first], high[second]) > b[now])
        step = 1 << floor
        low = np.concatenate([np.minimum(low[:-step], low[step:]), low[-step:]])
        high = np.concatenate([np.maximum(high[:-step], high[step:]), high[-step:]])
    return out


def crossing(pairs: Column) -> Column:
    """Those of an array of pairs that another of them crosses: some place inside the pair has a partner outside. n log
    n steps, where comparing pairs with pairs takes n squared; all structures of a batch are judged at once."""

    @F.arrow_udf("array<long>")
    def judge(lists: pa.Array) -> pa.Array:
        row = np.repeat(np.arange(len(lists)), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        values = lists.flatten().to_numpy(zero_copy_only=False)
        good = _crossed(row, values) if len(values) else np.zeros(0, bool)
        return _lists(row[good], values[good], len(lists))

    return judge(pairs)


def pair_arrays(structures: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, pairs) of structures in dot-bracket form; a null one has no pairs."""
    return structures.select(*keys, parsed(F.col("dotbracket")).alias("pairs"))


def listed(arrays: DataFrame, keys: Sequence[str] = KEYS, pairs: str = "pairs") -> DataFrame:
    """(keys, i, j): a row for each pair."""
    i, j = ends(F.col("_p"))
    return arrays.select(*keys, F.explode(pairs).alias("_p")).select(*keys, i.alias("i"), j.alias("j"))


def gathered(pairs: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, pairs) of a table of pairs, each pair once."""
    return pairs.groupBy(*keys).agg(F.collect_set(code(F.col("i"), F.col("j"))).alias("pairs"))


def dotbracket_pairs(structures: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, i, j): 0-based pairs i < j of four bracket families. Nothing is shuffled."""
    return listed(pair_arrays(structures, keys), keys)


def distinct_pairs(pairs: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return pairs.select(*keys, F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")).distinct()


def crossing_pairs(pairs: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, i, j): pairs that some other pair of the same structure crosses. A structure's pairs meet in one row."""
    return listed(gathered(pairs, keys).select(*keys, crossing(F.col("pairs")).alias("pairs")), keys)


def array_scores(arrays: DataFrame, truth: str = "truth") -> DataFrame:
    """(seq_id, method, precision, recall, f1, crossed_f1) of each structure of (seq_id, method, pairs) against the
    truth, only for sequences whose truth has crossing pairs; the others are ``without_crossings``. An empty
    denominator gives 0. Truth and predictions are shuffled once by seq_id; arrays grow when they are parsed, so that
    the size of what they are read from must not make either side a broadcast."""
    rows = arrays.withColumn("crossed", crossing(F.col("pairs")))
    real = rows.where((F.col("method") == truth) & (F.size("crossed") > 0)).select("seq_id", F.col("pairs").alias("real"), F.col("crossed").alias("real_x"))
    both = rows.where(F.col("method") != truth).join(real.hint("merge"), "seq_id")
    f1 = lambda a, b: ratio_or_zero(2 * F.size(F.array_intersect(a, b)), F.size(a) + F.size(b))
    hit = F.size(F.array_intersect("pairs", "real"))
    return both.select(
        "seq_id", "method", ratio_or_zero(hit, F.size("pairs")).alias("precision"), ratio_or_zero(hit, F.size("real")).alias("recall"),
        f1(F.col("pairs"), F.col("real")).alias("f1"), f1(F.col("crossed"), F.col("real_x")).alias("crossed_f1"),
    )


def structure_scores(pairs: DataFrame, grid: DataFrame, truth: str = "truth") -> DataFrame:
    """(seq_id, method, f1, crossed_f1) of a table of pairs: ``array_scores`` of each row of ``grid`` (seq_id, method).
    A method that is missing for a sequence scores against no pairs."""
    none = F.expr("array()").cast("array<long>")
    arrays = grid.select("seq_id", "method").distinct().join(gathered(pairs), list(KEYS), "left").select(*KEYS, F.coalesce("pairs", none).alias("pairs"))
    return array_scores(arrays, truth).select("seq_id", "method", "f1", "crossed_f1")


def arrays_without_crossings(arrays: DataFrame, truth: str = "truth") -> DataFrame:
    """(seq_id): the sequences of (seq_id, method, pairs) whose truth has no crossing pairs, or that have no truth."""
    real = F.when(F.col("method") == truth, F.col("pairs"))
    return arrays.groupBy("seq_id").agg(F.max(F.size(crossing(real))).alias("n")).where("n = 0").select("seq_id")


def without_crossings(pairs: DataFrame, sequences: DataFrame, truth: str = "truth") -> DataFrame:
    real = gathered(pairs.where(F.col("method") == truth)).where(F.size(crossing(F.col("pairs"))) > 0)
    return sequences.select("seq_id").distinct().join(real.select("seq_id"), "seq_id", "left_anti")


def missing_predictions(sequences: DataFrame, predictions: DataFrame, key: str = "sequence") -> DataFrame:
    """Sequences that no prediction is listed for."""
    return sequences.join(predictions.select(key).distinct(), key, "left_anti")


def wide_scores(scores: DataFrame, methods: Sequence[str]) -> DataFrame:
    """A row for each sequence with a struct (f1, crossed_f1) for each method."""
    return scores.groupBy("seq_id").pivot("method", list(methods)).agg(F.first(F.struct("f1", "crossed_f1")))
