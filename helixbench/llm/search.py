"""Ranked lexical search by two trees: one over the items that are asked, one over each batch of documents.

A document's value of a term is (10^9 tf) div (1000 tf + 8 m), an item's weight of a term w; a score is the sum of
their products. Every node of a tree holds, for each term, the largest value (weight) below it, so that the same sum
over two nodes is at least the score of any item and document below them. A pair of nodes whose bound is less than the
weakest kth score of its items so far is left with all that is below it; ties are kept, so that the result is exact.
Documents are read and counted once; a batch's tree lives in the task that searches it.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixbench.llm.common import forget, stored

#: Documents of a batch and of a leaf, children of a node, items of a leaf.
BATCH, LEAF, FAN, ITEMS = 8192, 32, 8, 4
#: Items whose weights and tree are sent to the tasks at once; more are searched block by block. One document in so
#: many tells the first kth scores.
BLOCK, FIRST = 2048, 16
#: Parts of an item's results that are ranked apart before they are ranked together.
_PARTS = 64
#: Bytes of a text as terms have them: A-Z lower-cased, all but letters, digits and what is not ASCII blank.
_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


def terms(text: bytes | None) -> list[bytes]:
    """The terms of a text in UTF-8: runs of letters, digits and characters beyond ASCII."""
    return text.translate(_BYTES).split() if text else []


def _binary(column: pa.Array) -> Iterator[bytes | None]:
    return (x.as_py() for x in column.cast(pa.binary()))


class Lists(NamedTuple):
    """Sparse rows: ``cols[at[i]:at[i+1]]`` and ``vals`` of row i."""

    at: np.ndarray
    cols: np.ndarray
    vals: np.ndarray

    def row(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        part = slice(self.at[i], self.at[i + 1])
        return self.cols[part], self.vals[part]


def _lists(rows: list[tuple[np.ndarray, np.ndarray]]) -> Lists:
    at = np.cumsum([0, *(len(c) for c, _ in rows)])
    none = np.empty(0, np.int64)
    return Lists(at, np.concatenate([none, *(c for c, _ in rows)]).astype(np.int64), np.concatenate([none, *(v for _, v in rows)]).astype(np.int64))


def _maxima(rows: Lists, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Of rows low to high, each column with its largest value."""
    part = slice(rows.at[low], rows.at[high])
    cols, where = np.unique(rows.cols[part], return_inverse=True)
    best = np.zeros(len(cols), np.int64)
    np.maximum.at(best, where, rows.vals[part])
    return cols, best


class Tree(NamedTuple):
    """Levels from the leaves up, each the sparse coordinate maxima of its nodes; node i of a level has the nodes
    i * fan to i * fan + fan - 1 of the level below it, a leaf as many rows in their order."""

    rows: Lists
    levels: list[Lists]
    fan: int
    leaf: int


def grow(rows: Lists, leaf: int, fan: int) -> Tree:
    levels, below, width = [], rows, leaf
    while True:
        n = len(below.at) - 1
        below = _lists([_maxima(below, low, min(n, low + width)) for low in range(0, n, width)])
        levels.append(below)
        if len(below.at) <= 2:
            return Tree(rows, levels, fan, leaf)
        width = fan


def in_order(rows: Lists) -> np.ndarray:
    """An order that puts rows side by side whose largest values are in the same terms: by their heaviest term, then
    the next. What is together in a leaf decides only how tight its bounds are."""
    heads = np.zeros((len(rows.at) - 1, 2), np.int64)
    for i in range(len(heads)):
        cols, vals = rows.row(i)
        top = cols[np.lexsort((cols, -vals))[:2]]
        heads[i, : len(top)] = top + 1
    return np.lexsort((heads[:, 1], heads[:, 0]))


class Items(NamedTuple):
    """The items of a block: their ids, the place of each of their terms, and their weights as a tree."""

    ids: list
    vocabulary: dict[bytes, int]
    weights: np.ndarray
    tree: Tree


def items_tree(words: list[tuple[object, list[bytes]]], df: dict[bytes, int], n: int) -> Items:
    """Items (id, terms) in the order of their tree. A term's weight is floor(1000 ln((2n + 2) / (2 df + 1)))."""
    vocabulary: dict[bytes, int] = {}
    for _, own in words:
        for t in own:
            vocabulary.setdefault(t, len(vocabulary))
    weights = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * df.get(t, 0) + 1))) for t in vocabulary], np.int64)
    rows = _lists([(c, weights[c]) for _, own in words for c in [np.unique([vocabulary[t] for t in own]).astype(np.int64)]])
    order = in_order(rows)
    return Items([words[i][0] for i in order], vocabulary, weights, grow(_lists([rows.row(i) for i in order]), ITEMS, 2))


class Posts:
    """The nodes of a level by the terms they hold, so that a bound adds up what the terms' lists say."""

    def __init__(self, rows: Lists):
        self.n = len(rows.at) - 1
        order = np.argsort(rows.cols, kind="stable")
        self.cols, self.vals = rows.cols[order], rows.vals[order]
        self.nodes = np.repeat(np.arange(self.n), np.diff(rows.at))[order]

    def sums(self, cols: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """For every node the sum over ``cols`` of weight times its value; whole numbers that a double holds exactly."""
        low, high = np.searchsorted(self.cols, cols), np.searchsorted(self.cols, cols, "right")
        sizes = high - low
        at = np.repeat(low - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        return np.bincount(self.nodes[at], self.vals[at] * np.repeat(weights, sizes), self.n).astype(np.int64)


class Search:
    """The best ``k`` documents of each item among a batch, given what scores are already known to be reached."""

    def __init__(self, items: Items, documents: Tree, k: int, reached: np.ndarray, tie: np.ndarray):
        self.items, self.documents, self.k, self.reached, self.tie = items, documents, k, reached.copy(), tie
        self.found: list[list[tuple[int, int, int]]] = [[] for _ in items.ids]  # (score, -tie, document)
        self.posts = [Posts(level) for level in documents.levels]
        self.looked = 0

    def weakest(self, level: int, node: int) -> int:
        """The least score that some item below the node still has to beat or meet."""
        tree = self.items.tree
        width = tree.leaf * tree.fan**level
        return int(self.reached[node * width : (node + 1) * width].min())

    def run(self) -> None:
        self._pairs(len(self.items.tree.levels) - 1, 0, len(self.documents.levels) - 1, np.zeros(1, np.int64))

    def _pairs(self, level: int, node: int, up: int, nodes: np.ndarray) -> None:
        """One node of the items against nodes of one level of the documents: what is left of these goes down in both
        trees as far as there are levels, and to the documents below two leaves."""
        bound = self.posts[up].sums(*self.items.tree.levels[level].row(node))[nodes]
        nodes = nodes[bound >= max(1, self.weakest(level, node))]
        if not len(nodes):
            return
        if up:
            down = (nodes[:, None] * self.documents.fan + np.arange(self.documents.fan)).ravel()
            nodes, up = down[down < self.posts[up - 1].n], up - 1
        elif not level:
            leaf = self.items.tree.leaf
            for item in range(node * leaf, min(len(self.items.ids), (node + 1) * leaf)):
                self._leaves(item, nodes)
            return
        fan = self.items.tree.fan
        children = range(fan * node, min(self._width(level - 1), fan * node + fan)) if level else [node]
        for child in children:
            self._pairs(max(0, level - 1), child, up, nodes)

    def _width(self, level: int) -> int:
        return len(self.items.tree.levels[level].at) - 1

    def _leaves(self, item: int, leaves: np.ndarray) -> None:
        """The item's scores of the documents in leaves that may hold one of its best."""
        cols, weights = self.items.tree.rows.row(item)
        bound = self.posts[0].sums(cols, weights)[leaves]
        weight = np.zeros(len(self.items.weights), np.int64)
        weight[cols] = weights
        rows, leaf = self.documents.rows, self.documents.leaf
        n = len(rows.at) - 1
        best = self.found[item]
        for at, most in sorted(zip(leaves.tolist(), bound.tolist(), strict=True), key=lambda x: -x[1]):
            if most < max(1, self.reached[item]):
                break
            low, high = at * leaf, min(n, (at + 1) * leaf)
            part = slice(rows.at[low], rows.at[high])
            each = weight[rows.cols[part]] * rows.vals[part]
            ends = np.concatenate([[0], np.cumsum(each)])
            scores = ends[rows.at[low + 1 : high + 1] - rows.at[low]] - ends[rows.at[low:high] - rows.at[low]]
            self.looked += high - low
            good = np.flatnonzero((scores > 0) & (scores >= self.reached[item]))
            if len(good):
                best += [(int(scores[i]), -int(self.tie[low + i]), low + int(i)) for i in good]
                best.sort(reverse=True)
                del best[self.k :]
                if len(best) == self.k:
                    self.reached[item] = max(self.reached[item], best[-1][0])


def counted(df: DataFrame, key: str, text: str, vocabulary: dict[bytes, int]) -> DataFrame:
    """(id, n, term, tf), one row for each row of ``df`` with a term: the number of its terms with repeats, and those of
    the vocabulary with their numbers; a stored table. Whole texts are read once, nothing is shuffled."""
    shared = df.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        known = shared.value.get
        for batch in batches:
            ids, ns, sizes, term, tf = [], [], [0], [], []
            for i, t in enumerate(_binary(batch.column(1))):
                words = terms(t)
                if words:
                    held = Counter(map(known, words))
                    held.pop(None, None)
                    ids.append(i)
                    ns.append(len(words))
                    term.extend(held.keys())
                    tf.extend(held.values())
                    sizes.append(len(term))
            offsets = pa.array(sizes, pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x, pa.int32())) for x in (term, tf)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ids, pa.int64())), pa.array(ns, pa.int64()), *lists], names=["id", "n", "term", "tf"])

    name = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("id"), F.col(text).cast("string").alias("t"))
    return stored(rows.mapInArrow(run, f"id {name}, n long, term array<int>, tf array<int>"), "counted")


def _batches(batches, most: int):
    """Record batches as tables of at most ``most`` rows."""
    held, n = [], 0
    for batch in batches:
        for low in range(0, batch.num_rows, most):
            part = batch.slice(low, most)
            if n + part.num_rows > most:
                yield pa.Table.from_batches(held)
                held, n = [], 0
            held.append(part)
            n += part.num_rows
    if n:
        yield pa.Table.from_batches(held)


def _documents(batch: pa.Table, total: int, length: int) -> tuple[Lists, pa.Array]:
    """The documents' values of their terms, and their ids, of those that have any."""
    batch = batch.combine_chunks()
    n = batch.column("n").to_numpy()
    if len(n) and int(n.max()) * 90 * total < 2**62:
        m = 10 + (90 * n * total) // length
    else:
        m = np.array([10 + (90 * int(x) * total) // length for x in n], np.int64)
    cols = batch.column("term").combine_chunks()
    sizes = np.diff(cols.offsets.to_numpy())
    tf = batch.column("tf").combine_chunks().flatten().to_numpy().astype(np.int64)
    each = np.repeat(m, sizes)
    vals = (1_000_000_000 * tf) // (1000 * tf + 8 * each)
    at = np.concatenate([[0], np.cumsum(sizes)])
    return Lists(at, cols.flatten().to_numpy().astype(np.int64), vals), batch.column("id").combine_chunks()


def _searched(docs: DataFrame, shared, k: int, total: int, length: int) -> DataFrame:
    """(item, id, score): of each batch of documents the best k of each item, by the items' places. ``shared``: the
    items and the scores that are known to be reached; a task's later batches know those of its earlier ones."""

    most, leaf, fan = BATCH, LEAF, FAN

    def run(batches):
        items, reached = shared.value
        for batch in _batches(batches, most):
            rows, ids = _documents(batch, total, length)
            order = in_order(rows)
            ids = ids.take(pa.array(order))
            tie = np.empty(len(ids), np.int64)
            tie[pc.array_sort_indices(ids).to_numpy()] = np.arange(len(ids))  # nulls last
            search = Search(items, grow(_lists([rows.row(i) for i in order]), leaf, fan), k, reached, tie)
            search.run()
            reached = search.reached
            found = [(item, score, at) for item, best in enumerate(search.found) for score, _, at in best]
            if found:
                item, score, at = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), ids.take(pa.array(at)), pa.array(score, pa.int64())], names=["item", "id", "score"])

    name = docs.schema["id"].dataType.simpleString()
    return docs.where(F.size("term") > 0).mapInArrow(run, f"item int, id {name}, score long")


def _top(found: DataFrame, k: int) -> DataFrame:
    """The best k rows of each item with their rank; ranked in parts first, so that an item's rows of all batches fill
    no task."""
    order = [F.desc("score"), F.asc_nulls_last("id")]
    part = found.withColumn("part", F.spark_partition_id() % _PARTS)
    some = part.withColumn("rank", F.row_number().over(Window.partitionBy("item", "part").orderBy(*order))).where(F.col("rank") <= k)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k).drop("part")


def _block(df: DataFrame, asked: dict, kind: str, k: int, key: str, text: str) -> DataFrame | None:
    """(item_, rank, id, score): the answers to the items of one block, {id: terms}, as a stored table."""
    spark = df.sparkSession
    vocabulary: dict[bytes, int] = {}
    for own in asked.values():
        for t in own:
            vocabulary.setdefault(t, len(vocabulary))
    docs = counted(df, key, text, vocabulary)
    total, length = docs.agg(F.count("*"), F.sum("n")).first()
    if not total:
        return None
    held = {r.t: r.n for r in docs.select(F.explode("term").alias("t")).groupBy("t").agg(F.count("*").alias("n")).collect()}
    items = items_tree(list(asked.items()), {t: held.get(i, 0) for t, i in vocabulary.items()}, total)
    low = np.zeros(len(items.ids), np.int64)
    sent = spark.sparkContext.broadcast((items, low))
    # What the documents of one share in FIRST reach is reached by all: a lower bound, whichever they are.
    some = _top(_searched(docs.where(F.pmod(F.xxhash64("id", "n"), F.lit(FIRST)) == 0), sent, k, total, length), k)
    for r in some.where(F.col("rank") == k).select("item", "score").collect():
        low[r.item] = r.score
    sent.unpersist()
    sent = spark.sparkContext.broadcast((items, low))
    names = spark.createDataFrame(list(enumerate(items.ids)), f"item int, item_ {kind}")
    out = stored(_top(_searched(docs, sent, k, total, length), k).join(F.broadcast(names), "item").select("item_", "rank", "id", "score"), "found")
    sent.unpersist()
    forget(docs)
    return out


def search(df: DataFrame, items: DataFrame, k: int = 10, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item, rank, key, score): for each item the ``k`` documents of ``df`` with the highest score above 0 (all, if
    fewer), equal scores by rising key, nulls last; ``rank`` from 1.

    With N documents that have a term, L terms of all, n of a document, tf of a term in it and df documents with the
    term: w = floor(1000 ln((2N + 2) / (2 df + 1))), m = 10 + (90 n N) div L, and a score is the sum over the item's
    terms, once each, of w * ((10^9 tf) div (1000 tf + 8 m)). Null and empty texts have no term, and items without one
    no answer; rows of one item key are one item, a null key is a key; rows that repeat a document's key are documents
    of their own. Items are searched in blocks of about ``BLOCK``; documents are read once for each block."""
    asked = items.select(F.col(item).alias("item"), F.col(item_text).cast("string").alias("t")).where("t is not null")
    kind, parts = items.schema[item].dataType.simpleString(), max(1, -(-asked.count() // BLOCK))
    out = None
    for i in range(parts):
        words: dict = {}
        for r in asked.where(F.pmod(F.xxhash64("item"), F.lit(parts)) == i).toLocalIterator():
            if own := terms(r.t.encode("utf-8")):
                words.setdefault(r.item, []).extend(own)
        found = _block(df, words, kind, k, key, text) if words else None
        if found is not None:
            out = found if out is None else out.unionByName(found)
    if out is None:
        out = df.sparkSession.createDataFrame([], f"item_ {kind}, rank int, id {df.schema[key].dataType.simpleString()}, score long")
    return out.select(F.col("item_").alias(item), "rank", F.col("id").alias(key), "score")
