"""Train and validation splits: random, and by classes of similar sequences."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence
from hashlib import md5
from itertools import repeat
from math import ceil
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixbench.operators.durable import stored

SIMILAR, SEED, SHARE = 0.8, 42, 0.2
#: Sequences of one comparison's side; those of an assay that have to be compared are dealt into parts of this size.
PART = 256
#: How far from a leader a sequence may be to be judged by it, as a share of the longer one's length; sequences that
#: change folds in a round, as a share of the assay's.
RADIUS, SWAPS = 0.25, 0.05
#: Sequences of a group on which its leader is chosen, and those of them that may lead it.
SAMPLE, CANDIDATES = 64, 7
#: Leaders of a group at most; sequences of a group that one task judges by itself, larger groups spread over many.
LEADERS, SMALL = 3, 1024


def random_split(df: DataFrame, keys: Sequence[str], group: str = "dms_id", share: float = SHARE, seed: int = SEED) -> DataFrame:
    """``df`` with ``fold``: of each group, ceil(share * n) rows are ``val``, those of the smallest md5 of seed and
    keys (repeats in any order among themselves); the rest ``train``. Null keys count as the empty text."""
    name = F.concat_ws("|", F.lit(str(seed)), *(F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys))
    order = F.row_number().over(Window.partitionBy(group).orderBy(F.md5(name.cast("binary"))))
    n = F.count(F.lit(1)).over(Window.partitionBy(group))
    return df.withColumn("fold", F.when(order <= F.ceil(F.lit(share) * n), "val").otherwise("train"))


def common_lengths(a: Sequence[str], b: Sequence[str], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Lengths of the longest common subsequences of the pairs a[i], b[j], by bit vectors of the first: all pairs at
    once where it has at most 63 letters."""
    out = np.zeros(len(i), np.int64)
    sizes = np.array([len(x) for x in a])
    for n in np.flatnonzero(sizes[i] > 63):
        x, v, masks = a[i[n]], -1, {}
        for p, c in enumerate(x):
            masks[c] = masks.get(c, 0) | 1 << p
        for c in b[j[n]]:
            u = v & masks.get(c, 0)
            v = (v + u) | (v - u)
        out[n] = (~v & ((1 << len(x)) - 1)).bit_count()
    at = np.flatnonzero(sizes[i] <= 63)
    if len(at):
        short = [x if len(x) <= 63 else "" for x in a]
        letters, codes = np.unique(_codes(short), return_inverse=True)
        codes = codes.reshape(len(a), -1)
        # The last row is for letters that the first sequence lacks, and for what lies behind a shorter second one.
        masks = np.zeros((len(letters) + 1, len(a)), np.uint64)
        for p in range(codes.shape[1]):
            there = np.flatnonzero((sizes > p) & (sizes <= 63))
            masks[codes[there, p], there] |= np.uint64(1 << p)
        first, second = i[at], j[at]
        other = _codes(b)
        place = np.minimum(np.searchsorted(letters, other), len(letters) - 1)
        known = (letters[place] == other) & (np.arange(other.shape[1]) < np.array([len(x) for x in b])[:, None])
        v = np.full(len(at), ~np.uint64(0), np.uint64)
        for row in np.where(known, place, len(letters)).T:
            u = v & masks[row[second], first]
            v = (v + u) | (v - u)
        out[at] = np.bitwise_count(~v & ((np.uint64(1) << sizes[first].astype(np.uint64)) - np.uint64(1)))
    return out


def _codes(words: Sequence[str]) -> np.ndarray:
    """A row of code points for each word, filled up with zeros."""
    return np.array(words, dtype=f"U{max(1, max(map(len, words)))}").view(np.uint32).reshape(len(words), -1)


def _between(s: pd.Series, lead: pd.Series) -> pd.Series:
    a, b = s.tolist(), lead.tolist()
    at = np.arange(len(a))
    return pd.Series(common_lengths(a, b, at, at) if a else [], dtype="int64")


def _common(a: str, b: str) -> Column:
    """The length of the longest common subsequence of two columns."""
    return F.pandas_udf(_between, "long")(a, b)


def _texts(df: DataFrame, group: str, sequence: str) -> DataFrame:
    return df.where(F.col(sequence).isNotNull() & (F.length(sequence) > 0)).select(F.col(group).alias("dms_id"), F.col(sequence).alias("s")).distinct()


def _consensus(words: Sequence[str]) -> str:
    """Letter by letter what most words have there, up to the commonest length; of several the last."""
    most = lambda xs: max(Counter(xs).items(), key=lambda x: x[::-1])[0]
    size = most(map(len, words))
    return "".join(most(x[p] for x in words if len(x) > p) for p in range(size))


def _led(drawn: pd.Series) -> pd.Series:
    """Of each sample the candidate that is nearest to it on the whole, where far sequences count alike: candidates are
    its consensus and the first of its sequences."""
    groups = [list(x) for x in drawn]
    leads = [sorted({_consensus(x), *x[:CANDIDATES]}) for x in groups]
    a, b = [s for x in groups for s in x], [s for x in leads for s in x]
    sizes, width = np.array([len(x) for x in groups]), np.array([len(x) for x in leads])
    i = np.concatenate([np.tile(np.arange(n), w) + o for n, w, o in zip(sizes, width, np.cumsum(sizes) - sizes, strict=True)])
    j = np.concatenate([np.repeat(np.arange(w), n) + o for n, w, o in zip(sizes, width, np.cumsum(width) - width, strict=True)])
    la, lb = np.array([len(x) for x in a])[i], np.array([len(x) for x in b])[j]
    cost = np.bincount(j, np.minimum(la + lb - 2 * common_lengths(a, b, i, j), RADIUS * np.maximum(la, lb)), len(b))
    ends = np.cumsum(width)
    return pd.Series([b[e - w + int(np.argmin(cost[e - w : e]))] for e, w in zip(ends, width, strict=True)], dtype=object)


def _leaders(rows: DataFrame) -> DataFrame:
    """(dms_id, lead): the leader of each group, chosen on a sample of at most ``SAMPLE`` of its sequences, drawn by
    hash. The choice says how much the index decides, not what."""
    salt = F.pmod(F.xxhash64(F.lit(1), "s"), F.lit(SAMPLE))
    drawn = rows.groupBy("dms_id", salt.alias("salt")).agg(F.min(F.struct(F.xxhash64(F.lit(2), "s").alias("h"), "s")).alias("x"))
    some = drawn.groupBy("dms_id").agg(F.sort_array(F.collect_list("x")).alias("x"))
    return some.select("dms_id", F.pandas_udf(_led, "string")(F.col("x.s")).alias("lead"))


class Index(NamedTuple):
    """Which sequences of a group can be similar, by their distances from few leaders.

    ``rows``: (dms_id, s, k, len, d, sig): the number k of the sequence's leader, its length, its distance from the
    leader (letters in one but not in the other's longest common subsequence: a metric) and these as its signature. A
    sequence far from all leaders has k = -1 and is judged by its length alone. ``pairs``: of two signatures (k, len,
    d), a and b, whether all their sequences are similar (``sure``); pairs of which none can be are not listed.
    ``sizes``: (dms_id, sig, n, rep) of each signature. ``apart``: (dms_id, k, apart), a leader's distances from all
    leaders. ``open``: whether any pair is undecided."""

    rows: DataFrame
    sizes: DataFrame
    pairs: DataFrame
    apart: DataFrame
    open: bool


def similarity_index(df: DataFrame, group: str = "dms_id", sequence: str = "sequence", rounds: int = LEADERS) -> Index:
    """In each round one of a few candidates becomes the leader of the sequences that are near it, see ``_leaders``.

    Let p and q lead a and b. By the triangle inequality d(a, b) lies between d(p, q) - d(a, p) - d(b, q) (or what is
    left of one of these after the others) and d(p, q) + d(a, p) + d(b, q), and the common length is half of what the
    lengths add up to less d. Where that decides, it decides for all sequences of the two signatures at once; nothing
    similar is ever left out, and only undecided pairs are compared letter by letter."""
    rows = left = stored(_texts(df, group, sequence), "texts")
    found, leaders = None, None
    for k in range(rounds):
        lead = stored(_leaders(left).withColumn("k", F.lit(k)), "lead")
        far_from = F.length("s") + F.length("lead") - 2 * _common("s", "lead")
        seen = stored(left.join(lead, "dms_id").select("dms_id", "s", F.length("s").alias("len"), F.length("lead").alias("lead_len"), far_from.cast("int").alias("d")), "seen")
        radius = RADIUS * F.greatest("len", "lead_len")
        near = F.col("d") <= radius
        mine = seen.where(near).select("dms_id", "s", F.lit(k).alias("k"), "len", "d")
        found = mine if found is None else found.unionByName(mine)
        leaders = lead if leaders is None else leaders.unionByName(lead)
        left = seen.where(~near).select("dms_id", "s")
        if left.isEmpty():
            break
    else:
        found = found.unionByName(left.select("dms_id", "s", F.lit(-1).alias("k"), F.length("s").alias("len"), F.lit(0).alias("d")))
    p, q = leaders.select("dms_id", "k", F.col("lead").alias("s")), leaders.select("dms_id", F.col("k").alias("other"), "lead")
    gaps = p.join(q, "dms_id").withColumn("gap", (F.length("s") + F.length("lead") - 2 * _common("s", "lead")).cast("int"))
    apart = gaps.groupBy("dms_id", "k").agg(F.transform(F.sort_array(F.collect_list(F.struct("other", "gap"))), lambda x: x["gap"]).alias("apart"))
    apart = stored(apart, "apart")
    rows = found.withColumn("sig", F.struct("k", "len", "d"))
    sizes = rows.groupBy("dms_id", "sig").agg(F.count("*").alias("n"), F.min("s").alias("rep"))
    sizes = stored(sizes.withColumn("k", F.col("sig.k")).join(apart, ["dms_id", "k"], "left").drop("k"), "sizes")
    a, b = sizes.select("dms_id", F.col("sig").alias("a"), F.col("n").alias("n_a"), F.col("apart")), sizes.select("dms_id", F.col("sig").alias("b"), F.col("n").alias("n_b"))
    both = a.join(b, "dms_id").where((F.col("a") < F.col("b")) | ((F.col("a") == F.col("b")) & (F.col("n_a") > 1)))
    known = (F.col("a.k") >= 0) & (F.col("b.k") >= 0)
    gap, da, db = F.get("apart", F.col("b.k")), F.col("a.d"), F.col("b.d")
    total, longer = F.col("a.len") + F.col("b.len"), F.greatest("a.len", "b.len")
    least = F.when(known, (total - (gap + da + db)) / 2).otherwise(0)
    most = F.least(F.least("a.len", "b.len"), F.when(known, (total - F.greatest(gap - da - db, da - gap - db, db - gap - da, F.lit(0))) / 2))
    pairs = both.withColumn("sure", least > F.lit(SIMILAR) * longer).where(F.col("sure") | (most > F.lit(SIMILAR) * longer))
    pairs = stored(pairs.select("dms_id", "a", "b", "n_a", "n_b", "sure"), "pairs")
    return Index(rows, sizes.drop("apart"), pairs, apart, not pairs.where(~F.col("sure")).isEmpty())


def compared_pairs(index: Index) -> DataFrame:
    """(dms_id, n_pairs, n_compared): pairs of distinct sequences, and those that are compared letter by letter."""
    each = F.when(F.col("a") == F.col("b"), F.col("n_a") * (F.col("n_a") - 1) / 2).otherwise(F.col("n_a") * F.col("n_b")).cast("long")
    some = index.pairs.where(~F.col("sure")).groupBy("dms_id").agg(F.sum(each).alias("n_compared"))
    every = index.rows.groupBy("dms_id").agg((F.count("*") * (F.count("*") - 1) / 2).cast("long").alias("n_pairs"))
    return every.join(some, "dms_id", "left").fillna(0, ["n_compared"])


def _undecided(left: pd.DataFrame, right: pd.DataFrame) -> np.ndarray:
    """The pairs of rows that their signatures leave open, as a matrix; the same bounds as the index's."""
    la, lb = left.len.to_numpy()[:, None], right.len.to_numpy()[None, :]
    longer, total = np.maximum(la, lb), la + lb
    known = (left.k.to_numpy()[:, None] >= 0) & (right.k.to_numpy()[None, :] >= 0)
    width = max((len(x) for x in left.apart if x is not None), default=1)
    gaps = np.array([list(x) + [0] * (width - len(x)) if x is not None else [0] * width for x in left.apart])
    gap = gaps[:, np.maximum(right.k.to_numpy(), 0) % width]
    da, db = left.d.to_numpy()[:, None], right.d.to_numpy()[None, :]
    least = np.where(known, (total - (gap + da + db)) / 2, 0)
    most = np.minimum(np.minimum(la, lb), np.where(known, (total - np.maximum.reduce([gap - da - db, da - gap - db, db - gap - da, np.zeros_like(gap)])) / 2, np.inf))
    return (least <= SIMILAR * longer) & (most > SIMILAR * longer)


def _lowest(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The smallest number reachable from each of n over links x[i], y[i]."""
    low = np.arange(n)
    while True:
        least = np.minimum(low[x], low[y])
        new = low.copy()
        np.minimum.at(new, x, least)
        np.minimum.at(new, y, least)
        new = new[new]
        if np.array_equal(new, low):
            return low
        low = new


def _alike(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether the pairs a[i], b[j] are similar; letters in common bound what the subsequences can have."""
    letters = sorted(set("".join(a)) | set("".join(b)))
    ca, cb = (np.array([[x.count(c) for c in letters] for x in side]).reshape(len(side), len(letters)) for side in (a, b))
    longer = np.maximum(ca.sum(axis=1)[i], cb.sum(axis=1)[j])
    may = np.flatnonzero(np.minimum(ca[i], cb[j]).sum(axis=1) > SIMILAR * longer)
    out = np.zeros(len(i), bool)
    if len(may):
        out[may] = common_lengths(a, b, i[may], j[may]) > SIMILAR * longer[may]
    return out


def _compare(pdf: pd.DataFrame) -> pd.DataFrame:
    """Links between two parts among undecided pairs: rows (s, other, n); without ``other``, n adds up the weights of
    the sequence's partners, the others span the links' components."""
    left, right = pdf[pdf.side != 1], pdf[pdf.side != 0]
    same = bool((pdf.side == 2).any())
    a, b = left.s.to_numpy(), right.s.to_numpy()
    ok = _undecided(left, right)
    if same:
        ok &= np.triu(np.ones_like(ok), 1)
    i, j = np.nonzero(ok)
    good = _alike(a, b, i, j)
    i, j = i[good], j[good]
    counts = np.concatenate([np.bincount(i, right.w.to_numpy()[j], len(a)), np.bincount(j, left.w.to_numpy()[i], len(b))])
    names, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    number = np.zeros(len(names))
    np.add.at(number, place, counts)
    rows = pd.DataFrame({"s": names[number > 0], "other": None, "n": number[number > 0]})
    low = _lowest(len(names), place[i], place[len(a) + j])
    moved = low != np.arange(len(names))
    links = pd.DataFrame({"s": names[moved], "other": names[low[moved]], "n": 0})
    out = pd.concat([rows, links], ignore_index=True).astype({"n": "int64"})
    out.insert(0, "dms_id", pdf.dms_id.iloc[0])
    return out


def _partners(index: Index) -> DataFrame:
    """(dms_id, a, b): sure pairs of signatures, either way."""
    sure = index.pairs.where("sure")
    return sure.select("dms_id", "a", "b").unionByName(sure.where("a <> b").select("dms_id", F.col("b").alias("a"), F.col("a").alias("b")))


def _sure_links(index: Index, weights: DataFrame) -> DataFrame:
    """(dms_id, sig, total, own): what the partners of a signature's sequences weigh by ``weights`` (dms_id, sig, w),
    and whether the sequence itself is among them."""
    partners = _partners(index).join(weights.withColumnRenamed("sig", "b"), ["dms_id", "b"], "left")
    return partners.groupBy("dms_id", F.col("a").alias("sig")).agg(F.coalesce(F.sum("w"), F.lit(0)).alias("total"), F.max(F.col("a") == F.col("b")).alias("own"))


def _open_links(index: Index, rows: DataFrame) -> DataFrame:
    """The links of undecided pairs, see ``indexed_links``; ``rows`` are the index's with their weights w.

    Sequences that have an undecided pair are put in the order of their signatures and dealt into parts of about 256;
    only parts with an undecided pair between them are compared, each pair of parts by itself, so that a large group
    spreads over many tasks."""
    open_ = index.pairs.where(~F.col("sure"))
    met = open_.select("dms_id", F.explode(F.array("a", "b")).alias("sig")).distinct()
    order = F.row_number().over(Window.partitionBy("dms_id").orderBy("sig", "s")) - 1
    dealt = rows.join(met, ["dms_id", "sig"], "left_semi").withColumn("part", F.floor(order / PART).cast("int"))
    dealt = stored(dealt.join(index.apart, ["dms_id", "k"], "left"), "dealt")
    held = dealt.select("dms_id", "sig", "part").distinct()
    x = held.select("dms_id", F.col("sig").alias("a"), F.col("part").alias("pa"))
    y = held.select("dms_id", F.col("sig").alias("b"), F.col("part").alias("pb"))
    jobs = open_.join(x, ["dms_id", "a"]).join(y, ["dms_id", "b"]).select("dms_id", F.least("pa", "pb").alias("x"), F.greatest("pa", "pb").alias("y")).distinct()
    side = F.when(F.col("x") == F.col("y"), 2).when(F.col("part") == F.col("x"), 0).otherwise(1)
    ends = jobs.withColumn("part", F.explode(F.array_distinct(F.array("x", "y")))).withColumn("side", side)
    found = dealt.join(ends, ["dms_id", "part"]).select("dms_id", "x", "y", "s", "k", "len", "d", "apart", "w", "side")
    return found.groupBy("dms_id", "x", "y").applyInPandas(_compare, "dms_id string, s string, other string, n long")


def indexed_links(index: Index, marked: DataFrame | None = None) -> DataFrame:
    """(dms_id, s, other, n): rows without ``other`` add up to the number of links of a sequence (with ``marked``
    (dms_id, s), of links to these), the others span the links' components. Sure pairs of signatures are counted and
    joined signature by signature, undecided ones are compared."""
    rows = index.rows
    rows = rows.withColumn("w", F.lit(1)) if marked is None else rows.join(marked.select("dms_id", "s", F.lit(1).alias("w")), ["dms_id", "s"], "left").fillna(0, ["w"])
    known = _sure_links(index, rows.groupBy("dms_id", "sig").agg(F.sum("w").alias("w")))
    counts = rows.join(known, ["dms_id", "sig"]).select("dms_id", "s", F.lit(None).cast("string").alias("other"), (F.col("total") - F.when(F.col("own"), F.col("w")).otherwise(0)).alias("n"))
    rep = index.sizes.select("dms_id", F.col("sig").alias("b"), F.col("rep").alias("other"))
    near = _partners(index).join(rep, ["dms_id", "b"]).groupBy("dms_id", F.col("a").alias("sig")).agg(F.min("other").alias("near"))
    star = rows.join(near, ["dms_id", "sig"]).select("dms_id", "s", F.col("near").alias("other"), F.lit(0).cast("long").alias("n"))
    links = counts.unionByName(star.unionByName(_between_signatures(index)).where("s <> other"))
    return links.unionByName(_open_links(index, rows)) if index.open else links


def _between_signatures(index: Index) -> DataFrame:
    """(dms_id, s, other, n): the smallest sequences of signatures that are similar for sure."""
    a, b = (index.sizes.select("dms_id", F.col("sig").alias(x), F.col("rep").alias(name)) for x, name in (("a", "s"), ("b", "other")))
    return index.pairs.where("sure and a <> b").join(a, ["dms_id", "a"]).join(b, ["dms_id", "b"]).select("dms_id", "s", "other", F.lit(0).cast("long").alias("n"))


def similarity_links(df: DataFrame, group: str = "dms_id", sequence: str = "sequence") -> DataFrame:
    """(dms_id, s, other, n): between the distinct sequences of a group whose longest common subsequence exceeds 0.8
    of the longer one's length; rows without ``other`` count links, the others span the links' components."""
    return indexed_links(similarity_index(df, group, sequence))


def classes(links: DataFrame) -> DataFrame:
    """(dms_id, s, class): the smallest sequence reachable over links, for sequences that have one. Labels spread
    along the links and jump to their labels' labels until nothing changes; each round is stored."""
    edges = links.where("other is not null").select("dms_id", "s", "other")
    both = edges.unionAll(edges.select("dms_id", F.col("other").alias("s"), F.col("s").alias("other"))).distinct()
    both = stored(both, "both")
    now = both.groupBy("dms_id", "s").agg(F.least(F.col("s"), F.min("other")).alias("class"))
    while True:
        seen = both.join(now.select("dms_id", F.col("s").alias("other"), "class"), ["dms_id", "other"]).groupBy("dms_id", "s").agg(F.min("class").alias("low"))
        spread = now.join(seen, ["dms_id", "s"]).select("dms_id", "s", F.least("class", "low").alias("class"), F.col("class").alias("was"))
        jump = spread.select("dms_id", F.col("s").alias("class"), F.col("class").alias("far"))
        new = stored(spread.join(jump, ["dms_id", "class"], "left").select("dms_id", "s", F.coalesce("far", "class").alias("class"), "was"), "labels")
        now = new.drop("was")
        if new.where("class <> was").isEmpty():
            return now


def _classed(index: Index) -> DataFrame:
    """(dms_id, sequence, class, n_links, sig). All sequences of a signature with a sure link are in one class, that of
    the signature's smallest sequence, so that classes are found among these and the sequences without such a link."""
    known = stored(_sure_links(index, index.sizes.select("dms_id", "sig", F.col("n").alias("w"))), "known")
    nodes = known.join(index.sizes.select("dms_id", "sig", "rep"), ["dms_id", "sig"])
    links, counts = _between_signatures(index).select("dms_id", "s", "other"), None
    if index.open:
        found = stored(_open_links(index, index.rows.withColumn("w", F.lit(1))), "found")
        counts = found.where("other is null").groupBy("dms_id", "s").agg(F.sum("n").alias("more"))
        names = index.rows.join(nodes.select("dms_id", "sig", "rep"), ["dms_id", "sig"]).select("dms_id", "s", "rep")
        ends = found.where("other is not null").select("dms_id", "s", "other").join(names, ["dms_id", "s"], "left").select("dms_id", F.coalesce("rep", "s").alias("s"), "other")
        ends = ends.join(names.withColumnRenamed("s", "other"), ["dms_id", "other"], "left").select("dms_id", "s", F.coalesce("rep", "other").alias("other"))
        links = links.unionByName(ends.where("s <> other"))
    label = stored(classes(links), "label")
    nodes = nodes.join(label.withColumnRenamed("s", "rep"), ["dms_id", "rep"], "left").select("dms_id", "sig", "total", "own", F.coalesce("class", "rep").alias("class"))
    rows = index.rows.select("dms_id", "s", "sig").join(nodes, ["dms_id", "sig"], "left")
    n = F.coalesce(F.col("total") - F.col("own").cast("int"), F.lit(0))
    if not index.open:
        return rows.select("dms_id", F.col("s").alias("sequence"), F.coalesce("class", "s").alias("class"), n.alias("n_links"), "sig")
    alone = rows.withColumnRenamed("class", "_class").join(label, ["dms_id", "s"], "left").join(counts, ["dms_id", "s"], "left")
    return alone.select("dms_id", F.col("s").alias("sequence"), F.coalesce("_class", "class", "s").alias("class"), (n + F.coalesce("more", F.lit(0))).alias("n_links"), "sig")


class _Group:
    """A small group's sequences by their places in order: its index, links and classes, found as ``similarity_index``
    finds a large one's, with the distances from all leaders at hand."""

    def __init__(self, words: list[str]):
        self.words = sorted(words)
        n, self.links = len(words), np.zeros((2, 0), np.int64)
        size, far, left = np.array([len(x) for x in self.words]), [], np.arange(n)
        for _ in range(LEADERS):
            drawn = [self.words[left[i * len(left) // min(SAMPLE, len(left))]] for i in range(min(SAMPLE, len(left)))]
            lead = _led(pd.Series([drawn])).tolist()
            far.append(size + len(lead[0]) - 2 * common_lengths(self.words, lead, np.arange(n), np.zeros(n, np.int64)))
            left = left[far[-1][left] > RADIUS * np.maximum(size[left], len(lead[0]))]
            if not len(left):
                break
        found, self.sig = np.unique(np.stack([size, *far]), axis=1, return_inverse=True)
        length, far = found[0], found[1:, :, None]
        total, longer = length[:, None] + length, np.maximum.outer(length, length)
        least = (total - (far + far.swapaxes(1, 2)).min(axis=0)) / 2
        most = np.minimum(np.minimum.outer(length, length), (total - np.abs(far - far.swapaxes(1, 2)).max(axis=0)) / 2)
        self.sure = least > SIMILAR * longer
        undecided = ~self.sure & (most > SIMILAR * longer)
        if undecided.any():
            i, j = np.nonzero(np.triu(undecided[self.sig][:, self.sig], 1))
            good = _alike(self.words, self.words, i, j)
            self.links = np.stack([i[good], j[good]])
        self.n_links = self.to(np.ones(n, bool))
        first = np.unique(self.sig, return_index=True)[1]
        joined = np.flatnonzero(self.sure.any(axis=1)[self.sig])
        a, b = np.nonzero(self.sure)
        # all of a signature that is similar to any are in one class
        a, b = np.concatenate([first[a], joined, self.links[0]]), np.concatenate([first[b], first[self.sig[joined]], self.links[1]])
        self.label = _lowest(n, a, b)

    def to(self, marked: np.ndarray) -> np.ndarray:
        """Each sequence's links to the marked ones."""
        i, j = self.links
        known = self.sure @ np.bincount(self.sig, marked, len(self.sure)).astype(np.int64)
        more = np.bincount(i, marked[j], len(marked)) + np.bincount(j, marked[i], len(marked))
        return known[self.sig] - (marked & self.sure[self.sig, self.sig]) + more.astype(np.int64)

    def split(self, name: str, share: float, seed: int, rounds: int) -> tuple[np.ndarray, np.ndarray]:
        """Whether each sequence is ``val`` and its links across, as ``_filled``, ``_across`` and ``_swapped`` have it."""
        n = len(self.words)
        place = np.array([md5(f"{seed}|{name}|{s}".encode()).hexdigest() for s in self.words])
        h = np.empty(n, np.int64)
        h[np.argsort(place)] = np.arange(n)
        tops, sizes = np.unique(self.label, return_counts=True)
        order, need = np.lexsort((tops, h[tops], sizes)), ceil(share * n)
        filled = np.cumsum(sizes[order])
        val = np.isin(self.label, tops[order[filled <= need]])
        rest = np.flatnonzero(~val)
        val[rest[np.lexsort((h[rest], self.n_links[rest]))[: need - int(val.sum())]]] = True
        across = self._across(val)
        for _ in range(rounds):
            gain = 2 * across - self.n_links
            ranked = np.lexsort((h, -gain))
            inner, outer = ranked[val[ranked]], ranked[~val[ranked]]
            width = min(len(inner), len(outer), ceil(SWAPS * n))
            moves = gain[inner[:width]] + gain[outer[:width]] > 2
            new = val.copy()
            new[inner[:width][moves]], new[outer[:width][moves]] = False, True
            then = self._across(new)
            if then[new].sum() >= across[val].sum():
                break
            val, across = new, then
        return val, across

    def _across(self, val: np.ndarray) -> np.ndarray:
        to_val = self.to(val)
        return np.where(val, self.n_links - to_val, to_val)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[str], bool]]:
    """The groups of rows (dms_id, s) that come group by group: name, sequences, whether these are all; one of more
    than ``SMALL`` comes in pieces."""
    name, words, whole = None, [], True
    for batch in batches:
        for g, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if g != name:
                if words:
                    yield name, words, whole
                name, words, whole = g, [], True
            words.append(s)
            if len(words) > SMALL:
                yield name, words, False
                words, whole = [], False
    if words:
        yield name, words, whole


def _small(df: DataFrame, group: str, sequence: str, split: tuple[float, int, int] | None = None) -> DataFrame:
    """(dms_id, s, class, n_links[, val, across]): groups of at most ``SMALL`` distinct sequences, each judged within
    one task, so that a sequence is shuffled once and stored once; ``split``: share, seed and rounds of the folds. The
    sequences of larger groups come as they are, with null for the rest."""
    names = ["dms_id", "s", "class", "n_links"] + ["val", "across"] * bool(split)
    kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.bool_(), pa.int64()][: len(names)]

    def judged(name: str, words: list[str]) -> list[Sequence]:
        found = _Group(words)
        rows = [repeat(name, len(words)), found.words, map(found.words.__getitem__, found.label.tolist()), found.n_links.tolist()]
        return rows + [x.tolist() for x in found.split(name, *split)] if split else rows

    def run(batches):
        held: list[list] = [[] for _ in names]
        for name, words, whole in _groups(batches):
            rows = judged(name, words) if whole else [repeat(name, len(words)), words, *[repeat(None, len(words))] * (len(names) - 2)]
            for column, more in zip(held, rows, strict=True):
                column.extend(more)
            if len(held[0]) >= 8 * SMALL:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(held, kinds, strict=True)], names)
                held = [[] for _ in names]
        if held[0]:
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(held, kinds, strict=True)], names)

    texts = _texts(df.where(F.col(group).isNotNull()), group, sequence).select(F.col("dms_id").cast("string"), "s")
    kind = "dms_id string, s string, class string, n_links long" + ", val boolean, across long" * bool(split)
    return stored(texts.repartition("dms_id").sortWithinPartitions("dms_id").mapInArrow(run, kind), "similar")


def similarity_classes(df: DataFrame, group: str = "dms_id", sequence: str = "sequence") -> DataFrame:
    """(dms_id, sequence, class, n_links) of each distinct sequence of each group."""
    found = _small(df, group, sequence)
    rest = found.where("class is null")
    done = found.where("class is not null").withColumnRenamed("s", "sequence")
    return done if rest.isEmpty() else done.unionByName(_classed(similarity_index(rest, "dms_id", "s")).drop("sig"))


def _place(seed: int, *columns: str) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *columns).cast("binary"))


def _filled(similar: DataFrame, share: float, seed: int) -> DataFrame:
    """(dms_id, s, sig, h, n_links, total, val): whole classes go to ``val``, the smallest first, as long as they fit; what
    is then left of the share is filled with the sequences of the others that have the fewest links."""
    sizes = similar.groupBy("dms_id", "class").agg(F.count("*").alias("n"))
    whole = Window.partitionBy("dms_id")
    order = whole.orderBy("n", _place(seed, "dms_id", "class"), "class").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    need = F.ceil(F.lit(share) * F.sum("n").over(whole))
    fits = sizes.select("dms_id", "class", F.sum("n").over(whole).alias("total"), need.alias("need"), F.sum("n").over(order).alias("filled"))
    fits = fits.withColumn("base", F.max(F.when(F.col("filled") <= F.col("need"), F.col("filled")).otherwise(0)).over(whole))
    rows = similar.join(fits, ["dms_id", "class"]).withColumn("in", F.col("filled") <= F.col("need")).withColumn("h", _place(seed, "dms_id", "sequence"))
    at = F.row_number().over(Window.partitionBy("dms_id", "in").orderBy("n_links", "h"))
    val = F.col("in") | (at <= F.col("need") - F.col("base"))
    return rows.select("dms_id", F.col("sequence").alias("s"), "sig", "class", "h", "n_links", "total", val.alias("val"))


def _across(index: Index, folds: DataFrame) -> DataFrame:
    """``folds`` with ``to_val``, the sequence's links to val, ``across``, those to the other fold, ``gain``, how many
    fewer would lie across if it changed its fold, and ``cut``, the group's links across."""
    known = _sure_links(index, folds.groupBy("dms_id", "sig").agg(F.sum(F.col("val").cast("int")).alias("w")))
    mine = F.when(F.col("own") & F.col("val"), 1).otherwise(0)
    rows = folds.join(known.withColumnRenamed("total", "sure"), ["dms_id", "sig"], "left").withColumn("to_val", F.coalesce(F.col("sure") - mine, F.lit(0))).drop("sure", "own")
    if index.open:
        weighed = index.rows.join(folds.select("dms_id", "s", F.col("val").cast("int").alias("w")), ["dms_id", "s"])
        more = _open_links(index, weighed).where("other is null").groupBy("dms_id", "s").agg(F.sum("n").alias("more"))
        rows = rows.join(more, ["dms_id", "s"], "left").withColumn("to_val", F.col("to_val") + F.coalesce("more", F.lit(0))).drop("more")
    across = F.when(F.col("val"), F.col("n_links") - F.col("to_val")).otherwise(F.col("to_val"))
    rows = rows.withColumn("across", across).withColumn("gain", 2 * F.col("across") - F.col("n_links"))
    return stored(rows.withColumn("cut", F.sum(F.when(F.col("val"), F.col("across")).otherwise(0)).over(Window.partitionBy("dms_id"))), "across")


def _swapped(rows: DataFrame) -> DataFrame:
    """The folds after the sequences of either fold that gain most have changed places, pair by pair: at most one in
    twenty of the group, and only where both together gain more than the link that they may have."""
    at = F.row_number().over(Window.partitionBy("dms_id", "val").orderBy(F.desc("gain"), "h"))
    ranked = rows.withColumn("at", at)
    pair = F.sum("gain").over(Window.partitionBy("dms_id", "at")), F.count("*").over(Window.partitionBy("dms_id", "at"))
    moves = (pair[0] > 2) & (pair[1] == 2) & (F.col("at") <= F.ceil(F.lit(SWAPS) * F.col("total")))
    return ranked.select("dms_id", "s", "sig", "class", "h", "n_links", "total", F.when(moves, ~F.col("val")).otherwise(F.col("val")).alias("val"))


def similarity_split(df: DataFrame, group: str = "dms_id", sequence: str = "sequence", share: float = SHARE, seed: int = SEED, rounds: int = 2) -> DataFrame:
    """(dms_id, sequence, class, fold, n_links, n_across): of each group, ceil(share * n) distinct sequences are
    ``val``, with few links between the folds; ``n_across`` are those of a sequence that are left.

    Classes of similar sequences are kept whole where that fits; a library whose variants are all similar to each
    other has one class, which is cut. In each of ``rounds`` rounds sequences of both folds change places, and a group
    keeps the new folds if fewer links lie across."""
    found = _small(df, group, sequence, (share, seed, rounds))
    rest = found.where("class is null")
    now = found.where("class is not null")
    if not rest.isEmpty():
        now = now.unionByName(_split(similarity_index(rest, "dms_id", "s"), share, seed, rounds).select(*now.columns))
    return now.select("dms_id", F.col("s").alias("sequence"), "class", F.when(F.col("val"), "val").otherwise("train").alias("fold"), "n_links", F.col("across").alias("n_across"))


def _split(index: Index, share: float, seed: int, rounds: int) -> DataFrame:
    """(dms_id, s, class, n_links, val, across) of groups of any size."""
    now = _across(index, stored(_filled(_classed(index), share, seed), "filled"))
    for _ in range(rounds):
        new = _across(index, stored(_swapped(now), "swapped"))
        better = new.select("dms_id", F.col("cut").alias("new_cut")).distinct().join(now.select("dms_id", F.col("cut").alias("old_cut")).distinct(), "dms_id").where("new_cut < old_cut").select("dms_id")
        if better.isEmpty():
            break
        now = stored(new.join(better, "dms_id", "left_semi").unionByName(now.join(better, "dms_id", "left_anti")), "folds")
    return now


def split_leftovers(split: DataFrame) -> DataFrame:
    """(dms_id, n_val, n_train, n_across): sizes of the folds and similar pairs that lie across them."""
    val = F.col("fold") == "val"
    return split.groupBy("dms_id").agg(F.count_if(val).alias("n_val"), F.count_if(~val).alias("n_train"), F.sum(F.when(val, F.col("n_across")).otherwise(0)).alias("n_across"))


def split_sizes(split: DataFrame) -> DataFrame:
    return split.groupBy("dms_id", "fold").agg(F.count("*").alias("n"))
