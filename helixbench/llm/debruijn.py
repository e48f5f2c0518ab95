"""Substring de-duplication on a compacted de Bruijn graph of words.

A k-mer of words is an edge from the node of its first k-1 words to that of its last k-1. The graph has the edges that
occur in several documents, each with its source coordinate, the place of its first occurrence (smallest document,
then smallest position). A node with one edge in and one out does not branch: its two edges are one path. Paths
compact by contraction, within tasks first, then by joins of what is left, until every edge knows its path and its
place on it. A document's stretch along a path, with its source, is a span; the words of both are compared by a
128-bit digest that is taken at the source.

To keep unique edges off the network, every edge is filed under its minimizer, the smallest hash of the shorter
word runs inside it: equal edges have equal minimizers, so only edges whose minimizer occurs in two documents are
hashed in full. That filter loses no repeated edge. A whole text that a smaller document has too is one path from its
first word to its last and takes no part in this. Neighbouring edges mostly share a minimizer, so they travel as one
row; what advances in step with its source is put together in the minimizer's bucket before it travels on.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixbench.llm.common import forget, partitions, sized, stored

WORDS, ANCHOR = 13, 6
#: Links that a task contracts at once, a bound on its memory.
PART = 1 << 18
_BASE, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def words_of(text: str | None) -> list[bytes]:
    """Runs of anything but space and the bytes 9 to 13, unchanged."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def _hashes(words: list[bytes]) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(w) for w in words), np.uint64, len(words))


def _runs(hashes: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each run of k words."""
    n = len(hashes) - k + 1
    total = np.zeros(n, np.uint64)
    for j in range(k):
        total *= _BASE
        total += hashes[j : j + n]
    total ^= total >> np.uint64(31)
    total *= _MIX
    total ^= total >> np.uint64(29)
    return total


def _minimizers(hashes: np.ndarray, k: int) -> np.ndarray:
    """For each run of k words, the smallest hash of the shorter runs in it."""
    anchor = min(ANCHOR, k)
    short, n = _runs(hashes, anchor), len(hashes) - k + 1
    least = short[:n].copy()
    for j in range(1, k - anchor + 1):
        np.minimum(least, short[j : j + n], out=least)
    return least


def _row(text) -> int:
    """Tells rows that share a key apart by their text: half of its SHA-1, as Spark has it in ``_text_row``."""
    return int(hashlib.sha1((text.as_py() or "").encode("utf-8", "surrogatepass")).hexdigest()[:15], 16)


def _text_row(text: Column) -> Column:
    return F.conv(F.substring(F.sha1(F.coalesce(text, F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def _file(k: int):
    """(doc, text, copies) to the distinct minimizers of each document."""

    def run(batches):
        for batch in batches:
            ids, found = [], []
            for i, (doc, text, copies) in enumerate(zip(*batch.columns, strict=True)):
                if doc.is_valid and not _copied(text, copies):
                    words = words_of(text.as_py())
                    if len(words) >= k:
                        with np.errstate(over="ignore"):
                            least = np.unique(_minimizers(_hashes(words), k))
                        found.append(least.view(np.int64))
                        ids.append(np.full(len(least), i))
            if found:
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.concatenate(ids))), pa.array(np.concatenate(found))], names=["doc", "m"])

    return run


def _copied(text, copies) -> bool:
    return copies.is_valid and _row(text) in copies.as_py()


def _edges(k: int):
    """(doc, text, minimizers) to the edges filed under one of these minimizers: a row for each run of edges, with the
    nodes before, between and behind them."""

    def run(batches):
        for batch in batches:
            ids, rows, least, start, size, edge, node = [], [], [], [], [], [], []
            for i, (doc, text, wanted) in enumerate(zip(*batch.columns, strict=True)):
                words = words_of(text.as_py()) if doc.is_valid and wanted.is_valid else []
                if len(words) >= k:
                    with np.errstate(over="ignore"):
                        hashes = _hashes(words)
                        m, e, between = (x.view(np.int64) for x in (_minimizers(hashes, k), _runs(hashes, k), _runs(hashes, k - 1)))
                    at = np.flatnonzero(np.isin(m, wanted.values.to_numpy()))
                    if len(at):
                        new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1] + 1) | (m[at[1:]] != m[at[:-1]])]))
                        n = np.diff(np.append(new, len(at)))
                        least.append(m[at[new]])
                        start.append(at[new])
                        size.append(n)
                        edge.append(e[at])
                        node.append(np.concatenate([between[a : a + c + 1] for a, c in zip(at[new], n, strict=True)]))
                        ids.append(np.full(len(new), i))
                        rows.append(np.full(len(new), _row(text)))
            if ids:
                n = np.concatenate(size)
                lists = [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(c)]).astype(np.int32)), pa.array(np.concatenate(x))) for c, x in ((n, edge), (n + 1, node))]
                flat = [pa.array(np.concatenate(x)) for x in (rows, least, start)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.concatenate(ids))), flat[0], flat[1], flat[2].cast(pa.int32()), *lists], names=["doc", "row", "m", "start", "edges", "nodes"])

    return run


def _dealt(df: DataFrame, key: str, text: str) -> DataFrame:
    """(doc, text) dealt by document once; every step below reads this one exchange."""
    docs = df.select(F.col(key).cast("long").alias("doc"), F.col(text).cast("string").alias("text"))
    return docs.repartition(partitions(df.sparkSession), "doc")


def _copies(df: DataFrame, key: str, text: str) -> DataFrame:
    """(doc, copies): for documents whose whole text a smaller document has, the rows of such texts and that
    document. Texts are compared by a 160-bit digest."""
    rows = df.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).cast("long").alias("doc"), F.sha1(F.col(text).cast("binary")).alias("h"), _text_row(F.col(text)).alias("row"))
    first = rows.groupBy("h").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first < last").drop("last")
    found = rows.join(first, "h").where("first < doc")
    return found.groupBy("doc").agg(F.map_from_entries(F.collect_set(F.struct("row", "first"))).alias("copies"))


def _with(docs: DataFrame, more: DataFrame) -> DataFrame:
    """``docs`` with the columns of a smaller table; the texts are not sorted for it."""
    return docs.join(more.hint("shuffle_hash"), "doc", "left")


def _found(docs: DataFrame, copies: DataFrame, k: int) -> DataFrame:
    """What repeats, as a stored table of two kinds of rows. ``edge`` is not null: an edge that several documents have,
    with its nodes and its source (src_doc, src_row, src_pos), a row each. Else: a stretch of n edges of (doc, row)
    from pos on whose sources, all in smaller documents, advance in step; stretches end where the minimizer changes."""
    known = F.map_keys("copies").alias("copies")
    filed = _with(docs, copies).select("doc", "text", known).mapInArrow(_file(k), "doc long, m long")
    under = Window.partitionBy("m")
    shared = filed.select("doc", "m", F.min("doc").over(under).alias("low"), F.max("doc").over(under).alias("high")).where("low < high")
    wanted = shared.groupBy("doc").agg(F.collect_set("m").alias("ms"))
    runs = _with(docs, wanted).select("doc", "text", "ms").mapInArrow(_edges(k), "doc long, row long, m long, start int, edges array<long>, nodes array<long>")
    dealt = runs.repartition(partitions(docs.sparkSession), "m")
    ends = F.transform("edges", lambda e, i: F.struct(e.alias("edge"), F.get("nodes", i).alias("left"), F.get("nodes", i + 1).alias("right")))
    edges = dealt.select("m", "doc", "row", "start", F.posexplode(ends).alias("i", "e")).select("m", "doc", "row", "start", (F.col("start") + F.col("i")).alias("pos"), "e.*")
    one = Window.partitionBy("m", "edge")
    order = one.orderBy("doc", "pos", "row")
    sourced = edges.withColumn("s", F.first(F.struct("doc", "pos", "row")).over(order)).withColumn("at", F.row_number().over(order)).withColumn("high", F.max("doc").over(one))
    # An edge's first place is its row in the graph, those in larger documents are what repeats.
    sourced = sourced.where("s.doc < high AND (at = 1 OR doc > s.doc)")
    own = lambda c: F.when(F.col("at") == 1, F.col(c)).alias(c)
    rows = sourced.select("m", "doc", "row", "start", "pos", F.lit(1).alias("n"), F.col("s.doc").alias("src_doc"), F.col("s.row").alias("src_row"), F.col("s.pos").alias("src_pos"), own("edge"), own("left"), own("right"))
    return stored(_in_step(rows, ["m", "doc", "row", "start", "edge", "left", "right"]).drop("m", "start"), "found")


def _in_step(stretches: DataFrame, within: list[str]) -> DataFrame:
    """Stretches that continue each other, in the document and at the source alike, become one."""
    along = Window.partitionBy(*within).orderBy("pos", "src_doc", "src_row", "src_pos")
    before = lambda c: F.lag(c).over(along)
    step = (F.col("pos") == before("pos") + before("n")) & (F.col("src_doc") == before("src_doc")) & (F.col("src_row") == before("src_row")) & (F.col("src_pos") == before("src_pos") + before("n"))
    numbered = stretches.withColumn("part", F.when(step, 0).otherwise(1)).withColumn("part", F.sum("part").over(along))
    one = numbered.groupBy(*within, "part").agg(F.min("pos").alias("pos"), F.sum("n").cast("int").alias("n"), F.min("src_doc").alias("src_doc"), F.min("src_row").alias("src_row"), F.min("src_pos").alias("src_pos"))
    return one.drop("part")


def links(edges: DataFrame) -> DataFrame:
    """(a, b, at): edges a and b that meet in a node which no other edge enters or leaves; ``at`` is a's source."""
    enters = edges.groupBy("right").agg(F.count("*").alias("n"), F.min(F.struct("edge", "src_doc")).alias("a")).where("n = 1")
    leaves = edges.groupBy("left").agg(F.count("*").alias("n"), F.min("edge").alias("b")).where("n = 1")
    met = enters.select("right", "a").join(leaves.select("left", "b"), F.col("right") == F.col("left"))
    return met.where("a.edge <> b").select(F.col("a.edge").alias("a"), "b", F.col("a.src_doc").alias("at"))


def _contract(batches):
    """Links (a, b) to (edge, end, dist), for each a the edge at the end of its path among the links at hand, and the
    steps to it. Edges on a ring have none."""
    held = []

    def made():
        table = pa.Table.from_batches(held)
        a, b = (table.column(i).to_numpy() for i in range(2))
        names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        step, dist = np.arange(len(names)), np.zeros(len(names), np.int64)
        step[at[: len(a)]] = at[len(a) :]
        dist[at[: len(a)]] = 1
        last = step == np.arange(len(names))
        for _ in range(len(names).bit_length()):
            dist += dist[step]
            step = step[step]
        mine = at[: len(a)][last[step[at[: len(a)]]]]
        return pa.RecordBatch.from_arrays([pa.array(names[x]) for x in (mine, step[mine])] + [pa.array(dist[mine])], names=["edge", "end", "dist"])

    n = 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= PART:
            yield made()
            held, n = [], 0
    if n:
        yield made()


def compacted(edges: DataFrame) -> DataFrame:
    """(edge, src_doc, src_row, src_pos, path, place): every edge of the graph with its path, named by the last edge, and its place on it
    (rising by one from edge to edge, 0 at the end), as a stored table. Paths mostly follow one source document, so
    links are dealt by it and contract there; what hangs together across tasks doubles its steps by joins."""
    own = links(edges).repartition(partitions(edges.sparkSession), "at").select("a", "b")
    hops = stored(own.mapInArrow(_contract, "edge long, end long, dist long"), "hops")
    ends = hops.select(F.col("end").alias("edge")).distinct()
    bridges = stored(hops.join(ends, "edge", "left_semi"), "bridges")  # ends that go on in another task
    rounds = max(1, bridges.count()).bit_length() + 1
    for _ in range(rounds):
        if bridges.isEmpty():
            break
        on = bridges.select(F.col("edge").alias("end"), F.col("end").alias("far"), F.col("dist").alias("more"))
        new = stored(bridges.join(on, "end", "left").select("edge", F.coalesce("far", "end").alias("end"), (F.col("dist") + F.coalesce("more", F.lit(0))).alias("dist"), F.col("far").isNotNull().alias("moved")), "bridges")
        forget(bridges)
        moved, bridges = not new.where("moved").isEmpty(), new.drop("moved")
        if not moved:
            break
    # What still goes on after all rounds is a ring over several tasks; it stays cut where they met.
    ring = bridges.join(bridges.select(F.col("edge").alias("end")), "end", "left_semi").select("edge")
    on = bridges.join(ring, "edge", "left_anti").select(F.col("edge").alias("end"), F.col("end").alias("far"), F.col("dist").alias("more"))
    full = hops.join(on, "end", "left").select("edge", F.coalesce("far", "end").alias("path"), (F.col("dist") + F.coalesce("more", F.lit(0))).alias("dist"))
    source = ["src_doc", "src_row", "src_pos"]
    out = edges.select("edge", *source).join(full, "edge", "left").select("edge", *source, F.coalesce("path", "edge").alias("path"), (-F.coalesce("dist", F.lit(0))).alias("place"))
    out = stored(out, "paths")
    for done in (hops, bridges):
        forget(done)
    return out


def _stretched(paths: DataFrame) -> DataFrame:
    """(doc, row, low, m, path): the paths where they lie at their sources, m edges from place low on."""
    keys = ["path", "src_doc", "src_row", "lane"]
    laned = paths.withColumn("lane", F.col("src_pos") - F.col("place"))
    island = F.col("src_pos") - F.row_number().over(Window.partitionBy(*keys).orderBy("src_pos"))
    out = laned.withColumn("island", island).groupBy(*keys, "island").agg(F.min("src_pos").alias("low"), F.count("*").cast("int").alias("m"))
    return out.select(F.col("src_doc").alias("of_doc"), F.col("src_row").alias("of_row"), "low", "m", "path")


def _repeated_spans(df: DataFrame, key: str, text: str, docs: DataFrame, copies: DataFrame, k: int) -> DataFrame:
    """Spans (doc, row, pos, n, src_doc, src_pos, digest): a document's stretches cut where the paths of their source
    end, with the digest of their words there; a stored table."""
    found = _found(docs, copies, k)
    paths = compacted(found.where("edge is not null").select("edge", "left", "right", "src_doc", "src_row", "src_pos"))
    long = _in_step(found.where("edge is null").select("doc", "row", "pos", "n", "src_doc", "src_row", "src_pos"), ["doc", "row"])
    along = _stretched(paths)
    low, high = F.greatest("src_pos", "low"), F.least(F.col("src_pos") + F.col("n"), F.col("low") + F.col("m"))
    met = long.join(along, (F.col("src_doc") == F.col("of_doc")) & (F.col("src_row") == F.col("of_row")) & (low < high))
    spans = met.select("doc", "row", (F.col("pos") + low - F.col("src_pos")).alias("pos"), (high - low).alias("n"), "src_doc", "src_row", low.alias("src_pos"))
    spans = stored(spans, "spans")
    asked = spans.select("src_doc", "src_row", "src_pos", "n").distinct().groupBy(F.col("src_doc").alias("doc")).agg(F.collect_list(F.struct("src_row", "src_pos", "n")).alias("asked"))
    asked = stored(asked, "asked")
    sources, _ = sized(asked.select("doc"), "sources")  # only their texts are read again, where their ids may be sent
    few = df.select(F.col(key).cast("long").alias("doc"), F.col(text).cast("string").alias("text")).join(sources, "doc", "left_semi")
    said = few.join(asked.hint("shuffle_hash"), "doc").select("doc", "text", "asked").mapInArrow(_source_digests(k), "src_doc long, src_row long, src_pos int, n int, digest binary")
    out = stored(spans.join(said.distinct(), ["src_doc", "src_row", "src_pos", "n"]).select(*_PATH_NAMES, "digest"), "sourced")
    for done in (found, paths, spans, asked, sources):
        forget(done)
    return out


def _digest(words: list[bytes]) -> bytes:
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest()


def _source_digests(k: int):
    """(doc, text, asked) to the digests of the words of the spans that are asked of this text."""

    def run(batches):
        for batch in batches:
            out = []
            for doc, text, asked in zip(*batch.columns, strict=True):
                row, words = _row(text), words_of(text.as_py())
                out += [(doc.as_py(), row, x["src_pos"], x["n"], _digest(words[x["src_pos"] : x["src_pos"] + x["n"] + k - 1])) for x in asked.as_py() if x["src_row"] == row]
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names=["src_doc", "src_row", "src_pos", "n", "digest"])

    return run


def _whole(k: int):
    """(doc, text, copies) to the paths of texts that are copies."""

    def run(batches):
        for batch in batches:
            out = []
            for doc, text, copies in zip(*batch.columns, strict=True):
                row, n, copies = _row(text), len(words_of(text.as_py())), dict(copies.as_py())
                if n >= k and row in copies:
                    out.append((doc.as_py(), row, 0, n - k + 1, copies[row], 0))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), _PATH_TYPES, strict=True)] if out else [pa.array([], t) for t in _PATH_TYPES], names=_PATH_NAMES)

    return run


_PATH_NAMES, _PATH_TYPES = ["doc", "row", "pos", "n", "src_doc", "src_pos"], [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32()]


def _checked(k: int):
    """(doc, text, paths) to those of its spans whose words have the digest of their source."""

    def run(batches):
        for batch in batches:
            out = []
            for doc, text, paths in zip(*batch.columns, strict=True):
                words, row = words_of(text.as_py()), _row(text)
                out += [(doc.as_py(), row, p["pos"], p["n"], p["src_doc"], p["src_pos"]) for p in paths.as_py() if p["row"] == row and _digest(words[p["pos"] : p["pos"] + p["n"] + k - 1]) == p["digest"]]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(_PATH_TYPES)], names=_PATH_NAMES)

    return run


def repeated_spans(df: DataFrame, key: str = "doc_id", text: str = "text", k: int = WORDS) -> DataFrame:
    """(key, row, start, n_words, src_doc, src_start): the documents' stretches along the compacted paths. Words start
    .. start+n_words-1 of the document are the words from src_start on of a document with a smaller key. Rows without
    a key take no part, texts of fewer than k words have no edge, rows that share a key (repeated rows too) are one
    document's variants and never each other's source; ``row``, a digest of the text, tells them apart."""
    docs, copies = _dealt(df, key, text), _copies(df, key, text)
    whole = docs.join(copies, "doc").mapInArrow(_whole(k), "doc long, row long, pos int, n int, src_doc long, src_pos int")
    paths = _repeated_spans(df, key, text, docs, copies, k).groupBy("doc").agg(F.collect_list(F.struct("row", "pos", "n", "src_doc", "src_pos", "digest")).alias("paths"))
    found = docs.join(paths.hint("shuffle_hash"), "doc").select("doc", "text", "paths").mapInArrow(_checked(k), "doc long, row long, pos int, n int, src_doc long, src_pos int")
    spans = found.unionAll(whole).distinct()
    return spans.select(F.col("doc").alias(key), "row", F.col("pos").alias("start"), (F.col("n") + k - 1).alias("n_words"), "src_doc", F.col("src_pos").alias("src_start"))


def _drop(k: int, kept_text: bool):
    """(doc, text, paths, copies) to the counts and the digest of what stays."""

    def run(batches):
        for batch in batches:
            total, gone, digest, kept = [], [], [], []
            for text, paths, copies in zip(*batch.columns[1:], strict=True):
                words = words_of(text.as_py())
                total.append(len(words))
                if _copied(text, copies):
                    words = words if len(words) < k else []
                elif paths.is_valid:
                    row = _row(text)
                    own = [(p["pos"], p["n"]) for p in paths.as_py() if p["row"] == row and _digest(words[p["pos"] : p["pos"] + p["n"] + k - 1]) == p["digest"]]
                    edge = np.zeros(len(words) + 1, np.int64)
                    for start, n in own:
                        edge[start] += 1
                        edge[start + n + k - 1] -= 1
                    stays = np.cumsum(edge[:-1]) == 0
                    words = [words[i] for i in np.flatnonzero(stays)]
                gone.append(total[-1] - len(words))
                joined = b" ".join(words)
                digest.append(hashlib.sha256(joined).hexdigest())
                kept.append(joined.decode("utf-8", "surrogatepass") if kept_text else None)
            values = [pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(digest, pa.string()), pa.array(kept, pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *values], names=["doc", "n_words", "n_removed", "kept_sha256", "kept"])

    return run


def drop_repeats(df: DataFrame, key: str = "doc_id", text: str = "text", k: int = WORDS, kept_text: bool = True) -> DataFrame:
    """(key, n_words, n_removed, kept_sha256, kept), one row for each input row. ``kept``: the words, joined by one
    space, that no k-word window covers which also starts in a document with a smaller key; windows are judged on
    the input; null without ``kept_text``. Null and empty texts have no words. Rows without a key lose nothing and
    are nobody's source."""
    docs, copies = _dealt(df, key, text), _copies(df, key, text)
    paths = _repeated_spans(df, key, text, docs, copies, k).groupBy("doc").agg(F.collect_list(F.struct("row", "pos", "n", "digest")).alias("paths"))
    every = _with(_with(docs, paths), copies).select("doc", "text", "paths", F.map_keys("copies").alias("copies"))
    out = every.mapInArrow(_drop(k, kept_text), "doc long, n_words long, n_removed long, kept_sha256 string, kept string")
    return out.withColumnRenamed("doc", key)
