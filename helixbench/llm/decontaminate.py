"""Benchmark decontamination by spaced seeds, in DataFrame functions only.

A seed is a fixed mask over consecutive words that looks at some positions and ignores the others. The masks' hashes
at every word of a training text are joined with those of the benchmark items; at each hit the two texts are
compared word by word on its diagonal, all along. The two masks are such that every window of 13 words with at most two
substituted words holds a hit of one of them, so no such overlap is missed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixbench.llm.common import sized, stored

WINDOW, NEED = 13, 11
MASKS = ("11010001101", "11101101")
#: Seeds of a benchmark that are sent to every executor; a larger benchmark is joined by a shuffle.
BROADCAST_SEEDS = 200_000


def word_hashes(text: Column) -> Column:
    """A 64-bit hash of each word; words are runs of letters and digits, lower-cased."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    return F.transform(words, lambda w: F.xxhash64(w))


def _seeds(df: DataFrame, words: str, place: str, seed: str) -> DataFrame:
    """A row for each mask and word at which it lies within the text; the columns of ``df`` stay."""
    at = df.withColumn(place, F.explode(F.sequence(F.lit(0), F.size(words) - min(map(len, MASKS)))))
    hashes = [
        F.when(F.col(place) + len(mask) <= F.size(words), F.xxhash64(F.lit(i), *(F.get(words, F.col(place) + j) for j, bit in enumerate(mask) if bit == "1")))
        for i, mask in enumerate(MASKS)
    ]
    return at.withColumn(seed, F.explode(F.array(*hashes))).where(F.col(seed).isNotNull())


def _slide(state: Column, equal: Column) -> Column:
    """Moves the window one word on: ``bits`` are its words' equalities, ``first`` and ``last`` begin good windows."""
    bits, at = (state["bits"] * 2 + equal) % (1 << WINDOW), state["i"] - (WINDOW - 1)
    good = F.when((at >= 0) & (F.bit_count(bits) >= NEED), at)
    return F.struct(bits.alias("bits"), (state["i"] + 1).alias("i"), F.coalesce(state["first"], good).alias("first"), F.coalesce(good, state["last"]).alias("last"))


def _judged(diagonal: Column) -> Column:
    """The document's words (first, last) at which good windows on a diagonal begin; null without one. Only the words
    that lie beside the item's are looked at."""
    low = F.greatest(F.lit(0), -diagonal)
    high = F.least(F.size("iw"), F.size("dw") - diagonal)  # the item's words low .. high-1 have words beside them
    same = F.transform(F.sequence(low, high - 1), lambda j: (F.get("dw", j + diagonal) == F.get("iw", j)).cast("int"))
    none = F.struct(*(x.cast("int").alias(n) for n, x in (("bits", F.lit(0)), ("i", F.lit(0)), ("first", F.lit(None)), ("last", F.lit(None)))))
    placed = lambda f: F.when(f["first"].isNotNull(), F.struct((low + diagonal + f["first"]).alias("first"), (low + diagonal + f["last"]).alias("last")))
    return F.when(high - low >= WINDOW, F.aggregate(same, none, _slide, placed))


def overlaps(df: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """(key, item, first_word, last_word): for each document and benchmark item that share an aligned window of 13
    words of which at least 11 are equal, the words of the document from the first such window's start to the last
    one's end, counted from 0; one row for each pair of keys.

    Null and empty texts and those of fewer than 13 words overlap nothing. Rows that share a key count as one
    document (or item), as do rows with a null key. The seeds are streamed past the benchmark's and only the diagonals
    (place in the text less place in the item) that have a hit are kept, each once; then the texts that have one, and
    only these, are read again. The diagonals of a document and an item are one row, so that a document's words are
    there once for all of them, and each is compared along the item's words in one go.
    """
    items = benchmark.select(F.col(item).alias("item"), word_hashes(F.col(item_text)).alias("iw")).where(F.size("iw") >= WINDOW)
    texts = df.select(F.col(key).alias("doc"), F.col(text).alias("text"))
    docs = lambda rows: rows.select("doc", word_hashes(F.col("text")).alias("dw")).where(F.size("dw") >= WINDOW)
    known = _seeds(items, "iw", "j", "seed").select("seed", "j", "item")
    small = known.count() <= BROADCAST_SEEDS
    found = _seeds(docs(texts), "dw", "i", "seed").select("seed", "doc", "i")
    met = found.join(F.broadcast(known) if small else known, "seed").select("doc", "item", (F.col("i") - F.col("j")).alias("diagonal"))
    lines = stored(met.distinct().groupBy("doc", "item").agg(F.collect_list("diagonal").alias("diagonals")), "diagonals")
    hit, _ = sized(lines.select("doc").distinct(), "hit-docs")
    again = docs(texts.join(hit, texts["doc"].eqNullSafe(hit["doc"]), "left_semi"))
    pairs = lines.join(again, lines["doc"].eqNullSafe(again["doc"])).drop(again["doc"])
    hits = pairs.join(F.broadcast(items) if small else items, pairs["item"].eqNullSafe(items["item"])).drop(items["item"])
    good = F.filter(F.transform("diagonals", _judged), lambda x: x.isNotNull())
    # A generator runs once a row, where a filter on the same array would have it computed again.
    verified = hits.select("doc", "item", F.inline(good))
    spans = verified.groupBy("doc", "item").agg(F.min("first").cast("long").alias("first_word"), (F.max("last") + WINDOW - 1).cast("long").alias("last_word"))
    return spans.select(F.col("doc").alias(key), F.col("item").alias(item), "first_word", "last_word")


def decontaminate(df: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``df`` whose key no benchmark item overlaps, columns unchanged; rows with a null key stay, repeated
    rows go or stay together, and an empty benchmark takes nothing away."""
    hit, _ = sized(overlaps(df, benchmark, key, text, item, item_text).select(key).distinct(), "contaminated")
    return df.join(hit, key, "left_anti")
