"""Token ids in binary shards: each document compressed on its own with one shared zstandard dictionary.

A shard: magic ``IDZ1``, the dictionary's SHA-256 (32 bytes), the frames of its documents one after the other, then
the index (for each document: doc_id, offset of its frame, number of ids, as little-endian int64, int64, uint32),
the number of documents (uint64) and the offset of the index (uint64), then the magic again. A frame decompresses
with the dictionary to ids of two bytes, or of four where one is above 65535. The dictionary lies beside the
shards, named by its digest. Any document is read with its shard's index and one frame.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixbench.llm.common import in_one_task, partitions, sampled, scratch, stored

MAGIC = b"IDZ1"
_INDEX = np.dtype([("doc_id", "<i8"), ("at", "<i8"), ("n", "<u4")])
_TAIL = "<QQ4s"

#: Whitespace-separated pieces whose split, lower case and normal form need no context: letters of Latin-1 and
#: runs of ASCII punctuation without the apostrophe (contractions) and ``<`` (special tokens).
_SIMPLE = re.compile(r"(?:[A-Za-zÀ-ÖØ-öø-ÿ]+|[!-&(-/:;=-@\[-`{-~]+)+")
_PART = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+|[!-&(-/:;=-@\[-`{-~]+")
#: Words and parts of words kept with their ids by each worker; beyond it only those of the batch at hand stay.
REMEMBERED, PARTS = 250_000, 60_000


def _byte_letters() -> dict[int, str]:
    """The letters that byte-level tokenizers write for bytes: printable ones stand for themselves."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordEncoder:
    """Ids of whole texts from a tokenizer that splits at white space: each word is encoded once and remembered."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.words = pa.array([], pa.string())
        self.ids, self.size = np.empty(0, np.uint32), np.empty(0, np.int64)
        self.parts: dict[str, bytes] = {}

    def __call__(self, text: str) -> np.ndarray:
        return self.batch(pa.array([text], pa.string()))[0]

    def batch(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text. The texts are split and their distinct words found at once; null texts have none."""
        lists = pc.ascii_split_whitespace(texts.fill_null(""))
        coded = lists.flatten().dictionary_encode()
        place = self._places(coded.dictionary)[coded.indices.to_numpy()]
        n = self.size[place]
        ends = np.concatenate([[0], np.cumsum(n)])
        at = np.repeat((np.cumsum(self.size) - self.size)[place] - ends[:-1], n)
        at += np.arange(len(at))
        flat = self.ids[at]
        bounds = ends[np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())])].tolist()
        return [flat[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]

    def _places(self, words: pa.Array) -> np.ndarray:
        """Where the distinct ``words`` are among the remembered ones, after the new ones were added."""
        known = pc.index_in(words, self.words)
        if len(self.words) + known.null_count > REMEMBERED:  # only the words of this batch stay
            self.words, self.ids, self.size = self.words[:0], self.ids[:0], self.size[:0]
            known = pa.nulls(len(words), pa.int32())
        new = words.filter(known.is_null())
        found = list(map(self._word, new.to_pylist()))
        if len(self.parts) > PARTS:
            self.parts.clear()
        first = len(self.words)
        self.words = pa.concat_arrays([self.words, new])
        self.ids = np.concatenate([self.ids, np.frombuffer(b"".join(found), "<u4")])
        self.size = np.concatenate([self.size, np.fromiter(map(len, found), np.int64, len(found)) // 4])
        out = known.fill_null(-1).to_numpy().astype(np.int64)
        out[out < 0] = np.arange(first, len(self.words))
        return out

    def _word(self, word: str) -> bytes:
        """The ids of a word without white space, as little-endian 32-bit integers."""
        if word.isascii() and word.isalpha():
            return self._part(word.lower())
        if not _SIMPLE.fullmatch(word):
            return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes() if word else b""
        low = word.lower()
        return self._part(low) if low.isalpha() else b"".join(map(self._part, _PART.findall(low)))

    def _part(self, part: str) -> bytes:
        """The same for a run of lower-case letters or of punctuation."""
        if (found := self.parts.get(part)) is None:
            letters = part if part.isascii() else part.encode().decode("latin-1").translate(self.letters)
            found = self.parts[part] = b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(letters)])
        return found


@lru_cache(maxsize=2)
def _encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def _pack(ids: np.ndarray) -> bytes:
    wide = bool(len(ids)) and int(ids.max()) > 0xFFFF
    return bytes([4 if wide else 2]) + ids.astype("<u4" if wide else "<u2").tobytes()


def _unpack(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<u4" if data[:1] == b"\x04" else "<u2", offset=1).astype(np.uint32)


def train_dictionary(df: DataFrame, key: str, text: str, tokenizer_path: str, end_id: int, documents: int = 2000, ids: int = 2048, size: int = 65536) -> bytes:
    """A dictionary from the serialized ids of at most ``documents`` documents, those of the smallest key hash
    (``common.sampled``). Whole texts are encoded; of each, a stretch of at most ``ids`` ids at a place drawn by a hash
    is trained on. The stretches go to one task, only the dictionary comes to the driver; too little text to train on
    gives an empty one."""
    hashed = df.where(F.col(text).isNotNull()).select(F.lit(0).alias("g"), F.xxhash64(F.lit(17), F.col(key)).alias("h"), F.col(text).cast("string").alias("t"))

    def stretches(batches):
        for batch in batches:
            for h, part in zip(batch.column(0).to_pylist(), _encoder(tokenizer_path).batch(batch.column(1)), strict=True):
                low = (h >> 20) % max(1, len(part) + 2 - ids)
                piece = np.append(part, np.uint32(end_id))[low : low + ids]
                yield pa.RecordBatch.from_pydict({"h": pa.array([h], pa.int64()), "piece": pa.array([_pack(piece)], pa.binary())})

    def trained(rows: pa.Table) -> bytes:
        samples = rows.sort_by([("h", "ascending"), ("piece", "ascending")])["piece"].to_pylist()
        total = sum(map(len, samples))
        if len(samples) < 16 or total < 4096:
            return b""
        try:
            return zstandard.train_dictionary(min(size, max(1024, total // 10)), samples).as_bytes()
        except zstandard.ZstdError:
            return b""

    return in_one_task(sampled(hashed, "g", documents).select("h", "t").mapInArrow(stretches, "h long, piece binary"), trained)


def _slices(batch: pa.RecordBatch, size: int = 1 << 22):
    """Parts of a batch (doc, text) of about so many bytes of text; a longer text is a part of its own."""
    ends = np.cumsum(pc.binary_length(batch.column(1)).fill_null(0).to_numpy(zero_copy_only=False))
    low = 0
    while low < batch.num_rows:
        high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + size, "right")))
        yield batch.slice(low, high - low)
        low = high


def _codec(dictionary: bytes):
    return zstandard.ZstdCompressionDict(dictionary) if dictionary else None


def _create(uri: str):
    files, path = pa.fs.FileSystem.from_uri(uri)
    files.create_dir(path.rpartition("/")[0], recursive=True)
    return files, path


def write_shards(df: DataFrame, folder: str, tokenizer_path: str, end_id: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Shards under ``folder`` (an URI that all executors reach), in ascending order of the key over all shards, and
    their manifest: (shard, path, documents, ids), one row for each shard, as a stored table.

    Rows are dealt by ranges of the key and sorted by (key, text hash), null keys first and stored as the smallest
    long; each task encodes and writes its own range as a stream, under a name of its own that only its manifest
    row makes valid, so tasks may be run again. The driver gets the dictionary and nothing else.
    """
    spark = df.sparkSession
    dictionary = train_dictionary(df, key, text, tokenizer_path, end_id)
    digest = hashlib.sha256(dictionary).digest()
    files, path = _create(f"{folder}/{digest.hex()}.dict")
    with files.open_output_stream(path) as f:
        f.write(dictionary)

    def write(batches):
        from pyspark import TaskContext

        name = f"{folder}/shard-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.idz"
        encode, out, index, at, total = _encoder(tokenizer_path), None, [], len(MAGIC) + 32, 0
        press = zstandard.ZstdCompressor(level=3, dict_data=_codec(dictionary), write_content_size=True)
        end = np.uint32(end_id)
        for batch in batches:
            for part in _slices(batch):
                if out is None:
                    files, path = _create(name)
                    out = files.open_output_stream(path)
                    out.write(MAGIC + digest)
                for doc, ids in zip(part.column(0).fill_null(-(1 << 63)).to_pylist(), encode.batch(part.column(1)), strict=True):
                    ids = np.append(ids, end)
                    frame = press.compress(_pack(ids))
                    out.write(frame)
                    index.append((doc, at, len(ids)))
                    at += len(frame)
                    total += len(ids)
        if out is not None:
            out.write(np.array(index, _INDEX).tobytes() + struct.pack(_TAIL, len(index), at, MAGIC))
            out.close()
            pa.default_memory_pool().release_unused()
            yield pa.RecordBatch.from_pydict({"shard": pa.array([TaskContext.get().partitionId()], pa.int32()), "path": [name], "documents": pa.array([len(index)], pa.int64()), "ids": pa.array([total], pa.int64())})

    rows = df.select(F.col(key).cast("long").alias("doc"), F.col(text).cast("string").alias("text"))
    dealt = rows.repartitionByRange(partitions(spark), "doc").sortWithinPartitions("doc", F.xxhash64("text"))
    return stored(dealt.mapInArrow(write, "shard int, path string, documents long, ids long"), "manifest")


class Shard:
    """One shard opened for reading: its index, and any document by its place or id."""

    def __init__(self, uri: str):
        files, path = pa.fs.FileSystem.from_uri(uri)
        self.file = files.open_input_file(path)
        size = self.file.size()
        n, at, magic = struct.unpack(_TAIL, self.file.read_at(struct.calcsize(_TAIL), size - struct.calcsize(_TAIL)))
        head = self.file.read_at(len(MAGIC) + 32, 0)
        if magic != MAGIC or head[:4] != MAGIC:
            raise ValueError(f"{uri} is no token shard")
        self.index = np.frombuffer(self.file.read_at(n * _INDEX.itemsize, at), _INDEX)
        self.ends = np.append(self.index["at"][1:], at)
        with files.open_input_stream(f"{path.rpartition('/')[0]}/{head[4:].hex()}.dict") as f:
            dictionary = f.read()
        if hashlib.sha256(dictionary).digest() != head[4:]:
            raise ValueError(f"the dictionary of {uri} is not the one it was written with")
        self.press = zstandard.ZstdDecompressor(dict_data=_codec(dictionary))

    def ids(self, place: int) -> np.ndarray:
        at = int(self.index["at"][place])
        found = _unpack(self.press.decompress(self.file.read_at(int(self.ends[place]) - at, at)))
        if len(found) != self.index["n"][place]:
            raise ValueError("a frame's ids are not as many as the index says")
        return found

    def document(self, doc_id: int) -> np.ndarray:
        place = int(np.searchsorted(self.index["doc_id"], doc_id))
        if place == len(self.index) or self.index["doc_id"][place] != doc_id:
            raise KeyError(doc_id)
        return self.ids(place)


def read_shards(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, decoded from the shards' files. ``start``: ids of all
    documents before it. Only the manifest, a row a shard, is numbered in one place."""

    def read(batches):
        for batch in batches:
            for uri, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                shard = Shard(uri)
                counts = shard.index["n"].astype(np.int64)
                starts = first + np.cumsum(counts) - counts
                for low in range(0, len(counts), 4096):
                    part = range(low, min(low + 4096, len(counts)))
                    crc = [zlib.crc32(shard.ids(i).astype("<u4").tobytes()) for i in part]
                    doc = shard.index["doc_id"][part.start : part.stop]
                    yield pa.RecordBatch.from_arrays([pa.array(doc, mask=doc == -(1 << 63)), pa.array(starts[part.start : part.stop]), pa.array(counts[part.start : part.stop]), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    shards = manifest.groupBy().agg(F.sort_array(F.collect_list(F.struct("shard", "path", "ids"))).alias("s"))
    before = F.expr("transform(s, (x, i) -> struct(x.path AS path, aggregate(slice(s, 1, i), 0L, (t, y) -> t + y.ids) AS first))")
    numbered = shards.select(F.explode(before).alias("x")).select("x.path", "x.first")
    return numbered.repartition(partitions(manifest.sparkSession), "path").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_rows(df: DataFrame, tokenizer_path: str, end_id: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Shards of ``df`` written to a folder of their own in the shared one, and read back: see ``read_shards``.
    Null and empty texts have the end id alone, rows that share a key stay rows of their own, an empty table has no
    shard and no rows."""
    manifest = write_shards(df, scratch(df.sparkSession, "tokens"), tokenizer_path, end_id, key, text)
    return read_shards(manifest).withColumnRenamed("doc_id", key)
