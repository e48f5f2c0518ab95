"""Media columns: payloads stored as FLAC streams in a table's binary column, read back as PCM blocks and features."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixbench.llm import flac
from helixbench.llm.common import stored

UNIT = 64
#: Rice codes of equal words are rarely equal bytes, so that it takes large pages and a high level to find what is left.
PACKED = {"compression": "zstd", "parquet.compression.codec.zstd.level": "12", "parquet.page.size": str(4 << 20)}


def _padded(data: bytes) -> bytes:
    return data + b"\0" * (-len(data) % UNIT or (0 if data else UNIT))


def _encoded(batches):
    for batch in batches:
        for low, high in _parts(batch.column(1), 4):
            data = [(x.as_py() or "").encode("utf-8", "surrogatepass") for x in batch.column(1)[low:high]]
            media = flac.encode([_padded(x) for x in data])
            yield pa.RecordBatch.from_arrays([batch.column(0)[low:high], pa.array([len(x) for x in data], pa.int64()), pa.array(media, pa.binary())], names=["k", "n_bytes", "media"])


def _parts(column, weight: int):
    """Bounds of row ranges that hold about a codec batch each; a single longer row is a range of its own."""
    low = held = 0
    for i, value in enumerate(column):
        held += value.as_buffer().size if value.is_valid else 0
        if held * weight >= 4 * flac.BATCH or i + 1 == len(column):
            yield low, i + 1
            low, held = i + 1, 0


def to_media(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, media), one row for each input row: the text's UTF-8, padded by zero bytes to a positive
    multiple of 64, as 8-bit samples of a FLAC stream. Null and empty texts are 64 zero bytes; null and repeated keys
    have rows of their own."""
    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"))
    return rows.mapInArrow(_encoded, f"k {kind}, n_bytes long, media binary").withColumnRenamed("k", key)


def store_media(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``to_media`` written to a table of its own in the shared folder, and that table as it is read back: every later
    step reads the stored bytes. The files stay; they are what is made here."""
    return stored(to_media(df, key, text), "media", **PACKED)


def media_blocks(df: DataFrame, key: str = "doc_id", media: str = "media") -> DataFrame:
    """(key, offset, samples, pcm): the PCM blocks of each stream at their sample offsets, verified against the
    streams' checksums. An empty stream has no block; a null one none either. Damaged streams fail the job."""
    kind = df.schema[key].dataType.simpleString()

    def blocks(batches):
        for batch in batches:
            for low, high in _parts(batch.column(1), 4):
                keys, offsets, pcm = [], [], []
                rows = [(i, x.as_py()) for i, x in enumerate(batch.column(1)[low:high], low) if x.is_valid]
                for (i, _), data in zip(rows, flac.decode([s for _, s in rows]), strict=True):
                    for at in range(0, len(data), flac.BLOCK):
                        keys.append(i)
                        offsets.append(at)
                        pcm.append(data[at : at + flac.BLOCK])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keys, pa.int64())), pa.array(offsets, pa.int64()), pa.array([len(p) for p in pcm], pa.int32()), pa.array(pcm, pa.binary())], names=["k", "offset", "samples", "pcm"])

    return df.select(F.col(key).alias("k"), F.col(media).alias("m")).mapInArrow(blocks, f"k {kind}, offset long, samples int, pcm binary").withColumnRenamed("k", key)


def _feature(payload: bytes) -> str:
    """Mean, root mean square and sign changes of the samples, in whole numbers."""
    x = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
    changes = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    return f"sum={int(x.sum())};squares={int((x * x).sum())};changes={changes}"


def media_features(df: DataFrame, key: str = "doc_id", media: str = "media") -> DataFrame:
    """(key, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature) from the stored
    streams. The tail, the last 64 samples, is read through the seek table: only its frames are decoded for it.
    Equal streams have equal values."""
    kind = df.schema[key].dataType.simpleString()

    def features(batches):
        for batch in batches:
            for low, high in _parts(batch.column(2), 4):
                media = [x.as_py() for x in batch.column(2)[low:high]]
                payloads, out = flac.decode(media), []
                tails = flac.read_ranges(media, [len(data) - UNIT for data in payloads], UNIT)
                for stream, data, tail in zip(media, payloads, tails, strict=True):
                    out.append((len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(tail), len(stream), hashlib.sha256(stream).hexdigest(), _feature(data)))
                columns = [pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0)[low:high], batch.column(1)[low:high], *columns], names=["k", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    schema = f"k {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return df.select(F.col(key).alias("k"), "n_bytes", F.col(media).alias("m")).mapInArrow(features, schema).withColumnRenamed("k", key)
