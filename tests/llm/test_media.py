import hashlib
import random
import zlib

import numpy as np
import pytest

from helixbench.llm import flac, media

RNG = random.Random(4)
PAYLOADS = [b"", b"\0" * 64, b"ab" * 32, bytes(range(256)) * 20, RNG.randbytes(9000), b"\0\xff" * 3000, "Größe und Maß. ".encode() * 500, b"a" * 10_000]


def test_round_trip_and_seeking():
    streams = flac.encode(PAYLOADS)
    assert flac.decode(streams) == PAYLOADS
    assert len(streams[7]) < 1500 < len(streams[4])
    for count in (1, 20, 64):
        for first in [[0] * 8, [len(p) // 2 for p in PAYLOADS], [max(0, len(p) - 64) for p in PAYLOADS], [2040] * 8]:
            assert flac.read_ranges(streams, first, count) == [p[f : f + count] for p, f in zip(PAYLOADS, first, strict=True)]


def test_scalar_decoder_and_walk_agree():
    for p, s in zip(PAYLOADS, flac.encode(PAYLOADS), strict=True):
        assert flac._walk(s, flac.parse(s)["at"]) == p


class Writer:
    def __init__(self):
        self.bits = ""

    def put(self, value, width):
        self.bits += format(value & (1 << width) - 1, f"0{width}b") if width else ""

    def rice(self, e, k):
        u = e * 2 if e >= 0 else -e * 2 - 1
        self.bits += "0" * (u >> k) + "1"
        self.put(u, k)

    def frame(self, number, samples):
        bits = self.bits + "0" * (-len(self.bits) % 8)
        body = flac._frame_header(number, samples) + int(bits, 2).to_bytes(len(bits) // 8, "big")
        crc = 0
        for byte in body:
            crc ^= byte << 8
            for _ in range(8):
                crc = (crc << 1 ^ 0x8005 if crc & 0x8000 else crc << 1) & 0xFFFF
        return body + crc.to_bytes(2, "big")


def test_streams_of_other_encoders():
    x = [RNG.randrange(-40, 40) for _ in range(64)]
    frames = []
    w = Writer()  # third-order prediction, two partitions, one of them escaped to raw values
    w.put(32 + 2, 7), w.put(0, 1)
    w.bits = "0" + format(32 + 2, "06b") + "0"
    for v in x[:3]:
        w.put(v, 8)
    w.put(7, 4), w.put(3, 5)
    taps = [9, -4, 2]
    for t in taps:
        w.put(t, 8)
    e = [x[i] - (sum(c * x[i - 1 - t] for t, c in enumerate(taps)) >> 3) for i in range(3, 64)]
    w.put(0, 2), w.put(1, 4), w.put(4, 4)
    for v in e[:29]:
        w.rice(v, 4)
    w.put(15, 4), w.put(10, 5)
    for v in e[29:]:
        w.put(v, 10)
    frames.append(w.frame(0, 64))
    for order, taps in enumerate(flac.FIXED):
        w = Writer()
        w.bits = "0" + format(8 + order, "06b") + "0"
        for v in x[:order]:
            w.put(v, 8)
        w.put(0, 6), w.put(3, 4)
        for i in range(order, 64):
            w.rice(x[i] - sum(c * x[i - 1 - t] for t, c in enumerate(taps)), 3)
        frames.append(w.frame(order + 1, 64))
    w = Writer()
    w.bits = "00000000"
    w.put(-7, 8)
    frames.append(w.frame(6, 64))
    w = Writer()  # three wasted bits
    w.bits = "00000011" + "001"
    for v in x:
        w.put(v >> 3, 5)
    frames.append(w.frame(7, 64))
    plain = (np.array(x) + 128).astype(np.uint8).tobytes()
    want = [plain] * 6 + [bytes([121]) * 64, (np.array([v >> 3 << 3 for v in x]) + 128).astype(np.uint8).tobytes()]
    assert flac.decode_frames(frames) == want
    signed = (np.frombuffer(b"".join(want), np.uint8) ^ 0x80).tobytes()
    info = b"\0\x40" * 2 + b"\0" * 6 + (8000 << 44 | 7 << 36 | 64 * 8).to_bytes(8, "big") + hashlib.md5(signed).digest()
    assert flac.decode([b"fLaC\x80" + len(info).to_bytes(3, "big") + info + b"".join(frames)]) == [b"".join(want)]


def test_damage_is_found():
    stream = flac.encode([b"some text " * 64])[0]
    at = flac.parse(stream)["at"]
    for place in (0, at, at + 4, at + 40, len(stream) - 1, 30):
        broken = bytearray(stream)
        broken[place] ^= 1
        with pytest.raises(flac.FlacError):
            flac.decode([bytes(broken)])


def test_frame_numbers():
    assert flac._coded(5) == b"\x05"
    for n in (0x80, 0x7FF, 0x800, 0xD7FF, 0xFFFF, 0x10000):
        assert flac._coded(n) == chr(n).encode()
    assert len(flac._coded(0x200000)) == 5


def test_features_of_a_table(spark):
    texts = ["", None, "é" * 32, "x" * 65, "ein Text\n" * 3000, "ein Text\n" * 3000]
    df = spark.createDataFrame([(i, t, "m") for i, t in enumerate(texts)], "doc_id long, text string, media string")
    stored = media.store_media(df)
    assert stored.inputFiles()
    got = {r.doc_id: r for r in media.media_features(stored).collect()}
    for i, t in enumerate(texts):
        data = (t or "").encode()
        padded = data + b"\0" * ((-len(data)) % 64 if data else 64)
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
    assert got[4][1:] == got[5][1:] and got[0][1:] == got[1][1:]
    blocks = media.media_blocks(stored).where("doc_id = 4").orderBy("offset").collect()
    assert b"".join(bytes(b.pcm) for b in blocks).rstrip(b"\0").decode() == texts[4]
    assert media.media_features(media.to_media(df.limit(0))).count() == 0


def test_long_text_null_and_repeated_keys(spark):
    text = "lang und länger, " * 300_000  # more than a decoding batch
    df = spark.createDataFrame([(None, text), (1, "a"), (1, "b"), (1, "b")], "doc_id long, text string")
    stored = media.store_media(df)
    got = sorted(((r.doc_id, r.n_bytes, r.payload_sha256) for r in media.media_features(stored).collect()), key=str)
    pad = lambda x: hashlib.sha256(x + b"\0" * (-len(x) % 64)).hexdigest()
    long = text.encode()
    assert got == sorted([(None, len(long), pad(long)), (1, 1, pad(b"a")), (1, 1, pad(b"b")), (1, 1, pad(b"b"))], key=str)
    blocks = media.media_blocks(stored.where("doc_id is null")).orderBy("offset").collect()
    assert b"".join(bytes(b.pcm) for b in blocks)[: len(long)] == long and len(blocks) == -(-len(long) // flac.BLOCK)
