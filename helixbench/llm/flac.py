"""FLAC streams of 8-bit mono samples: many at once with numpy, frame by frame in step.

A stream is ``fLaC``, STREAMINFO with the MD5 of the samples, a SEEKTABLE with one point for each frame where there
are several, and the frames. Each frame holds one subframe: verbatim, a fixed predictor or a second-order linear predictor, the last two
with Rice-coded residuals, whichever is shortest. Decoding verifies the header's CRC-8, the frame's CRC-16 and the
stream's MD5. Frames are decoded in step: one numpy operation takes the next residual of every frame of a batch.
Frames with features that the encoder here does not write (several Rice partitions, escape codes, wasted bits)
take a scalar path; streams without a seek point for each frame are walked frame by frame.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np

BLOCK, RATE = 2048, 8000
#: Samples of one decoding batch, a bound on memory; encoding and checksums take parts that stay in a core's cache.
BATCH, PART = 1 << 22, 1 << 16
_PRECISION, _SHIFT = 12, 9
#: The format's fixed predictors as coefficients of the last samples, newest first.
FIXED = [[], [1], [2, -1], [3, -3, 1], [4, -6, 4, -1]]


class FlacError(ValueError):
    """A stream that is no FLAC or is damaged."""


def _crc_table(poly: int, bits: int) -> np.ndarray:
    top, mask, out = 1 << (bits - 1), (1 << bits) - 1, []
    for byte in range(256):
        c = byte << (bits - 8)
        for _ in range(8):
            c = ((c << 1) ^ poly if c & top else c << 1) & mask
        out.append(c)
    return np.array(out, np.uint16)


_CRC8, _CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)


@lru_cache(maxsize=1 << 14)
def crc8(data: bytes) -> int:
    c = 0
    for byte in data:
        c = int(_CRC8[c ^ byte])
    return c


@lru_cache(maxsize=4)
def _far_table(length: int) -> np.ndarray:
    """What a byte adds to a CRC-16 when so many bytes follow it."""
    rows = [_CRC16]
    for _ in range(length - 1):
        c = rows[-1]
        rows.append((c << np.uint16(8)) ^ _CRC16[c >> np.uint16(8)])
    return np.concatenate(rows)


def crc16(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC-16 of each slice of ``flat``; none is empty."""
    size = max(4096, 1 << int(lengths.max()).bit_length())
    table, out, low = _far_table(size), np.empty(len(starts), np.uint16), 0
    total = np.cumsum(lengths)
    while low < len(starts):
        high = max(low + 1, int(np.searchsorted(total, (total[low - 1] if low else 0) + PART, "right")))
        n = lengths[low:high]
        at = _spread(starts[low:high], n)
        row = np.repeat((starts[low:high] + n - 1).astype(np.int32), n)
        row -= at
        row <<= 8
        row |= flat[at]
        out[low:high] = np.bitwise_xor.reduceat(table[row], np.cumsum(n) - n)
        low = high
    return out


def _spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All indices of the slices, one after the other."""
    first = np.cumsum(lengths) - lengths
    at = np.repeat((starts - first).astype(np.int32), lengths)
    at += np.arange(len(at), dtype=np.int32)
    return at


def _coded(number: int) -> bytes:
    """The format's variable-length frame number."""
    if number < 0x80:
        return bytes([number])
    out = []
    lead = 0x3F
    while number > lead:
        out.append(0x80 | number & 0x3F)
        number >>= 6
        lead >>= 1
    return bytes([(~(lead * 2 + 1)) & 0xFF | number, *reversed(out)])


@lru_cache(maxsize=1 << 14)
def _frame_header(number: int, samples: int) -> bytes:
    head = b"\xff\xf8\x70\x02" + _coded(number) + (samples - 1).to_bytes(2, "big")
    return head + bytes([crc8(head)])


# ---------------------------------------------------------------- encoding


def encode(payloads: list[bytes]) -> list[bytes]:
    """A stream for each payload; a byte b is the sample b - 128. An empty payload has a stream without frames."""
    out: list[bytes] = []
    group: list[bytes] = []
    held = 0
    for p in payloads:
        group.append(p)
        held += len(p)
        if held >= PART:
            out += _encode_group(group)
            group, held = [], 0
    return out + _encode_group(group) if group else out


def _encode_group(payloads: list[bytes]) -> list[bytes]:
    frames: list[list[bytes]] = [[] for _ in payloads]
    parts = [(d, i, p[at : at + BLOCK]) for d, p in enumerate(payloads) for i, at in enumerate(range(0, len(p), BLOCK))]
    low = 0
    while low < len(parts):
        high, held = low, 0
        while high < len(parts) and held < PART:
            held += len(parts[high][2])
            high += 1
        for (d, *_), frame in zip(parts[low:high], _encode_frames(parts[low:high]), strict=True):
            frames[d].append(frame)
        low = high
    return [_stream(p, f) for p, f in zip(payloads, frames, strict=True)]


def _stream(payload: bytes, frames: list[bytes]) -> bytes:
    sizes = [len(f) for f in frames]
    block = BLOCK.to_bytes(2, "big") * 2
    bounds = min(sizes, default=0).to_bytes(3, "big") + max(sizes, default=0).to_bytes(3, "big")
    packed = (RATE << 44 | 0 << 41 | 7 << 36 | len(payload)).to_bytes(8, "big")
    signed = (np.frombuffer(payload, np.uint8) ^ 0x80).tobytes()
    info = block + bounds + packed + hashlib.md5(signed).digest()
    points, at = [], 0
    for i, size in enumerate(sizes):
        points.append((i * BLOCK).to_bytes(8, "big") + at.to_bytes(8, "big") + (min(BLOCK, len(payload) - i * BLOCK)).to_bytes(2, "big"))
        at += size
    table = b"".join(points)
    last = b"\x80" if len(frames) < 2 else b"\x00"  # one frame needs no seek points
    seek = b"" if len(frames) < 2 else b"\x83" + len(table).to_bytes(3, "big") + table
    return b"fLaC" + last + len(info).to_bytes(3, "big") + info + seek + b"".join(frames)


def _sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, starts, dtype=np.int64)


def _encode_frames(parts: list[tuple[int, int, bytes]]) -> list[bytes]:
    n = np.array([len(p) for *_, p in parts])
    x = np.frombuffer(b"".join(p for *_, p in parts), np.uint8).astype(np.int32) - 128
    start = np.cumsum(n) - n
    place = np.arange(len(x), dtype=np.int32) - np.repeat(start.astype(np.int32), n)
    x1, x2 = np.zeros_like(x), np.zeros_like(x)
    x1[1:], x2[2:] = x[:-1], x[:-2]
    inside = place >= 2
    # A second-order predictor by least squares, in whole numbers.
    r0, r1, r2 = (_sums(x1 * y * inside, start).astype(float) for y in (x1, x, x2))
    s11, s22 = r0, _sums(x2 * x2 * inside, start).astype(float)
    t2 = _sums(x * x2 * inside, start).astype(float)
    det = s11 * s22 - r2 * r2
    safe = np.where(det > 0, det, 1)
    limit = (1 << (_PRECISION - 1)) - 1
    c1, c2 = (np.clip(np.round(np.where(det > 0, c / safe, 0) * (1 << _SHIFT)), -limit, limit).astype(np.int32) for c in (r1 * s22 - t2 * r2, t2 * s11 - r1 * r2))
    best_bits, kind = 8 * n, np.zeros(len(n), np.int64)  # verbatim
    rice, zig = np.zeros(len(n), np.int64), np.zeros(len(x), np.int32)
    for choice, order, guess in ((1, 1, x1), (2, 2, (np.repeat(c1, n) * x1 + np.repeat(c2, n) * x2) >> _SHIFT)):
        e = x - guess
        u = ((e << 1) ^ (e >> 31)) * (place >= order)
        count = n - order
        mean = _sums(u, start) / np.maximum(count, 1)
        k = np.clip(np.floor(np.log2(np.maximum(mean, 1) * 0.75 + 0.25)), 0, 14).astype(np.int64)
        bits = _sums(u >> np.repeat(k.astype(np.int32), n), start) + count * (1 + k) + 8 * order + 10 + (choice == 2) * (9 + 2 * _PRECISION)
        better = (bits < best_bits) & (count > 0)
        best_bits, kind, rice = np.where(better, bits, best_bits), np.where(better, choice, kind), np.where(better, k, rice)
        zig = np.where(np.repeat(better, n), u, zig)
    headers = [_frame_header(i, len(p)) for _, i, p in parts]
    head = np.array([len(h) for h in headers])
    size = head + 1 + -(-best_bits // 8) + 2
    begin = np.cumsum(size) - size
    # All that is written but for headers and verbatim samples, as values and the bits behind their last one.
    values, stops = [], []

    def put(rows, at, value, width):
        values.append(np.broadcast_to(value, len(rows)).astype(np.int32))
        stops.append((at + width).astype(np.int32))

    at = (begin + head) * 8
    put(at, at, np.array([0x02, 0x12, 0x42])[kind], 8)
    at += 8
    for j in range(2):
        rows = np.flatnonzero(kind > j)
        put(rows, at[rows], x[start[rows] + j] & 0xFF, 8)
        at[rows] += 8
    rows = np.flatnonzero(kind == 2)
    put(rows, at[rows], (_PRECISION - 1) << 5 | _SHIFT, 9)
    for j, c in enumerate((c1, c2)):
        put(rows, at[rows] + 9 + j * _PRECISION, c[rows] & ((1 << _PRECISION) - 1), _PRECISION)
    at[rows] += 9 + 2 * _PRECISION
    rows = np.flatnonzero(kind > 0)
    put(rows, at[rows] + 6, rice[rows], 4)
    at += 10
    count = np.where(kind > 0, n - kind, 0)
    coded = (place >= np.repeat(kind.astype(np.int32), n)) & np.repeat(kind > 0, n)
    u, k = zig[coded], np.repeat(rice.astype(np.int32), count)
    ends = np.cumsum((u >> k) + 1 + k, dtype=np.int32)
    before = np.concatenate([[0], ends])[np.cumsum(count) - count]
    ends += np.repeat((at - before).astype(np.int32), count)
    values.append((u & ((1 << k) - 1)) | (1 << k))  # the remainder after its one; the zeros before it are there
    stops.append(ends)
    stop = np.concatenate(stops)
    value = np.concatenate(values) << (-stop & 7)
    byte, total = (stop - 1) >> 3, int(size.sum())
    flat = np.bincount(byte, value & 0xFF, total)
    value >>= 8
    flat += np.bincount(byte - 1, value & 0xFF, total)
    flat = (flat + np.bincount(byte - 2, value >> 8, total)).astype(np.uint8)
    for i in np.flatnonzero(kind == 0):
        low = begin[i] + head[i] + 1
        flat[low : low + n[i]] = np.frombuffer(parts[i][2], np.uint8) ^ 0x80
    for b, h in zip(begin.tolist(), headers, strict=True):
        flat[b : b + len(h)] = np.frombuffer(h, np.uint8)
    check = crc16(flat, begin, size - 2)
    flat[begin + size - 2], flat[begin + size - 1] = check >> 8, check & 0xFF
    data = flat.tobytes()
    return [data[b : b + s] for b, s in zip(begin.tolist(), size.tolist(), strict=True)]


# ---------------------------------------------------------------- decoding


def parse(stream: bytes) -> dict:
    """STREAMINFO, the seek points and where the frames begin."""
    if stream[:4] != b"fLaC":
        raise FlacError("no FLAC stream")
    at, last, points, info = 4, False, [], None
    while not last:
        if at + 4 > len(stream):
            raise FlacError("the metadata ends early")
        last, kind, size = stream[at] >> 7, stream[at] & 0x7F, int.from_bytes(stream[at + 1 : at + 4], "big")
        body = stream[at + 4 : at + 4 + size]
        if kind == 0:
            packed = int.from_bytes(body[10:18], "big")
            info = {"block": int.from_bytes(body[2:4], "big"), "rate": packed >> 44, "channels": (packed >> 41 & 7) + 1, "bits": (packed >> 36 & 31) + 1, "samples": packed & (1 << 36) - 1, "md5": body[18:34]}
        elif kind == 3:
            points = [(int.from_bytes(body[i : i + 8], "big"), int.from_bytes(body[i + 8 : i + 16], "big"), int.from_bytes(body[i + 16 : i + 18], "big")) for i in range(0, size, 18)]
            points = [p for p in points if p[0] != (1 << 64) - 1]
        at += 4 + size
    if info is None or info["channels"] != 1 or info["bits"] != 8:
        raise FlacError("only 8-bit mono is stored here")
    if not points and 0 < info["samples"] <= info["block"]:
        points = [(0, 0, info["samples"])]
    return info | {"points": points, "at": at}


#: The format's codes of common block sizes.
BLOCK_SIZES = {1: 192, 2: 576, 3: 1152, 4: 2304, 5: 4608, 8: 256, 9: 512, 10: 1024, 11: 2048, 12: 4096, 13: 8192, 14: 16384, 15: 32768}


def _header(data: bytes, at: int) -> tuple[int, int]:
    """Length of the frame header at ``at`` and the frame's number of samples; its CRC-8 is verified."""
    if data[at : at + 2] not in (b"\xff\xf8", b"\xff\xf9"):
        raise FlacError("no frame where one should begin")
    code, rate = data[at + 2] >> 4, data[at + 2] & 15
    lead = data[at + 4]
    i = at + 4 + max(1, 8 - (lead ^ 0xFF).bit_length())
    if code in (6, 7):
        samples = int.from_bytes(data[i : i + code - 5], "big") + 1
        i += code - 5
    elif code in BLOCK_SIZES:
        samples = BLOCK_SIZES[code]
    else:
        raise FlacError("a reserved block size")
    i += {12: 1, 13: 2, 14: 2}.get(rate, 0)
    if crc8(data[at:i]) != data[i]:
        raise FlacError("a frame header's CRC-8 is wrong")
    return i + 1 - at, samples


def decode(streams: list[bytes]) -> list[bytes]:
    """The payload of each stream, all checks passed."""
    out: list[bytes] = []
    group: list[bytes] = []
    held = 0
    for s in streams:
        group.append(s)
        held += len(s)
        if held >= BATCH:
            out += _decode_group(group)
            group, held = [], 0
    return out + _decode_group(group) if group else out


def _decode_group(streams: list[bytes]) -> list[bytes]:
    infos = [parse(s) for s in streams]
    spans, whole = [], {}
    for d, (s, info) in enumerate(zip(streams, infos, strict=True)):
        covered = sum(p[2] for p in info["points"]) == info["samples"]
        if covered:
            offsets = [info["at"] + p[1] for p in info["points"]] + [len(s)]
            spans += [(d, a, b) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        else:
            whole[d] = _walk(s, info["at"])
    got: list[list[bytes]] = [[] for _ in streams]
    for low in range(0, len(spans), 2 * BATCH // BLOCK):
        part = spans[low : low + 2 * BATCH // BLOCK]
        for (d, *_), pcm in zip(part, decode_frames([streams[d][a:b] for d, a, b in part]), strict=True):
            got[d].append(pcm)
    out = []
    for d, info in enumerate(infos):
        pcm = whole[d] if d in whole else b"".join(got[d])
        signed = (np.frombuffer(pcm, np.uint8) ^ 0x80).tobytes()
        if len(pcm) != info["samples"] or hashlib.md5(signed).digest() != info["md5"]:
            raise FlacError("the samples are not those that were stored")
        out.append(pcm)
    return out


def read_ranges(streams: list[bytes], firsts: list[int], count: int) -> list[bytes]:
    """Samples first .. first+count-1 of each stream as payload bytes, found by the seek tables; only the frames that
    hold them are decoded, those of all streams in step."""
    frames: list[bytes] = []
    places = []
    for stream, first in zip(streams, firsts, strict=True):
        info = parse(stream)
        points = info["points"]
        ends = ([p[1] for p in points] + [len(stream) - info["at"]])[1:]
        need = [(p, e) for p, e in zip(points, ends, strict=True) if p[0] < first + count and p[0] + p[2] > first]
        places.append((len(frames), len(need), first - need[0][0][0] if need else 0))
        frames += [stream[info["at"] + p[1] : info["at"] + e] for p, e in need]
    pcm = decode_frames(frames)
    return [b"".join(pcm[at : at + n])[low : low + count] for at, n, low in places]


_LEADING = np.array([16 - int(i).bit_length() for i in range(1 << 16)], np.int64)


def decode_frames(frames: list[bytes]) -> list[bytes]:
    """Payload bytes of each whole frame; CRC-8 and CRC-16 are verified."""
    if not frames:
        return []
    size = np.array([len(f) for f in frames])
    if size.min() < 9:
        raise FlacError("a frame ends early")
    data = b"".join(frames)
    begin = np.cumsum(size) - size
    flat = np.frombuffer(data + b"\0" * 16, np.uint8)
    check = crc16(flat, begin, size - 2)
    if np.any(check != (flat[begin + size - 2].astype(np.uint16) << 8 | flat[begin + size - 1])):
        raise FlacError("a frame's CRC-16 is wrong")
    heads = [_header(data, b) for b in begin.tolist()]
    n = np.array([h[1] for h in heads])
    sub = begin + np.array([h[0] for h in heads])
    kind = flat[sub] >> 1
    out = np.zeros(int(n.sum()), np.int16)
    start = np.cumsum(n) - n
    order = np.where(kind >= 32, kind - 31, np.where((kind >= 8) & (kind <= 12), kind - 8, 0)).astype(np.int64)
    window = np.ndarray((len(flat) - 7,), ">u8", flat, 0, (1,))

    def get(at, width):
        return (window[at >> 3].astype(np.uint64) << (at & 7).astype(np.uint64)) >> np.asarray(64 - width).astype(np.uint64)

    at = (sub + 1) * 8
    plain = flat[sub] & 1 == 0
    predicted = plain & (order > 0) | plain & (kind == 8)
    linear = predicted & (kind >= 32)
    after = at + 8 * order
    precision = np.where(linear, get(after, 4).astype(np.int64) + 1, 0)
    shift = np.where(linear, get(after + 4, 5).astype(np.int64), 0)
    rice_at = after + np.where(linear, 9 + precision * order, 0)
    simple = predicted & (get(rice_at, 6) == 0) & (order <= 4) & (shift < 16)
    rice = get(rice_at + 6, 4).astype(np.int64)
    simple &= rice <= 12
    odd = np.flatnonzero(~simple)
    for i in odd.tolist():
        if kind[i] == 1 and plain[i]:
            out[start[i] : start[i] + n[i]] = flat[sub[i] + 1 : sub[i] + 1 + n[i]].astype(np.int8)
        else:
            out[start[i] : start[i] + n[i]] = _scalar(data, int(at[i]) - 8, int(n[i]))
    rows = np.flatnonzero(simple)
    rows = rows[np.argsort(-(n - order)[rows], kind="stable")]
    if len(rows):
        _in_step(flat, window, get, out, rows, *(a[rows] for a in (kind, order, n, start, at, after, precision, shift, rice_at, rice)))
    return [b for b in _split((out + 128).astype(np.uint8).tobytes(), start, n)]


def _split(data: bytes, start: np.ndarray, n: np.ndarray):
    for b, c in zip(start.tolist(), n.tolist(), strict=True):
        yield data[b : b + c]


def _in_step(flat, window, get, out, rows, kind, order, n, start, at, after, precision, shift, rice_at, k):
    k = k.copy()
    taps = max(1, int(order.max()))
    coefficient, history = np.zeros((taps, len(rows)), np.int64), np.zeros((taps, len(rows)), np.int64)
    for t in range(taps):
        for o in range(t + 1, 5):
            coefficient[t, (kind == 8 + o)] = FIXED[o][t]
        lin = np.flatnonzero((kind >= 32) & (order > t))
        p = precision[lin]
        c = get(after[lin] + 9 + t * p, p).astype(np.int64)
        coefficient[t, lin] = np.where(c >> (p - 1) > 0, c - (1 << p), c)
        warm = np.flatnonzero(order > t)
        value = get(at[warm] + 8 * t, 8).astype(np.uint8).astype(np.int8)
        out[start[warm] + t] = value
        history[order[warm] - 1 - t, warm] = value
    left = n - order
    falling = -left
    to, p = start + order, rice_at + 10
    rest, one = (63 - k).astype(np.uint64), np.uint64(1)
    active = np.append(np.searchsorted(falling, -np.arange(int(left.max(initial=0)))), [0, 0]).tolist()
    for i in range(0, len(active) - 2, 2):  # a 64-bit window holds two code words
        a = active[i]
        pos = p[:a]
        win = window[pos >> 3].astype(np.uint64)
        win <<= (pos & 7).view(np.uint64)
        for j in (i, i + 1):
            a = active[j]
            if a == 0:
                break
            pos, win = p[:a], win[:a]
            q = _LEADING[win >> np.uint64(48)]
            if q.max() == 16:
                long = np.flatnonzero(q == 16)
                q[long] = _unary(flat, pos[long])
                far = pos[long] + q[long]
                win[long] = (window[far >> 3].astype(np.uint64) << (far & 7).view(np.uint64)) << one
                near = np.flatnonzero(q < 16)
                win[near] <<= q[near].view(np.uint64) + one
            else:
                long = None
                win <<= (q + 1).view(np.uint64)
            e = ((win >> one) >> rest[:a]).view(np.int64)
            e |= q << k[:a]
            sign = -(e & 1)
            e >>= 1
            e ^= sign
            guess = coefficient[0, :a] * history[0, :a]
            for t in range(1, taps):
                guess += coefficient[t, :a] * history[t, :a]
            guess >>= shift[:a]
            e += guess
            for t in range(taps - 1, 0, -1):
                history[t, :a] = history[t - 1, :a]
            history[0, :a] = e
            out[to[:a] + j] = e
            q += 1
            q += k[:a]
            pos += q
            if long is not None:
                win = window[pos >> 3].astype(np.uint64) << (pos & 7).view(np.uint64)
            else:
                win <<= k[:a].view(np.uint64)


def _unary(flat: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Zero bits before the next one, for runs of 16 and more."""
    out = np.empty(len(at), np.int64)
    for j, p in enumerate(at.tolist()):
        n = p
        while n < len(flat) * 8 and not flat[n >> 3] >> (7 - (n & 7)) & 1:
            n += 1
        out[j] = n - p
    return out


class _Bits:
    def __init__(self, data: bytes, at: int):
        self.data, self.at = data, at

    def take(self, width: int) -> int:
        low, high = self.at >> 3, (self.at + width + 7) >> 3
        value = int.from_bytes(self.data[low:high], "big") >> (high * 8 - self.at - width)
        self.at += width
        return value & ((1 << width) - 1)

    def signed(self, width: int) -> int:
        v = self.take(width) if width else 0
        return v - (1 << width) if width and v >> (width - 1) else v

    def unary(self) -> int:
        n = 0
        while not self.take(1):
            n += 1
            if self.at > len(self.data) * 8:
                raise FlacError("a frame ends early")
        return n


def _subframe(bits: _Bits, n: int) -> list[int]:
    """One subframe in full generality."""
    head = bits.take(8)
    kind, wasted = head >> 1 & 63, bits.unary() + 1 if head & 1 else 0
    width = 8 - wasted
    if kind == 0:
        return [bits.signed(width) << wasted] * n
    if kind == 1:
        return [bits.signed(width) << wasted for _ in range(n)]
    if 8 <= kind <= 12:
        order, shift = kind - 8, 0
        x = [bits.signed(width) for _ in range(order)]
        taps = FIXED[order]
    elif kind >= 32:
        order = kind - 31
        x = [bits.signed(width) for _ in range(order)]
        precision, shift = bits.take(4) + 1, bits.signed(5)
        taps = [bits.signed(precision) for _ in range(order)]
    else:
        raise FlacError("a reserved subframe")
    method, parts = bits.take(2), 1 << bits.take(4)
    size = 4 + method
    for part in range(parts):
        k = bits.take(size)
        raw = bits.take(5) if k == (1 << size) - 1 else None
        for _ in range(n // parts - (order if part == 0 else 0)):
            if raw is not None:
                e = bits.signed(raw)
            else:
                q = bits.unary()
                u = q << k | (bits.take(k) if k else 0)
                e = (u >> 1) ^ -(u & 1)
            guess = sum(c * x[-1 - t] for t, c in enumerate(taps))
            x.append(e + (guess >> shift))
    return [v << wasted for v in x]


def _scalar(data: bytes, at: int, n: int) -> list[int]:
    return _subframe(_Bits(data, at), n)


def _walk(stream: bytes, at: int) -> bytes:
    """Frames one after the other, where no seek table gives their places."""
    out = []
    while at < len(stream):
        head, n = _header(stream, at)
        bits = _Bits(stream, (at + head) * 8)
        x = _subframe(bits, n)
        end = (bits.at + 7) >> 3
        frame = np.frombuffer(stream[at:end], np.uint8)
        if int(crc16(frame, np.array([0]), np.array([len(frame)]))[0]) != int.from_bytes(stream[end : end + 2], "big"):
            raise FlacError("a frame's CRC-16 is wrong")
        out.append((np.array(x) + 128).astype(np.uint8).tobytes())
        at = end + 2
    return b"".join(out)
