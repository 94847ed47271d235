"""FLAC media columns (operator 10): bytes stored as mono 8-bit samples in FLAC streams, many streams coded at once.

A stream has STREAMINFO (with the samples' MD5), a SEEKTABLE with a point every SEEK_EVERY frames, and frames of BLOCK
samples. The encoder takes for each frame the shortest of: constant, verbatim, fixed predictors of order 0 to 2 and a
linear predictor of order 2 with 8-bit coefficients, with Rice-coded residuals. The decoder also reads fixed orders to
4, linear predictors to order 32, Rice partitions, both Rice parameter widths and escaped partitions; it checks each
header's CRC-8, each frame's CRC-16 and the MD5. All frames of a group of streams advance together, one sample a step,
so numpy works on thousands of frames at a time.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame

from skein.llm.common import chunks, doc_bytes, map_docs, rows_of

BLOCK, SEEK_EVERY, RATE = 192, 4, 8000
MEDIA = "doc_id long, n_bytes long, media binary"
PCM = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
BLOCKS = "doc_id long, sample long, media_offset long, pcm binary"
_LPC_SHIFT = 6


class FlacError(ValueError):
    """A stream that isn't valid, or whose checksums don't match."""


def _crc_table(poly: int, bits: int) -> np.ndarray:
    top, mask, out = 1 << bits - 1, (1 << bits) - 1, []
    for byte in range(256):
        c = byte << bits - 8
        for _ in range(8):
            c = (c << 1 ^ poly if c & top else c << 1) & mask
        out.append(c)
    return np.array(out, np.uint16)


_CRC8, _CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)
_LEADING = np.array([16 - int(i).bit_length() for i in range(1 << 16)], np.int64)


def _crc(buf: np.ndarray, starts: np.ndarray, lengths: np.ndarray, table: np.ndarray, bits: int) -> np.ndarray:
    """CRCs of many stretches of buf."""
    order = np.argsort(-lengths, kind="stable")
    at, n = starts[order], lengths[order]
    c, live = np.zeros(len(at), np.uint16), len(at)
    for i in range(int(n[0]) if len(n) else 0):
        while n[live - 1] <= i:
            live -= 1
        byte = buf[at[:live] + i]
        c[:live] = (c[:live] << 8) ^ table[(c[:live] >> 8) ^ byte] if bits == 16 else table[c[:live] ^ byte]
    out = np.empty_like(c)
    out[order] = c
    return out


def _numbered(n: int) -> bytes:
    """A frame number in FLAC's extended UTF-8."""
    if n < 0x80:
        return bytes([n])
    tail = []
    lead = 0x3F
    while n > lead:
        tail.append(0x80 | n & 0x3F)
        n >>= 6
        lead >>= 1
    return bytes([~(lead << 1 | 1) & 0xFF | n, *reversed(tail)])


def _put(bits: np.ndarray, at: np.ndarray, value, width: int) -> None:
    for b in range(width):
        bits[at + b] = value >> (width - 1 - b) & 1


def encode(payloads: list[bytes]) -> list[bytes]:
    """One stream for each payload; a payload's length is a positive multiple of BLOCK."""
    if not payloads:
        return []
    counts = np.array([len(p) // BLOCK for p in payloads])
    raw = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, BLOCK)
    x = raw.astype(np.int32) - 128
    n = len(x)
    # Candidates: order, coefficients, shift.
    c1, c2 = _linear(x)
    orders = [0, 1, 2, 2]
    residuals = [x, np.diff(x, axis=1), np.diff(x, n=2, axis=1), x[:, 2:] - ((c1[:, None] * x[:, 1:-1] + c2[:, None] * x[:, :-2]) >> _LPC_SHIFT)]
    cost, rice = np.empty((6, n), np.int64), np.empty((4, n), np.int64)
    folded = []
    for i, r in enumerate(residuals):
        u = (r << 1) ^ (r >> 31)
        folded.append(u)
        mean = u.sum(1) * 0.69 / u.shape[1]
        rice[i] = k = np.clip(np.floor(np.log2(np.maximum(mean, 1))), 0, 14).astype(np.int64)
        cost[i] = 8 + 8 * orders[i] + (25 if i == 3 else 0) + 10 + (1 + k) * u.shape[1] + (u >> k[:, None]).sum(1)
    cost[4] = 8 + 8 * BLOCK
    cost[5] = np.where((x == x[:, :1]).all(1), 16, 1 << 40)
    kind = cost.argmin(0)
    body = (cost[kind, np.arange(n)] + 7) // 8
    number = np.arange(n) - np.repeat(np.cumsum(counts) - counts, counts)
    names = [_numbered(i) for i in range(int(counts.max()))]
    name_len = np.array([len(b) for b in names])[number]
    size = 4 + name_len + 1 + body + 2
    ends = np.cumsum(size)
    start = ends - size
    out = np.zeros(int(ends[-1]), np.uint8)
    # Frame headers: sync and fixed blocks, 192 samples at 8 kHz, mono of 8 bits.
    for i, b in enumerate((0xFF, 0xF8, 0x14, 0x02)):
        out[start + i] = b
    for i in range(int(name_len.max())):
        own = np.array([b[i] if i < len(b) else 0 for b in names], np.uint8)
        has = name_len > i
        out[start[has] + 4 + i] = own[number[has]]
    at = start + 4 + name_len
    out[at] = _crc(out, start, 4 + name_len, _CRC8, 8)
    at = at + 1
    verbatim, constant = np.flatnonzero(kind == 4), np.flatnonzero(kind == 5)
    coded = np.flatnonzero(kind < 4)
    if len(coded):
        at_bit = np.zeros(n, np.int64)
        at_bit[coded] = np.cumsum(body[coded] * 8) - body[coded] * 8
        bits = np.zeros(int(body[coded].sum()) * 8, np.uint8)
        for i in range(4):
            f = np.flatnonzero(kind == i)
            if not len(f):
                continue
            p, order, k = at_bit[f], orders[i], rice[i][f]
            _put(bits, p, np.full(len(f), (8 + order if i < 3 else 32 + order - 1) << 1), 8)
            p = p + 8
            for w in range(order):
                _put(bits, p, raw[f, w].astype(np.int64) ^ 128, 8)
                p = p + 8
            if i == 3:
                _put(bits, p, np.full(len(f), 7 << 5 | _LPC_SHIFT), 9)
                _put(bits, p + 9, c1[f].astype(np.int64) & 255, 8)
                _put(bits, p + 17, c2[f].astype(np.int64) & 255, 8)
                p = p + 25
            _put(bits, p, k, 10)
            p = p + 10
            u = folded[i][f].astype(np.int64)
            q = u >> k[:, None]
            length = q + 1 + k[:, None]
            stop = p[:, None] + np.cumsum(length, 1) - k[:, None] - 1
            bits[stop] = 1
            for b in range(int(k.max())):
                has = np.flatnonzero(k > b)
                if len(has) == len(f):
                    bits[stop + 1 + b] = u >> (k - 1 - b)[:, None] & 1
                else:
                    bits[stop[has] + 1 + b] = u[has] >> (k[has] - 1 - b)[:, None] & 1
        packed = np.packbits(bits)
        n_coded = body[coded]
        into = np.repeat(at[coded] - (np.cumsum(n_coded) - n_coded), n_coded) + np.arange(len(packed))
        out[into] = packed
    out[at[verbatim]] = 2
    out[at[verbatim][:, None] + 1 + np.arange(BLOCK)] = raw[verbatim] ^ 128
    out[at[constant] + 1] = raw[constant, 0] ^ 128
    crc = _crc(out, start, size - 2, _CRC16, 16)
    out[ends - 2], out[ends - 1] = crc >> 8, crc & 255
    streams, first = [], 0
    for payload, count in zip(payloads, counts.tolist(), strict=True):
        a, b = int(start[first]), int(ends[first + count - 1])
        points = range(0, count, SEEK_EVERY)
        table = b"".join(struct.pack(">QQH", i * BLOCK, int(start[first + i]) - a, BLOCK) for i in points)
        sizes = size[first : first + count]
        info = struct.pack(">HH", BLOCK, BLOCK) + int(sizes.min()).to_bytes(3, "big") + int(sizes.max()).to_bytes(3, "big")
        info += (RATE << 44 | 0 << 41 | 7 << 36 | count * BLOCK).to_bytes(8, "big") + hashlib.md5(_signed(payload)).digest()
        streams.append(b"fLaC\x00" + len(info).to_bytes(3, "big") + info + b"\x83" + len(table).to_bytes(3, "big") + table + out[a:b].tobytes())
        first += count
    return streams


_FLIP = bytes(b ^ 128 for b in range(256))


def _signed(payload: bytes) -> bytes:
    """8-bit samples as FLAC has them: two's complement."""
    return payload.translate(_FLIP)


def _linear(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients of the order-2 predictor of each row, as 8-bit integers over 2 ** _LPC_SHIFT."""
    r0, r1, r2 = ((x[:, 2 - k : BLOCK - k] * x[:, 2:]).sum(1).astype(np.float64) for k in range(3))
    det = r0 * r0 - r1 * r1
    with np.errstate(divide="ignore", invalid="ignore"):
        a = np.where(det > 0, r1 * (r0 - r2) / det, 0), np.where(det > 0, (r0 * r2 - r1 * r1) / det, 0)
    return tuple(np.clip(np.rint(v * (1 << _LPC_SHIFT)), -128, 127).astype(np.int32) for v in a)


def _metadata(stream: bytes) -> tuple[bytes, int, list[tuple[int, int]], int]:
    """STREAMINFO's MD5, number of samples, seek points (sample, offset in the frames), and where the frames start."""
    if stream[:4] != b"fLaC":
        raise FlacError("no fLaC marker")
    at, last, info, points = 4, False, None, []
    while not last:
        if at + 4 > len(stream):
            raise FlacError("metadata is cut short")
        last, kind, n = stream[at] >> 7, stream[at] & 127, int.from_bytes(stream[at + 1 : at + 4], "big")
        block = stream[at + 4 : at + 4 + n]
        if kind == 0:
            info = block
        elif kind == 3:
            if len(block) % 18:
                raise FlacError("the seek table is cut short")
            points = [(s, o) for s, o, _ in struct.iter_unpack(">QQH", block) if s < (1 << 64) - 1]
        at += 4 + n
    if info is None or len(info) < 34:
        raise FlacError("no STREAMINFO")
    fields = int.from_bytes(info[10:18], "big")
    if fields >> 36 & 31 != 7 or fields >> 41 & 7 != 0 or info[:2] != struct.pack(">H", BLOCK):
        raise FlacError("only mono streams of 8 bits in blocks of 192 samples")
    return info[18:34], fields & (1 << 36) - 1, points, at


class _Bits:
    """Reads at many bit positions at once."""

    def __init__(self, data: bytes):
        b = np.frombuffer(data + bytes(16), np.uint8)
        self.end = len(data) * 8
        self.word = np.zeros(len(b) - 8, np.uint64)
        for i in range(8):
            self.word |= b[i : len(b) - 8 + i].astype(np.uint64) << np.uint64(56 - 8 * i)
        self.byte = b

    def window(self, p: np.ndarray) -> np.ndarray:
        """57 bits or more from p, at the top."""
        if p.size and int(p.max()) >= self.end + 64:
            raise FlacError("a frame is cut short")
        return self.word[p >> 3] << (p & 7).astype(np.uint64)

    def get(self, p: np.ndarray, width) -> np.ndarray:
        """width (up to 32) bits from p, unsigned."""
        return (self.window(p) >> np.uint64(1) >> (63 - np.asarray(width)).astype(np.uint64)).astype(np.int64)

    def zeros(self, p: np.ndarray) -> np.ndarray:
        """Zero bits before the next one bit."""
        n = _LEADING[(self.window(p) >> np.uint64(48)).astype(np.int64)]
        if (more := np.flatnonzero(n == 16)).size:
            n[more] += self.zeros(p[more] + 16)
        return n


def _sign(v: np.ndarray, width) -> np.ndarray:
    half = np.left_shift(1, np.maximum(np.asarray(width) - 1, 0))
    return np.where(np.asarray(width) > 0, (v ^ half) - half, 0)


#: Fixed values of the format: coefficients of the fixed predictors, newest sample first.
_FIXED = np.array([[0, 0, 0, 0], [1, 0, 0, 0], [2, -1, 0, 0], [3, -3, 1, 0], [4, -6, 4, -1]], np.int64)


def _frames(bits: _Bits, at: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Decodes a frame at each byte offset of at; gives the samples and the offsets behind the frames."""
    byte, n = bits.byte, len(at)
    if int(at.max()) + 16 > bits.end // 8 + 8:
        raise FlacError("a frame is cut short")
    if not ((byte[at] == 0xFF) & (byte[at + 1] == 0xF8) & (byte[at + 2] == 0x14) & (byte[at + 3] == 0x02)).all():
        raise FlacError("a frame header isn't as expected")
    lead = byte[at + 4].astype(np.int64)
    ones = np.array([8 - int(255 ^ i).bit_length() for i in range(256)])[lead]
    length = np.maximum(ones, 1)
    named = np.where(ones == 0, lead, lead & (0x7F >> np.minimum(ones, 7)))
    for i in range(1, int(length.max())):
        named = np.where(length > i, named << 6 | byte[at + 4 + np.minimum(i, length - 1)] & 0x3F, named)
    if (named != number).any():
        raise FlacError("a frame has another number")
    if (_crc(byte, at, 4 + length, _CRC8, 8) != byte[at + 4 + length]).any():
        raise FlacError("a header's CRC-8 doesn't match")
    p = (at + 5 + length) * 8
    kind = bits.get(p, 8)
    if (kind & 0x81).any():
        raise FlacError("padding or wasted bits in a subframe header")
    kind >>= 1
    p = p + 8
    x = np.zeros((n, BLOCK), np.int64)
    for i in np.flatnonzero(kind == 0):
        x[i] = int(_sign(bits.get(p[i : i + 1], 8), 8)[0])
    p = p + np.where(kind == 0, 8, 0)
    if (v := np.flatnonzero(kind == 1)).size:
        x[v] = byte[(p[v] >> 3)[:, None] + np.arange(BLOCK)].view(np.int8)
        p[v] += 8 * BLOCK
    coded = np.flatnonzero(kind > 1)
    if coded.size:
        x[coded], p[coded] = _predicted(bits, p[coded], kind[coded])
    end = (p + 7) // 8
    if (_crc(byte, at, end - at, _CRC16, 16) != byte[end].astype(np.uint16) << 8 | byte[end + 1]).any():
        raise FlacError("a frame's CRC-16 doesn't match")
    return x.astype(np.int8), end + 2


def _predicted(bits: _Bits, p: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    linear = kind >= 32
    if ((kind < 8) | (kind > 12) & ~linear).any():
        raise FlacError("a reserved subframe type")
    n, order = len(p), np.where(linear, kind - 31, kind - 8)
    most = int(order.max())
    width = max(most, 4)
    x = np.zeros((n, width + BLOCK), np.int64)  # `width` zeros stand before the samples
    for i in range(most):
        has = order > i
        x[has, width + i] = _sign(bits.get(p[has], 8), 8)
        p = p + 8 * has
    taps, shift = np.zeros((n, width), np.int64), np.zeros(n, np.int64)
    taps[~linear, :4] = _FIXED[order[~linear]]
    if (f := np.flatnonzero(linear)).size:
        precision = bits.get(p[f], 4) + 1
        shift[f] = bits.get(p[f] + 4, 5)
        q = p[f] + 9
        for i in range(int(order[f].max())):
            has = order[f] > i
            taps[f[has], i] = _sign(bits.get(q[has], precision[has]), precision[has])
            q = q + np.where(has, precision, 0)
        p[f] = q
    used = max(1, int(np.flatnonzero(taps.any(0)).max(initial=0)) + 1)
    wide = bits.get(p, 2)
    if (wide > 1).any():
        raise FlacError("a reserved residual coding")
    parts = np.left_shift(1, bits.get(p + 2, 4))
    if (BLOCK % parts).any():
        raise FlacError("partitions don't fit the block")
    span = BLOCK // parts
    p = p + 6
    k, raw = np.zeros(n, np.int64), np.full(n, -1)
    single = bool((parts == 1).all() and (order == order[0]).all())
    for i in range(BLOCK):
        fresh = np.flatnonzero((i == order) if i < most or single else (i % span == 0) | (i == order)) if not single or i == order[0] else ()
        if not single and i < most:
            fresh = np.flatnonzero((i >= order) & ((i % span == 0) | (i == order)))
        if len(fresh):
            own = wide[fresh]
            k[fresh] = bits.get(p[fresh], 4 + own)
            escaped = k[fresh] == np.where(own == 1, 31, 15)
            p[fresh] += 4 + own
            raw[fresh] = np.where(escaped, bits.get(p[fresh], 5), -1)
            p[fresh] += 5 * escaped
        live = slice(None) if i >= most else np.flatnonzero(order <= i)
        at, low = p[live], k[live]
        w = bits.word[at >> 3] << (at & 7).astype(np.uint64)
        q = _LEADING[(w >> np.uint64(48)).astype(np.int64)]
        if (q == 16).any() or (raw[live] >= 0).any():
            q = np.where(raw[live] >= 0, 0, 0)
            plain = np.flatnonzero(raw[live] < 0)
            q[plain] = bits.zeros(at[plain])
            u = q << low | bits.get(at + q + 1, low)
            r = (u >> 1) ^ -(u & 1)
            esc = np.flatnonzero(raw[live] >= 0)
            r[esc] = _sign(bits.get(at[esc], raw[live][esc]), raw[live][esc])
            step = q + 1 + low
            step[esc] = raw[live][esc]
        else:
            u = q << low | (w << (q + 1).astype(np.uint64) >> np.uint64(1) >> (63 - low).astype(np.uint64)).astype(np.int64)
            r = (u >> 1) ^ -(u & 1)
            step = q + 1 + low
        p[live] = at + step
        guess = taps[live, 0] * x[live, width + i - 1]
        for t in range(1, used):
            guess = guess + taps[live, t] * x[live, width + i - 1 - t]
        x[live, width + i] = r + (guess >> shift[live])
        if not i & 31 and int(p.max()) > bits.end:
            raise FlacError("a frame is cut short")
    if int(p.max()) > bits.end:
        raise FlacError("a frame is cut short")
    return x[:, width:], p


def decode(streams: list[bytes]) -> list[bytes]:
    """The payloads of streams; FlacError if one is damaged."""
    if not streams:
        return []
    meta = [_metadata(s) for s in streams]
    at, number, count, out_at = [], [], [], []
    base = frames = 0
    for s, (_, samples, points, first) in zip(streams, meta, strict=True):
        if samples % BLOCK:
            raise FlacError("the last block is short")
        total = samples // BLOCK
        points = points if points and points[0] == (0, 0) else [(0, 0)]
        if not total or any(b[0] <= a[0] or b[0] % BLOCK for a, b in zip(points, points[1:])) or points[-1][0] >= samples or max(o for _, o in points) >= len(s) - first:
            raise FlacError("the seek table doesn't fit the stream")
        for i, (sample, offset) in enumerate(points):
            stop = points[i + 1][0] // BLOCK if i + 1 < len(points) else total
            at.append(base + first + offset)
            number.append(sample // BLOCK)
            count.append(stop - sample // BLOCK)
            out_at.append(frames + sample // BLOCK)
        base, frames = base + len(s), frames + total
    bits = _Bits(b"".join(streams))
    at, number, count, out_at = (np.array(v, np.int64) for v in (at, number, count, out_at))
    out = np.zeros((frames, BLOCK), np.int8)
    for i in range(int(count.max())):
        live = np.flatnonzero(count > i)
        out[out_at[live] + i], at[live] = _frames(bits, at[live], number[live] + i)
    flat, payloads, done = out.tobytes(), [], 0
    for md5, samples, _, _ in meta:
        own = flat[done : done + samples]
        done += samples
        if hashlib.md5(own).digest() != md5:
            raise FlacError("the MD5 of the samples doesn't match")
        payloads.append(own.translate(_FLIP))
    return payloads


def pad(text: bytes) -> bytes:
    """Bytes 32 up to a positive multiple of BLOCK."""
    return text + b" " * (-len(text) % BLOCK if text else BLOCK)


def to_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and the text's bytes, padded, as a FLAC stream. Null and empty texts are one block of spaces."""

    def work(batches) -> Iterator[dict]:
        for group in chunks(rows_of(batches, "doc_id", "text")):
            yield {"doc_id": [d for d, _ in group], "n_bytes": [len(t) for _, t in group], "media": encode([pad(t) for _, t in group])}

    return map_docs(doc_bytes(docs), work, MEDIA)


def describe(pcm: bytes) -> str:
    """Peak, root mean square and zero crossings of signed 8-bit samples."""
    x = np.frombuffer(pcm, np.uint8).astype(np.int64) - 128
    crossings = int(((x[1:] < 0) != (x[:-1] < 0)).sum())
    return f"peak={int(np.abs(x).max())};rms={(int((x * x).sum()) / len(x)) ** 0.5:.4f};crossings={crossings}"


def media_features(media: DataFrame) -> DataFrame:
    """Reads streams back, with all checks, and describes the samples. A damaged stream fails the task (FlacError)."""

    def work(batches) -> Iterator[dict]:
        for group in chunks(rows_of(batches, "doc_id", "n_bytes", "media"), size=lambda r: len(r[2])):
            streams = [m for _, _, m in group]
            payloads = decode(streams)
            yield {
                "doc_id": [d for d, _, _ in group],
                "n_bytes": [n for _, n, _ in group],
                "payload_bytes": [len(p) for p in payloads],
                "payload_sha256": [hashlib.sha256(p).hexdigest() for p in payloads],
                "tail_crc32": [zlib.crc32(p[-16:]) for p in payloads],
                "media_bytes": [len(s) for s in streams],
                "media_sha256": [hashlib.sha256(s).hexdigest() for s in streams],
                "feature": [describe(p) for p in payloads],
            }

    return map_docs(media, work, PCM)


def pcm_blocks(media: DataFrame) -> DataFrame:
    """PCM blocks with seekable offsets: doc_id, first sample, the seek point's offset in the frames, unsigned samples."""

    def work(batches) -> Iterator[dict]:
        for group in chunks(rows_of(batches, "doc_id", "media"), size=lambda r: len(r[1])):
            for (doc_id, stream), pcm in zip(group, decode([m for _, m in group]), strict=True):
                points = _metadata(stream)[2]
                stops = [s for s, _ in points[1:]] + [len(pcm)]
                yield {"doc_id": [doc_id] * len(points), "sample": [s for s, _ in points], "media_offset": [o for _, o in points], "pcm": [pcm[a:b] for (a, _), b in zip(points, stops, strict=True)]}

    return map_docs(media, work, BLOCKS)
