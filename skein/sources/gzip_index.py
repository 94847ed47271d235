"""Random access to gzip streams: members, restart points at block ends, and decoding from a restart point.

zlib does the decoding. Python's module has no way to stop at block ends or to start inside a byte, so restart points use
the system's libz through ctypes; where it is missing, range reads decode from the member's start instead.
"""

from __future__ import annotations

import bisect
import ctypes
import ctypes.util
import functools
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

SPAN = 1 << 22
WINDOW = 1 << 15
#: Bytes that go into a decoder, and come out of it, at once.
STEP = 1 << 18
#: Fixed values of zlib's interface.
BLOCK, _Z_OK, STREAM_END, _Z_BUF_ERROR = 5, 0, 1, -5
_FHCRC, _FEXTRA, _FNAME, _FCOMMENT = 2, 4, 8, 16
_NAME_LIMIT = 512


class GzipError(ValueError):
    """A stream that isn't valid gzip."""


@dataclass
class Member:
    member: int
    start: int  # of the header
    data: int  # of the compressed data
    out: int  # uncompressed bytes before this member
    name: str | None = None
    comment: str | None = None
    extra: bytes | None = None
    mod_time: int | None = None
    os: int | None = None
    crc32: int = 0
    isize: int = 0
    end: int = 0


@dataclass
class RestartPoint:
    """Decoding can start at bit `bits` before byte `into` with this history; `out` bytes of output are before it."""

    into: int
    out: int
    bits: int
    value: int
    history: bytes = field(repr=False)


def read_header(data: bytes, at: int = 0) -> tuple[dict, int]:
    """A member's header fields and where its compressed data starts."""
    if len(data) - at < 10 or data[at : at + 3] != b"\x1f\x8b\x08":
        raise GzipError("no gzip header")
    flags, mtime, os = data[at + 3], struct.unpack_from("<I", data, at + 4)[0], data[at + 9]
    out: dict = {"mod_time": mtime or None, "os": None if os == 255 else os, "extra": None, "name": None, "comment": None}
    p = at + 10
    try:
        if flags & _FEXTRA:
            n = struct.unpack_from("<H", data, p)[0]
            out["extra"] = data[p + 2 : p + 2 + n]
            if len(out["extra"]) < n:
                raise GzipError("the header is cut short")
            p += 2 + n
        for flag, name in ((_FNAME, "name"), (_FCOMMENT, "comment")):
            if flags & flag:
                stop = data.find(b"\0", p, p + _NAME_LIMIT)
                if stop < 0:
                    raise GzipError(f"the {name} has no end")
                out[name] = data[p:stop].decode("latin-1")
                p = stop + 1
        if flags & _FHCRC:
            if struct.unpack_from("<H", data, p)[0] != zlib.crc32(data[at:p]) & 0xFFFF:
                raise GzipError("the header's checksum doesn't match")
            p += 2
    except struct.error:
        raise GzipError("the header is cut short") from None
    return out, p


def _pieces(data: bytes, at: int, ends: list[int]) -> Iterator[bytes]:
    """Output of the raw stream at a place, in pieces; where it ended is added to ends."""
    z, rest = zlib.decompressobj(-15), b""
    while not z.eof:
        if not rest:
            rest = data[at : at + STEP]
            at += len(rest)
        try:
            piece = z.decompress(rest, STEP)
        except zlib.error as e:
            raise GzipError(str(e)) from None
        rest = z.unconsumed_tail
        if piece:
            yield piece
        elif not z.eof and not rest and at >= len(data):
            raise GzipError("the stream is cut short")
    ends.append(at - len(z.unused_data))


def read_members(data: bytes, multi: bool = True, keep: bool = True) -> Iterator[tuple[Member, bytes]]:
    """Each member with its content (empty if it isn't to be kept); size and CRC-32 are verified. No members in empty input."""
    at, out, i = 0, 0, 0
    while at < len(data):
        header, start = read_header(data, at)
        crc, size, held, ends = 0, 0, [], []
        for piece in _pieces(data, start, ends):
            crc, size = zlib.crc32(piece, crc), size + len(piece)
            if keep:
                held.append(piece)
        end = ends[0]
        if len(data) - end < 8:
            raise GzipError("the stream is cut short")
        want_crc, want_size = struct.unpack_from("<II", data, end)
        if want_crc != crc or want_size != size & 0xFFFFFFFF:
            raise GzipError("checksum or size doesn't match")
        yield Member(i, at, start, out, crc32=crc, isize=want_size, end=end + 8, **header), held[0] if len(held) == 1 else b"".join(held)
        at, out, i = end + 8, out + size, i + 1
        if not multi:
            return


class _Stream(ctypes.Structure):
    _fields_ = [
        ("next_in", ctypes.c_void_p), ("avail_in", ctypes.c_uint), ("total_in", ctypes.c_ulong),
        ("next_out", ctypes.c_void_p), ("avail_out", ctypes.c_uint), ("total_out", ctypes.c_ulong),
        ("msg", ctypes.c_char_p), ("state", ctypes.c_void_p), ("zalloc", ctypes.c_void_p), ("zfree", ctypes.c_void_p), ("opaque", ctypes.c_void_p),
        ("data_type", ctypes.c_int), ("adler", ctypes.c_ulong), ("reserved", ctypes.c_ulong),
    ]


@functools.cache
def libz():
    """The system's libz, or None."""
    for name in (ctypes.util.find_library("z"), "libz.so.1"):
        try:
            if name:
                return ctypes.CDLL(name)
        except OSError:
            continue
    return None


class Inflate:
    """Raw inflate over bytes that stay where they are; feed() goes on with others when all are used."""

    def __init__(self, data: bytes, at: int):
        self.z, self.data = _Stream(), data
        self.held = ctypes.create_string_buffer(1 << 16)
        lib = libz()
        if lib is None:
            raise GzipError("libz is missing")
        lib.zlibVersion.restype = ctypes.c_char_p
        if lib.inflateInit2_(ctypes.byref(self.z), -15, lib.zlibVersion(), ctypes.sizeof(_Stream)) != _Z_OK:
            raise GzipError("libz can't be set up")
        self.feed(data, at)

    def feed(self, data: bytes, at: int = 0) -> None:
        self.data = data
        self.z.next_in, self.z.avail_in = (ctypes.cast(ctypes.c_char_p(data), ctypes.c_void_p).value or 0) + at, len(data) - at

    def prime(self, point: RestartPoint) -> None:
        if point.bits:
            libz().inflatePrime(ctypes.byref(self.z), point.bits, point.value)
        if point.history:
            libz().inflateSetDictionary(ctypes.byref(self.z), point.history, len(point.history))

    def step(self, flush: int) -> tuple[int, bytes]:
        self.z.next_out, self.z.avail_out = ctypes.addressof(self.held), len(self.held)
        code = libz().inflate(ctypes.byref(self.z), flush)
        if code not in (_Z_OK, STREAM_END, _Z_BUF_ERROR):
            raise GzipError(f"inflate failed with {code}")
        return code, self.held.raw[: len(self.held) - self.z.avail_out]

    @property
    def at(self) -> int:
        return len(self.data) - self.z.avail_in

    @property
    def left(self) -> int:
        return self.z.avail_in

    @property
    def pending(self) -> bool:
        """Whether there may be output that had no room."""
        return not self.z.avail_out

    @property
    def block_end(self) -> bool:
        return bool(self.z.data_type & 128)

    @property
    def final(self) -> bool:
        return bool(self.z.data_type & 64)

    @property
    def bits(self) -> int:
        return self.z.data_type & 7

    def __del__(self):
        if libz() is not None and self.z.state:
            libz().inflateEnd(ctypes.byref(self.z))


def restart_points(data: bytes, span: int = SPAN) -> list[RestartPoint]:
    """A point at each member's data, and at block ends more than `span` output bytes behind the one before.

    The true output position of a block end is kept, and no point is made at a member's final block.
    """
    points, at, out = [], 0, 0
    while at < len(data):
        _, start = read_header(data, at)
        points.append(RestartPoint(start, out, 0, 0, b""))
        last = out
        if libz() is None:
            z = zlib.decompressobj(-15)
            out += len(z.decompress(data[start:]))
            at = len(data) - len(z.unused_data) + 8
            continue
        z, tail = Inflate(data, start), b""
        while True:
            code, got = z.step(BLOCK)
            out += len(got)
            tail = (tail + got)[-WINDOW:]
            if code == STREAM_END:
                break
            if code == _Z_BUF_ERROR or not got and not z.z.avail_in and not z.z.data_type & 128:
                raise GzipError("the stream is cut short")
            kind = z.z.data_type
            if kind & 128 and not kind & 64 and out - last > span:
                bits = kind & 7
                points.append(RestartPoint(z.at, out, bits, data[z.at - 1] >> 8 - bits if bits else 0, tail))
                last = out
        at = z.at + 8
    return points


def read_range(data: bytes, points: list[RestartPoint], offset: int, length: int) -> bytes:
    """Uncompressed bytes from offset; fewer at the end, none behind it. Decoding starts at the floor restart point."""
    return read_sorted(data, sorted(points, key=lambda p: (p.out, p.into)), offset, length)


def read_sorted(data: bytes, points: list[RestartPoint], offset: int, length: int) -> bytes:
    """As read_range, of points in order of output and place."""
    got = bytearray()
    while length > 0:
        n = bisect.bisect_right(points, offset, key=lambda p: p.out)
        if not n:
            break
        chunk = _decode(data, points[n - 1], offset - points[n - 1].out, length)
        got += chunk
        offset, length = offset + len(chunk), length - len(chunk)
        if not chunk or n == len(points):
            break
    return bytes(got)


def _decode(data: bytes, point: RestartPoint, skip: int, length: int) -> bytes:
    """Bytes skip to skip + length behind a point, to the end of its member at most."""
    if libz() is None:
        return zlib.decompressobj(-15).decompress(data[point.into :], skip + length)[skip:]
    z, out, passed = Inflate(data, point.into), bytearray(), 0
    z.prime(point)
    while len(out) < length:
        code, got = z.step(0)
        out += got[max(0, skip - passed) :]
        passed += len(got)
        if code == STREAM_END or code == _Z_BUF_ERROR or not got and not z.z.avail_in:
            break
    return bytes(out[:length])


def inflate(data: bytes, dictionary: bytes = b"") -> bytes:
    """A raw DEFLATE stream, with a preset dictionary if given."""
    z = zlib.decompressobj(-15, zdict=dictionary) if dictionary else zlib.decompressobj(-15)
    try:
        out = z.decompress(data) + z.flush()
    except zlib.error as e:
        raise GzipError(str(e)) from None
    if not z.eof:
        raise GzipError("the stream is cut short")
    return out
