"""Random access to archives where they are: only the compressed bytes that a request needs are fetched.

A store is anything with size() and read_at(offset, length); open_store() has files and HTTP. Operators take another opener
(path -> store), which must be a function that can be sent to tasks. Archives are indexed in tasks, in one pass that holds
a step of compressed bytes and a window of output. A request starts at the restart point before it; requests that follow
each other in an archive go on with the decoder of the one before. Decoding needs the system's libz.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.operators import reads, toc
from skein.sources import gzip_index
from skein.sources.gzip_index import GzipError, RestartPoint
from skein.sources.http_source import RangeReader

STEP = 1 << 16
POINTS = "archive string, into long, out long, bits int, value long, history binary"


class FileStore:
    def __init__(self, path: str):
        self.path = path

    def size(self) -> int:
        return os.stat(self.path).st_size

    def read_at(self, offset: int, length: int) -> bytes:
        with open(self.path, "rb") as f:
            f.seek(offset)
            return f.read(length)


def open_store(path: str):
    return RangeReader(path) if path.startswith(("http://", "https://")) else FileStore(path)


class Decoder:
    """Output of a gzip stream from a restart point on, through all members behind it."""

    def __init__(self, store, size: int, point: RestartPoint, step: int = STEP):
        self.store, self.size, self.step = store, size, step
        self.out, self.fetched, self.last = point.out, point.into, b""
        self._start(point)

    def _start(self, point: RestartPoint) -> None:
        self.z, self.before = gzip_index.Inflate(b"", 0), 0
        self.z.prime(point)

    @property
    def at(self) -> int:
        """The next compressed byte."""
        return self.fetched - self.z.left

    def _fetch(self) -> bool:
        some = self.store.read_at(self.fetched, min(self.step, self.size - self.fetched))
        if some:
            self.before = self.z.data[-1] if self.z.data else self.before
            self.z.feed(some)
            self.fetched += len(some)
        return bool(some)

    def last_byte(self) -> int:
        """The byte before the next one."""
        used = len(self.z.data) - self.z.left
        return self.z.data[used - 1] if used else self.before

    def next(self, flush: int = 0) -> tuple[bool | None, bytes]:
        """Whether a member ended, and more output; None where the stream is cut short."""
        while True:
            if not self.z.left and not self._fetch() and not self.z.pending:
                return None, b""
            code, got = self.z.step(flush)
            self.out += len(got)
            if code == gzip_index.STREAM_END:
                return True, got
            if got or flush and self.z.block_end:
                return False, got

    def next_member(self) -> bool:
        """Goes on behind a member's trailer; False if nothing is there."""
        start = self.at + 8
        if start >= self.size:
            return False
        for n in (2048, 1 << 17):
            head = self.store.read_at(start, min(n, self.size - start))
            try:
                data = gzip_index.read_header(head)[1]
                break
            except GzipError:
                if len(head) < n:
                    raise
        else:
            raise GzipError("the header is too long")
        self.fetched = start + data
        self._start(RestartPoint(self.fetched, self.out, 0, 0, b""))
        return True

    def read(self, offset: int, length: int) -> bytes:
        """Output bytes from offset, fewer at the end. What lies before first() is passed already."""
        held, ended = bytearray(), False
        while True:
            skip = offset - self.first()
            held += self.last[max(0, skip) :] if skip < len(self.last) else b""
            if len(held) >= length or ended is None or ended and not self.next_member():
                return bytes(held[:length])
            ended, self.last = self.next()

    def first(self) -> int:
        """The first output byte that is still there."""
        return self.out - len(self.last)


def restart_points(store, span: int = gzip_index.SPAN, step: int = STEP) -> Iterator[RestartPoint]:
    """As gzip_index.restart_points, one after the other, from a store."""
    size = store.size()
    if not size:
        return
    for n in (2048, 1 << 17):
        head = store.read_at(0, min(n, size))
        try:
            start = gzip_index.read_header(head)[1]
            break
        except GzipError:
            if len(head) < n or n > 2048:
                raise
    point = RestartPoint(start, 0, 0, 0, b"")
    decoder = Decoder(store, size, point, step)
    while True:
        yield point
        last, tail = point.out, b""
        while True:
            ended, got = decoder.next(gzip_index.BLOCK)
            tail = (tail + got)[-gzip_index.WINDOW :]
            if ended:
                break
            if ended is None:
                raise GzipError("the stream is cut short")
            if decoder.z.block_end and not decoder.z.final and decoder.out - last > span:
                bits = decoder.z.bits
                yield RestartPoint(decoder.at, decoder.out, bits, decoder.last_byte() >> 8 - bits if bits else 0, tail)
                last = decoder.out
        if not decoder.next_member():
            return
        point = RestartPoint(decoder.fetched, decoder.out, 0, 0, b"")


def index_archives(archives: DataFrame, span: int = gzip_index.SPAN, opener: Callable = open_store) -> DataFrame:
    """POINTS of the archives (column archive: paths or URLs), found in tasks; archives that aren't gzip have none."""

    def work(batches):
        import pandas as pd

        names = [x.split()[0] for x in POINTS.split(", ")]
        for pdf in batches:
            for path in pdf["archive"]:
                store = opener(path)
                if store.size() < 2 or store.read_at(0, 2) != b"\x1f\x8b":
                    continue
                rows = []
                for p in restart_points(store, span):
                    rows.append((path, p.into, p.out, p.bits, p.value, p.history))
                    if len(rows) == 64:
                        yield pd.DataFrame(rows, columns=names)
                        rows = []
                if rows:
                    yield pd.DataFrame(rows, columns=names)

    return archives.select("archive").distinct().mapInPandas(work, POINTS)


def read_ranges(requests: DataFrame, points: DataFrame, opener: Callable = open_store) -> DataFrame:
    """requests (archive, offset, length and any more columns) with content: bytes of the uncompressed stream; fewer at its end.

    Requests are dealt by archive and restart point. Archives without points are read as they are.
    """
    own = reads.floor_join(requests, points, ["archive"], "offset", "out") if "out" not in requests.columns else requests
    asked = requests.join(points.select("archive").distinct(), "archive", "left_anti").withColumn("out", F.lit(None).cast("long"))
    own = own.unionByName(asked) if "out" not in requests.columns else own
    held = own.join(points.dropDuplicates(["archive", "out"]), ["archive", "out"], "left")
    held = held.repartition("archive", "out").sortWithinPartitions("archive", "offset")
    schema = T.StructType([*requests.schema.fields, T.StructField("content", T.BinaryType())])

    def work(batches):
        store = decoder = None
        path = ""
        for pdf in batches:
            content = []
            for r in pdf.itertuples(index=False):
                if store is None or r.archive != path:
                    path, store, decoder = r.archive, opener(r.archive), None
                    size = store.size()
                offset, length = int(r.offset), int(r.length)
                if r.history is None or r.into != r.into:
                    content.append(store.read_at(offset, max(0, min(length, size - offset))))
                    continue
                if decoder is None or not int(r.out) <= decoder.first() <= offset:
                    decoder = Decoder(store, size, RestartPoint(int(r.into), int(r.out), int(r.bits), int(r.value), r.history))
                content.append(decoder.read(offset, length))
            pdf["content"] = content
            yield pdf[[f.name for f in schema]]

    return held.mapInPandas(work, schema)


def open_members(requests: DataFrame, entries: DataFrame, points: DataFrame, opener: Callable = open_store) -> DataFrame:
    """archive, path, target, size, content and error of (archive, path) requests; links are followed.

    entries: the archives' tables of contents; their archive column must be what the opener opens.
    """
    found = toc.stat(requests, entries)
    files = found.where(F.col("error").isNull() & F.col("typeflag").isin("0", "\0", "7")).select("archive", "path", "offset", F.col("size").alias("length"))
    got = read_ranges(files, points, opener).select("archive", "path", "content")
    return found.select("archive", "path", "target", "size", "error").join(got, ["archive", "path"], "left")


def trailer(store) -> tuple[int, int]:
    """CRC-32 and size that the last member of a gzip archive ends with."""
    return struct.unpack("<II", store.read_at(store.size() - 8, 8))
