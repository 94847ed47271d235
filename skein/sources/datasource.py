"""Python data sources for archives on local paths that all executors see, and behind HTTP.

``tar_toc``: one partition per archive, a row per entry. Options: path (a file, a glob or a URL; several with commas),
mode (seek or stream). ``archive_blocks``: decoded blocks (archive, chunk, content) for reads.read_members; one partition
per restart point, so that a large gzip archive is decoded in parallel once its points are known. Options: path, span,
chunk. Archives in other stores are read with Spark's binaryFile and skein.sources.members.
"""

from __future__ import annotations

import glob
import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from skein.sources import batching, gzip_index, members
from skein.sources.http_source import RangeReader


def expand(path: str) -> list[str]:
    found = []
    for p in path.split(","):
        found += [p] if p.startswith(("http://", "https://")) else sorted(glob.glob(p)) or [p]
    return found


def load(path: str) -> bytes:
    if path.startswith(("http://", "https://")):
        return RangeReader(path).read_all()
    with open(path, "rb") as f:
        return f.read()


@dataclass
class _Archive(InputPartition):
    path: str


class _TocReader(DataSourceReader):
    def __init__(self, options):
        self.paths, self.stream = expand(options["path"]), options.get("mode", "seek") == "stream"

    def partitions(self):
        return [_Archive(p) for p in self.paths]

    def read(self, partition):
        names = [c.split()[0] for c in members.TOC.replace("map<string,string>", "map").split(",")]
        for e in members.entries(members.uncompressed(load(partition.path)), os.path.basename(partition.path), self.stream):
            yield tuple(e[n] for n in names)


class TarToc(DataSource):
    @classmethod
    def name(cls):
        return "tar_toc"

    def schema(self):
        return members.TOC

    def reader(self, schema):
        return _TocReader(self.options)


@dataclass
class _Stretch(InputPartition):
    path: str
    point: gzip_index.RestartPoint | None
    start: int
    length: int


class _BlockReader(DataSourceReader):
    def __init__(self, options):
        self.paths, self.span, self.chunk = expand(options["path"]), int(options.get("span", gzip_index.SPAN)), int(options.get("chunk", 1 << 20))

    def partitions(self):
        """The first pass over a gzip archive is serial; its points then make partitions of whole chunks."""
        out = []
        for p in self.paths:
            data = load(p)
            if data[:2] != b"\x1f\x8b":
                out.append(_Stretch(p, None, 0, len(data)))
                continue
            points = gzip_index.restart_points(data, self.span)
            size = sum(m.isize for m, _ in gzip_index.read_members(data))
            starts = sorted({q.out // self.chunk * self.chunk for q in points})
            for a, b in zip(starts, [*starts[1:], size], strict=True):
                if b > a:
                    out.append(_Stretch(p, points, a, b - a))
        return out

    def read(self, partition):
        data, name = load(partition.path), os.path.basename(partition.path)
        at, end = partition.start, partition.start + partition.length
        content = data if partition.point is None else gzip_index.read_range(data, partition.point, at, end - at)
        for a in range(at, end, self.chunk):
            yield name, a // self.chunk, content[a - at : min(a + self.chunk, end) - at]


class ArchiveBlocks(DataSource):
    @classmethod
    def name(cls):
        return "archive_blocks"

    def schema(self):
        return "archive string, chunk long, content binary"

    def reader(self, schema):
        return _BlockReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TarToc)
    spark.dataSource.register(ArchiveBlocks)


_POINTS = "archive string, into long, out long, bits int, value long, history binary"


def restart_table(archives: DataFrame, span: int = gzip_index.SPAN) -> DataFrame:
    """archive, into, out, bits, value, history of (archive, content) rows; keep it as a table, or as JSON by index_io."""

    def work(rows):
        for archive, content in rows:
            for p in gzip_index.restart_points(content, span):
                yield archive, p.into, p.out, p.bits, p.value, p.history

    return batching.map_rows(archives.select("archive", "content"), work, _POINTS)


def read_ranges(requests: DataFrame, archives: DataFrame, points: DataFrame) -> DataFrame:
    """archive, offset, length and content of (archive, offset, length) requests into gzip archives.

    A task reads one sorted stream in which each archive comes first, then its points, then its requests; it holds one
    archive and its points at a time. Each request is decoded from the point before it.
    """

    def work(rows):
        name, data, at = work, None, []
        for archive, kind, offset, length, content, into, out, bits, value, history in rows:
            if name is work or archive != name:
                name, data, at = archive, None, []
            if kind == 0:
                data = content
            elif kind == 1:
                at.append(gzip_index.RestartPoint(into, out, bits, value, history))
            else:
                yield archive, offset, length, None if data is None else gzip_index.read_sorted(data, at, offset, length)

    tagged = lambda df, kind, *cols: df.select("archive", F.lit(kind).alias("kind"), *cols)
    both = tagged(requests, 2, F.col("offset").cast("long").alias("offset"), F.col("length").cast("long").alias("length"))
    both = both.unionByName(tagged(archives, 0, "content"), allowMissingColumns=True).unionByName(tagged(points, 1, *_POINTS.replace(",", "").split()[2::2]), allowMissingColumns=True)
    stream = both.repartition("archive").sortWithinPartitions("archive", "kind", "out", "into", "offset", "length")
    order = ["archive", "kind", "offset", "length", "content", "into", "out", "bits", "value", "history"]
    return batching.map_rows(stream.select(order), work, "archive string, offset long, length long, content binary")
