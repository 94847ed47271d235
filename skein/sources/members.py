"""Archives as rows: tar entries with exact data offsets, member contents, and packing of members into archives."""

from __future__ import annotations

import io
import itertools
import tarfile
from collections.abc import Iterator
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.sources import batching, gzip_index

TOC = (
    "archive string, seq long, name string, path string, parent string, base string, typeflag string, linkname string, size long, offset long, mode int, uid long, gid long, "
    "uname string, gname string, mtime timestamp, devmajor long, devminor long, format int, pax_records map<string,string>, is_dir boolean"
)


def normalized(name: str) -> str:
    """One trailing slash, one leading slash and one leading './' less."""
    name = name[:-1] if name.endswith("/") else name
    name = name[1:] if name.startswith("/") else name
    return name[2:] if name.startswith("./") else name


def parent_of(path: str) -> str:
    import posixpath

    return "" if path == "." else posixpath.normpath(path.rsplit("/", 1)[0] or "/") if "/" in path else "."


def uncompressed(data: bytes) -> bytes:
    """The tar bytes of a plain or gzipped archive, all gzip members, checksums verified."""
    return b"".join(content for _, content in gzip_index.read_members(data)) if data[:2] == b"\x1f\x8b" else data


def entries(data: bytes, archive: str = "", stream: bool = False) -> Iterator[dict]:
    """Rows of TOC, in archive order. stream: read without seeking. An archive without its end mark is read to its end."""
    with tarfile.open(fileobj=io.BytesIO(data), mode="r|" if stream else "r:", bufsize=1 << 20) as tar:
        for seq, e in enumerate(tar):
            path = normalized(e.name + ("/" if e.isdir() and not e.name.endswith("/") else ""))
            if e.issparse():
                raise ValueError(f"{e.name}: sparse members aren't supported")
            yield {
                "archive": archive, "seq": seq, "name": e.name, "path": path or ".", "parent": parent_of(path or "."), "base": path.rsplit("/", 1)[-1] or ".",
                "typeflag": (e.type or b"0").decode("latin-1").replace("\0", "0"), "linkname": e.linkname, "size": e.size, "offset": e.offset_data, "mode": e.mode, "uid": e.uid, "gid": e.gid,
                "uname": e.uname, "gname": e.gname, "mtime": datetime.fromtimestamp(float(e.mtime), timezone.utc), "devmajor": e.devmajor, "devminor": e.devminor, "format": tar.format or 0,
                "pax_records": {k: str(v) for k, v in e.pax_headers.items()}, "is_dir": e.isdir(),
            }


def pack(members: DataFrame) -> DataFrame:
    """Makes an archive row (archive, content) out of each (archive, path, content) row: a gzipped tar of one member."""

    def work(batches):
        import pandas as pd

        for pdf in batches:
            out = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                held = io.BytesIO()
                with tarfile.open(fileobj=held, mode="w:gz", format=tarfile.PAX_FORMAT) as tar:
                    info = tarfile.TarInfo(path)
                    info.size = len(content)
                    tar.addfile(info, io.BytesIO(content))
                out.append(held.getvalue())
            yield pd.DataFrame({"archive": pdf["archive"], "content": out})

    return members.select("archive", "path", "content").mapInPandas(work, "archive string, content binary")


def pack_together(members: DataFrame) -> DataFrame:
    """One tar.gz archive of each archive's (archive, path, content) rows, by path; an archive is made in one task.

    Members come sorted and go into the archive one by one: a task holds one archive's compressed bytes.
    """

    def work(rows):
        for archive, group in itertools.groupby(rows, key=lambda r: r[0]):
            held = io.BytesIO()
            with tarfile.open(fileobj=held, mode="w:gz", format=tarfile.PAX_FORMAT) as tar:
                for _, path, content in group:
                    info = tarfile.TarInfo(path)
                    info.size = len(content)
                    tar.addfile(info, io.BytesIO(content))
            yield archive, held.getvalue()

    own = members.select("archive", "path", "content").repartition("archive").sortWithinPartitions("archive", "path", "content")
    return batching.map_rows(own, work, "archive string, content binary")


def pack_gzip(contents: DataFrame) -> DataFrame:
    """A gzip stream of one named member for each of (archive, parts): arrays of (name, content)."""

    def work(rows):
        import gzip

        for archive, parts in rows:
            held = io.BytesIO()
            for p in parts:
                with gzip.GzipFile(p["name"], "wb", fileobj=held, mtime=0) as f:
                    f.write(p["content"])
            yield archive, held.getvalue()

    return batching.map_rows(contents.select("archive", "parts"), work, "archive string, content binary")


def unpack(archives: DataFrame) -> DataFrame:
    """archive, seq, path, typeflag, size, offset, content and error of all entries of (archive, content) rows.

    An archive that can't be read gives one row with the error and no path.
    """

    def work(rows):
        for archive, content in rows:
            try:
                tar = uncompressed(content)
                yield from [(archive, e["seq"], e["path"], e["typeflag"], e["size"], e["offset"], tar[e["offset"] : e["offset"] + e["size"]] if e["typeflag"] in "07" else b"", None) for e in entries(tar)]
            except (gzip_index.GzipError, tarfile.TarError, ValueError) as e:
                yield archive, None, None, None, None, None, None, str(e)

    return batching.map_rows(archives.select("archive", "content"), work, "archive string, seq long, path string, typeflag string, size long, offset long, content binary, error string")


def gzip_members(archives: DataFrame) -> DataFrame:
    """archive and the header fields, position, CRC and size of each gzip member of (archive, content) rows."""

    def work(rows):
        for archive, content in rows:
            try:
                yield from [(archive, m.member, m.data, m.out, m.name, m.comment, m.extra, m.mod_time, m.os, m.crc32, m.isize, None) for m, _ in gzip_index.read_members(content, keep=False)]
            except gzip_index.GzipError as e:
                yield archive, *[None] * 10, str(e)

    got = batching.map_rows(archives.select("archive", "content"), work, "archive string, member long, into long, out long, name string, comment string, extra binary, mod_time long, os long, crc32 long, isize long, error string")
    return got.withColumn("mod_time", F.timestamp_seconds("mod_time"))


def register_functions(spark) -> None:
    """SQL table function explode_archive(content): the entries of one archive."""
    from pyspark.sql.functions import udtf

    names = [c.split()[0] for c in TOC.replace("map<string,string>", "map").split(",")][1:]

    @udtf(returnType=TOC.removeprefix("archive string, "))
    class ExplodeArchive:
        def eval(self, content: bytes):
            for e in entries(uncompressed(content)):
                yield tuple(e[n] for n in names)

    spark.udtf.register("explode_archive", ExplodeArchive)
