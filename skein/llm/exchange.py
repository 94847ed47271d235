"""Asking all documents about small pieces of one's own, in packed blocks.

Documents are dealt to parts of a few megabytes by a hash of doc_id. A part sends each bucket one row with all it wants
to ask there; a bucket's task sees the rows of all parts and answers each with one row. A part asks about a key once,
however often it holds it, so a key that stands in a third of all documents costs a bucket one entry per part. The
number of parts and buckets follows the input's bytes; no row and no group grows with it.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.llm.common import arrow_schema, doc_bytes, trim

#: bucket and part: where a block goes and where it comes from, or the other way round.
BLOCK = "bucket int, part int, body binary"
_SCHEMA = arrow_schema(BLOCK)


def deal(docs: DataFrame, parts: int, *more) -> DataFrame:
    """doc_id, text as bytes and the document's part, with more columns if named. Plans that start from one dealt frame
    share one exchange of the texts. A column `rest` is only carried along to finish()."""
    own = doc_bytes(docs) if not more else docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string").cast("binary"), F.lit(b"")).alias("text"), *more)
    return own.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(parts)).cast("int"))


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets as ranges of the hashes' upper 32 bits, so that sorted hashes have sorted buckets."""
    return ((hashes >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def slices(bucket: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """bucket, from, to of sorted bucket numbers."""
    if not len(bucket):
        return
    cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(bucket)], strict=True):
        yield int(bucket[a]), a, b


def blob(*arrays: np.ndarray) -> bytes:
    """Packs arrays, compressed."""
    head = struct.pack("<B", len(arrays)) + b"".join(struct.pack("<2sQ", a.dtype.str[1:].encode(), a.nbytes) for a in arrays)
    return zstandard.ZstdCompressor(1).compress(head + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays))


def unblob(body: bytes) -> list[np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(body)
    n, out = data[0], []
    at = 1 + 10 * n
    for i in range(n):
        kind, size = struct.unpack_from("<2sQ", data, 1 + 10 * i)
        kind = np.dtype(f"<{kind.decode()}")
        out.append(np.frombuffer(data, kind, size // kind.itemsize, at))
        at += size
    return out


def _table(rows: list[tuple[int, int, bytes]]) -> pa.Table:
    b, p, body = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.Table.from_arrays([pa.array(b, pa.int32()), pa.array(p, pa.int32()), pa.array(body, pa.binary())], schema=_SCHEMA)


def _trimmed(rows: list[tuple[int, int, bytes]]) -> pa.Table:
    trim()
    return _table(rows)


def _blocks(table: pa.Table, by: str) -> list[tuple[int, bytes]]:
    return sorted(zip(table.column(by).to_pylist(), table.column("body").to_pylist(), strict=True), key=lambda x: x[0])


def _texts(table: pa.Table, names: list[str]) -> tuple[list[tuple], list[int]]:
    """A part's documents in an order that doesn't depend on how they came, and where each one was."""
    rows = list(zip(*(table.column(n).to_pylist() for n in names), strict=True))
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, *(x or (0 if k == 0 else b"" if k == 1 else "") for k, x in enumerate(rows[i]))))
    return [rows[i] for i in order], order


def _names(dealt: DataFrame) -> list[str]:
    return [c for c in dealt.columns if c not in ("part", "rest")]


def ask(dealt: DataFrame, work: Callable[[list[tuple]], Iterator[tuple[int, bytes]]]) -> DataFrame:
    """Blocks for buckets, made from each part's documents."""
    names = _names(dealt)

    def run(key, table):
        return _trimmed([(b, key[0].as_py(), body) for b, body in work(_texts(table, names)[0])])

    return dealt.groupBy("part").applyInArrow(run, BLOCK)


def answer(blocks: DataFrame, work: Callable[[list[tuple[int, bytes]]], Iterator[tuple[int, bytes]]]) -> DataFrame:
    """Blocks for parts, made from each bucket's blocks."""

    def run(key, table):
        return _trimmed([(key[0].as_py(), p, body) for p, body in work(_blocks(table, "part"))])

    return blocks.groupBy("bucket").applyInArrow(run, BLOCK)


def ask_again(dealt: DataFrame, answers: DataFrame, work: Callable[[list[tuple], list[tuple[int, bytes]]], Iterator[tuple[int, bytes]]]) -> DataFrame:
    """Blocks for buckets, made from each part's documents and the answers that it got."""
    names = _names(dealt)

    def run(key, texts, got):
        return _trimmed([(b, key[0].as_py(), body) for b, body in work(_texts(texts, names)[0], _blocks(got, "bucket"))])

    return dealt.groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(run, BLOCK)


def finish(dealt: DataFrame, answers: DataFrame, work: Callable[[list[tuple], list[tuple[int, bytes]]], dict], ddl: str) -> DataFrame:
    """The result's rows, made from each part's documents and the answers that it got, with `rest` if dealt has it."""
    names, schema, rest = _names(dealt), arrow_schema(ddl), "rest" in dealt.columns

    def run(_, texts, got):
        rows, order = _texts(texts, names)
        columns = work(rows, _blocks(got, "bucket"))
        out = pa.Table.from_arrays([pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)
        del columns, rows
        trim()
        return out.append_column("rest", texts.column("rest").take(pa.array(order, pa.int64()))) if rest else out

    kind = T.StructType([*T._parse_datatype_string(ddl).fields, *([dealt.schema["rest"]] if rest else [])])
    return dealt.groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(run, kind)
