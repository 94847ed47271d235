"""What the text operators share: reading Arrow batches of documents, schemas, sizing.

All operators see a document as ``(doc_id, text)``; other columns of the input are ignored, so extra columns with any
name do no harm. A null text counts as empty. A null doc_id is kept: it stays null in the result and sorts after every
other document. Rows that share a doc_id are separate documents, neither of which is earlier than the other.
"""

from __future__ import annotations

import ctypes
import functools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LAST_ID = (1 << 63) - 1
#: Bytes of text that a Python worker holds as one piece of work, besides a single longer document.
CHUNK_BYTES = 2 << 20


def doc_bytes(docs: DataFrame) -> DataFrame:
    """doc_id (long) and text as UTF-8 bytes (null text: empty)."""
    text = F.coalesce(F.col("text").cast("string").cast("binary"), F.lit(b""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))


def rows_of(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    """One tuple per row, without turning a whole batch into Python objects at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            yield from zip(*(part.column(part.schema.get_field_index(n)).to_pylist() for n in names), strict=True)


def row_groups(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[list[list]]:
    """Columns as lists, some hundred rows at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            yield [part.column(part.schema.get_field_index(n)).to_pylist() for n in names]


def chunks(rows: Iterator[tuple], size: Callable[[tuple], int] = lambda r: len(r[1]), limit: int = CHUNK_BYTES) -> Iterator[list[tuple]]:
    """Groups of rows of about `limit` bytes; a longer row makes a group of its own size."""
    held, total = [], 0
    for r in rows:
        held.append(r)
        total += size(r)
        if total >= limit:
            yield held
            held, total = [], 0
    if held:
        yield held


def batch(schema: pa.Schema, columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)


ARROW = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "double": pa.float64(), "boolean": pa.bool_()}


def arrow_schema(ddl: str) -> pa.Schema:
    """From 'a long, b string'."""
    return pa.schema([(name, ARROW[kind]) for name, kind in (x.split() for x in ddl.split(","))])


def map_docs(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[dict]], ddl: str) -> DataFrame:
    """mapInArrow of a function that yields columns as dicts."""
    schema = arrow_schema(ddl)

    def run(batches):
        for columns in work(batches):
            yield batch(schema, columns)
        trim()

    return df.mapInArrow(run, ddl)


def dictionary_split(texts: list[bytes], at_spaces: bool = False) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct words in the order of their appearance, all words as numbers, and how many each text has.

    Words stand between ASCII white space, and empty ones don't count; with at_spaces, between single spaces, and they do.
    """
    flat = pa.array(texts, pa.binary())
    flat = pa.Array.from_buffers(pa.string(), len(flat), flat.buffers())
    lists = pc.split_pattern(flat, " ") if at_spaces else pc.ascii_split_whitespace(flat)
    coded = lists.values.cast(pa.binary()).dictionary_encode()
    words, which = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy().astype(np.int64)
    n = np.diff(lists.offsets.to_numpy()).astype(np.int64)
    if at_spaces or b"" not in words:
        return words, which, n
    empty = words.index(b"")
    some = which != empty
    n = np.diff(np.concatenate([[0], np.cumsum(some)])[np.concatenate([[0], np.cumsum(n)])])
    which = which[some]
    return words[:empty] + words[empty + 1 :], which - (which > empty), n


def text_bytes(docs: DataFrame) -> int:
    """UTF-8 bytes of all texts, counted: what is stored may be compressed many times over."""
    return int(docs.agg(F.sum(F.octet_length(F.col("text").cast("string")).cast("long"))).first()[0] or 0)


def n_parts(docs: DataFrame, part_bytes: int = 6 << 20) -> int:
    """How many parts of about `part_bytes` bytes of text the documents make."""
    return max(1, math.ceil(text_bytes(docs) / part_bytes))


def trim() -> None:
    """Gives memory that is free again back to the system, so that reused workers stay as small as their present work."""
    pa.default_memory_pool().release_unused()
    if (free := _libc()) is not None:
        free(0)


@functools.cache
def _libc():
    try:
        return ctypes.CDLL("libc.so.6").malloc_trim
    except (OSError, AttributeError):  # another C library
        return None


def rest_of(docs: DataFrame):
    """All columns but doc_id and text in one, named rest, to carry them through an operator."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    return F.struct(*(others or [F.lit(0).alias("none")])).alias("rest")


def with_text(result: DataFrame, docs: DataFrame, text: str) -> DataFrame:
    """Rows with docs' columns, from a result that has doc_id, the new text and rest; n_chars follows the text."""
    new = F.col(text).alias("text")
    columns = {"doc_id": F.col("doc_id"), "text": new}
    if "n_chars" in docs.columns:
        columns["n_chars"] = F.length(text).cast(docs.schema["n_chars"].dataType).alias("n_chars")
    return result.select(*(columns.get(c, F.col(f"rest.`{c}`")).alias(c) for c in docs.columns))
