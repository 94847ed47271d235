"""Rows in and out of Arrow batches, one at a time: contents don't become Python objects by the batch."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame

#: Bytes and rows of a batch that goes out; a longer row makes a batch of its own.
BYTES, ROWS = 4 << 20, 4096


def rows(batches: Iterable, *names: str) -> Iterator[tuple]:
    """One tuple per row of the named columns. A batch's memory is given back before the next one is asked for."""
    import pyarrow as pa

    for b in batches:
        columns = [b.column(b.schema.get_field_index(n)) for n in names]
        b = None
        yield from zip(*((v.as_py() for v in c) for c in columns), strict=True)
        columns = None
        pa.default_memory_pool().release_unused()


def batches_of(found: Iterable[tuple], ddl: str) -> Iterator:
    """Record batches of bounded size of rows of 'a long, b string'."""
    import pyarrow as pa

    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
    schema = pa.schema([(n, kinds[k]) for n, k in (x.split() for x in ddl.split(","))])
    held, size = [], 0

    def made():
        return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)

    for r in found:
        held.append(r)
        size += sum(len(v) for v in r if isinstance(v, str | bytes))
        if size >= BYTES or len(held) >= ROWS:
            yield made()
            held, size = [], 0
    if held:
        yield made()


def map_rows(df: DataFrame, work: Callable[[Iterator[tuple]], Iterable[tuple]], ddl: str) -> DataFrame:
    """What work makes of a task's rows, in their order: it gets and gives tuples."""
    names = df.columns
    return df.mapInArrow(lambda batches: batches_of(work(rows(batches, *names)), ddl), ddl)
