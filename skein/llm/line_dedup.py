"""Repeated runs of lines by a suffix array over line-ID sequences (operator 1).

A document is the sequence of its \\n-separated lines. Distributed prefix doubling ranks suffixes by their first 1, 2, 4,
8 ... lines: the rank for 2k lines comes from sorting the pairs (rank for k lines here, rank for k lines k lines on).
Suffixes with one rank at depth k are an interval of the suffix array whose common prefix is k lines or more. Only
suffixes that share their interval with another go on to the next depth; the rest of a large corpus falls out at once.

A line is deleted if it stands in a run of `min_lines` or more lines that also starts at an earlier place (a smaller
doc_id, or further up in the same text), so the first copy stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.llm.common import LAST_ID, arrow_schema, rows_of
from skein.llm.tables import cut

MIN_LINES = 2
RESULT = "doc_id long, n_lines long, n_removed long, n_runs long, longest_run long, kept string"


def line_positions(docs: DataFrame) -> DataFrame:
    """d, t (which document: its id, and a hash of its text in case of rows that share an id), i and the line's hashes."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lines = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("d"), F.xxhash64(text).alias("t"), F.posexplode(F.split(text, "\n", -1)).alias("i", "line"))
    return lines.select("d", "t", "i", F.xxhash64("line").alias("x"), F.xxhash64(F.lit("line"), "line").alias("y"))


def _ranked(positions: DataFrame, name: str) -> DataFrame:
    """Positions whose (x, y) stands in two places or more, with its rank r among those pairs and its first place."""
    place = F.struct("d", "t", "i")
    pairs = positions.groupBy("x", "y").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last")
    n = int(positions.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # In a frame that is dealt and sorted by range, ids that grow with the place are ranks.
    ranks = pairs.repartitionByRange(n, "x", "y").sortWithinPartitions("x", "y").select("x", "y", F.monotonically_increasing_id().alias("r"), F.struct("first.d", "first.t", "first.i").alias("first"))
    return cut(positions.join(ranks, ["x", "y"]).select("d", "t", "i", "r", (place > F.col("first")).alias("later")), name)


def _step(level: DataFrame, by: int) -> DataFrame:
    """(rank here, rank `by` lines on) for positions that have both."""
    ahead = level.select("d", "t", (F.col("i") - by).alias("i"), F.col("r").alias("y"))
    return level.select("d", "t", "i", F.col("r").alias("x")).join(ahead, ["d", "t", "i"])


def repeated_windows(docs: DataFrame, min_lines: int = MIN_LINES) -> DataFrame:
    """d, t, i and depth: places where `depth` lines start that also start at an earlier place; depth is `min_lines`, and
    every power of two above it that a run reaches."""
    depth, level = 1, _ranked(line_positions(docs).distinct(), "lines")
    while depth * 2 <= min_lines:
        level, depth = _ranked(_step(level, depth), "lines"), depth * 2
    exact = level if depth == min_lines else _ranked(_step(level, min_lines - depth), "lines")
    found = [exact.where("later").select("d", "t", "i", F.lit(min_lines).alias("depth"))]
    while level.limit(1).count():
        level, depth = _ranked(_step(level, depth), "lines"), depth * 2
        if depth > min_lines:
            found.append(level.where("later").select("d", "t", "i", F.lit(depth).alias("depth")))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def remove_repeated_lines(docs: DataFrame, min_lines: int = MIN_LINES, rest: Column | None = None) -> DataFrame:
    """Per document: doc_id, n_lines, n_removed, n_runs (maximal deleted runs), longest_run, kept (the text without them),
    and rest if given.

    A null text counts as empty, and an empty text has one empty line. Rows with one doc_id and different texts are
    taken in the order of the texts' hashes; rows that are equal in both are one document, and all get its result.
    Null doc_ids come after all others.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    more = [] if rest is None else [rest]
    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), *more).withColumns({"d": F.coalesce("doc_id", F.lit(LAST_ID)), "t": F.xxhash64("text")})
    # One row of starts per document; a text's lines bound it.
    starts = repeated_windows(docs, min_lines).groupBy("d", "t", "i").agg(F.max("depth").alias("depth")).groupBy("d", "t").agg(F.collect_list(F.struct("i", "depth")).alias("starts"))
    held = whole.join(starts, ["d", "t"], "left").select("doc_id", F.col("text").cast("binary").alias("text"), F.col("starts.i").alias("at"), F.col("starts.depth").alias("depth"), *(["rest"] if more else []))
    schema, carried = arrow_schema(RESULT), bool(more)

    def work(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [_without_runs(*r) for r in rows_of([batch], "text", "at", "depth")]
            n_lines, n_removed, n_runs, longest, kept = zip(*rows, strict=True) if rows else ((),) * 5
            columns = [batch.column(0), *(pa.array(x, f.type) for x, f in zip((n_lines, n_removed, n_runs, longest, kept), list(schema)[1:], strict=True))]
            names = schema.names
            if carried:
                columns, names = [*columns, batch.column(4)], [*names, "rest"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return held.mapInArrow(work, T.StructType([*T._parse_datatype_string(RESULT).fields, *([held.schema["rest"]] if more else [])]))


def _without_runs(body: bytes, at: list[int] | None, depth: list[int] | None) -> tuple[int, int, int, int, str]:
    """n_lines, n_removed, n_runs, longest_run and what is left of a text whose lines from at[j] on, depth[j] of them, go."""
    lines = body.split(b"\n")
    drop, runs, longest, stop, begun = set(), 0, 0, -1, 0
    for i, n in sorted(zip(at or (), depth or (), strict=True)):
        if i > stop:
            runs, begun = runs + 1, i
        stop = max(stop, i + n)
        longest = max(longest, stop - begun)
        drop.update(range(i, i + n))
    kept = b"\n".join(x for i, x in enumerate(lines) if i not in drop) if drop else body
    return len(lines), len(drop), runs, longest, kept.decode("utf-8", "replace")
