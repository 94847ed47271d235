"""Near duplicates by SimHash fingerprints and a Gray-order hierarchical index (operator 9).

Fingerprints within `distance` differing bits are linked; documents whose fingerprints can reach each other are one
component. Two fingerprints that differ in at most d bits agree in one of d + 1 blocks of bits, so fingerprints are
dealt by each block's value. The fingerprints of one value are sorted by Gray rank, which puts those with common bit
patterns side by side; eight neighbours at a time become a node that holds the bits they all share, and again upwards.
A search counts a node's differences under its mask, which contains its parents' masks, and drops the whole node when
they exceed the distance. A value that holds more than GROUP fingerprints is split into cells, and each pair of cells
is searched on its own. Every task links what it found to trees, so a group of k near copies gives at most k links.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.common import doc_bytes, map_docs, row_groups
from skein.llm.tables import components, cut

SHINGLE, SEED, DISTANCE, GROUP, FAN = 3, 42, 3, 8192, 8
_SEARCH = 1 << 15


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    words = text.lower().split()  # for bytes: A-Z only; space and \x09 to \x0d
    if not words:
        return 0
    if len(words) < shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    return of_hashes(np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), "<u8"))


def of_hashes(h: np.ndarray) -> int:
    """The fingerprint of shingles' hashes: each bit as most of them have it; 0 if there are none."""
    ones = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long. Null and empty texts: 0."""

    def work(batches) -> Iterator[dict]:
        for ids, texts in row_groups(batches, "doc_id", "text"):
            yield {"doc_id": ids, "fp": np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64)}

    return map_docs(doc_bytes(docs), work, "doc_id long, fp long")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Place of each number in the sequence of reflected Gray codes."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


class GrayIndex:
    """A hierarchical index over fingerprints in groups; fp and group must be sorted by group, then by Gray rank."""

    def __init__(self, fp: np.ndarray, group: np.ndarray, fan: int = FAN):
        # A level: pattern, mask, group, first child and end of children in the level below.
        self.levels = [(fp, np.full(len(fp), ~np.uint64(0)), group, None, None)]
        while True:
            pattern, mask, own, _, _ = self.levels[-1]
            new = np.concatenate([[True], own[1:] != own[:-1]])
            if new.all() and len(self.levels) > 1:
                break
            first = np.maximum.accumulate(np.where(new, np.arange(len(own)), 0))
            start = np.flatnonzero((np.arange(len(own)) - first) % fan == 0)
            common = np.bitwise_and.reduceat(mask, start)
            ones, any_ = np.bitwise_and.reduceat(pattern, start), np.bitwise_or.reduceat(pattern, start)
            common &= ~(ones ^ any_)
            self.levels.append((ones & common, common, own[start], start, np.append(start[1:], len(own))))
        self.root = self.levels[-1][2]

    def search(self, query: np.ndarray, group: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, leaf) within the distance, in the query's group only."""
        node = np.searchsorted(self.root, group)
        q = np.flatnonzero((node < len(self.root)) & (self.root[np.minimum(node, len(self.root) - 1)] == group))
        node = node[q]
        for level in range(len(self.levels) - 1, -1, -1):
            pattern, mask, _, start, end = self.levels[level]
            near = np.bitwise_count((query[q] ^ pattern[node]) & mask[node]) <= distance
            q, node = q[near], node[near]
            if level:
                n = end[node] - start[node]
                q = np.repeat(q, n)
                node = np.repeat(start[node] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        return q, node


def links(fp: np.ndarray, group: np.ndarray, side: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """A forest over fp that joins what is within the distance in one group; side 0 is searched for, side 1 is indexed,
    side 2 is both."""
    order = np.lexsort((gray_rank(fp), group))
    fp, group, side = fp[order], group[order], side[order]
    label = np.arange(len(fp))
    held, asked = np.flatnonzero(side >= 1), np.flatnonzero(side != 1)
    if not len(held) or not len(asked):
        return fp[:0], fp[:0]
    index = GrayIndex(fp[held], group[held])
    for at in range(0, len(asked), _SEARCH):
        some = asked[at : at + _SEARCH]
        a, b = index.search(fp[some], group[some], distance)
        a, b = some[a], held[b]
        apart = a != b
        a, b = a[apart], b[apart]
        while len(a):
            x, y = label[a], label[b]
            apart = x != y
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
            while (label[label] != label).any():
                label = label[label]
    joined = np.flatnonzero(label != np.arange(len(fp)))
    return fp[joined], fp[label[joined]]


def link_fingerprints(distinct: DataFrame, distance: int = DISTANCE, group: int = GROUP, buckets: int | None = None) -> DataFrame:
    """Links (a, b) among distinct fingerprints (column fp) that join all that are within the distance."""
    spark, blocks = distinct.sparkSession, distance + 1
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    values = F.array(*(F.shiftrightunsigned("fp", a).bitwiseAND(F.lit((1 << b - a) - 1)) for a, b in zip(cuts, cuts[1:], strict=False)))
    dealt = distinct.select("fp", F.posexplode(values).alias("block", "value"))
    # Values with more than `group` fingerprints: at most (distance + 1) / group of all of them.
    large = dealt.groupBy("block", "value").count().where(F.col("count") > group).select("block", "value", F.ceil(F.col("count") / group).cast("int").alias("cells"))
    dealt = dealt.join(large, ["block", "value"], "left")
    cell = F.pmod(F.xxhash64("fp"), F.col("cells")).cast("int")
    # Cell i meets every cell j: it is searched for in the pairs (i, j) with j > i, held in (j, i), and both in (i, i).
    pairs = F.when(F.col("cells").isNull(), F.array(F.struct(F.lit(0).alias("x"), F.lit(0).alias("y"), F.lit(2).alias("side")))).otherwise(
        F.transform(F.sequence(F.lit(0), F.col("cells") - 1), lambda j: F.struct(F.least(cell, j).alias("x"), F.greatest(cell, j).alias("y"), F.when(j == cell, 2).when(j > cell, 0).otherwise(1).alias("side")))
    )
    dealt = dealt.select("fp", "block", "value", F.explode(pairs).alias("p")).select("fp", F.col("p.side").alias("side"), F.xxhash64("block", "value", "p.x", "p.y").alias("group"))
    dealt = dealt.withColumn("bucket", F.pmod("group", F.lit(buckets)))
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        fp, group, side = (table.column(c).to_numpy() for c in ("fp", "group", "side"))
        a, b = links(fp.view(np.uint64), group, side, distance)
        return pa.Table.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], schema=schema)

    return dealt.groupBy("bucket").applyInArrow(run, "a long, b long")


def buckets_for(fingerprints: int, distance: int, spark: SparkSession) -> int:
    """So many that a task indexes some hundred thousand fingerprints, and no fewer than the shuffle has."""
    return max(fingerprints * (distance + 1) >> 18, int(spark.conf.get("spark.sql.shuffle.partitions")))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE, group: int = GROUP) -> DataFrame:
    """doc_id, fp and component_id (smallest doc_id of the component) of every document.

    Texts without words have fingerprint 0 and are linked like any other. Exact copies share a fingerprint, so they are
    one component. Null doc_ids don't count for component_id, which is null if a component has no other.
    """
    marked = cut(fingerprints(docs, shingle), "fingerprints")
    distinct = marked.groupBy("fp").agg(F.min("doc_id").alias("least"))
    found = components(link_fingerprints(distinct, distance, group, buckets_for(marked.count(), distance, docs.sparkSession)), "links")
    rooted = distinct.join(found, distinct.fp == found.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(smallest, "root").select("fp", "component_id")
    return marked.join(named, "fp").select("doc_id", "fp", "component_id")
