"""Operator 9 at a similarity: near copies by word shingles, found by SimHash and confirmed by exact Jaccard similarity.

A document is the set of its shingles' 64-bit hashes; documents with one set are one node. First the nodes' SimHash
fingerprints are linked by the Gray-order index (simhash.py); nodes with linked fingerprints are candidates. At a similarity
of 0.8 fingerprints differ in some ten of 64 bits, in blocks too short for any index, so what the fingerprints leave apart
is searched by min hashes: BANDS x ROWS minimum hashes of each set make BANDS values, and nodes that share a value are
candidates; at similarity 0.8, all but 3 in 100,000 pairs share one. All candidates are confirmed by the exact similarity
of their sets. By values, every node is first held against the smallest one. Then nodes of a value that are not joined
yet and whose minimum hashes agree in LIKELY or more are found, in the first of the values that they share; those nodes' sets
go to the task of that value, which confirms pairs until its nodes are joined, and returns the trees that join them: k nodes
give less than k links. A value of more than GROUP nodes or GROUP_BYTES of sets is split into cells, and each pair of cells is
searched on its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import LAST_ID, map_docs, row_groups
from skein.llm.simhash import DISTANCE, buckets_for, link_fingerprints, of_hashes
from skein.llm.tables import components, cut

SHINGLE, SIMILARITY, SEED = 5, 0.8, 42
BANDS, ROWS, LIKELY, GROUP = 20, 4, 0.6, 4096
GROUP_BYTES, BUCKET_BYTES = 16 << 20, 32 << 20
_MIX = np.random.default_rng(SEED).integers(0, 1 << 64, (2, BANDS * ROWS), np.uint64) | np.uint64(1)
_SLICE = 1 << 9


def shingle_set(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """The sorted hashes of a text's distinct shingles; a shorter text is one shingle, a text without words has none."""
    words = text.lower().split()  # for bytes: A-Z only; space and \x09 to \x0d
    if not words:
        return np.zeros(0, np.uint64)
    grams = [b" ".join(words)] if len(words) < shingle else map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), "<u8"))


def set_hash(shingles: np.ndarray) -> int:
    return (xxhash.xxh64_intdigest(shingles.tobytes(), SEED) + (1 << 63)) % (1 << 64) - (1 << 63)


def min_hashes(shingles: np.ndarray) -> np.ndarray:
    least = np.full(BANDS * ROWS, ~np.uint64(0))
    for at in range(0, len(shingles), _SLICE):
        least = np.minimum(least, ((shingles[at : at + _SLICE, None] ^ _MIX[0]) * _MIX[1]).min(0))
    return least


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(len(a) + len(b) - both, 1)


def similarities(one: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """Of one set with each of some others, none of them empty."""
    sizes = np.array([len(x) for x in others])
    flat = np.concatenate(others)
    hit = one[np.minimum(np.searchsorted(one, flat), len(one) - 1)] == flat
    both = np.add.reduceat(hit, np.cumsum(sizes) - sizes, dtype=np.int64)
    return both / (len(one) + sizes - both)


def likely(node: np.ndarray, value: np.ndarray, side: np.ndarray, label: np.ndarray, sketch: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """A row and the rows of its value with other labels whose sketches agree with its own in LIKELY; sides as in
    simhash.links. Labels that are changed meanwhile count from then on."""
    order = np.argsort(value, kind="stable")
    value = value[order]
    stops = np.flatnonzero(np.append(value[1:] != value[:-1], True)) + 1 if len(value) else []
    for a, b in zip([0, *stops], stops, strict=False):
        own = order[a:b]
        held = own[side[own] >= 1]
        for i in own[side[own] != 1].tolist():
            some = held[(label[held] != label[i]) & ((side[held] == 1) | (node[held] > node[i]))]
            some = some[(sketch[some] == sketch[i]).mean(1) >= LIKELY] if len(some) else some
            if len(some):
                yield i, some


def likely_pairs(node: np.ndarray, value: np.ndarray, side: np.ndarray, label: np.ndarray, sketch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All of them as pairs of nodes."""
    out = [(node[:0], node[:0]), *((np.full(len(some), node[i]), node[some]) for i, some in likely(node, value, side, label, sketch))]
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def first_here(least: np.ndarray, band: np.ndarray, i: int, some: np.ndarray) -> np.ndarray:
    """Those rows that share no value of an earlier band with row i, where the pair is searched as well."""
    agree = (least[some] == least[i]).all(2)
    return some[~agree.any(1) | (agree.argmax(1) >= np.minimum(band[some], band[i]))]


def likely_rows(node: np.ndarray, value: np.ndarray, band: np.ndarray, side: np.ndarray, label: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Which rows are in a likely pair."""
    found = np.zeros(len(node), bool)
    for i, some in likely(node, value, side, label, least.reshape(len(node), -1).astype(np.uint8)):
        some = first_here(least, band, i, some)
        found[some] = True
        found[i] |= len(some) > 0
    return found


def forest(node: np.ndarray, value: np.ndarray, band: np.ndarray, side: np.ndarray, label: np.ndarray, sets: list[np.ndarray], similar: float) -> list[tuple[int, int]]:
    """Links that join the labels of all likely rows that are `similar` or more; pairs that are joined already are left out."""
    least = np.array([min_hashes(x) for x in sets], np.uint64).reshape(-1, BANDS, ROWS)
    label, out = label.copy(), []
    for i, some in likely(node, value, side, label, least.reshape(len(node), -1).astype(np.uint8)):
        some = first_here(least, band, i, some)
        for at in range(0, len(some), _SLICE):
            part = some[at : at + _SLICE]
            part = part[label[part] != label[i]]
            if not len(part):
                continue
            for j in part[similarities(sets[i], [sets[k] for k in part]) >= similar].tolist():
                if label[j] != label[i]:
                    out.append((int(node[i]), int(node[j])))
                    label[label == label[j]] = label[i]
    return out


def similar(docs: DataFrame, marked: DataFrame, pairs: DataFrame, shingle: int, least: float) -> DataFrame:
    """The pairs (a, b) of nodes whose sets are `least` or more similar."""
    pairs = cut(pairs.distinct(), "candidates")
    sets_ = sets_of(docs, marked, pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))), shingle)
    both = pairs.join(sets_.select(F.col("node").alias("a"), F.col("body").alias("x")), "a").join(sets_.select(F.col("node").alias("b"), F.col("body").alias("y")), "b").select("a", "b", "x", "y")

    def confirmed(batches) -> Iterator[dict]:
        for a, b, x, y in row_groups(batches, "a", "b", "x", "y"):
            ok = [similarity(np.frombuffer(p, "<u8"), np.frombuffer(q, "<u8")) >= least for p, q in zip(x, y, strict=True)]
            yield {"a": [v for v, k in zip(a, ok, strict=True) if k], "b": [v for v, k in zip(b, ok, strict=True) if k]}

    return cut(map_docs(both, confirmed, "a long, b long"), "similar")


def sets_of(docs: DataFrame, marked: DataFrame, needed: DataFrame, shingle: int) -> DataFrame:
    """node and its set as bytes, of the nodes that are needed."""
    of_node = marked.join(needed.distinct(), "node", "left_semi").groupBy("node").agg(F.min(F.struct("d", "t")).alias("one")).select("node", F.col("one.d").alias("d"), F.col("one.t").alias("t"))
    texts = _rows(docs).join(of_node, ["d", "t"]).select("node", "text")

    def sets(batches) -> Iterator[dict]:
        for nodes, bodies in row_groups(batches, "node", "text"):
            yield {"node": nodes, "body": [shingle_set(x, shingle).tobytes() for x in bodies]}

    return cut(map_docs(texts, sets, "node long, body binary").dropDuplicates(["node"]), "sets")


def _rows(docs: DataFrame) -> DataFrame:
    """d, t (as in line_dedup: the id, and a hash of the text) and text as bytes."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("d"), F.xxhash64(text).alias("t"), text.cast("binary").alias("text"))


def first_copies(docs: DataFrame, shingle: int = SHINGLE, least: float = SIMILARITY, group: int = GROUP) -> DataFrame:
    """d and t of one document of each component of near copies: the smallest doc_id's, null ids last."""

    def mark(batches) -> Iterator[dict]:
        for d, t, texts in row_groups(batches, "d", "t", "text"):
            sets = [shingle_set(x, shingle) for x in texts]
            fps = np.array([of_hashes(x) if len(x) else 0 for x in sets], np.uint64).view(np.int64)
            yield {"d": d, "t": t, "node": [set_hash(x) for x in sets], "fp": fps, "least": [min_hashes(x).tobytes() for x in sets], "size": [len(x) for x in sets]}

    def valued(batches) -> Iterator[dict]:
        for nodes, bodies, sizes in row_groups(batches, "node", "least", "size"):
            least_ = np.frombuffer(b"".join(bodies), "<u8").reshape(-1, BANDS, ROWS)
            value = np.repeat(np.arange(BANDS, dtype=np.uint64)[None], len(nodes), 0)
            for i in range(ROWS):
                value = (value ^ least_[:, :, i]) * np.uint64(0x9E3779B97F4A7C15)
                value ^= value >> np.uint64(29)
            yield {"node": np.repeat(np.array(nodes, np.int64), BANDS), "value": value.reshape(-1).view(np.int64), "band": np.tile(np.arange(BANDS, dtype=np.int32), len(nodes)), "size": np.repeat(np.array(sizes, np.int64), BANDS)}

    marked = cut(map_docs(_rows(docs), mark, "d long, t long, node long, fp long, least binary, size long"), "marked")
    nodes = marked.groupBy("node").agg(F.first("least").alias("least"), F.first("fp").alias("fp"), F.first("size").alias("size"))
    buckets = buckets_for(marked.count(), DISTANCE, docs.sparkSession)
    # By fingerprints: nodes with one fingerprint are held against the smallest of them, which stands for it in the index.
    by_fp = cut(nodes.select("node", "fp"), "by-fingerprint")
    heads = cut(by_fp.groupBy("fp").agg(F.min("node").alias("first")), "heads")
    same = by_fp.join(heads, "fp").where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    near = link_fingerprints(heads.select("fp"), DISTANCE, buckets=buckets)
    near = near.join(heads.select(F.col("fp").alias("a"), F.col("first").alias("x")), "a").join(heads.select(F.col("fp").alias("b"), F.col("first").alias("y")), "b")
    links = similar(docs, marked, same.unionByName(near.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))), shingle, least)
    # By values, what fingerprints left apart.
    values = cut(map_docs(nodes.select("node", "least", "size"), valued, "node long, value long, band int, size long"), "values")
    shared = values.groupBy("value").agg(F.count("*").alias("n"), F.sum("size").alias("total"), F.min("node").alias("first")).where("n > 1")
    held = cut(values.join(shared, "value"), "held")
    first = held.where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b")).distinct().join(links, ["a", "b"], "left_anti")
    links = cut(links.unionByName(similar(docs, marked, first, shingle, least)), "links")
    found = components(links, "links")
    # What the first round left apart: first the rows that have a likely partner, by their minimum hashes, then their sets.
    cells = F.ceil(F.greatest(F.col("n") / group, F.col("total") * 8 / GROUP_BYTES)).cast("int")
    labelled = held.join(found, "node", "left").select("node", "value", "band", "size", cells.alias("cells"), F.coalesce("root", "node").alias("label"))
    apart = labelled.groupBy("value").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("value")
    labelled = labelled.join(apart, "value", "left_semi").join(nodes.select("node", "least"), "node")
    cell = F.pmod(F.xxhash64("node"), F.col("cells")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("cells") - 1), lambda j: F.struct(F.least(cell, j).alias("x"), F.greatest(cell, j).alias("y"), F.when(j == cell, 2).when(j > cell, 0).otherwise(1).alias("side")))
    dealt = labelled.select("node", "value", "band", "size", "label", "least", F.explode(pairs).alias("p")).select("node", F.xxhash64("value", "p.x", "p.y").alias("value"), "band", F.col("p.side").alias("side"), "label", "size", "least")
    row = ("node", "value", "band", "side", "label")

    def mark_likely(table: pa.Table) -> pa.Table:
        least_ = np.frombuffer(b"".join(table.column("least").to_pylist()), "<u8").reshape(-1, BANDS, ROWS)
        found = likely_rows(*(table.column(c).to_numpy() for c in row), least_)
        return table.select([*row, "size"]).filter(pa.array(found))

    def search(table: pa.Table) -> pa.Table:
        links = forest(*(table.column(c).to_numpy() for c in row), [np.frombuffer(x, "<u8") for x in table.column("body").to_pylist()], least)
        return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})

    wanted = cut(dealt.withColumn("bucket", F.pmod("value", F.lit(buckets))).groupBy("bucket").applyInArrow(mark_likely, "node long, value long, band int, side int, label long, size long"), "likely")
    total = int(wanted.agg(F.sum("size")).first()[0] or 0) * 8
    buckets = max(-(-total // BUCKET_BYTES), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    more = wanted.join(sets_of(docs, marked, wanted.select("node"), shingle), "node").withColumn("bucket", F.pmod("value", F.lit(buckets)))
    more = cut(more.groupBy("bucket").applyInArrow(search, "a long, b long"), "similar")
    roots = components(links.unionByName(more), "links")
    rooted = marked.select("d", "t", "node").join(roots, "node", "left")
    return rooted.groupBy(F.coalesce("root", "node").alias("root")).agg(F.min(F.struct("d", "t")).alias("one")).select("one.d", "one.t")
