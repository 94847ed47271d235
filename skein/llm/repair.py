"""Token ids in Re-Pair compressed binary shards (operator 6).

Documents are dealt to shards by ascending doc_id. Within a shard, frequent pairs of neighbouring symbols are replaced
by nonterminals, round after round: each round counts all pairs, takes the most frequent ones as rules and replaces
their occurrences from the left. As it stands, that stops where symbols no longer fit 16 bits, and leaves rare pairs; the
exact form goes on until no pair repeats. The shard stores the rules, each rule's expansion length and the final sequence, so any
range of ids can be decoded by a search in the running expansion lengths, without decoding what is before it.

Shard format, little-endian: MAGIC, then seven u64 (documents, ids, terminals, rules, sequence length, bytes a symbol,
null-id marker count), doc_ids i64, doc lengths u32, null markers u8, rule left and right symbols u32, expansion lengths
u32, sequence (u16 or u32).
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.llm.common import chunks, doc_bytes, map_docs, n_parts, rows_of
from skein.llm.tokens import encoder, Spaced, stretches

MAGIC = b"SKRP0001"
ROUNDS, MIN_COUNT, RULES_A_ROUND = 6, 12, 5120
#: Symbols take 16 bits if terminals and rules fit in as many; rules beyond that would cost more than they save.
SYMBOLS = 1 << 16
BROADCAST_SHARDS = 1 << 18
SHARDS = "shard long, n_docs long, n_ids long, body binary"
IDS = "doc_id long, start long, n_tokens long, ids_crc32 long"
_SLOTS = 1 << 18


def compress(ids: np.ndarray, terminals: int, exact: bool = False, rounds: int = ROUNDS, min_count: int = MIN_COUNT, per_round: int = RULES_A_ROUND) -> tuple[np.ndarray, np.ndarray]:
    """The final sequence and the rules (an (n, 2) array); rule r is symbol terminals + r and uses earlier symbols only.

    exact: with 32-bit symbols, until no pair is left that could be replaced twice, whatever rounds and min_count say.
    """
    kind, half = (np.uint32, 16) if terminals < SYMBOLS and not exact else (np.uint64, 32)
    seq, rules = ids.astype(kind), []
    top, done = terminals, 0
    if exact:
        min_count = 2
    while exact or done < rounds:
        done += 1
        room = min(per_round, (1 << half) - top)
        if len(seq) < 2 or room <= 0:
            break
        pairs = (seq[:-1] << kind(half)) | seq[1:]
        counted = np.sort(pairs)
        at = np.flatnonzero(np.concatenate([[True], counted[1:] != counted[:-1]]))
        n = np.diff(np.append(at, len(counted)))
        frequent = np.flatnonzero(n >= min_count)
        if not len(frequent):
            break
        best_of = counted[at[frequent]]
        chosen = best_of[np.argsort(-n[frequent], kind="stable")[:room]]
        # A rule's slot in a table of pairs; where two rules meet, the more frequent one keeps it for this round.
        slot = _slot(chosen)
        _, first = np.unique(slot, return_index=True)
        chosen = chosen[np.sort(first)]
        at = _slot(chosen)
        # An empty slot holds a pair that belongs to another one: 0 belongs to slot 0, and 1 doesn't.
        held, table = np.zeros(_SLOTS, kind), np.zeros(_SLOTS, np.int32)
        held[0] = 1
        held[at], table[at] = chosen, np.arange(len(chosen), dtype=np.int32)
        slot = _slot(pairs)
        where = np.flatnonzero(held[slot] == pairs)
        # Of hits in a row, every second one, from the left, is free to be replaced.
        where = where[_apart(where)]
        taken = table[slot[where]]
        if exact:
            twice = (np.bincount(taken, minlength=len(chosen)) >= 2)[taken]
            where, taken = where[twice], taken[twice]
            if not len(where):  # what pairs take from each other, or from themselves; try them one by one
                order = np.argsort(-n[frequent], kind="stable")
                alone = (np.flatnonzero(pairs == best_of[i]) for i in order)
                where = next((w for x in alone if len(w := x[_apart(x)]) >= 2), None)
                if where is None:
                    break
                chosen, taken = pairs[where[:1]], np.zeros(len(where), np.int32)
        used = np.flatnonzero(np.bincount(taken, minlength=len(chosen)))
        symbol = np.zeros(len(chosen), kind)
        symbol[used] = np.arange(top, top + len(used))
        rules.append(np.stack([chosen[used] >> kind(half), chosen[used] & kind((1 << half) - 1)], 1))
        seq[where] = symbol[taken]
        keep = np.ones(len(seq), bool)
        keep[where + 1] = False
        seq, top = seq[keep], top + len(used)
    return seq, np.concatenate(rules).astype(np.int64) if rules else np.zeros((0, 2), np.int64)


def _apart(where: np.ndarray) -> np.ndarray:
    """Of places in a row, every second one."""
    start = np.maximum.accumulate(where * (np.diff(where, prepend=-2) > 1))
    return (where - start) & 1 == 0


def _slot(pairs: np.ndarray) -> np.ndarray:
    if pairs.itemsize == 4:
        return ((pairs * np.uint32(0x9E3779B1)) >> np.uint32(32 - 18)).astype(np.int64)
    return ((pairs * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 18)).astype(np.int64)


def _rounds(rules: np.ndarray, terminals: int) -> Iterator[tuple[int, int]]:
    """Rules in stretches from a to b whose symbols come before rule a."""
    last, a = rules.max(1, initial=0), 0
    while a < len(rules):
        later = np.flatnonzero(last[a : a + RULES_A_ROUND] >= terminals + a)
        b = a + int(later[0]) if len(later) else min(a + RULES_A_ROUND, len(rules))
        yield a, b
        a = b


def encode_shard(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray, exact: bool = False) -> bytes:
    terminals = int(ids.max(initial=0)) + 1
    seq, rules = compress(ids, terminals, exact)
    sizes = np.ones(terminals + len(rules), np.int64)
    for a, b in _rounds(rules, terminals):
        sizes[terminals + a : terminals + b] = sizes[rules[a:b]].sum(1)
    width = 2 if terminals + len(rules) <= 1 << 16 else 4
    head = struct.pack("<7Q", len(doc_ids), len(ids), terminals, len(rules), len(seq), width, sum(d is None for d in doc_ids))
    parts = [np.array([d or 0 for d in doc_ids], "<i8"), np.array(lengths, "<u4"), np.array([d is None for d in doc_ids], "u1"), rules[:, 0].astype("<u4"), rules[:, 1].astype("<u4"), sizes[terminals:].astype("<u4"), seq.astype(f"<u{width}")]
    return MAGIC + head + b"".join(p.tobytes() for p in parts)


@dataclass
class Shard:
    doc_ids: list[int | None]
    lengths: np.ndarray
    n_ids: int
    terminals: int
    rules: np.ndarray
    sizes: np.ndarray
    seq: np.ndarray

    @classmethod
    def parse(cls, body: bytes) -> Shard:
        if body[:8] != MAGIC:
            raise ValueError("not a Re-Pair shard")
        docs, n_ids, terminals, rules, n_seq, width, _ = struct.unpack_from("<7Q", body, 8)
        at, found = 64, []
        for kind, n in (("<i8", docs), ("<u4", docs), ("u1", docs), ("<u4", rules), ("<u4", rules), ("<u4", rules), (f"<u{width}", n_seq)):
            found.append(np.frombuffer(body, kind, n, at).astype(np.int64))
            at += found[-1].size * np.dtype(kind).itemsize
        doc_ids = [None if null else d for d, null in zip(found[0].tolist(), found[2].tolist(), strict=True)]
        return cls(doc_ids, found[1], n_ids, terminals, np.stack(found[3:5], 1), found[5], found[6])

    def _expand(self, seq: np.ndarray) -> np.ndarray:
        """The ids that a stretch of symbols stands for."""
        while (big := seq >= self.terminals).any():
            out = np.repeat(seq, 1 + big)
            at = np.flatnonzero(big) + np.arange(int(big.sum()))
            pair = self.rules[seq[big] - self.terminals]
            out[at], out[at + 1] = pair[:, 0], pair[:, 1]
            seq = out
        return seq

    def widths(self) -> np.ndarray:
        return np.concatenate([np.ones(self.terminals, np.int64), self.sizes])[self.seq]

    def read(self, start: int, length: int) -> np.ndarray:
        """Ids start to start + length, decoding only the symbols that cover them."""
        ends = np.cumsum(self.widths())
        a, b = np.searchsorted(ends, start, "right"), np.searchsorted(ends, start + length, "left")
        before = int(ends[a - 1]) if a else 0
        return self._expand(self.seq[a : b + 1])[start - before : start - before + length]

    def all(self) -> np.ndarray:
        """All ids: each rule is expanded once, then copied to where it is used."""
        size = np.concatenate([np.ones(self.terminals, np.int64), self.sizes])
        first = np.cumsum(size) - size
        pool = np.empty(int(size.sum()), np.uint32)
        pool[: self.terminals] = np.arange(self.terminals)
        for a, b in _rounds(self.rules, self.terminals):
            symbols = self.rules[a:b].ravel()
            got = stretches(pool, first[symbols], size[symbols])
            at = first[self.terminals + a]
            pool[at : at + len(got)] = got
        return stretches(pool, first[self.seq], size[self.seq])


def write_shards(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 2, exact: bool = False) -> None:
    """Writes every document's ids (null text: only end_id) to shards under path, in ascending doc_id order.

    exact: each shard's grammar to its end; else frequent pairs only, as many as 16-bit symbols hold.

    Null doc_ids come last; rows with one doc_id come in the order of their texts. An empty table writes no shard.
    """
    order = [F.col("doc_id").asc_nulls_last()]
    held = doc_bytes(docs).repartitionByRange(n_parts(docs), *order).sortWithinPartitions(*order, "text")

    def work(batches) -> Iterator[dict]:
        from pyspark import TaskContext

        coder, doc_ids, lengths, ids = encoder(tokenizer_path, Spaced), [], [], []
        made = TaskContext.get().partitionId() << 20

        def flush() -> dict:
            body = encode_shard(doc_ids, lengths, np.concatenate(ids), exact)
            return {"shard": [made], "n_docs": [len(doc_ids)], "n_ids": [sum(lengths)], "body": [body]}

        for group in chunks(rows_of(batches, "doc_id", "text"), limit=8 << 20):
            got, stops = coder.encode([t for _, t in group], end_id)
            doc_ids += [d for d, _ in group]
            lengths += np.diff(stops, prepend=0).tolist()
            ids.append(got)
            if sum(map(len, ids)) >= 4_000_000:
                yield flush()
                doc_ids, lengths, ids, made = [], [], [], made + 1
        if doc_ids:
            yield flush()

    map_docs(held, work, SHARDS).write.parquet(path)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the shards under path: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    shards = spark.read.parquet(path)
    # One row of counts per shard; their running sum needs one task, which reads no bodies.
    starts = shards.select("shard", "n_ids").withColumn("first", F.coalesce(F.sum("n_ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")).drop("n_ids")
    if shards.select("shard").count() <= BROADCAST_SHARDS:  # 16 bytes each
        starts = F.broadcast(starts)

    def work(batches) -> Iterator[dict]:
        for first, body in rows_of(batches, "first", "body"):
            shard = Shard.parse(body)
            stops = np.cumsum(shard.lengths)
            ids = shard.all().astype("<u4")
            crc = [zlib.crc32(ids[b - n : b].tobytes()) for b, n in zip(stops.tolist(), shard.lengths.tolist(), strict=True)]
            yield {"doc_id": shard.doc_ids, "start": first + stops - shard.lengths, "n_tokens": shard.lengths, "ids_crc32": crc}

    return map_docs(shards.select("shard", "body").join(starts, "shard").select("first", "body"), work, IDS)
