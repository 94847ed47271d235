"""Cost-balanced packing of documents into training sequences (operator 3).

The cost of a piece of n tokens is estimated as LINEAR * n + QUADRATIC * n * n (feed-forward and attention). Within a
shard of about SHARD_TOKENS tokens, documents are taken in descending order and each goes to the sequence of lowest
cost that has token capacity left; what doesn't fit there is cut off and goes on to the next such sequence. Whole
multiples of the capacity are cut off long documents first. A shard gets as many full sequences as its tokens fill; the
tokens left over open sequences whose capacities are the powers of two in their number, so nothing needs padding.

There is no shuffle: a shard is packed in the task that read it, and at most a shard's ids are held at once.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame

from skein.llm.common import chunks, doc_bytes, map_docs, rows_of
from skein.llm.tokens import encoder, Words

LINEAR, QUADRATIC = 1.0, 1.0 / 4096
SHARD_TOKENS = 3_000_000
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, capacity long"


def pack(lengths: list[int], capacity: int, linear: float = LINEAR, quadratic: float = QUADRATIC) -> tuple[list[tuple[int, int, int, int, int]], list[int]]:
    """Pieces (document, start, length, sequence, offset) that cover all documents, and each sequence's capacity."""
    pieces, sizes, rest = [], [], []
    for d, n in enumerate(lengths):
        for start in range(0, n - n % capacity, capacity):
            pieces.append((d, start, capacity, len(sizes), 0))
            sizes.append(capacity)
        if n % capacity:
            rest.append((n % capacity, d))
    total = sum(n for n, _ in rest)
    open_from = len(sizes)
    sizes += [capacity] * (total // capacity) + [1 << b for b in range(capacity.bit_length(), -1, -1) if (total % capacity) >> b & 1]
    heap = [(0.0, s) for s in range(open_from, len(sizes))]
    used = dict.fromkeys(range(open_from, len(sizes)), 0)
    for n, d in sorted(rest, key=lambda x: (-x[0], x[1])):
        start = lengths[d] - n
        while n:
            cost, s = heapq.heappop(heap)
            take = min(n, sizes[s] - used[s])
            pieces.append((d, start, take, s, used[s]))
            used[s] += take
            if used[s] < sizes[s]:
                heapq.heappush(heap, (cost + linear * take + quadratic * take * take, s))
            start, n = start + take, n - take
    return pieces, sizes


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 2, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and the sequence's capacity.

    Null and empty texts have one token, end_id. An empty table gives no rows. Repeated rows are packed each by itself.
    """

    def work(batches) -> Iterator[dict]:
        coder, task, made = encoder(tokenizer_path, Words), TaskContext.get().partitionId(), 0
        shard: list[tuple[int | None, np.ndarray]] = []

        def flush() -> dict:
            nonlocal made
            pieces, sizes = pack([len(ids) for _, ids in shard], capacity)
            first = (task << 36) + made
            made += len(sizes)
            d, start, length, s, offset = (list(x) for x in zip(*pieces, strict=True))
            out = {"doc_id": [shard[i][0] for i in d], "start": start, "length": length, "offset": offset, "doc_tokens": [len(shard[i][1]) for i in d], "sequence_id": [first + x for x in s], "capacity": [sizes[x] for x in s]}
            out["ids_crc32"] = [zlib.crc32(shard[i][1][a : a + n].astype("<u4").tobytes()) for i, a, n, _, _ in pieces]
            shard.clear()
            return out

        tokens = 0
        for group in chunks(rows_of(batches, "doc_id", "text"), limit=4 << 20):
            ids, stops = coder.encode([t for _, t in group], end_id)
            for (doc_id, _), own in zip(group, np.split(ids, stops[:-1]), strict=True):
                shard.append((doc_id, own))
            tokens += len(ids)
            if tokens >= shard_tokens:
                yield flush()
                tokens = 0
        if shard:
            yield flush()

    return map_docs(doc_bytes(docs), work, PIECES)
