"""Longest-previous-factor deduplication of bytes (operator 4).

Suffixes are sorted; for each, the previous and the next suffix in that order that belong to a smaller document (the
nearest smaller values) are its best matches among earlier documents, and the longer of the two common prefixes is its
longest previous factor. Factors are measured up to the window's length, for longer ones remove nothing more. A window is
removed where its factor reaches that length, so the first copy stays.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame

from skein.llm.repeats import Bytes, Spec, find_repeats, next_smaller, prefix_groups, previous_smaller, sorted_suffixes

WINDOW, GROUP = 50, 250_000
KEPT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"


def range_least(values: np.ndarray) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """least(a, b): the least of values[a[i]:b[i]], which must not be empty; each asks for two overlapping powers of two."""
    levels = [values]
    while len(values) >= 2 << len(levels) - 1:
        half = 1 << len(levels) - 1
        upper = levels[-1].copy()
        upper[:-half] = np.minimum(levels[-1][:-half], levels[-1][half:])
        levels.append(upper)
    table = np.stack(levels)

    def least(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        level = np.frexp(b - a)[1] - 1
        return np.minimum(table[level, a], table[level, b - (1 << level)])

    return least


def longest_previous(common: np.ndarray, value: np.ndarray) -> np.ndarray:
    """The longest previous factor of each suffix, in suffix order.

    common: common prefix with the suffix before; value: the document's rank. The common prefix with a nearest smaller
    place is the least of `common` between.
    """
    n, least = len(value), range_least(common)
    out = np.zeros(n, common.dtype)
    before, after = previous_smaller(value), next_smaller(value)
    at = np.flatnonzero(before >= 0)
    out[at] = least(before[at] + 1, at + 1)
    at = np.flatnonzero(after < n)
    out[at] = np.maximum(out[at], least(at + 1, after[at] + 1))
    return out


def judge(units: np.ndarray, starts: np.ndarray, rank: np.ndarray, window: int) -> np.ndarray:
    out = np.zeros(len(starts), bool)
    for own in prefix_groups(lambda s, i: units[starts[s] + i], len(starts), GROUP, window):
        order, common = sorted_suffixes(units, starts[own], window)
        out[own[order]] = longest_previous(common, rank[own[order]]) >= window
    return out


def _result(rows, ends, cover) -> dict:
    out = {"doc_id": [], "n_bytes": [], "n_removed": [], "n_spans": [], "kept": []}
    at = 0
    for (doc_id, text), end in zip(rows, ends.tolist(), strict=True):
        own = cover[at:end]
        at, removed = end, int(own.sum())
        out["doc_id"].append(doc_id)
        out["n_bytes"].append(len(text))
        out["n_removed"].append(removed)
        out["n_spans"].append(int((own[1:] & ~own[:-1]).sum()) + int(own[0]) if removed else 0)
        out["kept"].append(np.frombuffer(text, np.uint8)[~own].tobytes() if removed else text)
    return out


def remove_repeated_bytes(docs: DataFrame, window: int = WINDOW, gram: int | None = None) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans (removed runs) and the bytes that are left.

    Every byte covered by a `window`-byte string that also starts in a document with a smaller doc_id is removed.
    Null and empty texts have nothing to remove; rows with one doc_id don't remove each other's bytes; rows with a null
    doc_id come after all others. window must be 8 or more.
    """
    spec = Spec(Bytes, window, gram or max(8, window * 2 // 5), judge)
    return find_repeats(docs, spec, _result, KEPT)
