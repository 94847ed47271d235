"""Repeated word windows by prefix-partitioned suffix trees (operator 5).

Suffixes are split by prefixes of varying length: between tasks as repeats.py says, and in a task each just long enough
for its group to fit in memory. A group's subtree is held as its leaves in lexicographic order and the common prefixes
between neighbours; an internal node of depth d is a maximal stretch of leaves with common prefixes of d or more. Leaves
end after a window, so the deep nodes, of a window's depth, are the repeats; a leaf is removed if its node also has a leaf
of a smaller document.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame

from skein.llm.repeats import Spec, Words, find_repeats, next_smaller, prefix_groups, previous_smaller, sorted_suffixes

WINDOW, GROUP = 50, 40_000
KEPT = "doc_id long, n_words long, n_removed long, kept string"
_WORD = re.compile(rb"[^\x20\x09-\x0d]+")


def internal_nodes(common: np.ndarray, least: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Depth, first and last leaf of the subtree's internal nodes of depth `least` or more, in the order of their leaves."""
    at = np.flatnonzero(common >= least)
    # Each run of deep neighbours has a smaller value before it and behind it.
    runs = np.flatnonzero(np.diff(at, prepend=-2) > 1)
    flat, place = np.insert(common[at], runs, least - 1), np.insert(at, runs, at[runs] - 1)
    inner = np.flatnonzero(flat >= least)
    first, stop = previous_smaller(flat)[inner], next_smaller(flat)[inner]
    _, one = np.unique(first * (len(flat) + 1) + stop, return_index=True)
    return flat[inner[one]], place[first[one]], place[stop[one] - 1]


def judge(units: np.ndarray, starts: np.ndarray, rank: np.ndarray, window: int) -> np.ndarray:
    out = np.zeros(len(starts), bool)
    units = units.astype(">u4")
    for own in prefix_groups(lambda s, i: units[starts[s] + i], len(starts), GROUP, window):
        order, common = sorted_suffixes(units, starts[own], window)
        leaf_rank = rank[own[order]]
        _, first, last = internal_nodes(common, window)
        if len(first):
            least = np.minimum.reduceat(leaf_rank, np.stack([first, last + 1], 1).ravel()[: 2 * len(first) - (last[-1] + 1 >= len(order))])[::2]
            at = np.repeat(first - np.concatenate([[0], np.cumsum(last - first + 1)[:-1]]), last - first + 1) + np.arange(int((last - first + 1).sum()))
            out[own[order[at]]] = leaf_rank[at] > np.repeat(least, last - first + 1)
    return out


def _without(text: bytes, cover: np.ndarray) -> bytes:
    spans = [m.span() for m in _WORD.finditer(text)]
    edges = np.flatnonzero(np.diff(np.concatenate([[0], cover.astype(np.int8), [0]]))).tolist()
    out, at = [], 0
    for i, j in zip(edges[::2], edges[1::2], strict=True):
        out.append(text[at : spans[i][0]])
        at = spans[j][0] if j < len(spans) else len(text)
    return b"".join(out) + text[at:]


def _result(rows, ends, cover) -> dict:
    out = {"doc_id": [], "n_words": [], "n_removed": [], "kept": []}
    at = 0
    for (doc_id, text), end in zip(rows, ends.tolist(), strict=True):
        own = cover[at:end]
        removed = int(own.sum())
        out["doc_id"].append(doc_id)
        out["n_words"].append(end - at)
        out["n_removed"].append(removed)
        out["kept"].append((_without(text, own) if removed else text).decode("utf-8", "replace"))
        at = end
    return out


def remove_repeated_windows(docs: DataFrame, window: int = WINDOW, gram: int | None = None, rest: Column | None = None) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept (the text without the removed words, white space as it was), and rest
    if given.

    Every word covered by a window of `window` words that also starts in a document with a smaller doc_id is removed.
    Null and empty texts have no words; rows with one doc_id don't remove each other's words; rows with a null doc_id
    come after all others.
    """
    spec = Spec(Words, window, gram or max(1, window // 5), judge)
    return find_repeats(docs, spec, _result, KEPT, rest)
