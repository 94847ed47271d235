"""Windows of a fixed number of units (bytes or words) that also start in an earlier document, over all documents.

Of all suffixes only some are kept as samples, so that every window holds one: each window has an anchor, of the
`gram`-unit stretches in it the one with the lowest hash, and equal windows have equal anchors. The sampled suffixes are
partitioned by prefixes of varying length. At first a prefix is the anchor itself; parts ask which of the prefixes that
they hold stand in two documents or more, for windows around others can't repeat. A prefix that more than HOT parts hold
is made longer, to the right for windows that reach as far behind the anchor and to the left for the others, until it is
half a window more. Then parts send the stretches of text around shared prefixes, each distinct stretch once with the
smallest doc_id it has there. A bucket holds all stretches around its prefixes, and judges all their windows by a suffix
structure of the caller's choice: is there an equal window in an earlier document than the stretch's first? Parts mark
what these windows cover. Nothing is dropped on the way, and what is compared in a bucket are the units, not their hashes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame

from skein.llm.common import LAST_ID, dictionary_split, n_parts
from skein.llm.exchange import answer, ask, ask_again, blob, bucket_of, deal, finish, slices, unblob

#: Units hashed at once; what numpy holds for them is some hundred bytes a unit at most.
STRETCH = 1 << 17
#: A prefix in more parts than this is made longer. A bucket gets a stretch once from each part that holds it.
HOT = 256

_A, _B, _C, _D = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))


def _mixed(g: np.ndarray) -> np.ndarray:
    g ^= g >> np.uint64(32)
    g *= _D
    g ^= g >> np.uint64(29)
    g *= _A
    g ^= g >> np.uint64(32)
    return g


def hash_bytes(units: np.ndarray, gram: int) -> np.ndarray:
    """Hashes of all stretches of `gram` (8 or more) bytes."""
    n = len(units) - 7
    eight = np.empty(max(n, 0), np.uint64)
    for i in range(min(8, max(n, 0))):
        eight[i::8] = np.frombuffer(units, "<u8", (len(units) - i) // 8, i)[: len(eight[i::8])]
    out = np.zeros(max(len(units) - gram + 1, 0), np.uint64)
    for at in sorted({*range(0, gram - 7, 8), gram - 8}):
        out *= _B
        out += _C
        out ^= eight[at : at + len(out)] * _A
        out ^= out >> np.uint64(31)
    return _mixed(out)


def hash_words(units: np.ndarray, gram: int) -> np.ndarray:
    """Hashes of all stretches of `gram` word hashes."""
    out, have, at = np.full(max(len(units) - gram + 1, 0), gram, np.uint64), units, 0
    size = 1
    while True:  # stretches of 1, 2, 4 ... units make up gram
        if gram & size:
            out *= _B
            out += _C
            out ^= have[at : at + len(out)] * _A
            out ^= out >> np.uint64(31)
            at += size
        if at == gram:
            return _mixed(out)
        have = _mixed(have[:-size] * _B + have[size:]) if len(have) > size else have[:0]
        size *= 2


class Bytes:
    """Texts as bytes."""

    dtype, hashes = "u1", staticmethod(hash_bytes)

    def __init__(self, texts: list[bytes]):
        self.data = b"".join(texts)
        self.units = np.frombuffer(self.data, np.uint8)
        self.ends = np.cumsum([len(t) for t in texts], dtype=np.int64)

    def cut(self, a: np.ndarray, b: np.ndarray) -> list[bytes]:
        """Units a[i] to b[i] as bytes."""
        return [self.data[i:j] for i, j in zip(a.tolist(), b.tolist(), strict=True)]

    @staticmethod
    def parse(stretches: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The units of stretches as cut() gave them, and how many each has."""
        return np.frombuffer(b"".join(stretches), np.uint8), np.fromiter(map(len, stretches), np.int64, len(stretches))


_SPACE = np.isin(np.arange(256), list(b" \t\n\v\f\r"))


class Words:
    """Texts as words between white space. Units are hashes for the anchors, and numbers of distinct words in a bucket."""

    dtype, hashes = "u8", staticmethod(hash_words)

    def __init__(self, texts: list[bytes]):
        words, which, n = dictionary_split(texts)
        self.units, self.ends, self.texts = word_hashes(words)[which], np.cumsum(n), texts

    def cut(self, a: np.ndarray, b: np.ndarray) -> list[bytes]:
        """With the white space between the words as it is."""
        if self.texts is not None:
            self.data, self.texts = b"\n".join(self.texts), None
            edge = np.diff(_SPACE[np.frombuffer(self.data, np.uint8)].view(np.int8), prepend=1, append=1)
            self.starts, self.stops = np.flatnonzero(edge < 0), np.flatnonzero(edge > 0)
        return [self.data[i:j] for i, j in zip(self.starts[a].tolist(), self.stops[b - 1].tolist(), strict=True)]

    @staticmethod
    def parse(stretches: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        _, which, n = dictionary_split(stretches)
        return which.astype(np.uint32), n


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of words, eight bytes of all words at a time."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    start = np.cumsum(size) - size
    data = np.frombuffer(b"".join(words) + bytes(8), np.uint8)
    out, at, left = size.astype(np.uint64) * _A, np.arange(len(words)), size
    mask = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)
    while len(at):
        eight = np.lib.stride_tricks.sliding_window_view(data, 8)[start[at]].copy().view("<u8").ravel() & mask[np.minimum(left, 8)]
        out[at] = _mixed((out[at] ^ eight * _B) * _A + _C)
        start[at] += 8
        more = left > 8
        at, left = at[more], left[more] - 8
    return out


@dataclass
class Spec:
    """What a unit is, how long a window is, and how a bucket judges windows."""

    kind: type
    window: int
    gram: int
    #: (units of all stretches, each window's start, the rank of the document of each window) -> which windows stand in an earlier document
    judge: Callable[[np.ndarray, np.ndarray, np.ndarray, int], np.ndarray]


def anchors(units: np.ndarray, ends: np.ndarray, spec: Spec) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor: first window, last window, the anchor's hash and place."""
    k, w = spec.gram, spec.window
    starts = np.concatenate([[0], ends[:-1]])
    found: list[tuple[np.ndarray, ...]] = []
    doc = 0
    while doc < len(ends):
        last = max(doc + 1, int(np.searchsorted(ends, starts[doc] + STRETCH, "right")))
        a, b = int(starts[doc]), int(ends[last - 1])
        own, doc_ends = units[a:b], ends[doc:last] - a
        doc = last
        if len(own) < w:
            continue
        h = spec.kind.hashes(own, k)
        bits = np.uint64(32)  # the same in all documents, so that equal windows choose alike; of ties the leftmost
        least = ((h >> bits) << bits) | np.arange(len(h), dtype=np.uint64)
        span, have = w - k + 1, 1
        while have * 2 <= span:
            least = np.minimum(least[:-have], least[have:])
            have *= 2
        if have < span:
            least = np.minimum(least[: len(least) - (span - have)], least[span - have :])
        whole = np.ones(len(least), bool)
        for s, e in zip(np.concatenate([[0], doc_ends[:-1]]).tolist(), doc_ends.tolist(), strict=True):
            whole[max(s, e - w + 1) : e] = False
        at = np.flatnonzero(whole)
        if not len(at):
            continue
        of = (least[at] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
        new = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (at[1:] != at[:-1] + 1)]))
        # The lowest hashes are anchors, so they are spread over all values again.
        found.append((at[new] + a, at[np.append(new[1:], len(at)) - 1] + a, _mixed(h[of[new]] * _B + _C), of[new] + a))
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, none.astype(np.uint64), none
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


class Part:
    """A part's documents as one array of units, with its anchors."""

    def __init__(self, rows: list[tuple], spec: Spec):
        self.spec, self.texts = spec, spec.kind([r[1] for r in rows])
        self.ends, self.n_units = self.texts.ends, len(self.texts.units)
        self.ids = np.array([LAST_ID if r[0] is None else r[0] for r in rows], np.int64)
        self.first, self.last, self.hash, self.place = anchors(self.texts.units, self.ends, spec)
        self.texts.units = None
        self.doc = np.searchsorted(self.ends, self.first, "right")
        order = np.argsort(self.hash, kind="stable")
        ranked = self.hash[order]
        new = np.concatenate([[True], ranked[1:] != ranked[:-1]]) if len(order) else np.zeros(0, bool)
        self.keys = ranked[new]
        self.key = np.empty(len(order), np.int64)
        self.key[order] = np.cumsum(new) - 1
        at = np.flatnonzero(new)
        docs = self.doc[order]
        self.many = np.minimum.reduceat(docs, at) != np.maximum.reduceat(docs, at) if len(at) else np.zeros(0, bool)

    def stretches(self, shared: np.ndarray, hot: np.ndarray, buckets: int):
        """Distinct stretches around shared anchors, by bucket: runs' first window, its document, each run's stretch, and the
        stretches as (bucket, smallest doc_id, windows, bytes)."""
        runs = np.flatnonzero(shared[self.key]) if len(self.key) else np.zeros(0, np.int64)
        first, last, doc, where = self.first[runs], self.last[runs], self.doc[runs], self.hash[runs]
        w, k = self.spec.window, self.spec.gram
        if len(over := np.flatnonzero(hot[self.key[runs]])):
            long = (w + k + 1) // 2
            edge = self.place[runs[over]] + long - w  # windows from here on hold the longer prefix to the right
            right, left = over[last[over] >= edge], over[first[over] < edge]
            to_right, to_left = edge[last[over] >= edge], edge[first[over] < edge]
            at = self.place[runs]
            grams = self.texts.cut(at[right], at[right] + long) + [b"\0" + x for x in self.texts.cut(at[left] + k - long, at[left] + k)]
            rest = np.setdiff1d(np.arange(len(runs)), over)
            which = np.concatenate([rest, right, left])
            longer = np.fromiter(map(xxhash.xxh3_64_intdigest, grams), np.uint64, len(grams))
            first = np.concatenate([first[rest], np.maximum(first[right], to_right), first[left]])
            last = np.concatenate([last[rest], last[right], np.minimum(last[left], to_left - 1)])
            doc, where = doc[which], np.concatenate([where[rest], longer])
        # Equal stretches with different prefixes go to different buckets.
        known: dict[tuple[int, bytes], int] = {}
        bucket_ = bucket_of(where, buckets).astype(np.int64)
        texts = self.texts.cut(first, last + w)
        number = np.fromiter((known.setdefault(x, len(known)) for x in zip(bucket_.tolist(), texts, strict=True)), np.int64, len(texts))
        least = np.full(len(known), LAST_ID, np.int64)
        np.minimum.at(least, number, self.ids[doc])
        bucket = np.fromiter((b for b, _ in known), np.int64, len(known))
        order = np.argsort(bucket, kind="stable")
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        windows = np.zeros(len(known), np.int64)
        windows[number] = last - first + 1
        distinct = [t for _, t in known]
        return first, doc, back[number], bucket[order], least[order], windows[order], [distinct[i] for i in order.tolist()]


def _bits(blocks: list[tuple[int, bytes]], part: Part, buckets: int) -> tuple[np.ndarray, np.ndarray, dict[int, list[np.ndarray]]]:
    """Which of a part's keys are shared, which are hot, and both as they came, by bucket."""
    got = dict(blocks)
    shared, hot, bits = [], [], {}
    for bucket, a, b in slices(bucket_of(part.keys, buckets)):
        bits[bucket] = unblob(got[bucket])[-2:]
        for out, x in zip((shared, hot), bits[bucket], strict=True):
            out.append(np.unpackbits(x, count=b - a).astype(bool))
    none = np.zeros(0, bool)
    return np.concatenate([none, *shared]), np.concatenate([none, *hot]), bits


def find_repeats(docs: DataFrame, spec: Spec, result: Callable[[list[tuple], np.ndarray, np.ndarray], dict], ddl: str, rest: Column | None = None, part_bytes: int = 3 << 20, hot: int = HOT) -> DataFrame:
    """result(rows, ends, covered) for each part: its documents, where each one's units end, and which units are covered."""
    parts = buckets = n_parts(docs, part_bytes)
    dealt = deal(docs, parts) if rest is None else deal(docs, parts, rest)

    def wanted(rows) -> Iterator[tuple[int, bytes]]:
        part = Part(rows, spec)
        low = part.keys.astype(np.uint32)  # a bucket is a range of the upper bits; chance ties only cost work
        for bucket, a, b in slices(bucket_of(part.keys, buckets)):
            yield bucket, blob(low[a:b], np.packbits(part.many[a:b]))

    def shared(blocks) -> Iterator[tuple[int, bytes]]:
        got = [(p, *unblob(body)) for p, body in blocks]
        keys, n = np.unique(np.concatenate([np.unique(k) for _, k, _ in got]), return_counts=True)
        own = np.unique(np.concatenate([k[np.unpackbits(m, count=len(k)).astype(bool)] for _, k, m in got]))
        twice = n > 1
        twice[np.searchsorted(keys, own)] = True
        many = n > hot
        for p, k, _ in got:
            at = np.searchsorted(keys, k)
            yield p, blob(np.packbits(twice[at]), np.packbits(many[at]))

    def stretches(rows, blocks) -> Iterator[tuple[int, bytes]]:
        part = Part(rows, spec)
        mask, over, bits = _bits(blocks, part, buckets)
        _, _, _, bucket, least, _, texts = part.stretches(mask, over, buckets)
        spans = {b: (i, j) for b, i, j in slices(bucket)}
        none = np.zeros(0, np.uint8)
        for b in sorted({*bits, *spans}):  # the answer comes back with what is needed to know the stretches again
            i, j = spans.get(b, (0, 0))
            yield b, blob(*bits.get(b, (none, none)), np.array([len(t) for t in texts[i:j]], np.uint32), least[i:j], np.frombuffer(b"".join(texts[i:j]), np.uint8))

    def judged(blocks) -> Iterator[tuple[int, bytes]]:
        got, known, least = [], {}, []
        for p, body in blocks:
            *bits, lengths, ids, data = unblob(body)
            data, number, at = data.tobytes(), [], 0
            for n, d in zip(lengths.tolist(), ids.tolist(), strict=True):
                i = known.setdefault(data[at : at + n], len(known))
                at += n
                if i == len(least):
                    least.append(d)
                elif d < least[i]:
                    least[i] = d
                number.append(i)
            got.append((p, bits, np.array(number, np.int64)))
        first = np.array(least, np.int64)
        order = np.argsort(first, kind="stable")  # in the order of the documents
        texts = list(known)
        units, lengths = spec.kind.parse([texts[i] for i in order.tolist()])
        del known, texts, least
        windows = lengths - spec.window + 1
        ends = np.cumsum(windows)
        kind = np.int32 if len(units) < 1 << 31 else np.int64
        starts = np.repeat((np.cumsum(lengths) - lengths - (ends - windows)).astype(kind), windows) + np.arange(ends[-1] if len(ends) else 0, dtype=kind)
        rank = np.unique(first[order], return_inverse=True)[1].astype(kind)
        earlier = spec.judge(units, starts, np.repeat(rank, windows), spec.window) if len(starts) else np.zeros(0, bool)
        del starts
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        for p, bits, number in got:
            at = place[number]
            n = windows[at]
            flat = np.repeat((ends - windows)[at] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            yield p, blob(first[number], np.packbits(earlier[flat]), *bits)

    def covered(rows, blocks) -> dict:
        part = Part(rows, spec)
        mask, over, _ = _bits(blocks, part, buckets)
        start, doc, number, bucket, _, windows, _ = part.stretches(mask, over, buckets)
        got, w = dict(blocks), spec.window
        first, earlier = [], []
        for b, i, j in slices(bucket):
            ids, flags, *_ = unblob(got[b])
            first.append(ids)
            earlier.append(np.unpackbits(flags, count=int(windows[i:j].sum())))
        cover = np.zeros(part.n_units, bool)
        if len(start):
            first, earlier = np.concatenate(first), np.concatenate(earlier).astype(bool)
            n = windows[number]
            step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            out = earlier[np.repeat((np.cumsum(windows) - windows)[number], n) + step]
            out |= np.repeat(part.ids[doc] > first[number], n)
            begun = np.zeros(part.n_units + 1, np.int32)
            begun[1:][(np.repeat(start, n) + step)[out]] = 1
            begun = np.cumsum(begun, dtype=np.int32)
            cover = begun[1:] > begun[np.maximum(np.arange(len(cover)) - w + 1, 0)]
        return result(rows, part.ends, cover)

    asked = ask_again(dealt, answer(ask(dealt, wanted), shared), stretches)
    return finish(dealt, answer(asked, judged), covered, ddl)


def prefix_groups(keys: Callable[[np.ndarray, int], np.ndarray], n: int, most: int, depth: int) -> Iterator[np.ndarray]:
    """Splits suffixes 0 to n by prefixes just long enough for groups of `most` or fewer, in the prefixes' order.

    keys(suffixes, i): unit i of these suffixes. Suffixes that agree in all `depth` units stay together.
    """
    stack = [(np.arange(n), 0)]
    while stack:
        own, i = stack.pop()
        if len(own) <= most or i == depth:
            yield own
            continue
        k = keys(own, i)
        order = np.argsort(k, kind="stable")
        own = own[order]
        bounds = np.concatenate([[0], np.flatnonzero(np.diff(k[order])) + 1, [len(own)]])
        made, at = [], 0
        while at < len(bounds) - 1:
            to = int(np.searchsorted(bounds, bounds[at] + most, "right")) - 1
            if to > at:  # neighbouring prefixes that fit share a group
                made.append((own[bounds[at] : bounds[to]], depth))
            else:
                to = at + 1
                made.append((own[bounds[at] : bounds[to]], i + 1))
            at = to
        stack += made[::-1]


def previous_smaller(value: np.ndarray) -> np.ndarray:
    """For each place the nearest earlier place with a smaller value, or -1."""
    at = np.arange(len(value)) - 1
    open_ = np.flatnonzero((at >= 0) & (value[at] >= value))
    while len(open_):
        at[open_] = at[at[open_]]
        t = at[open_]
        open_ = open_[(t >= 0) & (value[t] >= value[open_])]
    return at


def next_smaller(value: np.ndarray) -> np.ndarray:
    """For each place the nearest later place with a smaller value, or the number of places."""
    return len(value) - 1 - previous_smaller(value[::-1])[::-1]


def sorted_suffixes(units: np.ndarray, starts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes, cut after `window` units (bytes or big-endian), in order, and each one's common prefix with the one before."""
    rows = np.lib.stride_tricks.sliding_window_view(units, window)[starts]
    order = np.argsort(np.ascontiguousarray(rows).view(f"S{window * rows.itemsize}").ravel(), kind="stable")
    rows = rows[order]
    common = np.zeros(len(order), np.int16 if window < 1 << 15 else np.int64)
    differ = rows[1:] != rows[:-1]
    common[1:] = np.where(differ.any(1), differ.argmax(1), window)
    return order, common
