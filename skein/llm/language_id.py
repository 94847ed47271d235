"""Hierarchical language identification (operator 7).

A family is predicted first, then the language within it; both levels vote by one-versus-one linear support vector
machines over hashed byte n-grams. A text's feature is the mean of its n-grams' indicator vectors, so a machine's margin
is the mean of its weights over the text's n-grams, which whole texts of any length give in one pass.

Fitting takes at most SAMPLE labelled rows of each language, those with the smallest hashes of doc_id; nothing else is
bounded. Only text and lang are learned from, only text is predicted from.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import chunks, map_docs, rows_of

SAMPLE, DIMENSIONS, ORDERS = 300, 1 << 14, (2, 3, 4)
SCALE, COST, EPOCHS, SLOPE = 100.0, 1.0, 60, 3.0
UNKNOWN = "und"
#: Families of language codes. A language without an entry is a family of its own.
FAMILIES = {
    **dict.fromkeys(("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "fy", "lb", "yi"), "germanic"),
    **dict.fromkeys(("fr", "es", "pt", "it", "ro", "ca", "gl", "oc", "la"), "romance"),
    **dict.fromkeys(("ru", "uk", "be", "pl", "cs", "sk", "sl", "hr", "sr", "bs", "bg", "mk"), "slavic"),
    **dict.fromkeys(("fi", "et", "hu"), "uralic"),
    **dict.fromkeys(("tr", "az", "kk", "uz", "tk", "ky", "tt"), "turkic"),
    **dict.fromkeys(("hi", "bn", "ur", "mr", "gu", "pa", "ne", "si", "fa", "ku", "ps"), "indo-iranian"),
    **dict.fromkeys(("lt", "lv"), "baltic"),
    **dict.fromkeys(("ar", "he", "mt", "am"), "semitic"),
}
PREDICTED = "doc_id long, lang_pred string, score double"
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_LETTER = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]")


def has_letter(text: str) -> bool:
    return _LETTER.search(text) is not None or any(map(str.isalpha, text))


def gram_slots(data: np.ndarray, order: int) -> np.ndarray:
    """The slot of each n-gram of bytes."""
    n = max(len(data) - order + 1, 0)
    key = np.full(n, order, np.uint64)
    for i in range(order):
        key = key << np.uint64(8) | data[i : i + n]
    return ((key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - DIMENSIONS.bit_length() + 1)).astype(np.int64)


def padded(text: bytes) -> bytes:
    return b"   " + text.translate(_LOWER) + b"   "


def feature(text: bytes) -> np.ndarray:
    data = np.frombuffer(padded(text), np.uint8)
    total = np.zeros(DIMENSIONS)
    for order in ORDERS:
        slots = gram_slots(data, order)
        total += np.bincount(slots, minlength=DIMENSIONS) / (len(slots) * len(ORDERS))
    return total


def fit_machine(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """A linear support vector machine by dual coordinate descent; the last weight is the bias's."""
    dots = (x @ x.T).astype(float) * SCALE**2 + 1
    alpha, reached = np.zeros(len(x)), np.zeros(len(x))
    # Classes of different sizes weigh alike.
    cost = np.where(y > 0, COST * len(y) / (2 * max((y > 0).sum(), 1)), COST * len(y) / (2 * max((y < 0).sum(), 1)))
    rng = np.random.default_rng(0)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(x)):
            new = min(max(alpha[i] - (y[i] * reached[i] - 1) / dots[i, i], 0.0), cost[i])
            if new != alpha[i]:
                reached += (new - alpha[i]) * y[i] * dots[i]
                alpha[i] = new
    weights = (alpha * y).astype(x.dtype)
    return np.append((x.T @ weights).astype(float) * SCALE, (alpha * y).sum())


@dataclass
class LanguageModel:
    """pairs: (level, one, other) of each machine, level None for families; weights: (DIMENSIONS + 1, machines)."""

    languages: list[str]
    pairs: list[tuple[str | None, str, str]]
    weights: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, lang: list[str]) -> LanguageModel:
        lang_of = np.array(lang, object)
        family_of = np.array([FAMILIES.get(v, f"={v}") for v in lang], object)
        languages, pairs, machines = sorted(set(lang)), [], []
        for level in [None, *sorted(set(family_of.tolist()))]:
            label = family_of if level is None else lang_of
            inside = np.ones(len(lang), bool) if level is None else family_of == level
            for a, b in combinations(sorted(set(label[inside].tolist())), 2):
                at = np.flatnonzero(inside & ((label == a) | (label == b)))
                pairs.append((level, a, b))
                machines.append(fit_machine(x[at], np.where(label[at] == a, 1.0, -1.0)))
        return cls(languages, pairs, np.stack(machines, 1) if machines else np.zeros((DIMENSIONS + 1, 0)))

    def margins(self, texts: list[bytes]) -> np.ndarray:
        """Each machine's margin for each text."""
        out = np.tile(self.weights[-1], (len(texts), 1))
        if not self.pairs:
            return out
        data = [padded(t) for t in texts]
        ends = np.cumsum([len(t) for t in data])
        flat = np.frombuffer(b"".join(data), np.uint8)
        weights = np.ascontiguousarray(self.weights[:-1] * (SCALE / len(ORDERS)))
        starts = np.concatenate([[0], ends[:-1]])
        for order in ORDERS:
            slots = gram_slots(flat, order)
            last = ends - order + 1  # n-grams that start here and up to the next text would cross its border
            for m in range(weights.shape[1]):
                got = weights[:, m][slots]
                sums = np.add.reduceat(got, np.stack([starts, np.minimum(last, len(got) - 1)], 1).ravel())[::2]
                if last[-1] >= len(got):
                    sums[-1] = got[starts[-1] :].sum()
                out[:, m] += sums / (last - starts)
        return out

    def predict(self, texts: list[bytes]) -> tuple[list[str], list[float]]:
        margins = self.margins(texts)
        chosen, scores = [], []
        for row in margins.tolist():
            family, p = self._vote(None, row)
            if family is None:
                family = FAMILIES.get(self.languages[0], f"={self.languages[0]}")
            lang, q = self._vote(family, row)
            if lang is None:
                lang = next(v for v in self.languages if FAMILIES.get(v, f"={v}") == family)
            chosen.append(lang)
            scores.append(p * q)
        return chosen, scores

    def _vote(self, level: str | None, row: list[float]) -> tuple[str | None, float]:
        """Most votes, then the largest sum of margins; the probability of the winner's weakest pair."""
        votes: dict[str, list[float]] = {}
        for (own, a, b), m in zip(self.pairs, row, strict=True):
            if own == level:
                votes.setdefault(a, []).append(m)
                votes.setdefault(b, []).append(-m)
        if not votes:
            return None, 1.0
        best = max(sorted(votes), key=lambda v: (sum(m > 0 for m in votes[v]), sum(votes[v])))
        return best, float(1 / (1 + np.exp(-SLOPE * min(votes[best]))))


def fit(docs: DataFrame, sample: int = SAMPLE) -> LanguageModel | None:
    """Learns from rows with a text that has a letter and a lang that isn't null; None if there are none."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("lang is not null and doc_id is not null")
    counts = {r.lang: r.n for r in own.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    # Of each language about twice the sample by hash, then the smallest hashes of those.
    share = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    few = F.lit(False)
    for lang, n in counts.items():
        few = few | ((F.col("lang") == lang) & (share < min(1.0, 2 * sample / n)))
    drawn: dict[str, list[int]] = {}
    for r in own.where(few).select("lang", "doc_id", share.alias("h")).orderBy("h", "doc_id").collect():
        drawn.setdefault(r.lang, []).append(r.doc_id)
    ids = sorted({d for x in drawn.values() for d in x[:sample]})

    def work(batches) -> Iterator[dict]:
        for group in chunks(rows_of(batches, "text", "lang"), size=lambda r: len(r[0] or "")):
            group = [(t, v) for t, v in group if t and has_letter(t)]
            got = [feature(t.encode("utf-8", "replace")).astype(np.float32) for t, _ in group]
            at = [np.flatnonzero(x) for x in got]
            yield {"lang": [v for _, v in group], "slots": [a.astype("<u2").tobytes() for a in at], "values": [x[a].tobytes() for x, a in zip(got, at, strict=True)]}

    rows = map_docs(own.where(F.col("doc_id").isin(ids)), work, "lang string, slots binary, values binary").collect()
    if not rows:
        return None
    rows.sort(key=lambda r: (r.lang, r.slots, r.values))
    x = np.zeros((len(rows), DIMENSIONS), np.float32)
    for i, r in enumerate(rows):
        x[i, np.frombuffer(r.slots, "<u2")] = np.frombuffer(r["values"], np.float32)
    return LanguageModel.fit(x, [r.lang for r in rows])


def predict(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """doc_id, lang_pred and score (0 to 1). `und` with score 0 where text is null or has no letter, or nothing was learned."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # machines for pairs of languages: no row adds to it

    def work(batches) -> Iterator[dict]:
        known = sent.value
        for group in chunks(rows_of(batches, "doc_id", "text"), size=lambda r: len(r[1] or ""), limit=1 << 20):
            lang, score = [UNKNOWN] * len(group), [0.0] * len(group)
            at = [i for i, (_, t) in enumerate(group) if t and known is not None and has_letter(t)]
            if at:
                for i, v, s in zip(at, *known.predict([group[i][1].encode("utf-8", "replace") for i in at]), strict=True):
                    lang[i], score[i] = v, s
            yield {"doc_id": [d for d, _ in group], "lang_pred": lang, "score": score}

    return map_docs(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), work, PREDICTED)


def held_out(doc_id: str = "doc_id"):
    """Rows that must not be learned from: crc32 of doc_id as text, modulo 4, is 2 (null doc_ids aren't held out)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))
