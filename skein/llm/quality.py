"""Quality rules with n-gram perplexity (operator 2).

The language model is a character 4-gram model of each language's texts, words with one space between, with modified
Kneser-Ney smoothing. A word's first two characters are predicted from the end of the word before. Tasks count the
4-grams of their documents: those within words once for each distinct word, those across borders once for each distinct
pair of a word's end and the next one's beginning. Spark adds the counts up and derives the lower orders' continuation counts,
the three discounts of each language and order and the interpolated probabilities. The model is a table of all orders'
n-grams; for scoring it becomes sorted arrays of hashes with log probabilities and back-off weights. Up to MODEL_ROWS
n-grams go to every task; a larger model stays dealt by hash ranges, and parts of the documents ask for the n-grams that
they hold. Everything is counted: no n-gram, word or document is left out.

A document has a perplexity per predicted character and one per word. The first shows text in an order or with characters
that the language doesn't have; the second also shows words that carry more than words do, such as symbols stuck to them,
which are cheap by the character once they are met often. Each language has a band for either, around the median of the
logarithm, BAND median deviations from the median wide on either side; documents outside one of them are rejected.
Languages of fewer than FEW documents have no spread to speak of, and bands of at least LEAST_BAND.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import chunks, dictionary_split, map_docs, n_parts, rows_of
from skein.llm.exchange import answer, ask, blob, bucket_of, deal, finish, slices, unblob
from skein.llm.tables import cut

ORDER = 4
MODEL_ROWS = 3_000_000
BAND, LEAST_BAND, FEW = 8.0, 0.6, 20
MIN_WORDS, MAX_REPEATED = 50, 50
#: Fixed values of the rule: what counts as a symbol.
SYMBOLS = b"#*$%&|<>"
STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
SCORED = f"doc_id long, lang string, {STATS}, n_predicted long, log_prob double, text_hash long"
_BITS = 21


def _docs(docs: DataFrame) -> DataFrame:
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("")) if "lang" in docs.columns else F.lit("")
    return docs.select("doc_id", "text", lang.alias("lang"))


def word_ids(texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct words, the words of all texts as numbers, and where each text's words end."""
    words, which, n = dictionary_split(texts)
    return words, which, np.cumsum(n)


def repeated_words(ids: np.ndarray) -> int:
    """Words in 3-word windows that are found twice or more among these words."""
    if len(ids) < 4:
        return 0
    top = int(ids.max()) + 1
    pairs = ids[:-1] * top + ids[1:]
    if top >= 1 << 21:
        pairs = np.unique(pairs, return_inverse=True)[1]
    key = pairs[:-1] * top + ids[2:]
    ranked = np.sort(key)
    twice = ranked[1:][ranked[1:] == ranked[:-1]]
    if not len(twice):
        return 0
    at = np.searchsorted(twice, key)
    hit = twice[np.minimum(at, len(twice) - 1)] == key
    cover = np.zeros(len(ids), bool)
    for i in range(3):
        cover[i : len(ids) - 2 + i] |= hit
    return int(cover.sum())


def text_stats(text: bytes, ids: np.ndarray) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    chars = len(text.decode("utf-8", "replace")) - (len(text) - len(text.translate(None, b" \t\n\v\f\r")))
    seen, dup = set(), 0
    if b"\n" in text:
        for line in text.split(b"\n"):
            if line in seen:
                dup += bool(line.split(None, 1))
            else:
                seen.add(line)
    return len(ids), chars, len(text) - len(text.translate(None, SYMBOLS)), dup, repeated_words(ids)


def word_grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The 4-grams that predict each word's characters and its end, as rows of code points, and where each word's end."""
    padded = "".join(["   " + w.decode("utf-8", "replace") + " " for w in words])
    points = np.frombuffer(padded.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    size = np.array([len(w.decode("utf-8", "replace")) + 1 for w in words], np.int64)
    ends = np.cumsum(size)
    first = np.repeat(np.cumsum(size + 3) - size - 3 - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)
    return points[first[:, None] + np.arange(ORDER)], ends


def border_grams(grams: np.ndarray, ends: np.ndarray, flat: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The 4-grams that predict a word's first two characters from the word before, two rows for each distinct border,
    and each word's border. grams and ends are word_grams' of the distinct words, flat and stops all texts' words."""
    blank = np.array([32 << _BITS | 32], np.int64)
    begin = np.concatenate([[0], ends[:-1]])
    tails, tail = np.unique(np.concatenate([grams[ends - 1, 1] << _BITS | grams[ends - 1, 2], blank]), return_inverse=True)
    heads, head = np.unique(grams[begin, 3] << _BITS | grams[begin + 1, 3], return_inverse=True)
    before = np.concatenate([[len(ends)], flat[:-1]])
    starts = np.concatenate([[0], stops[:-1]])
    before[starts[starts < len(flat)]] = len(ends)  # a text's first word has blanks before it
    pairs, border = np.unique(tail[before] * len(heads) + head[flat], return_inverse=True)
    x, y = tails[pairs // len(heads)], heads[pairs % len(heads)]
    low = (1 << _BITS) - 1
    space = np.full(len(pairs), 32, np.int64)
    rows = np.stack([x >> _BITS, x & low, space, y >> _BITS, x & low, space, y >> _BITS, y & low], 1)
    return rows.reshape(-1, ORDER), border


def text_grams(words: list[bytes], flat: np.ndarray, stops: np.ndarray, across: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]:
    """4-grams: first the distinct words' own, then, if across, two for each distinct border, which take the place of
    the words' first two. With them: where each word's own end, its number of predicted characters, and each word's border."""
    if not words:
        none = np.zeros(0, np.int64)
        return np.zeros((0, ORDER), np.int64), none, none, none if across else None
    grams, ends = word_grams(words)
    size = np.diff(ends, prepend=0)
    if not across:
        return grams, ends, size, None
    rows, border = border_grams(grams, ends, flat, stops)
    inner = np.ones(len(grams), bool)
    inner[ends - size] = inner[ends - size + 1] = False
    return np.concatenate([grams[inner], rows]), np.cumsum(size - 2), size, border


def _by_lang(group: list[tuple]) -> dict[str, list[int]]:
    out: dict[str, list[int]] = {}
    for i, (_, _, lang) in enumerate(group):
        out.setdefault(lang, []).append(i)
    return out


def _summed(rows: np.ndarray) -> np.ndarray:
    """Rows (a, b, n) with equal a and b added up."""
    rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
    at = np.flatnonzero(np.concatenate([[True], (rows[1:, :2] != rows[:-1, :2]).any(1)]))
    return np.concatenate([rows[at, :2], np.add.reduceat(rows[:, 2], at)[:, None]], 1)


def _summed_grams(grams: np.ndarray, times: np.ndarray) -> np.ndarray:
    """Rows (a, b, n) of distinct 4-grams."""
    letters = np.unique(grams[:, -1])
    letters = np.union1d(letters, [32])
    if len(letters) > 1 << 16:
        return _summed(np.stack([grams[:, 0] << _BITS | grams[:, 1], grams[:, 2] << _BITS | grams[:, 3], times], 1))
    small = np.zeros(int(letters[-1]) + 1, np.uint64)
    small[letters] = np.arange(len(letters), dtype=np.uint64)
    key = small[grams[:, 0]]
    for i in range(1, ORDER):
        key = key << np.uint64(16) | small[grams[:, i]]
    order = np.argsort(key)
    key = key[order]
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    first = grams[order[at]]
    return np.stack([first[:, 0] << _BITS | first[:, 1], first[:, 2] << _BITS | first[:, 3], np.add.reduceat(times[order], at)], 1)


def count_grams(docs: DataFrame, across: bool = False) -> DataFrame:
    """lang, a (the first two characters), b (the last two), n: 4-grams with their counts over all documents, each word's
    by itself or, if across, of the whole text."""

    def work(batches) -> Iterator[dict]:
        counts: dict[str, list[np.ndarray]] = {}
        held = 0

        def merge() -> int:
            for lang, rows in counts.items():
                counts[lang] = [_summed(np.concatenate(rows))]
            return sum(len(x[0]) for x in counts.values())

        def flush() -> Iterator[dict]:
            merge()
            for lang, (rows,) in counts.items():
                yield {"lang": [lang] * len(rows), "a": rows[:, 0], "b": rows[:, 1], "n": rows[:, 2]}
            counts.clear()

        for group in chunks(rows_of(batches, "doc_id", "text", "lang")):
            for lang, which in _by_lang(group).items():
                words, flat, stops = word_ids([group[i][1] for i in which])
                if words:
                    grams, ends, _, border = text_grams(words, flat, stops, across)
                    times = np.repeat(np.bincount(flat, minlength=len(words)), np.diff(ends, prepend=0))
                    if border is not None:
                        times = np.concatenate([times, np.repeat(np.bincount(border), 2)])
                    rows = _summed_grams(grams, times)
                    counts.setdefault(lang, []).append(rows)
                    held += len(rows)
            if held > 800_000 and (held := merge()) > 600_000:
                yield from flush()
                held = 0
        yield from flush()

    own = _docs(docs).select("doc_id", F.coalesce(F.col("text").cast("string").cast("binary"), F.lit(b"")).alias("text"), "lang")
    return map_docs(own, work, "lang string, a long, b long, n long").groupBy("lang", "a", "b").agg(F.sum("n").alias("n"))


def kneser_ney(counts: DataFrame) -> DataFrame:
    """The model: lang, k (order), a, b (the n-gram's characters, packed), p (interpolated probability of its last
    character) and back (weight of the next lower order where this n-gram is the context; null at the highest order)."""
    low = (1 << _BITS) - 1
    grams = {ORDER: counts.select("lang", *(F.shiftright(c, s).bitwiseAND(F.lit(low)).alias(f"c{i}") for i, (c, s) in enumerate((("a", _BITS), ("a", 0), ("b", _BITS), ("b", 0)))), "n")}
    for k in range(ORDER - 1, 0, -1):  # lower orders count in how many places an n-gram continues something
        grams[k] = cut(grams[k + 1].groupBy("lang", *(f"c{i}" for i in range(ORDER - k, ORDER))).agg(F.count("*").alias("n")), "grams")
    model = probabilities = None
    for k in range(1, ORDER + 1):
        own = grams[k]
        cols = [f"c{i}" for i in range(ORDER - k, ORDER)]
        context = ["lang", *cols[:-1]]
        few = own.groupBy("lang").agg(*(F.sum((F.col("n") == i).cast("double")).alias(f"n{i}") for i in range(1, 5)))
        y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
        safe = lambda i: F.when(F.col(f"n{i}") > 0, F.greatest(F.lit(0.05), F.least(F.lit(0.95 * i), F.lit(i) - (i + 1) * y * F.col(f"n{i + 1}") / F.col(f"n{i}")))).otherwise(F.lit(0.5 * i))  # noqa: E731, B023
        discounts = few.withColumn("y", F.when(F.col("n1") > 0, y).otherwise(0.5)).select("lang", safe(1).alias("d1"), safe(2).alias("d2"), safe(3).alias("d3"))
        kind = lambda i: F.sum((F.col("n") == i).cast("double") if i < 3 else (F.col("n") >= 3).cast("double"))
        totals = own.groupBy(*context).agg(F.sum("n").cast("double").alias("total"), *(kind(i).alias(f"k{i}") for i in (1, 2, 3)), F.count("*").alias("types"))
        totals = totals.join(discounts, "lang").select(*context, "total", "d1", "d2", "d3", ((F.col("d1") * F.col("k1") + F.col("d2") * F.col("k2") + F.col("d3") * F.col("k3")) / F.col("total")).alias("gamma"), "types")
        own = own.join(totals, context)
        taken = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        seen = F.greatest(F.col("n") - taken, F.lit(0.0)) / F.col("total")
        if k == 1:
            own = own.withColumn("p", seen + F.col("gamma") / (F.col("types") + 1))  # one share is left for characters never met
        else:
            own = own.join(probabilities.withColumnRenamed("p", "lower"), ["lang", *cols[1:]]).withColumn("p", seen + F.col("gamma") * F.col("lower"))
        probabilities = cut(own.select("lang", *cols, "p"), "probabilities")
        four = [F.lit(0).cast("long")] * (ORDER - k) + [F.col(c) for c in cols]
        table = probabilities.select("lang", F.lit(k).alias("k"), _packed(four[:2]).alias("a"), _packed(four[2:]).alias("b"), "p")
        if k > 1:  # the weight belongs to the context, which is an n-gram of order k - 1
            ctx = [F.lit(0).cast("long")] * (ORDER - k + 1) + [F.col(c) for c in cols[:-1]]
            back = totals.select("lang", F.lit(k - 1).alias("k"), _packed(ctx[:2]).alias("a"), _packed(ctx[2:]).alias("b"), "gamma")
            model = model.unionByName(back.select("lang", "k", "a", "b", F.lit(None).cast("double").alias("p"), F.col("gamma").alias("back")))
        table = table.withColumn("back", F.lit(None).cast("double"))
        model = table if model is None else model.unionByName(table)
        if k == 1:
            base = totals.select("lang", F.lit(0).alias("k"), F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"), (F.col("gamma") / (F.col("types") + 1)).alias("p"), F.lit(None).cast("double").alias("back"))
            model = model.unionByName(base)
    return model.groupBy("lang", "k", "a", "b").agg(F.max("p").alias("p"), F.max("back").alias("back"))


def _packed(two: list):
    return F.shiftleft(two[0], _BITS).bitwiseOR(two[1])


def gram_hash(lang: str, k: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """64-bit hashes of n-grams of one language and order."""
    import xxhash

    h = a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(xxhash.xxh64_intdigest(lang.encode(), k))
    for shift, factor in ((32, 0xD6E8FEB86659FD93), (29, 0xC2B2AE3D27D4EB4F)):
        h ^= h >> np.uint64(shift)
        h *= np.uint64(factor)
        if factor == 0xD6E8FEB86659FD93:
            h ^= b.astype(np.uint64) * np.uint64(0x165667B19E3779F9)
    return h ^ h >> np.uint64(32)


class HashModel:
    """Sorted hashes with log probabilities and back-off weights."""

    def __init__(self, keys: np.ndarray, log_p: np.ndarray, log_back: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.log_p, self.log_back = keys[order], log_p[order], log_back[order]

    @classmethod
    def of(cls, rows) -> HashModel:
        """From (lang, k, a, b, p, back) columns as arrays."""
        lang, k, a, b, p, back = rows
        keys = np.empty(len(a), np.uint64)
        for name in set(lang.tolist()):
            for order in range(ORDER + 1):
                at = np.flatnonzero((lang == name) & (k == order))
                keys[at] = gram_hash(name, order, a[at], b[at])
        with np.errstate(divide="ignore", invalid="ignore"):
            return cls(keys, np.log(p).astype(np.float32), np.log(np.where(np.isnan(back), 1.0, back)).astype(np.float32))

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Places of keys, -1 for those that aren't there."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, at, -1)

    def score(self, lang: str, grams: np.ndarray) -> np.ndarray:
        """Log probability of each 4-gram's last character; falls back to lower orders for n-grams never met."""
        out, todo = np.zeros(len(grams)), np.arange(len(grams))
        for k in range(ORDER, -1, -1):
            if not len(todo):
                break
            own = grams[todo].copy()
            own[:, : ORDER - k] = 0
            at = self.find(gram_hash(lang, k, own[:, 0] << _BITS | own[:, 1], own[:, 2] << _BITS | own[:, 3]))
            hit = (at >= 0) & ~np.isnan(self.log_p[at])
            out[todo[hit]] += self.log_p[at[hit]]
            todo, own = todo[~hit], own[~hit]
            if k == 0:
                out[todo] += -math.log(0x110000)  # a language without a model
            elif len(todo) and k > 1:
                ctx = np.concatenate([np.zeros((len(own), 1), np.int64), own[:, :-1]], 1)
                ctx[:, : ORDER - k + 1] = 0
                at = self.find(gram_hash(lang, k - 1, ctx[:, 0] << _BITS | ctx[:, 1], ctx[:, 2] << _BITS | ctx[:, 3]))
                out[todo] += np.where(at >= 0, self.log_back[at], 0.0)
        return out


def _log_sums(log_p: np.ndarray, ends: np.ndarray, border: np.ndarray | None) -> tuple[np.ndarray, np.ndarray | None]:
    """The words' own sums and each border's, from the log probabilities of text_grams' rows."""
    own = int(ends[-1]) if len(ends) else 0
    return _sums(log_p[:own], ends), None if border is None else log_p[own:].reshape(-1, 2).sum(1)


def _score_group(group: list[tuple], score: Callable[[str, list[bytes], np.ndarray, np.ndarray], tuple]) -> dict:
    """Statistics and scores of (doc_id, text, lang) rows; score gives each distinct word's log probability, its number of
    predicted characters, and each border's log probability and each word's border, or None and None."""
    import xxhash

    out = {n: [None] * len(group) for n in [x.split()[0] for x in SCORED.split(", ")]}
    for lang, which in _by_lang(group).items():
        words, flat, stops = word_ids([group[i][1] for i in which])
        log_p, n, between, border = score(lang, words, flat, stops)
        for i, a, b in zip(which, [0, *stops[:-1].tolist()], stops.tolist(), strict=True):
            ids = flat[a:b]
            doc_id, text, _ = group[i]
            for name, v in zip([x.split()[0] for x in STATS.split(", ")], text_stats(text, ids), strict=True):
                out[name][i] = v
            out["doc_id"][i], out["lang"][i] = doc_id, lang
            out["text_hash"][i] = (xxhash.xxh64_intdigest(text, 42) + (1 << 63)) % (1 << 64) - (1 << 63)
            own = log_p[ids].tolist() + ([] if between is None else between[border[a:b]].tolist())
            out["n_predicted"][i], out["log_prob"][i] = int(n[ids].sum()), math.fsum(own)
    return out


def _sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(values)])
    return total[ends] - total[np.concatenate([[0], ends[:-1]])] if len(ends) else np.zeros(0)


def score_documents(docs: DataFrame, model: DataFrame, model_rows: int = MODEL_ROWS, across: bool = False) -> DataFrame:
    """doc_id, lang, the base statistics, n_predicted characters, the sum of their log probabilities, and Spark's xxhash64
    of the text. across as in count_grams."""
    spark = docs.sparkSession
    own = _docs(docs).select("doc_id", F.coalesce(F.col("text").cast("string").cast("binary"), F.lit(b"")).alias("text"), "lang")
    if model.count() <= model_rows:  # 16 bytes each in the arrays
        table = model.toArrow()
        rows = [np.array(table.column("lang").to_pylist(), object), *(table.column(c).to_numpy() for c in ("k", "a", "b"))]
        rows += [np.array(table.column(c).to_numpy(zero_copy_only=False), float) for c in ("p", "back")]
        sent = spark.sparkContext.broadcast(HashModel.of(rows))

        def work(batches) -> Iterator[dict]:
            known = sent.value

            def score(lang, words, flat, stops):
                grams, ends, size, border = text_grams(words, flat, stops, across)
                log_p, between = _log_sums(known.score(lang, grams), ends, border)
                return log_p, size, between, border

            for group in chunks(rows_of(batches, "doc_id", "text", "lang")):
                yield _score_group(group, score)

        return map_docs(own, work, SCORED)
    return _score_in_parts(own, model, across)


def _score_in_parts(own: DataFrame, model: DataFrame, across: bool) -> DataFrame:
    """The same for a model of any size: every n-gram of a document was counted, so parts look up order 4 only."""
    buckets = n_parts(own)
    dealt = deal(own, buckets, "lang")

    def part_grams(rows):
        for lang, which in sorted(_by_lang(rows).items()):
            words, flat, stops = word_ids([rows[i][1] for i in which])
            grams, *found = text_grams(words, flat, stops, across)
            yield lang, gram_hash(lang, ORDER, grams[:, 0] << _BITS | grams[:, 1], grams[:, 2] << _BITS | grams[:, 3]), found

    def keys_of(rows) -> np.ndarray:
        return np.unique(np.concatenate([x[1] for x in part_grams(rows)]))

    def wanted(rows) -> Iterator[tuple[int, bytes]]:
        keys = keys_of(rows)
        for bucket, a, b in slices(bucket_of(keys, buckets)):
            yield bucket, blob(keys[a:b])

    def pieces(batches) -> Iterator[dict]:
        for batch in batches:
            lang = np.array(batch.column(0).to_pylist(), object)
            k, a, b = (batch.column(i).to_numpy() for i in (1, 2, 3))
            p, back = (np.array(batch.column(i).to_numpy(zero_copy_only=False), float) for i in (4, 5))
            held = HashModel.of((lang, k, a, b, p, back))
            for bucket, i, j in slices(bucket_of(held.keys, buckets)):
                yield {"bucket": [bucket], "part": [-1], "body": [blob(held.keys[i:j], held.log_p[i:j])]}

    def looked_up(blocks) -> Iterator[tuple[int, bytes]]:
        mine = [unblob(body) for p, body in blocks if p < 0]
        none = np.zeros(0, np.float32)
        held = HashModel(*(np.concatenate([x[i] for x in mine]) if mine else none for i in (0, 1, 1)))
        for p, body in blocks:
            if p >= 0:
                yield p, blob(held.log_p[held.find(unblob(body)[0])])

    def scored(rows, blocks) -> dict:
        keys, log_p = keys_of(rows), np.concatenate([unblob(b)[0] for _, b in blocks]) if blocks else np.zeros(0)
        found = {}
        for lang, hashes, (ends, size, border) in part_grams(rows):
            own, between = _log_sums(log_p[np.searchsorted(keys, hashes)].astype(float), ends, border)
            found[lang] = (own, size, between, border)
        return _score_group(rows, lambda lang, *_: found[lang])

    highest = map_docs(model.where(F.col("k") == ORDER).select("lang", "k", "a", "b", "p", "back"), pieces, "bucket int, part int, body binary")
    return finish(dealt, answer(ask(dealt, wanted).unionByName(highest), looked_up), scored, SCORED)


#: The logarithms of perplexity, with their bounds' names and what they are the average of.
_MEASURES = {"log_perplexity": ("low", "high", "n_predicted"), "log_perplexity_word": ("low_word", "high_word", "n_words")}


def bands(scored: DataFrame, band: float = BAND) -> DataFrame:
    """lang, low, high, low_word, high_word: bounds of the logarithms of perplexity per character and per word. A language's
    rows are first counted in steps of 0.001; a band is at least one step wide on either side."""
    each = F.explode(F.array(*(F.struct(F.lit(m).alias("measure"), F.round(-F.col("log_prob") / F.col(n) * 1000).cast("long").alias("x")) for m, (_, _, n) in _MEASURES.items()))).alias("m")
    steps = scored.where("n_predicted > 0 and n_words > 0").select("lang", each).select("lang", "m.*").groupBy("lang", "measure", "x").agg(F.count("*").alias("n"))
    by = ["lang", "measure"]

    def middle(table: DataFrame, value: str) -> DataFrame:
        from pyspark.sql import Window

        w = Window.partitionBy(*by).orderBy(value)
        ranked = table.withColumns({"upto": F.sum("n").over(w), "all": F.sum("n").over(Window.partitionBy(*by))})
        return ranked.where(F.col("upto") * 2 >= F.col("all")).groupBy(*by).agg(F.min(value).alias(f"mid_{value}"), F.max("all").alias("all"))

    centre = middle(steps, "x")
    spread = middle(steps.join(centre.drop("all"), by).select(*by, "n", F.abs(F.col("x") - F.col("mid_x")).alias("off")), "off")
    wide = F.greatest(F.lit(band) * F.col("mid_off"), F.when(F.col("all") < FEW, F.lit(LEAST_BAND * 1000)).otherwise(F.lit(1.0)))
    bounds = centre.drop("all").join(spread, by).select(*by, ((F.col("mid_x") - wide) / 1000).alias("low"), ((F.col("mid_x") + wide) / 1000).alias("high"))
    return bounds.groupBy("lang").agg(*(F.max(F.when(F.col("measure") == m, F.col(side))).alias(name) for m, names in _MEASURES.items() for side, name in zip(("low", "high"), names[:2], strict=True)))


def judge_quality(docs: DataFrame, band: float = BAND, model_rows: int = MODEL_ROWS) -> DataFrame:
    """doc_id, lang, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, log_perplexity (per
    character), log_perplexity_word, their bounds low, high, low_word and high_word, kept, text_hash (Spark's xxhash64 of
    the text).

    Null and empty texts have no words, fail the base rule and have null perplexities. A null lang is a language of
    its own, named ''. Repeated rows are judged each by itself. kept is false where base_failed, else whether the
    logarithms of both perplexities lie within their language's bands.
    """
    model = cut(kneser_ney(cut(count_grams(docs, across=True), "grams")), "model")
    # Every n-gram of these documents was counted, so none falls back to a lower order.
    scored = cut(score_documents(docs, model.where(F.col("k") == ORDER), model_rows, across=True), "scored")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    scored = scored.withColumn("base_failed", failed).withColumns({m: F.when(F.col(n) > 0, -F.col("log_prob") / F.col(n)) for m, (_, _, n) in _MEASURES.items()})
    judged = scored.join(bands(scored.where("not base_failed"), band), "lang", "left")
    within = [F.coalesce(F.col(m).between(F.col(low), F.col(high)), F.lit(False)) for m, (low, high, _) in _MEASURES.items()]
    bounds = [x for names in _MEASURES.values() for x in names[:2]]
    return judged.select("doc_id", "lang", *(x.split()[0] for x in STATS.split(", ")), "base_failed", *_MEASURES, *bounds, (~F.col("base_failed") & within[0] & within[1]).alias("kept"), "text_hash")
