import random

import corpus_pipeline
import numpy as np

from skein.llm import near_copies

from .helpers import ODD, clash, frame


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_firsts(texts, least=0.8):
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if sets[i] == sets[j] or len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]) > 0:
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return {i for i, r in enumerate(root) if i == r}


def family(rng, n_words, copies, changes):
    words = [f"w{rng.randrange(5000)}" for _ in range(n_words)]
    for _ in range(copies):
        own = list(words)
        for _ in range(changes):
            own[rng.randrange(n_words)] = f"w{rng.randrange(5000)}"
        yield " ".join(own)


def corpus():
    rng = random.Random(5)
    texts = [*ODD[:7], *ODD[10:]]
    for n_words, copies, changes in ((200, 6, 2), (200, 6, 4), (300, 8, 3), (80, 5, 1), (120, 5, 8), (60, 4, 0), (400, 12, 5), (150, 1, 0)):
        texts += family(rng, n_words, copies, changes)
    rng.shuffle(texts)
    return texts


def test_stage_against_brute_force(spark):
    texts = corpus()
    want = brute_firsts(texts)
    docs = clash(frame(spark, texts))
    got = corpus_pipeline.near_dedup(spark, docs, "")
    assert got.columns == docs.columns and {r.doc_id for r in got.collect()} == want and len(want) < len(texts) - 20
    split = near_copies.first_copies(docs, group=2)
    assert {r.d for r in split.collect()} == want


def test_likely_pairs_in_cells():
    sketch = np.zeros((4, 8), np.uint8)
    node, value, label = np.array([4, 1, 3, 2]), np.zeros(4, np.int64), np.array([4, 1, 3, 1])
    a, b = near_copies.likely_pairs(node, value, np.array([2, 2, 2, 2]), label, sketch)
    assert sorted(zip(a.tolist(), b.tolist(), strict=True)) == [(1, 3), (1, 4), (2, 3), (2, 4), (3, 4)]
    a, b = near_copies.likely_pairs(node, value, np.array([0, 1, 1, 0]), label, sketch)
    assert sorted(zip(a.tolist(), b.tolist(), strict=True)) == [(2, 3), (4, 1), (4, 3)]


def test_rows_with_one_id_or_none_are_judged_each_by_itself(spark):
    rng = random.Random(6)
    words = ["".join(rng.choice("bdfgk") + rng.choice("aeiou") for _ in range(2)) for _ in range(200)]
    good = [" ".join(rng.choice(words) for _ in range(80)) for _ in range(30)]
    rows = [(None, good[0], "en"), (None, "too short", "en"), (7, good[1], "en"), (7, "short as well", "en"), *((100 + i, t, "en") for i, t in enumerate(good[2:]))]
    left = corpus_pipeline.quality_rules(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string"), "")
    assert sorted((r.doc_id or 0, r.text) for r in left.collect() if (r.doc_id or 0) < 100) == [(0, good[0]), (7, good[1])]
    rows = [(None, good[0]), (None, good[0] + " more"), (None, good[0]), (5, good[1]), (5, good[1]), (5, good[2]), (6, good[2] + " more"), (6, good[3])]
    left = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    got = [(r.doc_id, r.text) for r in left.collect()]
    assert len(got) == 4 and sorted(got[i][0] or 0 for i in range(4)) == [0, 5, 5, 6]
    assert (5, good[2]) in got and (6, good[3]) in got and (5, good[1]) in got
    assert corpus_pipeline.near_dedup(spark, frame(spark, []), "").count() == 0


def test_a_forest_of_likely_rows_against_all_pairs():
    rng = random.Random(7)
    texts = sorted({t.encode() for n, changes in ((150, 6), (150, 9), (40, 1)) for t in family(rng, n, 25, changes)})
    sets = [near_copies.shingle_set(t) for t in texts]
    least = np.array([near_copies.min_hashes(x) for x in sets]).reshape(-1, near_copies.BANDS, near_copies.ROWS)
    rows = [(i, b, hash(least[i, b].tobytes())) for i in range(len(sets)) for b in range(near_copies.BANDS)]
    node, band, value = (np.array(x, np.int64) for x in zip(*rows, strict=True))
    side = np.full(len(rows), 2, np.int32)
    own = near_copies.likely_rows(node, value, band, side, node, least[node])
    assert 0 < own.sum() < len(rows)
    node, value, band, side = node[own], value[own], band[own], side[own]
    links = near_copies.forest(node, value, band, side, node, [sets[i] for i in node], 0.8)
    root = list(range(len(sets)))
    want = list(root)
    for a, b in links:
        assert near_copies.similarity(sets[a], sets[b]) >= 0.8
        x, y = sorted((root[a], root[b]))
        assert x != y  # trees only
        root = [x if r == y else r for r in root]
    for i in range(len(sets)):
        for j in range(i):
            if near_copies.similarity(sets[i], sets[j]) >= 0.8:
                x, y = sorted((want[i], want[j]))
                want = [x if r == y else r for r in want]
    assert root == want and 1 < len(set(root)) < len(sets)
    for i in range(0, len(sets), 7):
        assert np.allclose(near_copies.similarities(sets[i], sets), [near_copies.similarity(sets[i], x) for x in sets])
