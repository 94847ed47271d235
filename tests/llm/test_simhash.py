import random

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skein.llm import simhash
from skein.llm.tables import components

from .helpers import ODD, clash, frame


def brute_components(ids, fps, distance=3):
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= distance:
                root[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        least[find(i)] = min(d, least.get(find(i), d))
    return [least[find(i)] for i in range(len(ids))]


def brute_fingerprint(text):
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def near(rng, n, families=6):
    centres = [rng.getrandbits(64) for _ in range(families)]
    out = []
    for _ in range(n):
        x = rng.choice(centres)
        for _ in range(rng.randint(0, 5)):
            x ^= 1 << rng.randrange(64)
        out.append(x)
    return out


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 10**6), st.sampled_from([1, 2, 8]))
def test_index_finds_all_within_distance(seed, fan):
    rng = random.Random(seed)
    fp = np.array(sorted(set(near(rng, 120))), np.uint64)
    group = np.array([rng.randrange(4) for _ in fp])
    order = np.lexsort((simhash.gray_rank(fp), group))
    fp, group = fp[order], group[order]
    if fan > 1:
        q, leaf = simhash.GrayIndex(fp, group, fan).search(fp, group, 3)
        want = {(i, j) for i in range(len(fp)) for j in range(len(fp)) if group[i] == group[j] and (int(fp[i]) ^ int(fp[j])).bit_count() <= 3}
        assert set(zip(q.tolist(), leaf.tolist(), strict=True)) == want


def test_gray_rank():
    codes = np.array([i ^ i >> 1 for i in range(1000)], np.uint64)
    assert simhash.gray_rank(codes).tolist() == list(range(1000))


@pytest.mark.parametrize("group", [10, 100_000])
def test_links_join_what_is_near(spark, group):
    fps = list(dict.fromkeys(near(random.Random(7), 400, 4) + [0]))
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    edges = simhash.link_fingerprints(df, group=group).collect()
    assert all((np.int64(r.a).view(np.uint64) ^ np.int64(r.b).view(np.uint64)).item() >= 0 for r in edges)
    found = {r.node: r.root for r in components(spark.createDataFrame([(r.a, r.b) for r in edges], "a long, b long")).collect()}
    assert [found.get(x, x) for x in signed] == brute_components(signed, fps)


def test_documents(spark):
    rng = random.Random(1)
    base = [rng.choice("abcdefghij") * rng.randint(1, 9) for _ in range(300)]
    texts = [*ODD]
    for _ in range(40):
        w = list(base)
        for _ in range(rng.choice([0, 1, 2, 40])):
            w[rng.randrange(len(w))] = "other"
        texts.append(" ".join(w).upper() if rng.random() < 0.3 else " ".join(w))
    texts += [" ".join(rng.choice("klmnop") * rng.randint(1, 9) for _ in range(n)) for n in range(1, 30)]
    got = {r.doc_id: r for r in simhash.near_duplicates(clash(frame(spark, texts))).withColumn("hex", F.lower(F.lpad(F.hex("fp"), 16, "0"))).collect()}
    fps = [brute_fingerprint(t) for t in texts]
    assert [got[i].hex for i in range(len(texts))] == [f"{x:016x}" for x in fps]
    assert [got[i].component_id for i in range(len(texts))] == brute_components(range(len(texts)), fps)
    assert simhash.near_duplicates(frame(spark, [])).count() == 0


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 30)] + [(129, 130), (200, 200), (300, 299)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {i: 100 for i in range(100, 131)} | {299: 299, 300: 299}
