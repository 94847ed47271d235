import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from skein.llm.repair import Shard, compress, encode_shard, read_shards, write_shards
from skein.llm.tables import shared_path

from .helpers import ODD, clash, frame


def test_round_trip_and_random_access():
    rng = random.Random(3)
    for n in (1, 2, 3, 50, 5000):
        for letters in (1, 2, 5, 60_000):
            ids = np.array([rng.randrange(letters) for _ in range(n)] + [7, 7, 8] * n, np.uint32)
            shard = Shard.parse(encode_shard([4, None], [n, 3 * n], ids))
            assert shard.doc_ids == [4, None] and shard.all().tolist() == ids.tolist()
            for _ in range(20):
                a = rng.randrange(len(ids))
                k = rng.randint(0, len(ids) - a)
                assert shard.read(a, k).tolist() == ids[a : a + k].tolist()


def test_rules_use_earlier_symbols_and_shorten():
    ids = np.tile(np.arange(10), 500)
    seq, rules = compress(ids, 10)
    assert len(seq) < len(ids) / 5 and all(max(r) < 10 + i for i, r in enumerate(rules.tolist()))


def test_files(spark):
    texts = ODD + ["again and again " * 50] * 40
    path = shared_path(spark, "shards")
    write_shards(clash(frame(spark, texts)), path, P.path("byte_bpe_50k.json"))
    got = sorted(map(tuple, read_shards(spark, path).collect()))
    whole, want, at = Tokenizer.from_file(P.path("byte_bpe_50k.json")), [], 0
    for i, t in enumerate(texts):
        ids = np.array([*whole.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert got == want


def test_empty_table(spark):
    path = shared_path(spark, "shards")
    write_shards(frame(spark, []), path, P.path("byte_bpe_50k.json"))
    assert read_shards(spark, path).count() == 0


def repeats(seq):
    """Pairs that could be replaced twice."""
    found, last = {}, {}
    for i, pair in enumerate(zip(seq, seq[1:])):
        if last.get(pair, -2) < i - 1:
            found[pair], last[pair] = found.get(pair, 0) + 1, i
    return [p for p, n in found.items() if n > 1]


@pytest.mark.parametrize("seed", range(12))
def test_exact_grammars_leave_no_pair_that_repeats(seed):
    rng = np.random.default_rng(seed)
    ids = rng.integers(0, 2 + 3 * (seed % 4), 700 if seed else 0).astype(np.uint32)
    terminals = int(ids.max(initial=0)) + 1
    seq, rules = compress(ids, terminals, exact=True)
    assert not repeats(seq.tolist())
    assert len(ids) < 9 or len(seq) + 2 * len(rules) < len(ids)
    body = encode_shard([1], [len(ids)], ids, exact=True)
    shard = Shard.parse(body)
    assert shard.all().tolist() == ids.tolist()
    for start, length in ((0, 5), (300, 40), (690, 10)):
        assert shard.read(start, length).tolist() == ids[start : start + length].tolist()
