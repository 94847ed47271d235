import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from skein.llm.packing import pack, pack_documents
from skein.llm.tokens import ChunkEncoder, Spaced, Words

from .helpers import ODD, clash, frame


@pytest.mark.parametrize(("name", "split"), [("word_bpe_49k.json", Words), ("byte_bpe_50k.json", Spaced)])
def test_chunks_give_the_ids_of_the_whole_text(name, split):
    rng = random.Random(5)
    signs = ["a", "The", "é", "ß", "É", "'s", "don't", " ", "  ", "\n", "\t", "\r\n", " ", " ", "́", "1", "42", "!!", ".", "漢字", "𝔘", "<|endoftext|>", "\x1c", "\x85", "Σ", "ΑΣ", "\x00", "İ", "ÀÉ", "naïve", "foo", "bar.", "ﬁ", "x²"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 30))) for _ in range(3000)] + [t for t in ODD if t]
    words = ["foo", "Bar,", "été.", "ÜBER!!", "it's", "x|y", "a1b2", "don't"]
    texts += ["".join(rng.choice(words) + rng.choice([" ", " ", " ", "\n"]) for _ in range(rng.randint(0, 30))).strip() for _ in range(500)]
    whole = Tokenizer.from_file(P.path(name))
    whole.encode_special_tokens = True
    ids, stops = ChunkEncoder(P.path(name), split).encode([t.encode() for t in texts])
    for t, got in zip(texts, np.split(ids, stops[:-1]), strict=True):
        assert whole.encode(t, add_special_tokens=False).ids == got.tolist(), t

    small, at = ChunkEncoder(P.path(name), split, most=3_000), 0
    for t in texts[:400]:
        got, _ = small.encode([t.encode()])
        assert got.tolist() == ids[at : at + len(got)].tolist()
        at += len(got)


def test_pack_covers_everything_once_without_padding():
    rng = random.Random(1)
    for capacity in (1, 8, 4096):
        lengths = [rng.choice([1, 2, 3, capacity, capacity * 2, rng.randint(1, 3 * capacity)]) for _ in range(200)]
        pieces, sizes = pack(lengths, capacity)
        for d, n in enumerate(lengths):
            own = sorted((a, k) for e, a, k, _, _ in pieces if e == d)
            assert [a for a, _ in own] == np.cumsum([0] + [k for _, k in own]).tolist()[:-1] and sum(k for _, k in own) == n
        for s, size in enumerate(sizes):
            own = sorted((o, k) for _, _, k, t, o in pieces if t == s)
            assert [o for o, _ in own] == np.cumsum([0] + [k for _, k in own]).tolist()[:-1] and sum(k for _, k in own) == size
            assert size == capacity or size & (size - 1) == 0


def test_costs_are_balanced():
    rng = random.Random(2)
    pieces, sizes = pack([rng.randint(20, 2000) for _ in range(3000)], 4096)
    cost = np.zeros(len(sizes))
    for _, _, n, s, _ in pieces:
        cost[s] += n + n * n / 4096
    full = cost[[s for s, k in enumerate(sizes) if k == 4096]]
    assert full.std() / full.mean() < 0.1


def test_pack_documents(spark):
    got = pack_documents(clash(frame(spark, ODD)), P.path("word_bpe_49k.json"), shard_tokens=500).collect()
    whole = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    for i, t in enumerate(ODD):
        ids = np.array([*whole.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        own = sorted((r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got if r.doc_id == i)
        at = 0
        for start, n, crc, total in own:
            assert start == at and total == len(ids) and crc == zlib.crc32(ids[start : start + n].tobytes())
            at += n
        assert at == len(ids)
    assert pack_documents(frame(spark, []), P.path("word_bpe_49k.json")).count() == 0


def test_dictionary_split():
    from skein.llm.common import dictionary_split

    texts = [b"", b" ", b"a b", b"  a\n\nb ", b"\x0b\x0cc\r\td", "é x \x1c y".encode(), b"a"]
    words, which, n = dictionary_split(texts)
    assert [words[i] for i in which] == [w for t in texts for w in t.split()] and n.tolist() == [len(t.split()) for t in texts]
    words, which, n = dictionary_split(texts, at_spaces=True)
    assert [words[i] for i in which] == [w for t in texts for w in t.split(b" ")]
    assert dictionary_split([])[0] == []
