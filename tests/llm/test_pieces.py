import math
import random

import numpy as np
import public_tokenizers as P

from skein.llm import pieces

from .helpers import ODD, clash, frame

PATH = P.path("piece_bpe_32k.model")


def brute(model, text):
    """Best score over all segmentations, by dynamic programming over every substring."""
    scores = {w: v[1] for w, v in model.automaton.items()}
    text = text.replace(" ", pieces.MARK)
    best = [0.0] + [-math.inf] * len(text)
    for j in range(1, len(text) + 1):
        for i in range(max(0, j - 20), j):
            if text[i:j] in scores:
                best[j] = max(best[j], best[i] + scores[text[i:j]])
        if text[j - 1] not in model.single:
            best[j] = max(best[j], best[j - 1] + pieces.BYTE_SCORE * len(text[j - 1].encode()))
    return best[-1]


def score(model, ids):
    of = {v[2]: v[1] for v in model.automaton.values()}
    return sum(of.get(i, pieces.BYTE_SCORE) for i in ids)


def test_best_segmentation_and_round_trip():
    coder, rng = pieces.PieceEncoder(PATH, most=8_000), random.Random(0)
    signs = ["the", " ", "  ", "ing", "é", "\n", "ß", "x", "漢", "𝔘", ".", "▁", "under", "stand", "\t", "€", "\x00", "   "]
    texts = [t for t in ODD if t and len(t) < 10**4] + ["".join(rng.choice(signs) for _ in range(rng.randint(0, 25))) for _ in range(600)]
    ids, stops = coder.encode([t.encode() for t in texts])
    for t, own in zip(texts, np.split(ids, stops[:-1]), strict=True):
        assert coder.pieces.decode(own.astype(np.int64)) == t.encode(), t
        if t and "▁" not in t:
            assert abs(score(coder.pieces, own.tolist()) - brute(coder.pieces, " " + t)) < 1e-6, t


def test_columns(spark):
    got = {r.doc_id: r for r in pieces.decode_pieces(pieces.encode_pieces(clash(frame(spark, ODD)), PATH), PATH).collect()}
    assert [got[i].text for i in range(len(ODD))] == [t or "" for t in ODD]
    assert got[0].n_pieces == got[1].n_pieces == 0 and got[4].ids_crc32 == got[5].ids_crc32
    assert pieces.encode_pieces(frame(spark, []), PATH).count() == 0
