"""SentencePiece encoding and decoding by an Aho-Corasick automaton (operator 8).

One automaton holds all pieces. A single pass over the characters follows its output links: each piece that ends at a
position relaxes the best score there. A piece model of merges has ranks instead of log probabilities; a piece of rank r
gets -log(r + RANK_OFFSET), as under Zipf's law. Characters that no piece spells fall back to their bytes' pieces.

No piece has a space mark behind another character, so a text falls into chunks that begin with its spaces, each encoded
once. The first space is added, as the model wants it; decoding takes it off again. A text's own space marks (U+2581)
are spelled as bytes, so decoding gives back every text exactly.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame

from skein.llm.common import chunks, doc_bytes, map_docs, rows_of
from skein.llm.tokens import ChunkEncoder

RANK_OFFSET, BYTE_SCORE = 2.0, -14.0
MARK = "▁"
ENCODED = "doc_id long, ids binary"
_CHUNKS = re.compile(rb" +[^ ]*")


class PieceModel:
    """Pieces of a SentencePiece model, as an automaton for encoding and as bytes for decoding."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        own = sentencepiece.SentencePieceProcessor(model_file=path)
        self.automaton, self.byte_id, spelled = ahocorasick.Automaton(), {}, []
        self.single: set[str] = set()
        for i in range(own.get_piece_size()):
            piece = own.id_to_piece(i)
            if own.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                spelled.append(bytes([int(piece[3:5], 16)]))
            elif own.is_control(i) or own.is_unknown(i) or own.is_unused(i):
                spelled.append(b"")
            else:
                rank = -own.get_score(i)
                # Runs of spaces have no rank in the model; the last rank is theirs.
                score = -math.log(min(max(rank, 0.0), own.get_piece_size()) + RANK_OFFSET)
                self.automaton.add_word(piece, (len(piece), score, i))
                spelled.append(piece.replace(MARK, " ").encode())
                if len(piece) == 1:
                    self.single.add(piece)
        self.automaton.make_automaton()
        lengths = np.array([len(b) for b in spelled], np.int64)
        self.flat, self.ends = np.frombuffer(b"".join(spelled), np.uint8), np.cumsum(lengths)
        self.starts, self.lengths = self.ends - lengths, lengths

    def encode(self, text: str) -> list[int]:
        """Best segmentation of a stretch of text with its spaces as they are. Ties: the longest last piece."""
        if MARK in text:  # the text's own marks become bytes
            parts = text.split(MARK)
            return list(chain.from_iterable(([self.byte_id[b] for b in MARK.encode()] if i else []) + (self.encode(x) if x else []) for i, x in enumerate(parts)))
        text = text.replace(" ", MARK)
        n = len(text)
        best, back = [-math.inf] * (n + 1), [None] * (n + 1)
        best[0] = 0.0
        found: dict[int, list] = {}
        for end, piece in self.automaton.iter(text):
            found.setdefault(end, []).append(piece)
        for end in range(n):
            top, via = -math.inf, None
            for length, score, i in found.get(end, ()):
                new = best[end + 1 - length] + score
                if new > top or new == top and via is not None and length > via[0]:
                    top, via = new, (length, i)
            if text[end] not in self.single:
                new = best[end] + BYTE_SCORE * len(text[end].encode("utf-8", "replace"))
                if new > top:
                    top, via = new, (1, -1)
            best[end + 1], back[end + 1] = top, via
        out, at = [], n
        while at:
            length, i = back[at]
            out.append([i] if i >= 0 else [self.byte_id[b] for b in text[at - 1].encode("utf-8", "replace")])
            at -= length
        return list(chain.from_iterable(reversed(out)))

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of ids; the first space is the encoder's."""
        n = self.lengths[ids]
        ends = np.cumsum(n)
        data = self.flat[np.repeat(self.starts[ids] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)].tobytes()
        return data[1:] if data[:1] == b" " else data


class _Marked:
    """Keys are chunks without their first space."""

    at_spaces = True

    @staticmethod
    def joined(text: bytes) -> bytes | None:
        return None if not text or b"  " in text or text[:1] == b" " or text[-1:] == b" " else text

    @staticmethod
    def keys(text: bytes) -> list[bytes]:
        return [x[1:] for x in _CHUNKS.findall(b" " + text)] if text else []


class PieceEncoder(ChunkEncoder):
    def __init__(self, path: str, most: int = 60 << 20):
        self.pieces, self.split, self.most = PieceModel(path), _Marked, most
        self.start()

    def _learn(self, new: list[bytes]) -> None:
        got = []
        for key in new:
            lines = (" " + key.decode("utf-8", "replace")).split("\n")  # a line feed is spelled as a byte, whatever is around it
            ids = self.pieces.encode(lines[0])
            for line in lines[1:]:
                ids.append(self.pieces.byte_id[10])
                ids += self.pieces.encode(line)
            got.append(ids)
        self._add(new, np.fromiter(chain.from_iterable(got), np.uint32), np.fromiter(map(len, got), np.int64, len(got)))


_encoders: dict[str, PieceEncoder] = {}


def _encoder(path: str) -> PieceEncoder:
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]


def encode_pieces(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id and the piece ids of its whole text, little-endian unsigned 32-bit. Null and empty texts have none."""

    def work(batches) -> Iterator[dict]:
        coder = _encoder(model_path)
        for group in chunks(rows_of(batches, "doc_id", "text")):
            ids, stops = coder.encode([t for _, t in group])
            yield {"doc_id": [d for d, _ in group], "ids": [x.astype("<u4").tobytes() for x in np.split(ids, stops[:-1])]}

    return map_docs(doc_bytes(docs), work, ENCODED)


def decode_pieces(encoded: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_pieces, ids_crc32 and the decoded text."""

    def work(batches) -> Iterator[dict]:
        model = _encoder(model_path).pieces
        for group in chunks(rows_of(batches, "doc_id", "ids")):
            yield {
                "doc_id": [d for d, _ in group],
                "n_pieces": [len(x) // 4 for _, x in group],
                "ids_crc32": [zlib.crc32(x) for _, x in group],
                "text": [model.decode(np.frombuffer(x, "<u4").astype(np.int64)).decode("utf-8", "replace") for _, x in group],
            }

    return map_docs(encoded, work, "doc_id long, n_pieces long, ids_crc32 long, text string")
