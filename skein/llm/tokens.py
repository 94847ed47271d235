"""Tokenizing whole texts with the tokenizers library, one call for each distinct chunk instead of each occurrence.

A chunk is a stretch of text that the tokenizer's own pre-tokenizer never joins with its neighbours, so the ids of a
text are the ids of its chunks, one after the other.
"""

from __future__ import annotations

import gc
import os
import re
from itertools import chain, compress, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from skein.llm.common import dictionary_split

#: A cut before white space is safe behind printable ASCII or behind a two-byte letter (lead bytes C3 to DF: no white space).
_SPACED = re.compile(rb"(?<=[\x21-\x7e])(?=[ \n\t\r])|(?<=[\xc3-\xdf][\x80-\xbf])(?=[ \n\t\r])")
#: Bytes that ask for the careful way: control characters, and leads of characters that may be white space.
_ODD = bytes([*range(9), *range(11, 32), 127, 0xC2, *range(0xE0, 0x100)])
#: Keys whose texts can follow each other: nothing in them is changed but by lower-casing, which keeps the number of bytes.
_PLAIN = re.compile(rb"\n?(?:[\x21-\x7e]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")
_TOGETHER = 4096
#: Punctuation that the pre-tokenizer parts from a letter or digit before it (apostrophes may begin an ending), and the
#: last bytes of such letters and digits: of ASCII ones, and of those that begin with C3.
_TAIL = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
_ASCII = np.array([bytes([b]).isalnum() for b in range(256)])
_LATIN = np.array([0x80 <= b < 0xC0 and b not in (0x97, 0xB7) for b in range(256)])


class Words:
    """For tokenizers that lower-case and drop white space: words between ASCII white space."""

    at_spaces = False
    #: Whether keys may be cut between a word and punctuation behind it.
    parted = False

    @staticmethod
    def joined(text: bytes) -> bytes | None:
        return text

    @staticmethod
    def text(key: bytes) -> str:
        return key.decode("utf-8", "replace")

    #: What stands before a key's text, and whether it counts among the bytes of its tokens.
    before, counts = b" ", False


class Spaced:
    """For byte-level tokenizers, where white space goes with what follows: cuts before white space that follows text.

    A key stands for a chunk: one that begins with \\0 for what is after that, one that begins with a line feed for
    itself, any other for a space and itself.
    """

    at_spaces = True
    parted = True

    @staticmethod
    def joined(text: bytes) -> bytes | None:
        """The keys with spaces between them, unless some white space isn't a single space or line feed between words."""
        if text[:1] in b" \n" or len(text.translate(None, _ODD)) != len(text) or b"  " in text or b"\n\n" in text or b"\n " in text or b" \n" in text:
            return None
        return b"\0" + text.replace(b"\n", b" \n")

    @staticmethod
    def keys(text: bytes) -> list[bytes]:
        return [b"\0" + x for x in _SPACED.split(text)] if text else []

    @staticmethod
    def text(key: bytes) -> str:
        return (key[1:] if key[:1] == b"\0" else key if key[:1] == b"\n" else b" " + key).decode("utf-8", "replace")

    before, counts = b" ", True


class _Ids(dict):
    """Numbers keys in order of their first appearance."""

    def __missing__(self, key: bytes) -> int:
        self[key] = n = len(self)
        return n


def stretches(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Stretches of flat, one after the other."""
    stops = np.cumsum(lengths)
    return flat[np.repeat(starts - (stops - lengths), lengths) + np.arange(stops[-1] if len(stops) else 0)]


class ChunkEncoder:
    """encode(texts) gives the ids of many texts at once and where each text's ids end.

    At most about `most` bytes of distinct chunks and their ids are remembered; beyond that, those met only once so far are
    forgotten.

    New chunks are tokenized many at once, as one text. The tokens of the tokenizers here are bytes of the text, so the
    running number of bytes shows where each chunk's ids end; where it doesn't, chunks are tokenized one by one.

    Where the pre-tokenizer parts a word from the punctuation behind it, both are remembered by themselves: a word that is
    met with and without a comma is tokenized once.
    """

    parted = False

    def __init__(self, path: str, split, most: int = 90 << 20):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        vocabulary = self.tokenizer.get_vocab()
        self.token_bytes = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)
        for token, i in vocabulary.items():  # byte-level tokens have a character for each byte
            self.token_bytes[i] = len(token.removesuffix("</w>"))
        self.split, self.most = split, most
        pre = self.tokenizer.pre_tokenizer
        self.parted = split.parted and pre is not None and all(len(pre.pre_tokenize_str(t)) == 2 for t in (" a,.", " 7?", " \xe9***"))
        self.start()

    def start(self) -> None:
        self.known: dict[bytes, int] = {}
        self.flat, self.starts, self.lengths, self.met = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.key_bytes = 0

    def _whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def held_bytes(self) -> int:
        """About what the remembered chunks take: a key's object, its number, its entry in the table, and its ids."""
        return self.key_bytes + 150 * len(self.known) + 4 * len(self.flat)

    def _numbers(self, keys: list[bytes]) -> np.ndarray:
        """The numbers of keys, none of which comes twice; new ones are tokenized."""
        number = np.fromiter(map(self.known.get, keys, repeat(-1)), np.int64, len(keys))
        missing = np.flatnonzero(number < 0)
        if len(missing):
            new = [keys[i] for i in missing.tolist()]
            self._learn(new)
            number[missing] = np.fromiter(map(self.known.__getitem__, new), np.int64, len(new))
        return number

    def _learn(self, new: list[bytes]) -> None:
        plain = [k.isalnum() or _PLAIN.fullmatch(k) is not None for k in new]
        new = list(compress(new, plain)) + [k for k, p in zip(new, plain, strict=True) if not p]
        n = sum(plain)
        each = [self._together(new[i : min(i + _TOGETHER, n)]) for i in range(0, n, _TOGETHER)] + [self._alone(new[n:])]
        self._add(new, *(np.concatenate(x) for x in zip(*each, strict=True)))

    def _alone(self, keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        got = self._whole([self.split.text(k) for k in keys])
        return np.fromiter(chain.from_iterable(got), np.uint32), np.fromiter(map(len, got), np.int64, len(got))

    def _together(self, keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        before, counts = self.split.before, self.split.counts
        # Line feeds stand at the beginning of keys only, and in place of what is before the others.
        text = (before + before.join(keys)).replace(before + b"\n", b"\n")
        sizes = np.fromiter(map(len, keys), np.int64, len(keys))
        if counts:
            sizes += len(before)
            if b"\n" in text:
                sizes -= len(before) * np.fromiter((k[:1] == b"\n" for k in keys), bool, len(keys))
        ids = np.array(self._whole([text.decode()])[0], np.uint32)
        got, want = np.cumsum(self.token_bytes[ids]), np.cumsum(sizes)
        at = np.searchsorted(got, want)
        if not len(got) or got[-1] != want[-1] or (got[at] != want).any() or not self.token_bytes[ids].all():
            return self._alone(keys)
        return ids, np.diff(at + 1, prepend=0)

    def _add(self, keys: list[bytes], flat: np.ndarray, lengths: np.ndarray) -> None:
        self.known.update(zip(keys, range(len(self.known), len(self.known) + len(keys)), strict=True))
        self.key_bytes += sum(map(len, keys))
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(lengths) - lengths])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.flat = np.concatenate([self.flat, flat])
        self.met = np.concatenate([self.met, np.zeros(len(keys), np.int64)])

    def _forget(self) -> None:
        keys = list(self.known)
        keep = np.flatnonzero(self.met >= 2)
        if len(keep) > len(keys) // 2:
            keep = keep[np.argsort(-self.met[keep], kind="stable")[: len(keys) // 2]]
        lengths = self.lengths[keep]
        flat = stretches(self.flat, self.starts[keep], lengths)
        self.start()
        self._add([keys[i] for i in keep.tolist()], flat, lengths)
        self.met += 1

    def encode(self, texts: list[bytes], end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one uint32 array, and the end of each text in it; end_id follows each text if given."""
        if self.held_bytes() > self.most:
            self._forget()
        collecting = gc.isenabled()
        gc.disable()  # what is made here are many small lists without cycles
        try:
            keys, which, n = self._keys(texts)
            flat, lengths = self._ids(keys, np.bincount(which, minlength=len(keys)))
        finally:
            if collecting:
                gc.enable()
        if end_id is not None:
            which = np.insert(which, np.cumsum(n), len(keys))
            n = n + 1
            flat, lengths = np.append(flat, np.uint32(end_id)), np.append(lengths, 1)
        starts, own = (np.cumsum(lengths) - lengths)[which], lengths[which]
        ends = np.concatenate([[0], np.cumsum(own)])
        return stretches(flat, starts, own), ends[np.cumsum(n)] if len(n) else np.zeros(0, np.int64)

    def _keys(self, texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """Distinct keys of the texts, all keys as places among those, and how many each text has."""
        joined = [self.split.joined(t) for t in texts]
        keys, which, n = dictionary_split([t for t in joined if t is not None], self.split.at_spaces)
        if len(n) == len(texts):
            return keys, which, n
        place = _Ids(zip(keys, range(len(keys)), strict=True))
        parts, sizes, at, some = [], [], 0, iter(n.tolist())
        for text, own in zip(texts, joined, strict=True):
            if own is None:
                parts.append(np.fromiter(map(place.__getitem__, self.split.keys(text)), np.int64))
            else:
                size = next(some)
                parts.append(which[at : at + size])
                at += size
            sizes.append(len(parts[-1]))
        return list(place), np.concatenate(parts), np.array(sizes, np.int64)

    def _ids(self, keys: list[bytes], met: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All keys' ids, one after the other, and how many each has; met: how often each key is met."""
        if not self.parted:
            number = self._numbers(keys)
            self.met[number] += met
            return stretches(self.flat, self.starts[number], self.lengths[number]), self.lengths[number]
        words, word, cut, tails = _parts(keys)
        place = _Ids(zip(words, range(len(words)), strict=True))
        tail = np.fromiter(map(place.__getitem__, tails), np.int64, len(tails))
        number = self._numbers(list(place))
        self.met[number] += np.bincount(np.concatenate([word, tail]), np.concatenate([met, met[cut]]), len(number)).astype(np.int64)
        word, tail = number[word], number[tail]
        lengths = self.lengths[word]
        lengths[cut] += self.lengths[tail]
        each = np.insert(word, cut + 1, tail)
        return stretches(self.flat, self.starts[each], self.lengths[each]), lengths


def _parts(keys: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray, list[bytes]]:
    """Distinct keys without punctuation behind a letter or digit, each key's place among them, which keys had some, and
    the keys of what they had."""
    flat = pa.array(keys, pa.binary())
    flat = pa.Array.from_buffers(pa.string(), len(flat), flat.buffers())
    short = pc.ascii_rtrim(flat, characters=_TAIL)
    ends, data = np.frombuffer(short.buffers()[1], np.int32)[: len(keys) + 1], np.frombuffer(short.buffers()[2] or b"", np.uint8)
    size, stop = np.diff(ends), ends[1:]
    cut = np.flatnonzero((size > 0) & (size < np.diff(np.frombuffer(flat.buffers()[1], np.int32)[: len(keys) + 1])))
    last = data[stop[cut] - 1]
    cut = cut[_ASCII[last] | _LATIN[last] & (size[cut] > 1) & (data[stop[cut] - 2] == 0xC3)]
    some = np.zeros(len(keys), bool)
    some[cut] = True
    coded = pc.if_else(pa.array(some), short, flat).cast(pa.binary()).dictionary_encode()
    words, word = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy().astype(np.int64)
    return words, word, cut, [b"\0" + keys[i][n:] for i, n in zip(cut.tolist(), size[cut].tolist(), strict=True)]


_encoders: dict[tuple, ChunkEncoder] = {}


def encoder(path: str, split) -> ChunkEncoder:
    """This process's encoder; a reused Python worker keeps what it knows from task to task, but of one tokenizer only."""
    if (path, split) not in _encoders:
        _encoders.clear()
        _encoders[path, split] = ChunkEncoder(path, split)
    return _encoders[path, split]
