import random

import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

from skein.llm.tokens import ChunkEncoder, Spaced

PATH = P.path("byte_bpe_50k.json")


def test_a_word_is_tokenized_once_whatever_punctuation_follows():
    coder, given = ChunkEncoder(PATH, Spaced), []
    whole = coder._whole
    coder._whole = lambda texts: given.extend(texts) or whole(texts)
    coder.encode(["So onerrest, onerrest. onerrest!! onerrest été*** été".encode()])
    coder.encode([b"So onerrest; (onerrest) onerrest's onerrest"])
    said = "".join(given)
    # By itself once; what is before it, and an ending with an apostrophe, stay with it.
    assert said.count("onerrest") == 3 and said.count("été") == 1


def test_punctuation_behind_words_keeps_the_ids_of_the_whole_text():
    rng = random.Random(11)
    whole = Tokenizer.from_file(PATH)
    words = ["a", "The", "word", "12", "x9", "é", "Ü", "ÿ", "×", "÷", "ß÷", "x×", "日本", "Ω", "é", "²", "don't", "'", "o'", "'s", "\"q", "<|end", "...", "_", "\0", "\x7f"]
    tails = ["", "", ",", ".", "...", "!?", "***", "'", "',", ",'", "'s", "'s,", ".'s", "”", "…", ",é", "-b", "_", "\\", "]", "^", "`", "{|}~"]
    texts = ["".join(rng.choice(words) + rng.choice(tails) + rng.choice([" ", " ", " ", "\n"]) for _ in range(rng.randint(1, 12))).strip(" \n") for _ in range(4000)]
    coder = ChunkEncoder(PATH, Spaced)
    ids, stops = coder.encode([t.encode() for t in texts], 2)
    for t, got in zip(texts, np.split(ids, stops[:-1]), strict=True):
        assert [*whole.encode(t, add_special_tokens=False).ids, 2] == got.tolist(), t
    small, start = ChunkEncoder(PATH, Spaced, most=20_000), 0
    for t, stop in zip(texts[:800], stops.tolist()):
        assert small.encode([t.encode()], 2)[0].tolist() == ids[start:stop].tolist()
        start = stop
