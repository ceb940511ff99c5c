"""Ids by pieces against the whole text encoded by the library, and how much is given to the library."""

from __future__ import annotations

import random

import numpy as np
import pytest

from billoom.llm import wordcodes
from billoom.llm.queries import vocabulary

KINDS = [("byte_bpe_50k.json", "byte_level"), ("word_bpe_49k.json", "word")]
ODD = [None, "", " ", "\n", "\n\n", " \n", "\n ", " a", "\na", "a\n", "a ", "a  b", "a \nb", "a\n b", "a\n\nb", "a\t\nb", "a\r\nb c", "\n's it", "it\n's 're", ".\na", "a.\n.b", "\x00 \x00\n\x00"]
ODD += ["a\x1c b\x1f\nc", "a \x1cb\n\x1dc", "a \x85b\n\x85c", "a\xa0 b \xa0c\n\u3000d", "a \u180eb\n\u200bc", "a \u2028b\n\u2029c", "a<|endoftext|>\nb", "e \u0301e\n\u0301", "\U0001f600\n\U0001f600 \U0001f600."]
CHARACTERS = ["a", "b", "Z", "\xe9", "\u4e2d", "7", "\u0663", "'s", "'", ".", ",", "!", "_", " ", " ", " ", "\n", "\n", "\t", "\r", "\x0b", "\x1c", "\x1f", "\x85", "\xa0", "\u2028", "\u3000", "\u180e", "\ufeff", "\u0301", "\x00", "\U0001f600"]


def whole(tokenizer, texts):
    return [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize(("name", "kind"), KINDS)
def test_ids_are_those_of_the_whole_text(name, kind):
    code, rng = wordcodes.coder.__wrapped__(vocabulary(name), kind), random.Random(3)
    for few in (6, len(CHARACTERS)):
        texts = ODD + ["".join(rng.choices(rng.sample(CHARACTERS, few), k=rng.randrange(30))) for _ in range(3000)]
        got = code.ids(texts) + code.ids(texts[::-1])[::-1]
        assert [np.frombuffer(x, "<u4").tolist() for x in got] == 2 * whole(code.tokenizer, texts)
    assert code.ids([]) == [] and code.ids([None, ""]) == [b"", b""]


class Counting:
    """A tokenizer that notes the characters it is given."""

    def __init__(self, tokenizer):
        self.tokenizer, self.given = tokenizer, 0

    def encode(self, text, **more):
        self.given += sum(map(len, text))
        return self.tokenizer.encode(text, **more)

    def encode_batch_fast(self, texts, **more):
        self.given += sum(map(len, texts))
        return self.tokenizer.encode_batch_fast(texts, **more)


def test_words_met_before_are_not_encoded_again_at_other_line_feeds():
    code = wordcodes.coder.__wrapped__(vocabulary("byte_bpe_50k.json"), "byte_level")
    words = [f"{a}{b}ord" for a in "bcdf" for b in "aeiou"]
    code.ids(["x " + " ".join(words) + "\n" + "\n".join(words)])
    code.tokenizer = Counting(code.tokenizer)
    texts = ["x " + " ".join(f"{a}.\n{b}" for b in words) for a in words]
    got = code.ids(texts)
    assert code.tokenizer.given == 0
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == whole(code.tokenizer.tokenizer, texts)


def test_pieces_whose_tokens_are_not_their_bytes():
    """A vocabulary whose texts are normalised: pieces are not parted by their tokens' bytes."""
    from tokenizers import normalizers

    code = wordcodes.coder.__wrapped__(vocabulary("byte_bpe_50k.json"), "byte_level")
    code.tokenizer.normalizer = normalizers.NFD()
    texts = ["caf\xe9 d\xe9j\xe0 vu\nna\xefve", "plain words"]
    assert [np.frombuffer(x, "<u4").tolist() for x in code.ids(texts)] == whole(code.tokenizer, texts)
