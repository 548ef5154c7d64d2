"""Words of Latin letters go to the model alone; every text still has the ids of the whole tokenizer."""

import random

import numpy as np
import pytest

from tessella.llm import tokens
from tessella.llm.tokens import Encoder, tokenizer_path

FILES = [("byte_bpe_50k.json", "<u4"), ("word_bpe_49k.json", "<u2")]


class Forbidden:
    def __getattr__(self, name):
        raise AssertionError(f"{name} of the whole tokenizer was used")


@pytest.mark.parametrize(("name", "dtype"), FILES)
def test_words_pass_no_normalizer(name, dtype):
    tool = Encoder(tokenizer_path(name), dtype)
    text = "Plain words Straße über ÀÉÿ plain"
    whole, tool.tokenizer = tool.tokenizer, Forbidden()
    assert tool.encode([text]) == [np.array(whole.encode(text, add_special_tokens=False).ids, dtype).tobytes()]


@pytest.mark.parametrize(("name", "dtype"), FILES)
def test_letters_that_come_apart(name, dtype):
    """A letter that ends in a mark once it is normalised is no letter to the pre-tokenizer: the word goes on with the sign."""
    tool = Encoder(tokenizer_path(name), dtype)
    for text in ["Fİ<u", "İ|", "aक़.", "יִ! x", "İstanbul.", "\x1c Fİ<u"]:
        assert tool.encode([text]) == [np.array(tool.tokenizer.encode(text, add_special_tokens=False).ids, dtype).tobytes()], repr(text)


@pytest.mark.parametrize(("name", "dtype"), FILES)
def test_small_cache_and_mixed_letters(name, dtype, monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_CHUNKS", 50)
    tool, draw = Encoder(tokenizer_path(name), dtype), random.Random(3)
    signs = tokens.LETTERS + "     \n\t.,!'-09µªſİŉ́Σ中\x85\xa0\x1c×÷"
    texts = ["".join(draw.choices(signs, k=draw.randint(0, 90))) for _ in range(400)] + ["é" * n + " " + "z" * n for n in (62, 63, 64, 65, 200)] * 2
    for at in range(0, len(texts), 20):
        part = texts[at : at + 20]
        assert tool.encode(part) == [np.array(tool.tokenizer.encode(t, add_special_tokens=False).ids, dtype).tobytes() for t in part]


def test_chunks_of_words_with_and_without_the_fast_alternative():
    slow, draw = tokens.re.compile(tokens.PLAIN.pattern.split("|", 1)[1]), random.Random(4)
    assert tokens.PLAIN.pattern.startswith(f" ?[{tokens.LETTERS}]++")
    for _ in range(3000):
        text = "".join(draw.choices("azAZéßſİ中. ,<'\n\t\x85\u3000  09_", k=draw.randint(0, 40)))
        assert tokens.PLAIN.findall(text) == slow.findall(text), repr(text)
