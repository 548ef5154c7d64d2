"""Token ids of whole texts with a public tokenizer file, chunk by chunk.

The tokenizers split text before they merge: always before white space that follows other
characters, and always between letters and an ASCII sign. So a text is cut there, each distinct
chunk is encoded once by the library, and the ids of a text are the ids of its chunks in order.
Most chunks are one word of Latin letters after one space or none. What normalizer and pre-tokenizer make of such
a word is asked of them once, letter by letter, and the words themselves go to the library's model.
"""

from __future__ import annotations

import os
import re
import sys
import unicodedata
from array import array
from functools import lru_cache
from operator import attrgetter

import public_tokenizers

#: White space as the tokenizers have it: Python's \s also holds U+001C to U+001F.
SPACE, OTHER = r"[^\S\x1c-\x1f]", r"[\S\x1c-\x1f]"
#: Letters that end in a mark once a normalizer has taken them apart: such a word is not cut off.
MARKED = "".join(c for c in map(chr, range(sys.maxunicode + 1)) if c.isalpha() and not unicodedata.normalize("NFC", c).lower()[-1].isalpha())
CHUNK = re.compile(rf"{SPACE}*[^\W\d_]++(?<![{MARKED}])(?![^\s!-/:-@\[-`{{-~]|[\x1c-\x1f])|{SPACE}*{OTHER}+|{SPACE}+")
#: Letters that normalizers leave one by one, and a word of them.
LETTERS = "".join(map(chr, [*range(65, 91), *range(97, 123), *range(192, 215), *range(216, 247), *range(248, 256)]))
WORD = re.compile(rf" ?[{LETTERS}]+")
#: ``CHUNK`` for texts without these four characters; the first alternative is there for speed alone.
PLAIN = re.compile(rf" ?[{LETTERS}]++(?![^\s!-/:-@\[-`{{-~])|\s*+[^\W\d_]++(?<![{MARKED}])(?![^\s!-/:-@\[-`{{-~])|\s*+\S++|\s++")
CONTROL = "\x1c\x1d\x1e\x1f"
#: Distinct chunks in one generation of the cache; a worker keeps two generations.
CACHE_CHUNKS = 250_000
#: Longer chunks are encoded but not kept.
LONGEST_KEPT = 64
ID = attrgetter("id")


def tokenizer_path(name: str) -> str:
    return public_tokenizers.path(name)


class _Chunks(dict):
    """Ids of chunks as bytes: a chunk that is missing is taken from the older generation or encoded."""

    def __init__(self, encoder: Encoder, older: dict[str, bytes]) -> None:
        self.encoder, self.older, self.long = encoder, older, {}

    def __missing__(self, chunk: str) -> bytes:
        if len(chunk) > LONGEST_KEPT:
            if (found := self.long.get(chunk)) is None:
                found = self.long[chunk] = self.encoder.encode_chunk(chunk)
            return found
        if (found := self.older.get(chunk)) is None:
            found = self.encoder.encode_chunk(chunk)
        self[chunk] = found
        return found


class Encoder:
    """Ids as little-endian unsigned integers of ``dtype``, joined in bytes."""

    def __init__(self, path: str, dtype: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        #: Machine integers of this width are little-endian wherever the libraries used here run.
        self.code = {"<u2": "H", "<u4": "I"}[dtype]
        self.space, self.letters = self._words()
        self.known = _Chunks(self, {})

    def _words(self) -> tuple[str, dict[int, str]]:
        """What the space before a word becomes and what each of ``LETTERS`` does; no letters if words are not one piece of just these."""
        def pieces(text: str) -> list[str]:
            text = self.tokenizer.normalizer.normalize_str(text) if self.tokenizer.normalizer else text
            return [piece for piece, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]

        single = {ord(c): "".join(pieces(c)) for c in LETTERS}
        word, spaced = pieces(LETTERS), pieces(" " + LETTERS)
        added = [token.content for token in self.tokenizer.get_added_tokens_decoder().values()]
        if len(spaced) != 1 or word != [LETTERS.translate(single)] or not spaced[0].endswith(word[0]) or any(map(WORD.fullmatch, added)):
            return "", {}
        return spaced[0].removesuffix(word[0]), single

    def encode_chunk(self, chunk: str) -> bytes:
        # The test of ASCII words is the match once more, and faster.
        plain = self.letters and len(chunk) <= LONGEST_KEPT and (chunk.isascii() and chunk.removeprefix(" ").isalpha() or WORD.fullmatch(chunk))
        if plain:
            word = chunk.translate(self.letters)
            ids = map(ID, self.model.tokenize(self.space + word[1:] if word[0] == " " else word))
        else:
            ids = self.tokenizer.encode_batch_fast([chunk], add_special_tokens=False)[0].ids
        return array(self.code, ids).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Bytes of the ids of each text."""
        if len(self.known) > CACHE_CHUNKS:
            self.known = _Chunks(self, dict(self.known))
        known = self.known.__getitem__
        out = [b"".join(map(known, (CHUNK if any(c in text for c in CONTROL) else PLAIN).findall(text))) for text in texts]
        self.known.long = {}
        return out


@lru_cache(maxsize=4)
def encoder(path: str, dtype: str) -> Encoder:
    """One encoder for each worker process, tokenizer and width."""
    return Encoder(path, dtype)
