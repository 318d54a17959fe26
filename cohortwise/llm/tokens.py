"""Token ids of whole texts, by a tokenizer file of the `tokenizers` library."""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Callable

import numpy as np

CACHE_WORDS = 400_000
# Latin letters of ASCII and Latin-1 in UTF-8, and signs of ASCII, that are one token run after them.
_SIMPLE = re.compile(
    rb"((?:[a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+)([!-/:-@\[-`{-~]*)")


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes are their
    own, the others are numbered from 256."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {**{b: chr(b) for b in own}, **{b: chr(256 + i) for i, b in enumerate(rest)}}


_LETTERS = _byte_letters()


class _Words(dict):
    """Ids of lower-case words; one that is not known is encoded when it is asked for.

    Words are kept in two halves of ``CACHE_WORDS`` / 2: when the newer is full it becomes the older,
    whose words come back when they are met again, and those not met in the meantime are forgotten.
    """

    def __init__(self, encode: Callable[[bytes], bytes]):
        super().__init__()
        self.encode = encode
        self.older: dict[bytes, bytes] = {}

    def __missing__(self, word: bytes) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            ids = self.encode(word)
        self[word] = ids
        return ids

    def bound(self) -> None:
        if len(self) > CACHE_WORDS // 2:
            self.older = dict(self)
            self.clear()


class WordTokenizer:
    """Encodes texts word by word, remembering the ids of words it has met.

    Right for byte-level tokenizers with word ends that lower-case, never join ids over white space,
    and split letters from signs.  A word of plain letters goes to the model at once, and signs
    after it are looked up; any other is encoded with all rules of the file; a text with something
    like a special token is encoded whole.  Ids come as little-endian unsigned 32-bit values.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.known = _Words(self._ids)

    def whole(self, text: bytes) -> bytes:
        ids = self.tokenizer.encode(text.decode("utf-8"), add_special_tokens=False).ids
        return np.array(ids, dtype="<u4").tobytes()

    def _letters(self, letters: str) -> bytes:
        return array("I", [t.id for t in self.model.tokenize(letters)]).tobytes()

    def _ids(self, word: bytes) -> bytes:
        """Ids of a word not yet known, by way of its letters without signs and in lower case."""
        if word.isalpha():  # ASCII letters are their own in the vocabulary
            return self._letters(word.decode("ascii"))
        plain = _SIMPLE.fullmatch(word)
        if not plain:
            return self.whole(word)
        stem, signs = plain.groups()
        if signs:
            return self.known[stem] + self.known[signs]
        low = word.decode("utf-8").lower().encode()
        if low != word:
            return self.known[low]
        return self._letters(low.decode("latin-1").translate(_LETTERS))

    def encode(self, texts: list[bytes]) -> list[bytes]:
        self.known.bound()
        ids_of = self.known.__getitem__
        # bytes.lower() is for ASCII alone; the tokenizer's rules do the rest.
        return [self.whole(t) if b"<|" in t else b"".join(map(ids_of, t.lower().split()))
                for t in texts]


_loaded: dict[str, WordTokenizer] = {}


def word_tokenizer(path: str) -> WordTokenizer:
    """One tokenizer a process, so that its words outlive a task."""
    if path not in _loaded:
        _loaded[path] = WordTokenizer(path)
    return _loaded[path]
