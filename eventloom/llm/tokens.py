"""Exact token ids of whole texts with the tokenizers library, one library call per distinct word.

Both vocabularies cut a text at white space before anything else, so the ids of
a text are the ids of its words in a row; a bounded two-generation cache keeps
the ids of recent words.  Texts with other white space at a word's edge, or that
hold a special token's string, go to the library as they are.
"""

from __future__ import annotations

import os
import re
from array import array
from functools import lru_cache

import numpy as np

END_ID = 2
GENERATION = 400_000


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class _Joined(Exception):
    """A word's edge is white space that may belong to its neighbour's."""


class _Words(dict):
    """word -> ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, encode):
        super().__init__()
        self.encode, self.old = encode, {}

    def __missing__(self, word: str) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            ids = self.encode(word)
        if len(self) >= GENERATION:
            self.old = dict(self)
            self.clear()
        self[word] = ids
        return ids


#: Characters of the byte-level alphabet: printable bytes stand for themselves, the others follow from 256.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_CHARS = {b: (b if b in _PRINTABLE else 256 + n) for b, n in zip(sorted(range(256), key=lambda b: (b in _PRINTABLE, b)), range(256), strict=True)}
#: Below this code point a Python letter is a letter of the vocabularies' patterns, and lower case is one to one.
_LATIN = "\u0250"


class Encoder:
    """``encode(text) -> bytes``: ids (little-endian unsigned 32-bit) without special tokens."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.t = Tokenizer.from_file(path)
        self.model = self.t.model
        special = [re.escape(x.content) for x in self.t.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(special)) if special else None
        # A word's own blank belongs to it where the vocabulary is byte-level; the other kind drops white space.
        self.spaced = "Lowercase" not in str(self.t.normalizer)
        self.words = _Words(self._spaced if self.spaced else self._dropped)
        self.line = len(self._whole("\n"))

    def _whole(self, s: str) -> bytes:
        return np.array(self.t.encode(s, add_special_tokens=False).ids, "<u4").tobytes() if s else b""

    def _letters(self, s: str) -> bytes:
        """Ids of one piece of letters (with its blank), straight from the library's model."""
        mapped = s.encode().decode("latin-1").translate(_BYTE_CHARS)
        return array("I", [x.id for x in self.model.tokenize(mapped)]).tobytes()

    def _plain(self, word: str) -> bool:
        return word.isalpha() and (word.isascii() or max(word) < _LATIN and "\u0130" not in word)

    def _spaced(self, word: str) -> bytes:
        if word[-1:].isspace() and word != "\n" or word[:1].isspace() and word[0] != "\n":
            raise _Joined
        if self._plain(word):
            return self._letters(" " + word)
        if len(word) > 1 and word[-1] in ".,;:!?" and self._plain(word[:-1]):
            return self.words[word[:-1]] + self._mark(word[-1])
        if word[:1] == "\n":
            return self._mark("\n") + self._letters(word[1:]) if self._plain(word[1:]) else self._whole(word)
        return self._whole(" " + word)

    def _dropped(self, word: str) -> bytes:
        if self._plain(word):
            return self._letters(word.lower())
        if len(word) > 1 and word[-1] in ".,;:!?" and self._plain(word[:-1]):
            return self.words[word[:-1]] + self._mark(word[-1])
        return self._whole(word)

    @lru_cache(64)  # noqa: B019
    def _mark(self, s: str) -> bytes:
        return self._whole(s)

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.special and self.special.search(text):
            return self._whole(text)
        if not self.spaced:
            return b"".join(map(self.words.__getitem__, text.replace("\n", " ").split(" ")))
        # Runs of white space are cut by what follows them, so they are left to the library.
        if "  " in text or "\n\n" in text or " \n" in text or "\n " in text:
            return self._whole(text)
        words = text.replace("\n", " \n").split(" ")
        first = words[0]
        words[0] = "\n"
        try:
            ids = b"".join(map(self.words.__getitem__, words))
        except _Joined:
            return self._whole(text)
        return self._whole(first) + ids[self.line :]


_HELD: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per Python worker."""
    if path not in _HELD:
        _HELD[path] = Encoder(path)
    return _HELD[path]
