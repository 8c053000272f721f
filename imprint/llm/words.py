"""Ids by the tokenizers library, with a bounded memo per worker for the word-level vocabulary.

``word_bpe_49k.json`` lower-cases, drops white space and never joins across it, so a
white-space-separated word has the same ids everywhere.  New words go to the library,
known ones are looked up.  Texts with characters whose normalisation depends on their
neighbours or on Unicode tables (combining marks, uncommon white space, scripts beyond
Latin) and texts that may hold special tokens go to the library whole.
"""

from __future__ import annotations

import os
import re
import sys
from array import array

import numpy as np

from imprint.llm.bpetrie import byte_letters

_ODD = bytes([*range(9), *range(14, 32), *range(127, 161)])
_WHOLE = re.compile("[\x00-\x08\x0e-\x1f\x7f-\xa0\u0130\u0250-\U0010ffff]")


# marks that form one piece of their own after letters (an apostrophe may begin one with letters)
_MARKS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum() and c != 39)
if sys.byteorder != "little":
    raise ImportError("ids are kept as little-endian 16-bit integers")


def whole(text: str) -> bool:
    """Whether the ids of a text can't be put together from those of its words."""
    if "<|" in text:
        return True
    try:
        raw = text.encode("latin-1")
    except UnicodeEncodeError:
        return bool(_WHOLE.search(text))
    return len(raw.translate(None, _ODD)) != len(raw)


class WordIds(dict):
    """Lower-cased word -> its ids as little-endian uint16 bytes; new words are asked from the library."""

    def __init__(self, path: str, memo: int = 250_000, longest: int = 64):
        super().__init__()
        self.old: dict[str, bytes] = {}  # the memo before this one: what is used again moves over
        self.longest = longest
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.no_padding()
        self.lib.no_truncation()
        self.limit = memo
        letter = {b: c for c, b in byte_letters().items()}
        self.letters = [letter[b] for b in range(256)]
        if self.lib.get_vocab_size() > 1 << 16:
            raise ValueError(f"{path}: ids of up to 16 bits are needed, it has {self.lib.get_vocab_size()}")
        self.tails: dict[str, bytes] = {}

    def _ids(self, text: str) -> bytes:
        return array("H", self.lib.encode(text, add_special_tokens=False).ids).tobytes()

    def _piece(self, word: str) -> bytes:
        """Ids of letters only, one piece: straight from the model, in its byte letters."""
        letters = word if word.isascii() else "".join(map(self.letters.__getitem__, word.encode("utf-8")))
        return array("H", [t.id for t in self.lib.model.tokenize(letters)]).tobytes()

    def _tail(self, marks: str) -> bytes:
        if marks not in self.tails:
            if len(self.tails) >= 10_000:
                self.tails.clear()
            self.tails[marks] = self._ids(marks)
        return self.tails[marks]

    def __missing__(self, word: str) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            ids = self._new(word)
        if len(word) <= self.longest:  # so that the memo's bytes are bounded
            if len(self) >= self.limit:
                self.old = dict(self)
                self.clear()
            self[word] = ids
        return ids

    def _new(self, word: str) -> bytes:
        stem = word.rstrip(_MARKS)
        if stem.isalpha():
            ids = self.get(stem) or self._piece(stem)
            if len(stem) < len(word):
                ids += self._tail(word[len(stem) :])
        else:
            ids = self._ids(word)
        return ids

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids (uint16) of each text, as ``encode(text, add_special_tokens=False)`` gives them."""
        get = self.__getitem__
        raw = [self._ids(t) if whole(t) else b"".join(map(get, t.lower().split())) for t in texts]
        return [np.frombuffer(r, "<u2") for r in raw]


_LOADED: dict[str, WordIds] = {}


def coder(path: str | None) -> WordIds:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    if path not in _LOADED:
        _LOADED[path] = WordIds(path)
    return _LOADED[path]


def blocks(texts: list[str | None], limit: int = 1 << 20):
    """Row ranges of a batch with about ``limit`` characters each."""
    size = np.cumsum([len(t or "") for t in texts]) // limit if texts else np.empty(0, np.int64)
    cuts = np.flatnonzero(np.diff(size)) + 1
    return zip([0, *cuts.tolist()], [*cuts.tolist(), len(texts)])
