"""Ids of texts by the byte-level BPE vocabulary.

A text whose characters all lie in the Latin blocks, where Unicode's classes
are plain, is split into pre-tokens with one compiled expression, and each
distinct pre-token goes through the library's model once.

Any other text, and one that holds a special string, is cut into chunks
first: a run of white space with the run of other characters that follows
it.  No pre-token of a byte-level vocabulary reaches from a character that is
no white space into white space after it, and its look-ahead sees one
character only, so the ids of a text are those of its chunks.  Plain chunks
are split as above, all others go through the library as a whole.
"""

from __future__ import annotations

import re
import struct

import numpy as np

from riskwave.llm.common import quiet_tokenizers
from riskwave.llm.pretokens import _BYTE_MARKS, _LETTER, _NUMBER, _SPACE, LATIN_END

CACHE_ENTRIES = 300_000     # pre-tokens of a generation; two generations are kept
CACHE_CHARS = 64            # longest pre-token that is kept

# White space and what follows; U+001C to U+001F are none for the vocabulary.
_CHUNK = re.compile("(?:(?![\x1c-\x1f])\\s)*(?:[\x1c-\x1f]|\\S)+|\\s+")
# The contractions the vocabulary's pre-tokeniser splits off.
_CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"


def _pieces(letter: str, number: str, space: str) -> str:
    return (f"{_CONTRACTIONS}| ?[{letter}]+| ?[{number}]+| ?[^{space}{letter}{number}]+"
            f"|[{space}]+(?![^{space}])|[{space}]+")


_ASCII_PIECES = re.compile(_pieces("A-Za-z", "0-9", "\t-\r "))
_LATIN_PIECES = re.compile(_pieces(_LETTER, _NUMBER, _SPACE))
_NOT_LATIN = re.compile(f"[^\x00-{chr(LATIN_END - 1)}]")


class _Kept(dict):
    """key -> bytes of ids.  When a generation is full, the one before it is
    forgotten; what is still in use moves on."""

    def __init__(self, make):
        super().__init__()
        self.make, self.before = make, {}

    def __missing__(self, key: str) -> bytes:
        out = self.before.get(key)
        if out is None:
            out = self.make(key)
        if len(key) <= CACHE_CHARS:
            if len(self) >= CACHE_ENTRIES:
                self.before = dict(self)
                self.clear()
            self[key] = out
        return out


class ByteChunks:
    def __init__(self, path: str):
        quiet_tokenizers()
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.code = "H" if self.tokenizer.get_vocab_size() <= 1 << 16 else "I"
        self.dtype = np.dtype("<u2" if self.code == "H" else "<u4")
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self._special = re.compile("|".join(map(re.escape, special)) if special else "(?!)")
        self.pieces = _Kept(self._piece)

    def _pack(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}{self.code}", *ids)

    def _piece(self, piece: str) -> bytes:
        marks = piece.encode().decode("latin-1").translate(_BYTE_MARKS)
        return self._pack([t.id for t in self.tokenizer.model.tokenize(marks)])

    def encode(self, text: str) -> bytes:
        """Little-endian ids of the whole text (``dtype`` wide)."""
        if self._special.search(text) or (not text.isascii() and _NOT_LATIN.search(text)):
            return b"".join(map(self._chunk, _CHUNK.findall(text)))
        return self._plain(text)

    def _chunk(self, chunk: str) -> bytes:
        if _NOT_LATIN.search(chunk) or self._special.search(chunk):
            return self._pack(self.tokenizer.encode(chunk, add_special_tokens=False).ids)
        return self._plain(chunk)

    def _plain(self, text: str) -> bytes:
        pieces = (_ASCII_PIECES if text.isascii() else _LATIN_PIECES).findall(text)
        return b"".join(map(self.pieces.__getitem__, pieces))


_LOADED: dict[str, ByteChunks] = {}


def loaded(path: str) -> ByteChunks:
    """The vocabulary of this worker process, read once."""
    if path not in _LOADED:
        _LOADED[path] = ByteChunks(path)
    return _LOADED[path]
