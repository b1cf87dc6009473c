"""Pre-tokens of the lower-casing word BPE vocabulary, and their ids.

No pre-token of this vocabulary spans white space, so a text is first cut
into white-space separated words, and each distinct word into pre-tokens.
``split_word`` gives exactly the pre-tokens that the tokenizers library
forms (tests compare both).  Words whose characters all lie in the Latin
blocks, where Unicode's case mapping and classes are plain, are split
with one compiled expression; every other word goes through the library's
own normaliser and pre-tokeniser.  Special strings inside a word are cut
out first, as the library does by default.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np

from riskwave.llm.common import give_back, quiet_tokenizers

LATIN_END = 0x180                 # first code point outside the fast path
CACHE_ENTRIES = 400_000           # words, and pre-tokens, kept per worker


def _latin_class(kind: str) -> str:
    return "".join(re.escape(chr(c)) for c in range(LATIN_END)
                   if unicodedata.category(chr(c))[0] == kind)


_SEPARATORS = "\x1c\x1d\x1e\x1f"
# What both str.split() and the vocabulary's expression take as white space.
_WORD = re.compile(r"(?:[\x1c-\x1f]|\S)+")
_SPACE = "\t-\r \x85\xa0"
_LETTER, _NUMBER = _latin_class("L"), _latin_class("N")
# The contractions the vocabulary's pre-tokeniser splits off.
_CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")
_LATIN_PIECES = re.compile("|".join(
    [*_CONTRACTIONS, f"[{_LETTER}]+", f"[{_NUMBER}]", f"[^{_SPACE}{_LETTER}{_NUMBER}]+"]))
# U+0130 lower-cases to two characters, the second outside the blocks.
_NOT_LATIN = re.compile(f"[^\x00-įı-{chr(LATIN_END - 1)}]")


def _byte_marks() -> dict[int, str]:
    """Byte-level vocabularies spell a byte as its Latin-1 character where
    that is printable, and otherwise as the next character from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


_BYTE_MARKS = _byte_marks()


class Pretokens:
    def __init__(self, path: str):
        quiet_tokenizers()
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        special = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.special = special
        self._cut = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") \
            if special else None
        self._probe = min((s[:2] for s in special), default=None)
        self._ids = _WordIds(self)
        self.dtype = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")

    def words(self, text: str) -> list[str]:
        """White-space separated words (U+001C to U+001F are no white space here)."""
        return _WORD.findall(text) if any(c in text for c in _SEPARATORS) else text.split()

    def pretokens(self, text: str) -> list[str]:
        """The pre-tokens of a text in order; a special string counts as one."""
        plain = self._cut is None or self._probe not in text
        if plain and (text.isascii() or not _NOT_LATIN.search(text)):
            return _LATIN_PIECES.findall(text.lower())
        return [p for w in self.words(text) for p in self.split_word(w)]

    def split_word(self, word: str) -> list[str]:
        """The pre-tokens of a word in order; a special string counts as one."""
        if self._cut is not None and self._probe in word:
            out: list[str] = []
            for part in self._cut.split(word):
                if part in self.special:
                    out.append(part)
                elif part:
                    out.extend(self._plain(part))
            return out
        return self._plain(word)

    def _plain(self, text: str) -> list[str]:
        if text.isascii() or not _NOT_LATIN.search(text):
            return _LATIN_PIECES.findall(text.lower())
        norm = self.tokenizer.normalizer.normalize_str(text)
        return [norm[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(norm)]

    def ids_of(self, piece: str) -> list[int]:
        """Token ids of one pre-token, by the library's model."""
        if piece in self.special:
            return [self.special[piece]]
        marks = piece.encode().decode("latin-1").translate(_BYTE_MARKS)
        return [t.id for t in self.tokenizer.model.tokenize(marks)]

    def encode(self, text: str) -> bytes:
        """Little-endian ids of the whole text (``dtype`` wide)."""
        if len(self._ids) > CACHE_ENTRIES:
            self._ids.clear()
            self._ids.pieces.clear()
        return b"".join(map(self._ids.__getitem__, self.words(text)))

    def forget(self) -> None:
        """Drop the kept words, about 200 MB of a worker when all are there."""
        self._ids = _WordIds(self)
        give_back()


class _WordIds(dict):
    """word -> bytes of its ids, filled on demand."""

    def __init__(self, owner: Pretokens):
        super().__init__()
        self.owner, self.pieces = owner, {}

    def __missing__(self, word: str) -> bytes:
        out = b""
        for p in self.owner.split_word(word):
            got = self.pieces.get(p)
            if got is None:
                got = self.pieces[p] = np.array(self.owner.ids_of(p), self.owner.dtype).tobytes()
            out += got
        self[word] = out
        return out


_LOADED: dict[str, Pretokens] = {}


def loaded(path: str) -> Pretokens:
    """The tokenizer of this worker process, read once."""
    if path not in _LOADED:
        _LOADED[path] = Pretokens(path)
    return _LOADED[path]
