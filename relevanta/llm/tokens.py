"""Byte-level BPE encoding with a bounded per-process cache of word encodings.

The tokenizer splits at every single space or line feed between two other characters, so the ids of a text are the
ids of its space-separated pieces one after another. Pieces repeat, so each process keeps theirs. A text with other
white space next to a split point is encoded in one call, and so is one that holds a special token's string, unless such
strings are to be plain text.

Defined results: an empty text has no ids; callers give null texts as empty ones.
"""

from __future__ import annotations

import functools
import re
from array import array

import numpy as np

from relevanta.llm.common import CACHES, chunks

CACHE_ENTRIES = 900_000
#: Letters, then ASCII marks: two words to the tokenizer.
_MARKED = re.compile(r"([^\W\d_]+)([!-/:-@\[-`{-~]+)")


class _Cache(dict):
    """Encodes what it lacks."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, key):
        ids = self[key] = self.encode(key)
        return ids


def byte_letters(tokenizer) -> dict[int, str]:
    """The letter by which byte-level BPE writes each byte, as the tokenizer itself writes it (texts in UTF-8)."""
    out: dict[int, str] = {}
    for code in [*range(0x100), *range(0x100, 0x110000, 0x40)]:
        if not 0xD800 <= code < 0xE000:
            for byte, letter in zip(chr(code).encode(), "".join(w for w, _ in tokenizer.pre_tokenizer.pre_tokenize_str(chr(code))), strict=True):
                out[byte] = letter
    return out


class PieceEncoder:
    """``plain``: strings of special tokens in a text are plain text; else each is its token's id, as the tokenizer's own
    calls have it."""

    def __init__(self, path: str, cache_entries: int = CACHE_ENTRIES, plain: bool = False):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain
        self.specials = [] if plain else [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.mapped = byte_letters(self.tokenizer)
        self.most = cache_entries
        self.cache, self.marks = _Cache(self.piece), _Cache(self._word)

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int32)

    def _word(self, mapped: str) -> bytes:
        return array("i", [t.id for t in self.tokenizer.model.tokenize(mapped)]).tobytes()

    def piece(self, piece: str) -> bytes | None:
        """Ids of a piece with the space or line feed before it, specials as plain text; None where it can't stand alone."""
        if piece.isalpha():
            return self._word("Ġ" + piece if piece.isascii() else (b" " + piece.encode()).decode("latin-1").translate(self.mapped))
        if (marked := _MARKED.fullmatch(piece)) and marked[1].isalpha():
            return self.cache[marked[1]] + self.marks[marked[2]]
        bare = piece[1:] if piece[:1] == "\n" else piece
        if not bare or bare[0].isspace() or bare[-1].isspace():
            return None
        words = self.tokenizer.pre_tokenizer.pre_tokenize_str(piece if bare is not piece else " " + piece)
        return b"".join([self.marks[w] if len(w) < 4 else self._word(w) for w, _ in words])

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit integers."""
        out: list[bytes] = []
        for i, j in chunks(texts, 1_000_000):
            out += self._encode(texts[i:j])
        return out

    def _encode(self, texts: list[str]) -> list[bytes]:
        if len(self.cache) > self.most:
            self.cache.clear()
        if len(self.marks) > self.most // 10:
            self.marks.clear()
        get, out = self.cache.__getitem__, []
        for text in texts:
            if any(mark in text for mark in self.specials):
                out.append(self._ids(text).tobytes())
                continue
            pieces = text.replace("\n", " \n").split(" ")
            cut = 0
            if pieces[0]:  # no space before the first one: read it after a line feed and drop that id
                pieces[0], cut = "\n" + pieces[0], 4
            else:
                del pieces[0]
            ids = list(map(get, pieces))
            out.append(self._ids(text).tobytes() if None in ids else b"".join(ids)[cut:])
        return out


@functools.lru_cache(maxsize=2)
def encoder(path: str, cache_entries: int = CACHE_ENTRIES, plain: bool = False) -> PieceEncoder:
    """One encoder per worker process and file; workers are reused by later tasks."""
    return PieceEncoder(path, cache_entries, plain)


CACHES.append(encoder)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


