"""Subword lattice of byte strings under a unigram vocabulary, for many words at once.

The probability of a word is the sum over all its segmentations into vocabulary pieces of the product of the pieces'
probabilities, which are the vocabulary's own: a piece's rank is its score. Forward sums run in log space over byte
positions; pieces are found by the polynomial hash of a byte range. Words of a length up to ``SHORT`` are summed together,
position by position; longer ones (unspaced scripts, encoded data) each alone, in blocks of positions, some 4 microseconds a
byte, with memory for a hash and a sum a byte.
"""

from __future__ import annotations

import base64
import functools
import math
from array import array
from collections.abc import Iterator
from itertools import accumulate, islice

import numpy as np

_P = np.uint64(0x9E3779B97F4A7C15 | 1)
#: Numbers in the arrays of one step.
CELLS = 400_000
#: Bytes of a word that is summed together with others of its length, and positions of a block of a longer one.
SHORT, BLOCK = 64, 32_768


#: Rank r of the vocabulary has a probability in proportion to 1 / (r + RANK_SHIFT).
RANK_SHIFT = 10.0


def load_pieces(path: str) -> tuple[list[bytes], np.ndarray]:
    """Pieces of a byte-level vocabulary in rank order that a lower-cased word can hold (white space at most as one
    leading blank, no A-Z), and the natural logs of their probabilities, which sum to 1. All single bytes that can stand
    in a word are among them."""
    pieces, ranks = [], []
    with open(path, "rb") as f:
        for line in f:
            code, rank = line.split()
            piece = base64.b64decode(code)
            body = piece[1:] if piece[:1] == b" " else piece
            if piece == piece.lower() and not any(b in b" \t\n\v\f\r" for b in body) and (body or piece == b" "):
                pieces.append(piece)
                ranks.append(int(rank))
    p = 1.0 / (np.array(ranks) + RANK_SHIFT)
    return pieces, np.log(p / p.sum())


def _powers(n: int) -> np.ndarray:
    out = np.ones(n + 1, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(n):
            out[i + 1] = out[i] * _P
    return out


def _prefix_hashes(words: np.ndarray) -> np.ndarray:
    """(words, length) bytes to (words, length + 1) polynomial prefix hashes."""
    h = np.zeros((words.shape[0], words.shape[1] + 1), np.uint64)
    for i in range(words.shape[1]):
        h[:, i + 1] = h[:, i] * _P + words[:, i].astype(np.uint64) + np.uint64(1)
    return h


class Lattice:
    def __init__(self, pieces: list[bytes], logp: np.ndarray):
        self.longest, self.logp = max(map(len, pieces)), np.append(logp, -np.inf)
        by_length: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            by_length.setdefault(len(p), []).append(i)
        self.keys, self.ids = {}, {}
        for length, own in by_length.items():
            keys = _prefix_hashes(np.frombuffer(b"".join(pieces[i] for i in own), np.uint8).reshape(-1, length))[:, -1]
            order = np.argsort(keys)
            self.keys[length], self.ids[length] = keys[order], np.array(own)[order]

    def _edges(self, words: np.ndarray) -> list[tuple[int, int, np.ndarray]]:
        """(start, end, piece of each word or -1) for all ranges that are a piece in any of the words."""
        h, powers, out = _prefix_hashes(words), _powers(self.longest), []
        for end in range(1, words.shape[1] + 1):
            for length in range(1, min(end, self.longest) + 1):
                if (keys := self.keys.get(length)) is not None:
                    key = h[:, end] - h[:, end - length] * powers[length]
                    at = np.searchsorted(keys, key)
                    at[at == len(keys)] = 0
                    piece = np.where(keys[at] == key, self.ids[length][at], -1)
                    if (piece >= 0).any():
                        out.append((end - length, end, piece))
        return out

    @staticmethod
    def _sums(n: int, width: int, edges: list[tuple[int, int, np.ndarray]], logp: np.ndarray) -> np.ndarray:
        """Log sums over all paths to each position. ``logp`` ends with -inf for no piece."""
        total = np.full((n, width + 1), -np.inf)
        total[:, 0] = 0.0
        into: dict[int, list[tuple[int, np.ndarray]]] = {}
        for start, end, piece in edges:
            into.setdefault(end, []).append((start, piece))
        for at in range(1, width + 1):
            if near := into.get(at):
                terms = np.stack([total[:, start] + logp[piece] for start, piece in near])
                top = terms.max(0)
                base = np.where(np.isfinite(top), top, 0.0)
                with np.errstate(divide="ignore"):
                    total[:, at] = np.log(np.exp(terms - base).sum(0)) + base
        return total

    def _batches(self, words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Indexes of words of one length, and their bytes with a blank before."""
        sizes = np.array([len(w) for w in words])
        order = np.argsort(sizes, kind="stable")
        bounds = np.flatnonzero(np.diff(sizes[order])) + 1
        for own in np.split(order, bounds) if len(words) else []:
            width = int(sizes[own[0]]) + 1
            step = max(1, CELLS // (width * min(width, self.longest)))
            for i in range(0, len(own), step):
                part = own[i : i + step]
                yield part, np.frombuffer(b"".join(b" " + words[k] for k in part), np.uint8).reshape(len(part), width)

    def _long(self, word: bytes) -> float:
        """The same sum for one word of any length: the pieces that end in a block of positions are found together."""
        text, p, mask = b" " + word, int(_P), (1 << 64) - 1
        n = len(text)
        hashes = np.fromiter(accumulate(text, lambda h, b: (h * p + b + 1) & mask, initial=0), np.uint64, n + 1)
        powers, total = _powers(self.longest), array("d", bytes(8 * (n + 1)))
        for block in range(1, n + 1, BLOCK):
            ends, sizes, weights = [], [], []
            for length, keys in self.keys.items():
                end = np.arange(max(block, length), min(block + BLOCK, n + 1))
                key = hashes[end] - hashes[end - length] * powers[length]
                at = np.searchsorted(keys, key)
                at[at == len(keys)] = 0
                hit = keys[at] == key
                ends.append(end[hit])
                sizes.append(np.full(int(hit.sum()), length))
                weights.append(self.logp[self.ids[length][at[hit]]])
            end = np.concatenate(ends)
            order = np.argsort(end, kind="stable")
            counts = np.bincount(end - block, minlength=min(BLOCK, n + 1 - block)).tolist()
            arcs = zip((end - np.concatenate(sizes))[order].tolist(), np.concatenate(weights)[order].tolist(), strict=True)
            for at, count in enumerate(counts, block):
                terms = [total[start] + weight for start, weight in islice(arcs, count)]
                top = max(terms, default=-math.inf)
                total[at] = top if top == -math.inf else top + math.log(sum([math.exp(t - top) for t in terms]))
        return total[n]

    def log_probability(self, words: list[bytes], whole: np.ndarray | None = None, rest: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
        """Natural logs of each word's marginal probability, its leading blank included: over segmentations into pieces
        alone, and over these and one more arc that spans the word. ``whole`` weighs that arc (-inf for none), ``rest``
        every other path."""
        pieces = np.zeros(len(words))
        short = np.array([len(w) <= SHORT for w in words], bool)
        for i in np.flatnonzero(~short):
            pieces[i] = self._long(words[i])
        places = np.flatnonzero(short)
        for own, block in self._batches([words[i] for i in places]):
            pieces[places[own]] = self._sums(*block.shape, self._edges(block), self.logp)[:, -1]
        return pieces, pieces + rest if whole is None else np.logaddexp(whole, pieces + rest)


@functools.lru_cache(maxsize=2)
def lattice_of(path: str) -> Lattice:
    """One lattice per worker process and vocabulary."""
    return Lattice(*load_pieces(path))
