"""Hashed features of words, and tables of the words that a worker has met."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def hashed(words: list[str], bits: int, grams: Iterable[int] = (2, 3), affixes: Iterable[int] = ()) -> tuple[np.ndarray, np.ndarray]:
    """Features of each word, as places below 2 ** bits, and how many each word has.

    A word's features are its n-grams with marks at both ends, and its beginnings and ends of given lengths;
    words of any length are read whole. A word has at least one feature.
    """
    if not words:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    joined = "".join(f"\x02{w}\x03" for w in words)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 2
    ends = np.cumsum(size)
    starts = ends - size
    of = np.repeat(np.arange(len(words)), size)
    left = ends[of] - np.arange(len(codes))  # symbols from here to the word's end
    found, owner = [], []

    def add(h: np.ndarray, whose: np.ndarray, kind: int) -> None:
        h = (h ^ np.uint64(kind)) * _A
        h ^= h >> np.uint64(29)
        h *= _B
        found.append((h >> np.uint64(64 - bits)).astype(np.int64))
        owner.append(whose)

    for n in grams:
        at = np.nonzero(left >= n)[0]
        h = codes[at].copy()
        for j in range(1, n):
            h = h * _B + codes[at + j]
        add(h, of[at], n)
    for n in affixes:
        whose = np.nonzero(size >= n + 2)[0]
        for kind, first in ((100 + n, starts[whose] + 1), (200 + n, ends[whose] - 1 - n)):
            h = codes[first].copy()
            for j in range(1, n):
                h = h * _B + codes[first + j]
            add(h, whose, kind)
    places, whose = np.concatenate(found), np.concatenate(owner)
    order = np.argsort(whose, kind="stable")
    return places[order], np.bincount(whose, minlength=len(words))


def mean_rows(weights: np.ndarray, places: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each word, the mean of its features' rows of weights."""
    if not len(counts):
        return np.empty((0, *weights.shape[1:]), dtype=weights.dtype)
    firsts = np.cumsum(counts) - counts
    total = np.add.reduceat(weights[places], firsts, axis=0)
    return total / counts.reshape(-1, *[1] * (weights.ndim - 1))


class Words:
    """Rows of numbers for words, computed once for each; forgotten all at once when there are too many."""

    def __init__(self, width: int, compute: Callable[[list[str]], np.ndarray], most: int = 300_000):
        self.width, self.compute, self.most = width, compute, most
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.rows = np.empty((0, self.width), dtype=np.float32)

    def find(self, tokens: list[list[str]]) -> np.ndarray:
        """Places in rows of all tokens, one list after the other."""
        every = set().union(*tokens) if tokens else set()
        if len(self.place) > self.most:
            self.clear()
        new = sorted(every.difference(self.place))
        if new:
            self.place.update(zip(new, range(len(self.rows), len(self.rows) + len(new)), strict=True))
            self.rows = np.concatenate([self.rows, self.compute(new).astype(np.float32).reshape(len(new), self.width)])
        get = self.place.__getitem__
        return np.fromiter((get(t) for own in tokens for t in own), dtype=np.int64, count=sum(map(len, tokens)))
