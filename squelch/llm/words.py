"""Words of a batch of texts and their fingerprints, as numpy arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from squelch.llm.shared import forgettable

SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True

_rng = np.random.default_rng(20240607)
#: A random value for each byte, and odd multipliers for bytes and for words.
BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64)
FOR_BYTE, FOR_WORD = (np.uint64(x | 1) for x in _rng.integers(2**60, 2**63, 2))


def mixed(x: np.ndarray) -> np.ndarray:
    """The finalizer of SplitMix64: spreads each bit over all."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_tables: dict[tuple[int, bool], np.ndarray] = {}
forgettable(_tables.clear)


def powers(base: np.uint64, n: int, inverse: bool = False) -> np.ndarray:
    """base ** i mod 2 ** 64 for i < n (of the inverse of base, if asked)."""
    key = (int(base), inverse)
    have = _tables.get(key)
    if have is None or len(have) < n:
        step = np.uint64(pow(int(base), -1, 1 << 64)) if inverse else base
        have = np.full(max(n, 1 << 16), step, np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        _tables[key] = have
    return have[:n]


@dataclass
class Words:
    """Words of a batch: byte spans, and the first word of each text (n + 1)."""

    raw: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def n(self) -> int:
        return len(self.start)

    def text_of(self) -> np.ndarray:
        """For each word, the index of its text."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def words_of(raw: np.ndarray, offsets: np.ndarray) -> Words:
    inside = ~SPACES[raw]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    edges = offsets[(offsets > 0) & (offsets < len(raw))]
    begins[edges] = inside[edges]
    ends[edges - 1] = inside[edges - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return Words(raw, start, end, np.searchsorted(start, offsets))


def fingerprints(w: Words) -> np.ndarray:
    """64 bits for each word, the same for equal words anywhere."""
    n = len(w.raw)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(BYTE[w.raw] * powers(FOR_BYTE, n), out=sums[1:])
    return mixed((sums[w.end] - sums[w.start]) * powers(FOR_BYTE, n, True)[w.start])


def windows(prints: np.ndarray, k: int) -> np.ndarray:
    """64 bits for each run of k consecutive fingerprints (at its first one)."""
    n = len(prints)
    if n < k:
        return np.zeros(0, np.uint64)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(prints * powers(FOR_WORD, n), out=sums[1:])
    return mixed((sums[k:] - sums[:-k]) * powers(FOR_WORD, n - k + 1, True))


def whole(first: np.ndarray, n: int, k: int) -> np.ndarray:
    """Whether the k words from each word on (n of them) lie in one text; of length n - k + 1."""
    if n < k:
        return np.zeros(0, bool)
    last = np.repeat(first[1:], np.diff(first))
    return np.arange(n - k + 1) + k <= last[: n - k + 1]
