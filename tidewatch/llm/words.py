"""Words of many texts at once, as positions and 64-bit hashes in numpy."""

from __future__ import annotations

import numpy as np

MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * MIX[0]
    x = (x ^ (x >> np.uint64(27))) * MIX[1]
    return x ^ (x >> np.uint64(31))


BYTES = mixed(np.arange(1, 257, dtype=np.uint64) * BASE)
NOT_SPACE = np.array([b != 32 and not 9 <= b <= 13 for b in range(256)])


def word_spans(raw: np.ndarray, borders: np.ndarray, in_word: np.ndarray = NOT_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, text number) of every run of bytes that ``in_word`` marks; no word crosses texts."""
    inside = in_word[raw]
    start, end = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    first, last = borders[:-1][borders[:-1] < len(raw)], borders[1:][borders[1:] > 0] - 1
    start[first], end[last] = inside[first], inside[last]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(borders, starts, side="right") - 1


class SpanHash:
    """Hashes of any byte spans: differences of running sums, moved to a common place."""

    def __init__(self, raw: np.ndarray):
        powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(raw), BASE)]))
        self.back = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(raw), INVERSE)]))
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum(BYTES[raw] * powers[:-1])])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed((self.sums[ends] - self.sums[starts]) * self.back[starts])


def word_hashes(raw: np.ndarray, borders: np.ndarray, in_word: np.ndarray = NOT_SPACE) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text number) of every word."""
    starts, ends, owner = word_spans(raw, borders, in_word)
    return SpanHash(raw)(starts, ends), owner
