"""Words of many texts as 64-bit hashes, in numpy.

A word is a run of letters, digits and bytes beyond ASCII; ASCII letters count in lower case. Hashes
depend on the word alone, so they agree between tasks and runs.
"""

from __future__ import annotations

import numpy as np

FACTOR = 0x9E3779B97F4A7C15
INVERSE = pow(FACTOR, -1, 1 << 64)

_codes = np.zeros(256, np.uint8)
for _b in range(256):
    if _b >= 128 or chr(_b).isalnum():
        _codes[_b] = ord(chr(_b).lower()) if _b < 128 else _b
#: Lower-case byte of each byte; 0 between words.
CODES = _codes


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers; one-to-one."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class Powers:
    """Powers of a factor and of its inverse modulo 2^64, grown as needed."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(1 << 20, n)
            steps = np.full(size, FACTOR, np.uint64)
            steps[0] = 1
            self.up = np.cumprod(steps, dtype=np.uint64)
            steps[1:] = INVERSE
            self.down = np.cumprod(steps, dtype=np.uint64)
        return self.up[:n], self.down[:n]


def word_hashes(data: np.ndarray, places: np.ndarray, powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word in order, and how many words lie before each text (one more entry: all)."""
    codes = CODES[data]
    inside = codes != 0
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    edges = places[:-1]
    edges = edges[edges < len(data)]
    starts[edges] = inside[edges]
    spots = np.flatnonzero(starts)
    before = np.searchsorted(spots, places)
    if not len(spots):
        return np.zeros(0, np.uint64), before
    up, down = powers.upto(len(data))
    sums = np.add.reduceat(codes * up, spots)
    return mix(sums * down[spots]), before


def windows(hashes: np.ndarray, before: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words inside a text, and the text's number for each."""
    counts = np.diff(before)
    owner = np.repeat(np.arange(len(counts)), counts)
    if len(hashes) < size:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    n = len(hashes) - size + 1
    run = np.zeros(n, np.uint64)
    for i in range(size):
        run = run * np.uint64(FACTOR) + hashes[i : i + n]
    same = owner[:n] == owner[size - 1 :]
    return mix(run[same]), owner[:n][same]
