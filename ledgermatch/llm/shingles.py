"""Word and shingle hashes of many texts at once, in numpy."""

from __future__ import annotations

import numpy as np

_RNG = np.random.default_rng(20)
_BYTE = _RNG.integers(0, 2**64, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: ASCII white space: tab to carriage return, and the space.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _powers(n: int, base: np.uint64) -> np.ndarray:
    out = np.full(max(1, n), base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def word_hashes(texts: list[str | None], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in order, and for each text the number of words before it (one more entry than texts).

    Words lie between ASCII white space; null texts have none. ``lower`` folds A to Z.
    """
    blobs = [(t or "").encode() for t in texts]
    raw = np.frombuffer(b"\n".join(blobs) + b"\n", np.uint8)
    if lower:
        raw = _LOWER[raw]
    solid = ~SPACE[raw]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    starts_raw = np.flatnonzero(first)
    bounds = np.concatenate([[0], np.cumsum([len(b) + 1 for b in blobs])])
    offsets = np.searchsorted(starts_raw, bounds)
    if not len(starts_raw):
        return np.zeros(0, np.uint64), offsets
    packed = raw[solid]
    starts = np.cumsum(solid)[starts_raw] - 1
    lengths = np.diff(np.append(starts, len(packed)))
    place = np.arange(len(packed)) - np.repeat(starts, lengths)
    values = _BYTE[packed] * _powers(int(lengths.max()), _BASE)[place]
    return mix(np.add.reduceat(values, starts)), offsets


def shingle_hashes(words: np.ndarray, size: int = 5) -> np.ndarray:
    """Hashes of all runs of ``size`` words; of the whole text if it has fewer words; none for no words."""
    n = len(words)
    if n == 0:
        return words
    k = min(size, n)
    weights = _powers(k, _STEP)
    out = np.zeros(n - k + 1, np.uint64)
    for j in range(k):
        out += words[j : n - k + 1 + j] * weights[j]
    return mix(out + np.uint64(k))
