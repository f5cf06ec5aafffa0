"""Sets of word shingles as sorted 64-bit hashes, by array operations over a text's bytes."""

from __future__ import annotations

import numpy as np

WORDS_PER_SHINGLE = 5

_RANDOM = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _RANDOM.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _RANDOM.integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
#: A-Z lowered, blanks (0x20, 0x09 to 0x0D) as blanks.
_LOWER = bytes(b + 32 if 65 <= b <= 90 else 32 if 9 <= b <= 13 else b for b in range(256))
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base ** 0..n-1 modulo 2 ** 64; kept for texts of up to 256 kB."""
    known = _powers.get(base)
    if known is None or len(known) < n:
        size = max(1 << 12, 1 << (n - 1).bit_length())
        out = np.ones(size, np.uint64)
        filled = 1
        while filled < size:
            out[filled : 2 * filled] = out[:filled] * np.uint64(pow(base, filled, 1 << 64))
            filled *= 2
        if size <= 1 << 18:
            _powers[base] = out
        known = out
    return known[:n]


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash of each word of the lowered text, words being runs without blanks."""
    raw = np.frombuffer(text.encode().translate(_LOWER), np.uint8)
    blank = np.concatenate(([True], raw == 32, [True]))
    edge = np.flatnonzero(blank[1:] != blank[:-1])
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[raw] * _power(_BASE, len(raw)), dtype=np.uint64)))
        return _mix((sums[end] - sums[start]) * _power(_INVERSE, len(raw))[start] + (end - start).astype(np.uint64))


def shingle_set(text: str, k: int = WORDS_PER_SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of k words in a row; of all words where there are fewer; none without words."""
    words = word_hashes(text)
    if not len(words):
        return np.zeros(0, np.int64)
    size = min(k, len(words))
    with np.errstate(over="ignore"):
        total = np.full(len(words) - size + 1, size, np.uint64)
        for i in range(size):
            total += words[i : len(words) - size + i + 1] * _PLACE[i]
        return np.unique(_mix(total).view(np.int64))
