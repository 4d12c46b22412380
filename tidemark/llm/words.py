"""Whole-batch word splitting and hashing on the UTF-8 bytes of an Arrow column."""

from __future__ import annotations

import numpy as np

_rng = np.random.Generator(np.random.PCG64(20240229))
_WEIGHT = _rng.integers(1, 2**63, 4096, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FAR = _rng.integers(1, 2**63, 4096, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FAR[0] = 1  # so that the first 4096 bytes weigh the same whether or not a batch has longer words
_GRAM = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_CHECK = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Every ASCII byte but letters and digits parts words.
_MARKS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """Words `[^\\x20\\x09-\\x0D]+` of consecutive texts: starts, ends (bytes) and per-text word offsets.

    With marks_part, ASCII punctuation and control characters part words too.
    """

    def __init__(self, raw: np.ndarray, offs: np.ndarray, marks_part: bool = False):
        self.raw, self.offs = raw, offs
        solid = ~(_MARKS if marks_part else _SPACE)[raw]
        before = np.zeros(len(raw), bool)
        before[1:] = solid[:-1]
        inside = offs[:-1][offs[:-1] < offs[1:]]
        before[inside] = False
        self.starts = np.flatnonzero(solid & ~before)
        after = np.zeros(len(raw), bool)
        after[:-1] = solid[1:]
        after[inside[inside > 0] - 1] = False
        self.ends = np.flatnonzero(solid & ~after) + 1
        self.word_offs = np.searchsorted(self.starts, offs)
        self.solid = solid

    def __len__(self) -> int:
        return len(self.starts)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.word_offs)

    def hashes(self, lower: bool) -> np.ndarray:
        """64-bit multilinear hash of each word, ASCII letters lower-cased first if asked."""
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        lens = self.ends - self.starts
        at = np.zeros(len(lens) + 1, np.int64)
        np.cumsum(lens, out=at[1:])
        letters = self.raw[self.solid]
        if lower:
            letters = _LOWER[letters]
        place = np.arange(at[-1]) - np.repeat(at[:-1], lens)
        weight = _WEIGHT[place & 4095]
        if place.max() > 4095:
            weight = weight * _FAR[(place >> 12) & 4095] + (place >> 24).astype(np.uint64)
        total = np.add.reduceat(weight * (letters.astype(np.uint64) + np.uint64(1)), at[:-1])
        return mix(total + lens.astype(np.uint64))

    def texts(self) -> np.ndarray:
        """Index of the text that each word belongs to."""
        return np.repeat(np.arange(len(self.offs) - 1), self.counts)


def grams(words: np.ndarray, k: int, check: bool = False) -> np.ndarray:
    """Hash of each k consecutive words (by position; the caller masks starts that cross texts)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    weight = _CHECK if check else _GRAM
    total = words[:n] * weight[0]
    for j in range(1, k):
        total += words[j : j + n] * weight[j]
    return mix(total)


def gram_starts(word_offs: np.ndarray, k: int) -> np.ndarray:
    """Word positions at which k consecutive words of one text start."""
    n = np.maximum(np.diff(word_offs) - k + 1, 0)
    out = np.zeros(len(n) + 1, np.int64)
    np.cumsum(n, out=out[1:])
    return np.repeat(word_offs[:-1] - out[:-1], n) + np.arange(out[-1])
