"""Hashed word shingles of texts, as array arithmetic on the bytes of one text.

A word's hash is a polynomial in a random table value per byte, taken from prefix
sums over blocks of fixed size, so memory besides the word hashes does not depend on the
length of a text or of a word. Shingle hashes have 64 bits: two given different
sets of n shingles are mistaken for each other, or overlap wrongly, with a chance of
about n * n / 2**64.
"""

from __future__ import annotations

import hashlib

import numpy as np

WORDS = 5
BLOCK = 1 << 16
_rng = np.random.default_rng(20240229)  # fixed value: the seed of the byte table
_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32
_TABLE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)[_lower]
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_BASE = 0x9E3779B97F4A7C15  # an odd number, so it has an inverse
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int) -> np.ndarray:
    out = np.full(BLOCK, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_UP, _DOWN = _powers(_BASE), _powers(_INVERSE)
_PLACES = np.array([pow(0xD6E8FEB86659FD93, k + 1, 1 << 64) for k in range(WORDS)], np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    """Every bit of the result depends on every bit of ``h``."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(text: bytes) -> np.ndarray:
    """Hash of every word, A-Z taken as a-z."""
    data = np.frombuffer(text, np.uint8)
    starts, ends = [], []
    carry, up, down = 0, 1, 1
    inside = False
    for at in range(0, len(data), BLOCK):
        block = data[at : at + BLOCK]
        n = len(block)
        word = ~_SPACE[block]
        edge = np.flatnonzero(np.diff(word, prepend=inside))
        sums = np.empty(n + 1, np.uint64)
        sums[0] = carry
        with np.errstate(over="ignore"):
            np.cumsum(_TABLE[block] * _UP[:n] * np.uint64(up), out=sums[1:])
            sums[1:] += np.uint64(carry)
            opens = word[edge]
            begin = edge[opens]
            starts.append(np.stack([sums[begin], _DOWN[begin] * np.uint64(down)]))
            ends.append(sums[edge[~opens]])
        inside, carry = bool(word[-1]), int(sums[-1])
        up, down = up * pow(_BASE, n, 1 << 64) % (1 << 64), down * pow(_INVERSE, n, 1 << 64) % (1 << 64)
    if not starts:
        return np.empty(0, np.uint64)
    begin = np.concatenate(starts, axis=1)
    end = np.concatenate([*ends, np.array([carry] * inside, np.uint64)])
    with np.errstate(over="ignore"):
        return mixed((end - begin[0]) * begin[1])


def shingle_set(text: bytes) -> np.ndarray:
    """Sorted distinct hashes of the 5-word shingles; of a shorter text, of all its words."""
    h = word_hashes(text)
    if not len(h):
        return h
    width = min(WORDS, len(h))
    with np.errstate(over="ignore"):
        total = h[: len(h) - width + 1] * _PLACES[0] + np.uint64(width)
        for k in range(1, width):
            total += h[k : len(h) - width + 1 + k] * _PLACES[k]
        return np.unique(mixed(total))


def set_key(shingles: np.ndarray) -> int:
    """Signed 64-bit hash of a whole set."""
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)
