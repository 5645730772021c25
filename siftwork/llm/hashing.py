"""Vectorised 64-bit hashes of runs of bytes and of words, the same on every machine.

A word's hash takes eight bytes at a time and mixes after each. A run's hash is a polynomial over random values of its bytes, taken from prefix sums
modulo 2**64 and mixed at the end: it serves runs of up to a few hundred bytes, always together with a second hash, since long runs of
an automatic pattern (Thue-Morse words of a thousand letters) have equal polynomials.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np

_RNG = np.random.default_rng(20_24)
BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
STEP = np.uint64(0x9E3779B97F4A7C15)  # 5 modulo 8, so odd
BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
M1, M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
#: Bytes hashed at a time, where a single text isn't longer.
CHUNK = 1 << 20
#: Words longer than this many bytes are hashed one by one.
LONG_WORD = 256
_POWERS: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    known = _POWERS.get(int(base))
    if known is None or len(known) < n:
        known = np.full(max(n, 1 << 16), base)
        known[0] = 1
        with np.errstate(over="ignore"):
            known = np.cumprod(known, dtype=np.uint64)
        if n > 8 * CHUNK:
            return known  # not worth its memory
        _POWERS[int(base)] = known
    return known[:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h = h * M1
    h ^= h >> np.uint64(29)
    h = h * M2
    return h ^ (h >> np.uint64(32))


def words(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the words data[start:end], none of them empty."""
    size = end - start
    h = mix(size.astype(np.uint64) * STEP)
    wide = np.zeros(len(data), dtype=np.uint64)  # the eight bytes from each place on
    for k in range(min(8, len(data))):
        wide[: len(data) - k] |= data[k:].astype(np.uint64) << np.uint64(8 * k)
    live = np.nonzero(size <= LONG_WORD)[0]
    at = 0
    while len(live):
        left = size[live] - at
        part = wide[start[live] + at]
        short = left < 8
        part[short] &= (np.uint64(1) << (8 * left[short]).astype(np.uint64)) - np.uint64(1)
        h[live] = mix(h[live] * STEP ^ part)
        at += 8
        live = live[left > 8]
    for i in np.nonzero(size > LONG_WORD)[0].tolist():
        h[i] = int.from_bytes(hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
    return h


class Runs:
    """Hashes of any runs of one array of bytes."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(BYTE[data] * powers(STEP, n + 1)[:n], out=self.sums[1:])
        self.back = powers(BACK, n + 1)

    def hash(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return (self.sums[hi] - self.sums[lo]) * self.back[lo]

    def every(self, k: int) -> np.ndarray:
        """Mixed hashes of all runs of k bytes."""
        return mix((self.sums[k:] - self.sums[:-k]) * self.back[: len(self.sums) - k])


def chunks(texts: list[bytes], size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `size` bytes together."""
    lo, n = 0, 0
    for i, t in enumerate(texts):
        if n and n + len(t) > size:
            yield lo, i
            lo, n = i, 0
        n += len(t) + 1
    if lo < len(texts):
        yield lo, len(texts)


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
