"""Distances of byte strings: q-gram cosine, MinHash, edit operations."""

from __future__ import annotations

from collections import Counter
from functools import lru_cache
from math import sqrt

import numpy as np

from strandlog.functions import deltas

PRIME, HASHES, MINHASH_SEED = 1_099_511_628_211, 50, 12345
NAMES = ("cosine", "minhash", "qgram")


def mt19937_64(seed: int, n: int) -> list[int]:
    """The first n numbers of the 64-bit Mersenne Twister."""
    full, size, half = (1 << 64) - 1, 312, 156
    s = [seed & full]
    for i in range(1, size):
        s.append((6364136223846793005 * (s[-1] ^ (s[-1] >> 62)) + i) & full)
    out: list[int] = []
    upper, lower = full ^ 0x7FFFFFFF, 0x7FFFFFFF
    while len(out) < n:
        for i in range(size):
            x = (s[i] & upper) | (s[(i + 1) % size] & lower)
            s[i] = s[(i + half) % size] ^ (x >> 1) ^ (0xB5026F5AA96619E9 if x & 1 else 0)
        for x in s:
            x ^= (x >> 29) & 0x5555555555555555
            x ^= (x << 17) & 0x71D67FFFEDA60000 & full
            x ^= (x << 37) & 0xFFF7EEE000000000 & full
            out.append(x ^ (x >> 43))
    return out[:n]


@lru_cache
def minhash_params() -> tuple[list[int], list[int]]:
    """Factors and offsets of the hash functions, drawn in turn."""
    draws = mt19937_64(MINHASH_SEED, 2 * HASHES)
    return draws[0::2], draws[1::2]


@lru_cache
def _arrays() -> tuple[np.ndarray, np.ndarray]:
    a, b = minhash_params()
    return np.array(a, np.uint64)[:, None], np.array(b, np.uint64)[:, None]


def minhash(line: bytes) -> np.ndarray:
    """50 minima over the line's 3-grams, -1 each if it has none."""
    if len(line) < 3:
        return np.full(HASHES, -1, np.int64)
    a, b = _arrays()
    c = np.frombuffer(line, np.uint8).astype(np.uint64)
    h = ((np.uint64(5381 * 33) + c[:-2]) * np.uint64(33) + c[1:-1]) * np.uint64(33) + c[2:]
    h = np.unique(h)
    return ((a * h + b) % np.uint64(PRIME)).min(axis=1).astype(np.int64)


def _windows(lines: list[bytes], q: int) -> tuple[np.ndarray, np.ndarray]:
    """(number of the line, q-gram packed into 64 bits) of all q-grams of all lines, in order; q is 8 at most."""
    size = np.fromiter(map(len, lines), np.int64, len(lines))
    data = np.frombuffer(b"".join(lines), np.uint8)
    n = max(0, len(data) - q + 1)
    code = np.zeros(n, np.uint64)
    for j in range(q):
        code = code << np.uint64(8) | data[j : j + n]
    row = np.repeat(np.arange(len(lines)), size)[:n]
    inside = np.arange(n) + q <= np.cumsum(size)[row] if n else np.zeros(0, bool)
    return row[inside], code[inside]


def _minhash_some(lines: list[bytes]) -> np.ndarray:
    out = np.full((len(lines), HASHES), -1, np.int64)
    row, code = _windows(lines, 3)
    if len(row):
        a, b = _arrays()
        known, at = np.unique(code, return_inverse=True)
        c = [known >> np.uint64(k) & np.uint64(255) for k in (16, 8, 0)]
        h = ((np.uint64(5381 * 33) + c[0]) * np.uint64(33) + c[1]) * np.uint64(33) + c[2]
        table = np.ascontiguousarray(((a * h + b) % np.uint64(PRIME)).T.astype(np.int64))
        begin = np.flatnonzero(np.diff(row, prepend=-1))
        out[row[begin]] = np.minimum.reduceat(table[at], begin, axis=0)
    return out


def minhash_many(lines: list[bytes], most: int = 1 << 16) -> np.ndarray:
    """(lines, 50): `minhash` of each; every distinct 3-gram of about so many bytes of lines is hashed once."""
    out, first, size = [np.empty((0, HASHES), np.int64)], 0, 0
    for i, line in enumerate([*lines, None]):
        if i > first and (line is None or size + len(line) > most):
            out.append(_minhash_some(lines[first:i]) if size <= most else minhash(lines[first])[None])
            first, size = i, 0
        size += len(line or b"")
    return np.concatenate(out)


def gram_matrix(lines: list[bytes], q: int, most: int = 1 << 22) -> np.ndarray | None:
    """(lines, distinct q-grams): how often each line has each; None if that were more numbers than `most`."""
    row, code = _windows(lines, q)
    known, at = np.unique(code, return_inverse=True)
    if len(lines) * len(known) > most:
        return None
    return np.bincount(row * len(known) + at, minlength=len(lines) * len(known)).reshape(len(lines), len(known)).astype(np.float64)


def grams(line: bytes, q: int) -> Counter:
    return Counter(line[i : i + q] for i in range(len(line) - q + 1))


def cosine(a: Counter, na: int, b: Counter, nb: int) -> float:
    """1 - cosine of two gram counts with squared norms na and nb."""
    if not na or not nb:
        return 1.0
    if len(a) > len(b):
        a, b = b, a
    dot = sum(n * b[g] for g, n in a.items() if g in b)
    return 1.0 - dot / (sqrt(na) * sqrt(nb))


class Measure:
    """A distance with what it needs of each line computed once."""

    def __init__(self, name: str, q: int = 3):
        if name not in NAMES:
            raise ValueError(f"distance {name!r} is not one of {', '.join(NAMES)}")
        if q < 1:
            raise ValueError("q is at least 1")
        self.name, self.q = name, q

    def prepare(self, line: bytes):
        if self.name == "cosine":
            g = grams(line, self.q)
            return g, sum(n * n for n in g.values())
        return minhash(line) if self.name == "minhash" else None

    def between(self, line: bytes, mine, other: bytes, its) -> float:
        if self.name == "cosine":
            return cosine(its[0], its[1], mine[0], mine[1])
        if self.name == "minhash":
            if line == other:
                return 0.0
            if min(len(line), len(other)) < max(1, self.q):
                return 1.0
            return 1.0 - int((mine == its).sum()) / HASHES
        if not line and not other:
            return 0.0
        return min(1.0, deltas.approximate(other, line, self.q)[1] / max(len(line), len(other)))
