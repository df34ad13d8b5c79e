"""Vectorised text primitives on numpy arrays: words, shingles and window hashes of many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from .memory import keeps

U = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1  # odd, so it has an inverse modulo 2^64
_POWERS = [np.ones(1, U), np.ones(1, U)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose outputs look independent."""
    x = (x ^ (x >> U(31))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(29))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(32))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse, from 0 to n - 1 at least."""
    if len(_POWERS[0]) < n:
        size = -(-n // (1 << 16)) << 16
        for i, base in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            p = np.full(size, U(base))
            p[0] = 1
            _POWERS[i] = np.multiply.accumulate(p)
    return _POWERS[0][:n], _POWERS[1][:n]


def _forget() -> None:
    _POWERS[:] = [np.ones(1, U), np.ones(1, U)]


keeps(_forget)


def prefix(buf: np.ndarray) -> np.ndarray:
    """Running sums from which spans() and windows() get the hash of any stretch."""
    c = np.zeros(len(buf) + 1, U)
    np.cumsum((buf.astype(U) + U(1)) * powers(len(buf))[0], out=c[1:])
    return c


def spans(c: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of buf[start:end]; equal bytes have equal hashes wherever they stand."""
    return mix((c[end] - c[start]) * powers(len(c))[1][start])


def windows(c: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k bytes in a row."""
    return mix((c[k:] - c[:-k]) * powers(len(c))[1][: len(c) - k])


def words(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches without ASCII white space."""
    solid = np.zeros(len(buf) + 2, np.int8)
    solid[1:-1] = ~((buf == 32) | ((buf >= 9) & (buf <= 13)))
    step = np.diff(solid)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def grouped(texts: list[bytes], limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most limit bytes together, or of one text."""
    a = size = 0
    for i, t in enumerate(texts):
        if i > a and size + len(t) > limit:
            yield a, i
            a, size = i, 0
        size += len(t)
    if a < len(texts):
        yield a, len(texts)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each word of all texts in order, and where each text's words begin (one more at the end)."""
    buf = np.frombuffer(b"\n".join(texts), np.uint8)
    start, end = words(buf)
    at = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return spans(prefix(buf), start, end), np.searchsorted(start, at)


def shingles(texts: list[bytes], k: int) -> list[np.ndarray]:
    """Sorted distinct hashes of k words in a row, for each text. A text of 1 to k - 1 words has one, of all its words."""
    h, at = word_hashes(texts)
    n = max(0, len(h) - k + 1)
    s = np.zeros(n, U)
    for j in range(k):
        s += h[j : j + n] * U(pow(BASE, 2 * j + 3, 1 << 64))
    s, out = mix(s), []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= k:
            x = np.sort(s[a : b - k + 1])
            out.append(x[np.append(True, x[1:] != x[:-1])])
        elif b > a:
            w = np.array([b - a], U)
            for i in range(a, b):
                w = mix(w * U(BASE) + h[i : i + 1])
            out.append(w)
        else:
            out.append(np.zeros(0, U))
    return out
