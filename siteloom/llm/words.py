"""Words of many texts at once, as numpy arrays inside a task: bounds, hashes, rolling windows.

Texts are laid end to end in one byte buffer with a separating line feed, which no word contains.
A word hash is a polynomial over random byte values modulo 2**64, mixed; a window hash is the same
polynomial over word hashes. Both are equal for equal words wherever they stand.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

_U = np.uint64
# odd, and 3 modulo 4, so that differences of powers keep few factors of two
_BYTE_BASE, _WORD_BASE = 0x9E3779B97F4A7C17 | 3, 0xC2B2AE3D27D4EB4F | 3
_BYTES = np.random.Generator(np.random.PCG64(20240229)).integers(0, 2**64, 256, dtype=_U)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _space() -> np.ndarray:
    sep = np.zeros(256, bool)
    sep[[0x20, *range(0x09, 0x0E)]] = True
    return sep


def _not_alphanumeric() -> np.ndarray:
    """ASCII letters (lower-cased before), digits and everything beyond ASCII belong to words."""
    sep = np.zeros(256, bool)
    sep[:0x80] = True
    sep[0x30:0x3A] = False
    sep[0x61:0x7B] = False
    return sep


SPACE, NOT_ALPHANUMERIC = _space(), _not_alphanumeric()
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of a 64-bit value over all bits."""
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> _U(33))
    x = x * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


def _power(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of ``base`` and of its inverse modulo 2**64, kept for the usual sizes only."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 18)
        up = np.full(size, base, _U)
        down = np.full(size, pow(base, -1, 2**64), _U)
        up[0] = down[0] = 1
        have = np.multiply.accumulate(up), np.multiply.accumulate(down)
        if size <= 1 << 21:
            _powers[base] = have
    return have


def _ranges(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    up, down = _power(base, len(values) + 1)
    total = np.zeros(len(values) + 1, _U)
    np.cumsum(values * up[: len(values)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(_U))


@dataclass
class Words:
    """Words of ``n_docs`` texts: byte bounds in ``data``, hash, and each text's range of words."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray  # n_docs + 1 word positions

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc_of(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, positions, side="right") - 1

    def left(self) -> np.ndarray:
        """For each word, how many words its text has from here on."""
        return np.repeat(self.first[1:], self.counts) - np.arange(len(self.hash))

    def windows(self, positions: np.ndarray, length) -> np.ndarray:
        """Hash of the ``length`` words from each position; the caller keeps them inside a text."""
        return _ranges(self.hash, positions, positions + length, _WORD_BASE)

    def text(self, a: int, b: int) -> bytes:
        """Words a..b joined by single blanks."""
        d = self.data
        return b" ".join(d[s:e].tobytes() for s, e in zip(self.start[a:b].tolist(), self.end[a:b].tolist()))


def words(texts: list[bytes | None], separators: np.ndarray = SPACE, lower: bool = False) -> Words:
    raw = b"\n".join([*(t or b"" for t in texts), b""])
    data = np.frombuffer(raw, np.uint8)
    seen = _LOWER[data] if lower else data
    inside = ~separators[seen]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(inside) and inside[0]:
        edge = np.concatenate([[0], edge])
    # the buffer ends with a separator, so edges come in pairs
    start, end = edge[0::2], edge[1::2]
    sizes = np.fromiter((len(t or b"") + 1 for t in texts), np.int64, len(texts))
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    first = np.searchsorted(start, bounds)
    return Words(data, start, end, _ranges(_BYTES[seen], start, end, _BYTE_BASE), first)


def slices(sizes: list[int], limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of about ``limit`` bytes; a longer text stands alone, whole."""
    a = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > limit:
            yield a, i
            a, total = i, 0
        total += n
    if a < len(sizes):
        yield a, len(sizes)


def minimisers(values: np.ndarray, left: np.ndarray, k: int, window: int) -> np.ndarray:
    """Positions holding the least value of some ``window`` consecutive k-grams of one text.

    Every text span of ``window + k - 1`` words contains at least one; equal spans agree on which,
    because ties go to the rightmost. ``values[p]`` belongs to the k words from p.
    """
    n = len(values)
    valid = left >= window + k - 1
    if not n or not valid.any():
        return np.zeros(0, np.int64)
    # order-preserving key with the position breaking ties, then a doubling sparse table of minima
    best = np.arange(n)
    span = 1
    while span < window:
        step = min(span, window - span)
        other = np.empty(n, np.int64)
        other[: n - step] = best[step:]
        other[n - step :] = best[n - step :]
        take = values[other] <= values[best]
        best = np.where(take, other, best)
        span += step
    return np.unique(best[valid])
