"""Texts of an Arrow batch as flat byte arrays: words and shingles by numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: odd multiplier of the polynomial word hash, and its inverse modulo 2**64
_P = 0x9E3779B97F4A7C15
_P_INV = pow(_P, -1, 1 << 64)
#: bytes handled at once; a longer text is a piece of its own
PIECE = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (splitmix finaliser)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (one more than texts) and bytes; a null is an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary())
    if texts.null_count:
        texts = texts.fill_null(b"")
    n = len(texts)
    if n == 0:
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    _, where, data = texts.buffers()
    offsets = np.frombuffer(where, np.int64)[texts.offset: texts.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return offsets - offsets[0], raw[offsets[0]: offsets[-1]]


def pieces(offsets: np.ndarray, size: int = PIECE) -> Iterator[tuple[int, int]]:
    """Runs of texts [a, b) that hold about ``size`` bytes."""
    n, a = len(offsets) - 1, 0
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + size, side="right")) - 1
        b = min(n, max(a + 1, b))
        yield a, b
        a = b


_WHITE = np.zeros(256, bool)
_WHITE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Powers:
    """Powers of the multiplier and of its inverse, grown as needed."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, U)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            a, b = np.full(size, _P, U), np.full(size, _P_INV, U)
            a[0] = b[0] = 1
            self.up, self.down = np.cumprod(a), np.cumprod(b)
        return self.up, self.down


class Words:
    """Words of a piece: start, end (bytes), hash, and the bounds of each text's words."""

    def __init__(self, offsets: np.ndarray, data: np.ndarray, powers: Powers, lower: bool = True):
        if lower:
            data = _LOWER[data]
        self.data, self.n_texts = data, len(offsets) - 1
        n = len(data)
        inside = ~_WHITE[data]
        cut = np.zeros(n + 1, bool)
        cut[offsets] = True
        before = np.zeros(n, bool)
        before[1:] = inside[:-1]
        after = np.zeros(n, bool)
        after[:-1] = inside[1:]
        self.start = np.flatnonzero(inside & (~before | cut[:n]))
        self.end = np.flatnonzero(inside & (~after | cut[1:])) + 1
        up, down = powers.get(n + 1)
        total = np.zeros(n + 1, U)
        np.cumsum((data.astype(U) + U(1)) * up[:n], out=total[1:])
        self.hash = mix((total[self.end] - total[self.start]) * down[self.start]
                        + (self.end - self.start).astype(U))
        self.bounds = np.searchsorted(self.start, offsets)


def shingles(words: Words, size: int) -> list[np.ndarray]:
    """The distinct ``size``-word shingles of each text as sorted 64-bit hashes;
    a text of fewer words is one shingle, one without words has none."""
    h, n = words.hash, len(words.hash)
    width = max(0, n - size + 1)
    rolled = np.zeros(width, U)
    for i in range(size):
        rolled = rolled * U(0xD6E8FEB86659FD93) + h[i: i + width]
    rolled = mix(rolled)
    out = []
    for a, b in zip(words.bounds[:-1].tolist(), words.bounds[1:].tolist()):
        if b - a >= size:
            out.append(np.unique(rolled[a: b - size + 1]))
        elif b > a:
            whole = U(b - a)
            for x in h[a:b]:
                whole = _fold(whole, x)
            out.append(np.array([whole], U))
        else:
            out.append(np.zeros(0, U))
    return out


def _fold(total: np.uint64, x: np.uint64) -> np.uint64:
    return U((int(total) * 0xA24BAED4963EE407 + int(x)) & 0xFFFFFFFFFFFFFFFF)
