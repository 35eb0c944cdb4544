"""Static three-wise binary fuse filters over 64-bit keys, built by numpy.

A filter holds one byte per slot and about 1.13 to 1.3 slots per key; a key of
the set always answers yes, any other key does so in one case of 256.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

from .arrays import U, mix


@dataclass
class Filter:
    seed: int
    segment: int          #: slots per segment, a power of two
    segments: int         #: segments that a key's first slot can lie in
    slots: np.ndarray     #: uint8

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = mix(keys + U(self.seed))
        span = U(self.segments * self.segment)
        first = ((h >> U(32)) * span) >> U(32)
        mask = U(self.segment - 1)
        second = (first + U(self.segment)) ^ ((h >> U(18)) & mask)
        third = (first + U(2 * self.segment)) ^ (h & mask)
        mark = ((h ^ (h >> U(32))) & U(0xFF)).astype(np.uint8)
        return np.stack([first, second, third], axis=1).astype(np.int64), mark

    def contains(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.slots):
            return np.zeros(len(keys), bool)
        where, mark = self._places(keys)
        return (self.slots[where[:, 0]] ^ self.slots[where[:, 1]] ^ self.slots[where[:, 2]]) == mark


def build(keys: np.ndarray) -> Filter:
    """The filter of a set of keys (repeats are dropped)."""
    keys = np.unique(keys)
    n = len(keys)
    if n == 0:
        return Filter(0, 1, 1, np.zeros(0, np.uint8))
    segment = 1 << max(2, min(18, math.floor(math.log(n + 1) / math.log(3.33) + 2.25)))
    factor = max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(max(n, 2)))
    segments = max(1, math.ceil(n * factor / segment) - 2)
    for attempt in range(1, 200):
        size = (segments + 2) * segment
        out = Filter(attempt * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF, segment, segments,
                     np.zeros(size, np.uint8))
        where, mark = out._places(keys)
        order = _peel(where, size)
        if order is not None:
            for key, slot in reversed(order):
                w = where[key]
                out.slots[slot] = mark[key] ^ out.slots[w[:, 0]] ^ out.slots[w[:, 1]] ^ out.slots[w[:, 2]]
            return out
        if attempt % 10 == 0:  # a small set can need more room
            segments += 1
    raise RuntimeError("no seed peels this set")


def _peel(where: np.ndarray, size: int) -> list[tuple[np.ndarray, np.ndarray]] | None:
    """Rounds of (keys, the slot that each holds alone); None if keys stay."""
    n = len(where)
    count = np.bincount(where.ravel(), minlength=size)
    holder = np.zeros(size, np.int64)  # the sum of key numbers: the key itself where the count is 1
    np.add.at(holder, where.ravel(), np.repeat(np.arange(n), 3))
    front, rounds, left = np.flatnonzero(count == 1), [], n
    while len(front):
        key, first = np.unique(holder[front], return_index=True)
        rounds.append((key, front[first]))
        left -= len(key)
        touched = where[key].ravel()
        np.subtract.at(count, touched, 1)
        np.subtract.at(holder, touched, np.repeat(key, 3))
        touched = np.unique(touched)
        front = touched[count[touched] == 1]
    return rounds if left == 0 else None
