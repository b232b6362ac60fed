"""Bloom filters in segments by hash range, built by the tasks that own the ranges.

A filter also tells levels apart: an item of level q is inserted with each of
1..q, and its level is found by probing 1, 2, ... until a probe fails. No item
reads as less than its level; false positives can only raise it.
"""

from __future__ import annotations

import numpy as np

#: Bits set and probed for an item and level.
PROBES = 4
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of uint64 that spreads every bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * _B
        x = (x ^ (x >> np.uint64(29))) * _A
        return x ^ (x >> np.uint64(32))


def segment_of(h: np.ndarray, segments: int) -> np.ndarray:
    """The segment (hash range) of each uint64."""
    return ((h >> np.uint64(32)) * np.uint64(segments) >> np.uint64(32)).astype(np.int64)


def _positions(h: np.ndarray, level: int, probe: int, mask: np.ndarray | np.uint64) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(h + np.uint64(level * PROBES + probe + 1) * _A) & mask


def build(h: np.ndarray, levels: np.ndarray | int, bits_each: float, most_bits: int) -> bytes:
    """The segment of these items: a power of two of bits, at most most_bits."""
    levels = np.broadcast_to(np.asarray(levels), h.shape)
    wanted = max(64, int(levels.sum() * bits_each))
    size = 1 << min(wanted.bit_length(), int(most_bits).bit_length() - 1)
    marks = np.zeros(size, np.uint8)
    for level in range(1, int(levels.max(initial=0)) + 1):
        own = h[levels >= level]
        for probe in range(PROBES):
            marks[_positions(own, level, probe, np.uint64(size - 1)).astype(np.int64)] = 1
    return np.packbits(marks, bitorder="little").tobytes()


class Filter:
    """Segments put together; an absent one is empty."""

    def __init__(self, segments: int, parts: dict[int, bytes]):
        self.segments = segments
        empty = bytes(8)
        held = [parts.get(i, empty) for i in range(segments)]
        sizes = np.array([8 * len(x) for x in held], np.uint64)
        self.mask = sizes - np.uint64(1)
        self.start = np.concatenate(([0], np.cumsum(sizes)[:-1])).astype(np.uint64)
        self.bits = np.frombuffer(b"".join(held), np.uint8)

    def has(self, h: np.ndarray, level: int = 1) -> np.ndarray:
        """Whether each item was inserted with this level, or seems so."""
        where = segment_of(h, self.segments)
        start, mask = self.start[where], self.mask[where]
        out = np.ones(len(h), bool)
        alive = np.arange(len(h))
        for probe in range(PROBES):
            at = start[alive] + _positions(h[alive], level, probe, mask[alive])
            hit = (self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1
            out[alive[hit == 0]] = False
            alive = alive[hit > 0]
        return out

    def level(self, h: np.ndarray, most: int) -> np.ndarray:
        """The level of each item, 0 for none, by probing one level after another."""
        out = np.zeros(len(h), np.int64)
        alive = np.arange(len(h))
        for level in range(1, most + 1):
            alive = alive[self.has(h[alive], level)]
            if not len(alive):
                break
            out[alive] = level
        return out
