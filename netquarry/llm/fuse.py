"""Static binary-fuse filters: three-wise, eight-bit fingerprints, about nine bits a key, no false negatives."""

from __future__ import annotations

import math
import struct

import numpy as np

_HEAD = struct.Struct("<QIII")  # seed, segment length, segments, cells


def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
    h = keys + np.uint64(seed)
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return h ^ (h >> np.uint64(33))


def _cells(h: np.ndarray, length: int, segments: int) -> np.ndarray:
    """The three cells of each key, in three neighbouring segments."""
    first = ((h >> np.uint64(32)) * np.uint64(segments * length)) >> np.uint64(32)
    mask = np.uint64(length - 1)
    second = (first + np.uint64(length)) ^ ((h >> np.uint64(18)) & mask)
    third = (first + np.uint64(2 * length)) ^ (h & mask)
    return np.stack([first, second, third]).astype(np.int64)


def _mark(h: np.ndarray) -> np.ndarray:
    return ((h ^ (h >> np.uint64(32))) & np.uint64(255)).astype(np.uint8)


def build(keys: np.ndarray) -> bytes:
    """A filter of 64-bit keys; repeated keys count once."""
    keys = np.unique(np.asarray(keys, np.uint64))
    n = len(keys)
    length = min(1 << 18, 1 << math.floor(math.log(max(n, 2)) / math.log(3.33) + 2.25))
    size = n * max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(max(n, 2)))
    segments = max(1, math.ceil(size / length) - 2)
    cells = (segments + 2) * length
    for seed in range(1, 200):
        h = _mix(keys, seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        at = _cells(h, length, segments)
        degree = np.bincount(at.ravel(), minlength=cells)
        mixed = np.zeros(cells, np.int64)
        for row in at:
            np.bitwise_xor.at(mixed, row, np.arange(n))
        rounds, peeled = [], 0
        alone = np.flatnonzero(degree == 1)
        while len(alone):
            ids, first = np.unique(mixed[alone], return_index=True)
            rounds.append((ids, alone[first]))
            peeled += len(ids)
            for row in at[:, ids]:
                np.subtract.at(degree, row, 1)
                np.bitwise_xor.at(mixed, row, ids)
            touched = np.unique(at[:, ids])
            alone = touched[degree[touched] == 1]
        if peeled == n:
            marks = np.zeros(cells, np.uint8)
            own = _mark(h)
            for ids, cell in reversed(rounds):
                x, y, z = marks[at[:, ids]]
                marks[cell] = own[ids] ^ x ^ y ^ z  # the cell itself is still 0
            return _HEAD.pack(seed, length, segments, cells) + marks.tobytes()
    raise RuntimeError("no seed peels all keys")


def contains(content: bytes, keys: np.ndarray) -> np.ndarray:
    """For each key, False only if it isn't in the filter."""
    seed, length, segments, cells = _HEAD.unpack_from(content)
    marks = np.frombuffer(content, np.uint8, cells, _HEAD.size)
    h = _mix(np.asarray(keys, np.uint64), seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    x, y, z = marks[_cells(h, length, segments)]
    return _mark(h) == x ^ y ^ z
