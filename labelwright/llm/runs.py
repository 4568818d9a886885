"""Runs of bytes of some kind in many texts at once, in vectorised steps."""

from __future__ import annotations

import zlib

import numpy as np

#: Bytes of a run whose CRC advances together with that of other runs; the rest of a longer run is taken alone.
TOGETHER = 64
#: Continuation bytes of UTF-8: all others begin a code point.
INNER = np.array([c & 0xC0 == 0x80 for c in range(256)])


def _crc_table() -> np.ndarray:
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = (out >> np.uint32(1)) ^ np.where(out & np.uint32(1), np.uint32(0xEDB88320), np.uint32(0))
    return out


_CRC = _crc_table()


def runs(mask: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, size and text of every maximal run of bytes in `mask` that lies within one text."""
    if not len(mask):
        return (np.zeros(0, np.int64),) * 3
    before = np.concatenate([[False], mask[:-1]])
    after = np.concatenate([mask[1:], [False]])
    edges = offsets[(offsets > 0) & (offsets < len(mask))]
    before[edges] = False
    after[edges - 1] = False
    first = np.flatnonzero(mask & ~before)
    size = np.flatnonzero(mask & ~after) + 1 - first
    return first, size, np.searchsorted(offsets, first, "right") - 1


def crc32s(data: np.ndarray, first: np.ndarray, size: np.ndarray, start: np.ndarray) -> np.ndarray:
    """CRC-32 of runs of `data`, each going on from the value `start`, as zlib.crc32(run, start) has it."""
    order = np.argsort(-size, kind="stable")
    at, left, state = first[order], size[order], ~start[order].astype(np.uint32)
    for j in range(min(TOGETHER, int(left[0]) if len(left) else 0)):
        n = np.searchsorted(-left, -j, "left")  # runs longer than j
        own = state[:n]
        state[:n] = _CRC[(own ^ data[at[:n] + j]) & np.uint32(255)] ^ (own >> np.uint32(8))
    out = np.empty(len(first), np.uint32)
    out[order] = ~state
    for i in np.flatnonzero(size > TOGETHER):
        out[i] = zlib.crc32(data[first[i] + TOGETHER : first[i] + size[i]], int(out[i]))
    return out


def gathered(data: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes of runs, which are disjoint and in order, end to end."""
    edge = np.zeros(len(data) + 1, np.int8)
    edge[first] += 1
    edge[first + size] -= 1
    return data[np.cumsum(edge[:-1], dtype=np.int8).astype(bool)]
