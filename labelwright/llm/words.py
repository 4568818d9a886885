"""Words of many texts at once, in vectorised steps, and 64-bit hashes of their bytes.

Words are runs of bytes other than 9-13 and 32; A-Z are lower-cased. A hash mixes a word's bytes eight at a time, each
step multiplied and shifted twice, so that no linear relation of the bytes survives; words of up to eight bytes that have
one length never share a hash, as every step can be undone.
"""

from __future__ import annotations

import numpy as np

SPACE = 32
LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)
WHITE = np.array([c == SPACE or 9 <= c <= 13 for c in range(256)])
SEED, STEP = np.uint64(0xA0761D6478BD642F), np.uint64(0x9E3779B97F4A7C15)
_FIRST, _SECOND = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_SHIFT, _EIGHT = np.uint64(32), np.uint64(8)


def mixed(x: np.ndarray) -> np.ndarray:
    """A permutation of the 64-bit numbers without visible order."""
    x = (x ^ (x >> _SHIFT)) * _FIRST
    x = (x ^ (x >> np.uint64(29))) * _SECOND
    return x ^ (x >> _SHIFT)


class Lanes:
    """Bytes that can be read eight at a time from any place; those beyond the end are 0."""

    def __init__(self, data: np.ndarray):
        aligned = np.zeros(len(data) // 8 + 2, np.uint64)
        aligned.view(np.uint8)[: len(data)] = data
        self.aligned = aligned

    def read(self, at: np.ndarray) -> np.ndarray:
        whole, shift = at >> 3, ((at & 7) << 3).astype(np.uint64)
        low = self.aligned[whole] >> shift
        # Twice half a shift, as one of 64 bits is not defined.
        return low | ((self.aligned[whole + 1] << (np.uint64(63) - shift)) << np.uint64(1))


_KEPT = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def hashes(lanes: Lanes, first: np.ndarray, size: np.ndarray, seed: np.uint64 = SEED) -> np.ndarray:
    """A hash of the `size` bytes from each place `first` on."""
    out = mixed(size.astype(np.uint64) * STEP ^ seed)
    out = mixed(out ^ mixed((lanes.read(first) & _KEPT[np.minimum(size, 8)]) * STEP))
    left = np.flatnonzero(size > 8)
    step = 8
    while len(left):
        rest = size[left] - step
        out[left] = mixed(out[left] ^ mixed((lanes.read(first[left] + step) & _KEPT[np.minimum(rest, 8)]) * STEP))
        left, step = left[rest > 8], step + 8
    return out


def differing(lanes: Lanes, a: np.ndarray, others: Lanes, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Which of the runs of `size` bytes from a on in `lanes` differ from those from b on in `others`."""
    out, left, step = np.zeros(len(a), bool), np.flatnonzero(size > 0), 0
    while len(left):
        rest = size[left] - step
        off = ((lanes.read(a[left] + step) ^ others.read(b[left] + step)) & _KEPT[np.minimum(rest, 8)]) != 0
        out[left[off]] = True
        left, step = left[(rest > 8) & ~off], step + 8
    return out


def spaced(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> np.ndarray:
    """All texts end to end with their bytes replaced by `table`, a space before each and after the last."""
    n = len(offsets) - 1
    out = np.full(len(data) + n + 1, SPACE, np.uint8)
    for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        np.take(table, data[a:b], out=out[a + i + 1 : b + i + 1])
    return out


class Words:
    """Words of some texts: their first bytes and sizes in `text`, where each text's begin, and how many each has."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.text = spaced(data, offsets, LOWER)
        white = WHITE[self.text]
        edge = np.flatnonzero(white[1:] != white[:-1]) + 1
        self.first = edge[::2]
        self.size = edge[1::2] - self.first
        self.begin = np.searchsorted(self.first, offsets + np.arange(len(offsets)))
        self.counts = np.diff(self.begin)
        self.lanes = Lanes(self.text)

    def keys(self) -> np.ndarray:
        return hashes(self.lanes, self.first, self.size)
