"""Vectorised hashing of words and word windows over UTF-8 bytes."""

from __future__ import annotations

import numpy as np

#: Fixed 64-bit constants: a multiplier, an odd base with its inverse, and the seed of the byte table.
GOLDEN = 0x9E3779B97F4A7C15
BASE = 0x2545F4914F6CDD1D
BASE_INV = pow(BASE, -1, 1 << 64)
CHUNK = 1 << 20

_u = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = x ^ (x >> _u(30))
    x = x * _u(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _u(27))
    x = x * _u(0x94D049BB133111EB)
    return x ^ (x >> _u(31))


def _table() -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(np.arange(1, 257, dtype=_u) * _u(GOLDEN))


BYTES = _table()
LOWER = BYTES.copy()
LOWER[65:91] = BYTES[97:123]
#: ASCII white space: space and the codes 9 to 13.
SPACE = np.zeros(256, dtype=bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True

_powers: list[np.ndarray] = []


def _pow(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(1 << 14, 1 << (n - 1).bit_length())
        _powers[:] = []
        for b in (BASE, BASE_INV):
            p = np.full(size, _u(b & (2**64 - 1)), dtype=_u)
            p[0] = 1
            _powers.append(np.multiply.accumulate(p))
    return _powers[0], _powers[1]


def word_spans(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets (start, end) of the runs of bytes that are not ASCII white space."""
    if not data:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    inside = np.zeros(len(data) + 2, dtype=np.int8)
    inside[1:-1] = ~SPACE[np.frombuffer(data, np.uint8)]
    edges = np.flatnonzero(np.diff(inside))
    return edges[::2], edges[1::2]


def word_hashes(data: bytes, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of a text as byte spans and 64-bit hashes; ``lower`` folds A-Z."""
    starts, ends = word_spans(data)
    return starts, ends, span_hashes(data, starts, ends, lower)


def span_hashes(data: bytes, starts: np.ndarray, ends: np.ndarray, lower: bool = False, other: bool = False) -> np.ndarray:
    """64-bit hashes of spans that don't overlap and between which there is only white space; ``other`` gives independent ones.

    Long texts go through in pieces of about ``CHUNK`` bytes, cut between words, so that memory stays bounded.
    """
    n = len(starts)
    out = np.empty(n, dtype=_u)
    if n == 0:
        return out
    codes = np.frombuffer(data, np.uint8)
    values = LOWER if lower else BYTES
    values = mix(values ^ _u(BASE)) if other else values
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + CHUNK, side="right")))
        base, stop = int(starts[at]), int(ends[to - 1])
        power, inverse = _pow(stop - base + 1)
        part = codes[base:stop]
        prod = values[part] * power[: stop - base]
        prod[SPACE[part]] = 0
        begin = starts[at:to] - base
        out[at:to] = np.add.reduceat(prod, begin) * inverse[begin]
        at = to
    return mix(out)


def windows(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all windows of ``k`` consecutive words, in order."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, dtype=_u)
    acc = hashes[:n].copy()
    for j in range(1, k):
        acc *= _u(GOLDEN)
        acc += hashes[j : j + n]
    return mix(acc)


class Store:
    """Ids of hashed pieces of text, cached: sorted hashes with slots that point into one array of ids.

    Only the distinct pieces of a batch are looked up. Beyond ``limit`` pieces it is emptied. Each occurrence is checked by
    a second, independent hash; where that differs, the batch's pieces are all made anew and none is looked up.
    """

    def __init__(self, limit: int):
        self.limit = limit
        self.clear()

    def clear(self) -> None:
        self.keys, self.slot = np.empty(0, _u), np.empty(0, np.int64)
        self.ids, self.bound, self.used = np.empty(1 << 16, np.uint32), np.zeros(1 << 14, np.int64), 0
        self.second = np.empty(1 << 14, _u)

    def _learn(self, at: np.ndarray, hashes: np.ndarray, second: np.ndarray, parts: list) -> None:
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        n, m, total = len(self.keys), len(parts), int(sizes.sum())
        if self.used + total > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.used], np.empty(self.used + 2 * total, np.uint32)])
        if n + m + 1 > len(self.bound):
            self.bound = np.concatenate([self.bound[: n + 1], np.zeros(n + 2 * m + 1, np.int64)])
            self.second = np.concatenate([self.second[:n], np.empty(len(self.bound) - n, _u)])
        self.ids[self.used : self.used + total] = np.concatenate(parts)
        self.bound[n + 1 : n + 1 + m] = self.used + np.cumsum(sizes)
        self.second[n : n + m] = second
        self.used += total
        self.keys = np.insert(self.keys, at, hashes)
        self.slot = np.insert(self.slot, at, np.arange(n, n + m))

    def gather(self, hashes: np.ndarray, second: np.ndarray, make) -> tuple[np.ndarray, np.ndarray]:
        """All pieces' ids in a row, and the bounds of each piece in them. ``make``: from places of new pieces to their ids."""
        distinct, first, place = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.keys) + len(distinct) > self.limit:
            self.clear()
        at = np.searchsorted(self.keys, distinct)
        new = np.flatnonzero((at == len(self.keys)) | (np.append(self.keys, _u(0))[at] != distinct))
        if len(new):
            self._learn(at[new], distinct[new], second[first[new]], make(first[new]))
            at = np.searchsorted(self.keys, distinct)
        slot = self.slot[at]
        if not np.array_equal(self.second[slot][place], second):
            parts = make(np.arange(len(hashes)))
            return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])])
        begin, size = self.bound[slot][place], (self.bound[slot + 1] - self.bound[slot])[place]
        stop = np.cumsum(size)
        ids = self.ids[np.repeat(begin - stop + size, size) + np.arange(stop[-1] if len(stop) else 0)]
        return ids, np.concatenate([[0], stop])


def code_table(size: int = 0x110000) -> np.ndarray:
    """A 64-bit value for each code point."""
    return mix(np.arange(1, size + 1, dtype=_u) * _u(GOLDEN))


def code_hashes(codes: np.ndarray, starts: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Hashes of adjoining slices of code points, by where they begin."""
    power, inverse = _pow(len(codes))
    return mix(np.add.reduceat(table[codes] * power[: len(codes)], starts) * inverse[starts])
