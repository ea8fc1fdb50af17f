"""A pool of sets of bases as a prefix tree in flat arrays, probed by batches of strings.

Barcodes that allow the same bases at their first places share the nodes of these.  A batch walks the tree level by level: the
frontier holds (string, node, mismatches so far), and entries beyond the cap leave it.  Strings are looked for with no mismatch first, then
with one, and so on, so that the cap of each is never more than what its nearest barcode needs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from seqtally.functions.bases import IUPAC
from seqtally.operators.pool import BarcodePool

#: Entries of a frontier; strings are dealt into smaller batches where it would be larger.
MOST_FRONTIER = 1 << 20
_BIT = {b: 1 << i for i, b in enumerate("ACGT")}
_SETS = np.zeros(256, np.uint8)
for _code, _bases in IUPAC.items():
    _SETS[ord(_code)] = sum(_BIT[b] for b in _bases)
_OBSERVED = np.zeros(256, np.uint8)
for _base, _bit in _BIT.items():
    _OBSERVED[ord(_base)] = _bit


class PoolTree:
    """``sets[d]``: the bases each node of depth d + 1 allows; ``child[d]``: where the children of each node of depth d begin, and the end."""

    def __init__(self, pool: BarcodePool):
        self.length = pool.length
        text = np.frombuffer("".join(s.upper() for s in pool.sequences).encode(), np.uint8).reshape(len(pool), self.length)
        masks = _SETS[text]
        order = np.lexsort(masks.T[::-1]) if self.length else np.arange(len(pool))
        masks = masks[order]
        self.sets, self.child = [], []
        new, first = np.zeros(len(pool), bool), np.zeros(1, np.int64)
        new[:1] = True
        for d in range(self.length):
            new[1:] |= masks[1:, d] != masks[:-1, d]
            at = np.flatnonzero(new)
            self.sets.append(masks[at, d])
            self.child.append(np.append(np.searchsorted(at, first), len(at)))
            first = at
        self.low, self.high = np.minimum.reduceat(order, first), np.maximum.reduceat(order, first)

    @property
    def nbytes(self) -> int:
        return sum(a.nbytes for a in (*self.sets, *self.child, self.low, self.high))

    def _walk(self, bits: np.ndarray, cap: int) -> tuple[np.ndarray, np.ndarray]:
        """(string, leaf) of every barcode at most ``cap`` away."""
        string, node, miss = np.arange(len(bits)), np.zeros(len(bits), np.int64), np.zeros(len(bits), np.int32)
        for d in range(self.length):
            begin, end = self.child[d][node], self.child[d][node + 1]
            size = end - begin
            total = int(size.sum())
            if total > MOST_FRONTIER and len(bits) > 1:
                half = len(bits) // 2
                parts = [self._walk(bits[:half], cap), self._walk(bits[half:], cap)]
                return np.concatenate([parts[0][0], parts[1][0] + half]), np.concatenate([parts[0][1], parts[1][1]])
            stop = np.cumsum(size)
            child = np.arange(total) + np.repeat(begin - (stop - size), size)
            string, miss = np.repeat(string, size), np.repeat(miss, size)
            miss = miss + ((self.sets[d][child] & bits[string, d]) == 0)
            keep = miss <= cap
            string, node, miss = string[keep], child[keep], miss[keep]
        return string, node

    def nearest(self, strings: list[str], cap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(distance, first, last) of the nearest barcodes of each string; distance -1 where none is within cap."""
        distance = np.full(len(strings), -1, np.int32)
        first, last = np.zeros(len(strings), np.int32), np.zeros(len(strings), np.int32)
        fit = np.array([i for i, s in enumerate(strings) if s is not None and len(s) == self.length], np.int64)
        if not len(fit):
            return distance, first, last
        bits = _OBSERVED[np.frombuffer("".join(strings[i] for i in fit.tolist()).encode("ascii", "replace"), np.uint8).reshape(len(fit), self.length)]
        left = np.arange(len(fit))
        for c in range(min(cap, self.length) + 1):
            if not len(left):
                break
            string, leaf = self._walk(bits[left], c)
            low = np.full(len(left), np.iinfo(np.int64).max)
            high = np.full(len(left), -1)
            np.minimum.at(low, string, self.low[leaf])
            np.maximum.at(high, string, self.high[leaf])
            found = high >= 0
            at = fit[left[found]]
            distance[at], first[at], last[at] = c, low[found], high[found]
            left = left[~found]
        return distance, first, last


def probe(shared, cap: int, it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, distance, first, last) of the strings that have a barcode within cap."""
    tree: PoolTree = shared.value
    for batch in it:
        distance, first, last = tree.nearest(batch.column(0).to_pylist(), cap)
        out = pa.RecordBatch.from_arrays([batch.column(0), pa.array(distance), pa.array(first), pa.array(last)], names=["key", "distance", "first", "last"])
        yield out.filter(pa.array(distance >= 0))
