"""What designs find in single reads, by array operations over Arrow batches: the outcomes of ``outcomes.outcome``, many reads at a time.

Constant bases are compared at all places of a slice of reads at once; only where they fit are regions cut, and each distinct string of
regions is compared with the pool once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from seqtally.functions.bases import IUPAC
from seqtally.operators.pool import BarcodePool
from seqtally.plans.template import Template
from seqtally.schema import Duplicates

#: Letters of a slice of reads, and distances that are held at once.
SLICE, HELD = 1 << 20, 1 << 20
#: A base's place among ACGT, 4 for anything else.
_CODES = np.full(256, 4, np.uint8)
_CODES[[*b"ACGT"]] = range(4)
_BITS = np.array([1, 2, 4, 8, 0], np.uint8)
_TURNED = np.array([3, 2, 1, 0, 4], np.uint8)
#: Letters of a string that fits a 64-bit key.
_PACKED = 27


class Nearest:
    """The nearest barcodes of a pool to strings of codes."""

    def __init__(self, pool: BarcodePool):
        self.sets = np.array([[sum(1 << "ACGT".index(b) for b in IUPAC[c]) for c in s.upper()] for s in pool.sequences], np.uint8).reshape(len(pool), pool.length)

    def __call__(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(distance, first, last) of each row of codes."""
        n, length = codes.shape
        where = None
        if 0 < length <= _PACKED:
            key, at, where = np.unique(codes.astype(np.int64) @ 5 ** np.arange(length, dtype=np.int64), return_index=True, return_inverse=True)
            codes = codes[at]
        bits, pool = _BITS[codes], len(self.sets)
        out = [np.empty(len(codes), np.int32) for _ in range(3)]
        step = max(1, HELD // max(1, pool))
        for i in range(0, len(codes), step):
            part = bits[i : i + step]
            far = np.zeros((len(part), pool), np.int16)
            for j in range(length):
                far += (part[:, j, None] & self.sets[None, :, j]) == 0
            least = far.min(1)
            at_least = far == least[:, None]
            for o, x in zip(out, (least, at_least.argmax(1), pool - 1 - at_least[:, ::-1].argmax(1)), strict=True):
                o[i : i + step] = x
        return tuple(out) if where is None else tuple(o[where] for o in out)


def _texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(letters, offsets) of strings; any character is one letter, null is empty."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    letters = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    if len(letters) and letters.max() >= 0x80:
        texts = [s.encode("ascii", "replace") for s in column.to_pylist()]
        return np.frombuffer(b"".join(texts), np.uint8), np.append(0, np.cumsum([len(t) for t in texts]))
    return letters, offsets - offsets[0]


class Places:
    """Where a template's constant bases fit: for each place its read, position, strand, mismatches, and the codes of each region."""

    def __init__(self, codes: np.ndarray, offsets: np.ndarray, last: np.ndarray, template: Template, most: int, flags: tuple[bool, ...]):
        n, found = len(template), []
        for reverse in flags:
            size = max(0, len(codes) - n + 1)
            apart = np.zeros(size, np.uint8 if n < 256 else np.int32)
            for at, base in template.constants(reverse):
                apart += codes[at : at + size] != "ACGT".index(base)
            at = np.flatnonzero(apart <= most)
            read = np.searchsorted(offsets, at, "right") - 1
            position = at - offsets[read]
            good = position <= last[read]
            at, read, position = at[good], read[good], position[good]
            cut = [codes[at[:, None] + (np.arange(s, e) if not reverse else np.arange(n - s - 1, n - e - 1, -1))] for s, e in template.regions]
            found.append((read, position, np.full(len(at), reverse), apart[at].astype(np.int32), [_TURNED[c] for c in cut] if reverse else cut))
        self.read, self.position, self.reverse, self.mismatches = (np.concatenate([f[i] for f in found]) for i in range(4))
        self.regions = [np.concatenate([f[4][i] for f in found]) for i in range(len(template.regions))]


def resolved(places: Places, regions: list[np.ndarray], pools: list[Nearest], most: int, duplicates: Duplicates, use_first: bool, reads: int) -> np.ndarray:
    """The barcodes of each read, a row of places in the pools; -1 where it has none."""
    out = np.full((reads, len(pools)), -1, np.int32)
    if not all(len(p.sets) for p in pools) or not len(places.read):
        return out
    near = [p(r) for p, r in zip(pools, regions, strict=True)]
    total = places.mismatches + sum(d for d, _, _ in near)
    good = total <= most
    if duplicates not in (Duplicates.FIRST, Duplicates.LAST):
        for _, first, last in near:
            good &= first == last
    idx = np.stack([last if duplicates is Duplicates.LAST else first for _, first, last in near], 1)[good]
    read, total = places.read[good], total[good]
    order = np.lexsort((places.reverse[good], places.position[good], *(() if use_first else (total,)), read))
    read, total, idx = read[order], total[order], idx[order]
    begins = np.flatnonzero(np.append(True, read[1:] != read[:-1])) if len(read) else np.zeros(0, np.int64)
    out[read[begins]] = idx[begins]
    if not use_first:  # of equally good hits that differ none counts
        top = np.repeat(begins, np.diff(np.append(begins, len(read))))
        torn = (total == total[top]) & (idx != idx[top]).any(1)
        out[read[torn]] = -1
    return out


class Single:
    """Rows of barcodes of reads for designs of one read: ``find`` takes upper-case letters of reads and the number of letters of each before that."""

    def __init__(self, template: Template, most: int, flags: tuple[bool, ...], pools: list[BarcodePool], duplicates: Duplicates, use_first: bool, joined: bool = False):
        self.template, self.most, self.flags, self.duplicates, self.use_first, self.joined = template, most, flags, duplicates, use_first, joined
        self.pools = [Nearest(p) for p in pools]

    def places(self, letters: np.ndarray, offsets: np.ndarray, last: np.ndarray) -> Places:
        return Places(_CODES[letters], offsets, last, self.template, self.most, self.flags)

    def find(self, places: Places, reads: int) -> np.ndarray:
        regions = [np.concatenate(places.regions, 1)] if self.joined else places.regions
        return resolved(places, regions, self.pools, self.most, self.duplicates, self.use_first, reads)


def outcomes(steps: list[tuple[str, list[str], Single]], columns: list[str], weighted: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(kind, columns, weight) of batches of (upper-case text, letters before that, weight): the first step that finds something in a read gives its kind.

    Without weights equal results of a batch are one row.  The steps share their template, strand and number of mismatches.
    """
    first = steps[0][2]
    for batch in batches:
        if not batch.num_rows:
            continue
        letters, offsets = _texts(batch.column(0))
        size = np.diff(offsets)
        last = np.minimum(size, batch.column(1).fill_null(0).to_numpy(zero_copy_only=False)) - len(first.template)
        kind, found = np.zeros(len(size), np.int8), np.full((len(size), len(columns)), -1, np.int32)
        i = 0
        while i < len(size):
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + SLICE, "right")) - 1)
            places = first.places(letters[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], last[i:j])
            for k, (_, own, step) in enumerate(steps, 1):
                rows = step.find(places, j - i)
                free = np.flatnonzero((kind[i:j] == 0) & (rows >= 0).all(1)) + i
                kind[free] = k
                for m, c in enumerate(own):
                    found[free, columns.index(c)] = rows[free - i, m]
            i = j
        names = pa.array([None, *(k for k, _, _ in steps)], pa.string())
        if weighted:
            weight = batch.column(2)
        else:
            groups = pa.table({"kind": kind, **{c: found[:, m] for m, c in enumerate(columns)}}).group_by(["kind", *columns], use_threads=False).aggregate([([], "count_all")]).combine_chunks()
            kind, weight = groups["kind"].to_numpy(), groups["count_all"].combine_chunks()
            found = np.stack([groups[c].to_numpy() for c in columns], 1)
        yield pa.RecordBatch.from_arrays([names.take(pa.array(kind)), *(pa.array(found[:, m], mask=found[:, m] < 0) for m in range(len(columns))), weight], names=["kind", *columns, "_w"])
