"""Columnar text kernels: numpy over the byte buffers of Arrow string columns.

Python strings are never made for single words here.  A word is a pair of byte offsets.  Two kinds
of hash are used.  ``span_hashes`` is a polynomial, taken from prefix sums, and only says where to
look: strings can be written that agree on it, so bytes decide afterwards.  ``digests`` mixes eight
bytes at a time (XXH3 for longer words) into 128 bits and stands for the word itself.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash

#: Work is done on runs of documents of about this many bytes, which bounds the temporaries.
BLOCK_BYTES = 1 << 20

_R = 0x9E3779B97F4A7C15
#: Words of more bytes are hashed one by one.
_SHORT = 32
_SEEDS = (0x243F6A8885A308D3, 0x13198A2E03707344)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def column_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; a null is an empty value."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_binary())
    if pa.types.is_dictionary(column.type):
        column = column.dictionary_decode()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    n = len(column)
    if not n:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64, n + 1 + column.offset)[column.offset :]
    lo, hi = int(offsets[0]), int(offsets[-1])
    raw = np.frombuffer(data, np.uint8, hi)[lo:hi] if data is not None and hi > lo else np.empty(0, np.uint8)
    return raw, offsets - lo


def runs(offsets: np.ndarray, block: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Index ranges of whole documents, each of about ``block`` bytes or one document."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + block, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser, elementwise."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=8)
def _powers(n: int, inverse: bool) -> np.ndarray:
    r = pow(_R, -1, 1 << 64) if inverse else _R
    out = np.empty(n, np.uint64)
    out[0], k = 1, 1
    while k < n:
        m = min(k, n - k)
        out[k : k + m] = out[:m] * np.uint64(pow(r, k, 1 << 64))
        k += m
    return out


def _size(n: int) -> int:
    return max(BLOCK_BYTES * 2, 1 << (int(n) + 1).bit_length())


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of data[starts[i]:ends[i]] for each i; equal hashes don't prove equal bytes."""
    n = len(data)
    if not len(starts):
        return np.empty(0, np.uint64)
    size = _size(n)
    pre = np.empty(n + 1, np.uint64)
    pre[0] = 0
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(size, False)[:n], out=pre[1:])
    h = (pre[ends] - pre[starts]) * _powers(size, True)[starts]
    return mix(h + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def digests(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lanes: int = 2) -> list[np.ndarray]:
    """128 bits (or the first 64) of each data[starts[i]:ends[i]], in lanes of 64 bits, that stand for its bytes.

    Every eight bytes go through a non-linear step of their own, so no pattern of letters makes two words agree.
    """
    size = ends - starts
    out = [size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(seed) for seed in _SEEDS[:lanes]]
    if not len(size):
        return out
    eights = np.ndarray((len(data) + 1,), "<u8", np.append(data, np.zeros(8, np.uint8)).tobytes(), strides=(1,))
    at, step = np.flatnonzero(size <= _SHORT), 0
    while len(at):
        left = size[at] - step
        at, left = at[left > 0], left[left > 0]
        block = eights[starts[at] + step]
        cut = left < 8
        block[cut] &= (np.uint64(1) << (8 * left[cut]).astype(np.uint64)) - np.uint64(1)
        for lane in out:
            lane[at] = mix(lane[at] ^ block) + np.uint64(_R)
        step += 8
    at = np.flatnonzero(size > _SHORT)
    if len(at):
        raw = memoryview(np.ascontiguousarray(data))
        long = [xxhash.xxh3_128_intdigest(raw[a:b]) for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]
        for k, lane in enumerate(out):
            lane[at] = np.array([h >> 64 * k & 0xFFFFFFFFFFFFFFFF for h in long], np.uint64)
    return out


def sequence_hashes(words: np.ndarray, k: int, at: np.ndarray | None = None) -> np.ndarray:
    """Hashes of the k words (as one lane of ``digests``) from each place, or from the places ``at``."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n if at is None else len(at), np.uint64)
    for i in range(k):
        out ^= words[i : i + n] if at is None else words[at + i]
        out *= np.uint64(0x9FB21C651E98DF25)
        out ^= out >> np.uint64(29)
    return mix(out)


def words(data: np.ndarray, offsets: np.ndarray, letters: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of bytes other than 0x20 and 0x09-0x0D (or of ``letters``): starts, ends, document of each.

    Those bytes never occur inside a longer UTF-8 sequence, so this is the split by code points as well.
    """
    n = len(data)
    if not n:
        e = np.empty(0, np.int64)
        return e, e, e
    letter = ~_SPACE[data] if letters is None else letters[data]
    first = np.zeros(n + 1, bool)
    first[offsets[:-1]] = True  # a document's first byte never continues a word
    first = first[:n]
    prev = np.empty(n, bool)
    prev[0] = False
    prev[1:] = letter[:-1]
    starts = np.flatnonzero(letter & (~prev | first))
    last = np.empty(n, bool)
    last[-1] = True
    last[:-1] = ~letter[1:] | first[1:]
    ends = np.flatnonzero(letter & last) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


# --- pre-tokens of the byte-level BPE pattern -------------------------------------------------

_L, _N, _S, _O, _UNSURE = 0, 1, 2, 3, 4
#: Code points with the Unicode property White_Space.
_WHITE = [0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    out = np.full(0x110000, _O, np.uint8)
    for c in range(0x110000):
        k = unicodedata.category(chr(c))
        if k[0] == "L":
            out[c] = _L
        elif k[0] == "N":
            out[c] = _N
        elif k == "Cn":
            out[c] = _UNSURE
    out[_WHITE] = _S
    return out


@lru_cache(maxsize=1)
def _low_classes() -> np.ndarray:
    out = np.full(0x3000, _O, np.uint8)
    for c in range(0x3000):
        k = unicodedata.category(chr(c))
        out[c] = _L if k[0] == "L" else _N if k[0] == "N" else _UNSURE if k == "Cn" else _O
    out[[c for c in _WHITE if c < 0x3000]] = _S
    return out


def pretokens(data: np.ndarray, offsets: np.ndarray, classes: Callable[[np.ndarray], np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Splits documents as the byte-level BPE pattern does: starts, ends, document of each, unsure documents.

    The pattern's alternatives come down to runs of one class (letter, number, white space, other):
    a space before a run joins it, white space before a run keeps its last character apart, and an
    apostrophe alone takes the letters of a contraction.  Unsure documents hold code points at which
    libraries with other Unicode versions may differ; ``classes`` tells the classes of such code points, and then no document is unsure.
    """
    n_docs = len(offsets) - 1
    if not len(data):
        e = np.empty(0, np.int64)
        return e, e, e, np.zeros(n_docs, bool)
    lead = (data & 0xC0) != 0x80
    at = np.flatnonzero(lead)
    if len(at) == len(data):
        cp = data.astype(np.uint32)
    else:
        cp = np.frombuffer(data.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(cp)
    high = int(cp.max())
    cls = _low_classes()[cp] if high < 0x3000 else _classes()[cp]
    doc_first = np.searchsorted(at, offsets[:-1][offsets[:-1] < len(data)])
    is_first = np.zeros(n, bool)
    is_first[doc_first] = True
    unsure = np.zeros(n_docs, bool)
    odd = (cls == _UNSURE) | (cp >= 0x3000) | ((cp >= 0x1C) & (cp <= 0x1F))
    if odd.any() and classes is not None:
        which, where = np.unique(cp[odd], return_inverse=True)
        cls = cls.copy()
        cls[odd] = classes(which)[where]
    elif odd.any():
        unsure[np.searchsorted(offsets, at[odd], "right") - 1] = True
        cls = np.where(cls == _UNSURE, np.uint8(_O), cls)
    cut = np.ones(n + 1, bool)
    cut[1:n] = (cls[1:] != cls[:-1]) | is_first[1:]
    white = cls == _S
    after = np.flatnonzero(white[:-1] & ~white[1:] & ~is_first[1:]) + 1  # a run that follows white space
    cut[after - 1] = True
    cut[after] = cp[after - 1] != 0x20
    # contractions: a cut-off apostrophe directly before lower-case letters
    q = np.flatnonzero((cp == 0x27) & cut[:n])
    if len(q):
        q = q[q + 1 < n]
        q = q[(cls[q + 1] == _L) & ~is_first[q + 1]]
        a = cp[q + 1]
        b = np.where(q + 2 < n, cp[np.minimum(q + 2, n - 1)], 0)
        b = np.where((q + 2 < n) & ~is_first[np.minimum(q + 2, n - 1)], b, 0)
        one = np.isin(a, [ord(c) for c in "stmd"])
        two = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
        cut[q[one] + 1] = False
        cut[q[one] + 2] = True
        cut[q[two] + 1] = False
        cut[q[two] + 3] = True
    edge = np.append(at, len(data))[np.flatnonzero(cut)]
    starts, ends = edge[:-1], edge[1:]
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1, unsure


class PieceCache:
    """From a pre-token to its ids: an open-addressing table in arrays, emptied when ``limit`` entries are in it.

    A hash tells where to look and the bytes, which are kept, decide.  Of several pre-tokens with one hash the first
    is kept and the others are encoded each time.
    """

    def __init__(self, encode, limit: int = 1_000_000):
        self.encode, self.limit = encode, limit
        self.bits = max(10, (2 * limit).bit_length())
        self.clear()

    def clear(self) -> None:
        self.n = 0
        self.keys = np.zeros(1 << self.bits, np.uint64)
        self.slot = np.zeros(1 << self.bits, np.int32)
        self.begin, self.size, self.ids = np.empty(1024, np.int64), np.empty(1024, np.int32), np.empty(4096, np.uint32)
        self.text, self.text_at, self.text_size = np.empty(4096, np.uint8), np.empty(1024, np.int64), np.empty(1024, np.int64)
        self.used = self.text_used = 0

    def _find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place of each key, or of the free cell where it belongs; whether it is there)."""
        mask = (1 << self.bits) - 1
        pos = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        got = self.keys[pos]
        found = got == h
        left = np.flatnonzero(~found & (got != 0))
        while len(left):
            pos[left] = (pos[left] + 1) & mask
            got = self.keys[pos[left]]
            hit = got == h[left]
            found[left[hit]] = True
            left = left[~hit & (got != 0)]
        return pos, found

    def _grow(self, name: str, need: int) -> np.ndarray:
        a = getattr(self, name)
        if need > len(a):
            a = np.concatenate([a, np.empty(max(need, 2 * len(a)) - len(a), a.dtype)])
            setattr(self, name, a)
        return a

    def _append(self, name: str, at: int, values: np.ndarray) -> int:
        self._grow(name, at + len(values))[at : at + len(values)] = values
        return at + len(values)

    def lookup(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pre-tokens, one after another; number of ids of each)."""
        h = span_hashes(data, starts, ends)
        h[h == 0] = 1
        if self.n > self.limit or self.text_used > 64 * self.limit:
            self.clear()
        pos, found = self._find(h)
        raw = None
        if not found.all():
            new, first = np.unique(h[~found], return_index=True)
            at = np.flatnonzero(~found)[first]
            raw = data.tobytes()
            pieces = self.encode([raw[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)])
            size = np.fromiter(map(len, pieces), np.int32, len(pieces))
            length = ends[at] - starts[at]
            self._append("begin", self.n, self.used + np.cumsum(size) - size)
            self._append("size", self.n, size)
            self._append("text_at", self.n, self.text_used + np.cumsum(length) - length)
            self._append("text_size", self.n, length)
            self.used = self._append("ids", self.used, np.fromiter((i for p in pieces for i in p), np.uint32, int(size.sum())))
            self.text_used = self._append("text", self.text_used, gather(data, starts[at], length))
            self._insert(new, np.arange(self.n, self.n + len(new), dtype=np.int32))
            self.n += len(new)
            pos[~found] = self._find(h[~found])[0]
        slot = self.slot[pos]
        size, begin = self.size[slot], self.begin[slot]
        wrong = self._differ(data, starts, ends, slot)
        ids = self.ids
        if len(wrong):
            raw = raw or data.tobytes()
            pieces = self.encode([raw[a:b] for a, b in zip(starts[wrong].tolist(), ends[wrong].tolist(), strict=True)])
            size[wrong] = [len(p) for p in pieces]
            begin[wrong] = self.used + np.cumsum(size[wrong]) - size[wrong]
            ids = np.append(ids[: self.used], np.fromiter((i for p in pieces for i in p), np.uint32))
        return gather(ids, begin, size), size

    def _differ(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, slot: np.ndarray) -> np.ndarray:
        """Places of those whose bytes aren't the ones kept."""
        length = ends - starts
        same = self.text_size[slot] == length
        at = np.flatnonzero(same)
        if len(at):
            length = length[at]
            off = gather(self.text, self.text_at[slot[at]], length) != gather(data, starts[at], length)
            if off.any():
                same[at[np.searchsorted(np.cumsum(length), np.flatnonzero(off), "right")]] = False
        return np.flatnonzero(~same)

    def _insert(self, keys: np.ndarray, slots: np.ndarray) -> None:
        while self.n + len(keys) > 3 << (self.bits - 2):  # one very rich batch
            old_keys, old_slot = self.keys[self.keys != 0], self.slot[self.keys != 0]
            self.bits += 1
            self.keys, self.slot = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.int32)
            self._place(old_keys, old_slot)
        self._place(keys, slots)

    def _place(self, keys: np.ndarray, slots: np.ndarray) -> None:
        while len(keys):
            pos, _ = self._find(keys)
            _, first = np.unique(pos, return_index=True)  # of those that want the same cell, one gets it
            self.keys[pos[first]], self.slot[pos[first]] = keys[first], slots[first]
            rest = np.ones(len(keys), bool)
            rest[first] = False
            keys, slots = keys[rest], slots[rest]


def gather(values: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """values[begin[i]:begin[i]+size[i]] for all i, one after another."""
    total = int(size.sum())
    if not total:
        return values[:0]
    stop = np.cumsum(size)
    return values[np.arange(total) + np.repeat(begin - (stop - size), size)]
