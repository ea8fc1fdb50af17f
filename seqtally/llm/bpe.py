"""Byte-level BPE with a hierarchical-bitmap rank queue.

Merges are taken by rank.  There is a bucket for each rank that holds places in the linked list of
symbols, and a bitmap of non-empty buckets with two levels of summaries above it; find-first-set
from the top gives the next rank in three steps whatever the length.  Entries that a neighbouring
merge has outdated stay in their bucket and are skipped.  A pre-token of n bytes costs about
n steps of a heap of its own rank's places, so very long ones are no special case.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqtally.llm.common import arrow_schema, field, slices
from seqtally.llm.kernels import _L, _N, _O, _S, _WHITE, PieceCache, column_bytes, gather, pretokens, runs


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def load_ranks(path: str) -> dict[bytes, int]:
    out = {}
    with open(path, "rb") as f:
        for line in f:
            token, rank = line.split()
            out[base64.b64decode(token)] = int(rank)
    return out


class RankQueue:
    """A set of (rank, place) with the least rank, and its least place, first."""

    def __init__(self, ranks: int):
        self.low = [0] * (ranks // 64 + 1)
        self.mid = [0] * (ranks // 4096 + 1)
        self.top = 0
        self.buckets: dict[int, list[int]] = {}

    def push(self, rank: int, place: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket:
            heappush(bucket, place)
            return
        self.buckets[rank] = [place]
        self.low[rank >> 6] |= 1 << (rank & 63)
        self.mid[rank >> 12] |= 1 << (rank >> 6 & 63)
        self.top |= 1 << (rank >> 12)

    def pop(self) -> tuple[int, int] | None:
        if not self.top:
            return None
        a = (self.top & -self.top).bit_length() - 1
        word = self.mid[a]
        b = a << 6 | (word & -word).bit_length() - 1
        word = self.low[b]
        rank = b << 6 | (word & -word).bit_length() - 1
        bucket = self.buckets[rank]
        place = heappop(bucket)
        if not bucket:
            del self.buckets[rank]
            self.low[b] ^= 1 << (rank & 63)
            if not self.low[b]:
                self.mid[a] ^= 1 << (b & 63)
                if not self.mid[a]:
                    self.top ^= 1 << a
        return rank, place


class Bpe:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.most = max(ranks.values(), default=0) + 1
        self.queue = RankQueue(self.most)  # empty again after each pre-token
        by_id = [b""] * self.most
        for token, rank in ranks.items():
            by_id[rank] = token
        self.sizes = np.fromiter(map(len, by_id), np.int64, len(by_id))
        self.begin = np.cumsum(self.sizes) - self.sizes
        self.bytes = np.frombuffer(b"".join(by_id), np.uint8)

    def encode_piece(self, piece: bytes) -> list[int]:
        ranks = self.ranks
        whole = ranks.get(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        if not n:
            return []
        queue, get = self.queue, ranks.get
        stop = list(range(1, n + 1))  # where the symbol that starts here ends; also the next symbol
        before = list(range(-1, n - 1))
        pair = [-1] * n  # the rank of the merge of the symbol here with the next
        for i in range(n - 1):
            rank = get(piece[i : i + 2])
            if rank is not None:
                pair[i] = rank
                queue.push(rank, i)
        while (entry := queue.pop()) is not None:
            rank, i = entry
            if pair[i] != rank:
                continue
            j = stop[i]
            end = stop[j]
            stop[i], pair[j] = end, -1
            if end < n:
                before[end] = i
                new = get(piece[i : stop[end]])
            else:
                new = None
            pair[i] = -1 if new is None else new
            if new is not None:
                queue.push(new, i)
            h = before[i]
            if h >= 0:
                new = get(piece[h:end])
                if new is None:
                    pair[h] = -1
                elif new != pair[h]:
                    pair[h] = new
                    queue.push(new, h)
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : stop[i]]])
            i = stop[i]
        return out

    def encode_all(self, pieces: list[bytes]) -> list[list[int]]:
        return [self.encode_piece(p) for p in pieces]

    def decode(self, ids: np.ndarray) -> np.ndarray:
        return gather(self.bytes, self.begin[ids], self.sizes[ids])


@lru_cache(maxsize=2)
def _loaded(path: str) -> tuple[Bpe, PieceCache]:
    bpe = Bpe(load_ranks(path))
    return bpe, PieceCache(bpe.encode_all)


class LibraryClasses:
    """Letter, number or other: the classes that the tiktoken library gives to code points, by how it cuts them.

    Its Unicode version may be newer than Python's.  Before ``'s`` an apostrophe stays with what is neither a letter nor a number, and
    an ``x`` stays with a letter alone; two small vocabularies of its own show which.
    """

    def __init__(self, pattern: str):
        import tiktoken

        single = {bytes([i]): i for i in range(256)}
        after = {bytes([i]) + b"x": 256 + i for i in range(256) if i != 0x27}
        self.library = tiktoken.Encoding("classes", pat_str=pattern, mergeable_ranks=single | after | {b"'s": 256 + 0x27}, special_tokens={})
        self.known = np.full(0x110000, 255, np.uint8)
        self.known[_WHITE] = _S

    def __call__(self, points: np.ndarray) -> np.ndarray:
        for c in points[self.known[points] == 255].tolist():
            apart = self.library.encode_ordinary(chr(c) + "'s")[-1] == 256 + 0x27
            self.known[c] = (_L if self.library.encode_ordinary(chr(c) + "x")[-1] >= 256 else _N) if apart else _O
        return self.known[points]


@lru_cache(maxsize=1)
def _library_classes() -> LibraryClasses:
    import public_tokenizers

    return LibraryClasses(public_tokenizers.PATTERN)


def encode_decode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str | None = None, digests: bool = False) -> DataFrame:
    """doc_id, n_tokens, and ids (little-endian unsigned 32-bit) with the decoded bytes, or the digests of both.

    Texts are cut into pre-tokens as the tiktoken library cuts them, by its classes of code points.  A null text is empty and has no ids.  Each row is on its own: repeated rows, null ids and extra
    columns change nothing.  An empty table gives no rows.
    """
    path = ranks or default_ranks()
    names = ("ids_sha256", "decoded_sha256") if digests else ("ids", "decoded")
    kind = T.StringType() if digests else T.BinaryType()
    schema = T.StructType([field(docs, id_col, "doc_id"), T.StructField("n_tokens", T.LongType()), *(T.StructField(n, kind) for n in names)])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, cache = _loaded(path)
        target = arrow_schema(schema)
        for whole in it:
            for batch in slices(whole, 1):
                data, offsets = column_bytes(batch.column(1))
                n, a, b = [], [], []
                for i, j in runs(offsets):
                    lo = offsets[i]
                    d, o = data[lo : offsets[j]], offsets[i : j + 1] - lo
                    starts, ends, doc, _ = pretokens(d, o, _library_classes())
                    flat, size = cache.lookup(d, starts, ends)
                    per_doc = np.bincount(doc, weights=size, minlength=j - i).astype(np.int64)
                    cut = np.append(0, np.cumsum(per_doc))
                    text = bpe.decode(flat)
                    cut_text = np.append(0, np.cumsum(bpe.sizes[flat]))[cut]
                    flat = flat.astype("<u4")
                    for k in range(j - i):
                        x, y = flat[cut[k] : cut[k + 1]].tobytes(), text[cut_text[k] : cut_text[k + 1]].tobytes()
                        a.append(hashlib.sha256(x).hexdigest() if digests else x)
                        b.append(hashlib.sha256(y).hexdigest() if digests else y)
                    n += per_doc.tolist()
                yield pa.RecordBatch.from_arrays([batch.column(0).cast(target.field(0).type), pa.array(n, pa.int64()), pa.array(a, target.field(2).type), pa.array(b, target.field(3).type)], schema=target)

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)
