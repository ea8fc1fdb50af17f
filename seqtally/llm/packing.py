"""Packing token sequences into windows of a fixed length with little padding.

Bounded-space online packing.  Each partition keeps a fixed number of open windows.  A document's
full windows are cut off first; what is left goes where it fits best.  If it fits nowhere the
fullest window is emitted, topped up from the piece in hand unless only a few places are free.
At the end of a partition its open windows are left over.  They are merged over groups of
partitions, group by group, until one window is left; that one is cut at powers of two, which
need no padding.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqtally.llm.common import arrow_schema, batches, field, given_back, slices, written
from seqtally.llm.tokens import default_vocabulary, encode_column

WINDOW = 2048
OPEN_WINDOWS = 64
#: So few free places are padded rather than filled by cutting a document.
MAX_PAD = 16
#: Partitions whose leftovers are merged in one task.
FAN_IN = 32


class Packer:
    """Open windows of one partition.  A piece is (doc_id, start, ids, tokens of the document)."""

    def __init__(self, first_id: int, window: int = WINDOW, open_windows: int = OPEN_WINDOWS, max_pad: int = MAX_PAD):
        self.window, self.most, self.max_pad, self.next_id = window, open_windows, max_pad, first_id
        self.rooms: list[tuple[int, int]] = []  # (free places, sequence), in order
        self.open: dict[int, list] = {}

    def _new(self) -> int:
        self.next_id += 1
        return self.next_id - 1

    def add(self, doc_id, ids: np.ndarray) -> Iterator[tuple[int, list]]:
        """Yields the sequences that are full or emitted."""
        n, at = len(ids), 0
        while n - at >= self.window:
            yield self._new(), [(doc_id, at, ids[at : at + self.window], n)]
            at += self.window
        if at < n:
            yield from self.place((doc_id, at, ids[at:], n))

    def place(self, piece: tuple) -> Iterator[tuple[int, list]]:
        doc_id, start, ids, n = piece
        k = bisect_left(self.rooms, (len(ids), -1))
        if k == len(self.rooms) and len(self.rooms) >= self.most:
            room, seq = self.rooms.pop(0)
            pieces = self.open.pop(seq)
            if room > self.max_pad:
                pieces.append((doc_id, start, ids[:room], n))
                start, ids = start + room, ids[room:]
            yield seq, pieces
            k = bisect_left(self.rooms, (len(ids), -1))
        if k < len(self.rooms):
            room, seq = self.rooms.pop(k)
        else:
            room, seq = self.window, self._new()
            self.open[seq] = []
        self.open[seq].append((doc_id, start, ids, n))
        room -= len(ids)
        if room:
            insort(self.rooms, (room, seq))
        else:
            yield seq, self.open.pop(seq)

    def leftovers(self) -> Iterator[tuple[int, list]]:
        yield from sorted(self.open.items())
        self.open, self.rooms = {}, []


def merge(pieces: list[tuple], first_id: int, window: int, last: bool) -> Iterator[tuple[int, list, bool]]:
    """Joins pieces into full windows: (sequence, pieces, whether it is still open).

    What is left after the last full window stays open, or is cut at powers of two if ``last``.
    """
    total = sum(len(p[2]) for p in pieces)
    sizes = [window] * (total // window)
    rest = total % window
    if last:
        sizes += [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]
    elif rest:
        sizes.append(rest)
    k, used = 0, 0
    for i, size in enumerate(sizes):
        out = []
        while size:
            doc_id, start, ids, n = pieces[k]
            take = min(size, len(ids) - used)
            out.append((doc_id, start + used, ids[used : used + take], n))
            size, used = size - take, used + take
            if used == len(ids):
                k, used = k + 1, 0
        yield first_id + i, out, not last and bool(rest) and i == len(sizes) - 1


def _rows(schema: pa.Schema):
    return {name: [] for name in schema.names}


def _emit(rows: dict, seq: int, pieces: list, keep_ids: bool, is_open: bool, group: int) -> None:
    at = 0
    for doc_id, start, ids, n in pieces:
        raw = ids.astype("<u4").tobytes()
        for name, value in (("doc_id", doc_id), ("start", start), ("length", len(ids)), ("ids", raw if keep_ids or is_open else None), ("ids_crc32", zlib.crc32(raw)), ("doc_tokens", n), ("sequence_id", seq), ("offset", at), ("is_open", is_open), ("group", group)):
            rows[name].append(value)
        at += len(ids)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, end_id: int = 1, window: int = WINDOW, open_windows: int = OPEN_WINDOWS, max_pad: int = MAX_PAD, keep_ids: bool = True) -> DataFrame:
    """Pieces of documents and where they lie: doc_id, start, length, ids, ids_crc32, doc_tokens, sequence_id, offset.

    ``ids`` are little-endian unsigned 32-bit (null with keep_ids=False; the digest stays).
    A null or empty text is one piece holding the end id.  Repeated rows and equal ids are
    documents of their own.  A null id is kept.  Other columns are not read.  An empty table gives no rows.
    A lost executor repeats its partition alone; the first pass is written to the shared folder.
    """
    if window & (window - 1):
        raise ValueError("window must be a power of two")
    path = vocabulary or default_vocabulary()
    kind = field(docs, id_col, "doc_id")
    schema = T.StructType([kind, T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("ids_crc32", T.LongType()), T.StructField("doc_tokens", T.LongType()), T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType()), T.StructField("is_open", T.BooleanType()), T.StructField("group", T.LongType())])

    def first(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        target = arrow_schema(schema)
        packer, rows = Packer(part << 32, window, open_windows, max_pad), _rows(target)
        for batch in given_back(it):
            for piece in slices(batch, 1):
                ids, offsets = encode_column(piece.column(1), path, end_id)
                for k, doc_id in enumerate(piece.column(0).to_pylist()):
                    for seq, pieces in packer.add(doc_id, ids[offsets[k] : offsets[k + 1]].copy()):
                        _emit(rows, seq, pieces, keep_ids, False, part)
                yield from batches(rows, target)
        for seq, pieces in packer.leftovers():
            _emit(rows, seq, pieces, keep_ids, True, part)
        yield from batches(rows, target)

    def later(level: int, last: bool):
        def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["sequence_id", "offset"])
            ids = [np.frombuffer(x, "<u4") for x in pdf["ids"]]
            pieces = list(zip(pdf["doc_id"].tolist(), pdf["start"].tolist(), ids, pdf["doc_tokens"].tolist(), strict=True))
            target = arrow_schema(schema)
            rows = _rows(target)
            group = int(key[0])
            for seq, out, is_open in merge(pieces, (1 << 62) | (level << 56) | (group << 26), window, last):
                _emit(rows, seq, out, keep_ids, is_open, group)
            return pd.DataFrame(rows)

        return run

    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    groups = source.rdd.getNumPartitions()
    out = written(source.mapInArrow(first, schema))
    done, left, level = [out.filter("not is_open")], out.filter("is_open"), 0
    while True:
        level, groups = level + 1, -(-groups // FAN_IN)
        last = groups <= 1
        merged = left.withColumn("group", F.expr(f"group div {FAN_IN}")).groupBy("group").applyInPandas(later(level, last), schema)
        if not last:
            merged = written(merged)
        done.append(merged.filter("not is_open"))
        left = merged.filter("is_open")
        if last:
            break
    result = done[0]
    for d in done[1:]:
        result = result.unionByName(d)
    return result.drop("is_open", "group")
