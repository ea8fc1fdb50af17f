"""Removal of passages that repeat across documents: fixed-block anchors, extended to maximal exact repeats.

A repeat of ``window`` words holds a whole block of ``block`` words at a multiple of ``block`` in the
document it is compared with, if window >= 2 * block - 1.  So the non-overlapping blocks of every
document are the index, and every rolling window of ``block`` words is a probe.  Hits are extended:
around each, the windows of ``window`` words are compared by 96 bits, and the smallest
document id of each is found.  These bits come from 128-bit digests of the words' bytes, so that no pattern of
letters makes two windows agree; by chance two of 10^13 different windows do at a probability of about 0.1 %.  Words under windows that also start in a document with a smaller id go;
neighbouring windows together make up the maximal repeats.

Documents travel as chunks (some MB of text, kept once in a table bucketed by chunk), and only digests
of chunks are shuffled: for each range of hashes, the sorted distinct hashes of a chunk as
differences.  A passage that is in a third of all documents is one entry of each chunk.  Answers are
one bit for each entry.  Nothing grows with the number of pairs.
"""

from __future__ import annotations

import hashlib
import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqtally.llm.common import arrow_schema, give_back, given_back, scratch, written
from seqtally.llm.kernels import column_bytes, digests, gather, runs, sequence_hashes, words

WINDOW, BLOCK = 13, 7
CHUNK_BYTES = 4 << 20
#: Words whose hashes are compared in one task.
PART_WORDS = 1_500_000
_BLOBS = "part long, chunk long, n long, payload binary"
_LAST = np.iinfo(np.int64).max


# --- chunks ---------------------------------------------------------------------------------


def _chunk_rows(text_index: int, schema: pa.Schema):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, held, size = TaskContext.get().partitionId(), 0, [], 0
        zstd = zstandard.ZstdCompressor(level=3)

        def flush() -> pa.RecordBatch:
            nonlocal seq, held, size
            rows = pa.Table.from_batches(held).combine_chunks()
            data, offsets = column_bytes(rows.column(text_index))
            sink = io.BytesIO()
            with pa.ipc.new_stream(sink, rows.schema) as w:
                w.write_table(rows)
            n = sum(len(words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])[0]) for i, j in runs(offsets))
            out = pa.RecordBatch.from_arrays([pa.array([part << 24 | seq]), pa.array([n]), pa.array([zstd.compress(sink.getvalue())])], names=["chunk", "n_words", "payload"])
            seq, held, size = seq + 1, [], 0
            return out

        for batch in given_back(it):
            batch = pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(batch.columns, schema, strict=True)], schema=schema)
            data, offsets = column_bytes(batch.column(text_index))
            for i, j in runs(offsets, CHUNK_BYTES // 4):
                held.append(batch.slice(i, j - i))
                size += int(offsets[j] - offsets[i])
                if size >= CHUNK_BYTES:
                    yield flush()
        if held:
            yield flush()

    return run


def _open(payload: bytes) -> pa.Table:
    with pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(payload)) as r:
        return r.read_all()


class _Words:
    """The words of a chunk: two hash lanes, the document of each and its place there."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lanes: int):
        starts, ends, doc, lane = [], [], [], [[] for _ in range(lanes)]
        for i, j in runs(offsets):
            lo = offsets[i]
            d = data[lo : offsets[j]]
            s, e, k = words(d, offsets[i : j + 1] - lo)
            for n, x in enumerate(digests(d, s, e, lanes)):
                lane[n].append(x)
            starts.append(s + lo)
            ends.append(e + lo)
            doc.append((k + i).astype(np.int32))
        cat = lambda x, t: np.concatenate(x) if x else np.empty(0, t)
        self.starts, self.ends, self.doc = cat(starts, np.int64), cat(ends, np.int64), cat(doc, np.int32)
        self.lane = [cat(x, np.uint64) for x in lane]
        self.n_docs = len(offsets) - 1
        self.count = np.bincount(self.doc, minlength=self.n_docs)
        first = np.cumsum(self.count) - self.count
        self.place = np.arange(len(self.doc)) - first[self.doc]

    def fits(self, k: int) -> np.ndarray:
        """Places at which k words of one document begin."""
        n = len(self.doc) - k + 1
        return np.flatnonzero(self.doc[:n] == self.doc[k - 1 :]) if n > 0 else np.empty(0, np.int64)


def _planes(x: np.ndarray) -> bytes:
    """Integers byte by byte, most significant first: differences leave zeros that compress away."""
    return np.ascontiguousarray(x.astype(x.dtype.newbyteorder(">")).view(np.uint8).reshape(-1, x.dtype.itemsize).T).tobytes()


def _unplanes(raw: bytes, n: int, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, n).T).view(np.dtype(kind).newbyteorder(">")).ravel().astype(kind)


def _deltas(x: np.ndarray) -> np.ndarray:
    d = x.copy()
    d[1:] -= x[:-1]
    return d


# --- anchors --------------------------------------------------------------------------------


class _Anchors:
    """The distinct rolling blocks of a chunk, in order of (range of hashes, hash)."""

    def __init__(self, w: _Words, parts: int, window: int, block: int):
        at = w.fits(block)
        at = at[w.count[w.doc[at]] >= window]
        h = sequence_hashes(w.lane[0], block)[at] if len(at) else np.empty(0, np.uint64)
        key = ((h >> np.uint64(40)) % np.uint64(parts)) << np.uint64(32) | (h & np.uint64(0xFFFFFFFF))
        order = np.argsort(key, kind="stable")
        key, self.at = key[order], at[order]
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        self.first = np.flatnonzero(new)
        self.group = np.cumsum(new) - 1
        self.key = key[self.first]
        self.bounds = np.searchsorted(self.key >> np.uint64(32), np.arange(parts + 1, dtype=np.uint64))
        self.w, self.block = w, block

    def flags(self) -> tuple[np.ndarray, np.ndarray]:
        """(whether a document has it at a multiple of the block length, whether two documents here have it)."""
        if not len(self.first):
            return np.empty(0, bool), np.empty(0, bool)
        doc = self.w.doc[self.at]
        last = np.append(self.first[1:], len(doc)) - 1
        aligned = np.maximum.reduceat((self.w.place[self.at] % self.block == 0).view(np.uint8), self.first).astype(bool)
        return aligned, doc[self.first] != doc[last]

    def candidates(self, shared: np.ndarray, window: int) -> np.ndarray:
        """Places of windows with a hit in them."""
        n = len(self.w.doc)
        hit = np.zeros(n + 1, np.int64)
        hit[self.at[shared[self.group]] + 1] = 1
        np.cumsum(hit, out=hit)
        at = self.w.fits(window)
        return at[hit[at + window - self.block + 1] > hit[at]] if len(at) else at


class _Windows:
    """The distinct candidate windows of a chunk, by range and 96-bit hash, with the smallest document id."""

    def __init__(self, w: _Words, ids: np.ndarray, at: np.ndarray, parts: int, window: int):
        a, b = sequence_hashes(w.lane[0], window, at), sequence_hashes(w.lane[1], window, at) >> np.uint64(32)
        part = ((a >> np.uint64(40)) % np.uint64(parts)).astype(np.int64)
        order = np.lexsort((b, a, part))
        self.at, a, b, part = at[order], a[order], b[order], part[order]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        self.first = np.flatnonzero(new)
        self.group = np.cumsum(new) - 1
        self.id = ids[w.doc[self.at]]
        self.least = np.minimum.reduceat(self.id, self.first) if len(self.first) else np.empty(0, np.int64)
        self.a, self.b = a[self.first], b[self.first].astype(np.uint32)
        self.bounds = np.searchsorted(part[self.first], np.arange(parts + 1))


def _ids(table: pa.Table, index: int) -> np.ndarray:
    """Document ids; a null counts as greater than any id."""
    return table.column(index).cast(pa.int64()).fill_null(_LAST).to_numpy()


def _bits(rows: pd.DataFrame, bounds: np.ndarray) -> np.ndarray:
    out = np.zeros(bounds[-1], bool)
    for part, payload in zip(rows["part"].tolist(), rows["payload"].tolist(), strict=True):
        n = bounds[part + 1] - bounds[part]
        out[bounds[part] : bounds[part + 1]] = np.unpackbits(np.frombuffer(zstandard.ZstdDecompressor().decompress(payload), np.uint8), count=n).view(bool)
    return out


def _answers(pdf: pd.DataFrame, counts: list[int], yes: np.ndarray) -> pd.DataFrame:
    zstd, rows, i = zstandard.ZstdCompressor(level=1), [], 0
    for part, chunk, n in zip(pdf["part"].tolist(), pdf["chunk"].tolist(), counts, strict=True):
        own = yes[i : i + n]
        if own.any():
            rows.append((part, chunk, n, zstd.compress(np.packbits(own).tobytes())))
        i += n
    return pd.DataFrame(rows, columns=["part", "chunk", "n", "payload"])


def _shared_blocks(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of one range of hashes: bits of those that stand in two documents and are an indexed block of one."""
    give_back()
    zstd, keys, flags, counts = zstandard.ZstdDecompressor(), [], [], pdf["n"].tolist()
    for n, payload in zip(counts, pdf["payload"].tolist(), strict=True):
        raw = zstd.decompress(payload)
        keys.append(np.cumsum(_unplanes(raw[: 4 * n], n, "u4"), dtype=np.uint32))
        m = (n + 7) // 8
        flags.append(np.unpackbits(np.frombuffer(raw[4 * n : 4 * n + m], np.uint8), count=n) | np.unpackbits(np.frombuffer(raw[4 * n + m :], np.uint8), count=n) << 1)
    key, flag = np.concatenate(keys), np.concatenate(flags)
    order = np.argsort(key, kind="stable")
    s = key[order]
    new = np.ones(len(s), bool)
    new[1:] = s[1:] != s[:-1]
    first = np.flatnonzero(new)
    any_flag = np.bitwise_or.reduceat(flag[order], first) if len(first) else flag
    size = np.diff(np.append(first, len(s)))
    good = (any_flag & 1).astype(bool) & ((size > 1) | (any_flag & 2).astype(bool))
    yes = np.empty(len(key), bool)
    yes[order] = good[np.cumsum(new) - 1]
    return _answers(pdf, counts, yes)


def _smaller_elsewhere(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of one range of hashes: bits of a chunk's windows that also start in a smaller document of another chunk."""
    give_back()
    zstd, a, b, least, counts = zstandard.ZstdDecompressor(), [], [], [], pdf["n"].tolist()
    for n, payload in zip(counts, pdf["payload"].tolist(), strict=True):
        raw = zstd.decompress(payload)
        a.append(np.cumsum(_unplanes(raw[: 8 * n], n, "u8"), dtype=np.uint64))
        b.append(_unplanes(raw[8 * n : 12 * n], n, "u4"))
        least.append(_unplanes(raw[12 * n :], n, "i8"))
    a, b, least = np.concatenate(a), np.concatenate(b), np.concatenate(least)
    order = np.lexsort((b, a))
    x, y = a[order], b[order]
    new = np.ones(len(x), bool)
    new[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
    first = np.flatnonzero(new)
    best = np.minimum.reduceat(least[order], first)[np.cumsum(new) - 1] if len(first) else least
    yes = np.empty(len(a), bool)
    yes[order] = best < least[order]
    return _answers(pdf, counts, yes)


# --- the operator ---------------------------------------------------------------------------


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, block: int = BLOCK, chunk_bytes: int = CHUNK_BYTES, digest: bool = False) -> DataFrame:
    """All columns of docs, with n_words, n_removed and kept_text (or kept_sha256 with digest=True) after them.

    Words are runs of bytes other than 0x20 and 0x09-0x0D.  A word goes if a window over it also starts in
    a document with a smaller id; windows are judged on the input.  kept_text is the kept words joined by one
    space.  A null text has no words and keeps an empty text.  Ids are integers; a null id counts as greater
    than any other.  Rows with equal ids leave each other alone.  Columns of docs named like the new ones are
    dropped.  An empty table gives no rows.
    """
    if window < 2 * block - 1:
        raise ValueError("a window must hold a whole block wherever it starts")
    spark = docs.sparkSession
    new = [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256" if digest else "kept_text", T.StringType())]
    docs = docs.drop(*(f.name for f in new))
    schema = arrow_schema(docs.schema)
    id_at, text_at = docs.columns.index(id_col), docs.columns.index(text_col)

    name = f"seqtally_chunks_{scratch(spark).rsplit('-', 1)[1]}"
    made = docs.mapInArrow(_chunk_rows(text_at, schema), "chunk long, n_words long, payload binary")
    buckets = max(8, 2 * docs.rdd.getNumPartitions())
    made.write.bucketBy(buckets, "chunk").option("path", scratch(spark)).option("compression", "none").option("parquet.block.size", 32 << 20).saveAsTable(name)
    chunks = spark.table(name)
    total = chunks.agg(F.sum("n_words")).first()[0] or 0
    parts = max(8, int(total // PART_WORDS))

    def opened(payload: bytes, lanes: int) -> tuple[pa.Table, _Words]:
        rows = _open(payload)
        return rows, _Words(*column_bytes(rows.column(text_at)), lanes)

    def probe(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zstd = zstandard.ZstdCompressor(level=1)
        target = pa.schema([("part", pa.int64()), ("chunk", pa.int64()), ("n", pa.int64()), ("payload", pa.binary())])
        for batch in given_back(it):
            for chunk, payload in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                anchors = _Anchors(opened(payload.as_py(), 1)[1], parts, window, block)
                aligned, several = anchors.flags()
                out = []
                for p in np.flatnonzero(np.diff(anchors.bounds)).tolist():
                    i, j = anchors.bounds[p], anchors.bounds[p + 1]
                    raw = _planes(_deltas((anchors.key[i:j] & np.uint64(0xFFFFFFFF)).astype(np.uint32))) + np.packbits(aligned[i:j]).tobytes() + np.packbits(several[i:j]).tobytes()
                    out.append((p, chunk, int(j - i), zstd.compress(raw)))
                del anchors, aligned, several  # before the next chunk's are made
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), target, strict=True)], schema=target)
                out = []
                give_back()

    def extend(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        give_back()
        zstd, out = zstandard.ZstdCompressor(level=1), []
        for chunk, payload in zip(left["chunk"].tolist(), left["payload"].tolist(), strict=True):
            rows, w = opened(payload, 2)
            anchors = _Anchors(w, parts, window, block)
            found = _Windows(w, _ids(rows, id_at), anchors.candidates(_bits(right, anchors.bounds), window), parts, window)
            for p in np.flatnonzero(np.diff(found.bounds)).tolist():
                i, j = found.bounds[p], found.bounds[p + 1]
                raw = _planes(_deltas(found.a[i:j])) + _planes(found.b[i:j]) + _planes(found.least[i:j])
                out.append((p, chunk, int(j - i), zstd.compress(raw)))
        return pd.DataFrame(out, columns=["part", "chunk", "n", "payload"])

    out_schema = T.StructType([*docs.schema.fields, *new])

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        give_back()
        target = arrow_schema(out_schema)
        right = right.to_pandas()
        out = []
        for payload in left.column("payload"):
            rows, w = opened(payload.as_py(), 2)
            ids = _ids(rows, id_at)
            anchors = _Anchors(w, parts, window, block)
            found = _Windows(w, ids, anchors.candidates(_bits(right[right["step"] == 1], anchors.bounds), window), parts, window)
            elsewhere = _bits(right[right["step"] == 2], found.bounds)
            gone = found.at[elsewhere[found.group] | (found.id > found.least[found.group])] if len(found.at) else found.at
            cover = np.zeros(len(w.doc) + window + 1, np.int32)
            np.add.at(cover, gone, 1)
            np.add.at(cover, gone + window, -1)
            kept = np.cumsum(cover)[: len(w.doc)] == 0
            data = np.append(column_bytes(rows.column(text_at))[0], np.uint8(0x20))
            size = w.ends[kept] - w.starts[kept] + 1
            text = gather(data, w.starts[kept], size)
            text[np.cumsum(size) - 1] = 0x20
            per_doc = np.append(0, np.cumsum(np.bincount(w.doc[kept], weights=size, minlength=w.n_docs).astype(np.int64)))
            text = text.tobytes()
            texts = [text[a : max(a, b - 1)] for a, b in zip(per_doc[:-1].tolist(), per_doc[1:].tolist(), strict=True)]
            last = pa.array([hashlib.sha256(t).hexdigest() for t in texts]) if digest else pa.array(texts, pa.binary()).cast(pa.string())
            removed = np.bincount(w.doc[~kept], minlength=w.n_docs)
            out.append(pa.Table.from_arrays([*rows.columns, pa.array(w.count.astype(np.int64)), pa.array(removed.astype(np.int64)), last], names=target.names).cast(target))
        return pa.concat_tables(out) if out else target.empty_table()

    by_chunk = chunks.select("chunk", "payload")
    shared = written(by_chunk.mapInArrow(probe, _BLOBS).groupBy("part").applyInPandas(_shared_blocks, _BLOBS))
    grown = by_chunk.groupBy("chunk").cogroup(shared.groupBy("chunk")).applyInPandas(extend, _BLOBS)
    smaller = written(grown.groupBy("part").applyInPandas(_smaller_elsewhere, _BLOBS))
    answers = shared.withColumn("step", F.lit(1)).unionByName(smaller.withColumn("step", F.lit(2)))
    result = by_chunk.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(cut, out_schema)
    spark.sql(f"drop table {name}")  # the name alone: its files are in the shared folder, and plans made above read those
    return result
