"""Token files: independent zstandard frames with a trailing seek table.

A file holds the ids of some documents in order, as one stream of little-endian unsigned integers.
The stream is cut into frames of a bounded number of ids, each with its content checksum.  After
the frames come two skippable frames, as the seekable format of zstandard lays them down: one with
the documents' ids and lengths (an Arrow stream), then the seek table with the compressed and plain
size and a checksum of each frame.  A reader takes the tail of the file and then only those frames
that a document lies in.
"""

from __future__ import annotations

import io
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqtally.llm.common import arrow_schema, batches, field, scratch, slices
from seqtally.llm.tokens import default_vocabulary, encode_column

#: Fixed values of the zstandard seekable format.
SKIPPABLE_INDEX, SKIPPABLE_SEEK, SEEKABLE_MAGIC = 0x184D2A5D, 0x184D2A5E, 0x8F92EAB1
FRAME_IDS = 1 << 16


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


class Writer:
    def __init__(self, out, width: int, frame_ids: int = FRAME_IDS, level: int = 3):
        self.out, self.width, self.frame_ids = out, width, frame_ids
        self.zstd = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True)
        self.held: list[np.ndarray] = []
        self.n_held = 0
        self.frames: list[tuple[int, int, int]] = []
        self.docs: list = []
        self.sizes: list[int] = []

    def add(self, doc_ids: list, ids: np.ndarray, sizes: np.ndarray) -> None:
        self.docs += doc_ids
        self.sizes += sizes.tolist()
        self.held.append(ids.astype(f"<u{self.width}"))
        self.n_held += len(ids)
        if self.n_held >= self.frame_ids:
            self._flush(False)

    def _flush(self, everything: bool) -> None:
        ids = np.concatenate(self.held) if self.held else np.empty(0, f"<u{self.width}")
        stop = len(ids) if everything else len(ids) // self.frame_ids * self.frame_ids
        for i in range(0, stop, self.frame_ids):
            raw = ids[i : min(stop, i + self.frame_ids)].tobytes()
            packed = self.zstd.compress(raw)
            self.out.write(packed)
            self.frames.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.held, self.n_held = [ids[stop:]], len(ids) - stop

    def close(self, id_type: pa.DataType) -> None:
        self._flush(True)
        sink = io.BytesIO()
        index = pa.table({"doc_id": pa.array(self.docs, id_type), "n_tokens": pa.array(self.sizes, pa.int64())})
        with pa.ipc.new_stream(sink, index.schema.with_metadata({"width": str(self.width), "frame_ids": str(self.frame_ids)})) as w:
            w.write_table(index)
        body = self.zstd.compress(sink.getvalue())
        self.out.write(struct.pack("<II", SKIPPABLE_INDEX, len(body)) + body)
        table = b"".join(struct.pack("<III", *f) for f in self.frames)
        self.out.write(struct.pack("<II", SKIPPABLE_SEEK, len(table) + 9) + table + struct.pack("<IBI", len(self.frames), 0x80, SEEKABLE_MAGIC))


class Reader:
    """Reads documents out of a token file; ``frames_read`` counts what was decompressed."""

    def __init__(self, f, size: int):
        self.f, self.frames_read = f, 0
        f.seek(size - 9)
        n, flags, magic = struct.unpack("<IBI", f.read(9))
        if magic != SEEKABLE_MAGIC or not flags & 0x80:
            raise ValueError("not a token file")
        start = size - 17 - 12 * n
        f.seek(start)
        kind, length = struct.unpack("<II", f.read(8))
        if kind != SKIPPABLE_SEEK or length != 12 * n + 9:
            raise ValueError("damaged seek table")
        self.table = np.frombuffer(f.read(12 * n), "<u4").reshape(n, 3).astype(np.int64)
        self.at = np.append(0, np.cumsum(self.table[:, 0]))
        f.seek(int(self.at[-1]))
        kind, length = struct.unpack("<II", f.read(8))
        if kind != SKIPPABLE_INDEX:
            raise ValueError("damaged document index")
        with pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(f.read(length))) as r:
            index = r.read_all()
            meta = r.schema.metadata
        self.width, self.frame_ids = int(meta[b"width"]), int(meta[b"frame_ids"])
        self.docs = index.column("doc_id")
        self.sizes = index.column("n_tokens").to_numpy()
        self.starts = np.cumsum(self.sizes) - self.sizes
        self._kept: tuple[int, np.ndarray] = (-1, np.empty(0))

    def frame(self, k: int) -> np.ndarray:
        if self._kept[0] != k:
            self.f.seek(int(self.at[k]))
            raw = zstandard.ZstdDecompressor().decompress(self.f.read(int(self.table[k, 0])))
            if len(raw) != self.table[k, 1] or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.table[k, 2]:
                raise ValueError(f"frame {k} is damaged")
            self.frames_read += 1
            self._kept = k, np.frombuffer(raw, f"<u{self.width}")
        return self._kept[1]

    def document(self, i: int) -> np.ndarray:
        a, b = int(self.starts[i]), int(self.starts[i] + self.sizes[i])
        parts = [self.frame(k)[max(0, a - k * self.frame_ids) : b - k * self.frame_ids] for k in range(a // self.frame_ids, -(-b // self.frame_ids))]
        return np.concatenate(parts).astype(np.uint32) if parts else np.empty(0, np.uint32)


def write_tokens(docs: DataFrame, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, end_id: int = 2, width: int = 2, files: int | None = None) -> list[dict]:
    """Writes the ids of all texts, each with ``end_id`` after it, in ascending id order.

    Returns the manifest, in order: file, path, documents, tokens and the number of ids before it;
    it has a row for each file.  A null text is empty; rows with equal ids stand together; null ids
    come first.  Each attempt of a task writes a file of its own name, and the manifest holds those of the
    attempts that counted, so a repeated task does no harm; what a lost attempt left is never read.
    Other columns are not read.  An empty table gives files without documents.
    """
    spark = docs.sparkSession
    folder = folder or scratch(spark)
    path = vocabulary or default_vocabulary()
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    n = files or max(1, source.rdd.getNumPartitions())
    schema = T.StructType([T.StructField("file", T.LongType()), T.StructField("path", T.StringType()), T.StructField("documents", T.LongType()), T.StructField("tokens", T.LongType())])
    id_type = arrow_schema(T.StructType([field(source, "doc_id")])).field(0).type

    def write(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        part = task.partitionId()
        fs, base = file_system(folder)
        fs.create_dir(base, recursive=True)
        name = f"tokens-{part:06d}-{task.taskAttemptId()}.zst"
        n_docs = n_tokens = 0
        with fs.open_output_stream(f"{base}/{name}", compression=None) as out:
            w = Writer(out, width)
            for batch in it:
                for piece in slices(batch, 1):
                    ids, offsets = encode_column(piece.column(1), path, end_id)
                    if width < 4 and len(ids) and int(ids.max()) >> (8 * width):
                        raise ValueError(f"an id doesn't fit {width} bytes")
                    w.add(piece.column(0).to_pylist(), ids, np.diff(offsets))
                    n_docs, n_tokens = n_docs + piece.num_rows, n_tokens + len(ids)
            w.close(id_type)
        yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([f"{folder}/{name}"]), pa.array([n_docs]), pa.array([n_tokens])], schema=arrow_schema(schema))

    rows = source.repartitionByRange(n, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first()).mapInArrow(write, schema).collect()
    out, start = [], 0
    for r in sorted(rows, key=lambda r: r["file"]):
        out.append(r.asDict() | {"start": start})
        start += r["tokens"]
    return out


def read_tokens(spark, manifest: list[dict], id_type: T.DataType = T.LongType()) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids of every document in the files; no rows if there is none."""
    files = spark.createDataFrame([(m["path"], m["start"]) for m in manifest if m["documents"]], "path string, base long").repartition(max(1, len(manifest)))
    schema = T.StructType([T.StructField("doc_id", id_type), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())])

    def read(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target = arrow_schema(schema)
        for batch in it:
            for row in batch.to_pylist():
                fs, name = file_system(row["path"])
                with fs.open_input_file(name) as f:
                    r = Reader(f, f.size())
                    docs = r.docs.to_pylist()
                    for i in range(0, len(docs), 256):
                        k = range(i, min(len(docs), i + 256))
                        yield from batches({"doc_id": docs[i : i + 256], "start": [row["base"] + int(r.starts[j]) for j in k], "n_tokens": [int(r.sizes[j]) for j in k], "ids": [r.document(j).astype("<u4").tobytes() for j in k]}, target)

    return files.mapInArrow(read, schema)
