"""FASTQ files as DataFrames: whole, in byte ranges, in pairs, or as streams.

``format("fastq")`` is a Python data source.  Without an index a file is one task, since a record can span lines and
``@`` may begin a line of qualities, so that no place in a file is safe to split at.  ``index_fastq`` makes an index: each run of byte ranges of a plain
file, or range of a block-gzipped one, is read once from where its first record seems to begin, which tells where its last one ends; a guess
counts only if the run before ends there, and runs with a wrong one are read again from the right place.  Sums over ranges
number the records.  With the index runs of ranges are tasks, and no text is shuffled.  ``format("fastq_pairs")`` reads both files of a pair
in step.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from seqtally.scratch import scratch
from seqtally.sources.records import BLOCK, Records, file_infos, file_system, likely_start, open_plain, open_range, parse, text_from

__all__ = ["index_fastq", "pair", "parse", "read_fastq", "read_fastq_pairs", "read_fastq_ranges", "read_fastq_strict", "stream_fastq", "with_read_id", "write_fastq"]

#: Bits of a read's number within its file.
RECORD_BITS = 40
#: Bytes of a range.
SPLIT = 64 << 20
#: Bytes of a task of several ranges, at most, and how many tasks there are at least where there are as many ranges.
RUN, TASKS = 32 << 20, 64
UNEQUAL = "different number of reads in paired FASTQ files"


def list_files(path: str) -> list[str]:
    """The files that a path stands for, in order."""
    return [p for p, _, _ in file_infos(path)]


class Piece(InputPartition):
    """Records of one file: those that begin in a range of it from byte ``start`` of the range's text on; ``record`` and ``line`` are the numbers of the first one."""

    def __init__(self, path: str, file_no: int, begin: int = 0, end: int | None = None, start: int = 0, n: int | None = None, record: int = 0, line: int = 0):
        super().__init__(path)
        self.path, self.file_no, self.begin, self.end, self.start, self.n, self.record, self.line = path, file_no, begin, end, start, n, record, line

    def records(self, strip_cr: bool, on: bool = False, texts: bool = True) -> Records:
        """``on``: past the end of the range, to that of the file."""
        if on or self.end is None:
            return Records(text_from(self.path, self.begin, self.start), strip_cr, None, self.line, texts)
        plain = open_plain(self.path, self.begin + self.start)
        if plain is not None:
            return Records(plain, strip_cr, self.end - self.begin - self.start, self.line, texts)
        data, rest = open_range(self.path, self.begin, self.end)
        if data is None:
            return Records(rest, strip_cr, None, self.line, texts)

        def blocks() -> Iterator[bytes]:
            yield data[self.start :]
            yield from rest

        return Records(blocks(), strip_cr, max(0, len(data) - self.start), self.line, texts)


class Run(InputPartition):
    """Ranges of one file, one after another, as one task; ``marks`` has (begin, end, start, record, line) of each, -1 for the end of the file."""

    def __init__(self, path: str, file_no: int, marks: np.ndarray):
        super().__init__(path)
        self.path, self.file_no, self.marks = path, file_no, marks
        self.record = int(marks[0, 3])

    def piece(self, k: int, last: int | None = None) -> Piece:
        begin, _, start, record, line = self.marks[k].tolist()
        end = int(self.marks[k if last is None else last, 1])
        return Piece(self.path, self.file_no, begin, None if end < 0 else end, start, record=record, line=line)

    def records(self, strip_cr: bool) -> Iterator[tuple[pa.Array, pa.Array]]:
        if len(self.marks) == 1 or open_plain(self.path, 0) is not None:
            yield from self.piece(0, -1).records(strip_cr)
        else:
            for k in range(len(self.marks)):
                yield from self.piece(k).records(strip_cr)


def per_run(ranges: int, size: int) -> int:
    """Ranges of ``size`` bytes that make a task."""
    return max(1, min(RUN // max(1, size), -(-ranges // TASKS)))


def _files(options: dict, path: str, index: str) -> list[Run]:
    """All ranges of each file of an index, or the files of a path."""
    if options.get(index):
        fs, name = file_system(options[index])
        rows = pq.read_table(name, filesystem=fs).sort_by([("file_no", "ascending"), ("begin", "ascending")])
        marks = np.stack([rows[c].fill_null(-1).to_numpy() for c in ("begin", "end", "start", "record", "line")], 1)
        no = rows["file_no"].to_numpy()
        cuts = [*np.flatnonzero(np.append(True, no[1:] != no[:-1])).tolist(), len(no)] if len(no) else []
        return [Run(rows["path"][a].as_py(), int(no[a]), marks[a:b]) for a, b in zip(cuts, cuts[1:])]
    if not options.get(path):
        raise ValueError("a path is needed")
    found = [Run(p, i, np.array([[0, -1, 0, 0, 0]])) for i, p in enumerate(list_files(options[path]))]
    if not found:
        raise ValueError(f"no such file: {options[path]}")
    return found


def _runs(files: list[Run]) -> Iterator[list[Run]]:
    """The tasks of each file."""
    size = max((int((f.marks[:, 1] - f.marks[:, 0]).max()) for f in files), default=0)
    step = per_run(sum(len(f.marks) for f in files), size) if size > 0 else 1
    for f in files:
        yield [Run(f.path, f.file_no, f.marks[i : i + step]) for i in range(0, len(f.marks), step)]


def _strip_cr(options: dict) -> bool:
    return str(options.get("strip_cr", "false")).lower() == "true"


def _rows(piece: Piece | Run, names: list[str], strip_cr: bool) -> Iterator[pa.RecordBatch]:
    first = piece.record
    for name, seq in piece.records(strip_cr):
        n = len(seq)
        make = {"file": lambda: pa.repeat(piece.path, n), "file_no": lambda: pa.repeat(pa.scalar(piece.file_no, pa.int32()), n), "record_no": lambda: pa.array(np.arange(first, first + n)), "name": lambda: name, "seq": lambda: seq}  # noqa: B023  used at once
        yield pa.RecordBatch.from_arrays([make[c]() for c in names], names=names)
        first += n


class FastqReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.names, self.strip_cr = schema.fieldNames(), _strip_cr(options)
        self.pieces = [r for runs in _runs(_files(options, "path", "index")) for r in runs]

    def partitions(self) -> list[InputPartition]:
        return self.pieces

    def read(self, partition: Run) -> Iterator[pa.RecordBatch]:
        return _rows(partition, self.names, self.strip_cr)


class FastqStreamReader(DataSourceStreamReader):
    """Files of a folder as they come: an offset is the time and name of the last file read, and the number of files up to it.

    Files appear whole (written elsewhere and moved), with a time of change not before that of files already read, and stay while the stream runs.
    """

    def __init__(self, schema: StructType, options: dict):
        self.names, self.strip_cr, self.path = schema.fieldNames(), _strip_cr(options), options.get("path")
        if not self.path:
            raise ValueError("a path is needed")

    def _files(self) -> list[tuple[int, str]]:
        return sorted((t, p) for p, _, t in file_infos(self.path))

    def initialOffset(self) -> dict:  # noqa: N802  names of the interface
        return {"time": -1, "file": "", "files": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        files = self._files()
        return {"time": files[-1][0], "file": files[-1][1], "files": len(files)} if files else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        lo, hi = (start["time"], start["file"]), (end["time"], end["file"])
        return [Piece(p, start["files"] + i) for i, (_, p) in enumerate(f for f in self._files() if lo < f <= hi)]

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        return _rows(partition, self.names, self.strip_cr)

    def commit(self, end: dict) -> None:
        """Files stay where they are."""


class FastqSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fastq"

    def schema(self) -> str:
        return "file string, file_no int, record_no long, name string, seq string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return FastqReader(schema, self.options)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:  # noqa: N802
        return FastqStreamReader(schema, self.options)


class PairedPiece(InputPartition):
    """Records of a run of one file, and those at the same places of the other file, ``skip`` records into a piece of it."""

    def __init__(self, one: Run, two: Piece, skip: int, last: bool):
        super().__init__((one.path, two.path))
        self.one, self.two, self.skip, self.last = one, two, skip, last


class FastqPairsReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.names, self.strip_cr = schema.fieldNames(), _strip_cr(options)
        one, two = (_files(options, f"path{k}", f"index{k}") for k in (1, 2))
        if len(one) != len(two):
            raise ValueError(f"different number of paired FASTQ files ({len(one)} and {len(two)})")
        self.pieces = [p for runs, other in zip(_runs(one), two, strict=True) for p in self._matched(runs, other)]

    @staticmethod
    def _matched(runs: list[Run], two: Run) -> Iterator[PairedPiece]:
        for i, run in enumerate(runs):
            k = int(np.searchsorted(two.marks[:, 3], run.record, "right")) - 1
            yield PairedPiece(run, two.piece(k), run.record - int(two.marks[k, 3]), i + 1 == len(runs))

    def partitions(self) -> list[InputPartition]:
        return self.pieces

    def read(self, partition: PairedPiece) -> Iterator[pa.RecordBatch]:
        one, two = partition.one, partition.two
        mates, held, skip = iter(two.records(self.strip_cr, on=True)), None, partition.skip
        first = (one.file_no << RECORD_BITS) + one.record

        def mate() -> tuple[pa.Array, pa.Array] | None:
            nonlocal held, skip
            while held is None or not len(held[0]):
                held = next(mates, None)
                if held is None:
                    return None
                step = min(skip, len(held[0]))
                held, skip = tuple(x.slice(step) for x in held), skip - step
            return held

        def unequal(at: int, shorter: Piece) -> ValueError:
            return ValueError(f"{UNEQUAL}: {shorter.path} ends before read {at + 1} of its mate")

        at = one.record
        for name, seq in one.records(self.strip_cr):
            done = 0
            while done < len(seq):
                if mate() is None:
                    raise unequal(at, two)
                n = min(len(seq) - done, len(held[0]))
                make = {
                    "read_id": lambda: pa.array(np.arange(first, first + n)),  # noqa: B023  used at once
                    "name1": lambda: name.slice(done, n),  # noqa: B023
                    "seq1": lambda: seq.slice(done, n),  # noqa: B023
                    "name2": lambda: held[0].slice(0, n),  # noqa: B023
                    "seq2": lambda: held[1].slice(0, n),  # noqa: B023
                }
                yield pa.RecordBatch.from_arrays([make[c]() for c in self.names], names=self.names)
                held = tuple(x.slice(n) for x in held)
                done, first, at = done + n, first + n, at + n
        if partition.last and mate() is not None:
            raise unequal(at, one)


class FastqPairsSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fastq_pairs"

    def schema(self) -> str:
        return "read_id long, name1 string, seq1 string, name2 string, seq2 string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return FastqPairsReader(schema, self.options)


def read_fastq(spark: SparkSession, path: str, names: bool = True, partitions: int | None = None, **options) -> DataFrame:
    """file, file_no (its place among the files), record_no, name and seq; names=False leaves the name out of what is made into rows.

    A file is one task, unless ``index`` names an index of the files; ``partitions`` deals its reads out afterwards.
    """
    spark.dataSource.register(FastqSource)
    reader = spark.read.format("fastq").options(**{k: str(v) for k, v in options.items()})
    if not names:
        reader = reader.schema("file string, file_no int, record_no long, seq string")
    df = reader.load(path)
    return df.repartition(partitions) if partitions else df


def stream_fastq(spark: SparkSession, path: str, **options) -> DataFrame:
    """The columns of read_fastq as a stream of the files that come to a folder."""
    spark.dataSource.register(FastqSource)
    return spark.readStream.format("fastq").options(**{k: str(v) for k, v in options.items()}).load(path)


def index_fastq(spark: SparkSession, path: str, split: int = SPLIT, strip_cr: bool = False, to: str | None = None) -> str:
    """Writes the index of a path's files and returns where: one row for each range of ``split`` bytes in which a record begins.

    Files are read once, in runs of ranges (block-gzipped ones in ranges); one whose first record was looked for in the wrong place once more.  What can't be
    parsed is no error here, but to who reads that range.  The driver holds a row of numbers for each range.
    """
    infos = file_infos(path)
    if not infos:
        raise ValueError(f"no such file: {path}")
    sizes = [size for _, size, _ in infos]
    step = split * per_run(sum(-(-size // split) for size in sizes), split)
    runs = []
    for n, (p, size, _) in enumerate(infos):
        own = split if open_plain(p, 0) is None else step
        runs += [(n, p, at, min(at + own, size) if at + own < size else None) for at in range(0, max(size, 1), own)]

    def plain(file: str, begin: int, size: int, start: int, whole: bool) -> tuple:
        """What a run of a plain file has from its first record on; whole: to the end of the file."""
        records = Records(open_plain(file, begin + start, min(BLOCK, max(split, 1 << 16))), strip_cr, None, texts=False)
        marks = []
        for lo in range(0, max(size, 1), split):
            hi, at = min(lo + split, size), start + records.at
            if at >= hi and (begin or lo):  # one record goes on over the whole range
                continue
            n, line = records.n, records.line
            records.limit = None if whole and hi == size else hi - start
            try:
                for _ in records:
                    pass
            except ValueError:
                return start, size, None, 0, 0, np.array([*marks, (lo, at - lo, 0, n, line)])
            marks.append((lo, at - lo, records.n - n, n, line))
        return start, size, 0 if whole else max(0, records.at - size + start), records.n, records.line, np.array(marks, np.int64).reshape(-1, 5)

    def scanned(wanted: list[tuple]) -> list:
        """Of each (file_no, path, begin, end, start): (place in wanted, start, bytes of text, bytes past them, records, lines, marks).

        marks: (begin in the run, start, records, records and lines of the run before) of each range in which a record begins.
        """

        def scan(row: tuple[int, tuple]) -> tuple:
            k, (n, file, begin, end, start) = row
            if open_plain(file, 0) is not None:
                size = (sizes[n] if end is None else end) - begin
                if start is None and begin:
                    blocks = open_plain(file, begin, max(1, min(BLOCK, size)))
                    start = likely_start(next(blocks, b""), blocks, strip_cr)
                    if start is None:
                        return k, None, size, 0, 0, 0, None
                return k, *plain(file, begin, size, start or 0, end is None)
            data, rest = open_range(file, begin, end)
            if data is not None and start is None:
                start = 0 if not begin else likely_start(data, rest, strip_cr)
                if start is None:
                    return k, None, len(data), 0, 0, 0, None
            records = Piece(file, n, begin, end, start or 0).records(strip_cr, texts=False)
            mark = lambda count: np.array([(0, start or 0, count, 0, 0)])
            try:
                for _ in records:
                    pass
            except ValueError:
                return k, start or 0, len(data or b""), None, 0, 0, mark(0)
            return k, start or 0, len(data or b""), max(0, records.at - len(data or b"") + (start or 0)) if data is not None else 0, records.n, records.line, mark(records.n)

        tasks = max(1, min(len(wanted), max(TASKS, sum(sizes) // RUN)))
        return sorted(spark.sparkContext.parallelize(list(enumerate(wanted)), tasks).map(scan).collect(), key=lambda r: r[0])

    found = scanned([(*r, None) for r in runs])
    while True:
        wrong, carry, record, line, rows, dead = [], 0, 0, 0, [], False
        for k, ((n, file, begin, end), (_, start, size, past, count, lines, marks)) in enumerate(zip(runs, found, strict=True)):
            if not begin:
                carry, record, line, dead = 0, 0, 0, False
            if dead:
                continue
            if carry >= size and begin:  # one record goes on over the whole run
                carry -= size
                continue
            if start != carry:
                wrong.append(k)
                if start is None or past is None:
                    dead = True
                    found[k] = (k, carry, size, None, 0, 0, None)
                    continue
                found[k] = (k, carry, size, past, count, lines, None)  # what it says about the runs after it is tried first
                carry = past
                continue
            for lo, first, own, before, above in [] if marks is None else marks.tolist():
                stop = begin + lo + split
                stop = end if end is not None and stop > end or stop >= sizes[n] else stop
                rows.append((file, n, begin + lo, stop, first, own, record + before, line + above))
            if past is None:
                dead = True  # nothing after what can't be parsed is read
                continue
            carry, record, line = past, record + count, line + lines
        if not wrong:
            break
        for k, again in zip(wrong, scanned([(*runs[k], found[k][1]) for k in wrong]), strict=True):
            found[k] = (k, *again[1:])
    to = to or scratch(spark, "fastq")
    kinds = {"path": pa.string(), "file_no": pa.int32(), **dict.fromkeys(("begin", "end", "start", "n", "record", "line"), pa.int64())}
    table = pa.table({c: pa.array([r[i] for r in rows], kind) for i, (c, kind) in enumerate(kinds.items())})
    schema = "path string, file_no int, begin long, end long, start long, n long, record long, line long"
    spark.createDataFrame(table, schema).coalesce(1).write.parquet(to)
    return to


def read_fastq_ranges(spark: SparkSession, path: str, split: int = SPLIT, index: str | None = None, names: bool = True, **options) -> DataFrame:
    """read_fastq with a task for each range of ``split`` bytes, or of several where there are many; the index is made first, unless it is given."""
    index = index or index_fastq(spark, path, split, _strip_cr(options))
    return read_fastq(spark, path, names, index=index, **options)


def read_fastq_strict(spark: SparkSession, path: str, split: int = SPLIT) -> DataFrame:
    """file, file_no, record_no, name and seq of files of four lines a record, which are cut without a look at single lines."""
    return read_fastq_ranges(spark, path, split)


def read_fastq_pairs(spark: SparkSession, path1: str, path2: str, split: int | None = None, names: bool = True, **options) -> DataFrame:
    """Pairs by the places of files and of reads in them, never by name: read_id, name1, seq1, name2, seq2.

    The first file of one side goes with the first of the other, and so on; both files of a pair are read in one task, or with ``split`` a range of the
    first with the reads at its places in the second.  A read without a mate fails the task that comes to it.
    """
    spark.dataSource.register(FastqPairsSource)
    options = {k: str(v) for k, v in options.items()} | {"path1": path1, "path2": path2}
    if split:
        options |= {f"index{k}": index_fastq(spark, p, split, _strip_cr(options)) for k, p in ((1, path1), (2, path2))}
    reader = spark.read.format("fastq_pairs").options(**options)
    return (reader if names else reader.schema("read_id long, seq1 string, seq2 string")).load()


def with_read_id(df: DataFrame) -> DataFrame:
    """A number for each read that no other read of these files has; record_no itself in the first file."""
    return df.withColumn("read_id", F.shiftleft(F.col("file_no").cast("long"), RECORD_BITS) + F.col("record_no"))


def pair(one: DataFrame, two: DataFrame) -> DataFrame:
    """Pairs of two tables by the places of files and of reads in them, never by name: read_id, name1, seq1, name2, seq2.

    A read without a mate fails the job, so both sides need as many files with as many reads.  Tables without file and file_no
    count as one file.  This is a join of both sides; files are better read by ``read_fastq_pairs``, which needs none.
    """
    names = [c for c in ("name", "seq") if c in one.columns and c in two.columns]

    def side(df: DataFrame, n: int) -> DataFrame:
        if "file" in df.columns and "file_no" not in df.columns:
            raise ValueError("reads of several files need file_no, the place of their file")
        df = with_read_id(df) if "file_no" in df.columns else df.withColumn("read_id", F.col("record_no"))
        return df.select("read_id", *[F.col(c).alias(f"{c}{n}") for c in names])

    both = side(one, 1).join(side(two, 2), "read_id", "full")
    missing = F.col("seq1").isNull() | F.col("seq2").isNull()
    checked = F.when(missing, F.raise_error(F.lit(UNEQUAL)).cast("string")).otherwise(F.col("seq1"))
    return both.withColumn("seq1", checked)


def write_fastq(df: DataFrame, path: str, per_line: int | None = None, gz: bool = False) -> None:
    """Writes name and seq as FASTQ text (for round trips); sequences are wrapped at per_line bases."""
    wrap = (lambda c: c) if per_line is None else (lambda c: F.regexp_replace(c, f"(.{{{per_line}}})(?=.)", "$1\n"))
    text = F.concat(F.lit("@"), F.col("name"), F.lit("\n"), wrap(F.col("seq")), F.lit("\n+\n"), wrap(F.regexp_replace("seq", ".", "!")))
    df.select(text.alias("value")).write.mode("overwrite").option("compression", "gzip" if gz else "none").text(path)
