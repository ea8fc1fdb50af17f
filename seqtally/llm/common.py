"""Tables, shared scratch space and small plan helpers."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows and bytes of text that are worked on at once, at most; a longer text is a slice of its own.
SLICE_ROWS, SLICE_BYTES = 256, 8 << 20
#: Rows of one key that meet in a task of spread_join.
HOT_ROWS = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new path in the folder all executors share: spark.checkpoint.dir, or the context's checkpoint folder."""
    base = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getCheckpointDir()
    if not base:
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    return f"{base.rstrip('/')}/seqtally-{uuid.uuid4().hex}"


def slices(batch: pa.RecordBatch, at: int, rows: int = SLICE_ROWS, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """batch in slices of at most ``rows`` rows and about ``size`` bytes in column ``at``, or of one row."""
    column = batch.column(at)
    if batch.num_rows <= 1 or column.nbytes <= size and batch.num_rows <= rows:
        if batch.num_rows:
            yield batch
        return
    wide = pa.large_string() if pa.types.is_string(column.type) else pa.large_binary() if pa.types.is_binary(column.type) else column.type
    offsets = np.frombuffer(column.cast(wide).buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    i = 0
    while i < batch.num_rows:
        j = int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1
        j = min(max(j, i + 1), i + rows, batch.num_rows)
        yield batch.slice(i, j - i)
        i = j


def give_back() -> None:
    """Free memory of Arrow and of the C library, if that can, goes back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def given_back(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches of ``it``; after each, and at the end, free memory goes back to the system, as workers stay when a task is done."""
    for batch in it:
        yield batch
        del batch
        give_back()
    give_back()


def written(df: DataFrame, path: str | None = None) -> DataFrame:
    """df as a table in the shared folder: its lineage is cut, and a lost executor costs nothing that is done."""
    spark = df.sparkSession
    path = path or scratch(spark)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], hot: int = HOT_ROWS, how: str = "inner") -> DataFrame:
    """left, a written table, joined with right, whose keys are unique.

    Rows of a key that left has more than ``hot`` times are dealt out in shares of ``hot``, and its row of right is repeated for each
    share; such keys are few (a broadcast row for each ``hot`` rows of left at most), and other keys are joined as they are.
    """
    heavy = written(left.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") > hot).select(*keys, F.ceil(F.col("_n") / hot).cast("int").alias("_n")))
    if heavy.isEmpty():
        return left.join(right, keys, how)
    shares = lambda df: df.join(F.broadcast(heavy), keys, "left")
    dealt = shares(left).withColumn("_part", F.pmod(F.monotonically_increasing_id(), F.coalesce("_n", F.lit(1))).cast("int")).drop("_n")
    repeated = shares(right).withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_n", F.lit(1)) - 1))).drop("_n")
    return dealt.join(repeated, [*keys, "_part"], how).drop("_part")


def field(df: DataFrame, name: str, new: str | None = None) -> T.StructField:
    return T.StructField(new or name, df.schema[name].dataType, True)


def arrow_type(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def arrow_schema(schema: T.StructType) -> pa.Schema:
    return pa.schema([(f.name, arrow_type(f.dataType)) for f in schema])


def batches(rows: dict[str, list], schema: pa.Schema, size: int = 20_000) -> Iterator[pa.RecordBatch]:
    """rows, column by column, as batches; the lists are emptied."""
    n = len(next(iter(rows.values())))
    for i in range(0, n, size):
        yield pa.RecordBatch.from_arrays([pa.array(rows[f.name][i : i + size], f.type) for f in schema], schema=schema)
    for v in rows.values():
        v.clear()
