"""Counts over streams of reads.

``stream_counts`` and ``tally_stream``: what a design finds in a read or pair is found inside its row, so the only aggregation of the stream is the
count itself, which is in the state store.
``count_stream``: any design, pools of any size.  A read, or pair, lies whole in one micro-batch, so a design runs on each batch as it does on a
table, and its counts add up.  A batch's counts are a folder of its own name, so a repeated batch replaces what it wrote.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from seqtally.operators.handlers import Handler, SingleBarcode
from seqtally.operators.outcomes import _single, columns_of, tally


def match_in_row(design: SingleBarcode, seq: str = "seq") -> Column:
    """The barcode of a read, or null, by array functions alone."""
    return _single(design, seq)["idx"][0]


def stream_counts(reads: DataFrame, design: SingleBarcode, seq: str = "seq") -> DataFrame:
    """(idx, count) of barcodes seen so far; for output modes complete and update."""
    return reads.select(match_in_row(design, seq).alias("idx")).filter("idx is not null").groupBy("idx").agg(F.count("*").alias("count"))


def tally_stream(reads: DataFrame, design: Handler, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Starts a stream in update mode: each micro-batch writes the results whose counts it has changed, with the counts so far, below ``path``.

    A batch's results are a folder of its own name, so a repeated batch replaces what it wrote; ``latest`` reads them.
    """

    def one(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return tally(reads, design).writeStream.outputMode("update").foreachBatch(one).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def latest(spark: SparkSession, path: str, design: Handler) -> DataFrame:
    """(kind, columns of the result, count) of all reads so far, from what ``tally_stream`` writes."""
    parts = spark.read.parquet(path)
    return parts.groupBy("kind", *columns_of(design)).agg(F.max_by("count", "batch").alias("count"))


def compact(spark: SparkSession, path: str, design: Handler, to: str) -> None:
    """Writes the latest results as a folder of batch -1 below ``to``, which can take the place of all folders below ``path``."""
    latest(spark, path, design).write.parquet(f"{to}/batch=-1")


def count_stream(reads: DataFrame, design: Handler, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Starts a stream that writes the counts of each micro-batch below ``path``, a folder that all executors share."""

    def one(batch: DataFrame, number: int) -> None:
        design.plan(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return reads.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def counted(spark: SparkSession, path: str) -> DataFrame:
    """The sums over all batches so far; dense where the design's counts are."""
    parts = spark.read.parquet(path).drop("batch")
    return parts.groupBy(*(c for c in parts.columns if c != "count")).agg(F.sum("count").alias("count"))
