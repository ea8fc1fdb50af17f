"""Digest columns that queries show in place of long binary values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def crc_of_ids(df: DataFrame) -> DataFrame:
    return df.select(*(c for c in df.columns if c != "ids"), F.crc32("ids").alias("ids_crc32"))
