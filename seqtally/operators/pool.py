"""Barcode pools: dictionaries of equal-length sequences, IUPAC expansion and duplicates."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import product
from math import prod

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqtally.functions.bases import IUPAC, reverse_complement_text
from seqtally.schema import Duplicates

#: A pool whose barcodes stand for over MOST_EACH sequences on average, and for over MOST_EXPANDED in all, is wide: its
#: barcodes are compared base by base, not through a table of sequences.
MOST_EXPANDED, MOST_EACH = 200_000, 256


_MASKS = {k: sum(1 << "ACGT".index(b) for b in v) for k, v in IUPAC.items()}


@dataclass(frozen=True)
class BarcodePool:
    """A pool is a query parameter: it is held on the driver, and a barcode is its place in it."""

    sequences: tuple[str, ...]
    fixed_length: int | None = None

    def __init__(self, sequences, fixed_length: int | None = None):
        object.__setattr__(self, "sequences", tuple(sequences))
        object.__setattr__(self, "fixed_length", fixed_length)
        if fixed_length is None and len({len(s) for s in self.sequences}) > 1:
            raise ValueError("sequences for a given variable region should be of a constant length")
        for c in sorted(self.letters - set(IUPAC)):
            raise ValueError(f"unknown base '{c}' detected when constructing the trie")

    @staticmethod
    def from_frame(df: DataFrame, seq: str = "seq", order: str = "idx") -> BarcodePool:
        """From a table of (idx, seq); a pool is a parameter, so the table has to fit the driver."""
        return BarcodePool(r[0] for r in df.orderBy(order).select(seq).collect())

    def __len__(self) -> int:
        return len(self.sequences)

    def __getitem__(self, i: int) -> str:
        return self.sequences[i]

    @property
    def length(self) -> int:
        return self.fixed_length if self.fixed_length is not None else len(self.sequences[0]) if self.sequences else 0

    def frame(self, spark: SparkSession) -> DataFrame:
        columns = {"idx": pa.array(range(len(self)), pa.int32()), "seq": pa.array([s.upper() for s in self.sequences], pa.string())}
        return spark.createDataFrame(pa.table(columns), "idx int, seq string")

    def reversed(self) -> BarcodePool:
        return BarcodePool(map(reverse_complement_text, self.sequences), self.fixed_length)

    @cached_property
    def letters(self) -> set[str]:
        return set().union(*(s.upper() for s in self.sequences))

    @cached_property
    def expanded_size(self) -> int:
        if self.letters <= set("ACGT"):
            return len(self)
        return sum(prod(len(IUPAC[c]) for c in s.upper()) for s in self.sequences)

    @property
    def is_wide(self) -> bool:
        return self.expanded_size > max(MOST_EXPANDED, MOST_EACH * len(self))

    def expanded(self) -> Iterator[tuple[int, str]]:
        """(idx, sequence over ACGT) of every sequence that a barcode stands for."""
        if self.letters <= set("ACGT"):
            return ((i, s.upper()) for i, s in enumerate(self.sequences))
        return ((i, "".join(p)) for i, s in enumerate(self.sequences) for p in product(*(IUPAC[c] for c in s.upper())))

    def check(self, duplicates: Duplicates) -> None:
        """Duplicates.ERROR fails when the pool is built, not when it is used."""
        if duplicates is not Duplicates.ERROR:
            return
        message = "duplicate sequences detected ({}, {}) when constructing the trie"
        if self.is_wide:  # bits of the bases that each place allows; barcodes collide if they have one in common everywhere
            masks = np.array([[_MASKS[c] for c in s.upper()] for s in self.sequences], np.uint8)
            for j in range(1, len(masks)):
                same = np.flatnonzero((masks[:j] & masks[j]).all(1))
                if len(same):
                    raise ValueError(message.format(int(same[0]) + 1, j + 1))
            return
        seen: dict[str, int] = {}
        for j, s in self.expanded():
            i = seen.setdefault(s, j)
            if i != j:
                raise ValueError(message.format(i + 1, j + 1))


def concatenated(pools: list[BarcodePool], message: str = "all entries of 'barcode_pools' should have the same length") -> BarcodePool:
    """Valid tuples as one key: the sequences at the same place of all pools."""
    if len({len(p) for p in pools}) > 1:
        raise ValueError(message)
    return BarcodePool("".join(t) for t in zip(*(p.sequences for p in pools), strict=True))


def expand_iupac(df: DataFrame, seq: str = "seq") -> DataFrame:
    """A table of pool sequences with one row for each sequence over ACGT, by one explode for each place."""
    codes = F.create_map(*[x for k, v in IUPAC.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    sets = F.transform(F.split(F.upper(seq), ""), lambda c: F.element_at(codes, c))
    strings = F.aggregate(sets, F.array(F.lit("")), lambda acc, bases: F.flatten(F.transform(acc, lambda a: F.transform(bases, lambda b: F.concat(a, b)))))
    return df.withColumn("expanded", F.explode(strings))


def resolve_duplicates(expanded: DataFrame, duplicates: Duplicates) -> DataFrame:
    """(expanded, idx) with one row for each sequence; NONE leaves a null idx where barcodes collide."""
    agg = expanded.groupBy("expanded").agg(F.min("idx").alias("lo"), F.max("idx").alias("hi"))
    idx = {Duplicates.FIRST: F.col("lo"), Duplicates.LAST: F.col("hi")}.get(duplicates, F.when(F.col("lo") == F.col("hi"), F.col("lo")))
    return agg.select("expanded", idx.alias("idx"))


def add_status(expanded: DataFrame, duplicates: Duplicates) -> DataFrame:
    """For each barcode: has_ambiguous, is_duplicate, duplicate_replaced, duplicate_cleared, as when added in order."""
    w = Window.partitionBy("expanded").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    earlier = F.count("*").over(w)
    marked = expanded.distinct().withColumn("_dup", earlier > 0).withColumn("_first_dup", earlier == 1)
    replaced = F.max("_dup") if duplicates is Duplicates.LAST else F.lit(False)
    cleared = F.max("_first_dup") if duplicates is Duplicates.NONE else F.lit(False)
    return marked.groupBy("idx").agg((F.count("*") > 1).alias("has_ambiguous"), F.max("_dup").alias("is_duplicate"), replaced.alias("duplicate_replaced"), cleared.alias("duplicate_cleared"))
