"""From hits to one match per read: the first one, or the best one if it is not disputed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_match(hits: DataFrame, keys: list[str], columns: list[str], order: list[str]) -> DataFrame:
    """The hit that comes first by ``order``; a partial aggregate on the map side, no sort of the hits."""
    return hits.groupBy(*keys).agg(F.min(F.struct(*order, *[c for c in columns if c not in order])).alias("m")).select(*keys, *[F.col(f"m.{c}").alias(c) for c in columns])


def best_match(hits: DataFrame, keys: list[str], columns: list[str], order: list[str], same: list[str], score: str = "mismatches") -> DataFrame:
    """The first hit of the least score, unless hits of that score differ in ``same``.

    Hits of higher scores don't matter, even when those of the least are disputed.
    """
    top = F.min(F.struct(score, *order, *[c for c in columns if c != score and c not in order])).alias("m")
    lo, hi = F.min(F.struct(score, *same)).alias("lo"), F.max(F.struct((-F.col(score)).alias(score), *same)).alias("hi")
    agreed: Column = F.lit(True)
    for c in same:
        agreed = agreed & (F.col(f"lo.{c}") == F.col(f"hi.{c}"))
    return hits.groupBy(*keys).agg(top, lo, hi).filter(agreed).select(*keys, *[F.col(f"m.{c}").alias(c) for c in columns])


def match(hits: DataFrame, use_first: bool, keys: list[str], columns: list[str], same: list[str], order: tuple[str, ...] = ("position", "reverse")) -> DataFrame:
    if use_first:
        return first_match(hits, keys, columns, list(order))
    return best_match(hits, keys, columns, list(order), same)


def match_by_side(hits: DataFrame, sides: list[str], use_first: bool, columns: list[str], same: list[str], order: tuple[str, ...] = ("position", "reverse"), score: str = "mismatches") -> DataFrame:
    """(read_id, one struct of ``columns`` for each side) out of hits with a column ``side``: all matches of a read in one aggregate."""
    aggs, out = [], []
    for s in sides:
        own = lambda x, s=s: F.when(F.col("side") == s, x)
        if use_first:
            aggs.append(F.min(own(F.struct(*order, *[c for c in columns if c not in order]))).alias(f"_{s}"))
        else:
            aggs.append(F.min(own(F.struct(score, *order, *[c for c in columns if c != score and c not in order]))).alias(f"_{s}"))
            aggs += [F.min(own(F.struct(score, *same))).alias(f"_{s}_lo"), F.max(own(F.struct((-F.col(score)).alias(score), *same))).alias(f"_{s}_hi")]
        agreed: Column = F.col(f"_{s}").isNotNull()
        for c in same if not use_first else ():
            agreed = agreed & (F.col(f"_{s}_lo.{c}") == F.col(f"_{s}_hi.{c}"))
        out.append(F.when(agreed, F.struct(*[F.col(f"_{s}.{c}").alias(c) for c in columns])).alias(s))
    return hits.groupBy("read_id").agg(*aggs).select("read_id", *out)
