"""Nearest barcodes by Hamming distance, rewritten into equi-joins when the plan is made.

For an observed sequence o and a barcode b, d is the number of places at which o has none of the bases
that b stands for.  The nearest barcode within the cap is the answer; of several, the first, the
last, or none (AMBIGUOUS).
"""

from __future__ import annotations

import hashlib
from collections import Counter
from dataclasses import dataclass
from functools import reduce
from itertools import product
from math import comb

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqtally.functions.bases import IUPAC, hamming, let
from seqtally.operators.pool import BarcodePool, expand_iupac
from seqtally.operators.tree import PoolTree, probe
from seqtally.schema import AMBIGUOUS, OK, Duplicates

#: Rows of a neighbourhood table at most; it is this bound that allows it to be broadcast.
MOST_NEIGHBOURS = 500_000
#: Barcodes that are compared one by one, inside a row, at most.
MOST_BRUTE = 4096
#: Bytes of a tree of a pool that is broadcast, at most: some millions of barcodes.
MOST_TREE = 256 << 20
#: Tuples from which the frequencies of keys are estimated.
MOST_ESTIMATED = 20_000


def neighbourhood_size(expanded: int, length: int, cap: int) -> int:
    return expanded * sum(comb(length, i) * 4**i for i in range(cap + 1))


def strategy(pool: BarcodePool, cap: int) -> str:
    """exact, neighbours, brute, tree or seeds."""
    if pool.is_wide:
        return "brute" if len(pool) <= MOST_BRUTE else "tree"
    if cap == 0:
        return "exact"
    if neighbourhood_size(pool.expanded_size, pool.length, cap) <= MOST_NEIGHBOURS:
        return "neighbours"
    return "seeds"


def _expanded(spark: SparkSession, pool: BarcodePool) -> DataFrame:
    if pool.letters <= set("ACGT"):
        return pool.frame(spark).withColumnRenamed("seq", "key")
    return expand_iupac(pool.frame(spark)).select("idx", F.col("expanded").alias("key"))


def neighbours(spark: SparkSession, pool: BarcodePool, cap: int) -> DataFrame:
    """(key, idx, distance) for every string over ACGTN within cap of a barcode."""
    n = pool.length
    level = _expanded(spark, pool).withColumn("distance", F.lit(0)).withColumn("_from", F.lit(1))
    out = level
    for d in range(1, min(cap, n) + 1):
        at = level.filter(F.col("_from") <= n).withColumn("_at", F.explode(F.sequence(F.col("_from"), F.lit(n))))
        other = at.withColumn("_base", F.explode(F.array(*map(F.lit, "ACGTN")))).filter(F.expr("substring(key, _at, 1) <> _base"))
        level = other.select("idx", F.expr("concat(substring(key, 1, _at - 1), _base, substring(key, _at + 1))").alias("key"), F.lit(d).alias("distance"), (F.col("_at") + 1).alias("_from"))
        out = out.unionByName(level)
    return out.groupBy("key", "idx").agg(F.min("distance").alias("distance"))


def _nearest(df: DataFrame, by: list[str]) -> DataFrame:
    """Of (by, idx, distance): the least distance with the first and the last idx at it."""
    lo, hi = F.min(F.struct("distance", "idx")), F.max(F.struct((-F.col("distance")).alias("distance"), "idx"))
    return df.groupBy(*by).agg(lo.alias("lo"), hi.alias("hi")).select(*by, F.col("lo.distance").alias("distance"), F.col("lo.idx").alias("first"), F.col("hi.idx").alias("last"))


def _chosen(duplicates: Duplicates) -> tuple[Column, Column]:
    """(idx, status) from first and last."""
    if duplicates is Duplicates.FIRST:
        return F.col("first"), F.lit(OK)
    if duplicates is Duplicates.LAST:
        return F.col("last"), F.lit(OK)
    same = F.col("first") == F.col("last")
    return F.when(same, F.col("first")), F.when(same, F.lit(OK)).otherwise(F.lit(AMBIGUOUS))


def nearest_in_row(v: Column, pool: BarcodePool) -> Column:
    """struct(distance, first, last) of the nearest barcodes, inside the row: no pair becomes a row."""
    if len(pool) > MOST_BRUTE:
        raise ValueError(f"a pool of over {MOST_BRUTE} barcodes is too large to be compared inside a row")
    sets = F.array(*[F.struct(F.lit(i).alias("idx"), F.array(*[F.lit(IUPAC[c]) for c in s.upper()]).alias("sets")) for i, s in enumerate(pool.sequences)])
    distance = lambda bases, b: F.aggregate(F.zip_with(bases, b["sets"], lambda x, y: F.when(F.instr(y, x) > 0, 0).otherwise(1)), F.lit(0), lambda a, x: a + x)
    far = let(F.split(v, ""), lambda bases: F.transform(sets, lambda b: F.struct(distance(bases, b).alias("distance"), b["idx"].alias("idx"))))
    last = lambda all_, lo: F.array_max(F.transform(F.filter(all_, lambda x: x["distance"] == lo["distance"]), lambda x: x["idx"]))
    return let(far, lambda all_: let(F.array_min(all_), lambda lo: F.struct(lo["distance"].alias("distance"), lo["idx"].alias("first"), last(all_, lo).alias("last"))))


def _by_tree(seen: DataFrame, pool: BarcodePool, cap: int) -> DataFrame:
    """(key, distance, first, last) of distinct strings, by a tree of the pool's sets of bases that is broadcast."""
    tree = PoolTree(pool)
    if tree.nbytes > MOST_TREE:
        raise ValueError(f"the tree of a pool takes {tree.nbytes} bytes, which is over the {MOST_TREE} that are broadcast")
    shared = seen.sparkSession.sparkContext.broadcast(tree)
    return seen.mapInArrow(lambda it: probe(shared, cap, it), "key string, distance int, first int, last int")


def lookup_remembered(df: DataFrame, v: str, pool: BarcodePool, cap: int, duplicates: Duplicates, path: str) -> DataFrame:
    """lookup with what earlier runs have found: only strings that no run has met are looked up, and they are added to a table below ``path``.

    The table is one for each pool and cap, whatever the duplicates' treatment; strings without a barcode are in it too.  Runs that write at the same
    time may both look a string up, which does no harm.
    """
    spark = df.sparkSession
    name = hashlib.sha256("\n".join(s.upper() for s in pool.sequences).encode()).hexdigest()[:32]
    table = f"{path.rstrip('/')}/pool={name}/cap={cap}"
    schema = "key string, distance int, first int, last int"
    empty = spark.createDataFrame([], schema)
    empty.write.mode("append").parquet(table)  # a table without rows is a table
    known = spark.read.schema(schema).parquet(table)
    fresh = df.select(F.col(v).alias("string")).filter("string is not null").distinct()
    fresh = fresh.join(known, fresh["string"] == known["key"], "left_anti")
    looked = lookup(fresh, "string", pool, cap, Duplicates.FIRST).select("string", F.col("string_distance").alias("distance"), F.col("string_idx").alias("first"))
    other = lookup(fresh, "string", pool, cap, Duplicates.LAST).select("string", F.col("string_idx").alias("last"))
    fresh.join(looked.join(other, "string"), "string", "left").select(F.col("string").alias("key"), "distance", "first", "last").write.mode("append").parquet(table)
    every = spark.read.schema(schema).parquet(table).filter("distance is not null").distinct()
    idx, status = _chosen(duplicates)
    return df.join(every, df[v] == every["key"]).select(*df.columns, F.col("distance").alias(f"{v}_distance"), idx.alias(f"{v}_idx"), status.alias(f"{v}_status"))


def lookup(df: DataFrame, v: str, pool: BarcodePool, cap: int, duplicates: Duplicates, how: str | None = None) -> DataFrame:
    """df with <v>_distance, <v>_idx and <v>_status; rows without a barcode within cap are dropped.

    v holds strings over ACGTN.  The nearest set doesn't depend on the cap, so smaller budgets of single rows
    are a filter on the distance afterwards.
    """
    how = how or strategy(pool, cap)
    spark = df.sparkSession
    idx, status = _chosen(duplicates)
    done = lambda d: d.select(*df.columns, F.col("distance").alias(f"{v}_distance"), idx.alias(f"{v}_idx"), status.alias(f"{v}_status"))
    if not len(pool):
        return done(df.filter(F.lit(False)).withColumns({"distance": F.lit(0), "first": F.lit(0), "last": F.lit(0)}))
    if how == "brute":
        return done(df.withColumn("_near", nearest_in_row(F.col(v), pool)).select(*df.columns, "_near.*").filter(F.col("distance") <= cap))
    if how == "tree":
        table = _by_tree(df.select(F.col(v).alias("v")).distinct(), pool, cap)
        return done(df.join(table, df[v] == table["key"]))
    if how in ("exact", "neighbours"):
        table = _nearest(neighbours(spark, pool, cap if how == "neighbours" else 0), ["key"])
        if neighbourhood_size(pool.expanded_size, pool.length, cap) <= MOST_NEIGHBOURS:
            table = F.broadcast(table)
        return done(df.join(table, df[v] == table["key"]))
    # seeds: of cap + 1 parts of a string within cap, one is equal; each distinct string is looked up once
    n, parts = pool.length, min(cap + 1, pool.length)
    cuts = [i * n // parts for i in range(parts + 1)]
    seeds = lambda c: F.explode(F.array(*[F.struct(F.lit(i).alias("part"), F.substring(c, cuts[i] + 1, cuts[i + 1] - cuts[i]).alias("seed")) for i in range(parts)]))
    seen = df.select(F.col(v).alias("v")).distinct().select("v", seeds("v").alias("s")).select("v", "s.*")
    known = _expanded(spark, pool).select("idx", "key", seeds("key").alias("s")).select("idx", "key", "s.*")
    near = seen.join(known, ["part", "seed"]).withColumn("distance", hamming("v", "key", n)).filter(F.col("distance") <= cap).select("v", "idx", "distance")
    if cap >= n:  # a string that shares no base with any barcode is at full distance from all of them
        ends = _expanded(spark, pool).agg(F.array(F.min("idx"), F.max("idx")).alias("ends"))
        near = near.unionByName(df.select(F.col(v).alias("v")).distinct().filter(F.length("v") == n).crossJoin(F.broadcast(ends)).select("v", F.explode("ends").alias("idx"), F.lit(n).alias("distance")))
    table = _nearest(near, ["v"]).withColumnRenamed("v", "key")
    return done(df.join(table, df[v] == table["key"]))


def split_pool(pool: BarcodePool, lengths: list[int]) -> list[BarcodePool]:
    """The pools of consecutive segments of a pool's sequences."""
    if len(pool) and sum(lengths) != pool.length:
        raise ValueError("variable sequences should have the same length as the sum of segment lengths")
    ends = [sum(lengths[: i + 1]) for i in range(len(lengths))]
    return [BarcodePool([s[e - n : e] for s in pool.sequences], n) for n, e in zip(lengths, ends, strict=True)]


def _differing(v: Column, codes: Column, pool: BarcodePool) -> Column:
    """Places at which v has none of the bases that ``codes``, a barcode of pool, stands for."""
    plain = pool.letters <= set("ACGT")
    any_of = F.create_map(*[F.lit(x) for pair in IUPAC.items() for x in pair])
    d = F.lit(0)
    for at in range(1, pool.length + 1):
        base, code = F.substring(v, at, 1), F.substring(codes, at, 1)
        d = d + (base != code if plain else F.instr(F.element_at(any_of, code), base) == 0).cast("int")
    return d


@dataclass(frozen=True)
class _Keys:
    """What a key of tuples is made of: whole strings of the segments ``near`` (within their caps), and one of cap + 1 parts of each of ``parts``."""

    near: tuple[int, ...]
    parts: tuple[int, ...]

    def combinations(self, most: list[int]) -> list[dict[int, int]]:
        """For each kind of key the place of the part of each segment in ``parts``."""
        return [dict(zip(self.parts, c, strict=True)) for c in product(*(range(most[i] + 1) for i in self.parts))]


def _part(length: int, cap: int, k: int) -> tuple[int, int]:
    """(begin, size) of the k-th of cap + 1 parts."""
    cut = lambda j: j * length // (cap + 1)
    return cut(k), cut(k + 1) - cut(k)


def choose_keys(pools: list[BarcodePool], most: list[int], entries: int | None = MOST_NEIGHBOURS) -> _Keys | None:
    """The keys by which fewest tuples are compared with an observed one, by the frequencies of keys in the pools themselves.

    Any two tuples within the caps have such a key in common: a string within its cap is in the neighbourhood, and of cap + 1 parts one is
    equal.  ``entries`` bounds the rows of the tuples' keys; None allows parts alone, of which there are few.
    """
    n = len(pools[0])
    step = max(1, n // MOST_ESTIMATED)
    tuples = [tuple(p.sequences[i].upper() for p in pools) for i in range(0, n, step)]
    best: tuple[float, _Keys] | None = None
    for modes in product(("", "near", "parts"), repeat=len(pools)):
        keys = _Keys(*(tuple(i for i, m in enumerate(modes) if m == mode) for mode in ("near", "parts")))
        if not any(modes) or any(most[i] + 1 > pools[i].length for i in keys.parts) or entries is None and keys.near:
            continue
        size = float(n)
        for i in (*keys.near, *keys.parts):
            wide = pools[i].expanded_size / n
            size *= wide * (neighbourhood_size(1, pools[i].length, most[i]) if i in keys.near else most[i] + 1)
        if entries is not None and size > entries:
            continue
        compared, kinds = 0.0, keys.combinations(most)
        for kind in kinds:
            cuts = [(i, 0, pools[i].length) for i in keys.near] + [(i, *_part(pools[i].length, most[i], k)) for i, k in kind.items()]
            seen = Counter(tuple(t[i][a : a + m] for i, a, m in cuts) for t in tuples)
            compared += sum(f * f for f in seen.values()) / len(tuples) * step
        cost = 4 * compared + len(kinds)
        if best is None or cost < best[0]:
            best = (cost, keys)
    return best and best[1]


def lookup_segments(df: DataFrame, segments: list[tuple[str, BarcodePool, str]], duplicates: Duplicates, most: list[int] | int, entries: int = MOST_NEIGHBOURS) -> DataFrame:
    """df with distance, idx and status of the nearest tuple over several segments, each with a cap of its own.

    segments: (column of the string, pool, column of the cap) with pools of equal size, of which equal places form
    a barcode.  The caps of a row decide which barcodes compete; ``most`` bounds those of each segment, or of the first alone.  Rows
    without a tuple within all caps are dropped.

    Tuples are found by keys made of several segments, chosen so that few tuples share one.  Where the tuples' keys are ``entries`` at most
    they are broadcast, and a row is answered where it stands; otherwise each distinct observed tuple is looked up once.
    """
    spark = df.sparkSession
    pools, columns = [p for _, p, _ in segments], [v for v, _, _ in segments]
    most = [most, *(p.length for p in pools[1:])] if isinstance(most, int) else most
    idx, status = _chosen(duplicates)
    names = [f"s{i}" for i in range(len(segments))]

    def judged(found: Column) -> Column:
        """struct(distance, first, last) of an array of (idx, s0, s1, ...), null if no barcode is within the caps; repeats do no harm."""
        near = F.transform(found, lambda b: F.struct(b["idx"].alias("idx"), *(_differing(F.col(v), b[f"s{i}"], p).alias(f"d{i}") for i, (v, p, _) in enumerate(segments))))
        within = lambda b: reduce(Column.__and__, (b[f"d{i}"] <= F.col(c) for i, (_, _, c) in enumerate(segments)))
        total = lambda b: F.struct(reduce(Column.__add__, (b[f"d{i}"] for i in range(len(segments)))).alias("distance"), b["idx"].alias("idx"))
        last = lambda all_, lo: F.array_max(F.transform(F.filter(all_, lambda x: x["distance"] == lo["distance"]), lambda x: x["idx"]))
        return let(F.transform(F.filter(near, within), total), lambda all_: let(F.array_min(all_), lambda lo: F.when(lo.isNotNull(), F.struct(lo["distance"].alias("distance"), lo["idx"].alias("first"), last(all_, lo).alias("last")))))

    def done(rows: DataFrame) -> DataFrame:
        return rows.withColumn("_near", judged(F.col("_found"))).filter("_near is not null").select(*df.columns, "_near.*").select(*df.columns, "distance", idx.alias("idx"), status.alias("status"))

    if not len(pools[0]):
        return df.filter(F.lit(False)).withColumns({"distance": F.lit(0), "idx": F.lit(0), "status": F.lit(OK)})
    if any(p.is_wide for p in pools) and len(pools[0]) <= MOST_BRUTE:
        every = F.array(*[F.struct(F.lit(i).alias("idx"), *(F.lit(p.sequences[i].upper()).alias(c) for c, p in zip(names, pools, strict=True))) for i in range(len(pools[0]))])
        return done(df.withColumn("_found", every))
    rows = {"idx": pa.array(range(len(pools[0])), pa.int32())} | {c: pa.array([x.upper() for x in p.sequences], pa.string()) for c, p in zip(names, pools, strict=True)}
    whole = spark.createDataFrame(pa.table(rows), ", ".join(["idx int", *(f"{c} string" for c in names)]))
    keys = choose_keys(pools, most, entries)
    if keys is not None:
        out, found = df, []
        for k, kind in enumerate(keys.combinations(most)):
            table, on = whole, []
            for i in keys.near:
                table = table.join(neighbours(spark, pools[i], most[i]).select("idx", F.col("key").alias(f"_k{i}")), "idx")
                on.append((f"_k{i}", F.col(columns[i])))
            for i, j in kind.items():
                a, m = _part(pools[i].length, most[i], j)
                table = table.join(_expanded(spark, pools[i]).select("idx", F.substring("key", a + 1, m).alias(f"_k{i}")).distinct(), "idx")
                on.append((f"_k{i}", F.substring(columns[i], a + 1, m)))
            own = [c for c, _ in on]
            table = table.groupBy(*own).agg(F.collect_list(F.struct("idx", *names)).alias(f"_f{k}"))
            out = out.join(F.broadcast(table), reduce(Column.__and__, (x == table[c] for c, x in on)), "left").drop(*own)
            found.append(f"_f{k}")
        none = F.slice(F.coalesce(*found), 1, 0)
        every = F.col(found[0]) if len(found) == 1 else F.concat(*(F.coalesce(F.col(c), none) for c in found))
        return done(out.filter(reduce(Column.__or__, (F.col(c).isNotNull() for c in found))).withColumn("_found", every).drop(*found))
    # each distinct observed tuple is looked up once, by parts of which one kind of key is equal
    keys = choose_keys(pools, most, None)
    seen = df.select(*columns).distinct()
    sized = reduce(Column.__and__, (F.length(v) == p.length for v, p in zip(columns, pools, strict=True)))
    if keys is None:  # caps of whole lengths: every tuple is near every string
        pairs = seen.filter(sized).crossJoin(whole)
    else:
        cuts = [[(i, *_part(pools[i].length, most[i], j)) for i, j in kind.items()] for kind in keys.combinations(most)]
        key = lambda of: F.explode(F.array(*[F.concat(F.lit(f"{n}:"), *(F.substring(of(i), a + 1, m) for i, a, m in cut)) for n, cut in enumerate(cuts)]))
        known = whole
        for i in keys.parts:
            known = known.join(_expanded(spark, pools[i]).select("idx", F.col("key").alias(f"_e{i}")), "idx")
        known = known.select("idx", *names, key(lambda i: f"_e{i}").alias("_key")).distinct()
        pairs = seen.select(*columns, key(lambda i: columns[i]).alias("_key")).join(known, "_key").drop("_key").distinct()
    near = reduce(Column.__and__, (_differing(F.col(v), F.col(c), p) <= m for v, c, p, m in zip(columns, names, pools, most, strict=True)))
    table = pairs.filter(near).groupBy(*columns).agg(F.collect_list(F.struct("idx", *names)).alias("_found"))
    return done(df.join(table, columns))
