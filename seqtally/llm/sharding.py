"""Shards of nearly equal size, by sampled splitters.  DataFrame functions only.

Rows are ordered by their key and a row number.  A size-weighted sample of that order gives quantile
boundaries, so that ranges hold nearly equal bytes; a range that turns out overfull is divided by a
sample drawn inside it.  Running sums inside ranges and the ranges' totals give each row its place in
bytes, which decides its shard.  A record larger than a range is a range of its own: such records (at
most ``ranges`` of them, as they can't be more) are dealt to the least filled shard first, and the
others fill what room is left.
"""

from __future__ import annotations

import heapq
from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqtally.llm.common import written

SHARDS = 24
#: Ranges for each shard at least, and rows of a range about which there are more.
PER_SHARD, RANGE_ROWS = 32, 4_000_000
#: Sampled keys for each range.
OVERSAMPLE = 16
#: Times its part of the bytes from which a range is overfull.
OVERFULL = 4
SEED = 7


def _order(df: DataFrame) -> Column:
    return F.struct(F.col("_key"), F.col("_row"))


def _literal(points: list) -> Column:
    return F.array(*[F.struct(F.lit(k).alias("_key"), F.lit(r).alias("_row")) for k, r in points])


def _range_of(df: DataFrame, points: list) -> Column:
    """Number of points that are not above a row, by binary search."""
    if not points:
        return F.lit(0)
    types = df.select(_order(df).alias("x")).schema["x"].dataType.simpleString()
    bounds = _literal(points).cast(f"array<{types}>")
    steps = F.array(*[F.lit(1 << b) for b in range(len(points).bit_length() - 1, -1, -1)])
    fits = lambda at: (at <= len(points)) & (F.element_at(bounds, F.least(at, F.lit(len(points)))) <= _order(df))
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(fits(at + step), at + step).otherwise(at))


def _sample(rows: DataFrame, total: int, ranges: int) -> list:
    """Keys drawn with chance in proportion to size, in order; the draw is a hash of the row, so a retry repeats it."""
    u = (F.xxhash64("_row", F.lit(SEED)).bitwiseAND(F.lit((1 << 52) - 1))) / F.lit(float(1 << 52))
    drawn = rows.filter(u < F.col("_size") * (ranges * OVERSAMPLE / max(total, 1))).select("_key", "_row")
    return [(r[0], r[1]) for r in drawn.orderBy("_key", "_row").collect()]


def _quantiles(sample: list, ranges: int) -> list:
    step = len(sample) / ranges
    return [sample[int(i * step)] for i in range(1, ranges)] if len(sample) > ranges else sample


def deal_heavy(heavy: list[tuple[int, int]], total: int, shards: int) -> tuple[list[tuple[int, int, int]], list[float]]:
    """((row, shard, slot) of each heavy record, bytes of the others that each shard takes)."""
    loads = [(0, s) for s in range(shards)]
    taken, placed = [0] * shards, []
    for row, size in sorted(heavy, key=lambda x: (-x[1], x[0])):
        load, s = heapq.heappop(loads)
        placed.append((row, s, taken[s]))
        taken[s] += 1
        heapq.heappush(loads, (load + size, s))
    load = [0.0] * shards
    for x, s in loads:
        load[s] = float(x)
    rest = total - sum(load)
    level, order = 0.0, sorted(load)
    for k in range(1, shards + 1):  # the level that the others fill the lowest k shards up to
        level = (rest + sum(order[:k])) / k
        if k == shards or level <= order[k]:
            break
    return placed, [max(0.0, level - x) for x in load]


def shard_by_size(df: DataFrame, key: str, size: Column, shards: int = SHARDS, per_shard: int = PER_SHARD) -> DataFrame:
    """df with shard (0 to shards - 1) and slot (gapless from 0 in each shard) after its columns.

    Law: bytes.  Shards differ by about one record that is smaller than a range, unless one record alone is
    larger than a shard.  Any key type that can be ordered; equal and null keys are told apart by the row, so
    one key may hold any part of the rows.  A null size counts as 0.  Repeated rows each get a place.  Columns
    of df named shard or slot are replaced.  An empty table gives no rows.  df is written to the shared folder
    once, so give it slim columns.
    """
    df = df.drop("shard", "slot")
    rows = written(df.select("*", F.col(key).alias("_key"), F.coalesce(size, F.lit(0)).cast("long").alias("_size"), F.monotonically_increasing_id().alias("_row")))
    n, total = rows.agg(F.count("*"), F.sum("_size")).first()
    total = total or 0
    ranges = shards * max(per_shard, -(-n // (shards * RANGE_ROWS)))
    # heavy: fewer than ``ranges`` records can be larger than a range
    limit = max(1, ceil(total / ranges))
    heavy = [(r[0], r[1]) for r in rows.filter(F.col("_size") > limit).select("_row", "_size").collect()]
    placed, rooms = deal_heavy(heavy, total, shards)
    light = rows.filter(F.col("_size") <= limit)
    rest = total - sum(s for _, s in heavy)

    points = _quantiles(_sample(light, rest, ranges), ranges)
    while True:
        ranged = light.withColumn("_range", _range_of(light, points))
        sums = {r[0]: (r[1], r[2]) for r in ranged.groupBy("_range").agg(F.count("*"), F.sum("_size")).collect()}
        most = OVERFULL * max(rest / ranges, 1), OVERFULL * max(n / ranges, 64)
        over = sorted(k for k, (c, b) in sums.items() if c > 1 and (b > most[0] and b > 2 * limit or c > most[1]))
        if not over:
            break
        inside = ranged.filter(F.col("_range").isin(over))
        weighed = inside.withColumn("_size", F.col("_size") + F.lit(max(1, rest // max(n, 1))))
        more = _sample(weighed, sum(sums[k][1] + sums[k][0] * max(1, rest // max(n, 1)) for k in over), 4 * len(over))
        new = sorted({*points, *more}, key=lambda p: ((p[0] is not None), p[0] if p[0] is not None else 0, p[1]))
        if len(new) == len(points):
            break
        points = new

    base, bytes_before, rows_before = [], 0, 0
    for k in sorted(sums):
        base.append((k, bytes_before, rows_before))
        rows_before, bytes_before = rows_before + sums[k][0], bytes_before + sums[k][1]
    spark = df.sparkSession
    w = Window.partitionBy("_range").orderBy("_key", "_row")
    at = spark.createDataFrame(base, "_range int, _bytes long, _rows long")  # a row for each range
    running = ranged.join(F.broadcast(at), "_range").withColumn("_middle", F.col("_bytes") + F.sum("_size").over(w) - F.col("_size") / 2).withColumn("_index", F.col("_rows") + F.row_number().over(w) - 1)
    ends, stop = [], 0.0
    for room in rooms[:-1]:
        stop += room
        ends.append(stop)
    shard = F.lit(0)
    for e in ends:
        shard = shard + (F.col("_middle") > F.lit(e)).cast("int")
    dealt = written(running.withColumn("shard", shard).drop("_range", "_bytes", "_rows", "_middle"))
    first = {r[0]: r[1] for r in dealt.groupBy("shard").agg(F.min("_index")).collect()}
    own = [0] * shards
    for _, s, _ in placed:
        own[s] += 1
    shift = spark.createDataFrame([(s, own[s] - first.get(s, 0)) for s in range(shards)], "shard int, _shift long")
    small = dealt.join(F.broadcast(shift), "shard").withColumn("slot", F.col("_index") + F.col("_shift"))
    big = rows.filter(F.col("_size") > limit).join(F.broadcast(spark.createDataFrame(placed or [], "_row long, shard int, slot long")), "_row")
    names = [*df.columns, "shard", "slot"]
    return small.select(*names).unionByName(big.select(*names))


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard (null: the law is bytes) of each document."""
    slim = docs.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"), F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("text_crc32"))
    out = shard_by_size(slim, "doc_id", F.col("size"), shards)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
