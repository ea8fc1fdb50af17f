"""Exact links among all texts: those whose sets of shingles are similar enough.

Members of a set are in one order, frequent ones last.  If i members of a set of n come before the first one that it shares with another,
n - i are shared at most, so the other has at most ``most`` = (n - i) * (1 + least) / least - n members if the two have a Jaccard similarity of ``least`` or
more.  So a row for each of the first members, with n and ``most``, leads to all similar sets: their rows have a member in common, and
each one's n is at most the other's ``most`` (prefix, length and position filter).  Copies far from a text differ early, and no row of theirs
meets those of other such copies.  Groups found by other means, as by SimHash, and stars only say which sets to compare first.

Every two sets whose rows meet are either united or were compared and rejected: by parities of their members' hashes first, which differ in
no more places than the sets do, and then whole.  Texts with equal sets are one node, by 128 bits of a digest; nodes are numbered.
Sets hold 64-bit hashes, so a collision could change a similarity by one shingle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqtally.llm.common import given_back, slices, spread_join, written
from seqtally.llm.components import components
from seqtally.llm.kernels import column_bytes

#: Sets whose documents' ids are broadcast, at most (four numbers each).
MOST_BROADCAST = 1 << 21
#: Stars at most before all rows that meet are compared, and how many rows each row may meet without another star; none follows one that hasn't halved what meets.
STARS, MEETING = 3, 4
#: Shingles counted at once; counts of less than LOCAL among them are not passed on, nor are more than FREQUENT shingles kept.
COUNTED, LOCAL, FREQUENT = 1 << 20, 4, 1 << 18


def prefix(hashes: np.ndarray, frequent: np.ndarray, counts: np.ndarray, least: Fraction) -> tuple[np.ndarray, np.ndarray]:
    """The first hashes in the order of counts and then of hashes, and the most members of a similar set that shares none before each."""
    n, p, q = len(hashes), least.numerator, least.denominator
    most = (q * n - (p + q) * np.arange(n)) // p
    most = most[most >= -(-p * n // q)]
    count = np.zeros(n, np.int64)
    if len(frequent) and n:
        at = np.minimum(np.searchsorted(frequent, hashes), len(frequent) - 1)
        count = np.where(frequent[at] == hashes, counts[at], 0)
    return hashes[np.lexsort((hashes, count))[: len(most)]], most


def parities(hashes: np.ndarray) -> bytes:
    """For each remainder of hashes, whether an odd number of them have it: as many bits as there are hashes, or more."""
    size = max(64, 1 << (len(hashes) - 1).bit_length())
    return np.packbits(np.bincount((hashes & np.uint64(size - 1)).astype(np.int64), minlength=size).astype(np.uint8) & 1, bitorder="little").tobytes()


def may_be_similar(n: int, x: bytes, m: int, y: bytes, least: Fraction) -> bool:
    """Whether sets of n and m members with these parities can be: a member of one alone changes one parity."""
    size = min(len(x), len(y))
    folded = [np.bitwise_xor.reduce(np.frombuffer(z, np.uint8).reshape(-1, size), axis=0) for z in (x, y)]
    differ = int(np.bitwise_count(folded[0] ^ folded[1]).sum())
    return differ * (least.denominator + least.numerator) <= (n + m) * (least.denominator - least.numerator)


def similar(x: np.ndarray, y: np.ndarray, least: Fraction) -> bool:
    if min(len(x), len(y)) * least.denominator < max(len(x), len(y)) * least.numerator:
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both * least.denominator >= (len(x) + len(y) - both) * least.numerator


def _counted(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, n) of the shingles of a task's sets (at, hashes) that are frequent in it."""
    held, n = [], 0

    def flush() -> pa.RecordBatch:
        key, count = np.unique(np.concatenate(held), return_counts=True)
        keep = count >= LOCAL
        return pa.RecordBatch.from_arrays([pa.array(key[keep].view(np.int64)), pa.array(count[keep])], names=["key", "n"])

    for batch in it:
        for x in batch.column(1):
            held.append(np.frombuffer(x.as_buffer(), np.uint64))
            n += len(held[-1])
            if n >= COUNTED:
                yield flush()
                held, n = [], 0
    if held:
        yield flush()


def _frequent(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles, sorted, and their counts: an order for prefixes, of which any is right."""
    top = counts.groupBy("key").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "key").limit(FREQUENT).toArrow()  # columns, not rows, on the driver
    key, count = top["key"].to_numpy().astype(np.int64).view(np.uint64), top["n"].to_numpy().astype(np.int64)
    order = np.argsort(key)
    return key[order], count[order]


_ROW = ["key", "node", "size", "most"]


def _meeting(rows: DataFrame, roots: DataFrame | None) -> DataFrame:
    """The rows that may meet one of another root, with their root and the root that most rows of the key have (major)."""
    now = rows.withColumn("root", F.col("node")) if roots is None else rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    now = written(now.select(*_ROW, "root"))
    per = written(now.groupBy("key", "root").agg(F.min("size").alias("lo"), F.max("most").alias("hi"), F.count("*").alias("n")))
    first = per.groupBy("key").agg(F.min(F.struct("lo", "root")).alias("lo1"), F.max(F.struct("hi", "root")).alias("hi1"), F.max_by("root", F.struct("n", "root")).alias("major"))
    # the best of other roots, null where a key has one root alone
    second = per.join(first.select("key", "lo1", "hi1"), "key").groupBy("key").agg(F.min(F.when(F.col("root") != F.col("lo1.root"), F.col("lo"))).alias("lo2"), F.max(F.when(F.col("root") != F.col("hi1.root"), F.col("hi"))).alias("hi2"))
    bounds = written(first.join(second, "key").filter("lo2 is not null"))
    least = F.when(F.col("root") == F.col("lo1.root"), F.col("lo2")).otherwise(F.col("lo1.lo"))
    most = F.when(F.col("root") == F.col("hi1.root"), F.col("hi2")).otherwise(F.col("hi1.hi"))
    return written(now.join(bounds, "key").filter((least <= F.col("most")) & (most >= F.col("size"))).select(*_ROW, "root", "major"))


def _star(now: DataFrame, k: int) -> DataFrame:
    """Pairs of each node with one of its key: that which shares its members earliest, of all (k = 0) or of a root drawn by hash."""
    order = F.struct(*([F.xxhash64("root", F.lit(k))] if k else []), F.col("most") - F.col("size"), "node")
    heads = now.groupBy("key").agg(F.max_by(F.struct("node", "root", "size", "most"), order).alias("head"))
    pairs = now.join(heads, "key").filter("root <> head.root and size <= head.most and head.size <= most")
    return pairs.select(F.greatest("node", "head.node").alias("a"), F.least("node", "head.node").alias("b")).distinct()


def _all(now: DataFrame) -> DataFrame:
    """All pairs of different roots whose rows meet; the rows of a key's major root are not held against each other."""
    other = now.select("key", "major", *(F.col(c).alias(f"_{c}") for c in (*_ROW[1:], "root")))
    met = now.filter("root <> major").drop("major").join(other, "key").filter("root <> _root and size <= _most and _size <= most and (_root = major or node > _node)")
    return met.select(F.greatest("node", "_node").alias("a"), F.least("node", "_node").alias("b")).distinct()


def united(members: DataFrame, compare: Callable[[DataFrame], DataFrame], hints: DataFrame) -> DataFrame:
    """(node, root) of each node that is linked, among the nodes whose rows (key, node, size, most) meet.

    ``compare`` takes distinct pairs (a, b) and gives those accepted.  A star over ``hints``, rows of the same kind, goes first, then stars over
    ``members``, which unite a large group at a cost of its size, for as long as that helps and many rows meet others of another root, and at last all pairs that meet and are apart.
    """
    links, roots, before = None, None, float("inf")

    def link(pairs: DataFrame) -> None:
        nonlocal links, roots
        found = written(compare(pairs))
        links = found if links is None else links.unionByName(found)
        roots = written(components(links))

    now = _meeting(hints, None)
    if not now.isEmpty():
        link(_star(now, 0))
    for k in range(STARS + 1):
        now = _meeting(members, roots)
        rows, pairs = now.groupBy("key").agg(F.count("*").alias("n"), F.count_if(F.col("root") != F.col("major")).alias("m")).agg(F.sum("n"), F.sum(F.col("n").cast("double") * F.col("m"))).first()
        if not rows:
            break
        last = k == STARS or pairs <= MEETING * rows or 2 * pairs > before
        link(_all(now) if last else _star(now, k))
        if last:
            break
        before, members = pairs, now.select(*_ROW)  # what meets nothing now won't later
    return members.select("node", F.col("node").alias("root")).limit(0) if roots is None else roots


def confirm(table: DataFrame, texts: DataFrame, sets_of: Callable, name_of: Callable, least: float) -> DataFrame:
    """The rows of ``table`` (doc_id, root, node and others) with component_id, the smallest id that links lead to.

    ``root`` is the group of likely copies and ``node`` the name of the row's set of shingles.  ``texts`` (doc_id, text) are read again for
    one document of each set.
    """
    part = Fraction(str(least))
    nodes = written(table.groupBy("node").agg(F.min("doc_id").alias("id"), F.min("root").alias("root")).withColumn("at", F.monotonically_increasing_id()))

    def whole(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in given_back(it):
            for piece in slices(batch, 0):
                found = list(sets_of(*column_bytes(piece.column(0))))
                own = pa.array([name_of(x) == n for x, n in zip(found, piece.column(1).to_pylist(), strict=True)], pa.bool_())  # ids may repeat
                yield pa.RecordBatch.from_arrays([piece.column(2), pa.array([x.tobytes() for x in found], pa.binary())], names=["at", "hashes"]).filter(own)

    def read(wanted: DataFrame, last: Callable, schema: str) -> DataFrame:
        """What ``last`` makes of (at, hashes) of some nodes."""
        chosen = wanted.select(F.col("id").alias("_id"), "node", "at")
        if chosen.count() <= MOST_BROADCAST:  # otherwise texts are shuffled by their ids
            chosen = F.broadcast(chosen)
        return texts.join(chosen, texts["doc_id"].eqNullSafe(chosen["_id"])).select("text", "node", "at").mapInArrow(lambda it: last(whole(it)), schema)

    shared = table.sparkSession.sparkContext.broadcast(_frequent(read(nodes, _counted, "key long, n long")))

    def prefixes(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, counts = shared.value
        for batch in it:
            sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column(1)]
            at, n = batch.column(0).to_numpy(), np.array([len(x) for x in sets], np.int32)
            heads = [prefix(x, frequent, counts, part) for x in sets]
            size = [len(h) for h, _ in heads]
            if sum(size):
                rows = [pa.array(np.concatenate([h for h, _ in heads]).view(np.int64)), pa.array(np.repeat(at, size)), pa.array(np.repeat(n, size)), pa.array(np.concatenate([m for _, m in heads]).astype(np.int32))]
                yield pa.RecordBatch.from_arrays([*rows, pa.nulls(sum(size), pa.binary())], names=[*_ROW, "parity"])
            # a row without a key for the set itself
            yield pa.RecordBatch.from_arrays([pa.nulls(len(n), pa.int64()), pa.array(at), pa.array(n), pa.nulls(len(n), pa.int32()), pa.array([parities(x) for x in sets], pa.binary())], names=[*_ROW, "parity"])

    heads = written(read(nodes, prefixes, "key long, node long, size int, most int, parity binary"))
    keyed, whole_sets = heads.filter("key is not null").select(*_ROW), heads.filter("key is null and size > 0").select("node", "size", "parity")
    several = keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key")
    members = written(keyed.join(several, "key").select(*_ROW))
    likely = nodes.groupBy("root").agg(F.count("*").alias("n")).filter("n > 1").select("root")
    hints = nodes.join(likely, "root").select(F.xxhash64("root").alias("key"), F.col("at").alias("node")).join(whole_sets.select("node", "size"), "node")
    hints = hints.select("key", "node", "size", F.expr(f"cast(size * {part.denominator}L div {part.numerator} as int)").alias("most"))

    def likely_pairs(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            keep = [may_be_similar(n, x, m, y, part) for n, x, m, y in zip(*(batch.column(k).to_pylist() for k in range(2, 6)), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    def verified(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            keep = [similar(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), part) for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    def compare(pairs: DataFrame) -> DataFrame:
        """The similar ones; whole sets are made of the texts of those pairs alone whose parities allow it, and travel to the second of a pair."""
        of = lambda c, *to: whole_sets.select(F.col("node").alias(c), F.col("size").alias(to[0]), F.col("parity").alias(to[1]))
        fit = pairs.join(of("a", "n", "x"), "a").join(of("b", "m", "y"), "b").select("a", "b", "n", "x", "m", "y")
        fit = written(fit.mapInArrow(likely_pairs, "a long, b long"))
        sets = lambda c: read(written(nodes.join(fit.select(F.col(c).alias("at")).distinct(), "at")), iter, "at long, hashes binary")
        left = sets("a").select(F.col("at").alias("a"), F.col("hashes").alias("x"))
        right = sets("b").select(F.col("at").alias("b"), F.col("hashes").alias("y"))
        return fit.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(verified, "a long, b long")

    roots = united(members, compare, hints).withColumnRenamed("node", "at").withColumnRenamed("root", "top")
    named = written(nodes.join(roots, "at", "left").select("node", "id", F.coalesce("top", "at").alias("top")))
    ids = named.groupBy("top").agg(F.min("id").alias("component_id"))
    return spread_join(table, named.join(ids, "top").select("node", "component_id"), ["node"])
