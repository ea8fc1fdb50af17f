"""Connected components of a graph given as edges, by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqtally.llm.common import written


def _least(edges: DataFrame) -> DataFrame:
    """For each node the least of it and its neighbours."""
    return edges.groupBy("a").agg(F.min("b").alias("least")).select("a", F.least("a", "least").alias("least"))


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of edges (a, b); root is the smallest node that can be reached.

    Each round is two aggregations with a map-side combine and two joins on their keys, written to the
    shared folder; rounds grow with the logarithm of a component's diameter.  Loops and repeated edges are
    harmless.  No edges give no rows.
    """
    both = lambda e: e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    now, before = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()), None
    for _ in range(most_rounds):
        sums = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if sums == before or not sums[0]:
            break
        before = sums
        sym = both(now)
        large = sym.join(_least(sym), "a").filter("b > a").select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()
        down = large.filter("a <> b")
        least = down.groupBy("a").agg(F.min("b").alias("least"))
        small = down.join(least, "a").filter("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b"))
        now = written(small.unionByName(least.select("a", F.col("least").alias("b"))).distinct())
    else:
        raise RuntimeError("components didn't settle")
    roots = now.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root")
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())


def linked(members: DataFrame, compare: Callable[[DataFrame], DataFrame], stars: int = 2) -> tuple[DataFrame, DataFrame]:
    """(accepted pairs, (node, root) of each node in one) among the nodes that share keys of members (key, node, times, need).

    Two nodes share a key as often as the one does that has it fewer times; pairs that share less in all than the smaller of their ``need`` are not
    compared.  ``compare`` takes distinct pairs (a, b) and gives those accepted, with columns of its own.  A star compares the nodes
    of each key with one of them, which unites a large group at a cost of its size.  Then every two nodes that
    share enough and are not united yet are compared, so any two are either in one component or were rejected.
    Rejected pairs are compared one by one: many nodes that share keys and are not alike cost the square of their number.
    """
    columns = ["key", "node", "times", "need"]
    rows, accepted, roots = members.select(columns), None, None
    for k in range(stars + 1):
        now = rows.withColumn("root", F.col("node")) if roots is None else rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        apart = now.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("key")
        now = written(now.join(apart, "key").select(*columns, "root"))
        if now.isEmpty():
            break
        if k < stars:
            order = F.struct("node") if not k else F.struct(F.xxhash64("root", F.lit(k)).alias("h"), "node")
            heads = now.groupBy("key").agg(F.min_by(F.struct("node", "root", "times", "need"), order).alias("head"))
            pairs = now.join(heads, "key").filter("root <> head.root").select(F.greatest("node", "head.node").alias("a"), F.least("node", "head.node").alias("b"), F.least("times", "head.times").alias("times"), F.least("need", "head.need").alias("need"))
        else:
            other = now.select("key", F.col("node").alias("b"), F.col("root").alias("other"), F.col("times").alias("n"), F.col("need").alias("m"))
            pairs = now.withColumnRenamed("node", "a").join(other, "key").filter("a > b and root <> other").select("a", "b", F.least("times", "n").alias("times"), F.least("need", "m").alias("need"))
        # keys whose nodes are all united are left out, but those of two nodes that are apart are all here
        pairs = pairs.groupBy("a", "b").agg(F.sum("times").alias("times"), F.min("need").alias("need")).filter("times >= need").select("a", "b")
        found = written(compare(pairs))
        accepted = found if accepted is None else accepted.unionByName(found)
        roots = written(components(accepted))
    if accepted is None:
        accepted = compare(rows.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0))
        roots = components(accepted)
    return accepted, roots
