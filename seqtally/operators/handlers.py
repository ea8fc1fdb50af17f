"""Barcode designs.  Each takes reads (read_id, seq) or pairs (read_id, seq1, seq2) and gives plans:

``matches``: the accepted match of each read that has one; ``counts`` or ``combinations``: frequencies;
``summary``: one row of totals.  read_id tells reads apart and is null for none.  All checks of templates and
pools are made when a design is built; reads are checked when a plan runs.
"""

from __future__ import annotations

import pickle
from abc import ABC, abstractmethod
from collections.abc import Iterator
from dataclasses import replace
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqtally.operators.lookup import lookup, lookup_segments
from seqtally.operators.pool import BarcodePool, concatenated
from seqtally.operators.resolve import best_match, match, match_by_side
from seqtally.operators.scan import candidates, hits_in_row
from seqtally.plans.template import Template
from seqtally.schema import OK, Duplicates, Strand
from seqtally.scratch import written


class Handler(ABC):
    """A design of one's own: ``plan`` makes a DataFrame of results out of reads."""

    @abstractmethod
    def plan(self, reads: DataFrame) -> DataFrame: ...


class BatchHandler(Handler):
    """A design of one's own as a function over Arrow batches of reads; ``schema`` is that of the batches it gives.

    A batch is a part of a partition, so what needs more than one read is aggregated afterwards (``plan(...).groupBy(...)``).
    """

    schema: str

    @abstractmethod
    def process(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]: ...

    def plan(self, reads: DataFrame) -> DataFrame:
        process = self.process

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield from process(batch)

        return reads.mapInArrow(run, self.schema)


class StateHandler(Handler):
    """A design of one's own with a state: one for each partition of reads (or pairs), folded read by read and merged in order.

    A partition's place is that of its first read, by (file_no, record_no) or read_id, as FASTQ sources give them: a file or a range
    of one is a partition.  States are pickled; they are merged FAN at a time, in order, until one is left, so that no task holds all of
    them.  Without any reads the result is that of a new state.
    """

    #: Columns of the rows that ``finish`` gives.
    schema: str
    #: Whether batches have names (name, or name1 and name2) beside sequences.
    names = False
    #: States that are merged in one task, about.
    FAN = 32

    @abstractmethod
    def initialize(self) -> Any:
        """A new state."""

    @abstractmethod
    def process(self, state: Any, batch: pa.RecordBatch) -> Any:
        """The state after a batch of reads, which come in their order."""

    @abstractmethod
    def reduce(self, earlier: Any, later: Any) -> Any:
        """The state after the reads of both."""

    @abstractmethod
    def finish(self, state: Any) -> pa.Table | pa.RecordBatch: ...

    def plan(self, reads: DataFrame) -> DataFrame:
        spark = reads.sparkSession
        wanted = [c for c in (["name", "name1", "name2"] if self.names else []) + ["seq", "seq1", "seq2"] if c in reads.columns]
        order = ["file_no", "record_no"] if "file_no" in reads.columns else ["read_id"]

        def row(key: tuple, state: Any) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int64()), pa.array([key[-1]], pa.int64()), pa.array([pickle.dumps(state)], pa.binary())], names=["file", "read", "state"])

        def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            key, state = None, None
            for batch in batches:
                if not batch.num_rows:
                    continue
                if key is None:
                    key, state = tuple(batch.column(c)[0].as_py() for c in order), self.initialize()
                state = self.process(state, batch.select(wanted))
            if key is not None:
                yield row(key, state)

        def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            key, state = None, None
            for batch in batches:
                for r in batch.to_pylist():
                    other = pickle.loads(r["state"])
                    key, state = (key, self.reduce(state, other)) if key is not None else ((r["file"], r["read"]), other)
            if key is not None:
                yield row(key, state)

        def end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            states = [pickle.loads(x) for batch in batches for x in batch.column("state").to_pylist()]
            out = self.finish(states[0] if states else self.initialize())
            yield from out.to_batches() if isinstance(out, pa.Table) else [out]

        table = written(reads.select(*order, *wanted).mapInArrow(fold, "file long, read long, state binary"), "states")
        while (n := table.count()) > 1:
            ranges = table.repartitionByRange(max(1, n // self.FAN), "file", "read").sortWithinPartitions("file", "read")
            table = written(ranges.mapInArrow(merge, table.schema), "states")
        if not n:
            return spark.range(0, 1, 1, 1).select(F.lit(b"").alias("state")).mapInArrow(lambda it: (b for _ in [list(it)] for b in end(iter(()))), self.schema)
        return table.select("state").mapInArrow(end, self.schema)


def _pool(p) -> BarcodePool:
    return p if isinstance(p, BarcodePool) else BarcodePool(p)


def _template(t, strand: Strand) -> Template:
    return replace(t, strand=strand) if isinstance(t, Template) else Template(t, strand)


def _single_region(template: Template, pool: BarcodePool | None, which: str = "", message: str = "length of barcode_pool sequences ({0}) should be the same as the barcode_pool region ({1})") -> None:
    if len(template.regions) != 1:
        raise ValueError(f"expected one variable region in the {which}constant template")
    s, e = template.regions[0]
    if pool is not None and len(pool) and pool.length != e - s:
        raise ValueError(message.format(pool.length, e - s))


def dense(matches: DataFrame, pool: BarcodePool) -> DataFrame:
    """(idx, count) for every barcode of the pool, zeros included."""
    n = matches.groupBy("idx").agg(F.count("*").alias("count"))
    every = matches.sparkSession.range(len(pool)).select(F.col("id").cast("int").alias("idx"))
    return every.join(n, "idx", "left").select("idx", F.coalesce("count", F.lit(0)).alias("count"))


def total(reads: DataFrame) -> DataFrame:
    return reads.agg(F.count("*").alias("total"))


class SingleBarcode(Handler):
    """One variable region, found in single reads."""

    columns = ["idx", "position", "reverse", "mismatches", "variable_mismatches"]

    def __init__(self, template, pool, max_mismatches: int = 0, use_first: bool = True, strand: Strand = Strand.FORWARD, duplicates: Duplicates = Duplicates.ERROR, how: str | None = None):
        self.template, self.pool = _template(template, strand), _pool(pool)
        self.k, self.use_first, self.strand, self.duplicates, self.how = max_mismatches, use_first, strand, duplicates, how
        _single_region(self.template, self.pool)
        self.pool.check(duplicates)

    def hits(self, reads: DataFrame, seq: str = "seq", keys: tuple[str, ...] = ("read_id",)) -> DataFrame:
        found = lookup(candidates(reads, self.template, self.k, self.strand, seq, keys), "v0", self.pool, self.k, self.duplicates, self.how)
        found = found.filter(F.col("v0_status") == OK).withColumn("mismatches", F.col("constant_mismatches") + F.col("v0_distance"))
        return found.filter(F.col("mismatches") <= self.k).select(*keys, F.col("v0_idx").alias("idx"), "position", "reverse", "mismatches", F.col("v0_distance").alias("variable_mismatches"))

    def side_hits(self, pairs: DataFrame, sides: dict[str, str]) -> DataFrame:
        """Hits in several columns of a pair (side: column) by one scan, with the column ``side``."""
        stacked = pairs.select("read_id", F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.col(c).alias("seq")) for s, c in sides.items()])).alias("_s")).select("read_id", "_s.*")
        return self.hits(stacked, "seq", ("read_id", "side"))

    def matches(self, reads: DataFrame, seq: str = "seq") -> DataFrame:
        return match(self.hits(reads, seq), self.use_first, ["read_id"], self.columns, ["idx"])

    def counts(self, reads: DataFrame) -> DataFrame:
        return dense(self.matches(reads), self.pool)

    def summary(self, reads: DataFrame) -> DataFrame:
        return total(reads)

    plan = counts


class SingleBarcodePaired(Handler):
    """One variable region that may be in either read of a pair."""

    def __init__(self, template, pool, max_mismatches: int = 0, use_first: bool = True, strand: Strand = Strand.FORWARD, duplicates: Duplicates = Duplicates.ERROR):
        self.single = SingleBarcode(template, pool, max_mismatches, use_first, strand, duplicates)
        self.pool, self.use_first = self.single.pool, use_first

    def matches(self, pairs: DataFrame) -> DataFrame:
        hits = self.single.side_hits(pairs, {"one": "seq1", "two": "seq2"})
        both = match_by_side(hits, ["one", "two"], self.use_first, ["idx", "mismatches"], ["idx"])
        both = both.select("read_id", F.col("one.idx").alias("i1"), F.col("one.mismatches").alias("m1"), F.col("two.idx").alias("i2"), F.col("two.mismatches").alias("m2"))
        if self.use_first:
            idx = F.coalesce("i1", "i2")
        else:
            idx = F.when(F.col("i2").isNull() | (F.col("m1") < F.col("m2")), F.col("i1")).when(F.col("i1").isNull() | (F.col("m1") > F.col("m2")), F.col("i2")).when(F.col("i1") == F.col("i2"), F.col("i1"))
        return both.select("read_id", idx.alias("idx")).filter("idx is not null")

    def counts(self, pairs: DataFrame) -> DataFrame:
        return dense(self.matches(pairs), self.pool)

    def summary(self, pairs: DataFrame) -> DataFrame:
        return total(pairs)

    plan = counts


class CombinatorialBarcodes(Handler):
    """Several variable regions, each with a pool of its own, in single reads."""

    def __init__(self, template, pools, max_mismatches: int = 0, use_first: bool = True, strand: Strand = Strand.FORWARD, duplicates: Duplicates = Duplicates.ERROR):
        self.template, self.pools = _template(template, strand), [_pool(p) for p in pools]
        self.k, self.use_first, self.strand, self.duplicates = max_mismatches, use_first, strand, duplicates
        n = len(self.template.regions)
        if len(self.pools) != n:
            raise ValueError(f"length of 'barcode_pools' should be equal to the number of variable regions; expected {len(self.pools)} variable regions in the constant template")
        for i, (p, (s, e)) in enumerate(zip(self.pools, self.template.regions, strict=True)):
            if len(p) and p.length != e - s:
                raise ValueError(f"length of variable region {i + 1} ({e - s}) should be the same as its sequences ({p.length})")
            p.check(duplicates)
        self.idx = [f"idx{i + 1}" for i in range(n)]

    def set_first(self, use_first: bool = True) -> None:
        self.use_first = use_first

    def hits(self, reads: DataFrame, seq: str = "seq") -> DataFrame:
        found = candidates(reads, self.template, self.k, self.strand, seq).withColumn("mismatches", F.col("constant_mismatches"))
        for i, p in enumerate(self.pools):
            found = lookup(found, f"v{i}", p, self.k, self.duplicates).filter(F.col(f"v{i}_status") == OK)
            found = found.withColumn("mismatches", F.col("mismatches") + F.col(f"v{i}_distance")).filter(F.col("mismatches") <= self.k).drop(f"v{i}", f"v{i}_status", f"v{i}_distance")
        return found.select("read_id", *[F.col(f"v{i}_idx").alias(c) for i, c in enumerate(self.idx)], "position", "reverse", "mismatches")

    def matches(self, reads: DataFrame, seq: str = "seq") -> DataFrame:
        return match(self.hits(reads, seq), self.use_first, ["read_id"], [*self.idx, "position", "reverse", "mismatches"], self.idx)

    def combinations(self, reads: DataFrame) -> DataFrame:
        return self.matches(reads).groupBy(*self.idx).agg(F.count("*").alias("count"))

    def summary(self, reads: DataFrame) -> DataFrame:
        return total(reads)

    plan = combinations


class CombinatorialBarcodesPaired(Handler):
    """A barcode of one pool on one read of a pair and of another pool on the other."""

    def __init__(self, template1, pool1, template2, pool2, max_mismatches1: int = 0, max_mismatches2: int = 0, use_first: bool = True, strand1: Strand = Strand.FORWARD, strand2: Strand = Strand.FORWARD, duplicates: Duplicates = Duplicates.ERROR, random: bool = False):
        self.one = SingleBarcode(template1, pool1, max_mismatches1, use_first, strand1, duplicates)
        self.two = SingleBarcode(template2, pool2, max_mismatches2, use_first, strand2, duplicates)
        self.use_first, self.random = use_first, random

    def outcomes(self, pairs: DataFrame) -> DataFrame:
        """(read_id, kind, idx1, idx2) of pairs with a barcode; kind is combination, barcode1_only or barcode2_only."""
        one, two = {"m1": "seq1"}, {"m2": "seq2"}
        if self.random:
            one["n1"], two["n2"] = "seq2", "seq1"
        hits = self.one.side_hits(pairs, one).unionByName(self.two.side_hits(pairs, two))
        out = match_by_side(hits, [*one, *two], self.use_first, ["idx", "mismatches"], ["idx"])
        has = lambda c: F.col(c).isNotNull()
        idx = lambda c: F.col(f"{c}.idx")
        mm = lambda c: F.col(f"{c}.mismatches")
        combo = lambda a, b: F.struct(F.lit("combination").alias("kind"), idx(a).alias("idx1"), idx(b).alias("idx2"))
        nothing = F.lit(None).cast("int")
        only = lambda kind: F.struct(F.lit(kind).alias("kind"), nothing.alias("idx1"), nothing.alias("idx2"))
        if not self.random:
            result = F.when(has("m1") & has("m2"), combo("m1", "m2")).when(has("m1"), only("barcode1_only")).when(has("m2"), only("barcode2_only"))
        else:
            m, n = has("m1") & has("m2"), has("n1") & has("n2")
            result: Column
            if self.use_first:
                result = F.when(m, combo("m1", "m2"))
            else:
                a, b = mm("m1") + mm("m2"), mm("n1") + mm("n2")
                same = (idx("m1") == idx("n1")) & (idx("m2") == idx("n2"))
                result = F.when(m & n & (a < b), combo("m1", "m2")).when(m & n & (a > b), combo("n1", "n2")).when(m & n & same, combo("m1", "m2")).when(m & n, only("none")).when(m, combo("m1", "m2"))
            result = result.when(n, combo("n1", "n2")).when(has("m1") | has("n1"), only("barcode1_only")).when(has("m2") | has("n2"), only("barcode2_only"))
        return out.select("read_id", result.alias("r")).select("read_id", "r.*").filter("kind <> 'none'")

    def combinations(self, pairs: DataFrame) -> DataFrame:
        return self.outcomes(pairs).filter("kind = 'combination'").groupBy("idx1", "idx2").agg(F.count("*").alias("count"))

    def summary(self, pairs: DataFrame) -> DataFrame:
        kinds = self.outcomes(pairs).agg(F.count_if(F.col("kind") == "barcode1_only").alias("barcode1_only"), F.count_if(F.col("kind") == "barcode2_only").alias("barcode2_only"))
        return total(pairs).join(F.broadcast(kinds), F.lit(True))  # one row beside one row

    plan = combinations


class DualBarcodes(Handler):
    """One or more regions in single reads that together have to be one of a list of valid tuples."""

    def __init__(self, template, pools, max_mismatches: int = 0, use_first: bool = True, strand: Strand = Strand.FORWARD, duplicates: Duplicates = Duplicates.ERROR):
        self.template, pools = _template(template, strand), [_pool(p) for p in pools]
        self.k, self.use_first, self.strand, self.duplicates = max_mismatches, use_first, strand, duplicates
        if len(pools) != len(self.template.regions):
            raise ValueError("length of 'barcode_pools' should equal the number of variable regions")
        for i, (p, (s, e)) in enumerate(zip(pools, self.template.regions, strict=True)):
            if len(p) and p.length != e - s:
                raise ValueError(f"length of variable region {i + 1} ({e - s}) should be the same as its sequences ({p.length})")
        self.pool = concatenated(pools)
        self.pool.check(duplicates)

    def matches(self, reads: DataFrame, seq: str = "seq") -> DataFrame:
        found = candidates(reads, self.template, self.k, self.strand, seq)
        found = found.withColumn("v", F.concat(*[f"v{i}" for i in range(len(self.template.regions))]))
        found = lookup(found, "v", self.pool, self.k, self.duplicates).filter(F.col("v_status") == OK)
        found = found.withColumn("mismatches", F.col("constant_mismatches") + F.col("v_distance")).filter(F.col("mismatches") <= self.k)
        found = found.select("read_id", F.col("v_idx").alias("idx"), "position", "reverse", "mismatches", F.col("v_distance").alias("variable_mismatches"))
        return match(found, self.use_first, ["read_id"], SingleBarcode.columns, ["idx"])

    def counts(self, reads: DataFrame) -> DataFrame:
        return dense(self.matches(reads), self.pool)

    def summary(self, reads: DataFrame) -> DataFrame:
        return total(reads)

    plan = counts


class DualBarcodesPaired(Handler):
    """A region on each read of a pair that together have to be one of a list of valid pairs."""

    def __init__(self, template1, pool1, template2, pool2, max_mismatches1: int = 0, max_mismatches2: int = 0, use_first: bool = True, strand1: Strand = Strand.FORWARD, strand2: Strand = Strand.FORWARD, duplicates: Duplicates = Duplicates.ERROR, random: bool = False):
        if Strand.BOTH in (strand1, strand2):
            raise ValueError("searching both strands is not supported for paired dual barcodes")
        self.t1, self.t2, self.p1, self.p2 = _template(template1, strand1), _template(template2, strand2), _pool(pool1), _pool(pool2)
        self.k1, self.k2, self.use_first, self.duplicates, self.random = max_mismatches1, max_mismatches2, use_first, duplicates, random
        if len(self.p1) != len(self.p2):
            raise ValueError("both barcode pools should be of the same length")
        for t, p, which in ((self.t1, self.p1, "first "), (self.t2, self.p2, "second ")):
            _single_region(t, p, which, "length of variable sequences ({0}) should be the same as the variable region ({1})")
        self.pool = concatenated([self.p1, self.p2], "both barcode pools should be of the same length")
        self.pool.check(duplicates)

    def _hits(self, pairs: DataFrame) -> DataFrame:
        """(read_id, swapped, position1, position2, idx, mismatches) of every pair of places with a valid barcode."""
        keys = ("read_id", "swapped")
        side = lambda swapped: F.struct(
            F.lit(swapped).alias("swapped"),
            hits_in_row("seq2" if swapped else "seq1", self.t1, self.k1, self.t1.strand is Strand.REVERSE).alias("one"),
            hits_in_row("seq1" if swapped else "seq2", self.t2, self.k2, self.t2.strand is Strand.REVERSE).alias("two"),
        )
        sides = pairs.select("read_id", F.explode(F.array(*[side(s) for s in ((False, True) if self.random else (False,))])).alias("side")).select("read_id", "side.*")
        one = sides.filter("size(one) > 0 and size(two) > 0").select(*keys, F.explode("one").alias("one"), "two")
        both = one.select(*keys, "one", F.explode("two").alias("two"))
        found = both.select(*keys, F.col("one.position").alias("position1"), F.col("one.v").alias("a"), F.col("one.mismatches").alias("c1"), F.col("two.position").alias("position2"), F.col("two.v").alias("b"), F.col("two.mismatches").alias("c2"))
        found = found.withColumns({"left1": F.lit(self.k1) - F.col("c1"), "left2": F.lit(self.k2) - F.col("c2")})
        found = lookup_segments(found, [("a", self.p1, "left1"), ("b", self.p2, "left2")], self.duplicates, [self.k1, self.k2])
        return found.filter(F.col("status") == OK).select(*keys, "position1", "position2", "idx", (F.col("c1") + F.col("c2") + F.col("distance")).alias("mismatches"))

    def matches(self, pairs: DataFrame) -> DataFrame:
        """(read_id, idx, mismatches, swapped)."""
        columns = ["idx", "mismatches", "swapped", "position1", "position2"]
        hits = self._hits(pairs)
        if self.use_first:
            return match(hits, True, ["read_id"], columns, ["idx"], ("swapped", "position1", "position2")).select("read_id", *columns[:3])
        lo, hi = F.min(F.struct("mismatches", "idx")).alias("lo"), F.max(F.struct((-F.col("mismatches")).alias("m"), "idx")).alias("hi")
        side = hits.groupBy("read_id", "swapped").agg(lo, hi)
        side = side.select("read_id", "swapped", F.col("lo.mismatches").alias("mismatches"), F.when(F.col("lo.idx") == F.col("hi.idx"), F.col("lo.idx")).alias("idx"))
        if not self.random:
            return side.filter("idx is not null").select("read_id", "idx", "mismatches", "swapped")
        at = lambda swapped: F.max(F.when(F.col("swapped") == swapped, F.struct("mismatches", "idx")))
        both = side.groupBy("read_id").agg(at(False).alias("x"), at(True).alias("y"))
        none = F.lit(self.k1 + self.k2 + 1)
        x_mm, y_mm = F.coalesce("x.mismatches", none), F.coalesce("y.mismatches", none)
        take_y = F.col("x.idx").isNull() | (x_mm > y_mm)
        torn = ~take_y & (x_mm == y_mm) & ~F.col("x.idx").eqNullSafe(F.col("y.idx"))
        chosen = F.when(take_y, F.col("y.idx")).when(~torn, F.col("x.idx"))
        return both.select("read_id", chosen.alias("idx"), F.when(take_y, y_mm).otherwise(x_mm).alias("mismatches"), take_y.alias("swapped")).filter("idx is not null")

    def counts(self, pairs: DataFrame) -> DataFrame:
        return dense(self.matches(pairs), self.pool)

    def summary(self, pairs: DataFrame) -> DataFrame:
        return total(pairs)

    plan = counts


class DualBarcodesPairedDiagnostics(Handler):
    """DualBarcodesPaired and, for pairs without a valid barcode, the combinations that they hold instead."""

    def __init__(self, template1, pool1, template2, pool2, **options):
        self.dual = DualBarcodesPaired(template1, pool1, template2, pool2, **options)
        self.combo = CombinatorialBarcodesPaired(template1, pool1, template2, pool2, **(options | {"duplicates": Duplicates.FIRST}))

    def _rest(self, pairs: DataFrame) -> DataFrame:
        return pairs.join(self.dual.matches(pairs).select("read_id"), "read_id", "left_anti")

    def counts(self, pairs: DataFrame) -> DataFrame:
        return self.dual.counts(pairs)

    def combinations(self, pairs: DataFrame) -> DataFrame:
        return self.combo.combinations(self._rest(pairs))

    def summary(self, pairs: DataFrame) -> DataFrame:
        return total(pairs).join(F.broadcast(self.combo.summary(self._rest(pairs)).drop("total")), F.lit(True))

    plan = combinations


class DualBarcodesDiagnostics(Handler):
    """DualBarcodes and, for reads without a valid barcode, the combinations that they hold instead."""

    def __init__(self, template, pools, **options):
        pools = [_pool(p) for p in pools]
        self.dual = DualBarcodes(template, pools, **options)
        self.combo = CombinatorialBarcodes(template, pools, **(options | {"duplicates": Duplicates.FIRST}))

    def counts(self, reads: DataFrame) -> DataFrame:
        return self.dual.counts(reads)

    def combinations(self, reads: DataFrame) -> DataFrame:
        return self.combo.combinations(reads.join(self.dual.matches(reads).select("read_id"), "read_id", "left_anti"))

    def summary(self, reads: DataFrame) -> DataFrame:
        return total(reads)

    plan = combinations


class RandomBarcode(Handler):
    """No pool: the variable region itself is counted."""

    def __init__(self, template, max_mismatches: int = 0, use_first: bool = True, strand: Strand = Strand.FORWARD):
        self.template = _template(template, strand)
        self.k, self.use_first, self.strand = max_mismatches, use_first, strand
        _single_region(self.template, None)

    def matches(self, reads: DataFrame, seq: str = "seq") -> DataFrame:
        hits = candidates(reads, self.template, self.k, self.strand, seq, raw=True).withColumnRenamed("constant_mismatches", "mismatches").withColumnRenamed("v0", "barcode")
        columns = ["barcode", "position", "reverse", "mismatches"]
        if self.use_first:
            return match(hits, True, ["read_id"], columns, [])
        return best_match(hits, ["read_id"], columns, ["position", "reverse"], ["position", "reverse"])

    def counts(self, reads: DataFrame) -> DataFrame:
        return self.matches(reads).groupBy("barcode").agg(F.count("*").alias("count"))

    def summary(self, reads: DataFrame) -> DataFrame:
        return total(reads)

    plan = counts
