"""What a design finds in a read or pair, as one expression of its row.

Hits, the nearest barcodes and the choice among hits are array functions, so all results of a design come from one scan and one
aggregation, in batches and in streams alike.  Barcodes are compared one by one, so pools have MOST_BRUTE barcodes at most.
``tally`` finds the same by array operations over many reads (``arrays``) where a design has one read and pools.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqtally.functions.bases import IUPAC, canonical, let, reverse_complement
from seqtally.operators import arrays
from seqtally.operators import handlers as H
from seqtally.operators.lookup import MOST_BRUTE, nearest_in_row
from seqtally.operators.pool import BarcodePool
from seqtally.operators.scan import _fits, constant_mismatches
from seqtally.plans.template import Template
from seqtally.schema import Duplicates

MATCH, COMBINATION, ONE_ONLY, TWO_ONLY = "match", "combination", "barcode1_only", "barcode2_only"


def places(seq: str, template: Template, most: int, flags: tuple[bool, ...], raw: bool = False) -> Column:
    """An array of struct(position, reverse, mismatches, regions): where the constant bases fit, with the regions in the template's direction."""
    n, upper = len(template), F.upper(seq)
    every = F.when(F.length(seq) >= n, F.sequence(F.lit(0), F.length(seq) - n)).otherwise(F.array().cast("array<int>"))
    window = lambda p: F.substr(upper, p + 1, F.lit(n))

    def side(reverse: bool) -> Column:
        quick = _fits(F.lit(""), template, reverse, most) is not None
        at = F.filter(every, lambda p: _fits(window(p), template, reverse, most)) if quick else every

        def regions(w: Column) -> Column:
            if not reverse:
                cut = [F.substring(w, s + 1, e - s) for s, e in template.regions]
            elif raw:
                cut = [reverse_complement(F.substring(w, n - e + 1, e - s), strict=True, allow_iupac=False) for s, e in template.regions]
            else:
                cut = [reverse_complement(F.substring(w, n - e + 1, e - s)) for s, e in template.regions]
            return F.array(*(c if raw else canonical(c) for c in cut))

        near = F.filter(F.transform(at, lambda p: F.struct(p.alias("position"), constant_mismatches(window(p), template, reverse).alias("mismatches"))), lambda h: h["mismatches"] <= most)
        text = lambda p: F.substr(F.col(seq), p + 1, F.lit(n)) if raw else window(p)
        return F.transform(near, lambda h: F.struct(h["position"].alias("position"), F.lit(reverse).alias("reverse"), h["mismatches"].alias("mismatches"), regions(text(h["position"])).alias("regions")))

    sides = [side(r) for r in flags]
    return sides[0] if len(sides) == 1 else F.concat(*sides)


def _picked(near: Column, duplicates: Duplicates) -> Column:
    """The barcode of struct(distance, first, last), null if it is disputed."""
    if duplicates is Duplicates.FIRST:
        return near["first"]
    if duplicates is Duplicates.LAST:
        return near["last"]
    return F.when(near["first"] == near["last"], near["first"])


def _within(pool: BarcodePool) -> BarcodePool:
    if len(pool) > MOST_BRUTE:
        raise ValueError(f"a pool of over {MOST_BRUTE} barcodes is too large to be compared inside a row")
    return pool


def scored(found: Column, pools: list[BarcodePool], most: int, duplicates: Duplicates) -> Column:
    """An array of struct(mismatches, position, reverse, idx) of the places whose regions have barcodes within ``most`` in all; idx is an array."""
    if not all(len(_within(p)) for p in pools):
        found = F.slice(found, 1, 0)
        pools = [p if len(p) else BarcodePool(["A"]) for p in pools]
    near = F.transform(found, lambda h: F.struct(h.alias("h"), F.array(*(nearest_in_row(h["regions"][i], p) for i, p in enumerate(pools))).alias("near")))
    total = lambda x: reduce(Column.__add__, (x["near"][i]["distance"] for i in range(len(pools))), x["h"]["mismatches"])
    made = F.transform(near, lambda x: F.struct(total(x).alias("mismatches"), x["h"]["position"].alias("position"), x["h"]["reverse"].alias("reverse"), F.array(*(_picked(x["near"][i], duplicates) for i in range(len(pools)))).alias("idx")))
    return F.filter(made, lambda x: (x["mismatches"] <= most) & ~F.exists(x["idx"], lambda i: i.isNull()))


def resolved(hits: Column, use_first: bool, order: tuple[str, ...], same: Callable[[Column], Column], value: str = "idx") -> Column:
    """struct(mismatches, value) of the first hit by ``order``, or of the best one unless hits as good differ in ``same``; null if there is none."""
    top = lambda some: let(F.array_min(F.transform(some, lambda h: F.struct(*(h[c].alias(c) for c in order), h["mismatches"].alias("mismatches"), h[value].alias(value)))), lambda m: F.when(m.isNotNull(), F.struct(m["mismatches"].alias("mismatches"), m[value].alias(value))))
    if use_first:
        return top(hits)
    least = lambda all_: let(F.array_min(F.transform(all_, lambda h: h["mismatches"])), lambda lo: F.filter(all_, lambda h: h["mismatches"] == lo))
    return let(hits, lambda all_: let(least(all_), lambda best: F.when(F.size(F.array_distinct(F.transform(best, same))) == 1, top(best))))


_ORDER = ("position", "reverse")


def _single(d: H.SingleBarcode, seq: str) -> Column:
    hits = scored(places(seq, d.template, d.k, d.strand.reversed_flags), [d.pool], d.k, d.duplicates)
    return resolved(hits, d.use_first, _ORDER, lambda h: h["idx"])


def _combined(d: H.CombinatorialBarcodes, seq: str = "seq") -> Column:
    hits = scored(places(seq, d.template, d.k, d.strand.reversed_flags), d.pools, d.k, d.duplicates)
    return resolved(hits, d.use_first, _ORDER, lambda h: h["idx"])


def _joined(d: H.DualBarcodes, seq: str = "seq") -> Column:
    found = F.transform(places(seq, d.template, d.k, d.strand.reversed_flags), lambda h: F.struct(h["position"].alias("position"), h["reverse"].alias("reverse"), h["mismatches"].alias("mismatches"), F.array(F.array_join(h["regions"], "")).alias("regions")))
    return resolved(scored(found, [d.pool], d.k, d.duplicates), d.use_first, _ORDER, lambda h: h["idx"])


def _tuples(d: H.DualBarcodesPaired) -> Column:
    """struct(mismatches, idx) of a pair against the valid tuples, on both sides if mates may be swapped."""
    sets = lambda s: F.array(*[F.lit(IUPAC[c]) for c in s.upper()])
    if not len(_within(d.pool)):
        return F.lit(None).cast("struct<mismatches: int, idx: array<int>>")
    every = F.array(*[F.struct(F.lit(i).alias("idx"), sets(a).alias("a"), sets(b).alias("b")) for i, (a, b) in enumerate(zip(d.p1.sequences, d.p2.sequences, strict=True))])
    far = lambda bases, codes: F.aggregate(F.zip_with(bases, codes, lambda x, y: F.when(F.instr(y, x) > 0, 0).otherwise(1)), F.lit(0), lambda n, x: n + x)

    def near(x: Column, y: Column) -> Column:
        """The hit of two places: the nearest tuple of which either part is within what its place leaves."""
        apart = let(F.split(x["regions"][0], ""), lambda a: let(F.split(y["regions"][0], ""), lambda b: F.transform(every, lambda t: F.struct(far(a, t["a"]).alias("d1"), far(b, t["b"]).alias("d2"), t["idx"].alias("idx")))))
        fit = F.filter(apart, lambda t: (t["d1"] + x["mismatches"] <= d.k1) & (t["d2"] + y["mismatches"] <= d.k2))
        both = F.transform(fit, lambda t: F.struct((t["d1"] + t["d2"]).alias("distance"), t["idx"].alias("idx")))

        def chosen(all_: Column) -> Column:
            last = lambda lo: F.array_max(F.transform(F.filter(all_, lambda t: t["distance"] == lo["distance"]), lambda t: t["idx"]))
            return let(F.array_min(all_), lambda lo: F.struct(lo["distance"].alias("distance"), lo["idx"].alias("first"), last(lo).alias("last")))

        hit = lambda m: F.struct((m["distance"] + x["mismatches"] + y["mismatches"]).alias("mismatches"), x["position"].alias("position1"), y["position"].alias("position2"), F.array(_picked(m, d.duplicates)).alias("idx"))
        return let(let(both, chosen), hit)

    def side(swapped: bool) -> Column:
        one = places("seq2" if swapped else "seq1", d.t1, d.k1, d.t1.strand.reversed_flags)
        two = places("seq1" if swapped else "seq2", d.t2, d.k2, d.t2.strand.reversed_flags)
        found = let(two, lambda ys: F.flatten(F.transform(one, lambda x: F.transform(ys, lambda y: near(x, y)))))
        found = F.transform(found, lambda h: F.struct(F.lit(swapped).alias("swapped"), h["position1"].alias("position1"), h["position2"].alias("position2"), h["mismatches"].alias("mismatches"), h["idx"].alias("idx")))
        return F.filter(found, lambda h: h["mismatches"].isNotNull() & h["idx"][0].isNotNull())

    order = ("swapped", "position1", "position2")
    if d.use_first:
        hits = F.concat(side(False), side(True)) if d.random else side(False)
        return resolved(hits, True, order, lambda h: h["idx"])
    if not d.random:
        return resolved(side(False), False, order, lambda h: h["idx"])

    # a side that is torn between tuples still has its mismatches
    least = lambda hits: let(hits, lambda all_: F.struct(F.array_min(F.transform(all_, lambda h: h["mismatches"])).alias("mismatches"), resolved(all_, False, order, lambda h: h["idx"])["idx"].alias("idx")))

    def between(x: Column, y: Column) -> Column:
        none = F.lit(d.k1 + d.k2 + 1)
        a, b = F.coalesce(x["mismatches"], none), F.coalesce(y["mismatches"], none)
        take_y = x["idx"].isNull() | (a > b)
        torn = ~take_y & (a == b) & ~x["idx"].eqNullSafe(y["idx"])
        idx = F.when(take_y, y["idx"]).when(~torn, x["idx"])
        return F.when(idx.isNotNull(), F.struct(F.when(take_y, b).otherwise(a).alias("mismatches"), idx.alias("idx")))

    return let(least(side(False)), lambda x: let(least(side(True)), lambda y: between(x, y)))


def _result(kind: str | None, columns: list[str], values: dict[str, Column]) -> Column:
    return F.struct(F.lit(kind).cast("string").alias("kind"), *(values.get(c, F.lit(None).cast("int")).alias(c) for c in columns))


def _paired_combination(d: H.CombinatorialBarcodesPaired, columns: list[str]) -> Column:
    one, two = _single(d.one, "seq1"), _single(d.two, "seq2")
    combo = lambda a, b: _result(COMBINATION, columns, {"idx1": a["idx"][0], "idx2": b["idx"][0]})
    only = lambda kind: _result(kind, columns, {})
    if not d.random:
        return let(F.struct(one.alias("m1"), two.alias("m2")), lambda r: F.when(r["m1"].isNotNull() & r["m2"].isNotNull(), combo(r["m1"], r["m2"])).when(r["m1"].isNotNull(), only(ONE_ONLY)).when(r["m2"].isNotNull(), only(TWO_ONLY)))

    def chosen(r: Column) -> Column:
        m1, m2, n1, n2 = (r[c] for c in ("m1", "m2", "n1", "n2"))
        m, n = m1.isNotNull() & m2.isNotNull(), n1.isNotNull() & n2.isNotNull()
        if d.use_first:
            out = F.when(m, combo(m1, m2))
        else:
            a, b = m1["mismatches"] + m2["mismatches"], n1["mismatches"] + n2["mismatches"]
            same = (m1["idx"] == n1["idx"]) & (m2["idx"] == n2["idx"])
            out = F.when(m & n & (a < b), combo(m1, m2)).when(m & n & (a > b), combo(n1, n2)).when(m & n & same, combo(m1, m2)).when(m & n, only(None)).when(m, combo(m1, m2))
        return out.when(n, combo(n1, n2)).when(m1.isNotNull() | n1.isNotNull(), only(ONE_ONLY)).when(m2.isNotNull() | n2.isNotNull(), only(TWO_ONLY))

    return let(F.struct(one.alias("m1"), two.alias("m2"), _single(d.one, "seq2").alias("n1"), _single(d.two, "seq1").alias("n2")), chosen)


def _either(d: H.SingleBarcodePaired) -> Column:
    def chosen(r: Column) -> Column:
        x, y = r["x"], r["y"]
        if d.use_first:
            return F.coalesce(x["idx"], y["idx"])
        return F.when(y.isNull() | (x["mismatches"] < y["mismatches"]), x["idx"]).when(x.isNull() | (x["mismatches"] > y["mismatches"]), y["idx"]).when(x["idx"] == y["idx"], x["idx"])

    return let(F.struct(_single(d.single, "seq1").alias("x"), _single(d.single, "seq2").alias("y")), chosen)


def columns_of(design: H.Handler) -> list[str]:
    """The columns that tell one result of a design from another."""
    if isinstance(design, H.RandomBarcode):
        return ["barcode"]
    if isinstance(design, H.CombinatorialBarcodes):
        return design.idx
    if isinstance(design, H.CombinatorialBarcodesPaired):
        return ["idx1", "idx2"]
    if isinstance(design, H.DualBarcodesPairedDiagnostics | H.DualBarcodesDiagnostics):
        return ["idx", *columns_of(design.combo)]
    return ["idx"]


def outcome(design: H.Handler) -> Column:
    """struct(kind, columns of the result), null where a read or pair has none.

    kind: match, combination, barcode1_only or barcode2_only.
    """
    columns = columns_of(design)
    match = lambda idx: F.when(idx.isNotNull(), _result(MATCH, columns, {"idx": idx[0]}))
    if isinstance(design, H.SingleBarcode):
        return match(_single(design, "seq")["idx"])
    if isinstance(design, H.SingleBarcodePaired):
        return match(_either(design))
    if isinstance(design, H.DualBarcodes):
        return match(_joined(design)["idx"])
    if isinstance(design, H.DualBarcodesPaired):
        return match(_tuples(design)["idx"])
    if isinstance(design, H.CombinatorialBarcodes):
        return let(_combined(design), lambda m: F.when(m.isNotNull(), _result(COMBINATION, columns, {c: m["idx"][i] for i, c in enumerate(columns)})))
    if isinstance(design, H.CombinatorialBarcodesPaired):
        return _paired_combination(design, columns)
    if isinstance(design, H.DualBarcodesPairedDiagnostics):
        return F.coalesce(match(_tuples(design.dual)["idx"]), _paired_combination(design.combo, columns))
    if isinstance(design, H.DualBarcodesDiagnostics):
        rest = let(_combined(design.combo), lambda m: F.when(m.isNotNull(), _result(COMBINATION, columns, {c: m["idx"][i] for i, c in enumerate(design.combo.idx)})))
        return F.coalesce(match(_joined(design.dual)["idx"]), rest)
    if isinstance(design, H.RandomBarcode):
        hits = F.transform(places("seq", design.template, design.k, design.strand.reversed_flags, raw=True), lambda h: F.struct(h["mismatches"].alias("mismatches"), h["position"].alias("position"), h["reverse"].alias("reverse"), h["regions"][0].alias("barcode")))
        found = resolved(hits, design.use_first, _ORDER, lambda h: F.struct(h["position"], h["reverse"]), "barcode")
        return let(found, lambda m: F.when(m.isNotNull(), F.struct(F.lit(MATCH).alias("kind"), m["barcode"].alias("barcode"))))
    raise TypeError(f"no outcome inside a row for {type(design).__name__}")


def _steps(design: H.Handler) -> list[tuple[str, list[str], arrays.Single]] | None:
    """(kind, columns, what finds them) of a design of single reads with pools, in the order in which they count; None for others."""
    if isinstance(design, H.SingleBarcode):
        return [(MATCH, ["idx"], arrays.Single(design.template, design.k, design.strand.reversed_flags, [_within(design.pool)], design.duplicates, design.use_first))]
    if isinstance(design, H.DualBarcodes):
        return [(MATCH, ["idx"], arrays.Single(design.template, design.k, design.strand.reversed_flags, [_within(design.pool)], design.duplicates, design.use_first, joined=True))]
    if isinstance(design, H.CombinatorialBarcodes):
        return [(COMBINATION, design.idx, arrays.Single(design.template, design.k, design.strand.reversed_flags, [_within(p) for p in design.pools], design.duplicates, design.use_first))]
    if isinstance(design, H.DualBarcodesDiagnostics):
        return [*_steps(design.dual), *_steps(design.combo)]
    return None


def tally(reads: DataFrame, design: H.Handler, weight: str | None = None) -> DataFrame:
    """(kind, columns of the result, count): all results of a design from one scan and one aggregation.

    Reads without a result are counted under a null kind, so the counts add up to all reads.  Of a stream this is its only aggregation, for the
    output modes update and complete.  ``weight``: a column that says how many reads a row stands for.
    """
    columns, steps = columns_of(design), _steps(design)
    if steps is not None:
        # upper case is Spark's, as in the row: a character may become two
        given = reads.select(F.upper("seq").alias("text"), F.length("seq").alias("letters"), *([F.col(weight).cast("long").alias("_w")] if weight else []))
        found = given.mapInArrow(partial(arrays.outcomes, steps, columns, weight is not None), ", ".join(["kind string", *(f"{c} int" for c in columns), "_w long"]))
        return found.groupBy("kind", *columns).agg(F.sum("_w").alias("count"))
    made = reads.select(outcome(design).alias("_o"), (F.col(weight) if weight else F.lit(1)).cast("long").alias("_w"))
    return made.select("_o.kind", *(f"_o.{c}" for c in columns), "_w").groupBy("kind", *columns).agg(F.sum("_w").alias("count"))


def counts_of(tallied: DataFrame, design: H.Handler) -> DataFrame:
    """The frequencies that ``design.plan`` gives, from a tally."""
    if isinstance(design, H.CombinatorialBarcodes | H.CombinatorialBarcodesPaired):
        return tallied.filter(F.col("kind") == COMBINATION).select(*columns_of(design), "count")
    if isinstance(design, H.DualBarcodesPairedDiagnostics | H.DualBarcodesDiagnostics):
        return tallied.filter(F.col("kind") == COMBINATION).select(*columns_of(design.combo), "count")
    found = tallied.filter(F.col("kind") == MATCH)
    if isinstance(design, H.RandomBarcode):
        return found.select("barcode", "count")
    pool = design.pool
    every = tallied.sparkSession.range(len(pool)).select(F.col("id").cast("int").alias("idx"))
    return every.join(found.select("idx", "count"), "idx", "left").select("idx", F.coalesce("count", F.lit(0)).alias("count"))


def folded(reads: DataFrame) -> DataFrame:
    """Equal reads (or pairs) as one row, with their number as ``weight``: worth its shuffle where most reads have copies."""
    sides = [c for c in ("seq", "seq1", "seq2") if c in reads.columns]
    return reads.groupBy(*sides).agg(F.count("*").alias("weight"))
