"""Template scan: the places of a read whose constant bases fit, and the variable regions there."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqtally.functions.bases import canonical, let, reverse_complement
from seqtally.plans.template import Template
from seqtally.schema import Strand


def spread(df: DataFrame) -> DataFrame:
    """Deals rows out where a scan has fewer pieces than there are cores: windows are many times the reads."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def constant_mismatches(window: Column, template: Template, reverse: bool) -> Column:
    """Constant bases that a window of the template's length doesn't have; each base that isn't ACGT is one."""
    out = F.lit(0)
    for at, base in template.constants(reverse):
        out = out + (F.substring(window, at + 1, 1) != F.lit(base)).cast("int")
    return out


def _fits(window: Column, template: Template, reverse: bool, most: int) -> Column | None:
    """For few mismatches a test that is cheaper than counting: one of most + 1 groups of segments is exact."""
    segments = template.segments(reverse)
    if len(segments) <= most:
        return None
    tests = [F.substring(window, at + 1, len(bases)) == F.lit(bases) for at, bases in segments]
    if most == 0:
        out = tests[0]
        for t in tests[1:]:
            out = out & t
        return out
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def candidates(reads: DataFrame, template: Template, max_mismatches: int, strand: Strand, seq: str = "seq", keys: tuple[str, ...] = ("read_id",), raw: bool = False) -> DataFrame:
    """keys, position, reverse, constant_mismatches and v0, v1, ...: the variable regions in the template's direction.

    One row for each place and strand with at most max_mismatches constant mismatches, found before anything is
    shuffled.  Regions are upper case with N for what isn't a base; raw=True keeps forward ones as read and
    fails on reverse ones that have no complement.  Reads shorter than the template, and null ones, give no rows.
    """
    n = len(template)
    flags = strand.reversed_flags
    fit = reads.filter(F.length(seq) >= n).select(*keys, F.col(seq).alias("_seq"), F.upper(seq).alias("_upper"))
    # windows are cut in the generator: as its output they are made once, whatever tests refer to them
    places = F.transform(F.sequence(F.lit(0), F.length("_seq") - n), lambda p: F.struct(p.alias("position"), F.substr("_upper", p + 1, F.lit(n)).alias("window")))
    slid = fit.select(*keys, "_seq", F.explode(places).alias("_at")).select(*keys, "_seq", F.col("_at.position").alias("position"), F.col("_at.window").alias("_window"))
    window = F.col("_window")
    quick = [_fits(window, template, r, max_mismatches) for r in flags]
    if all(q is not None for q in quick):
        slid = slid.filter(quick[0] if len(quick) == 1 else quick[0] | quick[1])
    count = [constant_mismatches(window, template, r) for r in flags]
    if len(flags) == 1:
        hits = slid.withColumn("reverse", F.lit(flags[0])).withColumn("constant_mismatches", count[0])
    else:
        sides = F.array(*[F.struct(F.lit(r).alias("reverse"), c.alias("constant_mismatches")) for r, c in zip(flags, count, strict=True)])
        hits = slid.select("*", F.explode(sides).alias("_side")).select("*", "_side.*")
    hits = hits.filter(F.col("constant_mismatches") <= max_mismatches)
    whole = F.expr(f"substring(_seq, position + 1, {n})") if raw else window
    regions = []
    for i, (s, e) in enumerate(template.regions):
        forward = F.substring(whole, s + 1, e - s)
        backward = F.substring(whole, n - e + 1, e - s)
        backward = reverse_complement(backward, strict=True, allow_iupac=False) if raw else reverse_complement(backward)
        v = forward if flags == (False,) else backward if flags == (True,) else F.when(F.col("reverse"), backward).otherwise(forward)
        regions.append((v if raw else canonical(v)).alias(f"v{i}"))
    return hits.select(*keys, "position", "reverse", "constant_mismatches", *regions)


def hits_in_row(seq: str, template: Template, max_mismatches: int, reverse: bool) -> Column:
    """An array of struct(position, v, mismatches): the hits of a template of one region, found inside the row.

    They are those of ``candidates``, for one strand, without a row for each place.
    """
    n, (s, e) = len(template), template.regions[0]
    places = F.when(F.length(seq) >= n, F.sequence(F.lit(0), F.length(seq) - n)).otherwise(F.array().cast("array<int>"))
    upper = F.upper(seq)
    window = lambda p: F.substr(upper, p + 1, F.lit(n))
    quick = _fits(F.lit(""), template, reverse, max_mismatches) is not None
    at = F.filter(places, lambda p: _fits(window(p), template, reverse, max_mismatches)) if quick else places
    cut = lambda w: canonical(reverse_complement(F.substring(w, n - e + 1, e - s)) if reverse else F.substring(w, s + 1, e - s))
    found = F.transform(at, lambda p: let(window(p), lambda w: F.struct(p.alias("position"), cut(w).alias("v"), constant_mismatches(w, template, reverse).alias("mismatches"))))
    return F.filter(found, lambda h: h["mismatches"] <= max_mismatches)
