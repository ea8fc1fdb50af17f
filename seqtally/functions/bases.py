"""Bases as Column expressions: complement, reverse complement, distances, IUPAC sets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The bases that each IUPAC code stands for, and complements.
IUPAC = {"A": "A", "C": "C", "G": "G", "T": "T", "R": "AG", "Y": "CT", "S": "CG", "W": "AT", "K": "GT", "M": "AC", "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ACGT"}
_FROM, _TO = "ACGTRYKMBDHVNSW", "TGCAYRMKVHDBNSW"


def _column(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, body) -> Column:
    """body of a value that is computed once, inside array functions."""
    return F.element_at(F.transform(F.array(value), body), 1)


def complement(x: Column | str, allow_n: bool = True, allow_iupac: bool = True) -> Column:
    """Upper-case complement of each base; anything else fails the job with ``cannot complement unknown base``."""
    x = _column(x)
    legal = "ACGT" + ("N" if allow_n else "") + ("RYKMBDHVSW" if allow_iupac else "")
    bad = F.regexp_extract(F.upper(x), f"[^{legal}]", 0)
    return F.when(F.length(bad) > 0, F.raise_error(F.concat(F.lit("cannot complement unknown base '"), bad, F.lit("'"))).cast("string")).otherwise(F.translate(F.upper(x), _FROM, _TO))


def reverse_complement(x: Column | str, strict: bool = False, allow_n: bool = True, allow_iupac: bool = True) -> Column:
    """With strict=False characters without a complement stay as they are."""
    x = _column(x)
    return F.reverse(complement(x, allow_n, allow_iupac) if strict else F.translate(F.upper(x), _FROM, _TO))


def is_standard_base(x: Column | str) -> Column:
    return _column(x).rlike("^[ACGTacgt]$")


def canonical(x: Column | str) -> Column:
    """Upper case, with N for all that isn't one of the four bases."""
    return F.regexp_replace(F.upper(_column(x)), "[^ACGT]", "N")


def packed_bases(x: Column | str) -> Column:
    """At most 15 bases as a long of four bits each, one bit for each of A, C, G, T and all four for others."""
    return F.conv(F.translate(canonical(x), "ACGTN", "1248F"), 16, 10).cast("long")


def hamming(a: Column | str, b: Column | str, length: int) -> Column:
    """Places at which two strings of ``length`` differ, unrolled so that it stays in generated code."""
    a, b = _column(a), _column(b)
    out = F.lit(0)
    for i in range(1, length + 1):
        out = out + (F.substring(a, i, 1) != F.substring(b, i, 1)).cast("int")
    return out


def reverse_complement_text(s: str) -> str:
    """On the driver, for templates and pools."""
    table = str.maketrans(_FROM, _TO)
    return s.upper().translate(table)[::-1]
