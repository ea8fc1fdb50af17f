"""Reads made from the driver's tables, by expressions that Spark and DuckDB share.

Every order gives a read, or a pair of reads, with planted barcodes: some have substitutions, N's, lower case,
a second insert, or lie on the other strand.  Barcodes 20 to 23 are one base away from 0 to 3.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession

from seqtally.operators.scan import spread

POOL1, POOL2 = 24, 12
#: Templates of one region, of two, of three, and for either read of a pair.
ONE, TWO, THREE = "ACGT--------CGGC", "ACGT--------CGGC------TTGA", "ACGT--------CGGC------TTGA----GG"
LEFT, RIGHT = ONE, "AGCT------TTGA"
ASYMMETRIC = "ACGTCA------TG"


def dna(x: str) -> str:
    return f"translate(md5(cast({x} as string)), '0123456789abcdef', 'ACGTACGTACGTACGT')"


def _py_dna(x: str) -> str:
    return hashlib.md5(x.encode()).hexdigest().translate(str.maketrans("0123456789abcdef", "ACGTACGTACGTACGT"))


def pool1() -> list[str]:
    base = [_py_dna(f"b{i}")[:8] for i in range(20)]
    return base + [s[:7] + s[7].translate(str.maketrans("ACGT", "CGTA")) for s in base[:4]]


def pool2() -> list[str]:
    return [_py_dna(f"c{i}")[:6] for i in range(POOL2)]


def pool3() -> list[str]:
    return ["ACCA", "GTTG", "CAAC", "TGGT"]


def bc1(idx: str) -> str:
    near = f"substr({dna(f"'b'||({idx}-20)")},1,7) || translate(substr({dna(f"'b'||({idx}-20)")},8,1),'ACGT','CGTA')"
    return f"(case when {idx} >= 20 then {near} else substr({dna(f"'b'||({idx})")},1,8) end)"


def bc2(idx: str) -> str:
    return f"substr({dna(f"'c'||({idx})")},1,6)"


def bc3(idx: str) -> str:
    return f"(case {idx} when 0 then 'ACCA' when 1 then 'GTTG' when 2 then 'CAAC' else 'TGGT' end)"


def _changed(s: str, when: str, at: str, to: str) -> str:
    return f"(case when {when} then substr({s},1,cast({at} as int)) || {to} || substr({s},cast({at}+2 as int)) else {s} end)"


def _turned(s: str, when: str) -> str:
    return f"(case when {when} then reverse(translate(upper({s}),'ACGT','TGCA')) else {s} end)"


K = "o_orderkey"


def single() -> str:
    k = K
    one = _changed(bc1(f"({k}*7%24)"), f"{k}%4=1", f"{k}%8", f"substr('ACGTN',cast({k}%5+1 as int),1)")
    two = _changed(bc2(f"({k}*5%12)"), f"{k}%10=3", f"{k}%6", f"substr('GTNAC',cast({k}%5+1 as int),1)")
    body = f"substr({dna(f"'p'||{k}")},1,cast({k}%9 as int)) || (case when {k}%5=0 then 'ACGA' else 'ACGT' end) || {one} || 'CGGC' || {two} || (case when {k}%11=4 then 'TNGA' else 'TTGA' end) || {bc3(f'({k}%4)')} || 'GG' || substr({dna(f"'s'||{k}")},1,6)"
    again = f"(case when {k}%9=0 then 'ACGT' || {bc1(f'({k}*7%23)')} || 'CGGC' || {bc2(f'({k}%12)')} || 'TTGA' else '' end)"
    s = _turned(f"({body} || {again})", f"{k}%7=3")
    return f"(case when {k}%13=5 then lower({s}) else {s} end)"


def mate1() -> str:
    k = K
    one = _changed(bc1(f"({k}*7%24)"), f"{k}%4=1", f"{k}%8", f"substr('ACGTN',cast({k}%5+1 as int),1)")
    return f"substr({dna(f"'p'||{k}")},1,cast({k}%7 as int)) || (case when {k}%8=2 then 'ACGG' else 'ACGT' end) || {one} || (case when {k}%17=6 then 'AAAA' else 'CGGC' end) || substr({dna(f"'s'||{k}")},1,5) || (case when {k}%12=0 then 'ACGT' || {bc1(f'({k}*7%22)')} || 'CGGC' else '' end)"


def mate2() -> str:
    k = K
    two = _changed(bc2(f"(case when {k}%6=1 then {k}*5%12 else {k}*7%24%12 end)"), f"{k}%10=3", f"{k}%6", f"substr('GTNAC',cast({k}%5+1 as int),1)")
    return f"substr({dna(f"'q'||{k}")},1,cast({k}%5 as int)) || (case when {k}%9=4 then 'AGGT' else 'AGCT' end) || {two} || (case when {k}%19=7 then 'CCCC' else 'TTGA' end) || substr({dna(f"'t'||{k}")},1,7) || (case when {k}%14=0 then 'AGCT' || {bc2(f'({k}%12)')} || 'TTGA' else '' end)"


def turned_pair() -> tuple[str, str]:
    """Every third pair has its reads the other way round."""
    a, b, w = mate1(), mate2(), f"{K}%3=0"
    return f"(case when {w} then {b} else {a} end)", f"(case when {w} then {a} else {b} end)"


def asymmetric() -> str:
    k = K
    body = f"substr({dna(f"'p'||{k}")},1,cast({k}%9 as int)) || (case when {k}%5=0 then 'ACNTCA' else 'ACGTCA' end) || (case when {k}%6=2 then 'AGNACA' else substr({dna(f"'r'||({k}%50)")},1,6) end) || (case when {k}%8=1 then 'NG' else 'TG' end) || substr({dna(f"'s'||{k}")},1,8)"
    return _turned(body, f"{k}%7=3")


#: Barcodes of the large pool, and the template that holds them.
LARGE, LARGE_TEMPLATE = 300_000, "ACGT--------------------CGGC"


def large_pool() -> list[str]:
    return [_py_dna(f"L{i}")[:20] for i in range(LARGE)]


def large() -> str:
    """A read with a barcode of the large pool, or of none of it, and a substitution in every fourth."""
    code = _changed(f"substr({dna(f"'L'||({K}*17%400000)")},1,20)", f"{K}%4=1", f"{K}%20", f"substr('ACGTN',cast({K}%5+1 as int),1)")
    return f"substr({dna(f"'p'||{K}")},1,cast({K}%9 as int)) || 'ACGT' || {code} || 'CGGC' || substr({dna(f"'s'||{K}")},1,6)"


LARGE_SQL = f"select {K} as read_id, {large()} as seq from orders"
LARGE_POOL_SQL = f"select cast(i as integer) as idx, substr({dna("'L'||i")},1,20) as seq from range({LARGE}) t(i)"
#: Barcodes of the wide pool: bases at the even or at the odd of 20 places, N at the others.
WIDE = 20_000


def wide_pool() -> list[str]:
    return ["".join(c if (j + i) % 2 == 0 else "N" for j, c in enumerate(_py_dna(f"W{i}")[:20])) for i in range(WIDE)]


def wide() -> str:
    """20 bases that fit a barcode of the wide pool, or none, with a substitution in every fourth and anything where the barcode has N."""
    b = f"({K}*17%26000)"
    return "concat(" + ", ".join(f"case when {K}%4=1 and {K}%20={j} then substr('ACGTN',cast({K}%5+1 as int),1) when ({j}+{b})%2=0 then substr({dna(f"'W'||{b}")},{j + 1},1) else substr({dna(f"'r'||{K}")},{j + 1},1) end" for j in range(20)) + ")"


WIDE_SQL = f"select {K} as read_id, {wide()} as v0 from orders"
READS_SQL = f"select {K} as read_id, {single()} as seq from orders"
PAIRS_SQL = "select {0} as read_id, {1} as seq1, {2} as seq2 from orders".format(K, *turned_pair())
ASYMMETRIC_SQL = f"select {K} as read_id, {asymmetric()} as seq from orders"


def _from_orders(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/orders.parquet").select(K)).selectExpr(f"{K} as read_id", *columns)


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _from_orders(spark, sf_dir, f"{single()} as seq")


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = turned_pair()
    return _from_orders(spark, sf_dir, f"{a} as seq1", f"{b} as seq2")


def asymmetric_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _from_orders(spark, sf_dir, f"{asymmetric()} as seq")


def large_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _from_orders(spark, sf_dir, f"{large()} as seq")
