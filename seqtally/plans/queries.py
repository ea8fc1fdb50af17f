"""Queries of the operators over reads made from the driver's tables, each with its oracle."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqtally.functions.bases import canonical, complement, hamming, is_standard_base, packed_bases, reverse_complement
from seqtally.operators import handlers as H
from seqtally.operators.lookup import lookup, lookup_remembered, lookup_segments
from seqtally.operators.outcomes import counts_of, folded, tally
from seqtally.operators.pool import BarcodePool, add_status, concatenated, expand_iupac, resolve_duplicates
from seqtally.operators.scan import candidates
from seqtally.plans import oracle as O
from seqtally.plans import synth as S
from seqtally.plans.template import Template
from seqtally.schema import Duplicates, Strand
from seqtally.scratch import scratch
from seqtally.sources.fastq import pair, read_fastq, read_fastq_pairs, read_fastq_ranges, read_fastq_strict, stream_fastq, write_fastq
from seqtally.streaming.counts import count_stream, counted, latest, stream_counts, tally_stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

FIRST_BEST = ((True, "first"), (False, "best"))
MATCH = "select read_id, idx, position, reverse, cast(mm as integer) as mismatches, cast(d as integer) as variable_mismatches from m"
IUPAC_POOL = ["ARRACSSC", "GKKGTNNT", "ACGTNNNN", "TTTTWWWW", "ACGTRCGT"]


def add(name: str, query: Query, sql: str) -> None:
    QUERIES[name], ORACLES[name] = query, sql


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet")


# --- reads and sources -----------------------------------------------------------------------


def named(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.reads(spark, sf_dir).select(F.concat(F.lit("R"), "read_id").alias("name"), "seq")


def fastq_round_trip(per_line: int | None, gz: bool, strict: bool = False) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = scratch(spark)
        write_fastq(named(spark, sf_dir), path, per_line, gz)
        back = read_fastq_strict(spark, path) if strict else read_fastq(spark, path)
        return back.select("name", "seq")

    return run


NAMED_SQL = O.query([], "select 'R' || read_id as name, seq from reads")
add("reads_synth", lambda s, d: S.reads(s, d), O.query([], "select read_id, seq from reads"))
add("reads_fastq_roundtrip", fastq_round_trip(None, False), NAMED_SQL)
add("reads_fastq_multiline", fastq_round_trip(17, False), NAMED_SQL)
add("reads_fastq_gzip", fastq_round_trip(None, True), NAMED_SQL)
add("reads_fastq_strict", fastq_round_trip(None, False, True), NAMED_SQL)


def paired_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    one, two = (S.pairs(spark, sf_dir).select(F.col("read_id").alias("record_no"), F.concat(F.lit(n), "read_id").alias("name"), F.col(c).alias("seq")) for n, c in (("FOO", "seq1"), ("BAR", "seq2")))
    return pair(one, two)


def paired_files(per_line: int | None, gz: bool, split: int | None) -> Query:
    """Four files a side, written and read again: a read goes with the one at its place in the file of its place."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        base = scratch(spark)
        for n in (1, 2):
            own = S.pairs(spark, sf_dir).select(F.concat(F.lit(f"{n}."), "read_id").alias("name"), F.col(f"seq{n}").alias("seq"), "read_id")
            write_fastq(own.repartition(4, "read_id").sortWithinPartitions("read_id"), f"{base}/{n}", per_line, gz)
        return read_fastq_pairs(spark, f"{base}/1", f"{base}/2", split).select("name1", "seq1", "name2", "seq2")

    return run


def ranges(per_line: int | None) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = scratch(spark)
        write_fastq(named(spark, sf_dir), path, per_line)
        return read_fastq_ranges(spark, path, 1 << 16).select("name", "seq")

    return run


def streamed_fastq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FASTQ files of a folder as a stream, counted by one aggregation."""
    base, name = scratch(spark), f"fastq_{uuid.uuid4().hex}"
    write_fastq(named(spark, sf_dir), f"{base}/in")
    counts = stream_counts(stream_fastq(spark, f"{base}/in"), H.SingleBarcode(S.ONE, S.pool1(), 1, False))
    counts.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.table(name)


PAIRS_SQL = O.query([], "select '1.' || read_id as name1, seq1, '2.' || read_id as name2, seq2 from pairs")
add("paired_fastq_files", paired_files(17, True, None), PAIRS_SQL)
add("paired_fastq_strict", paired_files(None, False, 1 << 16), PAIRS_SQL)
add("reads_fastq_ranges", ranges(None), NAMED_SQL)
add("reads_fastq_ranges_multiline", ranges(17), NAMED_SQL)
add("streaming_fastq", streamed_fastq, O.query(O.single("m", "reads", "seq", S.ONE, "pool1", 1, False), "select idx, count(*) as count from m group by idx"))
add("paired_zip", paired_zip, O.query([], "select read_id, 'FOO' || read_id as name1, seq1, 'BAR' || read_id as name2, seq2 from pairs"))

# --- bases -------------------------------------------------------------------------------------

PLAIN = "substr(translate(md5(cast(o_orderkey as string)), '0123456789abcdef', 'ACGTacgtNACGTNac'), 1, 12)"
CODES = "substr(translate(md5(cast(o_orderkey as string)), '0123456789abcdef', 'ACGTRYKMBDHVNSWa'), 1, 12)"
_swap = "translate(upper(x), 'ACGTRYKMBVDH', 'TGCAYRMKVBHD')"
_nibbles = " + ".join(f"(case upper(substr(x, {i}, 1)) when 'A' then 1 when 'C' then 2 when 'G' then 4 when 'T' then 8 else 15 end) * {16 ** (6 - i)}" for i in range(1, 7))
add("complement", lambda s, d: orders(s, d).selectExpr("o_orderkey", f"{PLAIN} as x").select("o_orderkey", complement("x", allow_iupac=False).alias("y")), f"select o_orderkey, {_swap} as y from (select o_orderkey, {PLAIN} as x from orders)")
add("revcomp", lambda s, d: orders(s, d).selectExpr("o_orderkey", f"{PLAIN} as x").select("o_orderkey", reverse_complement("x", strict=True).alias("y")), f"select o_orderkey, reverse({_swap}) as y from (select o_orderkey, {PLAIN} as x from orders)")
add("revcomp_iupac", lambda s, d: orders(s, d).selectExpr("o_orderkey", f"{CODES} as x").select("o_orderkey", reverse_complement("x", strict=True).alias("y")), f"select o_orderkey, reverse({_swap}) as y from (select o_orderkey, {CODES} as x from orders)")
add("is_standard_base", lambda s, d: orders(s, d).selectExpr("o_orderkey", f"substr({CODES}, 1, 1) as x").select("o_orderkey", is_standard_base("x").alias("y")), f"select o_orderkey, x in ('A','C','G','T','a','c','g','t') as y from (select o_orderkey, substr({CODES}, 1, 1) as x from orders)")
add("packed_bases", lambda s, d: orders(s, d).selectExpr("o_orderkey", f"substr({PLAIN}, 1, 6) as x").select("o_orderkey", packed_bases("x").alias("y")), f"select o_orderkey, cast({_nibbles} as bigint) as y from (select o_orderkey, substr({PLAIN}, 1, 6) as x from orders)")
add("hamming_distance", lambda s, d: orders(s, d).selectExpr("o_orderkey", f"{PLAIN} as x", f"{CODES} as z").select("o_orderkey", hamming("x", "z", 12).alias("y")), f"select o_orderkey, cast(hamming({PLAIN}, {CODES}) as integer) as y from orders")

# --- pools -------------------------------------------------------------------------------------

# a pool of one sequence for each order, with IUPAC codes and repeats
POOL_EXPR = "substr(translate(md5(cast(o_orderkey as string)), '0123456789abcdef', 'AACCGGTTAACCRYAN'), 1, 5)"
_EXPANDED = f"""pool as (select cast(o_orderkey as integer) as idx, {POOL_EXPR} as seq from orders),
code as (select * from (values ('A','A'),('C','C'),('G','G'),('T','T'),('R','A'),('R','G'),('Y','C'),('Y','T'),('N','A'),('N','C'),('N','G'),('N','T')) t(k, b)),
expanded as (select idx, c1.b || c2.b || c3.b || c4.b || c5.b as expanded from pool
 join code c1 on c1.k = substr(seq,1,1) join code c2 on c2.k = substr(seq,2,1) join code c3 on c3.k = substr(seq,3,1) join code c4 on c4.k = substr(seq,4,1) join code c5 on c5.k = substr(seq,5,1))"""


def pool_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders(spark, sf_dir).selectExpr("cast(o_orderkey as int) as idx", f"{POOL_EXPR} as seq")


add("pool_iupac_expand", lambda s, d: expand_iupac(pool_table(s, d)).select("idx", "expanded"), f"with {_EXPANDED} select idx, expanded from expanded")
for _dup, _sql in ((Duplicates.FIRST, "min(idx)"), (Duplicates.LAST, "max(idx)"), (Duplicates.NONE, "case when count(distinct idx) = 1 then min(idx) end")):
    add(f"pool_dups_{_dup.value}", lambda s, d, x=_dup: resolve_duplicates(expand_iupac(pool_table(s, d)), x), f"with {_EXPANDED} select expanded, {_sql} as idx from expanded group by expanded")
    _rep = "bool_or(n > 0)" if _dup is Duplicates.LAST else "false"
    _clr = "bool_or(n = 1)" if _dup is Duplicates.NONE else "false"
    add(
        f"pool_add_status_{_dup.value}",
        lambda s, d, x=_dup: add_status(expand_iupac(pool_table(s, d)).select("idx", "expanded"), x),
        f"with {_EXPANDED}, k as (select distinct idx, expanded from expanded), j as (select a.idx, a.expanded, (select count(*) from k b where b.expanded = a.expanded and b.idx < a.idx) as n from k a) select idx, count(*) > 1 as has_ambiguous, bool_or(n > 0) as is_duplicate, {_rep} as duplicate_replaced, {_clr} as duplicate_cleared from j group by idx",
    )


def dual_pools() -> tuple[list[str], list[str]]:
    p2 = S.pool2()
    return S.pool1(), [p2[i % 12] for i in range(S.POOL1)]


add("pool_dual_concat", lambda s, d: concatenated([BarcodePool(dual_pools()[0]), BarcodePool(dual_pools()[1]).reversed()]).frame(s), O.query([], f"select idx, s1 || {O.turned('s2')} as seq from tuples"))

# --- scan --------------------------------------------------------------------------------------

for _name, _strand, _text, _k in (("template_mismatch_fwd", "forward", S.ONE, 1), ("template_mismatch_rev", "reverse", S.ONE, 1), ("template_mismatch_both", "both", S.ONE, 2), ("template_multi_region", "both", S.THREE, 2)):
    _n = len(Template(_text).regions)
    _v = ", ".join(f"v{i}" for i in range(_n))
    add(
        _name,
        lambda s, d, a=_strand, t=_text, k=_k: candidates(S.reads(s, d), Template(t), k, Strand(a)),
        O.query(O.scan("h", "reads", "seq", _text, _k, _strand), f"select read_id, position, reverse, cm as constant_mismatches, {_v} from h"),
    )
add("template_n_bases", lambda s, d: candidates(S.asymmetric_reads(s, d), Template(S.ASYMMETRIC), 2, Strand.BOTH), O.query(O.scan("h", "odd", "seq", S.ASYMMETRIC, 2, "both"), "select read_id, position, reverse, cm as constant_mismatches, v0 from h"))
add("template_positions", lambda s, d: candidates(S.reads(s, d), Template("ACGT----"), 4, Strand.FORWARD).groupBy("read_id").agg(F.count("*").alias("places"), F.min("position").alias("first"), F.max("position").alias("last")), O.query([], "select read_id, length(seq) - 7 as places, 0 as first, cast(length(seq) - 8 as integer) as last from reads where length(seq) >= 8"))

# --- lookup ------------------------------------------------------------------------------------

OBSERVED = f"select o_orderkey as read_id, {S._changed(S._changed(S.bc1('(o_orderkey*7%24)'), 'o_orderkey%3>0', 'o_orderkey%8', "substr('ACGTN',cast(o_orderkey%5+1 as int),1)"), 'o_orderkey%3>1', '(o_orderkey*3+1)%8', "substr('CANTG',cast(o_orderkey%5+1 as int),1)")} as v0 from orders"


def observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders(spark, sf_dir).createOrReplaceTempView("seqtally_orders")
    return spark.sql(OBSERVED.replace("from orders", "from seqtally_orders")).withColumn("v0", canonical("v0"))


def lookup_query(cap: int, duplicates: Duplicates, how: str | None, pool: list[str] | None = None) -> Query:
    return lambda s, d: lookup(observed(s, d), "v0", BarcodePool(pool or S.pool1()), cap, duplicates, how).select("read_id", F.col("v0_distance").alias("distance"), F.col("v0_idx").alias("idx"), F.col("v0_status").alias("status"))


def lookup_sql(cap: int, duplicates: str, pool: str = "pool1") -> str:
    pick = {"first": "min(idx)", "last": "max(idx)"}.get(duplicates, "case when count(distinct idx) = 1 then min(idx) end")
    status = "'OK'" if duplicates in ("first", "last") else "case when count(distinct idx) = 1 then 'OK' else 'AMBIGUOUS' end"
    return f"with {O.POOLS}, obs as ({OBSERVED}), c as (select read_id, p.idx, cast(hamming(v0, p.seq) as integer) as d from obs cross join {pool} p), m as (select *, min(d) over (partition by read_id) as least from c where d <= {cap}) select read_id, least as distance, {pick} as idx, {status} as status from m where d = least group by read_id, least"


add("lookup_exact", lookup_query(0, Duplicates.ERROR, "exact"), lookup_sql(0, "error"))
for _cap in (1, 2, 3):
    for _how in ("neighbours", "seeds", "brute"):
        if _cap < 3 or _how != "neighbours":
            add(f"lookup_hamming{_cap}_{_how}", lookup_query(_cap, Duplicates.NONE, _how), lookup_sql(_cap, "none"))
for _dup in (Duplicates.FIRST, Duplicates.LAST, Duplicates.NONE):
    add(f"lookup_ties_{_dup.value}", lookup_query(2, _dup, None), lookup_sql(2, _dup.value))
_iupac_rows = ", ".join(f"({i}, '{s}')" for i, s in enumerate(IUPAC_POOL))
_iupac_d = " + ".join(f"(case when instr((case substr(p.seq,{i},1) when 'R' then 'AG' when 'Y' then 'CT' when 'S' then 'CG' when 'W' then 'AT' when 'K' then 'GT' when 'M' then 'AC' when 'N' then 'ACGT' else substr(p.seq,{i},1) end), substr(v0,{i},1)) > 0 then 0 else 1 end)" for i in range(1, 9))
_IUPAC_SQL = f"with obs as ({OBSERVED}), pool as (select cast(idx as integer) as idx, seq from (values {_iupac_rows}) t(idx, seq)), c as (select read_id, idx, cast({_iupac_d} as integer) as d from obs cross join pool p), m as (select *, min(d) over (partition by read_id) as least from c where d <= 3) select read_id, least as distance, min(idx) as idx, 'OK' as status from m where d = least group by read_id, least"
for _how in ("brute", "seeds", "neighbours", "tree"):
    add(f"lookup_iupac_{_how}", lookup_query(3, Duplicates.FIRST, _how, IUPAC_POOL), _IUPAC_SQL)


def segmented(spark: SparkSession, sf_dir: str) -> DataFrame:
    halves = observed(spark, sf_dir).selectExpr("read_id", "substring(v0, 1, 5) as a", "substring(v0, 6, 3) as b", "cast(read_id % 3 as int) as cap1", "cast(read_id % 2 as int) as cap2")
    p = S.pool1()
    out = lookup_segments(halves, [("a", BarcodePool([s[:5] for s in p]), "cap1"), ("b", BarcodePool([s[5:] for s in p]), "cap2")], Duplicates.NONE, [2, 1])
    return out.select("read_id", "distance", "idx", "status")


add("lookup_segmented", segmented, f"with {O.POOLS}, obs as ({OBSERVED}), c as (select read_id, p.idx, cast(hamming(substr(v0,1,5), substr(p.seq,1,5)) as integer) as d1, cast(hamming(substr(v0,6,3), substr(p.seq,6,3)) as integer) as d2 from obs cross join pool1 p), m as (select *, min(d1 + d2) over (partition by read_id) as least from c where d1 <= read_id % 3 and d2 <= read_id % 2) select read_id, least as distance, case when count(distinct idx) = 1 then min(idx) end as idx, case when count(distinct idx) = 1 then 'OK' else 'AMBIGUOUS' end as status from m where d1 + d2 = least group by read_id, least")

# --- matches and designs -----------------------------------------------------------------------

ERR, FST = Duplicates.ERROR, Duplicates.FIRST
for _first, _word in FIRST_BEST:
    add(f"match_{_word}", lambda s, d, f=_first: H.SingleBarcode(S.ONE, S.pool1(), 2, f, Strand.BOTH).matches(S.reads(s, d)), O.query(O.single("m", "reads", "seq", S.ONE, "pool1", 2, _first, "both"), MATCH))
    add(f"single_se_{_word}", lambda s, d, f=_first: H.SingleBarcode(S.ONE, S.pool1(), 1, f).counts(S.reads(s, d)), O.query(O.single("m", "reads", "seq", S.ONE, "pool1", 1, _first), O.dense("m", S.POOL1)))
    add(f"single_se_both_{_word}", lambda s, d, f=_first: H.SingleBarcode(S.ONE, S.pool1(), 2, f, Strand.BOTH, FST).counts(S.reads(s, d)), O.query(O.single("m", "reads", "seq", S.ONE, "pool1", 2, _first, "both", "first"), O.dense("m", S.POOL1)))
    _ctes = O.single("a", "pairs", "seq1", S.LEFT, "pool1", 1, _first) + O.single("b", "pairs", "seq2", S.LEFT, "pool1", 1, _first)
    _idx = "coalesce(a.idx, b.idx)" if _first else "case when b.idx is null or a.mm < b.mm then a.idx when a.idx is null or a.mm > b.mm then b.idx when a.idx = b.idx then a.idx end"
    _ctes.append(f"m as (select * from (select p.read_id, {_idx} as idx from pairs p left join a on a.read_id = p.read_id left join b on b.read_id = p.read_id) where idx is not null)")
    add(f"single_pe_{_word}", lambda s, d, f=_first: H.SingleBarcodePaired(S.LEFT, S.pool1(), 1, f).counts(S.pairs(s, d)), O.query(_ctes, O.dense("m", S.POOL1)))
    add(f"combo_se_{_word}", lambda s, d, f=_first: H.CombinatorialBarcodes(S.TWO, [S.pool1(), S.pool2()], 2, f).combinations(S.reads(s, d)), O.query(O.combo("m", "reads", "seq", S.TWO, ["pool1", "pool2"], 2, _first), "select idx1, idx2, count(*) as count from m group by all"))
    add(f"combo_se_both_{_word}", lambda s, d, f=_first: H.CombinatorialBarcodes(S.TWO, [S.pool1(), S.pool2()], 1, f, Strand.BOTH).combinations(S.reads(s, d)), O.query(O.combo("m", "reads", "seq", S.TWO, ["pool1", "pool2"], 1, _first, "both"), "select idx1, idx2, count(*) as count from m group by all"))
    add(f"dual_se_{_word}", lambda s, d, f=_first: H.DualBarcodes(S.TWO, dual_pools(), 2, f, Strand.BOTH).counts(S.reads(s, d)), O.query(O.dual("m", "reads", "seq", S.TWO, "tuples", 2, _first, "both"), O.dense("m", S.POOL1)))
    add(f"random_se_{_word}", lambda s, d, f=_first: H.RandomBarcode(S.ASYMMETRIC, 1, f, Strand.BOTH).counts(S.asymmetric_reads(s, d)), O.query([*O.scan("h", "odd", "seq", S.ASYMMETRIC, 1, "both", True), "t as (select *, cm as mm, v0 as idx from h)", *O.resolve("m", "t", _first, "position, reverse")], "select idx as barcode, count(*) as count from m group by all"))
    for _random in (False, True):
        _tag = f"random_{_word}" if _random else _word
        _two = lambda s, d, f=_first, r=_random: H.CombinatorialBarcodesPaired(S.LEFT, S.pool1(), S.RIGHT, S.pool2(), 1, 1, f, random=r)
        _ctes = O.combo_paired("m", "pairs", _first, _random, 1, 1, S.LEFT, S.RIGHT)
        add(f"combo_pe_{_tag}", lambda s, d, t=_two: t(s, d).combinations(S.pairs(s, d)), O.query(_ctes, "select idx1, idx2, count(*) as count from m where kind in ('m', 'n') group by all"))
        add(f"combo_pe_{_tag}_summary", lambda s, d, t=_two: t(s, d).summary(S.pairs(s, d)), O.query(_ctes, "select count(*) as total, count(*) filter (kind = 'barcode1_only') as barcode1_only, count(*) filter (kind = 'barcode2_only') as barcode2_only from m"))
        _dual = lambda s, d, f=_first, r=_random: H.DualBarcodesPaired(S.LEFT, dual_pools()[0], S.RIGHT, dual_pools()[1], 1, 1, f, random=r)
        add(f"dual_pe_{_tag}", lambda s, d, t=_dual: t(s, d).counts(S.pairs(s, d)), O.query(O.dual_paired("m", _first, _random, 1, 1, S.LEFT, S.RIGHT), O.dense("m", S.POOL1)))

add("combo_se_reverse", lambda s, d: H.CombinatorialBarcodes(S.TWO, [S.pool1(), S.pool2()], 2, False, Strand.REVERSE).combinations(S.reads(s, d)), O.query(O.combo("m", "reads", "seq", S.TWO, ["pool1", "pool2"], 2, False, "reverse"), "select idx1, idx2, count(*) as count from m group by all"))
add("combo_se_3regions", lambda s, d: H.CombinatorialBarcodes(S.THREE, [S.pool1(), S.pool2(), S.pool3()], 2, False, Strand.BOTH).combinations(S.reads(s, d)), O.query(O.combo("m", "reads", "seq", S.THREE, ["pool1", "pool2", "pool3"], 2, False, "both"), "select idx1, idx2, idx3, count(*) as count from m group by all"))
add("match_best_ambiguous", lambda s, d: S.reads(s, d).select("read_id").join(H.SingleBarcode(S.ONE, S.pool1(), 2, False).matches(S.reads(s, d)).select("read_id"), "read_id", "left_anti"), O.query(O.single("m", "reads", "seq", S.ONE, "pool1", 2, False), "select read_id from reads where read_id not in (select read_id from m)"))


_repeats = [S.pool2()[i % 12] for i in range(S.POOL1)]
for _first, _word in FIRST_BEST:
    _ctes = O.dual_paired("m", _first, False, 1, 1, S.LEFT, S.RIGHT) + ["rest as (select * from pairs where read_id not in (select read_id from m))"]
    # the second pool of the design has each of twelve sequences twice; FIRST takes the lower place
    _ctes += O.combo_paired("c", "rest", _first, False, 1, 1, S.LEFT, S.RIGHT, "first")
    _diag = lambda f=_first: H.DualBarcodesPairedDiagnostics(S.LEFT, S.pool1(), S.RIGHT, _repeats, max_mismatches1=1, max_mismatches2=1, use_first=f)
    add(f"dual_pe_diag_{_word}", lambda s, d, g=_diag: g().combinations(S.pairs(s, d)), O.query(_ctes, "select idx1, idx2, count(*) as count from c where kind = 'm' group by all"))
    add(f"dual_pe_diag_{_word}_summary", lambda s, d, g=_diag: g().summary(S.pairs(s, d)), O.query(_ctes, "select (select count(*) from pairs) as total, count(*) filter (kind = 'barcode1_only') as barcode1_only, count(*) filter (kind = 'barcode2_only') as barcode2_only from c"))
    _ctes = O.dual("m", "reads", "seq", S.TWO, "tuples", 1, _first) + ["rest as (select * from reads where read_id not in (select read_id from m))"] + O.combo("c", "rest", "seq", S.TWO, ["pool1", "pool2"], 1, _first, duplicates="first")
    add(f"dual_se_diag_{_word}", lambda s, d, f=_first: H.DualBarcodesDiagnostics(S.TWO, [S.pool1(), _repeats], max_mismatches=1, use_first=f).combinations(S.reads(s, d)), O.query(_ctes, "select idx1, idx2, count(*) as count from c group by all"))


# --- pools of any size --------------------------------------------------------------------------

_LARGE = [f"large_reads as ({S.LARGE_SQL})", f"large_pool as ({S.LARGE_POOL_SQL})"]
# within one mismatch of a barcode: one of its halves is equal
_near = lambda p, q: f"select read_id, position, p.idx, cm, cast(hamming(v0, p.seq) as integer) as d from h join large_pool p on substr(v0,{p},10) = substr(p.seq,{p},10){q}"
_LARGE_MATCH = [
    *_LARGE,
    *O.scan("h", "large_reads", "seq", S.LARGE_TEMPLATE, 1, "forward"),
    f"c as ({_near(1, '')} union {_near(11, '')})",
    "t as (select read_id, idx, position, false as reverse, cm + d as mm from c where cm + d <= 1)",
    *O.resolve("m", "t", False),
]


def exact_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = S.large_reads(spark, sf_dir).select("read_id", F.regexp_extract("seq", "ACGT([ACGTN]{20})CGGC", 1).alias("v0"))
    out = lookup(seen, "v0", BarcodePool(S.large_pool()), 0, Duplicates.ERROR)
    return out.select("read_id", F.col("v0_idx").alias("idx"), F.col("v0_status").alias("status"))


add("lookup_exact_large", exact_large, O.query(_LARGE, "select read_id, p.idx, 'OK' as status from (select read_id, regexp_extract(seq, 'ACGT([ACGTN]{20})CGGC', 1) as v0 from large_reads) join large_pool p on p.seq = v0"))
add("single_se_large_pool", lambda s, d: H.SingleBarcode(S.LARGE_TEMPLATE, S.large_pool(), 1, False).matches(S.large_reads(s, d)).select("read_id", "idx", "position", "mismatches"), O.query(_LARGE_MATCH, "select read_id, idx, position, cast(mm as integer) as mismatches from m"))

def wide_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders(spark, sf_dir).createOrReplaceTempView("seqtally_orders")
    seen = spark.sql(S.WIDE_SQL.replace("from orders", "from seqtally_orders"))
    return lookup(seen, "v0", BarcodePool(S.wide_pool()), 1, FST).select("read_id", F.col("v0_distance").alias("distance"), F.col("v0_idx").alias("idx"))


def remembered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs over one table of what has been looked up: all but the orders divisible by five, then all."""
    path, seen = scratch(spark), observed(spark, sf_dir)
    lookup_remembered(seen.filter("read_id % 5 <> 0"), "v0", BarcodePool(S.pool1()), 2, Duplicates.NONE, path).write.format("noop").mode("overwrite").save()
    out = lookup_remembered(seen, "v0", BarcodePool(S.pool1()), 2, Duplicates.NONE, path)
    return out.select("read_id", F.col("v0_distance").alias("distance"), F.col("v0_idx").alias("idx"), F.col("v0_status").alias("status"))


def _significant(x: str, parity: int) -> str:
    return " || ".join(f"substr({x}, {j + 1}, 1)" for j in range(20) if j % 2 == parity)


# of ten letters with one mismatch at most, the first five or the last five are equal; an N of the string fits no base of the others either
_odd_n = lambda parity: f"length({_significant('v0', parity)}) - length(replace({_significant('v0', parity)}, 'N', ''))"
_WIDE_SQL = f"""with obs as ({S.WIDE_SQL}), pool as (select cast(i as integer) as idx, {S.dna("'W'||i")} as w from range({S.WIDE}) t(i)),
letters as (select idx, idx % 2 as side, case when idx % 2 = 0 then {_significant('w', 0)} else {_significant('w', 1)} end as s from pool),
seen as (select read_id, 0 as side, {_significant('v0', 0)} as s, {_odd_n(1)} as n from obs union all select read_id, 1, {_significant('v0', 1)}, {_odd_n(0)} from obs),
near as (select read_id, idx, cast(hamming(a.s, b.s) + n as integer) as d from seen a join letters b on a.side = b.side and substr(a.s, 1, 5) = substr(b.s, 1, 5)
 union select read_id, idx, cast(hamming(a.s, b.s) + n as integer) from seen a join letters b on a.side = b.side and substr(a.s, 6, 5) = substr(b.s, 6, 5))
select read_id, min(d) as distance, arg_min(idx, d * 1000000 + idx) as idx from near where d <= 1 group by read_id"""
add("lookup_iupac_wide", wide_lookup, _WIDE_SQL)
add("lookup_remembered", remembered, lookup_sql(2, "none"))

# --- other strands, ties and counters of paired designs --------------------------------------------


def turned_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs whose first read lies on the other strand."""
    return S.pairs(spark, sf_dir).withColumn("seq1", reverse_complement("seq1"))


_TURNED = [f"turned_pairs as (select read_id, {O.turned('seq1')} as seq1, seq2 from pairs)"]
_OTHER = ("reverse", "forward")
for _first, _word in FIRST_BEST:
    _ctes = O.dual_paired("m", _first, True, 1, 1, S.LEFT, S.RIGHT, strands=_OTHER, source="turned_pairs")
    add(f"dual_pe_reverse_{_word}", lambda s, d, f=_first: H.DualBarcodesPaired(S.LEFT, dual_pools()[0], S.RIGHT, dual_pools()[1], 1, 1, f, Strand.REVERSE, random=True).counts(turned_pairs(s, d)), O.query([*_TURNED, *_ctes], O.dense("m", S.POOL1)))
    _ctes = O.combo_paired("m", "turned_pairs", _first, True, 1, 1, S.LEFT, S.RIGHT, strands=_OTHER)
    add(f"combo_pe_reverse_{_word}", lambda s, d, f=_first: H.CombinatorialBarcodesPaired(S.LEFT, S.pool1(), S.RIGHT, S.pool2(), 1, 1, f, Strand.REVERSE, random=True).combinations(turned_pairs(s, d)), O.query([*_TURNED, *_ctes], "select idx1, idx2, count(*) as count from m where kind in ('m', 'n') group by all"))

# a pool and tuples in which places i and i + 12 are the same
_TWICE = [f"twice as (select cast(i as integer) as idx, {S.bc1('(i % 12)')} as seq from range(24) t(i))", "tuples_twice as (select a.idx, a.seq as s1, b.seq as s2, a.seq || b.seq as seq from twice a join pool2 b on b.idx = a.idx % 12)"]
for _dup in (Duplicates.LAST, Duplicates.NONE, Duplicates.FIRST):
    _word, _pool = _dup.value, S.pool1()[:12] * 2
    add(f"single_se_ties_{_word}", lambda s, d, x=_dup, p=_pool: H.SingleBarcode(S.ONE, p, 1, False, Strand.FORWARD, x).counts(S.reads(s, d)), O.query([*_TWICE, *O.single("m", "reads", "seq", S.ONE, "twice", 1, False, duplicates=_word)], O.dense("m", S.POOL1)))
    _ctes = O.dual_paired("m", False, False, 1, 1, S.LEFT, S.RIGHT, _word, tuples="tuples_twice")
    add(f"dual_pe_ties_{_word}", lambda s, d, x=_dup, p=_pool: H.DualBarcodesPaired(S.LEFT, p, S.RIGHT, S.pool2() * 2, 1, 1, False, duplicates=x).counts(S.pairs(s, d)), O.query([*_TWICE, *_ctes], O.dense("m", S.POOL1)))

# two first barcodes for all tuples
_SHARED = [f"shared as (select cast(i as integer) as idx, {S.bc1('(i // 12)')} as s1, {S.bc2('(i % 12)')} as s2 from range(24) t(i))"]
for _first, _word in FIRST_BEST:
    _ctes = O.dual_paired("m", _first, True, 1, 1, S.LEFT, S.RIGHT, tuples="shared")
    _word = "shared_barcodes" if not _first else "shared_barcodes_first"
    add(f"dual_pe_{_word}", lambda s, d, f=_first: H.DualBarcodesPaired(S.LEFT, [S.pool1()[i // 12] for i in range(24)], S.RIGHT, S.pool2() * 2, 1, 1, f, random=True).counts(S.pairs(s, d)), O.query([*_SHARED, *_ctes], O.dense("m", S.POOL1)))

add("dual_pe_diag_counts", lambda s, d: H.DualBarcodesPairedDiagnostics(S.LEFT, S.pool1(), S.RIGHT, _repeats, max_mismatches1=1, max_mismatches2=1, use_first=False).counts(S.pairs(s, d)), O.query(O.dual_paired("m", False, False, 1, 1, S.LEFT, S.RIGHT), O.dense("m", S.POOL1)))
add("dual_se_diag_counts", lambda s, d: H.DualBarcodesDiagnostics(S.TWO, [S.pool1(), _repeats], max_mismatches=1, use_first=False).counts(S.reads(s, d)), O.query(O.dual("m", "reads", "seq", S.TWO, "tuples", 1, False), O.dense("m", S.POOL1)))


# --- streams -----------------------------------------------------------------------------------


def streaming_single_se(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = scratch(spark)
    S.reads(spark, sf_dir).repartition(4).write.parquet(f"{base}/in")
    stream = spark.readStream.schema("read_id long, seq string").option("maxFilesPerTrigger", 2).parquet(f"{base}/in")
    name = f"counts_{uuid.uuid4().hex}"
    run = stream_counts(stream, H.SingleBarcode(S.ONE, S.pool1(), 1, False)).writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.table(name)


add("streaming_single_se", streaming_single_se, O.query(O.single("m", "reads", "seq", S.ONE, "pool1", 1, False), "select idx, count(*) as count from m group by idx"))


#: Bytes of a row group of a stream's files: a row group is read by one task.
ROW_GROUP = 8 << 20


def streamed(design: Callable[[], H.Handler], source: Query, schema: str, in_state: bool = True) -> Query:
    """Four files of reads, two in each micro-batch, in row groups that are tasks; counts are in the state store, or added up from those of each batch."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        base = scratch(spark)
        source(spark, sf_dir).repartition(4).write.option("parquet.block.size", ROW_GROUP).parquet(f"{base}/in")
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(f"{base}/in")
        made = design()
        if not in_state:
            count_stream(stream, made, f"{base}/out", f"{base}/state").awaitTermination()
            return counted(spark, f"{base}/out")
        tally_stream(stream, made, f"{base}/out", f"{base}/state").awaitTermination()
        return counts_of(latest(spark, f"{base}/out", made), made)

    return run


_READS, _PAIRS = "read_id long, seq string", "read_id long, seq1 string, seq2 string"
for _name, _design, _source, _schema, _same in (
    ("single_dense", lambda: H.SingleBarcode(S.ONE, S.pool1(), 1, False), S.reads, _READS, "single_se_best"),
    ("single_pe", lambda: H.SingleBarcodePaired(S.LEFT, S.pool1(), 1, False), S.pairs, _PAIRS, "single_pe_best"),
    ("combo_se", lambda: H.CombinatorialBarcodes(S.TWO, [S.pool1(), S.pool2()], 2, False), S.reads, _READS, "combo_se_best"),
    ("combo_pe", lambda: H.CombinatorialBarcodesPaired(S.LEFT, S.pool1(), S.RIGHT, S.pool2(), 1, 1, False), S.pairs, _PAIRS, "combo_pe_best"),
    ("dual_se", lambda: H.DualBarcodes(S.TWO, dual_pools(), 2, False, Strand.BOTH), S.reads, _READS, "dual_se_best"),
    ("dual_pe", lambda: H.DualBarcodesPaired(S.LEFT, dual_pools()[0], S.RIGHT, dual_pools()[1], 1, 1, False), S.pairs, _PAIRS, "dual_pe_best"),
    ("dual_se_diag", lambda: H.DualBarcodesDiagnostics(S.TWO, [S.pool1(), _repeats], max_mismatches=1, use_first=False), S.reads, _READS, "dual_se_diag_best"),
    ("dual_pe_diag", lambda: H.DualBarcodesPairedDiagnostics(S.LEFT, S.pool1(), S.RIGHT, _repeats, max_mismatches1=1, max_mismatches2=1, use_first=False), S.pairs, _PAIRS, "dual_pe_diag_best"),
    ("random_se", lambda: H.RandomBarcode(S.ASYMMETRIC, 1, False, Strand.BOTH), S.asymmetric_reads, _READS, "random_se_best"),
):
    add(f"streaming_{_name}", streamed(_design, _source, _schema), ORACLES[_same])
    if _name in ("dual_pe", "single_dense"):
        add(f"streaming_batches_{_name}", streamed(_design, _source, _schema, False), ORACLES[_same])


class BasesOfReads(H.BatchHandler):
    """Reads by length, counted batch by batch: an example of a design over Arrow batches."""

    schema = "length int, count long"

    def process(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        n = pc.value_counts(pc.utf8_length(batch.column("seq")))
        yield pa.RecordBatch.from_arrays([n.field("values").cast(pa.int32()), n.field("counts")], names=["length", "count"])


add("batch_handler", lambda s, d: BasesOfReads().plan(S.reads(s, d)).groupBy("length").agg(F.sum("count").alias("count")), O.query([], "select cast(length(seq) as integer) as length, count(*) as count from reads group by 1"))


class FirstOfLength(H.StateHandler):
    """The first read of each length, by the order of files and of reads in them, and how many there are."""

    schema, names = "length int, name string, count long", True

    def initialize(self) -> dict[int, tuple[str, int]]:
        return {}

    def process(self, state: dict, batch: pa.RecordBatch) -> dict:
        rows = pa.table({"length": pc.utf8_length(batch.column("seq")), "name": batch.column("name")}).group_by("length", use_threads=False).aggregate([("name", "first"), ("name", "count")])
        return self.reduce(state, {n: (name, k) for n, name, k in zip(*(rows.column(c).to_pylist() for c in ("length", "name_first", "name_count")), strict=True)})

    def reduce(self, earlier: dict, later: dict) -> dict:
        return earlier | {n: (earlier[n][0], earlier[n][1] + k) if n in earlier else (name, k) for n, (name, k) in later.items()}

    def finish(self, state: dict) -> pa.Table:
        return pa.table({"length": pa.array(state, pa.int32()), "name": pa.array([v[0] for v in state.values()], pa.string()), "count": pa.array([v[1] for v in state.values()], pa.int64())})


class BasesOfPairs(H.StateHandler):
    """The number of each letter on either side of pairs, whatever its case."""

    schema = "base string, count1 long, count2 long"

    def initialize(self) -> np.ndarray:
        return np.zeros((2, 256), np.int64)

    def process(self, state: np.ndarray, batch: pa.RecordBatch) -> np.ndarray:
        for k, c in enumerate(("seq1", "seq2")):
            text = "".join(pc.utf8_upper(batch.column(c)).to_pylist())
            state[k] += np.bincount(np.frombuffer(text.encode(), np.uint8), minlength=256)
        return state

    def reduce(self, earlier: np.ndarray, later: np.ndarray) -> np.ndarray:
        return earlier + later

    def finish(self, state: np.ndarray) -> pa.Table:
        seen = np.flatnonzero(state.sum(0))
        return pa.table({"base": [chr(c) for c in seen], "count1": state[0, seen], "count2": state[1, seen]})


def first_of_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark)
    own = S.reads(spark, sf_dir).select("read_id", F.concat(F.lit("R"), "read_id").alias("name"), "seq")
    write_fastq(own.repartitionByRange(4, "read_id").sortWithinPartitions("read_id"), path)
    return FirstOfLength().plan(read_fastq_ranges(spark, path, 1 << 18))


def bases_of_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = scratch(spark)
    for n in (1, 2):
        own = S.pairs(spark, sf_dir).select(F.col("read_id").cast("string").alias("name"), F.col(f"seq{n}").alias("seq"), "read_id")
        write_fastq(own.repartition(4, "read_id").sortWithinPartitions("read_id"), f"{base}/{n}")
    return BasesOfPairs().plan(read_fastq_pairs(spark, f"{base}/1", f"{base}/2", names=False))


add("handler_state_in_order", first_of_length, O.query([], "select cast(length(seq) as integer) as length, 'R' || min(read_id) as name, count(*) as count from reads group by 1"))
add("handler_state_pairs", bases_of_pairs, O.query([], "select base, count(*) filter (side = 1) as count1, count(*) filter (side = 2) as count2 from (select 1 as side, unnest(string_split(upper(seq1), '')) as base from pairs union all select 2, unnest(string_split(upper(seq2), '')) from pairs) group by base"))


# --- all results of a design from one scan ---------------------------------------------------------

_ctes = O.dual_paired("m", False, False, 1, 1, S.LEFT, S.RIGHT) + ["rest as (select * from pairs where read_id not in (select read_id from m))", *O.combo_paired("c", "rest", False, False, 1, 1, S.LEFT, S.RIGHT, "first")]
_none = "cast(null as integer)"
_ALL_RESULTS = O.query(
    _ctes,
    f"select 'match' as kind, idx, {_none} as idx1, {_none} as idx2, count(*) as count from m group by idx union all select case kind when 'm' then 'combination' else kind end, {_none}, idx1, idx2, count(*) from c group by kind, idx1, idx2",
)
_all = lambda: H.DualBarcodesPairedDiagnostics(S.LEFT, S.pool1(), S.RIGHT, _repeats, max_mismatches1=1, max_mismatches2=1, use_first=False)
add("dual_pe_diag_tally", lambda s, d: tally(S.pairs(s, d), _all()), _ALL_RESULTS)
add("dual_pe_diag_tally_weighted", lambda s, d: tally(folded(S.pairs(s, d)), _all(), "weight"), _ALL_RESULTS)
_ctes = O.combo("m", "reads", "seq", S.TWO, ["pool1", "pool2"], 2, False, "both")
add("combo_se_tally", lambda s, d: tally(S.reads(s, d), H.CombinatorialBarcodes(S.TWO, [S.pool1(), S.pool2()], 2, False, Strand.BOTH)), O.query(_ctes, f"select 'combination' as kind, idx1, idx2, count(*) as count from m group by all union all select null, {_none}, {_none}, count(*) from reads where read_id not in (select read_id from m)"))
