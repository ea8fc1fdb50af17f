import pytest
from pyspark.sql import functions as F

from seqtally.functions.bases import IUPAC
from seqtally.operators import lookup as lk
from seqtally.operators.pool import BarcodePool
from seqtally.schema import Duplicates

PLAIN = [f"{i:09b}".translate(str.maketrans("01", "AC")) + f"{i:09b}"[::-1].translate(str.maketrans("01", "GT")) for i in range(512)]


def brute(v, seqs, cap):
    d = [sum(x not in IUPAC[c] for x, c in zip(v, s, strict=True)) for s in seqs]
    least = min(d)
    return (least, d.index(least)) if least <= cap else None


def test_a_pool_with_a_length():
    assert BarcodePool(["AC", "GT"], 2).length == 2 and BarcodePool([], 7).length == 7 and BarcodePool([]).length == 0
    with pytest.raises(ValueError, match="constant length"):
        BarcodePool(["AC", "GTT"])


def test_large_plain_pools_are_not_wide():
    pool = BarcodePool([f"{i:020b}".translate(str.maketrans("01", "AC")) for i in range(250_000)])
    assert not pool.is_wide and lk.strategy(pool, 0) == "exact" and lk.strategy(pool, 1) == "seeds"
    pool.check(Duplicates.ERROR)
    with pytest.raises(ValueError, match=r"duplicate sequences detected \(8, 250001\)"):
        BarcodePool([*pool.sequences, pool[7]]).check(Duplicates.ERROR)


def test_duplicates_of_wide_pools():
    seqs = ["N" * 9 + "AAAA", "N" * 9 + "CCAA", "ACGTACGTACCNA"]
    assert BarcodePool(seqs).is_wide
    with pytest.raises(ValueError, match=r"duplicate sequences detected \(2, 3\)"):
        BarcodePool(seqs).check(Duplicates.ERROR)
    BarcodePool(seqs[:2]).check(Duplicates.ERROR)


@pytest.mark.parametrize("cap", [0, 1, 2])
def test_seeds_of_a_larger_pool(spark, monkeypatch, cap):
    monkeypatch.setattr(lk, "MOST_NEIGHBOURS", 100)
    seen = [PLAIN[i][:k] + "N" + PLAIN[i][k + 1 :] for i, k in ((3, 0), (77, 17), (500, 9))] + [PLAIN[9], "A" * 18, "T" * 18]
    df = spark.createDataFrame([(s,) for s in seen], "v string")
    got = {r["v"]: (r["v_distance"], r["v_idx"]) for r in lk.lookup(df, "v", BarcodePool(PLAIN), cap, Duplicates.FIRST).collect()}
    assert got == {s: b for s in seen if (b := brute(s, PLAIN, cap))}


@pytest.mark.parametrize("wide", [False, True])
def test_segments_against_brute_force(spark, wide):
    one = ["NNNNNNNNNNNNAC", "NNNNNNNNNNNNGT", "ACGTACGTACGTAA"] if wide else ["ACGTACGTACGTAC", "ACGTACGTACGTGT", "ACGTACGTACGTAA"]
    two = ["AC", "AR", "TT"]
    rows = [(a, b, c, d) for a in ("ACGTACGTACGTAC", "ACGTACGTACGTGG", "CCGTACGTACGTAA", "GGGGGGGGGGGGTT") for b in ("AC", "AG", "TA") for c in (0, 1, 2) for d in (0, 1)]
    df = spark.createDataFrame(rows, "a string, b string, ca int, cb int")
    assert BarcodePool(one).is_wide == wide
    got = {(r["a"], r["b"], r["ca"], r["cb"]): (r["distance"], r["idx"], r["status"]) for r in lk.lookup_segments(df, [("a", BarcodePool(one), "ca"), ("b", BarcodePool(two), "cb")], Duplicates.NONE, 2).collect()}
    want = {}
    for a, b, c, d in rows:
        pairs = [(i, brute(a, [one[i]], c), brute(b, [two[i]], d)) for i in range(3)]
        near = [(x[0] + y[0], i) for i, x, y in pairs if x and y]
        if near:
            least = [i for z, i in near if z == min(near)[0]]
            want[a, b, c, d] = (min(near)[0], least[0], "OK") if len(least) == 1 else (min(near)[0], None, "AMBIGUOUS")
    assert got == want and len(want) > 5


def test_segments_have_to_add_up():
    assert [p.sequences for p in lk.split_pool(BarcodePool(["AACGG", "TTTCC"]), [2, 3])] == [("AA", "TT"), ("CGG", "TCC")]
    with pytest.raises(ValueError, match="same length as the sum of segment lengths"):
        lk.split_pool(BarcodePool(["AACGG"]), [2, 2])


def test_hits_in_the_row_are_those_of_the_scan(spark):
    from seqtally.operators.scan import candidates, hits_in_row
    from seqtally.plans.template import Template
    from seqtally.schema import Strand

    reads = spark.createDataFrame([(1, "ttACGTAANCTTTTgACGAGGGGTTTT"), (2, "AAAACCCCACGTAAAAGG"), (3, "ACG"), (4, None), (5, "AAAAGGTTACGT" * 2)], "read_id long, seq string")
    for text in ("ACGT----TTTT", "--ACGT"):
        for strand in (Strand.FORWARD, Strand.REVERSE):
            for k in (0, 1, 2):
                t = Template(text, strand)
                want = sorted(tuple(r) for r in candidates(reads, t, k, strand).select("read_id", "position", "v0", "constant_mismatches").collect())
                rows = reads.select("read_id", F.explode(hits_in_row("seq", t, k, strand is Strand.REVERSE)).alias("h")).select("read_id", "h.*").collect()
                assert sorted(map(tuple, rows)) == want
