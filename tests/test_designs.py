import pytest

from seqtally.operators import handlers as H
from seqtally.operators.lookup import lookup
from seqtally.operators.pool import BarcodePool, concatenated
from seqtally.plans.template import Template
from seqtally.schema import Duplicates, Strand

POOL = ["AAAA", "CCCC", "GGGG", "TTTT"]
POOL6 = ["ACACAC", "TGTGTG", "AGAGAG", "CTCTCT"]
ONE, TWO = "ACGT----TTTT", "AAAA----CGGC------TTTT"
LEFT, RIGHT = "AAAA----CGGC", "AGCT------TTTT"


def reads(spark, *seqs):
    return spark.createDataFrame(list(enumerate(seqs)), "read_id long, seq string").coalesce(1)


def pairs(spark, *seqs):
    return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(seqs)], "read_id long, seq1 string, seq2 string").coalesce(1)


def counts(df):
    return [r["count"] for r in sorted(df.collect())]


def test_template_regions():
    t = Template("ACGT----TT-----GG")
    assert t.regions == [(4, 8), (10, 15)] and t.reverse_regions == [(2, 7), (9, 13)]
    assert Template("ACGT").regions == []


def test_single_first_and_best(spark):
    r = reads(spark, "cagACGTAAAATTTTacg", "cagACGTCCCCTTTTacg", "cagACTTAAAATTTTacg", "cagACTTAAGATTTTacg", None, "", "ACG")
    assert counts(H.SingleBarcode(ONE, POOL, 0).counts(r)) == [1, 1, 0, 0]
    assert counts(H.SingleBarcode(ONE, POOL, 2).counts(r)) == [3, 1, 0, 0]
    assert H.SingleBarcode(ONE, POOL).summary(r).first()[0] == 7


def test_both_strands_first_against_best(spark):
    # an inexact hit on the reverse strand, then an exact one forward
    r = reads(spark, "AAAAGTTTACGTxxACGTGGGGTTTT".replace("x", "c"))
    m = lambda first: [x["idx"] for x in H.SingleBarcode(ONE, POOL, 1, first, Strand.BOTH).matches(r).collect()]
    assert m(True) == [0] and m(False) == [2]


def test_best_is_torn_between_two_exact_hits(spark):
    two, same = "ACGTAAAATTTTACGTCCCCTTTT", "ccACGTAAAATTTTACGTAAAATTTT"
    got = H.SingleBarcode(ONE, POOL, 0, False).matches(reads(spark, two, same)).collect()
    assert [(r["read_id"], r["idx"], r["position"]) for r in got] == [(1, 0, 2)]


def test_distance_tie_is_no_match_unless_duplicates_say_so(spark):
    r = reads(spark, "ACGTATTATTTT")
    assert H.SingleBarcode(ONE, POOL, 2).matches(r).count() == 0
    pick = lambda d: H.SingleBarcode(ONE, POOL, 2, duplicates=d).matches(r).first()["idx"]
    assert pick(Duplicates.FIRST) == 0 and pick(Duplicates.LAST) == 3


def test_iupac_pools(spark):
    r = reads(spark, "ACGTAGATTTTT".replace("AGAT", "AGAA"), "ACGTCGCCTTTT", "ACGTTCTTTTTT".replace("TCTT", "TCGT"))
    d = H.SingleBarcode(ONE, ["ARRA", "CSSC", "GKKG", "TNNT"])
    assert counts(d.counts(r)) == [1, 1, 0, 1]


def test_non_bases_cost_one_in_asymmetric_templates(spark):
    t = "ACGT----"
    d = lambda k: H.SingleBarcode(t, POOL, k)
    r = reads(spark, "ACGTAAAA", "NCGTAAAA", "NNGTAAAA", "ACGTNAAA")
    assert [d(k).matches(r).count() for k in (0, 1, 2)] == [1, 3, 4]


@pytest.mark.parametrize("how", ["neighbours", "seeds", "brute"])
def test_lookup_strategies(spark, how):
    pool = BarcodePool(["AAAAAAB", "AAAAAAY", "TTTVTTT", "TTTRTTT"])
    df = spark.createDataFrame([(0, "AAAAAAC"), (1, "AAAAAAG"), (2, "TTTATTT"), (3, "TTTCTTT"), (4, "TTTTTTT"), (5, "NNNNNNN")], "read_id long, v string")
    got = lambda d: {r["read_id"]: (r["v_distance"], r["v_idx"], r["v_status"]) for r in lookup(df, "v", pool, 1, d, how).collect()}
    assert got(Duplicates.FIRST) == {0: (0, 0, "OK"), 1: (0, 0, "OK"), 2: (0, 2, "OK"), 3: (0, 2, "OK"), 4: (1, 2, "OK")}
    assert got(Duplicates.LAST) == {0: (0, 1, "OK"), 1: (0, 0, "OK"), 2: (0, 3, "OK"), 3: (0, 2, "OK"), 4: (1, 3, "OK")}
    assert got(Duplicates.NONE)[0] == (0, None, "AMBIGUOUS") and got(Duplicates.NONE)[1] == (0, 0, "OK")


def test_combinations_share_one_budget(spark):
    r = reads(spark, "AAAAAAAACGGCACACACTTTT", "AAAAAAAACGGCACACAGTTTT", "AAAAAATACGGCACACAGTTTT", "AAATAATACGGCACACAGTTTT")
    n = lambda k: {tuple(x) for x in H.CombinatorialBarcodes(TWO, [POOL, POOL6], k).combinations(r).collect()}
    assert n(0) == {(0, 0, 1)} and n(1) == {(0, 0, 2)} and n(2) == {(0, 0, 3)} and n(3) == {(0, 0, 4)}


def test_paired_competition(spark):
    p = pairs(spark, ("ACGTAAAATTTT", "ACGTCCCCTTTT"), ("ACGTAATATTTT", "ACGTCCCCTTTT"), ("ccc", "ACGTGGGGTTTT"), ("c", "g"))
    assert counts(H.SingleBarcodePaired(ONE, POOL, 1, True).counts(p)) == [2, 0, 1, 0]
    assert counts(H.SingleBarcodePaired(ONE, POOL, 1, False).counts(p)) == [0, 1, 1, 0]


def test_swapped_mates_and_one_only(spark):
    a, b = "AAAACCCCCGGC", "AGCTTGTGTGTTTT"
    p = pairs(spark, (a, b), (b, a), (a, "cc"), ("cc", b), ("c", "c"))
    d = H.CombinatorialBarcodesPaired(LEFT, POOL, RIGHT, POOL6)
    assert [tuple(r) for r in d.combinations(p).collect()] == [(1, 1, 1)] and tuple(d.summary(p).first()) == (5, 1, 1)
    for first in (True, False):
        d = H.CombinatorialBarcodesPaired(LEFT, POOL, RIGHT, POOL6, use_first=first, random=True)
        assert [tuple(r) for r in d.combinations(p).collect()] == [(1, 1, 2)] and tuple(d.summary(p).first()) == (5, 1, 1)


def test_dual_pairs_with_diagnostics(spark):
    valid = [("AAAACCCCCGGC", "AGCTTGTGTGTTTT"), ("AAAAGGGGCGGC", "AGCTAGAGAGTTTT")]
    p = pairs(spark, *valid, ("AAAAGGGGCGGC", "AGCTTGTGTGTTTT"), ("AAAACCCCCGGC", "c"), ("c", "AGCTAGAGAGTTTT"))
    d = H.DualBarcodesPairedDiagnostics(LEFT, POOL, RIGHT, POOL6)
    assert counts(d.counts(p)) == [0, 1, 1, 0]
    assert [tuple(r) for r in d.combinations(p).collect()] == [(2, 1, 1)] and tuple(d.summary(p).first()) == (5, 1, 1)
    with pytest.raises(ValueError):
        H.DualBarcodesPaired(LEFT, POOL, RIGHT, POOL6, strand1=Strand.BOTH)


def test_segment_caps_decide_which_barcodes_compete(spark):
    d = H.DualBarcodesPaired("A-C", ["A", "G"], "A--C", ["AC", "AA"], max_mismatches1=1, max_mismatches2=0)
    got = d.matches(pairs(spark, ("AAC", "AAAC"))).collect()
    assert [r["idx"] for r in got] == [1]


def test_dual_single_end_with_diagnostics(spark):
    t = "AAAA----CGGCAGCT------TTTT"
    seq = lambda a, b: f"AAAA{a}CGGCAGCT{b}TTTT"
    r = reads(spark, seq("CCCC", "TGTGTG"), seq("GGGG", "AGAGAG"), seq("GGGG", "TGTGTG"), seq("TTTT", "ACACAC"), "cc")
    d = H.DualBarcodesDiagnostics(t, [POOL, POOL6])
    assert counts(d.counts(r)) == [0, 1, 1, 0] and sorted(map(tuple, d.combinations(r).collect())) == [(2, 1, 1), (3, 0, 1)]


def test_random_barcodes(spark):
    r = reads(spark, "ACGTAGNATTTT", "AAAATNTTACGT", "ACGTNNNNTTTT")
    got = {x["barcode"] for x in H.RandomBarcode(ONE, 0, True, Strand.BOTH).counts(r).collect()}
    assert got == {"AGNA", "AANA", "NNNN"}
    with pytest.raises(Exception, match="cannot complement unknown base 'X'"):
        H.RandomBarcode(ONE, 0, True, Strand.BOTH).counts(reads(spark, "AAAATXTTACGT")).collect()
    # the region of a reverse hit is where the turned template has it
    got = H.RandomBarcode("ACGTCA--TG", 0, True, Strand.REVERSE).matches(reads(spark, "CAGGTGACGT")).first()
    assert got["barcode"] == "CC"


@pytest.mark.parametrize(
    ("make", "message"),
    [
        (lambda: Template("ACGT----", max_size=4), "maximum template size should be"),
        (lambda: Template("ACNT"), "unknown base"),
        (lambda: Template("ACNT", Strand.REVERSE), "cannot complement unknown base"),
        (lambda: BarcodePool(["AC", "ACG"]), "should be of a constant length"),
        (lambda: BarcodePool(["AU"]), "unknown base 'U' detected when constructing the trie"),
        (lambda: H.SingleBarcode("ACGT", POOL), "expected one variable region in the constant template"),
        (lambda: H.SingleBarcode("ACGT---", POOL), "should be the same as the barcode_pool"),
        (lambda: H.SingleBarcode(ONE, ["ACGT", "ACGT"]), r"duplicate sequences detected \(1, 2\)"),
        (lambda: H.SingleBarcode(ONE, ["ACGN", "ACGT"]), r"duplicate sequences detected \(1, 2\)"),
        (lambda: H.CombinatorialBarcodes(TWO, [POOL]), "length of 'barcode_pools' should be equal"),
        (lambda: H.CombinatorialBarcodes(TWO, [POOL, POOL]), "length of variable region 2"),
        (lambda: H.DualBarcodes(TWO, [POOL]), "length of 'barcode_pools' should equal the number of variable regions"),
        (lambda: H.DualBarcodes(TWO, [POOL, POOL6[:3]]), "same length"),
        (lambda: H.DualBarcodesPaired(LEFT, POOL, RIGHT, POOL6[:2]), "both barcode pools should be of the same length"),
        (lambda: H.DualBarcodesPaired("ACGT", POOL, RIGHT, POOL6), "expected one variable region in the first constant template"),
        (lambda: H.RandomBarcode("AC--GT--"), "expected one variable region"),
        (lambda: concatenated([BarcodePool(POOL), BarcodePool(POOL[:1])]), "same length"),
    ],
)
def test_validation(make, message):
    with pytest.raises(ValueError, match=message):
        make()
