"""Outcomes by array operations are those inside the row."""

import random

import pytest
from pyspark.sql import functions as F

from seqtally.operators import handlers as H
from seqtally.operators.outcomes import columns_of, outcome, tally
from seqtally.schema import Duplicates, Strand

POOLS = [["ACGT", "ACGA", "CCCC", "RNTA", "ACGT"], ["TTAGC", "TTAGA", "GGGGG", "WSTAG", "TTAGC"]]
TWO = "AC----GT-----CA"


def reads(spark):
    """Reads with several hits, of either strand and any case, short, empty and null ones, and letters that become two in upper case or take two bytes."""
    rng = random.Random(5)
    flip = str.maketrans("ACGTacgt", "TGCAtgca")
    out = [None, "", "AC", "ß" * 15, "AC"]
    for i in range(150):
        s = ""
        for _ in range(rng.randrange(1, 4)):
            hit = "AC" + rng.choice(POOLS[0]).translate(str.maketrans("RN", "AC")) + "GT" + rng.choice(POOLS[1]).translate(str.maketrans("WS", "AC")) + "CA"
            hit = "".join(rng.choice("ACGTNxéßŉ𝔸") if rng.random() < 0.06 else c for c in hit)
            s += "".join(rng.choices("ACGT", k=rng.randrange(5))) + (hit[::-1].translate(flip) if rng.random() < 0.4 else hit)
        out.append(s.lower() if i % 7 == 0 else s)
    return spark.createDataFrame(list(enumerate(out)), "read_id long, seq string").repartition(3).cache()


def same(r, d):
    made = tally(r, d)
    assert "MapInArrow" in made._jdf.queryExecution().toString()
    want = r.select(outcome(d).alias("o")).select("o.*").groupBy("kind", *columns_of(d)).agg(F.count("*").alias("count"))
    shown = lambda df: sorted(map(str, (tuple(x) for x in df.collect())))
    assert shown(made) == shown(want)
    weighed = r.withColumn("w", F.col("read_id") % 3)
    want = weighed.select(outcome(d).alias("o"), "w").select("o.*", "w").groupBy("kind", *columns_of(d)).agg(F.sum("w").alias("count"))
    assert shown(tally(weighed, d, "w")) == shown(want)


@pytest.mark.parametrize("strand", [Strand.REVERSE, Strand.BOTH])
@pytest.mark.parametrize(("first", "duplicates"), [(True, Duplicates.FIRST), (False, Duplicates.NONE), (False, Duplicates.LAST)])
def test_tuples_of_one_read(spark, strand, first, duplicates):
    same(reads(spark), H.DualBarcodes(TWO, POOLS, 2, first, strand, duplicates))


@pytest.mark.parametrize(("first", "duplicates"), [(True, Duplicates.LAST), (False, Duplicates.NONE)])
def test_one_barcode_of_one_read(spark, first, duplicates):
    same(reads(spark), H.SingleBarcode("AC----GT", POOLS[0], 1, first, Strand.BOTH, duplicates))
    same(reads(spark), H.SingleBarcode("AC----GT", [], 1, first, Strand.FORWARD, duplicates))


def test_tuples_and_what_reads_hold_instead(spark):
    same(reads(spark), H.DualBarcodesDiagnostics(TWO, POOLS, max_mismatches=1, use_first=False, strand=Strand.BOTH, duplicates=Duplicates.NONE))
