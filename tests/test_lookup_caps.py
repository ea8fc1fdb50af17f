import pytest

from seqtally.operators import lookup as lk
from seqtally.operators.pool import BarcodePool
from seqtally.schema import Duplicates

POOL = BarcodePool(["AAC", "CAC", "AAA"])
STRINGS = ["AAC", "GGG", "GGC", "TTT", "NNN"]


@pytest.mark.parametrize("cap", [2, 3, 4])
@pytest.mark.parametrize("duplicates", list(Duplicates))
def test_strategies_agree_up_to_caps_of_the_whole_length(spark, cap, duplicates):
    df = spark.createDataFrame([(s,) for s in STRINGS], "v string")
    brute, neighbours, seeds = (sorted(map(str, lk.lookup(df, "v", POOL, cap, duplicates, how).collect())) for how in ("brute", "neighbours", "seeds"))
    assert brute == neighbours == seeds and (len(brute) == len(STRINGS)) == (cap >= 3)


def test_segments_agree_at_a_cap_of_the_whole_length(spark, monkeypatch):
    df = spark.createDataFrame([(s, "AC", 3, 1) for s in STRINGS], "a string, b string, ca int, cb int")
    segments = [("a", POOL, "ca"), ("b", BarcodePool(["AC", "AG", "TT"]), "cb")]
    rows = lambda: sorted(map(str, lk.lookup_segments(df, segments, Duplicates.FIRST, 3).select("a", "b", "distance", "idx", "status").collect()))
    want = rows()
    monkeypatch.setattr(lk, "MOST_NEIGHBOURS", 3)
    assert rows() == want and len(want) == len(STRINGS)
