import random

import pytest

from seqtally.operators import handlers as H
from seqtally.operators import outcomes
from seqtally.operators.outcomes import COMBINATION, MATCH, ONE_ONLY, TWO_ONLY, columns_of, counts_of, folded, tally
from seqtally.schema import Duplicates, Strand

POOL, POOL6 = ["AAAA", "CCCC", "GGGG", "ACCA", "TGGT"], ["ACACAC", "TGTGTG", "AGAGAG", "CTCTCT", "ACACAG"]
ONE, TWO = "ACGT----TT", "AC----GG------TT"
LEFT, RIGHT = "AC----GG", "AG------TT"


def noisy(rng, text, rate=0.12):
    text = "".join(rng.choice("ACGTNacgtX") if rng.random() < rate else c for c in text)
    return "".join(rng.choices("ACGT", k=rng.randrange(4))) + text + "".join(rng.choices("ACGT", k=rng.randrange(4)))


def flip(s):
    return s[::-1].translate(str.maketrans("ACGTacgt", "TGCAtgca"))


def data(spark):
    rng = random.Random(2)
    fill = lambda t, *v: "".join([t.split("-")[0]] + [x + y for x, y in zip(v, [p for p in t.replace("-", " ").split()][1:], strict=True)])
    reads, pairs = [None, "", "ACG"], [(None, "A"), ("", ""), ("ACAAAAGG", None)]
    for i in range(250):
        one = noisy(rng, fill(ONE, rng.choice(POOL))) + (noisy(rng, fill(ONE, rng.choice(POOL))) if i % 4 == 0 else "")
        two = noisy(rng, fill(TWO, rng.choice(POOL), rng.choice(POOL6)))
        k = rng.randrange(5)
        a, b = noisy(rng, fill(LEFT, POOL[k])), noisy(rng, fill(RIGHT, POOL6[k if i % 3 else rng.randrange(5)]))
        if i % 7 == 0:
            a += noisy(rng, fill(LEFT, rng.choice(POOL)))
        reads += [flip(x) if i % 5 == 0 else x for x in (one, two)]
        pairs.append((a, b) if i % 2 else (b, a))
    r = spark.createDataFrame(list(enumerate(reads)), "read_id long, seq string").repartition(3).cache()
    p = spark.createDataFrame([(i, *x) for i, x in enumerate(pairs)], "read_id long, seq1 string, seq2 string").repartition(3).cache()
    return r, p


def designs(first, duplicates):
    o = {"use_first": first, "duplicates": duplicates}
    yield "r", H.SingleBarcode(ONE, POOL, 2, strand=Strand.BOTH, **o)
    yield "p", H.SingleBarcodePaired(LEFT, POOL, 1, **o)
    yield "r", H.CombinatorialBarcodes(TWO, [POOL, POOL6], 2, strand=Strand.BOTH, **o)
    yield "r", H.DualBarcodes(TWO, [POOL, POOL6], 2, strand=Strand.BOTH, **o)
    yield "r", H.DualBarcodesDiagnostics(TWO, [POOL, POOL6], max_mismatches=1, strand=Strand.REVERSE, **o)
    for swapped in (False, True):
        yield "p", H.CombinatorialBarcodesPaired(LEFT, POOL, RIGHT, POOL6, 1, 2, random=swapped, **o)
        yield "p", H.DualBarcodesPaired(LEFT, POOL, RIGHT, POOL6, 1, 2, random=swapped, **o)
        yield "p", H.DualBarcodesPairedDiagnostics(LEFT, POOL, RIGHT, POOL6, max_mismatches1=1, max_mismatches2=1, random=swapped, **o)


def rows(df):
    return sorted(map(str, (tuple(r) for r in df.collect())))


@pytest.mark.parametrize(("first", "duplicates"), [(True, Duplicates.FIRST), (False, Duplicates.NONE)])
def test_tallies_give_all_results_of_a_design(spark, first, duplicates):
    r, p = data(spark)
    tables = {"r": r, "p": p}
    for side, d in designs(first, duplicates):
        reads, name = tables[side], f"{type(d).__name__} {first} {duplicates}"
        t = tally(reads, d).cache()
        assert rows(counts_of(t, d).select(*d.plan(reads).columns)) == rows(d.plan(reads)), name
        kinds = {}
        for x in t.collect():
            kinds[x["kind"]] = kinds.get(x["kind"], 0) + x["count"]
        want = d.summary(reads).first().asDict()
        assert sum(kinds.values()) == want["total"], name
        assert [kinds.get(k, 0) for k in (ONE_ONLY, TWO_ONLY) if k in want] == [want[k] for k in (ONE_ONLY, TWO_ONLY) if k in want], name
        if "Diagnostics" in name:
            assert rows(t.filter(f"kind = '{MATCH}'").select("idx", "count")) == rows(d.counts(reads).filter("count > 0")), name
            assert COMBINATION in kinds
        shown = t._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in shown


def test_random_barcodes_and_weights(spark):
    r, p = data(spark)
    plain = r.filter("seq is null or not seq rlike 'X'")
    for first in (True, False):
        d = H.RandomBarcode(ONE, 1, first, Strand.BOTH)
        assert rows(counts_of(tally(plain, d), d)) == rows(d.counts(plain))
    d = H.SingleBarcode(ONE, POOL, 1, True, duplicates=Duplicates.FIRST)
    many = r.unionByName(r).unionByName(r.filter("read_id % 3 = 0"))
    assert rows(tally(folded(many), d, "weight")) == rows(tally(many, d))
    q = H.DualBarcodesPaired(LEFT, POOL, RIGHT, POOL6, 1, 1, duplicates=Duplicates.FIRST)
    assert rows(tally(folded(p.unionByName(p)), q, "weight")) == rows(tally(p.unionByName(p), q))


def test_empty_and_large_pools(spark):
    r, p = data(spark)
    d = H.SingleBarcode(ONE, [], 1, True, duplicates=Duplicates.FIRST)
    assert [x["kind"] for x in tally(r, d).collect()] == [None] and columns_of(d) == ["idx"]
    q = H.DualBarcodesPaired(LEFT, [], RIGHT, [], 1, 1)
    assert [x["kind"] for x in tally(p, q).collect()] == [None]
    large = ["".join("ACGT"[i >> 2 * k & 3] for k in range(7)) for i in range(outcomes.MOST_BRUTE + 1)]
    with pytest.raises(ValueError, match="too large"):
        outcomes.outcome(H.SingleBarcode("ACGT-------TT", large))


def test_a_stream_goes_on_after_it_is_stopped(spark, tmp_path):
    """Counts in the state store, in update mode: a stream stopped in the middle goes on, and a batch done again changes nothing."""
    from seqtally.streaming.counts import compact, latest, tally_stream

    _, p = data(spark)
    d = H.DualBarcodesPairedDiagnostics(LEFT, POOL, RIGHT, POOL6, max_mismatches1=1, max_mismatches2=1, use_first=False, duplicates=Duplicates.FIRST)
    (tmp_path / "in").mkdir()

    def run(share):
        p.filter(f"read_id % 3 = {share}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("read_id long, seq1 string, seq2 string").parquet(str(tmp_path / "in"))
        tally_stream(stream, d, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()

    run(0)
    first = rows(latest(spark, str(tmp_path / "out"), d))
    assert first == rows(tally(p.filter("read_id % 3 = 0"), d))
    for f in (tmp_path / "state" / "commits").glob("*0*"):  # as if the first batch had not been marked as done
        f.unlink()
    run(1)
    run(2)
    assert rows(latest(spark, str(tmp_path / "out"), d)) == rows(tally(p, d))
    compact(spark, str(tmp_path / "out"), d, str(tmp_path / "small"))
    assert rows(latest(spark, str(tmp_path / "small"), d)) == rows(tally(p, d))
