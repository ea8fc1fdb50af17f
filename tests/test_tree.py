import random

import pytest

from seqtally.functions.bases import IUPAC
from seqtally.operators import tree
from seqtally.operators.lookup import lookup, lookup_remembered, strategy
from seqtally.operators.pool import BarcodePool
from seqtally.schema import Duplicates


@pytest.mark.parametrize("frontier", [1 << 20, 50])
@pytest.mark.parametrize(("letters", "n", "size"), [("ACGT", 5, 200), ("ACGTRYNNN", 6, 150), ("N", 3, 4), ("ACGTN", 1, 6)])
def test_nearest_against_brute_force(monkeypatch, frontier, letters, n, size):
    monkeypatch.setattr(tree, "MOST_FRONTIER", frontier)
    rng = random.Random(str((letters, n)))
    pool = BarcodePool(["".join(rng.choices(letters, k=n)) for _ in range(size)])
    seen = ["".join(rng.choices("ACGTN", [5, 5, 5, 5, 1], k=n)) for _ in range(300)] + [None, "", "A" * (n + 1)]
    for cap in (0, 1, 2, n, n + 3):
        distance, first, last = tree.PoolTree(pool).nearest(seen, cap)
        for s, d, a, b in zip(seen, distance.tolist(), first.tolist(), last.tolist(), strict=True):
            far = [sum(x not in IUPAC[c] for x, c in zip(s, p, strict=True)) for p in pool.sequences] if s is not None and len(s) == n else []
            least = min(far, default=n + 9)
            if least > cap:
                assert d == -1
            else:
                near = [i for i, f in enumerate(far) if f == least]
                assert (d, a, b) == (least, near[0], near[-1])


def test_wide_pools_of_any_size_go_by_the_tree(spark):
    rng = random.Random(1)
    pool = BarcodePool(["".join(rng.choice("ACGT") if j % 2 else "N" for j in range(20)) for _ in range(5000)])
    assert pool.is_wide and strategy(pool, 1) == "tree"
    rows = [(i, "".join(rng.choice("ACGT") if c == "N" else c for c in pool[i])) for i in range(0, 5000, 50)]
    got = {r.read_id: (r.v_distance, pool[r.v_idx] == pool[r.read_id]) for r in lookup(spark.createDataFrame(rows, "read_id int, v string"), "v", pool, 1, Duplicates.FIRST).collect()}
    assert got == {i: (0, True) for i, _ in rows}


def test_strings_met_before_are_not_looked_up_again(spark, tmp_path, monkeypatch):
    from seqtally.operators import lookup as L

    pool = BarcodePool(["AAAA", "CCCC", "GGGG", "AAAA"])
    one = spark.createDataFrame([(0, "AAAA"), (1, "CCCA"), (2, "TTTT"), (3, None), (4, "ACAC")], "read_id int, v string")
    two = one.unionByName(spark.createDataFrame([(5, "GGGT"), (6, "CCCA")], "read_id int, v string"))
    shown = lambda df: sorted(map(str, df.collect()))
    asked, plain = [], L.lookup
    monkeypatch.setattr(L, "lookup", lambda df, *a, **k: (asked.append(sorted(r[0] for r in df.collect())), plain(df, *a, **k))[1])
    for duplicates in (Duplicates.FIRST, Duplicates.LAST, Duplicates.NONE):
        path = str(tmp_path / duplicates.value)
        assert shown(lookup_remembered(one, "v", pool, 2, duplicates, path)) == shown(plain(one, "v", pool, 2, duplicates))
        assert shown(lookup_remembered(two, "v", pool, 2, duplicates, path)) == shown(plain(two, "v", pool, 2, duplicates))
        assert asked[0] == ["AAAA", "ACAC", "CCCA", "TTTT"] and asked[2] == ["GGGT"]
        asked.clear()
