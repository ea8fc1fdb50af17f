import random
import time

import pytest

from seqtally.functions.bases import IUPAC
from seqtally.operators import handlers as H
from seqtally.operators.lookup import choose_keys, lookup_segments
from seqtally.operators.pool import BarcodePool
from seqtally.schema import Duplicates


def brute(rows, pools, duplicates):
    out = {}
    for row in rows:
        key, strings, caps = row[0], row[1 : 1 + len(pools)], row[1 + len(pools) :]
        found = []
        for i in range(len(pools[0])):
            d = [sum(b not in IUPAC[c] for b, c in zip(v, p[i], strict=True)) for v, p in zip(strings, pools, strict=True)]
            if all(x <= c for x, c in zip(d, caps, strict=True)):
                found.append((sum(d), i))
        if found:
            least = min(found)[0]
            near = [i for d, i in found if d == least]
            idx = {Duplicates.FIRST: near[0], Duplicates.LAST: near[-1]}.get(duplicates, near[0] if len(near) == 1 else None)
            out[key] = (least, idx)
    return out


@pytest.mark.parametrize("letters", ["ACGT", "ACGTRYN"])
@pytest.mark.parametrize(("shape", "most", "entries"), [((6, 5), (1, 1), 500_000), ((6, 5), (1, 2), 3000), ((6, 5), (2, 1), 0), ((4, 3, 5), (1, 0, 2), 500_000), ((4, 3, 5), (1, 1, 1), 0), ((2, 6), (2, 1), 0), ((2, 2), (2, 2), 0), ((2, 2), (2, 3), 500_000)])
def test_tuples_against_brute_force(spark, letters, shape, most, entries):
    """Keys that are broadcast and keys that are joined, of some segments or of all, with caps of whole lengths too."""
    rng = random.Random(str((letters, shape, most, entries)))
    few = [["".join(rng.choices(letters, weights=[10] * 4 + [1] * (len(letters) - 4), k=n)) for _ in range(3)] for n in shape]
    pools = [[rng.choice(few[k]) if k == 0 else "".join(rng.choices("ACGT", k=n)) for _ in range(40)] for k, n in enumerate(shape)]

    def observed(k, n):
        s = rng.choice(pools[k])
        return "".join(rng.choice("ACGTN") if rng.random() < 0.25 else rng.choice(IUPAC[c]) for c in s)

    rows = [(i, *(observed(k, n) for k, n in enumerate(shape)), *(rng.randrange(0, m + 1) for m in most)) for i in range(300)]
    names = [f"v{k}" for k in range(len(shape))], [f"c{k}" for k in range(len(shape))]
    df = spark.createDataFrame(rows, ", ".join(["read_id int", *(f"{c} string" for c in names[0]), *(f"{c} int" for c in names[1])]))
    for duplicates in (Duplicates.FIRST, Duplicates.NONE):
        got = lookup_segments(df, [(v, BarcodePool(p), c) for v, p, c in zip(names[0], pools, names[1], strict=True)], duplicates, list(most), entries)
        assert {r["read_id"]: (r["distance"], r["idx"]) for r in got.collect()} == brute(rows, pools, duplicates)


def test_keys_are_of_the_segment_that_tells_tuples_apart():
    rng = random.Random(0)
    dna = lambda n: "".join(rng.choices("ACGT", k=n))
    one, many = ["ACGTACGT"] * 4000, [dna(8) for _ in range(4000)]
    assert choose_keys([BarcodePool(one), BarcodePool(many)], [1, 1]).near == (1,)
    assert choose_keys([BarcodePool(many), BarcodePool(one)], [1, 1]).near == (0,)
    grid = [[dna(8) for _ in range(64)] for _ in range(2)]
    both = choose_keys([BarcodePool([grid[0][i // 64] for i in range(4096)]), BarcodePool([grid[1][i % 64] for i in range(4096)])], [1, 1])
    assert len(both.near + both.parts) == 2


def test_shared_first_barcodes_cost_no_more(spark):
    """4,000 tuples with one first barcode against 4,000 with different ones: the same plan for both."""
    rng = random.Random(1)
    dna = lambda n: "".join(rng.choices("ACGT", k=n))
    second = list(dict.fromkeys(dna(10) for _ in range(4000)))
    took = {}
    for kind, first in (("different", [dna(10) for _ in second]), ("shared", ["ACGTTGCAAC"] * len(second))):
        d = H.DualBarcodesPaired("AAAA----------CGGC", first, "AGCT----------TTTT", second, 1, 1, False, duplicates=Duplicates.FIRST)
        rows = [(i, f"AAAA{first[k]}CGGC", f"AGCT{second[k]}TTTT") for i, k in enumerate(rng.choices(range(len(second)), k=2000))]
        pairs = spark.createDataFrame(rows, "read_id long, seq1 string, seq2 string")
        best = []
        for _ in range(2):
            began = time.time()
            assert d.matches(pairs).count() == 2000
            best.append(time.time() - began)
        took[kind] = min(best)
    print(took)
    assert took["shared"] < 2 * took["different"] + 2
