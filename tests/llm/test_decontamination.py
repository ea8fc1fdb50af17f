import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqtally.llm.decontamination import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute(docs, items, window=10):
    table = defaultdict(set)
    for item, text in items:
        w = WORD.findall(lower(text))
        k = min(len(w), window)
        for i in range(len(w) - k + 1 if k else 0):
            table[tuple(w[i : i + k])].add(item)
    out = []
    for doc, text in docs:
        w = WORD.findall(lower(text))
        hit, found = np.zeros(len(w), bool), set()
        for k in {len(g) for g in table}:
            for i in range(len(w) - k + 1):
                if own := table.get(tuple(w[i : i + k])):
                    hit[i : i + k] = True
                    found |= own
        edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(int), [0]])))
        spans = tuple(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))
        out.append((doc, len(w), spans, tuple(sorted(str(x) for x in found if x is not None))))
    return sorted(out, key=repr)


def run(spark, docs, items, **options):
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    i = spark.createDataFrame(items, "item_id long, text string")
    rows = decontaminate(d, i, **options).collect()
    return sorted(((r.doc_id, r.n_words, tuple((s.start, s.end) for s in r.spans), tuple(r["items"])) for r in rows), key=repr)


def cases():
    rng = np.random.default_rng(5)
    word = lambda n, m: " ".join(f"W{x}" for x in rng.integers(0, m, n))
    items = [(i, word(int(rng.integers(10, 40)), 4)) for i in range(30)] + [(100 + i, word(i, 300)) for i in range(12)]
    items += [(7, items[3][1]), (200, items[3][1].lower()), (200, items[3][1]), (None, word(12, 300)), (300, None), (301, ""), (302, " .,;! "), (303, "Éa é 中文 x" + "y" * 40), (304, "a " * 25)]
    texts = [t for _, t in items if t]
    docs = [(i, word(60, 3)) for i in range(20)]
    docs += [(100 + i, f"{word(5, 9)} ;{t.upper().replace('É', 'É')}\n {word(3, 9)} {t}") for i, t in enumerate(texts)]
    docs += [(1000, None), (1001, ""), (1002, " .- "), (1003, " ".join(texts)), (1003, " ".join(texts)), (1004, word(20_000, 500) + " " + texts[0]), (1005, "a " * 500), (None, texts[1]), (1006, "\x00".join(texts[2].split()))]
    return docs, items


@pytest.mark.parametrize("most", [8 << 20, 0])
def test_against_brute_force(spark, most):
    docs, items = cases()
    assert run(spark, docs, items, index_bytes=most) == brute(docs, items)
    assert run(spark, docs[:60], items, index_bytes=most, window=6) == brute(docs[:60], items, 6)


@pytest.mark.parametrize("most", [8 << 20, 0])
def test_empty_and_clashing_tables(spark, none, clashing, most):
    nothing = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate(none, nothing, index_bytes=most - 1 if not most else most).count() == 0
    out = decontaminate(clashing.withColumns({"spans": F.lit(1), "items": F.lit(2), "item_id": F.lit(3), "_x": F.lit(4)}), nothing, index_bytes=-1 if not most else most)
    assert out.filter("size(spans) > 0 or size(items) > 0").count() == 0
    assert out.count() == clashing.count() and {"item_id", "_x", "score"} <= set(out.columns)


def test_sampled_windows_are_always_found(spark):
    """Every span of ten words that is shared is found, wherever it stands."""
    rng = np.random.default_rng(9)
    items = [(i, " ".join(f"i{x}" for x in rng.integers(0, 10**6, 50))) for i in range(40)]
    docs = []
    for n in range(400):
        w = items[n % 40][1].split()
        at = int(rng.integers(0, 41))
        docs.append((n, " ".join([f"d{x}" for x in rng.integers(0, 10**6, int(rng.integers(0, 30)))] + w[at : at + 10] + ["end"])))
    assert all(len(r[2]) == 1 and r[2][0][1] - r[2][0][0] == 10 for r in run(spark, docs, items))


def test_query_against_sql(spark, sf):
    import duckdb

    from seqtally.llm.queries import oracle_sql, queries

    got = sorted(tuple(r) for r in queries()["op13_decontamination"](spark, sf).collect())
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    want = sorted(con.execute(oracle_sql()["op13_decontamination"]).fetchall())
    assert got == want and any(r[5] for r in got)
