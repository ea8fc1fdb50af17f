import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqtally.llm.queries import oracle_sql, queries
from seqtally.llm.tries import conversations, prefix_trie, with_shared_openings

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(w)] for c, w in own.items()}
    nodes, ends = defaultdict(list), defaultdict(list)
    for c, w in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        w = own.get(c - c % 100, [])[:h] + w[h:]
        for d in range(len(w) + 1):
            nodes[tuple(w[:d])].append(c)
        ends[tuple(w)].append(c)
    children = defaultdict(list)
    for p in nodes:
        if p:
            children[p[:-1]].append(p)
    leaves, saved, out = {}, {}, []
    for p in sorted(nodes, key=len, reverse=True):
        leaves[p] = sum(leaves[q] for q in children[p]) if children[p] else 1
        saved[p] = (len(nodes[p]) - 1) * (len(p[-1][1]) if p else 0) + sum(saved[q] for q in children[p])
        sha = hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()
        out.append((min(nodes[p]), len(p), min(nodes[p[:-1]]) if p else None, len(nodes[p]), len(children[p]), leaves[p], saved[p], sha))
    return sorted(out, key=repr)


def made(spark, rows, part_turns):
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    out = prefix_trie(with_shared_openings(conversations(df)), part_turns=part_turns).select(*COLUMNS)
    return sorted((tuple(r) for r in out.collect()), key=repr)


def tables():
    rng = np.random.default_rng(1)
    text = lambda: ["a", "bé中", "", None, "longer text \U0001f600"][int(rng.integers(0, 5))]
    rows = []
    for c in [*range(0, 260), 300, *range(301, 330, 3), 10**12, 10**12 + 1, *range(501, 540)]:
        for t in range(int(rng.integers(0, 9))):
            rows.append((c, t if rng.random() > 0.05 else None, ["user", "assistant", None][t % 3], text()))
    rows += [(700 + i, t, "user", f"same {t}") for i in range(60) for t in range(12)]  # copies
    rows += [(901, t, "user", f"long {t}") for t in range(3000)] + [(902, t, "user", f"long {t}") for t in range(2500)]
    rows += [(1001, None, None, None), (1002, 5, "", ""), (1003, 1, "user", "tie b"), (1003, 1, "user", "tie a"), (1003, 1, "assistant", "tie c"), (1003, 1, "user", "tie a")]
    rows += [(None, 1, "user", "nobody's"), rows[5], rows[5]]
    return rows


@pytest.mark.parametrize("part_turns", [10**9, 400, 60])
def test_against_brute_force(spark, part_turns):
    """In one range and in many, whose bounds stand inside copies and long conversations."""
    rows = tables()
    assert made(spark, rows, part_turns) == brute(rows)


@pytest.mark.parametrize("seed", range(3))
def test_small_alphabets(spark, seed):
    """Many arrays that begin alike, more ranges than some openings have arrays."""
    rng = np.random.default_rng(seed)
    rows = [(int(c), t, "u", str(rng.integers(0, 2))) for c in range(1, 150) for t in range(int(rng.integers(0, 7)))]
    assert made(spark, rows, 5) == brute(rows)


def test_empty_and_clashing_tables(spark):
    assert made(spark, [], 10) == []
    assert made(spark, [(None, 1, "u", "x")], 10) == []
    rows = [(7, 1, "u", "x"), (8, 1, "u", "x")]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("turns", "digest", "key", "chars", "least", "n", "name", "_head", "_c")})
    assert sorted((tuple(r) for r in prefix_trie(with_shared_openings(conversations(df))).select(*COLUMNS).collect()), key=repr) == brute(rows)


def test_query_against_sql(spark, sf):
    import duckdb

    got = queries()["op12_prefix_trie"](spark, sf)
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{sf}/conversations.parquet'")
    want = sorted(con.execute(oracle_sql()["op12_prefix_trie"]).fetchall(), key=repr)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == want and len(want) > 20
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted((r[:8] for r in want), key=repr) == brute(rows)
