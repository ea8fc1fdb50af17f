import hashlib
import re

import numpy as np
import pytest
import xxhash

from seqtally.llm import simhash
from seqtally.llm.components import components
from seqtally.llm.passages import remove_repeats
from seqtally.llm.queries import queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_kept(rows, window=13):
    """(doc_id, words, words removed, kept text) of each row, in order."""
    words = [WORD.findall(t or "") for _, t in rows]
    ids = [float("inf") if d is None else d for d, _ in rows]
    first = {}
    for d, w in zip(ids, words, strict=True):
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            first[k] = min(first.get(k, float("inf")), d)
    out = []
    for (doc_id, _), d, w in zip(rows, ids, words, strict=True):
        gone = set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < d:
                gone.update(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((doc_id, len(w), len(gone), kept))
    return out


def brute_passages(rows, window=13):
    return sorted((str(d), n, gone, hashlib.sha256(kept.encode()).hexdigest()) for d, n, gone, kept in brute_kept(rows, window))


@pytest.mark.parametrize("name", ["edge", "documents", "clashing"])
def test_passages_against_brute_force(request, name):
    docs = request.getfixturevalue(name)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = remove_repeats(docs, digest=True).collect()
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got) == brute_passages(rows)


@pytest.mark.parametrize("order", [1, -1])
@pytest.mark.parametrize("n", [1024, 2048, 4096])
def test_words_that_only_hash_alike_are_no_repeat(spark, order, n):
    """Two words of two letters, swapped: every polynomial hash modulo 2^64 of them is the same."""
    t = "".join("ab"[k.bit_count() % 2] for k in range(n))
    u = t.translate(str.maketrans("ab", "ba"))
    rest = " ".join(f"w{i}" for i in range(12))
    rows = list(zip((1, 2, 3), (f"{t} {rest}", f"{u} {rest}", f"x {t} {rest}")[::order], strict=True))
    got = remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), digest=True).collect()
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got) == brute_passages(rows)
    assert sum(r["n_removed"] for r in got) == 13


def test_passages_leave_no_table_behind(spark, documents):
    before = {t.name for t in spark.catalog.listTables()}
    out = remove_repeats(documents)
    assert out.count() == documents.count() and {t.name for t in spark.catalog.listTables()} == before


def test_passages_over_many_small_chunks(spark, documents, monkeypatch):
    from seqtally.llm import passages

    monkeypatch.setattr(passages, "CHUNK_BYTES", 4000)
    monkeypatch.setattr(passages, "PART_WORDS", 5000)
    docs = documents.repartition(5)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = remove_repeats(docs).collect()
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], hashlib.sha256(r["kept_text"].encode()).hexdigest()) for r in got) == brute_passages(rows)


@pytest.mark.parametrize("shift", range(8))
def test_a_repeat_of_exactly_one_window_is_found(spark, shift):
    shared = " ".join(f"s{i}" for i in range(13))
    a = " ".join(f"a{i}" for i in range(shift)) + " " + shared + " x y z"
    b = "q r t " + shared + " " + " ".join(f"b{i}" for i in range(20))
    c = "m n o " + " ".join(f"s{i}" for i in range(12)) + " end of it all and more words here ok"
    rows = spark.createDataFrame([(3, a), (9, b), (10, c)], "doc_id long, text string")
    assert {r["doc_id"]: r["n_removed"] for r in remove_repeats(rows).collect()} == {3: 0, 9: 13, 10: 0}


def test_passages_keep_other_columns_and_empty_tables(spark, none, clashing):
    assert remove_repeats(none).count() == 0
    out = remove_repeats(clashing)
    assert out.columns[:2] == ["doc_id", "text"] and "payload" in out.columns and out.columns[-3:] == ["n_words", "n_removed", "kept_text"]
    assert {bytes(r["payload"]) for r in out.collect()} == {b"p"}
    with pytest.raises(ValueError):
        remove_repeats(none, window=10, block=7)


# --- SimHash --------------------------------------------------------------------------------------


def brute_fingerprint(text, n=3):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(w[i : i + n]) for i in range(len(w) - n + 1)] if len(w) >= n else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(rows, distance=3):
    fp = np.array([brute_fingerprint(t) for _, t in rows], np.uint64)
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in np.flatnonzero(np.bitwise_count(fp ^ fp[i]) <= distance):
            a, b = find(i), find(int(j))
            parent[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        least[r] = min((x for x in (least.get(r), d) if x is not None), default=None)
    return sorted((str(d), f"{int(fp[i]):016x}", str(least[find(i)])) for i, (d, _) in enumerate(rows))


def shown(df):
    return sorted((str(r["doc_id"]), r["fingerprint"], str(r["component_id"])) for r in df.collect())


@pytest.mark.parametrize("name", ["edge", "documents", "clashing"])
def test_simhash_against_brute_force(request, name):
    docs = request.getfixturevalue(name)
    assert shown(simhash.near_duplicates(docs)) == brute_groups([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_large_buckets_are_divided(spark, documents):
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    base = rows[3][1].split()
    rng = np.random.default_rng(1)
    for k in range(60):  # many near copies of one text
        w = list(base)
        w[int(rng.integers(len(w)))] = f"new{k}"
        rows.append((10_000 + k, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert shown(simhash.near_duplicates(docs, most=10)) == brute_groups(rows)


@pytest.mark.parametrize("m", [1, 2, 3, 4])
def test_every_plan_of_thresholds_finds_all_pairs(m):
    rng = np.random.default_rng(m)
    x = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    bits = np.unpackbits(x.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(float)
    groups = simhash.correlated_groups(len(x), bits.T @ bits, m)
    assert sorted(b for g in groups for b in g) == list(range(64))
    masks = [simhash.mask_of(g) for g in groups]
    costs = [[1.0 + i * 7 % 3, 3.0, 2.0 + i, 9.0] for i in range(m)]
    _, thresholds = simhash.allocate(costs, 3)
    assert sum(t + 1 for t in thresholds) == 4
    for _ in range(2000):
        a = int(rng.integers(0, 1 << 62))
        b = a ^ simhash.mask_of([int(i) for i in rng.choice(64, 3, replace=False)])
        assert any(t >= 0 and ((a ^ b) & mask).bit_count() <= t for mask, t in zip(masks, thresholds, strict=True))


def test_probes_reach_all_values_within_the_threshold():
    mask = 0b1011_0001
    assert len(simhash.flips(mask, 2)) == 4 + 6 and all(f & ~mask == 0 for f in simhash.flips(mask, 2))


def test_search_with_unequal_thresholds(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 62, 200, dtype=np.uint64)
    near = np.array([int(b) ^ simhash.mask_of([int(i) for i in rng.choice(64, int(rng.integers(1, 5)), replace=False)]) for b in base], np.uint64)
    every = np.unique(np.concatenate([base, near]))
    df = spark.createDataFrame([(int(v),) for v in every.view(np.int64)], "fp long")
    want = {frozenset((int(every[i]), int(every[j]))) for i in range(len(every)) for j in np.flatnonzero(np.bitwise_count(every ^ every[i]) <= 3) if i != j}
    parts = [(simhash.mask_of(range(0, 24)), 1), (simhash.mask_of(range(24, 40)), 0), (simhash.mask_of(range(40, 64)), 0)]
    got = {frozenset((r["a"] % (1 << 64), r["b"] % (1 << 64))) for r in simhash.near_pairs(df, parts).collect()}
    assert got <= want
    parent = {int(v): int(v) for v in every}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for e in got:
        a, b = map(find, e)
        parent[a] = b
    assert all(len({find(x) for x in e}) == 1 for e in want)


def test_simhash_empty_table(none):
    assert simhash.near_duplicates(none).count() == 0


def test_components(spark):
    chain = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (101, 102), (102, 100), (7, 7), (200, 200), (100, 101)] + [(300, 300 + k) for k in range(1, 50)]
    got = dict(components(spark.createDataFrame(chain, "a long, b long")).collect())
    assert got == {**{i: 1 for i in range(1, 41)}, 100: 100, 101: 100, 102: 100, **{300 + k: 300 for k in range(50)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_queries(spark, sf, documents):
    q = queries()
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    assert shown(q["op9_simhash"](spark, sf)) == brute_groups(rows)
    assert sorted((str(r[0]), *r[1:]) for r in q["op3_passages"](spark, sf).collect()) == brute_passages(rows)
