from fractions import Fraction

import numpy as np
import pytest
from test_dedup import WORD

import corpus_pipeline as cp
from seqtally.llm import copies
from seqtally.llm.simhash import near_duplicates


def brute_copies(rows, n=5, least=(4, 5)):
    """component_id of each row: every two texts compared on their sets of shingles."""
    sets = []
    for _, t in rows:
        w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if 5 * min(len(a), len(b)) >= 4 * max(len(a), len(b)) and least[1] * len(a & b) >= least[0] * len(a | b):
                parent[find(i)] = find(j)
    out = {}
    for i, (d, _) in enumerate(rows):
        out.setdefault(find(i), []).append(d)
    return sorted((str(d), str(min((x for x in ids if x is not None), default=None))) for ids in out.values() for d in ids)


def near(docs):
    return near_duplicates(docs, shingle=cp.SHINGLE, distance=cp.BITS, least=cp.SIMILARITY)


def shown(df):
    return sorted((str(r["doc_id"]), str(r["component_id"])) for r in df.collect())


@pytest.mark.parametrize("name", ["edge", "documents", "clashing", "none"])
def test_near_copies_against_brute_force(request, name):
    docs = request.getfixturevalue(name)
    assert shown(near(docs)) == brute_copies([(r["doc_id"], r["text"]) for r in docs.collect()])


@pytest.mark.parametrize("most", [copies.MOST_BROADCAST, 0])
def test_near_copies_of_edited_texts(spark, monkeypatch, most):
    """Copies with more and more words changed, among texts that share a long passage and nothing else."""
    monkeypatch.setattr(copies, "MOST_BROADCAST", most)
    rng, rows = np.random.default_rng(3), []
    passage = [f"p{i}" for i in range(60)]
    for g in range(6):
        base = [f"g{g}w{i}" for i in range(120)] + passage
        for k in range(12):
            w = list(base)
            for i in rng.choice(len(w), k // 2, replace=False):
                w[i] = f"new{g}_{k}_{i}"
            rows.append((100 * g + k, " ".join(w)))
    want = brute_copies(rows)
    assert 6 < len({c for _, c in want}) < len(rows)
    assert shown(near(spark.createDataFrame(rows, "doc_id long, text string"))) == want


def test_near_dedup_goes_by_similarity(spark, sf):
    """A copy with one word of sixty changed goes (51 of 61 shingles); one of the first 30 words stays."""
    w = [f"word{i}" for i in range(60)]
    texts = {1: w, 2: [*w[:30], "other", *w[31:]], 3: w[:30], 4: [*w[:10], "x", *w[11:30], "y", *w[31:50], "z", *w[51:]]}
    docs = spark.createDataFrame([(d, " ".join(t), "en", "s", 1) for d, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r["doc_id"] for r in cp.near_dedup(spark, docs, sf).collect()} == {1, 3, 4}


def test_pairs_at_the_similarity_itself(spark):
    """Short and long texts whose similarity is 0.8, just above and just below, with no fingerprints near each other."""
    rows = []
    for g, n in enumerate([*range(5, 60), 200, 1000]):
        base = [f"g{g}w{i}" for i in range(n)]
        rows += [(1000 * g + k, " ".join(base[: n - k] + [f"e{g}k{k}x{i}" for i in range(k)])) for k in (0, *range(1, 5), n // 9, n // 10, n // 11) if k < n]
    want = brute_copies(rows)
    assert shown(near(spark.createDataFrame(rows, "doc_id long, text string"))) == want
    assert len({c for _, c in want}) < len({t for _, t in rows})


def test_many_short_texts_with_one_common_shingle(spark):
    rows = [(i, f"please see the note below item{i % 900} of list{i % 700}") for i in range(1500)] + [(5000 + i, "please see the note below") for i in range(50)]
    assert shown(near(spark.createDataFrame(rows, "doc_id long, text string"))) == brute_copies(rows)


def test_far_copies_of_one_text_are_not_held_against_each_other(spark, monkeypatch):
    """Copies with five of 150 words changed are less than 0.8 similar to the text and to each other: comparisons grow with their number, not its square."""
    rng, compared = np.random.default_rng(8), []
    base = [f"w{i}" for i in range(150)]
    rows = [(0, " ".join(base))]
    for k in range(1, 241):
        w = list(base)
        for i in rng.choice(np.arange(5, 145, 10), 1 if k <= 40 else 5, replace=False) + rng.integers(0, 5):
            w[i] = f"new{k}_{i}"
        rows.append((k, " ".join(w)))
    real = copies.written

    def counting(df, *path):
        out = real(df, *path)
        compared.append(out.count() if out.columns == ["a", "b"] else 0)
        return out

    monkeypatch.setattr(copies, "written", counting)
    want = brute_copies(rows)
    assert len({c for _, c in want}) == 201
    assert shown(near(spark.createDataFrame(rows, "doc_id long, text string"))) == want
    assert 40 <= sum(compared) < 5 * len(rows)


def test_rows_of_similar_sets_meet():
    """Two similar sets share a row that leads from each to the other, and their parities don't forbid it."""
    rng, least, seen = np.random.default_rng(5), Fraction(4, 5), set()
    for _ in range(3000):
        n = int(rng.integers(1, 120))
        x = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        y = np.unique(np.append(rng.choice(x, len(x) - int(rng.integers(0, len(x) // 6 + 1)), replace=False), rng.integers(0, 1 << 63, int(rng.integers(0, n // 5 + 2)), dtype=np.uint64)))
        frequent = np.sort(rng.choice(x, len(x) // 2, replace=False))
        counts = rng.integers(1, 5, len(frequent))
        (hx, mx), (hy, my) = (copies.prefix(z, frequent, counts, least) for z in (x, y))
        _, i, j = np.intersect1d(hx, hy, return_indices=True)
        meet = bool(((mx[i] >= len(y)) & (my[j] >= len(x))).any())
        may = copies.may_be_similar(len(x), copies.parities(x), len(y), copies.parities(y), least)
        alike = copies.similar(x, y, least)
        assert (meet and may) or not alike
        seen.add((alike, meet, may))
    assert {(True, True, True), (False, False, False)} <= seen


@pytest.mark.parametrize("stars", [0, 3])
def test_all_rows_that_meet_are_united_or_compared(spark, monkeypatch, stars):
    """Random rows and links: the roots are those of all links between rows that meet."""
    monkeypatch.setattr(copies, "STARS", stars)
    rng = np.random.default_rng(2)
    size = rng.integers(50, 90, 120)
    rows = sorted({(int(k), int(v)): int(size[v]) * 5 // 4 - int(rng.integers(0, 40)) for k, v in zip(rng.integers(0, 9, 500), rng.integers(0, 120, 500), strict=True)}.items())
    rows = [(k, v, int(size[v]), m) for (k, v), m in rows]
    meet = {(a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and a[1] > b[1] and a[2] <= b[3] and b[2] <= a[3]}
    alike = {(a, b) for a, b in meet if a % 7 == b % 7 and (a + b) % 3 == 0}
    root = {v: v for p in alike for v in p}
    for _ in root:
        for a, b in alike:
            root[a] = root[b] = min(root[a], root[b])
    links, asked = spark.createDataFrame(sorted(alike), "a long, b long"), []

    def compare(pairs):
        asked.extend((r["a"], r["b"]) for r in pairs.collect())
        return pairs.join(links, ["a", "b"])

    members = spark.createDataFrame(rows, "key long, node long, size int, most int")
    got = {r["node"]: r["root"] for r in copies.united(members, compare, members.limit(0)).collect()}
    assert got == root and set(asked) <= meet
    apart = {(a, b) for a, b in meet if root.get(a, a) != root.get(b, b)}
    assert apart <= set(asked)
