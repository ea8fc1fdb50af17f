import hashlib
import random
import re
import struct
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from seqtally.llm import chroma, hnsw, neighbours, pii, sharding, toxicity
from seqtally.llm.queries import queries

# --- sharding -----------------------------------------------------------------------------------


def check_shards(docs, rows, shards=24):
    assert len(rows) == docs.count()
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r)
    for s, own in by.items():
        assert 0 <= s < shards and sorted(r["slot"] for r in own) == list(range(len(own)))
    return [sum(r["size"] for r in by.get(s, [])) for s in range(shards)]


@pytest.mark.parametrize("name", ["edge", "documents", "clashing"])
def test_shards(request, name):
    docs = request.getfixturevalue(name)
    rows = sharding.shard_documents(docs).collect()
    expected = sorted((str(r["doc_id"]), len((r["text"] or "").encode()) + 8, zlib.crc32((r["text"] or "").encode())) for r in docs.collect())
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in rows) == expected
    assert all(r["law"] == "bytes" and r["grown_shard"] is None for r in rows)
    sizes = check_shards(docs, rows)
    if name == "documents":
        assert max(sizes) <= max(1.1 * sum(sizes) / 24, max(r["size"] for r in rows))


def test_one_key_with_most_rows_is_divided(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 3 > 0, 7).otherwise(F.col("id")).alias("key"), F.lit(10).alias("size"), F.lit("x").alias("shard"))
    rows = sharding.shard_by_size(df, "key", F.col("size"), 8, 4).collect()
    sizes = check_shards(df, rows, 8)
    assert max(sizes) - min(sizes) <= 20


def test_ranges_grow_with_the_rows(spark, monkeypatch):
    monkeypatch.setattr(sharding, "RANGE_ROWS", 20)
    df = spark.range(3000).select(F.col("id").alias("key"), (F.col("id") % 7 + 1).alias("size"))
    sizes = check_shards(df, sharding.shard_by_size(df, "key", F.col("size"), 8, 4).collect(), 8)
    assert max(sizes) - min(sizes) <= 14


def test_no_shards_of_an_empty_table(none):
    assert sharding.shard_documents(none).count() == 0


def test_heavy_records_are_dealt_to_the_least_filled():
    placed, rooms = sharding.deal_heavy([(1, 100), (2, 60), (3, 50)], 300, 3)
    assert sorted(r for r, _, _ in placed) == [1, 2, 3] and rooms == [0.0, 40.0, 50.0]


# --- toxicity -------------------------------------------------------------------------------------


def test_interactions_are_learnt():
    rng = np.random.default_rng(0)
    rows, label = [], []
    for _ in range(4000):
        a, b = rng.random(2) < 0.4
        rows.append(np.array([*([11] if a else []), *([22] if b else []), 1000 + int(rng.integers(50))]))
        label.append(int(a and b))
    m = toxicity.fit(rows, np.array(label))
    score = lambda f: float(m.score(1, np.zeros(len(f), np.int64), np.array(f, np.int64))[0])
    assert score([11, 22]) > 0.8 and score([11]) < 0.3 and score([22]) < 0.3 and score([]) < 0.3


@pytest.mark.parametrize("noise", [1, 50, 2000])
def test_a_pair_whose_terms_tell_nothing_alone_is_found(noise):
    """Label: exactly one of two terms.  Either term is as frequent in one class as in the other."""
    rng = np.random.default_rng(0)
    rows, label = [], []
    for _ in range(4000):
        a, b = rng.random(2) < 0.5
        rows.append(np.unique([*([11] if a else []), *([22] if b else []), *(1000 + rng.integers(noise, size=40 if noise > 1 else 1))]))
        label.append(int(a != b))
    right = {}
    for factors in (toxicity.FACTORS, 0):
        m = toxicity.fit(rows[:3000], np.array(label[:3000]), factors=factors)
        right[factors] = np.mean([(m.score(1, np.zeros(len(f), np.int64), f)[0] >= 0.5) == y for f, y in zip(rows[3000:], label[3000:], strict=True)])
    assert right[toxicity.FACTORS] > 0.95 and right[0] < 0.6


def test_labels_dealt_at_random_teach_nothing():
    rng = np.random.default_rng(4)
    rows = [np.unique(rng.integers(500, size=30)) for _ in range(3000)]
    m = toxicity.fit(rows, (rng.random(3000) < 0.1).astype(int))
    assert all(m.score(1, np.zeros(len(f), np.int64), f)[0] < 0.3 for f in rows[:500])


def test_score_is_the_sum_over_all_pairs():
    rng = np.random.default_rng(6)
    index = np.full(100, -1, np.int32)
    index[10:60] = rng.permutation(50)
    m = toxicity.FactorizationMachine(-0.3, index, rng.normal(0, 0.3, 50), rng.normal(0, 0.3, (50, 5)))
    texts = [np.unique(rng.integers(100, size=k)) for k in (0, 1, 2, 9, 30)]
    got = m.score(len(texts), np.repeat(np.arange(len(texts)), [len(t) for t in texts]), np.concatenate(texts).astype(np.int64))
    for t, s in zip(texts, got, strict=True):
        at = [int(index[f]) for f in t if index[f] >= 0]
        z = m.bias + sum(m.w[i] for i in at) + sum(float(m.v[i] @ m.v[j]) for x, i in enumerate(at) for j in at[:x])
        assert abs(s - 1 / (1 + np.exp(-z))) < 1e-9


def test_features_are_the_terms_of_a_text():
    data = "Ein HÄSSLICHES ding, ein Ding! a_b été".encode()
    doc, feature = toxicity.features(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
    terms = [t for t in re.findall("[^\\W_]+", data.decode().lower())]
    assert len(feature) == len(set(terms)) + sum(terms.count(t) > 1 for t in set(terms)) and not doc.any()


def test_toxicity_edges(spark, edge, none, clashing):
    labels = spark.createDataFrame([(5, 1), (6, 1), (8, 0), (9, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.train(edge, labels)
    rows = toxicity.score(edge, model).collect()
    assert len(rows) == edge.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r["text"] or "", set()).add(r["score"])
    assert all(len(s) == 1 for s in by.values())
    assert toxicity.score(none, model).count() == 0
    assert toxicity.score(clashing, toxicity.train(none, labels)).columns.count("score") == 1
    assert toxicity.train(edge, labels.filter("false")).score(1, np.zeros(0, np.int64), np.zeros(0, np.int64))[0] < 0.3


def test_held_out_labels_are_not_read(spark, documents, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    lies = labels.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = toxicity.train(documents, labels), toxicity.train(documents, lies)
    assert a.bias == b.bias and np.array_equal(a.w, b.w) and np.array_equal(a.v, b.v)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    rows = queries()["op4_toxicity"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    own = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert all(r["held_out"] for r in own) and sum(r["held_out"] for r in rows) == len(own)
    hit = sum(r["predicted"] and r["toxic"] for r in own)
    assert hit / sum(r["predicted"] for r in own) > 0.9 and hit / sum(r["toxic"] for r in own) > 0.75


# --- personal data ----------------------------------------------------------------------------------

E, I = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
C, P = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute_spans(t):
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    luhn = lambda s: sum(sum(divmod(int(c) * 2, 10)) if i % 2 else int(c) for i, c in enumerate(s[::-1])) % 10 == 0
    out = [(m.start(), 0, m.end()) for m in E.finditer(t)]
    out += [(m.start(), 1, m.end()) for m in I.finditer(t) if all(int(x) <= 255 for x in m.group().split("."))]
    out += [(m.start(), 2, m.end()) for m in C.finditer(t) if 12 <= len(digits(m)) <= 19 and luhn(digits(m))]
    out += [(m.start(), 3, m.end()) for m in P.finditer(t) if 9 <= len(digits(m)) <= 15]
    return sorted(out)


def test_base_spans_on_random_texts():
    rnd = random.Random(5)
    for _ in range(20_000):
        t = "".join(rnd.choice("0123456789 -.+()@ab._\né") for _ in range(rnd.randint(0, 45)))
        assert pii.base_spans(t) == brute_spans(t), t


def test_long_runs_take_linear_time():
    for t in ("1" * 200_000, "a" * 200_000, "1." * 100_000, "a@" * 50_000, "+1" * 50_000, "1-" * 100_000):
        pii.base_spans(t)


@pytest.mark.parametrize("name", ["edge", "documents", "clashing"])
def test_personal_data(request, name):
    docs = request.getfixturevalue(name)
    rows = pii.find_personal_data(docs, masked=True).collect()
    assert len(rows) == docs.count()
    for r in rows:
        base = brute_spans(r["text"] or "")
        written = pii.written_spans(base)
        assert r["base_sha256"] == hashlib.sha256(written.encode()).hexdigest()
        assert [r[c] for c in ("n_email", "n_ip", "n_card", "n_phone")] == [sum(k == j for _, k, _ in base) for j in range(4)]
        assert set(written.split(",")) - {""} <= set(r["spans"].split(","))
        if r["spans"] == "":
            assert r["masked_text"] == r["text"]


def test_random_field_finds_what_has_no_pattern(spark):
    texts = ["call (030) 555-8642 soon", 'x token = "9f8e7d6c5b4a39281706f5e4d3c2b1a09f8e7d6c" y', "see version 4.0. and 17 pages of 2019", "in all 1250 units and 3451278123459912 rows"]
    got = [r["spans"] for r in pii.find_personal_data(spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1)).collect()]
    assert "phone:" in got[0] and got[1].startswith("secret:11:") and got[2] == "" and got[3] == ""


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(3)
    k = len(pii.LABELS)
    m = pii.ChainField({}, np.zeros((0, k)), rng.normal(size=(k, k)))
    u = rng.normal(size=(3, 4, k))
    mask = np.array([[1, 1, 1, 1], [1, 1, 0, 0], [1, 1, 1, 0]], bool)
    got = m.viterbi(u, mask)
    from itertools import product

    for row, n in enumerate((4, 2, 3)):
        best = max(product(range(k), repeat=n), key=lambda p: m.move[0, p[0]] + sum(u[row, t, p[t]] for t in range(n)) + sum(m.move[p[t - 1], p[t]] for t in range(1, n)) + m.move[p[-1], 0])
        assert tuple(got[row, :n]) == best


def decoded(text, m):
    """All spans of a text by a plain Viterbi, word by word."""
    labels, k = [], len(pii.LABELS)
    found = [(w.start(), w.group()) for w in re.finditer("[^\\x20\\x09-\\x0D]+", text)]
    tokens = ["", "", *(w for _, w in found), ""]
    cued = [any(c in "0123456789@" for c in w) for _, w in found]
    t = 0
    while t < len(found):
        end = t
        while end < len(found) and cued[end] == cued[t]:
            end += 1
        if cued[t]:
            best = None
            for i in range(t, end):
                row = [m.index[f] for f in pii.word_features(tokens[i], tokens[i + 1], tokens[i + 2], tokens[i + 3]) if f in m.index]
                own = m.emit[row].sum(0)
                step = [(m.move[0, y] + own[y], [y]) for y in range(k)] if best is None else [max(((z + m.move[p[-1], y] + own[y], [*p, y]) for z, p in best), key=lambda x: x[0]) for y in range(k)]
                best = step
            labels += max(((z + m.move[p[-1], 0], p) for z, p in best), key=lambda x: x[0])[1]
        else:
            labels += [0] * (end - t)
        t = end
    base = brute_spans(text)
    out, t = list(base), 0
    while t < len(found):
        end = t + 1
        while end < len(found) and labels[end] == labels[t] and cued[end] == cued[t]:
            end += 1
        if labels[t]:
            first, last = found[t][1], found[end - 1][1]
            a = found[t][0] + len(first) - len(first.lstrip("\"'`.,;:!?*#%&$|[]{}<>"))
            b = found[end - 1][0] + len(last.rstrip("\"'`.,;:!?*#%&$|[]{}<>()"))
            if a < b and not any(x < b and a < y for x, _, y in base):
                out.append((a, pii.KINDS.index(pii.LABELS[labels[t]]), b))
        t = end
    return sorted(out)


def test_spans_of_documents_against_a_plain_viterbi(spark, documents, edge):
    model = pii.train()
    texts = [r["text"] for df in (documents, edge) for r in df.collect() if r["text"] and len(r["text"]) < 20_000]
    texts += ["call (030) 555-8642 or (030) 555-8643 soon, jo@a.example.com 10.0.0.1 x1", "k=1 " * 50, "password: swordfish", 'a token = "9f8e7d6c5b4a39281706f5e4d3c2b1a09f8e7d6c" b']
    rows = pii.find_personal_data(spark.createDataFrame([(t,) for t in texts], "text string")).collect()
    want = {t: pii.written_spans(decoded(t, model)) for t in texts}
    assert all(r["spans"] == want[r["text"]] for r in rows)
    assert sum("secret" in v for v in want.values()) and want["password: swordfish"] == ""


def test_training_rows_are_in_no_table(spark):
    words = {w.strip("\"'.,;:()") for line in pii.TRAINING for w in line.rpartition("|")[0].split() if sum(c.isdigit() for c in w) >= 6}
    texts = "\n".join(r["text"] or "" for sf in ("sf0.001", "sf0.01", "sf0.1") for r in spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").select("text").collect())
    assert len(words) > 15 and not [w for w in words if w in texts]
    assert not [line for line in pii.TRAINING if line.rpartition("|")[0] in texts]


def test_time_grows_with_the_length_of_a_text():
    import time

    model, took = pii.train(), []
    for n in (3000, 3000, 12_000):
        data = np.frombuffer(("call (030) 555-8642 or jo7@mail.example.com at 10.0.0.1 now " * n).encode(), np.uint8)
        began = time.process_time()
        base, every = pii.find(data, np.array([0, len(data)]), model)
        took.append(time.process_time() - began)
        assert len(base[0]) == 2 * n and len(every[0]) == 3 * n
    assert took[2] < 8 * took[1] + 1


def test_what_follows_64_characters_counts():
    assert pii.shape("a1" * 50 + "-") != pii.shape("a1" * 50 + "+")


def test_personal_data_of_an_empty_table(none):
    assert pii.find_personal_data(none).count() == 0


# --- recordings ---------------------------------------------------------------------------------------


def tune(n, seed):
    rng = np.random.default_rng(seed)
    f = np.repeat(rng.choice([0.03, 0.05, 0.07, 0.1, 0.13, 0.2], n // 500 + 1), 500)[:n]
    return np.sin(2 * np.pi * np.cumsum(f)) + np.sin(2 * np.pi * np.cumsum(np.roll(f, 700)))


def pcm(x):
    return np.clip(128 + 40 * x, 0, 255).astype(np.uint8).tobytes()


def wav(x):
    body = np.clip(x * 10_000, -32768, 32767).astype("<i2").tobytes()
    return b"RIFF" + struct.pack("<I", 36 + len(body)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, 8000, 16000, 2, 16) + b"data" + struct.pack("<I", len(body)) + body


def test_a_cut_of_a_recording_is_aligned(spark):
    x = tune(60_000, 1)
    noise = np.random.default_rng(2).normal(0, 0.02, 60_000)
    rows = [(1, pcm(x)), (2, pcm((x + noise)[128 * 50 : 128 * 350])), (3, pcm(tune(60_000, 9))), (4, pcm(x)), (5, b""), (6, None), (None, pcm(x)), (7, b"short"), (8, bytes(5000)), (9, wav(x))]
    got = {r["id"]: r for r in chroma.align(spark.createDataFrame(rows, "id long, audio binary"), "id", F.col("audio")).collect()}
    assert len(got) == len(rows)
    assert got[2]["shift"] == -50 and got[2]["error"] < 0.1 and got[2]["component_id"] == 1 and got[2]["votes"] > 1
    assert got[4]["class_id"] == 1 and got[None]["class_id"] == 1 and got[3]["component_id"] == 3
    assert got[9]["component_id"] == 1 and got[1]["error"] is None
    assert [got[k]["n_values"] for k in (5, 6, 7)] == [0, 0, 0] and got[5]["class_id"] == 5


def given(prints):
    return lambda t, *_: t.select("id", F.expr("length(audio) div 4").alias("n_values"), F.col("audio").alias("vals"), F.lit(None).cast("string").alias("samples"))


def test_copies_whose_landmarks_others_have_first_are_compared(spark, monkeypatch):
    """7 and 8 are near copies, of the parts that 1 and 2 have; neither is accepted with 1 or 2 over the whole overlap."""
    rng = np.random.default_rng(7)
    noise = lambda n: rng.integers(0, 1 << 32, n, dtype=np.uint32)
    one, two = noise(6), noise(6)
    p = np.concatenate([one, noise(200), two])
    q = p.copy()
    q[6:206] ^= np.uint32(1)
    prints = {1: np.concatenate([noise(300), one, noise(300)]), 2: np.concatenate([noise(300), two, noise(300)]), 7: p, 8: q}
    table = spark.createDataFrame([(k, bytes(v.astype("<u4"))) for k, v in prints.items()], "id long, audio binary").coalesce(1)
    monkeypatch.setattr(chroma, "fingerprints", given(prints))
    got = {r["id"]: r for r in chroma.align(table, "id", F.col("audio")).collect()}
    assert [got[k]["component_id"] for k in (1, 2, 7, 8)] == [1, 2, 7, 7]
    assert got[8]["shift"] == 0 and got[8]["votes"] == 10 and got[7]["votes"] is None


def brute_alignment(a, b):
    x, y = [list(zip(v.tolist(), v.tolist()[1:], strict=False)) for v in (a, b)]
    places, distinct = {}, {}
    for i, m in enumerate(x):
        for j, n in enumerate(y):
            if m == n:
                places[i - j] = places.get(i - j, 0) + 1
                distinct.setdefault(i - j, set()).add(m)
    if not places:
        return None
    found = []
    for n in (places, {k: len(v) for k, v in distinct.items()}):
        top = max(n.values())
        s = min((k for k in n if n[k] == top), key=lambda k: (abs(k), k))
        at = [i for i in range(len(a)) if 0 <= i - s < len(b)]
        found.append((sum((int(a[i]) ^ int(b[i - s])).bit_count() for i in at) / (32 * len(at)), -places[s], abs(s), s))
    error, votes, _, s = min(found)
    return s, -votes, error


def brute_align(prints):
    """(id, class_id, component_id, shift, votes, error) with every two recordings compared."""
    raw = {k: v.tobytes() for k, v in prints.items()}
    first = {}
    for k in sorted(raw):
        first.setdefault(raw[k], k)
    ids = sorted(first.values())
    parent = {k: k for k in ids}

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for x, i in enumerate(ids):
        for j in ids[:x]:
            f = brute_alignment(prints[i], prints[j])
            if f and f[1] >= min(2, len(prints[i]) - 1, len(prints[j]) - 1) and f[2] <= 0.25:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    out = []
    for k in sorted(prints):
        c = first[raw[k]]
        f = (None, None, None) if find(c) == c else brute_alignment(prints[c], prints[find(c)]) or (None, 0, None)
        out.append((k, c, find(c), f[0], f[1], None if f[2] is None else round(f[2], 9)))
    return out


def shown(rows):
    return sorted((r["id"], r["class_id"], r["component_id"], r["shift"], r["votes"], None if r["error"] is None else round(r["error"], 9)) for r in rows)


def test_alignments_against_all_pairs(spark, monkeypatch):
    rng = np.random.default_rng(11)
    base = [rng.integers(0, 1 << 32, 60, dtype=np.uint32) for _ in range(4)]
    prints = {}
    for k in range(60):
        v = base[k % 4].copy()
        v = np.concatenate([rng.integers(0, 1 << 32, int(rng.integers(0, 5)), dtype=np.uint32), v[int(rng.integers(0, 20)) : int(rng.integers(30, 60))]])
        flip = rng.random(len(v)) < rng.choice([0, 0.3, 0.8])
        v[flip] ^= rng.integers(0, 1 << 32, int(flip.sum()), dtype=np.uint32) & rng.integers(0, 1 << 32, int(flip.sum()), dtype=np.uint32)
        if k % 7 == 0:
            v = np.concatenate([np.full(int(rng.integers(3, 40)), 9, np.uint32), v])
        prints[k] = v
    prints[70], prints[71] = prints[3], np.full(200, 9, np.uint32)
    for k in range(12):  # of one landmark and of two, alone, in longer ones, and with bits that differ
        v = base[k % 4]
        prints[80 + k] = v[30 : 32 + k % 2].copy() if k < 8 else v[30:33] ^ np.array([0, 0, [0, 1, 0xFFFFFFFF, 0xFFFF0000][k - 8]], np.uint32)
        prints[100 + k] = np.array([9, 9, *([7] * (k % 3))], np.uint32)
    table = spark.createDataFrame([(k, bytes(v.astype("<u4"))) for k, v in prints.items()], "id long, audio binary").coalesce(1)
    monkeypatch.setattr(chroma, "fingerprints", given(prints))
    want = brute_align(prints)
    assert shown(chroma.align(table, "id", F.col("audio")).collect()) == want
    assert 4 < len({c for _, _, c, *_ in want}) < 58


def test_offsets_of_long_steady_sounds():
    rng = np.random.default_rng(2)
    for n, m in ((700, 500), (3, 2), (1500, 40)):
        a, b = (rng.integers(0, 2, k).astype(np.uint32) * (rng.random(k) < 0.02) for k in (n, m))
        places, distinct = chroma.offsets(a, b)
        x, y = chroma.landmarks(a), chroma.landmarks(b)
        want = np.zeros(len(places), np.int64)
        for i in range(len(x)):
            for j in np.flatnonzero(y == x[i]):
                want[i - j + len(y) - 1] += 1
        assert places.tolist() == want.tolist() and (distinct <= places).all() and ((distinct > 0) == (places > 0)).all()


def test_equal_short_recordings_are_a_class(spark):
    short = bytes(range(200)) * 2
    rows = [(4, short), (2, short), (3, short[:-1]), (5, b""), (6, b""), (7, None), (8, None), (9, wav(np.arange(-50, 50) / 100)), (10, wav(np.arange(-50, 50) / 100)), (None, short)]
    got = {r["id"]: r for r in chroma.align(spark.createDataFrame(rows, "id long, audio binary"), "id", F.col("audio")).collect()}
    assert len(got) == len(rows) and not any(r["n_values"] for r in got.values())
    for c in ("class_id", "component_id"):
        assert {k: r[c] for k, r in got.items()} == {4: 2, 2: 2, 3: 3, 5: 5, 6: 6, 7: 7, 8: 8, 9: 9, 10: 9, None: 2}


def test_what_is_shorter_than_a_span_is_followed_by_silence():
    x = tune(3000, 4)
    assert [len(chroma.fingerprint(pcm(x)[:n])) for n in (511, 512, 1000, 1536, 1664)] == [0, 2, 2, 2, 3]


def test_headers_of_recordings():
    x = np.arange(-90, 90) / 100.0

    def riff(kind, bits, body, channels=1, cut=None):
        head = b"RIFF" + struct.pack("<I", 36 + len(body)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, kind, channels, 8000, 8000 * bits // 8, bits // 8, bits)
        return (head + b"data" + struct.pack("<I", len(body)) + body)[:cut]

    i32 = np.round(x * 2.0**31).astype("<i4")
    for bits, body in ((8, (x * 128 + 128).astype(np.uint8).tobytes()), (16, (x * 2**15).astype("<i2").tobytes()), (24, i32.view(np.uint8).reshape(-1, 4)[:, 1:].tobytes()), (32, i32.tobytes())):
        assert np.abs(chroma.decode(riff(1, bits, body)) - x).max() < 0.01
    for kind in ("<f4", "<f8"):
        assert np.allclose(chroma.decode(riff(3, 8 * int(kind[-1]), x.astype(kind).tobytes())), x, atol=1e-6)
    assert np.allclose(chroma.decode(riff(1, 16, np.repeat((x * 2**15).astype("<i2"), 2).tobytes() + b"\0", 2)), x, atol=1e-3)
    body = (x * 2**15).astype("<i2").tobytes()
    assert all(not len(chroma.decode(r)) for r in (riff(1, 16, body, channels=0), riff(1, 12, body), riff(7, 8, body), riff(3, 16, body), riff(1, 0, body)))
    for n in range(len(riff(1, 16, body))):
        chroma.decode(riff(1, 16, body, cut=n))
    assert not len(chroma.decode(riff(1, 16, body, cut=30)))


def test_semitones_fall_in_classes_of_their_own():
    n = 4096
    for octave in range(3):
        tops = [int(chroma.chroma(np.sin(2 * np.pi * chroma.SCALE.lowest * 2 ** (octave + k / 12) * np.arange(n))).mean(0).argmax()) for k in range(12)]
        assert tops == list(range(12))


def test_steady_sounds_of_different_lengths_are_aligned(spark):
    rows = [(1, bytes([128]) * 4000), (2, bytes([128]) * 6000), (3, bytes(range(64)) * 80), (4, bytes(range(64)) * 110), (5, pcm(tune(60_000, 1)))]
    table = spark.createDataFrame(rows, "id long, audio binary").coalesce(1)
    got = {r["id"]: r for r in chroma.align(table, "id", F.col("audio")).collect()}
    assert {k: r["component_id"] for k, r in got.items()} == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5}
    assert got[2]["error"] == 0 and got[2]["shift"] == 0 and got[4]["error"] < 0.05


def test_filters_come_from_the_integral_image():
    frames = np.abs(np.random.default_rng(0).normal(size=(20, 12))).astype(np.float32)
    for scale in (chroma.SCALE, chroma.Scale(span=16)):
        want = []
        for t in range(len(frames) - scale.span + 1):
            v = 0
            for regions in scale.filters:
                s = {1: 0.0, -1: 0.0}
                for sign, a, b, c, d in regions:
                    s[sign] += frames[t + a : t + b, c:d].astype(float).sum()
                level = int(np.digitize(np.log((1 + s[1]) / (1 + s[-1])), chroma.LEVELS))
                v = v << 2 | (0, 1, 3, 2)[level]
            want.append(v)
        assert chroma.packed(frames, scale).tolist() == want


def test_recordings_of_edge_documents(edge, none, clashing):
    for docs in (edge, clashing, none):
        rows = chroma.align(docs, "doc_id", F.encode("text", "UTF-8")).collect()
        assert len(rows) == docs.count()


def test_recording_query(spark, sf, documents):
    rows = {r["doc_id"]: r for r in queries()["op5_chroma"](spark, sf).collect()}
    assert len(rows) == documents.count()
    prints, short = {}, {}
    for r in documents.collect():
        raw = (r["text"] or "").encode()
        v = chroma.fingerprint(raw)
        assert rows[r["doc_id"]]["n_values"] == len(v) and rows[r["doc_id"]]["values_crc32"] == zlib.crc32(v.astype("<u4").tobytes())
        if len(v):
            prints[r["doc_id"]] = v
        else:
            short.setdefault(raw or r["doc_id"], []).append(r["doc_id"])
    assert shown([rows[d].asDict() | {"id": d} for d in prints]) == brute_align(prints)
    assert all(rows[d]["class_id"] == rows[d]["component_id"] == min(ids) for ids in short.values() for d in ids)


# --- vectors --------------------------------------------------------------------------------------------


def brute_vectors(rows, least=0.9):
    out, parent = [], list(range(len(rows)))

    def unit(v):
        if v is None or not v or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            return None
        a = np.array(v, float)
        return a / np.sqrt((a * a).sum())

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    u = [unit(v) for _, v in rows]
    n = [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            if u[i] is not None and u[j] is not None and len(u[i]) == len(u[j]) and u[i] @ u[j] >= least:
                n[i] += 1
                n[j] += 1
                parent[find(i)] = find(j)
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((str(d), n[i], str(min(ids, default=None)), d is not None and d == min(ids)))
    return sorted(out)


def vector_rows():
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 16))
    rows = [(i, (centres[i % 12] + rng.normal(0, 0.12, 16)).tolist()) for i in range(150)] + [(200 + i, rng.normal(size=16).tolist()) for i in range(150)]
    rows += [(900, None), (901, []), (902, [0.0] * 16), (903, [float("nan")] * 16), (904, [None] + [1.0] * 15), (905, [float("inf")] * 16), (906, [1.0, 2.0]), (907, [2.0, 4.0]), (None, rows[0][1]), rows[5], (908, [x * 3 for x in rows[7][1]]), (909, rows[7][1]), (910, [-0.0] + [0.0] * 14 + [1.0]), (911, [0.0] * 15 + [1.0])]
    return rows


def test_vectors_against_brute_force(spark):
    rows = vector_rows()
    df = spark.createDataFrame([(a, b, 1, "x") for a, b in rows], "vec_id long, embedding array<double>, label int, node string")
    got = sorted((str(r["vec_id"]), r["n_links"], str(r["component_id"]), r["kept"]) for r in neighbours.near_vectors(df, shards=3, block_rows=64).collect())
    assert got == brute_vectors(rows)


def test_lengths_whose_squares_leave_the_range(spark):
    """Only directions count, so scaled by powers of two all links are those of the plain vectors."""
    rows = [(i, v) for i, (_, v) in enumerate(vector_rows()[:40])]
    scaled = [(i, [x * 2.0 ** (700 if i % 2 else -700) for x in v]) for i, v in rows]
    df = spark.createDataFrame(scaled, "vec_id long, embedding array<double>")
    got = sorted((str(r["vec_id"]), r["n_links"], str(r["component_id"]), r["kept"]) for r in neighbours.near_vectors(df, shards=2).collect())
    assert got == brute_vectors(rows) and any(r[1] for r in got)


def test_vectors_of_an_empty_table(spark):
    assert neighbours.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_graph_recall():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 32)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1)[:, None]
    g = hnsw.build(x)
    ids, _ = g.search(x[:300], 64)
    exact = np.argsort(-(x[:300] @ x.T), axis=1)[:, :10]
    assert np.mean([len(set(a[:64].tolist()) & set(b.tolist())) / 10 for a, b in zip(ids, exact, strict=True)]) > 0.9


def test_beams_widen_until_the_audit_passes(monkeypatch):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 8)) * 0.05 + np.ones(8)
    g = neighbours._build(pd.DataFrame({"shard": 0, "node": range(400), "weight": 1, "vector": list(x)})).iloc[0].to_dict()
    counts, _, _, recall = neighbours.query_block(g, np.arange(400), x, 0.9, beam=2)
    u = x / np.linalg.norm(x, axis=1)[:, None]
    assert recall >= neighbours.AUDIT_RECALL and sum(counts) >= 0.9 * ((u @ u.T >= 0.9).sum() - 400)


def test_vector_query(spark, sf):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = sorted((str(r["vec_id"]), r["n_links"], str(r["component_id"]), r["kept"]) for r in queries()["op10_vectors"](spark, sf).collect())
    assert got == brute_vectors(rows)


def test_sharding_query(spark, sf, documents):
    sizes = check_shards(documents, queries()["op1_sharding"](spark, sf).collect())
    assert sum(sizes) == sum(len((r["text"] or "").encode()) + 8 for r in documents.collect())


def test_personal_data_query(spark, sf, documents):
    assert queries()["op6_personal_data"](spark, sf).count() == documents.count()
