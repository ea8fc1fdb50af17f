import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqtally.llm.collocations import collocations


def brute(docs, least, longest=5, share=100):
    f, total = Counter(), Counter()
    for _, lang, text in docs:
        lang = "und" if lang is None else lang
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for i in range(len(w)):
                for k in range(1, longest + 1):
                    if i + k <= len(w):
                        f[lang, tuple(w[i : i + k])] += 1
    cand = {key: n for key, n in f.items() if len(key[1]) > 1 and n >= least}
    inside = Counter()
    for (lang, g), n in cand.items():
        for k in range(2, len(g)):
            for i in range(len(g) - k + 1):
                inside[lang, g[i : i + k]] = max(inside[lang, g[i : i + k]], n)
    out = []
    for (lang, g), a in cand.items():
        if not (inside[lang, g] and 100 * inside[lang, g] >= share * a):
            n = total[lang]
            score, _, left, right = min((1000 * a * n // (f[lang, g[:k]] * f[lang, g[k:]]), k, f[lang, g[:k]], f[lang, g[k:]]) for k in range(1, len(g)))
            out.append((lang, " ".join(g), a, left, right, n, score))
    return sorted(out)


def tables():
    rng = np.random.default_rng(3)
    words = ["the", "of", "new", "York", "city", "Ünïted", "中文", "a'b", "x" * 40, "states"] + [f"w{i}" for i in range(60)]
    texts = []
    for i in range(300):
        w = rng.choice(words, 40, p=[0.3, 0.1] + [0.05] * 8 + [0.2 / 60] * 60)
        text = "".join(x + str(rng.choice([" ", "  ", "\t", ". ", ",", "\n", "\x0b", "\x0c;"], p=[0.6, 0.1, 0.1, 0.05, 0.05, 0.04, 0.03, 0.03])) for x in w)
        texts.append(text + " New York City, the United States of America. the the the the the the")
    texts += [None, "", " \t. ;", "one two " * 3000, texts[0], texts[0], "new york"]
    return [(i, [None, "en", "de", "und", "en"][i % 5], t) for i, t in enumerate(texts)] + [(3, "en", texts[0])]


@pytest.mark.parametrize(("most", "part"), [(1 << 20, 1 << 20), (0, 1 << 20), (1 << 20, 700), (0, 700)])
def test_against_brute_force(spark, most, part):
    """By codes and by digests, in one range and in many, whose bounds stand inside frequent words and pairs."""
    docs = tables()
    df = spark.createDataFrame(docs, "doc_id long, lang string, text string").repartition(5)
    got = sorted(tuple(r) for r in collocations(df, least=10, best=None, most_words=most, part=part).drop("rank").collect())
    want = brute(docs, 10)
    assert got == want and len(want) > 50


def test_other_lengths_and_shares(spark):
    docs = tables()
    df = spark.createDataFrame(docs, "doc_id long, lang string, text string")
    for longest, share in ((2, 100), (3, 60), (7, 40)):
        got = sorted(tuple(r) for r in collocations(df, least=20, longest=longest, share=share, best=None, part=3000).drop("rank").collect())
        assert got == brute(docs, 20, longest, share)


def test_ranks(spark):
    docs = tables()
    df = spark.createDataFrame(docs, "doc_id long, lang string, text string")
    got = [tuple(r) for r in collocations(df, least=10, best=7).orderBy("lang", "rank").collect()]
    want = []
    for lang in sorted({r[0] for r in brute(docs, 10)}):
        own = sorted((r for r in brute(docs, 10) if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))[:7]
        want += [(lang, i + 1, *r[1:]) for i, r in enumerate(own)]
    assert got == want


def test_empty_edge_and_clashing_tables(spark, none, edge, clashing):
    assert collocations(none).count() == 0
    rows = {r.phrase for r in collocations(edge, least=2).collect()}
    assert "and more words at the end" not in rows and any(r.startswith("word") for r in rows)
    named = clashing.withColumns({c: F.lit(1) for c in ("word", "code", "n", "total", "rank", "phrase", "c0", "part")} | {"lang": F.lit("en")})
    out = collocations(named, least=2)
    assert out.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"] and out.count() > 0


def test_scores_beyond_64_bits(spark):
    """a * n and l * r are decimals: floor(1000 a n / (l r)) is exact for counts near 10^12."""
    a, n, x, y = 999_999_999_989, 9_999_999_999_971, 1_000_000_000_039, 1_000_000_000_061
    got = spark.range(1).select(((F.lit(a) * 1000).cast("decimal(19,0)") * F.lit(n).cast("decimal(19,0)")).alias("x"), (F.lit(x).cast("decimal(19,0)") * F.lit(y).cast("decimal(19,0)")).alias("y")).select(F.expr("x div y").alias("s")).first().s
    assert got == 1000 * a * n // (x * y)


def test_query_against_sql(spark, sf):
    import duckdb

    from seqtally.llm.queries import oracle_sql, queries

    got = sorted(tuple(r) for r in queries()["op11_collocations"](spark, sf).collect())
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    want = sorted(con.execute(oracle_sql()["op11_collocations"]).fetchall())
    assert got == want and got
