import pyarrow as pa
import pytest
from test_copies import brute_copies
from test_dedup import brute_kept
from test_tokens import check_packing

import corpus_pipeline as cp
from seqtally.llm import pii, toxicity
from seqtally.llm.kernels import column_bytes
from seqtally.llm.packing import pack


def test_stages(spark, sf, documents):
    docs, seen = documents, []
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == documents.columns, name
        rows = out.collect()
        ids = [r["doc_id"] for r in rows]
        assert len(ids) == len(set(ids)) and set(ids) <= {r["doc_id"] for r in docs.collect()}
        seen.append((name, len(rows)))
        docs = spark.createDataFrame(rows, documents.schema)
    counts = dict(seen)
    assert counts["near_dedup"] < counts["toxicity"] <= documents.count() and counts["personal_data"] == counts["passages"] == counts["near_dedup"]
    rows = cp.packing(spark, docs, sf).collect()
    assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in docs.collect()}


@pytest.mark.parametrize("k", range(5))
def test_stages_with_edge_cases(spark, sf, edge, none, k):
    _, stage = cp.STAGES[k]
    out = stage(spark, edge, sf)
    assert out.count() >= (8 if k < 4 else 10)
    assert stage(spark, none, sf).count() == 0


@pytest.mark.parametrize("k", [0, 1, 2, 3])
def test_stages_leave_columns_of_any_name_alone(spark, sf, clashing, k):
    """Columns named as those that operators add come out as they went in."""
    docs = clashing.selectExpr("*", "'mine' as kept_sha256", "'own' as masked_text", "9 as n_email", "3 as n_removed", "'b' as base_sha256")
    out = cp.STAGES[k][1](spark, docs, sf)
    assert out.columns == docs.columns
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    rows = out.select(*others).collect()
    assert rows and set(map(str, rows)) == {str(docs.select(*others).first())}


def masked(text, model):
    """Spans cut from the end, so that those before keep their places; overlapping ones as one, of the first's kind."""
    _, (spans,) = pii.find(*column_bytes(pa.array([text])), model)
    whole = []
    for a, kind, b in spans:
        if whole and a < whole[-1][2]:
            whole[-1][2] = max(whole[-1][2], b)
        else:
            whole.append([a, kind, b])
    for a, kind, b in reversed(whole):
        text = f"{text[:a]}<{pii.KINDS[kind]}>{text[b:]}"
    return text


def test_run_against_brute_force(spark, sf, documents):
    """Every stage again, one text at a time; the model of toxicity and the random field are the trained ones."""
    model = toxicity.train(documents, spark.read.parquet(f"{sf}/labels.parquet"))
    rows = [(r["doc_id"], r["text"]) for r in documents.orderBy("doc_id").collect()]
    n = len(rows)
    rows = [(d, t) for d, t in rows if model.score(1, *toxicity.features(*column_bytes(pa.array([t or ""]))))[0] < 0.3]
    assert len(rows) < n
    n, least = len(rows), dict(brute_copies(rows))
    rows = [(d, t) for d, t in rows if least[str(d)] == str(d)]
    assert len(rows) < n
    cut = brute_kept(rows)
    assert any(gone for _, _, gone, _ in cut)
    rows = [(d, kept if gone else t) for (d, t), (_, _, gone, kept) in zip(rows, cut, strict=True)]
    field = pii.train()
    clean = [(d, t if t is None else masked(t, field)) for d, t in rows]
    assert clean != rows
    df = cp.run(spark, sf)
    assert df.columns == pack(documents).columns
    got = df.collect()
    assert {r["doc_id"] for r in got} == {d for d, _ in clean}
    assert check_packing(spark.createDataFrame(clean, "doc_id long, text string"), got) < 0.01


def test_near_dedup_keeps_one_of_each_group(spark, sf):
    text = "some words of a text that is here more than once and goes on for a while"
    docs = spark.createDataFrame([(5, text, "en", "a", 1), (3, text, "en", "b", 1), (8, text + " too", "en", "c", 1), (9, "another one", "en", "d", 1), (None, text, "en", "e", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r["doc_id"] for r in cp.near_dedup(spark, docs, sf).collect()}
    assert {3, 9} <= kept and 5 not in kept


def test_personal_data_is_masked(spark, sf):
    docs = spark.createDataFrame([(1, "write to jo@example.com now", "en", "a", 27), (2, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    rows = {r["doc_id"]: r for r in cp.personal_data(spark, docs, sf).collect()}
    assert rows[1]["text"] == "write to <email> now" and rows[1]["n_chars"] == 20 and rows[2]["text"] is None
