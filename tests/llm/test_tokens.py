import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers as P
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyarrow import fs as pafs
from tokenizers import Tokenizer

from seqtally.llm import bpe, common, kernels, packing, tokenfiles, tokens
from seqtally.llm.queries import queries

LIB = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
TIK = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(P.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
TEXT = st.text(st.sampled_from(list(" '\n\tstmdrevlaZ09.,é中　\x1c٣\U0001f600")) | st.characters(exclude_categories=["Cs"]), max_size=40)


def letters(n, a, b):
    """A word of two letters for which every polynomial hash modulo 2^64 is the same as with the letters swapped (n >= 1024)."""
    return "".join(b if k.bit_count() % 2 else a for k in range(n))


SWAPPED = [letters(2048, "a", "b"), letters(2048, "b", "a"), "x " + letters(1024, "a", "b") + " y", "x " + letters(1024, "b", "a") + " y"]


def ids_of(text, end):
    return LIB.encode(text or "", add_special_tokens=False).ids + [end]


@settings(max_examples=150, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=8))
def test_ids_are_the_librarys(texts):
    ids, offsets = tokens.encode_column(pa.array(texts), tokens.default_vocabulary(), 1)
    for i, t in enumerate(texts):
        assert ids[offsets[i] : offsets[i + 1]].tolist() == ids_of(t, 1)


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from(list("abcéxyz中 \n'1")), max_size=60))
def test_bpe_is_tiktokens(text):
    model, _ = bpe._loaded(bpe.default_ranks())
    pieces = [p.encode() for p in __import__("regex").findall(P.PATTERN, text)]
    assert [i for p in pieces for i in model.encode_piece(p)] == TIK.encode_ordinary(text)


def test_rank_queue_gives_least_rank_then_least_place():
    q = bpe.RankQueue(50_000)
    items = [(49_999, 1), (3, 9), (3, 2), (4096, 0), (64, 5)]
    for r, p in items:
        q.push(r, p)
    assert [q.pop() for _ in items] == sorted(items)
    assert q.pop() is None


def test_very_long_pretoken():
    model, _ = bpe._loaded(bpe.default_ranks())
    piece = ("ab" * 20_000 + "é" * 999).encode()
    assert model.decode(np.array(model.encode_piece(piece))).tobytes() == piece


def check_bpe(docs, rows):
    expected = sorted((str(r["doc_id"]), len(i := TIK.encode_ordinary(r["text"] or "")), hashlib.sha256(np.array(i, "<u4").tobytes()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest()) for r in docs.collect())
    assert sorted((str(r[0]), *r[1:]) for r in rows) == expected


@pytest.mark.parametrize("name", ["edge", "documents", "clashing"])
def test_bpe_round_trip(request, name):
    docs = request.getfixturevalue(name)
    check_bpe(docs, bpe.encode_decode(docs, digests=True).collect())


def test_bpe_of_words_with_equal_hashes(spark):
    docs = spark.createDataFrame(list(enumerate(SWAPPED)), "doc_id long, text string").coalesce(1)
    check_bpe(docs, bpe.encode_decode(docs, digests=True).collect())


def check_packing(docs, rows, window=2048):
    expected = {}
    for r in docs.collect():
        expected.setdefault(r["doc_id"], []).append(ids_of(r["text"], 1))
    sequences = {}
    by_doc = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        by_doc.setdefault(r["doc_id"], []).append(r)
        assert 0 < r["length"] <= window
    for doc_id, copies in expected.items():
        own = sorted(by_doc[doc_id], key=lambda r: r["start"])
        assert sum(r["length"] for r in own) == sum(map(len, copies))
        if len(copies) == 1:
            at = 0
            for r in own:
                piece = np.array(copies[0][r["start"] : r["start"] + r["length"]], "<u4").tobytes()
                assert r["start"] == at and r["doc_tokens"] == len(copies[0]) and zlib.crc32(piece) == r["ids_crc32"]
                assert "ids" not in r.asDict() or bytes(r["ids"]) == piece
                at += r["length"]
    used = padded = 0
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= window
        used += at
        padded += 0 if at & (at - 1) == 0 else window - at
    return padded / max(1, used)


@pytest.mark.parametrize("name", ["edge", "documents", "clashing"])
def test_packing_places_each_id_once(request, name):
    docs = request.getfixturevalue(name)
    assert check_packing(docs, packing.pack(docs).collect()) < 0.01


def test_packing_merges_over_several_levels(documents, monkeypatch):
    monkeypatch.setattr(packing, "FAN_IN", 2)
    rows = packing.pack(documents.repartition(9), open_windows=3).collect()
    assert check_packing(documents, rows) < 0.01


def test_packer_keeps_few_windows_open():
    p = packing.Packer(0, 16, 3, 2)
    for i, n in enumerate([5, 9, 7, 11, 3, 13, 2, 8, 8, 40]):
        list(p.add(i, np.arange(n)))
        assert len(p.open) <= 3


def check_files(docs, rows):
    texts = sorted(((r["doc_id"], r["text"]) for r in docs.collect()), key=lambda x: (x[0] is not None, x[0] or 0))
    rows = sorted(rows, key=lambda r: r["start"])
    ids_seen = [d for d, _ in texts]
    assert len(rows) == len(texts)
    at = 0
    for (doc_id, text), r in zip(texts, rows, strict=True):
        ids = ids_of(text, 2)
        assert (r["doc_id"], r["start"], r["n_tokens"]) == (doc_id, at, len(ids)) or ids_seen.count(doc_id) > 1
        if ids_seen.count(doc_id) == 1:
            raw = np.array(ids, "<u4").tobytes()
            assert zlib.crc32(raw) == r["ids_crc32"] if "ids_crc32" in r.asDict() else bytes(r["ids"]) == raw
        at += r["n_tokens"]


@pytest.mark.parametrize("name", ["edge", "documents", "clashing"])
def test_token_files_round_trip(request, spark, name):
    docs = request.getfixturevalue(name)
    check_files(docs, tokenfiles.read_tokens(spark, tokenfiles.write_tokens(docs, files=3)).collect())


def test_a_repeated_task_replaces_no_file(spark, documents, tmp_path):
    first = tokenfiles.write_tokens(documents, f"file://{tmp_path}", files=2)
    again = tokenfiles.write_tokens(documents, f"file://{tmp_path}", files=3)
    assert not {m["path"] for m in first} & {m["path"] for m in again}
    for manifest in (first, again):
        check_files(documents, tokenfiles.read_tokens(spark, manifest).collect())


def test_reader_decompresses_only_what_is_asked_for(tmp_path):
    path = str(tmp_path / "x.zst")
    with pafs.LocalFileSystem().open_output_stream(path, compression=None) as out:
        w = tokenfiles.Writer(out, 2, frame_ids=100)
        docs = [np.arange(n, dtype=np.uint32) % 60_000 for n in (30, 0, 250, 100, 7)]
        w.add(list(range(5)), np.concatenate(docs), np.array([len(d) for d in docs]))
        w.close(pa.int64())
    with pafs.LocalFileSystem().open_input_file(path) as f:
        r = tokenfiles.Reader(f, f.size())
        assert r.document(4).tolist() == docs[4].tolist() and r.frames_read == 1
        assert all(r.document(i).tolist() == docs[i].tolist() for i in range(5))
    raw = bytearray(open(path, "rb").read())
    raw[20] ^= 255
    open(path, "wb").write(raw)
    with pafs.LocalFileSystem().open_input_file(path) as f, pytest.raises(Exception):
        tokenfiles.Reader(f, f.size()).document(0)


def test_frames_can_be_read_by_any_zstandard(tmp_path):
    import zstandard

    path = str(tmp_path / "y.zst")
    ids = np.arange(1000, dtype=np.uint32)
    with open(path, "wb") as out:
        w = tokenfiles.Writer(out, 4, frame_ids=128)
        w.add([1], ids, np.array([1000]))
        w.close(pa.int64())
    with open(path, "rb") as f:
        raw = zstandard.ZstdDecompressor().stream_reader(f, read_across_frames=True).read()
    assert raw == ids.astype("<u4").tobytes()


def test_empty_tables(spark, none):
    assert packing.pack(none).count() == 0
    assert bpe.encode_decode(none).count() == 0
    assert tokenfiles.read_tokens(spark, tokenfiles.write_tokens(none)).count() == 0


def test_queries(spark, sf, documents):
    q = queries()
    assert check_packing(documents, q["op2_packing"](spark, sf).collect()) < 0.01
    check_files(documents, q["op7_token_files"](spark, sf).collect())
    check_bpe(documents, q["op8_bpe"](spark, sf).collect())


def _library():
    import public_tokenizers
    import tiktoken

    from seqtally.llm.bpe import default_ranks, load_ranks

    return tiktoken.Encoding("multi", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_ranks(default_ranks()), special_tokens={})


def test_code_points_newer_than_pythons_are_cut_as_the_library_cuts(spark):
    """Unassigned and new code points, alone in a run and beside others, each before contractions, letters, digits and blanks."""
    import random
    import unicodedata

    import numpy as np

    from seqtally.llm.bpe import encode_decode

    rng = random.Random(4)
    new = [c for c in range(0x110000) if unicodedata.category(chr(c)) == "Cn"]
    points = [0x1C89, 0xA7CB, 0x10D40, 0x1C8A, 0x2FFF, 0x1F, 0x1C, 0x85, 0x3000, *rng.sample(new, 1500), *rng.sample(range(0x80, 0x30000), 500)]
    points = [c for c in points if not 0xD800 <= c < 0xE000]
    texts = [chr(c) + tail for c in points for tail in ("'s",)] + [f"a{chr(c)}1 {chr(c)}'ll{chr(c)}x {chr(c)}{chr(rng.choice(points))}'re  \n{chr(c)}" for c in points]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    lib = _library()
    for r in encode_decode(df).collect():
        assert np.frombuffer(r.ids, "<u4").tolist() == lib.encode_ordinary(texts[r.doc_id]), ascii(texts[r.doc_id])
        assert bytes(r.decoded).decode() == texts[r.doc_id]


def test_classes_of_assigned_code_points_are_the_librarys():
    import numpy as np

    from seqtally.llm import kernels as K
    from seqtally.llm.bpe import _library_classes

    mine = K._classes()
    points = np.array([c for c in range(0x80, 0x110000) if mine[c] != K._UNSURE and not 0xD800 <= c < 0xE000 and not 0xE000 <= c < 0xF900 and c < 0xF0000])
    assert (_library_classes()(points) == mine[points]).all()


def test_a_new_code_point_beside_texts_of_other_scripts(spark):
    """Documents of one run: one with a code point that Python doesn't know, another with high ones."""
    import public_tokenizers
    from tokenizers import Tokenizer

    from seqtally.llm.tokens import default_vocabulary, encode_column
    import pyarrow as pa

    texts = ["Ᲊ's", "中文 text", "\U00010d40's x"]
    ids, offsets = encode_column(pa.array(texts), default_vocabulary(), 1)
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert [ids[offsets[i] : offsets[i + 1] - 1].tolist() for i in range(3)] == [lib.encode(t, add_special_tokens=False).ids for t in texts]
