import gzip

import pytest

from seqtally.sources.fastq import pair, parse, read_fastq, read_fastq_strict


def records(text, **options):
    return list(parse(iter(text.encode().splitlines(keepends=True)), **options))


def test_empty_read_and_empty_input():
    assert records("@FOO\n\n+\n") == [(b"FOO", b"")]
    assert records("") == []


def test_name_ends_at_white_space():
    assert records("@FOO and more info\nACGT\n+\n!!!!\n@WHEE\nTGCA\n+asdasd\naaaa\n") == [(b"FOO", b"ACGT"), (b"WHEE", b"TGCA")]


def test_lines_and_at_signs_in_qualities():
    assert records("@FOO\nA\nCG\nTGCA\n+\n!!\n!!\n!!!\n@ARG\nACACGGT\nC\n+\n@@@\n@\n@@@@") == [(b"FOO", b"ACGTGCA"), (b"ARG", b"ACACGGTC")]


@pytest.mark.parametrize(
    ("text", "message"),
    [
        ("FOO", "read name should start"),
        ("@FOO\nAC\n+", "premature end"),
        ("@FOO\nAC\n+\n!!\n@BAR\nACGT\n+\n!!!\n", "non-equal lengths .*line 5"),
        ("@FOO\nAC\n+\n!!\n@BAR\nACGT\n+\n!!!!!\n", "non-equal lengths .*line 5"),
        ("@FOO\nAC\n+\n!!\nBAR\nACGT\n+\n!!!!\n", "should start .*line 5"),
        ("@FOO\nAC\n+\n!!\n\n", "should start"),
    ],
)
def test_errors(text, message):
    with pytest.raises(ValueError, match=message):
        records(text)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("@A\n+\n+\n!\n", [(b"A", b"+")]),
        ("@A\n+AC\nG\n+x\n!!!\n!\n", [(b"A", b"+ACG")]),
        ("@A\n\nAC\n+\n!!\n", [(b"A", b"AC")]),
        ("@A\nAC\n\nGT\n+\n!!!!!\n", [(b"A", b"AC\nGT")]),
        ("@A\nAC\n\n+T\n+\n!!!!!\n", [(b"A", b"AC\n+T")]),
        ("@A\nAC\n\n\n+\n!!!\n", [(b"A", b"AC\n")]),
    ],
)
def test_lines_of_a_sequence(text, want):
    assert records(text) == want


def test_pairs_of_several_files(spark, tmp_path):
    for side, prefix in (("one", "F"), ("two", "B")):
        (tmp_path / side).mkdir()
        for lane, n in ((1, 3), (2, 5)):
            (tmp_path / side / f"lane{lane}.fastq").write_text("".join(f"@{prefix}{lane}.{i}\nAC\n+\n!!\n" for i in range(n)))
    read = lambda side: read_fastq(spark, f"file://{tmp_path}/{side}")
    rows = pair(read("one"), read("two")).collect()
    assert sorted((r["name1"], r["name2"]) for r in rows) == [(f"F{lane}.{i}", f"B{lane}.{i}") for lane, n in ((1, 3), (2, 5)) for i in range(n)]
    assert len({r["read_id"] for r in rows}) == 8
    (tmp_path / "two" / "lane2.fastq").unlink()
    with pytest.raises(Exception, match="different number of reads"):
        pair(read("one"), read("two")).collect()


def test_patterns_and_hidden_files(spark, tmp_path):
    for name in ("a.fastq", "b.fastq", "c.txt", "_x.fastq", ".y.fastq"):
        (tmp_path / name).write_text(f"@{name}\nA\n+\n!\n")
    assert sorted(r["name"] for r in read_fastq(spark, f"{tmp_path}/*.fastq").collect()) == ["a.fastq", "b.fastq"]
    assert sorted((r["file_no"], r["name"]) for r in read_fastq(spark, f"file://{tmp_path}").collect()) == [(0, "a.fastq"), (1, "b.fastq"), (2, "c.txt")]
    with pytest.raises(Exception, match="no such file"):
        read_fastq(spark, f"{tmp_path}/*.none").collect()


def test_carriage_returns():
    text = "@A\r\nAC\r\n+\r\n!!\r\n"
    assert records(text, strip_cr=True) == [(b"A", b"AC")]


def test_files(spark, tmp_path):
    text = "".join(f"@r{i} x\nAC{'GT' * (i % 5)}\nA\n+\n{'!' * (3 + 2 * (i % 5))}\n" for i in range(1000))
    (tmp_path / "a.fastq").write_text(text)
    with gzip.open(tmp_path / "b.fastq.gz", "wt") as f:
        f.write(text)
    for name in ("a.fastq", "b.fastq.gz"):
        rows = sorted(read_fastq(spark, str(tmp_path / name), buffer_size=7).collect(), key=lambda r: r["record_no"])
        assert [(r["record_no"], r["name"], r["seq"]) for r in rows] == [(i, f"r{i}", "AC" + "GT" * (i % 5) + "A") for i in range(1000)]
    assert "name" not in read_fastq(spark, str(tmp_path / "a.fastq"), names=False).columns
    assert read_fastq(spark, str(tmp_path)).count() == 2000


def test_strict_files_and_their_errors(spark, tmp_path):
    (tmp_path / "a.fastq").write_text("".join(f"@r{i}\nACGT\n+\n!!!!\n" for i in range(50)))
    rows = {r["record_no"]: (r["name"], r["seq"]) for r in read_fastq_strict(spark, str(tmp_path / "a.fastq")).collect()}
    assert rows == {i: (f"r{i}", "ACGT") for i in range(50)}
    (tmp_path / "b.fastq").write_text("@a\nACGT\n+\n!!!\n")
    with pytest.raises(Exception, match="non-equal lengths"):
        read_fastq_strict(spark, str(tmp_path / "b.fastq")).collect()


def test_pairs_go_by_place(spark):
    one = spark.createDataFrame([(0, "FOO1", "A"), (1, "FOO2", "C")], "record_no long, name string, seq string")
    two = spark.createDataFrame([(0, "BAR1", "G"), (1, "BAR2", "T")], "record_no long, name string, seq string")
    assert sorted(pair(one, two).collect()) == [(0, "FOO1", "A", "BAR1", "G"), (1, "FOO2", "C", "BAR2", "T")]
    with pytest.raises(Exception, match="different number of reads"):
        pair(one, two.limit(1)).collect()
