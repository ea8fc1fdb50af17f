"""Many small ranges of FASTQ files are read by few tasks, alike."""

import random

import pyarrow.parquet as pq
import pytest

from seqtally.sources.fastq import TASKS, index_fastq, pair, read_fastq, read_fastq_pairs, read_fastq_ranges
from seqtally.sources.records import Records


def text(seed, n, lines):
    rng, out = random.Random(seed), []
    for i in range(n):
        k = rng.choice([3, 40, 400] if i % 50 == 0 else [3, 40])
        seq, quality = ("".join(rng.choice(x) for _ in range(k)) for x in ("ACGTN", "@+!IF"))
        cut = lambda x: x if lines == 1 else "\n".join(x[j : j + 17] for j in range(0, len(x), 17))
        # a line of a sequence never begins with +, one of qualities may begin with anything
        out.append(f"@r{seed}.{i}\n{cut(seq)}\n+\n{cut(quality)}\n")
    return "".join(out)


def rows_of(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


COLUMNS = ("file_no", "record_no", "name", "seq")


@pytest.mark.parametrize("lines", [1, 2])
def test_many_ranges_are_few_tasks(spark, tmp_path, lines):
    for i in range(3):
        (tmp_path / f"{i}.fastq").write_text(text(i, 1500, lines))
    at = index_fastq(spark, str(tmp_path), 100)
    index = pq.read_table(at.removeprefix("file://")).to_pylist()
    assert len(index) > 1500 and all(r["end"] is None or r["end"] - r["begin"] == 100 for r in index)
    df = read_fastq_ranges(spark, "", index=at)
    assert df.rdd.getNumPartitions() <= TASKS + 3  # as many as ranges before
    assert rows_of(df, *COLUMNS) == rows_of(read_fastq(spark, str(tmp_path)), *COLUMNS)
    # each row of the index tells where its records are
    raw = {i: (tmp_path / f"{i}.fastq").read_bytes() for i in range(3)}
    for r in random.Random(0).sample(index, 100):
        cut = Records(iter([raw[r["file_no"]][r["begin"] + r["start"] :]]), limit=(r["end"] or len(raw[r["file_no"]])) - r["begin"] - r["start"])
        names = [x for a, _ in cut for x in a.to_pylist()]
        assert names == [f"r{r['file_no']}.{r['record'] + i}" for i in range(r["n"])]
        assert r["line"] == raw[r["file_no"]][: r["begin"] + r["start"]].count(b"\n")


@pytest.mark.parametrize("lines", [1, 2])
def test_pairs_of_many_ranges_are_few_tasks(spark, tmp_path, lines):
    for k, side in enumerate(("one", "two")):
        (tmp_path / side).mkdir()
        for i in range(2):
            (tmp_path / side / f"{i}.fastq").write_text(text(10 * k + i, 1500, lines))
    one, two = str(tmp_path / "one"), str(tmp_path / "two")
    df = read_fastq_pairs(spark, one, two, 100)
    assert df.rdd.getNumPartitions() <= TASKS + 2
    columns = ("read_id", "name1", "seq1", "name2", "seq2")
    assert rows_of(df, *columns) == rows_of(pair(read_fastq(spark, one), read_fastq(spark, two)), *columns)


def test_an_error_far_into_a_run(spark, tmp_path):
    good = text(5, 1500, 1)
    (tmp_path / "a.fastq").write_text(good + "@bad\nACGT\n+\n!!!\n" + good)
    with pytest.raises(Exception, match="non-equal lengths .*line 6001"):
        read_fastq_ranges(spark, str(tmp_path / "a.fastq"), 100).collect()


def test_records_go_on_when_their_limit_is_set_anew():
    for lines in (1, 2):
        raw = text(7, 300, lines).encode()
        records, got, ends = Records(iter([raw[i : i + 90] for i in range(0, len(raw), 90)])), [], []
        for limit in [*range(0, len(raw), 333), None]:
            records.limit = limit
            got += [x for a, _ in records for x in a.to_pylist()]
            ends.append(records.at)
        assert got == [f"r7.{i}" for i in range(300)] and all(raw[e : e + 2] in (b"@r", b"") for e in ends) and records.n == 300
