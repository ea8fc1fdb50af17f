import gzip
import random
import struct
import time
import zlib

import pytest

from seqtally.sources.fastq import index_fastq, pair, read_fastq, read_fastq_pairs, read_fastq_ranges, read_fastq_strict, stream_fastq
from seqtally.sources.records import Records, parse


def blocked(raw, size):
    """raw as a block-gzipped file, with the empty block at the end."""
    out = b""
    for i in [*range(0, len(raw), size), None]:
        part = b"" if i is None else raw[i : i + size]
        z = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = z.compress(part) + z.flush()
        out += b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(part), len(part))
    return out


def record(rng, i, lines):
    n = rng.randrange(0, 60)
    seq = "".join(rng.choice("ACGTN") for _ in range(n))
    quality = "".join(rng.choice("@+!IF") for _ in range(n))
    cut = lambda x: x if lines == 1 or n < 4 else "\n".join([x[: n // 2], x[n // 2 :]])
    if n >= 4 and lines > 1 and quality[n // 2] == "+":  # either half may begin with anything but this, in a sequence
        pass
    return f"@r{i} more\n{cut(seq)}\n+{'again' * rng.randrange(2)}\n{cut(quality)}\n"


def text(seed, n, kinds):
    rng = random.Random(seed)
    return "".join(record(rng, i, rng.choice(kinds)) for i in range(n))


ODD = ["@A\n+\n+\n!\n@B\n+AC\nG\n+x\n!!!\n!\n", "@A\n\nAC\n+\n!!\n@A\nAC\n\nGT\n+\n!!!!!\n", "@A\nAC\n\n+T\n+\n!!!!!\n@FOO\n\n+\n", "", "@x\nAC\n+\n@@", "@r\n\n+\n\n@q\tz\nA\n+\n@\n", "@ n\nA\n+\n!\n@éü\nAé\n+\n!!!\n"]


@pytest.mark.parametrize("raw", [*ODD, text(1, 200, [1]), text(2, 200, [1, 2]), text(3, 200, [2])])
@pytest.mark.parametrize("size", [1, 7, 100_000])
def test_blocks_are_read_as_lines_are(raw, size):
    raw = raw.encode()
    want = [(a.decode("latin-1"), b.decode("latin-1")) for a, b in parse(iter(raw.splitlines(keepends=True)))]
    got = Records(iter([raw[i : i + size] for i in range(0, len(raw), size)]))
    rows = [(a, b) for names, seqs in got for a, b in zip(names.to_pylist(), seqs.to_pylist(), strict=True)]
    assert rows == want and got.n == len(want) and got.at == len(raw) and got.line == raw.count(b"\n") + (not raw.endswith(b"\n") and raw != b"")


@pytest.mark.parametrize("strip_cr", [False, True])
def test_errors_and_carriage_returns_in_blocks(strip_cr):
    raw = b"@A\r\nAC\r\n+\r\n!!\r\n" * 3
    for tail in (b"", b"@B\r\nAC\r\n+\r\n!\r\n@", b"B\n", b"@B\nA"):
        def outcome(run):
            try:
                return run()
            except ValueError as e:
                return str(e)

        want = outcome(lambda: [b for _, b in parse(iter((raw + tail).splitlines(keepends=True)), strip_cr)])  # noqa: B023
        got = outcome(lambda: [b.encode() for _, s in Records(iter([(raw + tail)[i : i + 5] for i in range(0, 100, 5)]), strip_cr) for b in s.to_pylist()])  # noqa: B023
        assert got == want


def rows_of(df):
    return sorted(tuple(r) for r in df.select("file_no", "record_no", "name", "seq").collect())


def test_ranges_equal_whole_files(spark, tmp_path):
    """Plain, block-gzipped and gzipped files, one-line and multi-line records, qualities that look like names, ranges shorter than a record."""
    folder = tmp_path / "in"
    folder.mkdir()
    for i, kinds in enumerate([[1], [1, 2], [2]]):
        raw = text(i, 300, kinds).encode()
        (folder / f"a{i}.fastq").write_bytes(raw)
        (folder / f"b{i}.fastq.gz").write_bytes(blocked(raw, 997))
        (folder / f"c{i}.fastq.gz").write_bytes(gzip.compress(raw))
    (folder / "d.fastq").write_bytes(b"")
    for i, raw in enumerate(ODD):
        (folder / f"e{i}.fastq").write_bytes(raw.encode())
    whole = rows_of(read_fastq(spark, str(folder)))
    for split in (5000, 700):
        assert rows_of(read_fastq_ranges(spark, f"file://{folder}", split)) == whole
    small = tmp_path / "small"
    small.mkdir()
    (small / "x.fastq").write_bytes(text(9, 40, [1, 2]).encode() + b"@long\n" + b"A" * 5000 + b"\n+\n" + b"@" * 5000 + b"\n@last\nA\n+\n@\n")
    assert rows_of(read_fastq_ranges(spark, str(small), 37)) == rows_of(read_fastq(spark, str(small)))


def test_many_tasks_and_no_exchange(spark, tmp_path):
    (tmp_path / "a.fastq").write_text(text(4, 2000, [1]))
    df = read_fastq_ranges(spark, str(tmp_path / "a.fastq"), 10_000)
    assert df.rdd.getNumPartitions() > 10 and "Exchange" not in df._jdf.queryExecution().toString()
    assert rows_of(read_fastq_strict(spark, str(tmp_path / "a.fastq"))) == rows_of(df)


def test_errors_in_ranges_tell_lines(spark, tmp_path):
    good = text(5, 300, [1])
    (tmp_path / "a.fastq").write_text(good + "@bad\nACGT\n+\n!!!\n" + good)
    with pytest.raises(Exception, match="non-equal lengths .*line 1201"):
        read_fastq_ranges(spark, str(tmp_path / "a.fastq"), 900).collect()


def sides(tmp_path, counts1, counts2, make):
    for side, counts in (("one", counts1), ("two", counts2)):
        (tmp_path / side).mkdir()
        for i, n in enumerate(counts):
            rng = random.Random(f"{side}{i}")
            make(tmp_path / side / f"lane{i}", "".join(record(rng, f"{side}.{i}.{k}", rng.choice([1, 2])) for k in range(n)).encode())


@pytest.mark.parametrize("kind", ["plain", "blocked", "gzip"])
@pytest.mark.parametrize("split", [None, 1500])
def test_pairs_in_step(spark, tmp_path, kind, split):
    make = {"plain": lambda p, raw: p.write_bytes(raw), "blocked": lambda p, raw: p.write_bytes(blocked(raw, 500)), "gzip": lambda p, raw: p.write_bytes(gzip.compress(raw))}[kind]
    sides(tmp_path, (200, 0, 77), (200, 0, 77), make)
    df = read_fastq_pairs(spark, str(tmp_path / "one"), str(tmp_path / "two"), split)
    assert "Exchange" not in df._jdf.queryExecution().toString()
    want = pair(read_fastq(spark, str(tmp_path / "one")), read_fastq(spark, str(tmp_path / "two")))
    order = ["read_id", "name1", "seq1", "name2", "seq2"]
    rows = sorted(tuple(r) for r in df.select(*order).collect())
    assert rows == sorted(tuple(r) for r in want.select(*order).collect()) and len(rows) == 277
    assert sorted(r.seq1 for r in read_fastq_pairs(spark, str(tmp_path / "one"), str(tmp_path / "two"), split, names=False).collect()) == sorted(r[2] for r in rows)


@pytest.mark.parametrize("split", [None, 900])
def test_pairs_of_unequal_files(spark, tmp_path, split):
    sides(tmp_path, (50, 60), (50, 59), lambda p, raw: p.write_bytes(raw))
    with pytest.raises(Exception, match="different number of reads in paired FASTQ files: .*two/lane1 ends before read 60 "):
        read_fastq_pairs(spark, str(tmp_path / "one"), str(tmp_path / "two"), split).collect()
    with pytest.raises(Exception, match="different number of reads in paired FASTQ files: .*two/lane1 ends before read 60 "):
        read_fastq_pairs(spark, str(tmp_path / "two"), str(tmp_path / "one"), split).collect()
    (tmp_path / "two" / "lane1").unlink()
    with pytest.raises(Exception, match="different number of paired FASTQ files"):
        read_fastq_pairs(spark, str(tmp_path / "one"), str(tmp_path / "two"), split).collect()


def test_pairs_of_tables_need_file_numbers(spark, tmp_path):
    sides(tmp_path, (3, 2), (3, 2), lambda p, raw: p.write_bytes(raw))
    one, two = (read_fastq_strict(spark, str(tmp_path / s)) for s in ("one", "two"))
    assert pair(one, two).count() == 5
    with pytest.raises(ValueError, match="file_no"):
        pair(one.drop("file_no"), two.drop("file_no"))


def test_stream_goes_on_where_it_stopped(spark, tmp_path):
    folder, out = tmp_path / "in", tmp_path / "out"
    folder.mkdir()

    def drain():
        q = stream_fastq(spark, str(folder)).writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination()
        return sorted((r.file_no, r.record_no, r["name"]) for r in spark.read.parquet(str(out)).collect())

    (folder / "b.fastq").write_text("@b0\nA\n+\n!\n@b1\nA\n+\n!\n")
    assert drain() == [(0, 0, "b0"), (0, 1, "b1")]
    assert drain() == [(0, 0, "b0"), (0, 1, "b1")]
    time.sleep(0.05)
    (folder / "a.fastq").write_text("@a0\nA\n+\n!\n")
    time.sleep(0.05)
    (folder / "c.fastq.gz").write_bytes(gzip.compress(b"@c0\nA\n+\n!\n"))
    assert drain() == [(0, 0, "b0"), (0, 1, "b1"), (1, 0, "a0"), (2, 0, "c0")]


def test_an_index_is_used_again(spark, tmp_path):
    (tmp_path / "a.fastq").write_text(text(6, 100, [1, 2]))
    at = index_fastq(spark, str(tmp_path / "a.fastq"), 400)
    assert rows_of(read_fastq_ranges(spark, "", index=at)) == rows_of(read_fastq(spark, str(tmp_path / "a.fastq")))
