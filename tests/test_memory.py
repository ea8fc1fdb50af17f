"""Files of any size are read a block at a time."""

import struct
import tracemalloc
import zlib

import pytest

from seqtally.sources.fastq import FastqPairsReader, Piece
from seqtally.sources.records import Records


def blocked(raw):
    out = b""
    for i in [*range(0, len(raw), 60_000), None]:
        part = b"" if i is None else raw[i : i + 60_000]
        z = zlib.compressobj(1, zlib.DEFLATED, -15)
        body = z.compress(part) + z.flush()
        out += b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(part), len(part))
    return out


def peak(run):
    tracemalloc.start()
    try:
        return run(), tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


@pytest.mark.parametrize("pack", [bytes, blocked])
@pytest.mark.parametrize("record", [b"@r\n" + b"A" * 90 + b"\n+\n" + b"!" * 90 + b"\n", b"@r\n" + b"A" * 45 + b"\n" + b"A" * 45 + b"\n+\n" + b"!" * 45 + b"\n" + b"!" * 45 + b"\n"])
def test_a_whole_file_is_never_held(tmp_path, pack, record):
    n = (80 << 20) // len(record)
    (tmp_path / "a.fastq").write_bytes(pack(record * n))

    def first():
        return len(next(iter(Piece(str(tmp_path / "a.fastq"), 0).records(False)))[0])

    rows, most = peak(first)
    assert rows and most < 40 << 20  # 80 MB and more before


def test_a_pair_of_whole_files_is_never_held(tmp_path):
    record = b"@r\n" + b"A" * 90 + b"\n+\n" + b"!" * 90 + b"\n"
    for k in (1, 2):
        (tmp_path / str(k)).write_bytes(record * ((40 << 20) // len(record)))
    from pyspark.sql.types import StructType

    reader = FastqPairsReader(StructType().add("seq1", "string").add("seq2", "string"), {f"path{k}": str(tmp_path / str(k)) for k in (1, 2)})
    rows, most = peak(lambda: next(iter(reader.read(reader.partitions()[0]))).num_rows)
    assert rows and most < 40 << 20  # 80 MB and more before


@pytest.mark.parametrize("limit", [None, 15 << 20])
def test_records_count_without_batches(limit):
    record = b"@r\nAC\nGT\n+\n!!\n!!\n"
    records = Records(iter([record * 1000]), limit=limit, texts=False)
    assert list(records) == [] and records.n == 1000
