"""FASTQ records out of blocks of bytes, and byte ranges of plain and block-gzipped files.

Records of four lines are cut with array operations; from the first one that isn't, ``parse`` goes on line by line, so what is read and which
errors are raised don't depend on the way.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from fnmatch import fnmatch

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs

#: Bytes read at once.
BLOCK = 1 << 20
#: Records of a batch that are parsed line by line.
BATCH = 8192
#: Records after which a guessed start counts as likely.
LIKELY = 3
_SPACE = np.zeros(256, bool)
_SPACE[[*b" \t\n\r\x0b\x0c"]] = True


def parse(lines: Iterator[bytes], strip_cr: bool = False, number: int = 0) -> Iterator[tuple[bytes, bytes]]:
    """(name, sequence) of each record; sequences and qualities may span lines.

    Errors tell true line numbers, after ``number`` lines before.  The line after a name is sequence even if it begins with ``+``.  A blank line inside a
    sequence is part of it as a line feed, and the next line is sequence whatever it begins with; one after
    the last record is an error.  No line is taken before it is needed.
    """

    def take() -> bytes | None:
        nonlocal number
        line = next(lines, None)
        if line is None:
            return None
        number += 1
        return line

    def early() -> ValueError:
        return ValueError(f"premature end of the file at line {number + 1}")

    def body(line: bytes) -> bytes:
        line = line[:-1] if line.endswith(b"\n") else line
        return line[:-1] if strip_cr and line.endswith(b"\r") else line

    while (header := take()) is not None:
        start = number
        if not header.startswith(b"@"):
            raise ValueError(f"read name should start with '@' (starting line {start})")
        if not header.endswith(b"\n"):
            raise early()
        words = header[1:].split(None, 1)
        name = words[0] if words and not header[1:2].isspace() else b""
        parts: list[bytes] = []
        free = True  # whether a line may begin with + and still be sequence
        while True:
            line = take()
            if line is None:
                raise early()
            if line.startswith(b"+") and not free:
                break
            if not line.endswith(b"\n"):
                raise early()
            text = body(line)
            if not text and not free:
                parts.append(b"\n")
            parts.append(text)
            free = not text and not free
        if not line.endswith(b"\n"):
            raise early()
        seq = b"".join(parts)
        length = 0
        while True:
            line = take()
            if line is None:
                if length == len(seq) and not seq:
                    break
                if length < len(seq):
                    raise early() if not length else ValueError(f"non-equal lengths for quality and sequence strings (starting line {start})")
                break
            length += len(body(line))
            if length >= len(seq):
                break
        if length != len(seq):
            raise ValueError(f"non-equal lengths for quality and sequence strings (starting line {start})")
        yield name, seq


def _strings(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> pa.Array:
    """data[begin[i]:end[i]] as strings, each byte a character (Latin-1)."""
    size = end - begin
    offsets = np.append(0, np.cumsum(size))
    chars = data[np.arange(offsets[-1]) + np.repeat(begin - offsets[:-1], size)]
    if len(chars) and chars.max() >= 0x80:
        raw = chars.tobytes().decode("latin-1")
        return pa.array([raw[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], pa.string())
    return pa.StringArray.from_buffers(len(size), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(chars))


def _regular(data: np.ndarray, strip_cr: bool, most: int | None, texts: bool) -> tuple[int, pa.Array | None, pa.Array | None, int, bool]:
    """(records, names, sequences, bytes used, whether all that is whole was used) of the four-line records that data begins with and that begin before ``most``."""
    ends = np.flatnonzero(data == 0x0A)
    n = len(ends) // 4
    ends = ends[: 4 * n].reshape(n, 4)
    begins = np.append(0, ends.ravel()[:-1] + 1).reshape(n, 4) if n else ends
    if most is not None:
        n = int(np.searchsorted(begins[:, 0], most))
        ends, begins = ends[:n], begins[:n]
    cut = ends
    if strip_cr and n:
        cut = ends - ((data[ends - 1] == 0x0D) & (ends > begins))
    good = (data[begins[:, 0]] == 0x40) & (data[begins[:, 2]] == 0x2B) & (cut[:, 1] - begins[:, 1] == cut[:, 3] - begins[:, 3])
    bad = np.flatnonzero(~good)
    whole = not len(bad)
    n = n if whole else int(bad[0])
    if not n:
        return 0, None, None, 0, whole
    begins, cut, ends = begins[:n], cut[:n], ends[:n]
    used = int(ends[-1, 3]) + 1
    if not texts:
        return n, None, None, used, whole
    name = begins[:, 0] + 1
    space = np.flatnonzero(_SPACE[data[: ends[-1, 0] + 1]])
    return n, _strings(data, name, space[np.searchsorted(space, name)]), _strings(data, begins[:, 1], cut[:, 1]), used, whole


class Records:
    """Batches of (names, sequences) from blocks of bytes that begin at a record.

    ``limit``: records that begin at that byte or later are left; iteration goes on from there when it is set anew.  ``n``, ``at`` and ``line`` tell the records
    read, and the bytes and lines before the next one.  ``texts=False`` only counts: no record is in a batch.
    """

    def __init__(self, blocks: Iterator[bytes], strip_cr: bool = False, limit: int | None = None, line: int = 0, texts: bool = True):
        self.blocks, self.strip_cr, self.limit, self.line, self.texts = iter(blocks), strip_cr, limit, line, texts
        self.n = self.at = 0
        self.held, self.parsed = b"", None

    def _past(self) -> bool:
        return self.limit is not None and self.at >= self.limit

    def __iter__(self) -> Iterator[tuple[pa.Array, pa.Array]]:
        spent = not self.held
        while self.parsed is None and not self._past():
            if spent:
                block = next(self.blocks, None)
                if block is None:
                    break
                self.held = self.held + block if self.held else block
            n, name, seq, used, whole = _regular(np.frombuffer(self.held, np.uint8), self.strip_cr, None if self.limit is None else self.limit - self.at, self.texts)
            self.n, self.at, self.line = self.n + n, self.at + used, self.line + 4 * n
            self.held, spent = self.held[used:], True
            if n and self.texts:
                yield name, seq
            if not whole:
                break
        if not self._past():
            if self.parsed is None:
                held, self.held = self.held, b""
                self.parsed = parse(self._lines(held), self.strip_cr, self.line)
            yield from self._by_lines()

    def _lines(self, held: bytes) -> Iterator[bytes]:
        while True:
            *lines, held = held.split(b"\n")
            for line in lines:
                self.at, self.line = self.at + len(line) + 1, self.line + 1
                yield line + b"\n"
            block = next(self.blocks, None)
            if block is None:
                break
            held += block
        if held:
            self.at, self.line = self.at + len(held), self.line + 1
            yield held

    def _by_lines(self) -> Iterator[tuple[pa.Array, pa.Array]]:
        rows: list[tuple[bytes, bytes]] = []

        def batch() -> tuple[pa.Array, pa.Array]:
            out = tuple(pa.array([r[k].decode("latin-1") for r in rows], pa.string()) for k in (0, 1))
            rows.clear()
            return out

        for row in self.parsed:
            self.n += 1
            if self.texts:
                rows.append(row)
                if len(rows) == BATCH:
                    yield batch()
            if self._past():
                break
        if rows:
            yield batch()


# --- files and ranges ---------------------------------------------------------------------------


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """A local path, or the URI of any store that Arrow reads (file, hdfs, s3, gs, ...)."""
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def file_infos(path: str) -> list[tuple[str, int, int]]:
    """(path, bytes, time of the last change) of the files of a folder, or those that a pattern in the last part of a path fits, or one file, in order; names that begin with _ or . don't count."""
    fs, name = file_system(path)
    prefix = path[: len(path) - len(name)] if path.endswith(name) else ""
    folder, _, last = name.rstrip("/").rpartition("/")
    if any(c in last for c in "*?["):
        found = [i for i in fs.get_file_info(pafs.FileSelector(folder or ".")) if i.is_file and fnmatch(i.base_name, last)]
    else:
        info = fs.get_file_info(name.rstrip("/"))
        found = [i for i in fs.get_file_info(pafs.FileSelector(info.path)) if i.is_file] if info.type == pafs.FileType.Directory else [info] if info.is_file else []
    found = [i for i in found if not i.base_name.startswith(("_", "."))]
    return sorted((prefix + i.path, i.size or 0, i.mtime_ns or 0) for i in found)


def _block_size(head: bytes) -> int | None:
    """Bytes of the block of a block-gzipped file that ``head`` begins, None if it begins none."""
    if len(head) < 18 or head[:4] != b"\x1f\x8b\x08\x04":
        return None
    extra, at = head[12 : 12 + struct.unpack_from("<H", head, 10)[0]], 0
    while at + 4 <= len(extra):
        size = struct.unpack_from("<H", extra, at + 2)[0]
        if extra[at : at + 2] == b"BC" and size == 2 and at + 6 <= len(extra):
            return struct.unpack_from("<H", extra, at + 4)[0] + 1
        at += 4 + size
    return None


def _plain(f: pa.NativeFile, at: int, size: int = BLOCK) -> Iterator[bytes]:
    f.seek(at)
    while block := f.read(size):
        yield block


def open_plain(path: str, at: int, size: int = BLOCK) -> Iterator[bytes] | None:
    """Blocks of a plain file from a byte on, None for a gzipped one."""
    fs, name = file_system(path)
    f = fs.open_input_file(name)
    return None if f.read(2) == b"\x1f\x8b" else _plain(f, at, size)


def _blocks(f: pa.NativeFile, at: int) -> Iterator[tuple[int, bytes]]:
    """(place in the file, text) of each block from the first that begins at ``at`` or later."""
    f.seek(at)
    held = f.read(BLOCK)
    if at:  # a block begins where a second one follows it, or the end
        place = held.find(b"\x1f\x8b\x08\x04")
        while place >= 0:
            size = _block_size(held[place : place + 64])
            if size and (place + size >= len(held) or _block_size(held[place + size : place + size + 64]) or len(held) - place - size < 64):
                break
            place = held.find(b"\x1f\x8b\x08\x04", place + 1)
        if place < 0:
            return
        held, at = held[place:], at + place
    while held:
        size = _block_size(held[:64])
        if size is None or len(held) < size + 64:
            more = f.read(BLOCK)
            held += more
            size = _block_size(held[:64])
            if size is None or len(held) < size:
                raise ValueError("a damaged block of a gzipped file")
        skip = 12 + struct.unpack_from("<H", held, 10)[0]
        yield at, zlib.decompress(held[skip : size - 8], -15)
        held, at = held[size:], at + size
        if len(held) < 64:
            held += f.read(BLOCK)


def open_range(path: str, begin: int, end: int | None) -> tuple[bytes | None, Iterator[bytes]]:
    """(text of a range of a file's bytes, blocks of text after it); the text of a block-gzipped file is that of the blocks which begin in the range.

    A file that can be read from its beginning alone (gzipped as one) is all in its first range: its text is None there, and empty elsewhere.
    """
    fs, name = file_system(path)
    f = fs.open_input_file(name)
    head = f.read(64)
    if head[:2] != b"\x1f\x8b":
        f.seek(begin)
        data = f.read(None if end is None else end - begin)
        return data, _plain(f, begin + len(data))
    if _block_size(head) is None:
        if begin:
            return b"", iter(())
        stream = fs.open_input_stream(name, compression="gzip")
        return None, iter(lambda: stream.read(BLOCK), b"")
    if end is not None and end <= begin:
        return b"", iter(())
    blocks, data, first = _blocks(f, begin), [], b""
    for at, text in blocks:
        if end is not None and at >= end:
            first = text
            break
        data.append(text)

    def rest() -> Iterator[bytes]:
        if first:
            yield first
        for _, text in blocks:
            yield text

    return b"".join(data), rest()


def text_from(path: str, begin: int, start: int) -> Iterator[bytes]:
    """Blocks of a file's text to its end, from the ``start``-th byte of the text of its bytes from ``begin`` on."""
    fs, name = file_system(path)
    f = fs.open_input_file(name)
    head = f.read(64)
    if head[:2] != b"\x1f\x8b":
        yield from _plain(f, begin + start)
    elif _block_size(head) is not None:
        for _, text in _blocks(f, begin):
            if start < len(text):
                yield text[start:]
            start = max(0, start - len(text))
    elif not begin:
        stream = fs.open_input_stream(name, compression="gzip")
        yield from iter(lambda: stream.read(BLOCK), b"")


def likely_start(data: bytes, rest: Iterator[bytes], strip_cr: bool) -> int | None:
    """Where the first record of a range seems to begin: at a line with ``@`` from which LIKELY records, or the end, can be read."""
    text, at = data, 0 if data[:1] == b"@" else data.find(b"\n@") + 1
    while 0 < at < len(data) or at == 0 and data[:1] == b"@":
        def lines(at: int = at) -> Iterator[bytes]:
            nonlocal text
            while True:
                end = text.find(b"\n", at)
                while end < 0:
                    block = next(rest, None)
                    if block is None:
                        break
                    text += block
                    end = text.find(b"\n", at)
                if end < 0:
                    if at < len(text):
                        yield text[at:]
                    return
                yield text[at : end + 1]
                at = end + 1

        try:
            for k, _ in enumerate(parse(lines(), strip_cr), 1):
                if k == LIKELY:
                    break
            return at
        except ValueError:
            at = data.find(b"\n@", at) + 1
            if not at:
                return None
    return None
