"""Benchmark decontamination by winnowing: words of documents that stand in a window of a benchmark item.

An item of ``window`` words or more has a window at each of its words; a shorter one is one window of all its words.
For each length of window a text keeps the least hash of every run of word k-grams that fills one window (the last of
equal ones), with k half the length.  Which one is kept depends on the window's words alone, so a window that stands in a document and
in an item leaves one fingerprint in both, wherever it stands.  Fingerprints are joined; around each hit the windows that
hold it are compared by 128 bits, and windows found next to each other make up the maximal shared spans.

Items of INDEX_BYTES at most are one broadcast index, and documents are read once, without a shuffle.  Larger benchmarks are
joined by their fingerprints and then by their windows, which are distinct on the items' side, so no pairs of a
frequent window's documents and items are made; the items of each distinct set of windows are put together once.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqtally.llm.common import arrow_schema, slices, written
from seqtally.llm.kernels import column_bytes, digests, mix, runs, sequence_hashes, words

WINDOW = 10
#: Bytes of texts of items, and items, whose index is broadcast, at most.
INDEX_BYTES, INDEX_ITEMS = 8 << 20, 1 << 18

#: Letters of words, once A-Z are lower case: 0-9, a-z and every byte of a longer UTF-8 sequence.
_LETTERS = np.zeros(256, bool)
_LETTERS[0x30:0x3A] = _LETTERS[0x61:0x7B] = _LETTERS[0x80:] = True


class _Words:
    """The words of some texts as 128-bit digests, with the text of each and its place there."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        capital = (data >= 0x41) & (data <= 0x5A)
        data = np.where(capital, data | 0x20, data) if capital.any() else data
        self.data, (self.starts, self.ends, self.text) = data, words(data, offsets, _LETTERS)
        self.lane = digests(data, self.starts, self.ends, 1)
        self.count = np.bincount(self.text, minlength=len(offsets) - 1)
        self.first = np.cumsum(self.count) - self.count

    def fits(self, k: int) -> np.ndarray:
        """Places at which k words of one text begin."""
        n = len(self.text) - k + 1
        return np.flatnonzero(self.text[:n] == self.text[k - 1 :]) if n > 0 else np.empty(0, np.int64)

    def windows(self, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.lane) < 2:  # most texts share nothing and need one
            self.lane = digests(self.data, self.starts, self.ends)
        salt = np.uint64(k * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        return tuple(mix(sequence_hashes(lane, k, at) + salt) for lane in self.lane)

    def fingerprints(self, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, hashes) that winnowing keeps of the windows of k words at the places ``at``."""
        gram = (k + 1) // 2
        if not len(at):
            return at, np.empty(0, np.uint64)
        h = sequence_hashes(self.lane[0], gram) + np.uint64(k)
        best, place = h[at], at.copy()
        for i in range(1, k - gram + 1):
            other = h[at + i]
            less = other <= best
            best = np.where(less, other, best)
            place[less] = at[less] + i
        kept = np.unique(place)
        return kept, mix(h[kept])

    def around(self, hits: np.ndarray, k: int) -> np.ndarray:
        """Places of the windows of k words that hold a k-gram of the places ``hits``."""
        at = np.unique((hits[:, None] - np.arange(k - (k + 1) // 2 + 1)).ravel())
        at = at[(at >= 0) & (at + k <= len(self.text))]
        return at[self.text[at] == self.text[at + k - 1]]


def _item_windows(w: _Words, window: int) -> Iterator[tuple[int, np.ndarray]]:
    """(length, places) of the windows of items."""
    for k in range(1, window):
        short = w.first[w.count == k]
        if len(short):
            yield k, short
    at = w.fits(window)
    if len(at):
        yield window, at


class _Index:
    """Distinct windows of items, by length: their fingerprints, digests and the items that have each."""

    def __init__(self, texts: pa.Array, ids: list[str | None], window: int):
        w = _Words(*column_bytes(texts))
        self.ids, self.levels = np.array(ids, object), []
        for k, at in _item_windows(w, window):
            a, b = w.windows(at, k)
            order = np.lexsort((b, a))
            a, b, item = a[order], b[order], w.text[at[order]]
            new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))
            first = np.flatnonzero(new)
            self.levels.append((k, np.unique(w.fingerprints(at, k)[1]), a[first], b[first], np.append(first, len(a)), item))

    def hits(self, w: _Words) -> tuple[np.ndarray, list[np.ndarray]]:
        """(changes of the number of windows over each word, [texts and items of the windows found])."""
        cover, found = np.zeros(len(w.text) + 1, np.int64), [np.empty((2, 0), np.int64)]
        for k, prints, a, b, cuts, item in self.levels:
            at, h = w.fingerprints(w.fits(k), k)
            hit = at[prints[np.minimum(np.searchsorted(prints, h), len(prints) - 1)] == h]
            at = w.around(hit, k)
            if not len(at):
                continue
            x, y = w.windows(at, k)
            left, right = np.searchsorted(a, x), np.searchsorted(a, x, "right")
            which = np.full(len(at), -1)
            for step in range(int((right - left).max(initial=0))):  # windows whose first 64 bits agree: one, but for chance
                slot = np.minimum(left + step, len(a) - 1)
                which = np.where((left + step < right) & (b[slot] == y), slot, which)
            at, which = at[which >= 0], which[which >= 0]
            np.add.at(cover, at, 1)
            np.add.at(cover, at + k, -1)
            pair = np.unique(np.stack([w.text[at], which]), axis=1)  # a window counts once a text
            size = cuts[pair[1] + 1] - cuts[pair[1]]
            place = np.arange(size.sum()) + np.repeat(cuts[pair[1]] - (np.cumsum(size) - size), size)
            found.append(np.stack([np.repeat(pair[0], size), item[place]]))
        return cover, found


_HELD: dict[str, _Index] = {}


def _index(name: str, shared, window: int) -> _Index:
    """The index of a broadcast table, made once a worker; the last one is kept."""
    if name not in _HELD:
        _HELD.clear()
        table = shared.value
        _HELD[name] = _Index(table.column(1).combine_chunks(), table.column(0).to_pylist(), window)
    return _HELD[name]


def _spans(w: _Words, cover: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word, end) of the maximal runs of words under windows."""
    on = np.cumsum(cover[:-1]) > 0
    new = np.append(True, w.text[1:] != w.text[:-1]) if len(on) else on
    start = np.flatnonzero(on & (np.append(False, ~on[:-1]) | new)) if len(on) else np.empty(0, np.int64)
    last = np.flatnonzero(on & (np.append(~on[1:], True) | np.append(new[1:], True))) if len(on) else start
    text = w.text[start]
    return text, start - w.first[text], last + 1 - w.first[text]


_SPAN = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
_NEW = [T.StructField("n_words", T.LongType()), T.StructField("spans", _SPAN), T.StructField("items", T.ArrayType(T.StringType()))]


def decontaminate(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """All columns of docs, with n_words, spans and items after them.

    spans: the maximal runs of words under windows of items, as (first word, word after the last), in order.  items: ids, as text
    and in byte order, of the items that have a window in the document; both are empty where nothing is shared.  Words are runs of
    0-9, a-z and characters beyond ASCII, with A-Z as a-z.  Null and empty texts, and texts without words, have no words; such items have
    no window.  Items with equal texts are all listed, equal ids once; an item without an id marks words and is not listed.  Repeated documents
    are rows of their own.  Columns of docs named like the new ones are dropped.  No items, or no documents, are no error.
    """
    docs = docs.drop(*(f.name for f in _NEW))
    items = items.select(F.col(item_id).cast("string").alias("item"), F.col(item_text).alias("text")).filter("text is not null")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes"), F.count("*").alias("n")).first()
    if size["bytes"] <= index_bytes and size["n"] <= INDEX_ITEMS:
        return _by_index(docs, items, text_col, window)
    return _by_joins(docs, items, text_col, window)


def _by_index(docs: DataFrame, items: DataFrame, text_col: str, window: int) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(items.toArrow())
    name, at = uuid.uuid4().hex, docs.columns.index(text_col)
    schema = T.StructType([*docs.schema.fields, *_NEW])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, target = _index(name, shared, window), arrow_schema(schema)
        for batch in it:
            for piece in slices(batch, at):
                data, offsets = column_bytes(piece.column(at))
                count, spans, listed = [], [], []
                for i, j in runs(offsets):
                    w = _Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                    cover, found = index.hits(w)
                    own, own_items = [[] for _ in range(j - i)], [[] for _ in range(j - i)]
                    for text, a, b in zip(*(x.tolist() for x in _spans(w, cover, j - i)), strict=True):
                        own[text].append({"start": a, "end": b})
                    for text, item in np.unique(np.concatenate(found, axis=1), axis=1).T.tolist() if len(found) > 1 else ():
                        if index.ids[item] is not None:
                            own_items[text].append(index.ids[item])
                    count += w.count.tolist()
                    spans += own
                    listed += [sorted(set(x)) for x in own_items]
                new = [pa.array(x, target.field(f.name).type) for x, f in zip((count, spans, listed), _NEW, strict=True)]
                yield pa.RecordBatch.from_arrays([*(c.cast(f.type) for c, f in zip(piece.columns, target, strict=False)), *new], schema=target)

    return docs.mapInArrow(run, schema)


def _by_joins(docs: DataFrame, items: DataFrame, text_col: str, window: int) -> DataFrame:
    signed = lambda x: pa.array(x.view(np.int64))

    def item_rows(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for piece in slices(batch, 1):
                w = _Words(*column_bytes(piece.column(1)))
                for k, at in _item_windows(w, window):
                    a, b = w.windows(at, k)
                    yield pa.RecordBatch.from_arrays([piece.column(0).take(pa.array(w.text[at])), pa.array(np.full(len(at), k)), signed(a), signed(b)], names=["item", "k", "a", "b"])

    def item_prints(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for piece in slices(batch, 1):
                w = _Words(*column_bytes(piece.column(1)))
                for k, at in _item_windows(w, window):
                    yield pa.RecordBatch.from_arrays([signed(np.unique(w.fingerprints(at, k)[1]))], names=["print"])

    windows = written(items.mapInArrow(item_rows, "item string, k long, a long, b long").distinct())
    prints = written(items.mapInArrow(item_prints, "print long").distinct())
    lengths = [r["k"] for r in windows.select("k").distinct().collect()]  # ``window`` of them at most
    table = written(docs.withColumn("_row", F.monotonically_increasing_id()))
    texts = table.select("_row", text_col)

    def doc_prints(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for piece in slices(batch, 1):
                w = _Words(*column_bytes(piece.column(1)))
                for k in lengths:
                    at, h = w.fingerprints(w.fits(k), k)
                    pair = np.unique(np.stack([w.text[at].astype(np.uint64), h]), axis=1)
                    yield pa.RecordBatch.from_arrays([piece.column(0).take(pa.array(pair[0].astype(np.int64))), signed(np.ascontiguousarray(pair[1]))], names=["_row", "print"])

    def candidates(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for piece in slices(batch, 1):
                w = _Words(*column_bytes(piece.column(1)))
                some = [np.sort(np.array(x, np.int64).view(np.uint64)) for x in piece.column(2).to_pylist()]
                for k in lengths:
                    at, h = w.fingerprints(w.fits(k), k)
                    text = w.text[at]
                    hit = np.zeros(len(at), bool)
                    for i in np.unique(text):
                        hit[text == i] = np.isin(h[text == i], some[i])
                    at = w.around(at[hit], k)
                    a, b = w.windows(at, k)
                    place = at - w.first[w.text[at]]
                    yield pa.RecordBatch.from_arrays([piece.column(0).take(pa.array(w.text[at])), pa.array(place), pa.array(np.full(len(at), k)), signed(a), signed(b)], names=["_row", "at", "k", "a", "b"])

    matched = texts.mapInArrow(doc_prints, "_row long, print long").join(prints, "print", "left_semi").groupBy("_row").agg(F.collect_set("print").alias("prints"))
    near = texts.join(matched, "_row").select("_row", text_col, "prints").mapInArrow(candidates, "_row long, at long, k long, a long, b long")
    distinct = windows.select("k", "a", "b").distinct()
    window_of = F.struct("k", "a", "b")
    found = near.join(distinct, ["k", "a", "b"], "left_semi").groupBy("_row").agg(F.collect_list(F.struct("at", "k")).alias("hits"), F.sort_array(F.collect_set(window_of)).alias("set"))
    found = written(found.withColumn("name", F.sha2(F.to_json("set"), 256)))
    some = found.groupBy("name").agg(F.first("set").alias("set")).select("name", F.explode("set").alias("w")).select("name", "w.*").join(windows, ["k", "a", "b"])
    listed = some.filter("item is not null").select("name", "item").distinct().groupBy("name").agg(F.sort_array(F.collect_list("item")).alias("items"))
    # windows in order of place; those that touch are one span
    grown = F.aggregate(
        F.sort_array("hits"),
        F.expr("cast(array() as array<struct<start: bigint, end: bigint>>)"),
        lambda acc, h: F.when(
            (F.size(acc) > 0) & (F.element_at(acc, -1)["end"] >= h["at"]),
            F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["end"], h["at"] + h["k"]).alias("end")))),
        ).otherwise(F.concat(acc, F.array(F.struct(h["at"].alias("start"), (h["at"] + h["k"]).alias("end"))))),
    )
    found = found.select("_row", "name", grown.alias("spans")).join(listed, "name", "left").drop("name")

    def counted(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for piece in slices(batch, 1):
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(_Words(*column_bytes(piece.column(1))).count)], names=["_row", "n_words"])

    n = texts.mapInArrow(counted, "_row long, n_words long")
    whole = table.join(n, "_row").join(found, "_row", "left")
    return whole.select(*docs.columns, "n_words", F.coalesce("spans", F.expr(f"cast(array() as {_SPAN.simpleString()})")).alias("spans"), F.coalesce("items", F.expr("cast(array() as array<string>)")).alias("items"))
