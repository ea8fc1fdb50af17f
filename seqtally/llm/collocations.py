"""Phrase collocations by suffix counting: every suffix of a piece, cut to ``longest`` words, sorted and swept once.

Words are counted first.  A phrase can't be frequent if one of its words isn't, so rarer words end a suffix; the others are
codes.  Suffixes travel sorted by language, first word and the words after it, in ranges of about PART suffixes whose bounds are quantiles
of a sample: a first word of many suffixes is divided where its next words are, so no word, pair or passage makes a
large range.  Equal suffixes are added up before they travel.  In a range, adjacent suffixes share their first words, and the counts
of all prefixes come from one sweep of a stack over these lengths (written with arrays, depth by depth).  Prefixes that are
open at either end of a range are partial; the parts are joined by a sum.  Then each frequent phrase meets the counts of its parts in joins.

Codes are places in the table of frequent words where that has MOST_WORDS at most, and it is broadcast; otherwise
64-bit digests of language and word, by which counts of different words would be mixed at a chance of about words^2 / 2^65.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqtally.llm.common import slices, written
from seqtally.llm.kernels import column_bytes, digests, mix, runs, words

LEAST, LONGEST, BEST = 100, 5, 2000
#: Frequent words that are broadcast, at most, so that three codes fit into 63 bits.
MOST_WORDS = (1 << 21) - 2
#: Suffixes of a range, and of what is sorted at once before it travels.
PART = 1 << 20
#: Sampled suffixes that bound the ranges: for each range, and in all (16 bytes each, on the driver).
SAMPLED, MOST_SAMPLED = 200, 1_000_000
#: Bytes from which a longer text is likelier to be read for the sample.
SAMPLE_BYTES = 1 << 16
#: Words counted at once in a task.
COUNTED = 1 << 20

_BREAK = np.zeros(256, bool)
_BREAK[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LETTERS = ~_BREAK
_LETTERS[[0x20, 0x09]] = False


class _Words:
    """The words of some texts: where they are, their text, whether the next word follows in the same piece."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, salts: np.ndarray):
        capital = (data >= 0x41) & (data <= 0x5A)
        self.data = np.where(capital, data | 0x20, data) if capital.any() else data
        self.starts, self.ends, self.text = words(self.data, offsets, _LETTERS)
        piece = np.append(0, np.cumsum(_BREAK[self.data]))[self.starts]
        self.follows = np.append((piece[1:] == piece[:-1]) & (self.text[1:] == self.text[:-1]), False) if len(piece) else np.empty(0, bool)
        self.code = mix(digests(self.data, self.starts, self.ends, 1)[0] ^ salts[self.text])
        self.code[self.code == 0] = 1


def _salts(langs: list[str]) -> np.ndarray:
    raw = [x.encode("utf-8", "surrogatepass") for x in langs]
    ends = np.cumsum([len(x) for x in raw])
    data = np.frombuffer(b"".join(raw), np.uint8)
    return digests(data, ends - np.array([len(x) for x in raw], np.int64), ends, 2)[1] if raw else np.empty(0, np.uint64)


def _texts(it: Iterator[pa.RecordBatch]) -> Iterator[tuple[_Words, list[str]]]:
    """Runs of texts of batches of (lang, text), with the language of each text."""
    for batch in it:
        for piece in slices(batch, 1):
            langs = piece.column(0).to_pylist()
            salts = _salts(langs)
            data, offsets = column_bytes(piece.column(1))
            for i, j in runs(offsets):
                yield _Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], salts[i:j]), langs[i:j]


def _counted(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, word, code, n) of a task's words, added up over about COUNTED of them at a time."""
    held, size = [], 0

    def flush() -> pa.RecordBatch:
        nonlocal held, size
        code = np.concatenate([h[0] for h in held])
        n = np.concatenate([h[1] for h in held])
        every, first, where = np.unique(code, return_index=True, return_inverse=True)
        names = [np.concatenate([h[k] for h in held]) for k in (2, 3)]
        out = pa.RecordBatch.from_arrays([pa.array(names[0][first], pa.string()), pa.array(names[1][first], pa.binary()).cast(pa.string()), pa.array(every.view(np.int64)), pa.array(np.bincount(where, weights=n).astype(np.int64))], names=["lang", "word", "code", "n"])
        held, size = [], 0
        return out

    for w, langs in _texts(it):
        if not len(w.code):
            continue
        code, first, n = np.unique(w.code, return_index=True, return_counts=True)
        raw = w.data.tobytes()
        word = np.array([raw[a:b] for a, b in zip(w.starts[first].tolist(), w.ends[first].tolist(), strict=True)], object)
        held.append((code, n, np.array(langs, object)[w.text[first]], word))
        size += len(code)
        if size >= COUNTED:
            yield flush()
    if held:
        yield flush()


class _Codes:
    """The code of a word: its place among the frequent ones (from 1), or its digest; 0 for one that isn't frequent."""

    def __init__(self, known: np.ndarray | None):
        self.known = known

    def __call__(self, digest: np.ndarray) -> np.ndarray:
        if self.known is None:
            return digest
        if not len(self.known):
            return np.zeros(len(digest), np.uint64)
        at = np.minimum(np.searchsorted(self.known, digest), len(self.known) - 1)
        return np.where(self.known[at] == digest, at + 1, 0).astype(np.uint64)


def _suffixes(w: _Words, codes: _Codes, longest: int) -> np.ndarray:
    """One row for each suffix of two words or more: codes of its words, then zeros."""
    code = codes(w.code)
    n = len(code)
    out = np.zeros((n, longest), np.uint64)
    on = code > 0
    for k in range(longest):
        m = n - k
        if m <= 0:
            break
        if k:
            on = on[:m] & w.follows[k - 1 : n - 1] & (code[k:] > 0)
        out[:m, k] = np.where(on[:m], code[k:], 0)
    return out[out[:, 1] > 0] if longest > 1 else out[:0]


def _order(rows: np.ndarray, narrow: bool) -> np.ndarray:
    """The order of rows by their codes in turn; narrow ones are packed three to a number."""
    if narrow:
        keys = []
        for k in range(0, rows.shape[1], 3):
            key = np.zeros(len(rows), np.uint64)
            for j in range(k, min(k + 3, rows.shape[1])):
                key = key << np.uint64(21) | rows[:, j]
            keys.append(key)
        return np.lexsort(keys[::-1])
    return np.lexsort(rows.T[::-1])


def _distinct(rows: np.ndarray, n: np.ndarray, narrow: bool) -> tuple[np.ndarray, np.ndarray]:
    order = _order(rows, narrow)
    rows, n = rows[order], n[order]
    new = np.append(True, (rows[1:] != rows[:-1]).any(axis=1)) if len(rows) else np.empty(0, bool)
    first = np.flatnonzero(new)
    return rows[first], np.add.reduceat(n, first) if len(first) else n


def _parts(rows: np.ndarray, bounds: np.ndarray, narrow: bool) -> np.ndarray:
    """Where in sorted rows each range of suffixes begins (and the last one ends)."""
    both = np.concatenate([bounds, rows])
    order = _order(both, narrow)  # stable, so a bound comes before its equals
    place = np.empty(len(both), np.int64)
    place[order] = np.arange(len(both))
    return np.concatenate([[0], place[: len(bounds)] - np.arange(len(bounds)), [len(rows)]])


def _pack(rows: np.ndarray, n: np.ndarray, narrow: bool) -> bytes:
    """Sorted rows as differences of columns, whose bytes of one weight stand together."""
    kind = ">u4" if narrow else ">u8"
    planes = lambda x, t: np.ascontiguousarray(x.astype(t).view(np.uint8).reshape(-1, np.dtype(t).itemsize).T).tobytes()
    first = rows[:, 0].copy()
    first[1:] -= rows[:-1, 0]
    return zstandard.compress(planes(first, kind) + b"".join(planes(rows[:, k], kind) for k in range(1, rows.shape[1])) + planes(n, ">u8"), 1)


def _unpack(raw: bytes, m: int, longest: int, narrow: bool) -> tuple[np.ndarray, np.ndarray]:
    raw, kind = zstandard.decompress(raw), ">u4" if narrow else ">u8"
    size, at, out = np.dtype(kind).itemsize, 0, []
    for k in range(longest + 1):
        t, s = (kind, size) if k < longest else (">u8", 8)
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, s * m, at).reshape(s, m).T).view(t).ravel().astype(np.uint64))
        at += s * m
    out[0] = np.cumsum(out[0], dtype=np.uint64)
    return np.stack(out[:longest], axis=1), out[longest].astype(np.int64)


def _swept(rows: np.ndarray, n: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(prefixes, counts) of sorted distinct suffixes: those of ``least`` or more, and all that are open at either end.

    A prefix of d words is on the stack from where fewer than d words are shared with the suffix before to where
    that happens again.
    """
    m, longest = rows.shape
    if not m:
        return rows, n
    same = np.cumprod(rows[1:] == rows[:-1], axis=1).sum(axis=1) if m > 1 else np.empty(0, np.int64)
    out, counts = [], []
    for d in range(2, longest + 1):
        at = np.append(0, np.flatnonzero(same < d) + 1)
        total = np.add.reduceat(n, at)
        keep = (total >= least) | (at == 0)
        keep[-1] = True
        keep &= rows[at, d - 1] > 0
        found = rows[at[keep]].copy()
        found[:, d:] = 0
        out.append(found)
        counts.append(total[keep])
    return np.concatenate(out), np.concatenate(counts)


def _wait(shared, name: str, held: dict = {}) -> object:  # noqa: B006  one entry a worker, on purpose
    if name not in held:
        held.clear()
        held[name] = shared.value
    return held[name]


def count_words(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, word, code, n) of all words, A-Z as a-z; a null language is ``und``, a null text has no words."""
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    return texts.mapInArrow(_counted, "lang string, word string, code long, n long").groupBy("lang", "word").agg(F.first("code").alias("code"), F.sum("n").alias("n"))


def count_phrases(docs: DataFrame, vocabulary: DataFrame, least: int = LEAST, longest: int = LONGEST, lang_col: str = "lang", text_col: str = "text", most_words: int = MOST_WORDS, part: int = PART) -> DataFrame:
    """(lang, words, n) of the phrases of 2 to ``longest`` words that stand ``least`` times or more within pieces.

    ``vocabulary`` is that of ``count_words``.
    """
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).alias("text")).filter("text is not null")
    frequent = written(vocabulary.filter(F.col("n") >= least))
    size = frequent.agg(F.count("*").alias("words"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    narrow = size["words"] <= most_words
    known = np.unique(frequent.select("code").toPandas()["code"].to_numpy().astype(np.int64).view(np.uint64)) if narrow else None
    ranges = max(1, size["n"] // part)
    shared, name = spark.sparkContext.broadcast(known), uuid.uuid4().hex
    columns = [f"c{k}" for k in range(longest)]

    rate = min(SAMPLED * ranges, MOST_SAMPLED) / max(size["n"], 1)

    def sampled(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each suffix with the same chance: a text is read with one that grows with its length, and then its suffixes have the rest."""
        codes, chosen = _Codes(_wait(shared, name)), np.random.default_rng(TaskContext.get().partitionId())
        for batch in it:
            read = np.minimum(1, 10 * rate * np.maximum(1, np.nan_to_num(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False)) / SAMPLE_BYTES))
            for r in np.unique(read).tolist():
                own = np.flatnonzero((read == r) & (chosen.random(len(read)) < r))
                for w, _ in _texts(iter([batch.take(pa.array(own))])):
                    rows = _suffixes(w, codes, longest)
                    rows = rows[chosen.random(len(rows)) < rate / r]
                    yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(rows[:, k]).view(np.int64)) for k in range(longest)], names=columns)

    if ranges > 1:
        some = texts.mapInArrow(sampled, ", ".join(f"{c} long" for c in columns)).toPandas()
        rows = some.to_numpy().astype(np.int64).view(np.uint64).reshape(-1, longest)
        rows = rows[_order(rows, narrow)]
        bounds = np.unique(rows[(np.arange(1, ranges) * len(rows)) // ranges], axis=0) if len(rows) else rows
    else:
        bounds = np.empty((0, longest), np.uint64)
    edges, edges_name = spark.sparkContext.broadcast(bounds[_order(bounds, narrow)]), uuid.uuid4().hex

    def dealt(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, cuts, held, size = _Codes(_wait(shared, name)), edges.value, [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held, size
            rows = np.concatenate(held)
            held, size = [], 0
            rows, n = _distinct(rows, np.ones(len(rows), np.int64), narrow)
            at = _parts(rows, cuts, narrow)
            full = np.flatnonzero(np.diff(at)).tolist()
            payload = [_pack(rows[at[p] : at[p + 1]], n[at[p] : at[p + 1]], narrow) for p in full]
            yield pa.RecordBatch.from_arrays([pa.array(full, pa.int64()), pa.array([at[p + 1] - at[p] for p in full], pa.int64()), pa.array(payload, pa.binary())], names=["part", "n", "payload"])

        for w, _ in _texts(it):
            rows = _suffixes(w, codes, longest)
            held.append(rows)
            size += len(rows)
            if size >= PART:
                yield from flush()
        if size:
            yield from flush()

    def swept(pdf: pd.DataFrame) -> pd.DataFrame:
        both = [_unpack(raw, m, longest, narrow) for raw, m in zip(pdf["payload"], pdf["n"], strict=True)]
        rows, n = _distinct(np.concatenate([b[0] for b in both]), np.concatenate([b[1] for b in both]), narrow)
        rows, n = _swept(rows, n, least)
        return pd.DataFrame({c: np.ascontiguousarray(rows[:, k]).view(np.int64) for k, c in enumerate(columns)} | {"n": n})

    dealt_rows = texts.mapInArrow(dealt, "part long, n long, payload binary")
    partial = dealt_rows.groupBy("part").applyInPandas(swept, ", ".join([*(f"{c} long" for c in columns), "n long"]))
    coded = written(partial.groupBy(*columns).agg(F.sum("n").alias("n")).filter(F.col("n") >= least).withColumn("id", F.monotonically_increasing_id()))
    if narrow:

        def ranked(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            own = _wait(shared, name)
            for pdf in it:
                pdf["code"] = _Codes(own)(pdf["code"].to_numpy().astype(np.int64).view(np.uint64)).astype(np.int64)
                yield pdf

        frequent = frequent.mapInPandas(ranked, frequent.schema)
    # codes back to words
    spelled = coded.select("id", "n", F.posexplode(F.array(*columns)).alias("at", "code")).filter("code <> 0")
    spelled = spelled.join(frequent.select("code", "lang", "word"), "code")
    phrase = F.transform(F.sort_array(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]).alias("words")
    return written(spelled.groupBy("id").agg(F.first("lang").alias("lang"), phrase, F.first("n").alias("n")).drop("id"))


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, best: int | None = BEST, share: int = 100, lang_col: str = "lang", text_col: str = "text", most_words: int = MOST_WORDS, part: int = PART) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the phrases of each language whose words meet more often than by chance.

    Texts are cut into pieces at ``.,;:!?`` and line ends, and these into words at blanks and tabs; A-Z count as a-z.  A phrase has 2 to ``longest`` words
    and stands ``least`` times or more (``a``).  Of its cuts into two parts, with counts l and r, the one with the least
    score floor(1000 * a * n / (l * r)) counts, the first of equal ones; n is the number of the language's words.
    A phrase inside a longer one that stands at least ``share`` percent as often is left out.  Equal scores are ranked by a, then by
    the phrase's bytes.  ``best`` None gives all, without ranks.  Null texts and tables without rows give no phrases; a null language is ``und``; other
    columns don't matter; repeated rows count each.
    """
    vocabulary = written(count_words(docs, lang_col, text_col))
    totals = vocabulary.groupBy("lang").agg(F.sum("n").alias("total"))  # one row for each language
    phrases = count_phrases(docs, vocabulary, least, longest, lang_col, text_col, most_words, part)
    # what is inside a longer one: it is enough to look at those of one word more, as counts only fall with length
    inner = phrases.filter(F.size("words") > 2).select("lang", "n", F.explode(F.array(F.expr("slice(words, 1, size(words) - 1)"), F.expr("slice(words, 2, size(words) - 1)"))).alias("words"))
    longer = inner.groupBy("lang", "words").agg(F.max("n").alias("most"))
    kept = phrases.join(longer, ["lang", "words"], "left").filter(F.col("most").isNull() | (F.col("most") * 100 < F.col("n") * share)).drop("most")
    kept = written(kept.withColumn("id", F.monotonically_increasing_id()))
    single = vocabulary.filter(F.col("n") >= least).select("lang", F.array("word").alias("words"), F.col("n").alias("f"))
    known = single.unionByName(phrases.select("lang", "words", F.col("n").alias("f")))
    cut = kept.select("lang", "id", "words", F.explode(F.expr("sequence(1, size(words) - 1)")).alias("k"))
    side = lambda which, part_: cut.select("lang", "id", "k", F.lit(which).alias("side"), F.expr(part_).alias("words"))
    needed = side("l", "slice(words, 1, k)").unionByName(side("r", "slice(words, k + 1, size(words) - k)"))
    of = lambda which: F.max(F.when(F.col("side") == which, F.col("f")))
    counted = needed.join(known, ["lang", "words"]).groupBy("id", "k").agg(of("l").alias("l"), of("r").alias("r"))
    wide = lambda x: F.col(x).cast("decimal(19,0)")
    scored = counted.join(kept, "id").join(F.broadcast(totals), "lang")
    scored = scored.withColumns({"x": (F.col("n") * 1000).cast("decimal(19,0)") * wide("total"), "y": wide("l") * wide("r")}).withColumn("score", F.expr("x div y"))
    lowest = scored.groupBy("id").agg(F.min(F.struct("score", "k", "l", "r")).alias("c"), F.first("lang").alias("lang"), F.first("words").alias("words"), F.first("n").alias("a"), F.first("total").alias("n"))
    out = lowest.select("lang", F.array_join("words", " ").alias("phrase"), "a", "c.l", "c.r", "n", "c.score")
    order = [F.desc("score"), F.desc("a"), "phrase"]
    if best is not None:  # the best of each of many shares of a language first
        near = out.withColumn("_share", F.pmod(F.xxhash64("phrase"), F.lit(64)))
        near = near.withColumn("_rank", F.row_number().over(Window.partitionBy("lang", "_share").orderBy(*order))).filter(F.col("_rank") <= best).drop("_share", "_rank")
        ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= best)
    else:
        ranked = out.withColumn("rank", F.lit(None).cast("long"))
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
