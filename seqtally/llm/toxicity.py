"""Toxicity by a factorization machine over hashed terms.

A term is a lower-cased run of letters and digits; it gives one hashed feature if it occurs and a
second one if it occurs again.  The score is logistic in b + sum(w_i) + sum over pairs (v_i . v_j), so that
two mild terms can weigh together what neither weighs alone.

All features that stand in LEAST_ROWS training rows take part; none is chosen by its own relation to the label.
Weights and factors are fitted together under a penalty that grows with the noise of their gradients: a
weight, or a row of factors, stays zero unless its gradient is NOISE standard deviations from what labels dealt
at random would give, so a long text doesn't add up the noise of thousands of weights, and a term that tells
only beside another one is kept for its factors.  Factors start from a power iteration over what additive weights leave
unexplained, so that a pair whose terms tell nothing alone is come by among thousands of others.  What isn't zero is then
fitted again with a weak penalty.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqtally.llm.common import arrow_schema, field, give_back, given_back, slices
from seqtally.llm.kernels import column_bytes, runs, span_hashes, words

HASH_BITS = 18
FACTORS = 8
#: Labelled rows that the model is fitted on, at most: those with the least hash of their id.
SAMPLE_ROWS = 12_000
#: Training rows that a feature stands in at least: fewer can't show a relation.
LEAST_ROWS = 4
#: Standard deviations of noise that a gradient must exceed.
NOISE = 3.5
#: Parts of the rows, one for each step of descent; passes over them while weights are chosen, and when they are fitted again.
PARTS, CHOOSE, REFIT = 8, 16, 60
THRESHOLD = 0.3

_LETTERS = np.zeros(256, bool)
_LETTERS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _lower(data: np.ndarray) -> np.ndarray:
    """ASCII and Latin-1 capitals (C3 80-9E in UTF-8) in lower case."""
    out = _LOWER[data]
    if len(data) > 1:
        at = np.flatnonzero(data[:-1] == 0xC3) + 1
        at = at[(data[at] >= 0x80) & (data[at] <= 0x9E) & (data[at] != 0x97)]
        out[at] += 0x20
    return out


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, feature) of every feature that a text has, each once."""
    docs, out = [], []
    for i, j in runs(offsets):
        lo = offsets[i]
        d = _lower(data[lo : offsets[j]])
        starts, ends, doc = words(d, offsets[i : j + 1] - lo, _LETTERS)
        key = doc.astype(np.uint64) << np.uint64(HASH_BITS) | span_hashes(d, starts, ends) >> np.uint64(64 - HASH_BITS)
        key, n = np.unique(key, return_counts=True)
        again = key[n > 1]
        bucket = lambda k: (k & np.uint64((1 << HASH_BITS) - 1)).astype(np.int64)
        owner = lambda k: (k >> np.uint64(HASH_BITS)).astype(np.int64) + i
        docs += [owner(key), owner(again)]
        out += [bucket(key), bucket(again) + (1 << HASH_BITS)]
    return (np.concatenate(docs), np.concatenate(out)) if docs else (np.empty(0, np.int64), np.empty(0, np.int64))


@dataclass
class FactorizationMachine:
    bias: float
    index: np.ndarray  # from feature to its place in w and v, or -1
    w: np.ndarray
    v: np.ndarray

    def score(self, n: int, doc: np.ndarray, feature: np.ndarray) -> np.ndarray:
        at = self.index[feature]
        doc, at = doc[at >= 0], at[at >= 0]
        z = self.bias + np.bincount(doc, weights=self.w[at], minlength=n)
        for f in range(self.v.shape[1]):
            x = self.v[at, f]
            z += (np.bincount(doc, weights=x, minlength=n) ** 2 - np.bincount(doc, weights=x * x, minlength=n)) / 2
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


class _Rows:
    """A matrix of zeros and ones, in the order of rows and of columns."""

    def __init__(self, n: int, row: np.ndarray, col: np.ndarray, size: int):
        heads = lambda x: np.flatnonzero(np.append(True, x[1:] != x[:-1])) if len(x) else np.empty(0, np.int64)
        order = np.lexsort((col, row))
        self.shape, row, self.col = (n, size), row[order], col[order].astype(np.int32)
        self.row_heads = heads(row)
        self.rows = row[self.row_heads]
        order = np.argsort(self.col, kind="stable")
        self.row, col = row[order], self.col[order]
        self.col_heads = heads(col)
        self.cols = col[self.col_heads]

    def by_row(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((self.shape[0], *x.shape[1:]), np.float32)
        if len(self.rows):
            out[self.rows] = np.add.reduceat(x[self.col], self.row_heads, axis=0)
        return out

    def by_col(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((self.shape[1], *x.shape[1:]), np.float32)
        if len(self.cols):
            out[self.cols] = np.add.reduceat(x[self.row], self.col_heads, axis=0)
        return out


def _parts(row: np.ndarray, col: np.ndarray, label: np.ndarray, size: int, seed: int) -> list[tuple[_Rows, np.ndarray]]:
    """Rows dealt out into parts, at least some 32 in each."""
    n = len(label)
    count = max(1, min(PARTS, n // 32))
    part = np.random.default_rng(seed).permutation(n) % count
    out = []
    for k in range(count):
        own = np.flatnonzero(part == k)
        new = np.full(n, -1, np.int32)
        new[own] = np.arange(len(own))
        keep = part[row] == k
        out.append((_Rows(len(own), new[row[keep]], col[keep], size), label[own].astype(np.float32)))
    return out


def _descend(parts: list, size: int, bias: float, factors: int, passes: int, rate: float, seed: int, decay=(0.0, 0.0), noise: tuple | None = None, start: tuple | None = None) -> tuple[float, np.ndarray, np.ndarray]:
    """Bias, weights and factors after some passes over the parts, from ``start`` or from small random factors.

    ``noise`` (threshold of each weight, threshold of factors for a unit of what they are multiplied with) makes
    weights and whole rows of factors zero whose gradients stay below it.
    """
    w, v = start or (np.zeros(size), np.random.default_rng(seed).normal(0, 0.05, (size, factors)))
    p = [np.full(1, bias, np.float32), w.astype(np.float32), v.astype(np.float32)]
    mean, square = [np.zeros_like(x) for x in p], [np.zeros_like(x) for x in p[:2]] + [np.zeros((size, 1), np.float32)]
    beside = np.zeros(size, np.float32)  # mean square of the factors that a feature's own are multiplied with
    for step in range(1, passes * len(parts) + 1):
        x, y = parts[step % len(parts)]
        xv = x.by_row(p[2])
        own = x.by_row(np.column_stack([p[1], (p[2] ** 2).sum(1)]))
        z = p[0][0] + own[:, 0] + ((xv * xv).sum(1) - own[:, 1]) / 2
        err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(y)
        g = x.by_col(np.column_stack([err[:, None] * xv, err, (xv * xv).sum(1) / len(y)]).astype(np.float32))
        grads = [err.sum(keepdims=True), g[:, factors] + decay[0] * p[1], g[:, :factors] - g[:, factors, None] * p[2] + decay[1] * p[2]]
        beside += 0.1 * (g[:, factors + 1] - beside)
        for k, grad in enumerate(grads if factors else grads[:2]):
            mean[k] += 0.1 * (grad - mean[k])
            square[k] += 0.01 * ((grad * grad).mean(1, keepdims=True) if k == 2 else grad * grad) - 0.01 * square[k]
            speed = rate / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-8)
            new = p[k] - speed * mean[k] / (1 - 0.9**step)
            if noise and k == 1:
                new = np.sign(new) * np.maximum(np.abs(new) - speed * noise[0], 0)
            if noise and k == 2:
                length = np.sqrt((new * new).sum(1))
                least = speed[:, 0] * noise[1] * np.sqrt(beside / (1 - 0.9**step))
                new = new * np.maximum(1 - least / np.maximum(length, 1e-12), 0)[:, None]
            p[k] = new.astype(np.float32)
    return float(p[0][0]), p[1], p[2]


def _paired(parts: list, size: int, bias: float, w: np.ndarray, seed: int, columns: int = 16, rounds: int = 8) -> np.ndarray:
    """Which features go in pairs with what additive weights leave over: a power iteration that keeps few of them.

    The matrix is sum(residual * x_i * x_j), off its diagonal.  Beginning with random columns, a row of the product is kept
    as far as it exceeds the length that residuals dealt at random would give it; the bound rises with each round.
    """
    left = [(x, y - 1 / (1 + np.exp(-np.clip(bias + x.by_row(w), -30, 30)))) for x, y in parts]
    left = [(x, r - sum(q.sum() for _, q in left) / sum(len(q) for _, q in left)) for x, r in left]
    often = sum(x.by_col(np.ones(len(r), np.float32)) for x, r in left)
    own = sum(x.by_col(r) for x, r in left)
    u = np.random.default_rng(seed).normal(size=(size, columns)) / np.sqrt(np.maximum(often, 1))[:, None]
    for k in range(rounds):
        u = u.astype(np.float32)
        new, noise = -own[:, None] * u, np.zeros(size)
        for x, r in left:
            xu = x.by_row(u)
            both = x.by_col(np.column_stack([r[:, None] * xu, r * r * (xu * xu).sum(1)]).astype(np.float32))
            new += both[:, :-1]
            noise += both[:, -1]
        z = np.sqrt((new * new).sum(1) / np.maximum(noise, 1e-12))
        least = 1 + (1 + 0.5 * k) / np.sqrt(2 * columns)  # under chance z is about 1, with that spread
        u = new / np.sqrt(np.maximum(noise * often, 1e-12))[:, None] * np.maximum(1 - least / np.maximum(z, 1e-12), 0)[:, None]
        if not u.any():
            break
        u /= np.sqrt((u * u).sum(0)).max()
    return np.abs(u).sum(1) > 0


def fit(rows: list[np.ndarray], label: np.ndarray, factors: int = FACTORS, noise: float = NOISE, seed: int = 1) -> FactorizationMachine:
    """rows: the features of each training text.  Without rows of both labels every score is near the base rate.

    factors=0 gives additive weights alone.
    """
    index = np.full(2 << HASH_BITS, -1, np.int32)
    n, n1 = len(label), int(label.sum())
    base = (n1 + 0.5) / (n + 5)
    bias = float(np.log(base / (1 - base)))
    nothing = FactorizationMachine(bias, index, np.zeros(1), np.zeros((1, factors)))
    if not n1 or n1 == n:
        return nothing
    row = np.repeat(np.arange(n, dtype=np.int32), [len(r) for r in rows])
    flat = np.concatenate(rows).astype(np.int32)
    count = np.bincount(flat, minlength=len(index))
    chosen = np.flatnonzero(count >= LEAST_ROWS)
    spread = base * (1 - base) / n
    for _ in range(3 if len(chosen) else 0):  # what a first round has not brought to zero yet, the next ones do
        index[:] = -1
        index[chosen] = np.arange(len(chosen))
        col = index[flat]
        row, col, flat = row[col >= 0], col[col >= 0], flat[col >= 0]
        often = np.minimum(count[chosen], n - count[chosen] + 1)
        least = (noise * np.sqrt(often / n * spread)).astype(np.float32), noise * float(np.sqrt(spread))
        parts = _parts(row, col, label, len(chosen), seed)
        now, w, _ = _descend(parts, len(chosen), bias, 0, CHOOSE, 0.05, seed, noise=least)
        v = np.zeros((len(chosen), factors))
        if factors:
            v = np.random.default_rng(seed).normal(0, 0.05, v.shape) * _paired(parts, len(chosen), now, w, seed)[:, None]
            _, w, v = _descend(parts, len(chosen), now, factors, CHOOSE, 0.05, seed, noise=least, start=(w, v))
        keep = (w != 0) | (np.abs(v).sum(1) > 0)
        chosen = chosen[keep]
        if not len(chosen) or len(chosen) > 0.9 * len(keep):
            break
    index[:] = -1
    if not len(chosen):
        return nothing
    index[chosen] = np.arange(len(chosen))
    col = index[flat]
    parts = _parts(row[col >= 0], col[col >= 0], label, len(chosen), seed)
    bias, w, v = _descend(parts, len(chosen), bias, factors, REFIT * PARTS // len(parts), 0.03, seed, decay=(2e-4, 1e-3))
    return FactorizationMachine(bias, index, w.astype(np.float64), v.astype(np.float64))


def held_out(id_col: str = "doc_id") -> Column:
    """Rows whose labels are never learnt from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most_rows: int = SAMPLE_ROWS) -> FactorizationMachine:
    """Fits on at most ``most_rows`` labelled rows outside the held-out part.

    Rows with null labels or ids don't count; a null text is an empty one.  Repeated labels of an id count once, the
    greatest; repeated documents count each.  Extra columns are not read.  Without rows (empty tables, no labels) or with labels
    of one kind every score is near the base rate.
    """
    chosen = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label")).filter("doc_id is not null and label is not null").filter(~held_out("doc_id"))
    chosen = chosen.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in given_back(it):
            for batch in slices(whole, 1):
                doc, feature = features(*column_bytes(batch.column(1)))
                order = np.argsort(doc, kind="stable")
                cut = np.searchsorted(doc[order], np.arange(batch.num_rows + 1))
                flat = feature[order].astype("<i4")
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2).cast(pa.int32()), pa.array([flat[cut[k] : cut[k + 1]].tobytes() for k in range(batch.num_rows)], pa.binary())], names=["doc_id", "label", "features"])

    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    joined = source.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "label")  # at most most_rows rows
    rows = joined.mapInArrow(run, T.StructType([field(joined, "doc_id"), T.StructField("label", T.IntegerType()), T.StructField("features", T.BinaryType())])).toArrow()
    rows = rows.sort_by("doc_id")  # whatever order tasks end in, the sums are the same
    model = fit([np.frombuffer(x.as_buffer(), "<i4") for x in rows.column("features")] or [np.empty(0, np.int32)], rows.column("label").to_numpy().astype(np.int64) if rows.num_rows else np.zeros(1, np.int64))
    del rows
    give_back()
    return model


def score(docs: DataFrame, model: FactorizationMachine, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """All columns of docs, with score (0 to 1) and predicted (1 if score >= threshold) after them.

    A null text is empty; an empty text scores the bias alone.  Only the text is read, so repeated rows score
    alike, and columns of docs named like the new ones are replaced.  An empty table gives no rows.
    """
    docs = docs.drop("score", "predicted")
    at = docs.columns.index(text_col)
    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target = arrow_schema(schema)
        for whole in given_back(it):
            for batch in slices(whole, at):
                s = model.score(batch.num_rows, *features(*column_bytes(batch.column(at))))
                columns = [c.cast(f.type) for c, f in zip(batch.columns, target, strict=False)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(s), pa.array((s >= threshold).astype(np.int32))], schema=target)

    return docs.mapInArrow(run, schema)
