"""SimHash fingerprints and near-duplicate groups by a generalised pigeonhole search.

Two fingerprints of 64 bits within ``distance`` bits agree, up to t_i bits, on at least one of m
partitions of their bits, if sum(t_i + 1) = distance + 1.  Bits that are correlated go into the same
partition, so that partitions are nearly independent and agreeing on one means little less than it
seems.  The thresholds t_i, -1 for a partition that is not used, come from dynamic programming over
the number of candidates and probes that they are expected to cost.  Each distinct fingerprint is
indexed under its own bits of a partition and probes all values within t_i; what meets is verified.

With ``least``, texts whose sets of shingles have that Jaccard similarity are linked, exactly, and no others are: the
groups found are compared first, and a prefix filter over all sets finds what fingerprints lose (see copies.py).

Equal fingerprints are one node.  A bucket gives the edges of a spanning forest, not its pairs.
Buckets of more than ``most`` fingerprints are divided: what differs in ``distance`` bits outside the
bits already equal agrees on one of distance + 1 parts of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqtally.llm.common import arrow_schema, field, given_back, slices, spread_join, written
from seqtally.llm.components import components
from seqtally.llm.copies import confirm
from seqtally.llm.kernels import column_bytes, gather, runs, words

BITS = 64
DISTANCE = 3
SHINGLE = 3
SEED = 42
#: Fingerprints, those with the least hash, on which chances of agreement are estimated.
SAMPLE = 4096
#: Fingerprints of a bucket that are compared with each other in one task.
MOST = 1 << 14
#: What a row of a bucket costs to shuffle and gather, in comparisons of two fingerprints.
ROW_COST = 2000.0
#: Buckets whose members agree on so many bits are not divided; they hold at most 2 ** (BITS - DIVIDED) fingerprints.
DIVIDED = 50

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, shingle: int = SHINGLE) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each run of texts: their number, and the text and hash of each shingle, repeats included, in order."""
    h = xxhash.xxh64_intdigest
    for i, j in runs(offsets):
        lo, n = offsets[i], j - i
        d = _LOWER[data[lo : offsets[j]]]
        starts, ends, doc = words(d, offsets[i : j + 1] - lo)
        if not len(doc):
            yield n, np.empty(0, np.int64), np.empty(0, np.uint64)
            continue
        size = ends - starts + 1
        text = gather(np.append(d, np.uint8(32)), starts, size)
        stop = np.cumsum(size)
        text[stop - 1] = 32
        begin, stop = stop - size, stop - 1
        per_doc = np.bincount(doc, minlength=n)
        first = np.cumsum(per_doc) - per_doc
        at = np.arange(len(doc))
        last = first[doc] + per_doc[doc] - 1
        keep = (at + shingle - 1 <= last) | ((per_doc[doc] < shingle) & (at == first[doc]))
        at = at[keep]
        end = np.minimum(at + shingle - 1, last[keep])
        raw = text.tobytes()
        yield n, doc[at], np.array([h(raw[a:b], SEED) for a, b in zip(begin[at].tolist(), stop[end].tolist(), strict=True)], np.uint64)


def _majority(n: int, owner: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    fp = np.zeros(n, np.uint64)
    if len(owner):
        head = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        total = np.diff(np.append(head, len(owner)))
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = np.add.reduceat(bits, head, axis=0, dtype=np.int32)
        fp[owner[head]] = np.packbits(2 * ones > total[:, None], axis=1, bitorder="little").view(np.uint64).ravel()
    return fp


def fingerprints(data: np.ndarray, offsets: np.ndarray, shingle: int = SHINGLE) -> np.ndarray:
    """A fingerprint for each text: bit set if it is set in over half the hashes of its shingles."""
    out = [_majority(*x) for x in shingle_hashes(data, offsets, shingle)]
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def _sets(n: int, owner: np.ndarray, hashes: np.ndarray) -> Iterator[np.ndarray]:
    cuts = np.searchsorted(owner, np.arange(n + 1))
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        yield np.unique(hashes[a:b])


def shingle_sets(data: np.ndarray, offsets: np.ndarray, shingle: int) -> Iterator[np.ndarray]:
    """The sorted distinct hashes of each text's shingles."""
    for x in shingle_hashes(data, offsets, shingle):
        yield from _sets(*x)


def set_name(hashes: np.ndarray) -> bytes:
    """128 bits that stand for a set."""
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


def fingerprint_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, sets: bool = False) -> DataFrame:
    """doc_id and fp (a signed long) of every row, and with sets=True ``node``, the name of its set of shingles.

    A null or empty text has fingerprint zero.  Null and repeated ids are kept; an empty table gives no rows.
    """
    schema = T.StructType([field(docs, id_col, "doc_id"), T.StructField("fp", T.LongType()), *([T.StructField("node", T.BinaryType())] if sets else [])])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target = arrow_schema(schema)
        for whole in given_back(it):
            for batch in slices(whole, 1):
                fp, node = [np.empty(0, np.uint64)], []
                for x in shingle_hashes(*column_bytes(batch.column(1)), shingle):
                    fp.append(_majority(*x))
                    node += map(set_name, _sets(*x)) if sets else []
                columns = [batch.column(0).cast(target.field(0).type), pa.array(np.concatenate(fp).view(np.int64)), *([pa.array(node, pa.binary())] if sets else [])]
                yield pa.RecordBatch.from_arrays(columns, schema=target)

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


# --- the plan of partitions and thresholds ----------------------------------------------------


def bit_moments(fps: DataFrame) -> tuple[int, np.ndarray]:
    """(number of fingerprints, how often bits i and j are both set), over all of them."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((BITS, BITS)), 0
        for batch in it:
            x = np.unpackbits(batch.column(0).to_numpy().view(np.uint64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float64)
            total += x.T @ x
            n += len(x)
        i, j = np.indices((BITS, BITS)).reshape(2, -1)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(i, -1)), pa.array(np.append(j, -1)), pa.array(np.append(total.ravel(), n).astype(np.int64))], names=["i", "j", "n"])

    rows = fps.select("fp").mapInArrow(run, "i long, j long, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).collect()
    out, n = np.zeros((BITS, BITS)), 0
    for r in rows:
        if r["i"] < 0:
            n = r["n"]
        else:
            out[r["i"], r["j"]] = r["n"]
    return n, out


def correlated_groups(n: int, moments: np.ndarray, m: int) -> list[list[int]]:
    """m groups of about BITS / m bits, each grown from the bit best correlated with it."""
    p = np.diag(moments) / max(n, 1)
    cov = moments / max(n, 1) - np.outer(p, p)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    phi = np.abs(cov / np.outer(sd, sd))
    np.fill_diagonal(phi, 0)
    free, out = set(range(BITS)), []
    for k in range(m):
        size = len(free) // (m - k)
        left = sorted(free)
        seed = left[int(np.argmax(phi[np.ix_(left, left)].sum(1)))]
        group = [seed]
        free.discard(seed)
        while len(group) < size:
            left = sorted(free)
            best = left[int(np.argmax(phi[np.ix_(left, group)].sum(1)))]
            group.append(best)
            free.discard(best)
        out.append(sorted(group))
    return out


def mask_of(bits: list[int]) -> int:
    return sum(1 << b for b in bits)


def agreement(sample: np.ndarray, mask: int, most: int) -> list[float]:
    """Chances that two fingerprints differ in at most 0, 1, ... most bits of the mask."""
    x, seen = sample & np.uint64(mask), np.zeros(BITS + 1)
    for i in range(0, len(x), 512):
        seen += np.bincount(np.bitwise_count(x[i : i + 512, None] ^ x[None, :]).ravel(), minlength=BITS + 1)
    seen[0] -= len(x)
    pairs = max(1, len(x) * (len(x) - 1))
    return [(seen[: t + 1].sum() + 1) / pairs for t in range(most + 1)]


def allocate(costs: list[list[float]], distance: int) -> tuple[float, list[int]]:
    """Thresholds with sum(t + 1) = distance + 1 of least cost; costs[i][t] is of partition i at t."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in costs:
        new: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, chosen) in best.items():
            for t in range(-1, distance - used + 1):
                c = cost + (row[t] if t >= 0 else 0.0)
                if used + t + 1 not in new or c < new[used + t + 1][0]:
                    new[used + t + 1] = (c, [*chosen, t])
        best = new
    return best[distance + 1]


def plan(n: int, moments: np.ndarray, sample: np.ndarray, distance: int = DISTANCE, most: int = MOST) -> list[tuple[int, int]]:
    """(mask, threshold) of each partition that is used.  Buckets of over ``most`` members are expected to be divided once."""
    best, n = None, max(n, 1)
    for m in range(1, distance + 2):
        masks = [mask_of(g) for g in correlated_groups(n, moments, m)]
        costs = []
        for mask in masks:
            width = mask.bit_count()
            chance = agreement(sample, mask, distance)
            again = distance + 1 if n * chance[0] > most else 1
            costs.append([n * n / 2 * chance[t] + ROW_COST * again * n * sum(comb(width, k) for k in range(t + 1)) for t in range(distance + 1)])
        cost, thresholds = allocate(costs, distance)
        if best is None or cost < best[0]:
            best = cost, [(mask, t) for mask, t in zip(masks, thresholds, strict=True) if t >= 0]
    return best[1]


def flips(mask: int, t: int) -> list[int]:
    bits = [b for b in range(BITS) if mask >> b & 1]
    return [mask_of(list(c)) for k in range(1, t + 1) for c in combinations(bits, k)]


# --- search -----------------------------------------------------------------------------------


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _buckets(fps: DataFrame, parts: list[tuple[int, int]]) -> DataFrame:
    """(bits, key, fp, own): ``bits`` is the mask that members agree on, own is false for a probe."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        variants = [(mask, [0, *flips(mask, t)]) for mask, t in parts]
        for batch in it:
            fp = batch.column(0).to_numpy().view(np.uint64)
            for mask, flip in variants:
                for i in range(0, len(flip), 64):
                    f = np.array(flip[i : i + 64], np.uint64)
                    key = ((fp & np.uint64(mask))[:, None] ^ f[None, :]).ravel()
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), _signed(mask))), pa.array(key.view(np.int64)), pa.array(np.repeat(fp, len(f)).view(np.int64)), pa.array(np.tile(f == 0, len(fp)))], names=["bits", "key", "fp", "own"])

    return fps.select("fp").mapInArrow(run, "bits long, key long, fp long, own boolean")


def _divide(rows: DataFrame, distance: int) -> DataFrame:
    """Each row once for each of distance + 1 parts of the bits outside its mask."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            bits, key, fp, own = (batch.column(k) for k in range(4))
            b, k, f = (x.to_numpy().view(np.uint64) for x in (bits, key, fp))
            for mask in np.unique(b):
                at = np.flatnonzero(b == mask)
                rest = [i for i in range(BITS) if not int(mask) >> i & 1]
                for g in range(distance + 1):
                    part = np.uint64(mask_of(rest[g :: distance + 1]))
                    new = np.uint64(int(mask) | int(part))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), new).view(np.int64)), pa.array(((k[at] & mask) | (f[at] & part)).view(np.int64)), pa.array(f[at].view(np.int64)), own.take(pa.array(at))], names=["bits", "key", "fp", "own"])

    return rows.select("bits", "key", "fp", "own").mapInArrow(run, "bits long, key long, fp long, own boolean")


def forest(own: np.ndarray, probes: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links among ``own`` and between it and ``probes``."""
    nodes = np.concatenate([own, probes])
    parent = np.arange(len(nodes))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    edges = []
    for i in range(len(own)):
        near = i + 1 + np.flatnonzero(np.bitwise_count(nodes[i + 1 :] ^ nodes[i]) <= distance)
        if not len(near):
            continue
        a = find(i)
        for j in near[parent[near] != a].tolist():
            b = find(j)
            if a != b:
                parent[b] = a
                edges.append((int(nodes[i]), int(nodes[j])))
        parent[near] = a
    return edges


def near_pairs(fps: DataFrame, parts: list[tuple[int, int]], distance: int = DISTANCE, most: int = MOST) -> DataFrame:
    """Edges (a, b) between distinct fingerprints, enough to connect all that are linked."""

    def verify(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            out = []
            for own, probes in zip(batch.column(0), batch.column(1), strict=True):
                a, b = (x.values.to_numpy(zero_copy_only=False).view(np.uint64) for x in (own, probes))
                if len(a) and len(a) + len(b) > 1:
                    out += forest(a, b, distance)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.array(x, np.uint64).view(np.int64)) for x in zip(*out, strict=True)], names=["a", "b"])

    rows, found = _buckets(fps, parts), None
    while True:
        sized = rows.groupBy("bits", "key").agg(F.count("*").alias("size"))
        large = written(sized.filter((F.col("size") > most) & (F.bit_count("bits") < DIVIDED)).select("bits", "key"))
        none = large.isEmpty()
        fit = rows if none else rows.join(large, ["bits", "key"], "left_anti")
        gathered = fit.groupBy("bits", "key").agg(F.collect_list(F.when(F.col("own"), F.col("fp"))).alias("own"), F.collect_list(F.when(~F.col("own"), F.col("fp"))).alias("probes"))
        edges = gathered.filter("size(own) > 0 and size(own) + size(probes) > 1").select("own", "probes").mapInArrow(verify, "a long, b long")
        found = edges if found is None else found.unionByName(edges)
        if none:
            return found
        # parts of different masks can make the same mask, so a row may come more than once
        rows = written(_divide(rows.join(large, ["bits", "key"]), distance).distinct())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, distance: int = DISTANCE, most: int = MOST, least: float | None = None) -> DataFrame:
    """doc_id, fingerprint (16 lower-case hex digits) and component_id, the smallest id reachable by links.

    Fingerprints within ``distance`` bits are linked.  With ``least``, all texts are linked whose sets of shingles have
    a Jaccard similarity of ``least`` or more, and no others; fingerprints then only say what to compare first.

    Words are runs of bytes other than 0x20 and 0x09-0x0D, lower-cased A-Z.  A text of fewer words than a
    shingle is one shingle; one without words, or a null, has fingerprint zero and is linked like any other (with
    ``least``, to others without words).  A null id keeps its row; its component is the smallest id that is not null.
    Rows with equal ids are rows of their own.  Extra columns are not read.  An empty table gives no rows.
    """
    table = written(fingerprint_table(docs, id_col, text_col, shingle, sets=least is not None))
    fps = written(table.groupBy("fp").agg(F.min("doc_id").alias("least")))
    n, moments = bit_moments(fps)
    sample = fps.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).toPandas()["fp"].to_numpy().astype(np.int64).view(np.uint64)
    edges = near_pairs(fps, plan(n, moments, sample, distance, most), distance, most)
    roots = components(edges)
    member = written(fps.join(roots, fps["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))
    if least is None:
        ids = member.groupBy("root").agg(F.min("least").alias("component_id"))
        named = member.join(ids, "root").select("fp", "component_id")
        out = spread_join(table, named, ["fp"])
    else:
        texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
        out = confirm(written(spread_join(table, member.select("fp", "root"), ["fp"])), texts, lambda *x: shingle_sets(*x, shingle), set_name, least)
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
