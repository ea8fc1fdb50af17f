"""Chroma fingerprints of recordings, and their alignment.

A recording is cut into overlapping frames; a frame's spectrum is folded into twelve pitch classes.  Over
each few frames, sixteen filters compare sums of two regions of the (time, pitch class) plane, taken from an
integral image; each comparison is quantised to two bits, so a place becomes one packed 32-bit integer.
Two recordings are aligned by histograms of offsets between places with equal landmarks (two packed
integers in a row), and accepted by the share of bits that differ over the overlap at the best offset.

Landmarks only say which recordings are compared; a comparison reads both fingerprints, which are 1/32 of 8-bit
samples.  Recordings that share a landmark are first aligned with one of them, so a large group of copies costs its size;
accepted alignments are united into components.  Then every two that share landmarks at enough places (least_votes, or all that the
shorter one has) and are in different components are aligned.  So two such recordings are either united or rejected.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqtally.llm.common import arrow_schema, field, slices, spread_join, written
from seqtally.llm.components import linked

CLASSES = 12


@dataclass(frozen=True)
class Scale:
    """Samples of a frame and between frames, frames that a packed integer covers, lowest pitch as a part of the sampling rate.

    A semitone above ``lowest`` is as wide as a line of the spectrum, so all of them are told apart: at 8 kHz from 250 Hz up.
    """

    frame: int = 512
    hop: int = 128
    span: int = 8
    lowest: float = 1 / 30

    @cached_property
    def fold(self) -> np.ndarray:
        """Lines of the spectrum x pitch classes."""
        out = np.zeros((self.frame // 2 + 1, CLASSES), np.float32)
        for line in range(1, self.frame // 2 + 1):
            semitone = int(np.floor(CLASSES * np.log2(line / self.frame / self.lowest) + 0.5))
            if semitone >= 0:
                out[line, semitone % CLASSES] = 1
        return out

    @cached_property
    def filters(self) -> list[tuple[tuple[int, int, int, int, int], ...]]:
        """Each filter is regions (sign, from frame, to frame, from class, to class); made by rule.

        The kinds: a band against the rest of its frames, an earlier against a later half, a lower against an
        upper half of a band, and a checkerboard; at four places of the pitch axis each.
        """
        out, n = [], self.span
        m, q = n // 2, n // 4
        for k in range(4):
            a, b = 3 * k, 3 * k + 3
            lo, hi = 2 * k, 2 * k + 6
            out.append(((1, 0, n, a, b), (-1, 0, n, (a + 6) % 12, (a + 6) % 12 + 3)))
            out.append(((1, 0, m, lo, hi), (-1, m, n, lo, hi)))
            out.append(((1, q, n - q, lo, lo + 3), (-1, q, n - q, lo + 3, hi)))
            out.append(((1, 0, m, lo, lo + 3), (1, m, n, lo + 3, hi), (-1, m, n, lo, lo + 3), (-1, 0, m, lo + 3, hi)))
        return out


SCALE = Scale()
#: Equal landmarks at one offset, and the share of differing bits, for an alignment.
LEAST_VOTES, MOST_ERROR = 2, 0.25
#: Limits between the four levels of a comparison.
LEVELS = (-0.12, 0.0, 0.12)
_GRAY = np.array([0, 1, 3, 2], np.uint32)


def _wave(raw: bytes) -> np.ndarray:
    """Samples of a RIFF file; none if its header is cut, says nothing that can be read, or names another format."""
    at, kind, channels, bits, body = 12, 0, 0, 0, b""
    while at + 8 <= len(raw):
        name, size = raw[at : at + 4], struct.unpack_from("<I", raw, at + 4)[0]
        if name == b"fmt " and size >= 16 and at + 24 <= len(raw):
            kind, channels, bits = *struct.unpack_from("<HH", raw, at + 8), struct.unpack_from("<H", raw, at + 22)[0]
        elif name == b"data":
            body = raw[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    if channels < 1 or kind not in (1, 3, 0xFFFE) or bits not in ((32, 64) if kind == 3 else (8, 16, 24, 32)):
        return np.empty(0)
    width = bits // 8
    body = body[: len(body) // (width * channels) * (width * channels)]
    if kind == 3:
        x = np.nan_to_num(np.frombuffer(body, f"<f{width}").astype(np.float64), posinf=0.0, neginf=0.0)
    elif bits == 8:
        x = (np.frombuffer(body, np.uint8) - 128.0) / 128
    elif bits == 24:
        wide = np.zeros((len(body) // 3, 4), np.uint8)
        wide[:, 1:] = np.frombuffer(body, np.uint8).reshape(-1, 3)
        x = wide.view("<i4").ravel() / 2.0**31
    else:
        x = np.frombuffer(body, f"<i{width}") / 2.0 ** (bits - 1)
    return x.reshape(-1, channels).mean(1)


def decode(raw: bytes) -> np.ndarray:
    """Samples in -1 to 1 of a RIFF file with PCM of 8, 16, 24 or 32 bits or floats (channels are averaged).

    A RIFF file that can't be read has no samples.  Other bytes are unsigned 8-bit samples.
    """
    if raw[:4] == b"RIFF" and raw[8:12] == b"WAVE":
        return _wave(raw)
    return (np.frombuffer(raw, np.uint8) - 128.0) / 128


def chroma(x: np.ndarray, scale: Scale = SCALE) -> np.ndarray:
    """frames x pitch classes, each frame of unit length (or zero, where it is silent).

    What has a whole frame but not the frames of a landmark is followed by silence.
    """
    if len(x) < scale.frame:
        return np.zeros((0, CLASSES), np.float32)
    least = scale.frame + scale.span * scale.hop
    x = np.append(x, np.zeros(max(0, least - len(x)))).astype(np.float32)
    n = (len(x) - scale.frame) // scale.hop + 1
    out = np.empty((n, CLASSES), np.float32)
    window = np.hanning(scale.frame + 1)[:-1].astype(np.float32)
    for i in range(0, n, 1024):
        k = min(n, i + 1024)
        frames = np.lib.stride_tricks.sliding_window_view(x[i * scale.hop : (k - 1) * scale.hop + scale.frame], scale.frame)[:: scale.hop]
        spectrum = np.fft.rfft((frames - frames.mean(1, keepdims=True)) * window, axis=1)
        out[i:k] = (spectrum.real**2 + spectrum.imag**2).astype(np.float32) @ scale.fold
    norm = np.sqrt((out * out).sum(1, keepdims=True))
    return np.where(norm > 1e-4, out / np.maximum(norm, 1e-4), 0).astype(np.float32)


def packed(frames: np.ndarray, scale: Scale = SCALE) -> np.ndarray:
    """One packed integer for each place at which the frames of a span begin."""
    n = len(frames) - scale.span + 1
    if n < 1:
        return np.empty(0, np.uint32)
    image = np.zeros((len(frames) + 1, CLASSES + 1))
    image[1:, 1:] = frames.astype(np.float64).cumsum(0).cumsum(1)
    out = np.zeros(n, np.uint32)
    for regions in scale.filters:
        side = {1: np.zeros(n), -1: np.zeros(n)}
        for sign, t0, t1, c0, c1 in regions:
            side[sign] += image[t1 : t1 + n, c1] - image[t0 : t0 + n, c1] - image[t1 : t1 + n, c0] + image[t0 : t0 + n, c0]
        value = np.log((1 + np.maximum(side[1], 0)) / (1 + np.maximum(side[-1], 0)))
        out = out << np.uint32(2) | _GRAY[np.digitize(value, LEVELS)]
    return out


def fingerprint(raw: bytes, scale: Scale = SCALE) -> np.ndarray:
    return packed(chroma(decode(raw), scale), scale)


def landmarks(values: np.ndarray) -> np.ndarray:
    v = values.astype(np.uint64)
    return np.empty(0, np.uint64) if len(v) < 2 else v[:-1] << np.uint64(32) | v[1:]


def offsets(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each offset from -(len(b) - 2) up: places of equal landmarks, and distinct landmarks that are equal, with a's place i beside b's i - offset."""
    x, y = landmarks(a), landmarks(b)
    size = max(0, len(x) + len(y) - 1)
    places, distinct = np.zeros(size, np.int64), np.zeros(size, np.int64)
    for mark in np.intersect1d(x, y):
        p, q = np.flatnonzero(x == mark), np.flatnonzero(y == mark)
        if len(p) * len(q) <= 64 * size:
            n = np.bincount((p[:, None] - q[None, :]).ravel() + len(y) - 1, minlength=size)
        else:  # a steady sound: the same sums by a product of spectra
            at, width = np.zeros((2, size)), 1 << (size - 1).bit_length()
            at[0, p], at[1, len(y) - 1 - q] = 1, 1
            n = np.rint(np.fft.irfft(np.prod(np.fft.rfft(at, width, axis=1), axis=0), width)[:size]).astype(np.int64)
        places += n
        distinct += n > 0
    return places, distinct


def bit_error(a: np.ndarray, b: np.ndarray, offset: int) -> tuple[float, int]:
    """(share of bits that differ, places compared) with a's place i beside b's place i - offset."""
    lo, hi = max(0, offset), min(len(a), len(b) + offset)
    if hi <= lo:
        return 1.0, 0
    x = a[lo:hi] ^ b[lo - offset : hi - offset]
    return float(np.bitwise_count(x).sum()) / (32 * (hi - lo)), hi - lo


def alignment(a: np.ndarray, b: np.ndarray) -> tuple[int, int, float] | None:
    """(offset, votes, bit error) of a against b, or None if no landmark is equal.

    Of the offset with the most places and that with the most distinct landmarks (pauses can outvote the rest by places),
    the one with the smaller error counts; of equals that nearest to zero, then the lesser.
    """
    places, distinct = offsets(a, b)
    best = None
    for n in (places, distinct):
        if not n.any():
            return None
        top = np.flatnonzero(n == n.max()) - (len(b) - 2)
        shift = min(top.tolist(), key=lambda s: (abs(s), s))
        error = bit_error(a, b, shift)[0]
        found = (error, -int(places[shift + len(b) - 2]), abs(shift), shift)
        best = found if best is None or found < best else best
    return best[3], -best[1], best[0]


def fingerprints(table: DataFrame, id_col: str, audio: Column, scale: Scale = SCALE) -> DataFrame:
    """id, n_values, vals (little-endian unsigned 32-bit) and, where there are samples but no values, a digest of the samples.

    A null or empty recording, or one that can't be read, has neither.  Null and repeated ids are kept; an empty table gives no rows.
    """
    source = table.select(F.col(id_col).alias("id"), audio.cast("binary").alias("audio"))
    schema = T.StructType([field(source, "id"), T.StructField("n_values", T.LongType()), T.StructField("vals", T.BinaryType()), T.StructField("samples", T.StringType())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target = arrow_schema(schema)
        for whole in it:
            for batch in slices(whole, 1):
                values, short = [], []
                for x in batch.column(1):
                    x = decode(x.as_py() or b"")
                    values.append(packed(chroma(x, scale), scale))
                    short.append(hashlib.sha256(x.tobytes()).hexdigest() if len(x) and not len(values[-1]) else None)
                yield pa.RecordBatch.from_arrays([batch.column(0).cast(target.field(0).type), pa.array([len(v) for v in values], pa.int64()), pa.array([v.astype("<u4").tobytes() for v in values], pa.binary()), pa.array(short, pa.string())], schema=target)

    return source.mapInArrow(run, schema)


def _landmarks(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct landmarks of each class, the number of places of each, and that of all."""
    for batch in it:
        marks = [np.unique(landmarks(np.frombuffer(raw.as_buffer(), "<u4")), return_counts=True) for raw in batch.column(1)]
        if marks:
            key, times = np.concatenate([m for m, _ in marks]), np.concatenate([n for _, n in marks])
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(np.repeat(batch.column(0).to_numpy(), [len(m) for m, _ in marks])), pa.array(times.astype(np.int64)), pa.array(np.repeat([int(n.sum()) for _, n in marks], [len(m) for m, _ in marks]))], names=["key", "node", "times", "places"])


_ALIGNED = "a long, b long, shift long, votes long, error double, places long"


def _align(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        shorter = pa.array([min(x.as_buffer().size, y.as_buffer().size) // 4 - 1 for x, y in zip(batch.column(2), batch.column(3), strict=True)], pa.int64())
        found = [alignment(np.frombuffer(x.as_buffer(), "<u4"), np.frombuffer(y.as_buffer(), "<u4")) or (None, 0, None) for x, y in zip(batch.column(2), batch.column(3), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([f[k] for f in found], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.float64()))), shorter], names=["a", "b", "shift", "votes", "error", "places"])


def align(table: DataFrame, id_col: str, audio: Column, least_votes: int = LEAST_VOTES, most_error: float = MOST_ERROR, scale: Scale = SCALE) -> DataFrame:
    """One row for each recording: id, n_values, values_crc32, class_id, component_id, shift, votes, error.

    class_id: the smallest id with the same packed integers or, of recordings shorter than a frame, with the same samples.
    Two classes are linked if their alignment (see ``alignment``) has least_votes votes, or one for each landmark that the shorter one has if these are
    fewer, and an error of at most most_error (both limits included);
    component_id is the smallest id reachable.  shift (in frames), votes and error are those of a class against the class of
    the component's smallest id: null in that class itself, votes 0 where the two share no landmark.
    A recording without samples, or null, is alone.  A null id is kept, and counts as no id.
    Repeated rows are one class.  Extra columns are not read.  An empty table gives no rows.
    """
    prints = fingerprints(table, id_col, audio, scale).withColumn("row", F.monotonically_increasing_id())
    alone = F.coalesce(F.concat(F.lit("samples "), "samples"), F.col("row").cast("string"))
    prints = written(prints.withColumn("class_key", F.when(F.col("n_values") > 0, F.sha2("vals", 256)).otherwise(alone)).drop("row", "samples"))
    classes = written(prints.groupBy("class_key").agg(F.min("id").alias("class_id"), F.any_value("vals").alias("vals")).withColumn("class", F.monotonically_increasing_id()))
    marks = written(classes.select("class", "vals").mapInArrow(_landmarks, "key long, node long, times long, places long"))
    several = marks.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).filter("lo <> hi").select("key")
    shared = written(marks.join(several, "key"))
    side = lambda c, v: classes.select(F.col("class").alias(c), F.col("vals").alias(v))
    aligned = lambda pairs: pairs.join(side("a", "x"), "a").join(side("b", "y"), "b").select("a", "b", "x", "y").mapInArrow(_align, _ALIGNED)

    def compare(pairs: DataFrame) -> DataFrame:
        return aligned(pairs).filter((F.col("votes") >= F.least(F.lit(least_votes), "places")) & (F.col("error") <= most_error)).select("a", "b")

    _, roots = linked(shared.withColumn("need", F.least(F.lit(least_votes), "places")), compare)  # fewer places can't give as many votes
    known = written(classes.select("class_key", "class", "class_id").join(roots, F.col("class") == F.col("node"), "left").withColumn("root", F.coalesce("root", "class")).drop("node"))
    # the smallest id that isn't null, and the class that has it
    firsts = known.groupBy("root").agg(F.min(F.when(F.col("class_id").isNotNull(), F.struct("class_id", "class"))).alias("first"), F.min("class").alias("any"))
    firsts = firsts.select("root", F.col("first.class_id").alias("component_id"), F.coalesce("first.class", "any").alias("b"))
    placed = written(known.join(firsts, "root"))
    beside = aligned(placed.filter(F.col("class") != F.col("b")).select(F.col("class").alias("a"), "b")).select(F.col("a").alias("class"), "shift", "votes", "error")
    final = placed.join(beside, "class", "left").select("class_key", "class_id", "component_id", "shift", "votes", "error")
    return prints.select("id", "n_values", F.crc32("vals").alias("values_crc32"), "class_key").transform(lambda rows: spread_join(rows, final, ["class_key"])).drop("class_key")
