"""The trie of all conversations' openings: one node for each distinct sequence of first turns.

A conversation is an array of digests of its turns.  Distinct arrays are sorted over the whole cluster in ranges; in each range one
sweep with a stack goes over the lengths that neighbours share (LCPs), opens a node where an array leaves the path of the one before,
and closes nodes that no later array has.  Nodes on the path of a range's first or last array may go on in the
range beside it: they are written as open pieces, and a second sweep of the same kind over the pieces alone, in the order of ranges, stitches them.
What is closed inside a range is final, but for the name of a parent that is open.

The ids of conversations that end at a node are hashed in a stream, sorted by node and id: SHA-256 takes its input in order, so a node's
ids pass through one task, one after another, but are never held together.  Copies of a conversation are one array for the sweep.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqtally.llm.common import written

#: Turns of a range of arrays.
PART_TURNS = 200_000
#: Hex digits of a turn's digest: 128 bits of SHA-256.
DIGITS = 32
ROWS = 4096
_NOBODY = hashlib.sha256(b"").hexdigest()


def conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turns): an array of (digest, chars) for each conversation, by turn number, null first.

    Null roles and texts are empty.  Turns with one number are in the order of role and text; their texts travel, others' don't.  Rows without a
    conversation's id belong to none.  The digests of one conversation have to fit in a row.
    """
    role, text = F.coalesce(F.col(role_col).cast("string"), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    digest = F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, DIGITS)
    rows = turns.filter(F.col(conv_col).isNotNull()).select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text"), digest.alias("digest"), F.char_length(text).cast("long").alias("chars"))
    tied = written(rows.groupBy("conv_id", "turn").agg(F.min("digest").alias("lo"), F.max("digest").alias("hi")).filter("lo <> hi").select(F.col("conv_id").alias("_c"), F.col("turn").alias("_t")))
    if tied.isEmpty():
        rows = rows.withColumns({"role": F.lit(""), "text": F.lit("")})
    else:
        rows = rows.join(tied, (F.col("conv_id") == F.col("_c")) & F.col("turn").eqNullSafe(F.col("_t")), "left")
        rows = rows.withColumns({c: F.when(F.col("_c").isNotNull(), F.col(c)).otherwise("") for c in ("role", "text")})
    order = F.sort_array(F.collect_list(F.struct("turn", "role", "text", "digest", "chars")))
    return rows.groupBy("conv_id").agg(F.transform(order, lambda x: F.struct(x["digest"].alias("digest"), x["chars"].alias("chars"))).alias("turns"))


def with_shared_openings(convs: DataFrame, block: int = 100, most: int = 5) -> DataFrame:
    """Conversations rebuilt: the first h turns of the first conversation c - c % block of a block, then one's own after its first h.

    h is crc32 of the decimal id modulo most + 1.  A block's first conversation may be absent: then nothing comes before.
    """
    h = (F.crc32(F.col("conv_id").cast("string")) % (most + 1)).cast("int")
    heads = convs.filter(F.col("conv_id") % block == 0).select(F.col("conv_id").alias("_head"), F.slice("turns", 1, most).alias("_opening"))
    joined = convs.withColumn("_head", F.col("conv_id") - F.col("conv_id") % block).join(heads, "_head", "left")
    opening = F.coalesce("_opening", F.slice("turns", 1, 0))
    return joined.select("conv_id", F.concat(F.slice(opening, F.lit(1), h), F.slice("turns", h + 1, F.size("turns"))).alias("turns"))


def _ends(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(name, least, n, ends): of rows sorted by name and id, the smallest id, the number and the digest of all ids of a name."""
    name, least, n, digest = None, 0, 0, None
    done: list[tuple] = []

    def made() -> pa.RecordBatch:
        columns = list(zip(*done, strict=True))
        done.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["name", "least", "n", "ends"])

    for batch in it:
        names, ids = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy()
        cuts = [0, *(np.flatnonzero(names[1:] != names[:-1]) + 1).tolist(), len(names)] if len(names) else [0]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            text = ",".join(map(str, ids[a:b].tolist())).encode()
            if names[a] == name:
                digest.update(b"," + text)
            else:
                if digest is not None:
                    done.append((name, least, n, digest.hexdigest()))
                name, least, n, digest = names[a], int(ids[a]), 0, hashlib.sha256(text)
            n += b - a
            if len(done) >= ROWS:
                yield made()
    if digest is not None:
        done.append((name, least, n, digest.hexdigest()))
        yield made()


class _Node:
    """A node on the stack; what its closed children add up to is in it already."""

    __slots__ = ("chars", "children", "digest", "ends", "least", "leaves", "n", "no", "pending", "saved", "side")

    def __init__(self, digest: str, chars: int, no: int = -1, side: int = -1):
        self.digest, self.chars, self.no, self.side = digest, chars, no, side
        self.n = self.children = self.leaves = self.saved = 0
        self.least: int | None = None
        self.ends: str | None = None
        self.pending: list[tuple] = []

    def add(self, n: int, least: int | None) -> None:
        self.n += n
        self.least = least if self.least is None else self.least if least is None else min(self.least, least)

    def close(self, depth: int, parent: _Node | None) -> tuple:
        """The finished node without its parent's name, which is added up in the parent."""
        leaves, saved = self.leaves or 1, self.saved + (self.n - 1) * self.chars
        if parent is not None:
            parent.children += 1
            parent.leaves += leaves
            parent.saved += saved
        return (self.least, depth, self.n, self.children, leaves, saved, self.ends or _NOBODY, self.digest)


_NODE = "least long, depth long, n long, children long, leaves long, saved long, ends string, digest string"
_SWEPT = f"kind int, part int, no int, side int, chars long, parent long, parent_no int, {_NODE}"
_CLOSED, _OPEN, _NAME = 0, 1, 2
_TYPES = [pa.int32()] * 4 + [pa.int64(), pa.int64(), pa.int32()] + [pa.int64()] * 6 + [pa.string()] * 2
_COLUMNS = [f.split()[0] for f in _SWEPT.split(", ")]


class _Rows:
    def __init__(self) -> None:
        self.held: list[tuple] = []

    def closed(self, rows: list[tuple], part: int, parent: int | None, parent_no: int | None) -> None:
        self.held += [(_CLOSED, part, None, None, None, parent, parent_no, *r) for r in rows]

    def batch(self) -> pa.RecordBatch:
        columns = zip(*self.held, strict=True)
        out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True)], names=_COLUMNS)
        self.held = []
        return out


def _sweep(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Closed nodes and open pieces of one range: rows (key, chars, n, least, ends), sorted by key."""
    part, out, stack = TaskContext.get().partitionId(), _Rows(), []
    pieces = 0

    def pop() -> None:
        depth, node = len(stack) - 1, stack.pop()
        parent = stack[-1] if stack else None
        if parent is not None:
            parent.add(node.n, node.least)
        if node.side < 0:
            parent.pending.append(node.close(depth, parent))
            out.closed(node.pending, part, node.least, None)
            if parent.side == 0:  # its piece is known: nothing has to wait for it
                out.closed(parent.pending, part, None, parent.no)
                parent.pending = []
        else:
            out.closed(node.pending, part, None, node.no)
            out.held.append((_OPEN, part, node.no, node.side, node.chars, None, None, node.least, depth, node.n, node.children, node.leaves, node.saved, node.ends, node.digest))

    for batch in it:
        for key, chars, n, least, ends in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            size, d = len(chars), 0
            first = not stack
            if first:
                stack.append(_Node("", 0, 0, 0))
                pieces = 1
            while d < size and d + 1 < len(stack) and stack[d + 1].digest == key[d * DIGITS : (d + 1) * DIGITS]:
                d += 1
            while len(stack) > d + 1:
                pop()
            for k in range(d, size):
                stack.append(_Node(key[k * DIGITS : (k + 1) * DIGITS], chars[k], pieces if first else -1, 0 if first else -1))
                pieces += first
            stack[-1].add(n, least)
            stack[-1].ends = ends
            if len(out.held) >= ROWS:
                yield out.batch()
    for node in stack:  # the path of the last array
        if node.side < 0:
            node.side, node.no = 1, pieces
            pieces += 1
    while stack:
        pop()
    if out.held:
        yield out.batch()


def _stitch(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Final nodes out of open pieces, sorted by range, side and depth, and the smallest id behind each piece's number."""
    out, stack, refs = _Rows(), [], []
    at = (None, None)
    meeting = False

    def pop() -> None:
        depth, node = len(stack) - 1, stack.pop()
        parent = stack[-1] if stack else None
        row = node.close(depth, parent)
        out.closed(node.pending, 0, node.least, None)
        if parent is None:
            out.closed([row], 0, None, None)
        else:
            parent.pending.append(row)
        out.held.extend((_NAME, p, no, None, None, node.least, None, *[None] * 8) for p, no in refs.pop())

    for batch in it:
        for row in batch.to_pylist():
            depth = row["depth"]
            if at != (row["part"], row["side"]):  # a right side begins where it leaves the left one
                at, meeting = (row["part"], row["side"]), row["side"] == 0
                if not meeting:
                    while len(stack) > depth:
                        pop()
            if meeting and depth < len(stack) and stack[depth].digest == row["digest"]:
                node = stack[depth]
            else:
                meeting = False
                while len(stack) > depth:
                    pop()
                node = _Node(row["digest"], row["chars"])
                stack.append(node)
                refs.append([])
            node.add(row["n"], row["least"])
            node.children += row["children"]
            node.leaves += row["leaves"]
            node.saved += row["saved"]
            node.ends = node.ends or row["ends"]
            refs[depth].append((row["part"], row["no"]))
        if len(out.held) >= ROWS:
            yield out.batch()
    while stack:
        pop()
    if out.held:
        yield out.batch()


def prefix_trie(convs: DataFrame, part_turns: int = PART_TURNS) -> DataFrame:
    """One row for each distinct sequence of first turns of conversations (conv_id, turns), the empty one included.

    conv_id: the smallest member, a conversation that begins with the sequence; depth: turns of it; parent_conv_id: the
    parent's conv_id, null for the root; n_convs: members; n_children, n_leaves: nodes right below, and childless ones in the
    subtree (itself, if it has no children); saved_tokens: characters that need not be read again, (n_convs - 1) times those of the last turn, over the
    subtree; ends_sha256: of the ids of conversations that end here, ascending, joined by commas; turn_digest: the last turn (empty for the root).
    Equal conversations are members each.  No conversations give no nodes.
    """
    key = F.array_join(F.transform("turns", lambda x: x["digest"]), "")
    table = convs.select("conv_id", key.alias("key"), F.transform("turns", lambda x: x["chars"]).alias("chars"))
    table = written(table.withColumn("name", F.sha2("key", 256)))
    total = table.agg(F.sum(F.size("chars") + 1)).first()[0] or 0
    ends = written(table.select("name", "conv_id").repartition("name").sortWithinPartitions("name", "conv_id").mapInArrow(_ends, "name string, least long, n long, ends string"))
    arrays = ends.join(table.select("name", F.col("conv_id").alias("least"), "key", "chars"), ["name", "least"]).select("key", "chars", "n", "least", "ends")
    ranges = int(max(1, total // part_turns))
    swept = written(arrays.repartitionByRange(ranges, "key").sortWithinPartitions("key").mapInArrow(_sweep, _SWEPT))
    pieces = swept.filter(F.col("kind") == _OPEN)
    stitched = written(pieces.repartition(1).sortWithinPartitions("part", "side", "depth").mapInArrow(_stitch, _SWEPT))
    closed = swept.filter(F.col("kind") == _CLOSED)
    names = stitched.filter(F.col("kind") == _NAME).select("part", F.col("no").alias("parent_no"), F.col("parent").alias("_parent"))
    below = closed.filter("parent_no is not null").join(names, ["part", "parent_no"]).withColumn("parent", F.col("_parent"))
    columns = ["least", "depth", "parent", "n", "children", "leaves", "saved", "ends", "digest"]
    nodes = closed.filter("parent_no is null").select(columns).unionByName(below.select(columns)).unionByName(stitched.filter(F.col("kind") == _CLOSED).select(columns))
    return nodes.toDF("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "turn_digest")
