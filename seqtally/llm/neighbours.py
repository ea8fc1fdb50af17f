"""Near-duplicate vectors: a small-world graph for each shard, every shard queried, components united.

Equal vectors are one entry with a count.  Entries are dealt to shards by a hash; a graph is built for
each shard and written to the shared folder.  Queries go to every shard in blocks: a task has one shard and one block,
and reads the shard's graph once, so graphs are never shuffled.  Shards and blocks are bounded in bytes.
A query whose beam is full of links is widened until it isn't.  In each task a sample of queries is held
against brute force, and while too few of their links were found the beam of the whole block is
doubled, up to the size of the shard.  Similarities near the threshold are taken again in double
precision.  A query gives, for each shard, the number of its links and one link to each component of
the shard that it meets, not its pairs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqtally.llm.common import scratch, spread_join, written
from seqtally.llm.components import components
from seqtally.llm.hnsw import Graph, build
from seqtally.llm.tokenfiles import file_system

COSINE = 0.9
SHARDS = 6
#: Vectors of a shard and of a block at most, and bytes of their numbers; more vectors make more shards and blocks.
SHARD_ROWS, BLOCK_ROWS, MOST_BYTES = 100_000, 16_384, 64 << 20
BEAM = 32
AUDIT_ROWS = 48
AUDIT_RECALL = 0.99

_INDEX = "shard long, dim long, node binary, weight binary, vectors binary, level binary, links array<binary>, entry long"
_FOUND = "node long, n_links long, roots array<long>, recall double"


def _unit(raw: np.ndarray) -> np.ndarray:
    """Rows of length 1; a power of two is taken out first, so that no square over- or underflows."""
    x = raw.astype(np.float64)
    x = np.ldexp(x, -np.frexp(np.abs(x).max(1, initial=0))[1][:, None])
    return x / np.sqrt((x * x).sum(1))[:, None]


def _build(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("node")
    raw = np.stack([np.asarray(v, np.float64) for v in pdf["vector"]])
    g = build(_unit(raw).astype(np.float32))
    row = {"shard": pdf["shard"].iloc[0], "dim": raw.shape[1], "node": pdf["node"].to_numpy(np.int64).tobytes(), "weight": pdf["weight"].to_numpy(np.int64).tobytes(), "vectors": raw.tobytes(), "level": g.level.tobytes(), "links": [x.tobytes() for x in g.links], "entry": g.entry}
    return pd.DataFrame([row])


def _find(parent: np.ndarray, i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return int(i)


def _links(g: Graph, unit: np.ndarray, q: np.ndarray, least: float, beam: int) -> list[np.ndarray]:
    """Of each query, the shard's rows with a cosine of at least ``least``, as far as the search comes by them."""
    n, out = len(unit), [np.empty(0, np.int64)] * len(q)
    left = np.arange(len(q))
    while len(left):
        full = []
        step = max(8, min(256, (1 << 22) // max(n, 1), (1 << 22) // (beam * 64)))
        for i in range(0, len(left), step):
            own = left[i : i + step]
            if beam >= n:
                sims = q[own] @ unit.T
                hits = [np.flatnonzero(s >= least) for s in sims]
            else:
                ids, sims = g.search(q[own].astype(np.float32), beam)
                near = (sims >= least - 1e-4) & (ids >= 0)
                full += own[near.all(1)].tolist()
                hits = []
                for k in range(len(own)):
                    at = ids[k, near[k]]
                    hits.append(at[(unit[at] * q[own[k]]).sum(1) >= least] if len(at) else at)
            for k, at in zip(own.tolist(), hits, strict=True):
                out[k] = at
        left, beam = np.array(full, np.int64), min(4 * beam, n)
    return out


def _load(path: str, shard: int) -> dict | None:
    """The graph of a shard, or None if it has no vectors."""
    fs, base = file_system(path)
    place = f"{base}/shard={shard}"
    if fs.get_file_info(place).type != pafs.FileType.Directory:
        return None
    return pq.read_table(place, filesystem=fs, partitioning=None).to_pylist()[0]


def query_block(graph: dict, node: np.ndarray, vectors: np.ndarray, least: float = COSINE, beam: int = BEAM) -> tuple[list, list, list, float]:
    """(links of each query counted with weights, nodes of the shard's components it meets, edges that make these, recall of the last audit)."""
    own_node = np.frombuffer(graph["node"], np.int64)
    weight = np.frombuffer(graph["weight"], np.int64)
    unit = _unit(np.frombuffer(graph["vectors"], np.float64).reshape(len(own_node), -1))
    g = Graph(unit.astype(np.float32), np.frombuffer(graph["level"], np.int64), [np.frombuffer(x, np.int32).reshape(len(own_node) + 1, -1) for x in graph["links"]], int(graph["entry"]))
    q = _unit(vectors)
    rng = np.random.default_rng(int(node[0]) & 0xFFFF)
    while True:
        found = _links(g, unit, q, least, beam)
        linked = np.flatnonzero([len(f) > 0 for f in found])
        audit = np.unique(np.concatenate([rng.integers(0, len(q), AUDIT_ROWS), rng.choice(linked, min(len(linked), AUDIT_ROWS), replace=False) if len(linked) else linked]))
        # each audited query counts alike, whatever its links are, and itself not at all
        itself = own_node[None, :] == node[audit, None]
        exact = ((q[audit] @ unit.T >= least) & ~itself).sum(1)
        have = np.array([(own_node[found[k]] != node[k]).sum() for k in audit])
        recall = float((have[exact > 0] / exact[exact > 0]).mean()) if (exact > 0).any() else 1.0
        if recall >= AUDIT_RECALL or beam >= len(unit):
            break
        beam = min(2 * beam, len(unit))
    found = [f[own_node[f] != node[k]] for k, f in enumerate(found)]
    parent, edges = np.arange(len(own_node)), []
    for f in found:  # what one query links hangs together
        if len(f):
            a = _find(parent, int(f[0]))
            for j in f[1:][parent[f[1:]] != a].tolist():
                b = _find(parent, j)
                if a != b:
                    parent[b] = a
                    edges.append((int(own_node[b]), int(own_node[a])))
            parent[f] = a
    counts = [int(weight[f].sum()) for f in found]
    roots = [sorted({int(own_node[_find(parent, int(r))]) for r in np.unique(parent[f])}) for f in found]
    return counts, roots, edges, recall


def near_vectors(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = COSINE, shards: int = SHARDS, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """vec_id, n_links (other vectors with a cosine of at least ``least``), component_id, kept and least_audited_recall.

    A vector that is null, empty, zero or holds a null or a value that isn't finite links with nothing.
    Vectors of different lengths don't link.  Repeated rows link with each other.  component_id is the smallest
    id reachable by links; a null id is kept and counts as no id.  Labels and other columns are not read.
    An empty table gives no rows.  least_audited_recall is the least recall of the tasks' audits, the same in all rows.
    """
    spark = table.sparkSession
    kind = "float" if isinstance(getattr(table.schema[vector_col].dataType, "elementType", None), T.FloatType) else "double"
    source = table.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast(f"array<{kind}>").alias("vector"))
    fine = F.coalesce(F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("vector", lambda x: x != 0), F.lit(False))
    source = source.withColumn("vector", F.when(fine, F.transform("vector", lambda x: x + F.lit(0.0).cast(kind))))  # no negative zeros
    source = written(source.withColumns({"h": F.xxhash64("vector"), "k": F.xxhash64(F.lit(1), "vector")}))
    entries = source.filter("vector is not null").groupBy("vector", "h", "k").agg(F.min("vec_id").alias("least_id"), F.count("*").alias("weight"))
    entries = written(entries.withColumn("node", F.monotonically_increasing_id()))
    n, longest = entries.agg(F.count("*"), F.coalesce(F.max(F.size("vector")), F.lit(1))).first()
    most = max(1, MOST_BYTES // (8 * longest))
    shards = max(shards, -(-n // min(shard_rows, most)))
    blocks = max(1, -(-n // min(block_rows, most)))
    dim = F.size("vector").cast("long")
    dealt = entries.select("node", "vector", "weight", (F.pmod(F.xxhash64("node", F.lit(1)), F.lit(shards)) + dim * shards).alias("shard"), dim.alias("dim"), (F.pmod(F.xxhash64("node", F.lit(2)), F.lit(blocks)) + dim * blocks).alias("block"))
    index = scratch(spark)
    dealt.select("shard", "node", "vector", "weight").groupBy("shard").applyInPandas(_build, _INDEX).write.partitionBy("shard").parquet(index)
    queries = dealt.select("node", "vector", "block", F.explode(F.sequence(F.col("dim") * shards, F.col("dim") * shards + shards - 1)).alias("shard"))

    def search(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        graph = _load(index, int(key[0]))
        if graph is None:
            return pd.DataFrame({"node": [], "n_links": [], "roots": [], "recall": []}, dtype=object)
        node = pdf["node"].to_numpy(np.int64)
        counts, roots, edges, recall = query_block(graph, node, np.stack([np.asarray(v, np.float64) for v in pdf["vector"]]), least)
        out = [(a, c, r) for a, c, r in zip(node.tolist(), counts, roots, strict=True) if len(r)] + [(a, 0, [b]) for a, b in edges]
        out.append((None, 0, []))  # the audit is reported even where nothing was found
        return pd.DataFrame({"node": pd.array([a for a, _, _ in out], "Int64"), "n_links": [c for _, c, _ in out], "roots": [r for _, _, r in out], "recall": recall})

    found = written(queries.groupBy("shard", "block").applyInPandas(search, _FOUND))
    audited = found.agg(F.min("recall")).first()[0]
    found = found.filter("node is not null")
    roots = components(found.select(F.col("node").alias("a"), F.explode("roots").alias("b")))
    linked = found.groupBy("node").agg(F.sum("n_links").alias("links"))
    named = entries.join(linked, "node", "left").join(roots, "node", "left").select("h", "k", "least_id", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("root", "node").alias("root"))
    named = written(named)
    ids = named.groupBy("root").agg(F.min("least_id").alias("component_id"))
    whole = named.join(ids, "root").select("h", "k", "n_links", F.col("component_id").alias("c"))
    keyed = source.select("vec_id", F.when(F.col("vector").isNotNull(), F.col("h")).alias("h"), "k")
    joined = spread_join(keyed, whole, ["h", "k"], how="left")
    component = F.coalesce("c", "vec_id")
    return joined.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"), F.lit(audited).cast("double").alias("least_audited_recall"))
