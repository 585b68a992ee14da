"""Approximate nearest neighbours on robust-pruned directed graphs.

Equal vectors form one node. Nodes are dealt by hash into shards of about
``SHARD_NODES``; each shard's graph is built in one task: nodes enter in
batches, a greedy beam search from the shard's medoid proposes neighbours, and
relaxed-distance pruning (factor ``ALPHA``) keeps at most ``DEGREE`` diverse
edges per node, forwards and backwards; a second pass refines the edges. Blocks
of queries then search every shard's graph by beam search, and the nearest of
all shards win. Distances of the answers are computed again in double precision
on the original vectors.

A node stands for all rows with its vector: it carries the smallest
``k + 1`` row ids, which is all that an answer of ``k`` rows can show of it
(ties go to the smaller id, and one of them may be the query itself).

Definitions for odd input. Vectors that are null, empty, all zero, or hold null
or non-finite components take no part, as query or answer, and so do rows with
a null id. Vectors are compared with vectors of the same length only. Rows that
share an id and a vector count once; a query never finds its own id. With fewer
candidates than ``k`` all are returned. An empty table gives no rows. Extra
columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, trimmed

SHARD_NODES = 2_048
DEGREE = 32
BEAM_BUILD = 48
BEAM_SEARCH = 64
ALPHA = 1.2
BATCH = 128
QUERY_BLOCK = 512
K = 10
_INF = np.float32(np.inf)


def _norms(x: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", x, x)


class Graph:
    """A shard's vectors and directed edges (-1 where a node has fewer)."""

    def __init__(self, vectors: np.ndarray, edges: np.ndarray | None = None, start: int | None = None):
        self.x = np.ascontiguousarray(vectors, np.float32)
        self.sq = _norms(self.x)
        centre = self.x.mean(0) if len(self.x) else np.zeros(self.x.shape[1], np.float32)
        self.start = int(np.argmin(_norms(self.x - centre))) if start is None and len(self.x) else start or 0
        self.edges = np.full((len(self.x), DEGREE), -1, np.int32) if edges is None else edges

    def beam(self, queries: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Greedy beam search of all queries at once: (nodes, squared distances), nearest first, -1 where none."""
        q = np.ascontiguousarray(queries, np.float32)
        m, n = len(q), len(self.x)
        qq = _norms(q)
        nodes = np.full((m, width), -1, np.int32)
        dist = np.full((m, width), _INF)
        done = np.ones((m, width), bool)
        seen = np.zeros((m, n), bool)
        nodes[:, 0] = self.start
        dist[:, 0] = np.maximum(qq + self.sq[self.start] - 2 * (q @ self.x[self.start]), 0)
        done[:, 0] = False
        seen[:, self.start] = True
        active = np.arange(m)
        while len(active):
            todo = np.where(done[active], _INF, dist[active])
            best = todo.argmin(1)
            open_ = np.isfinite(todo[np.arange(len(active)), best])
            active, best = active[open_], best[open_]
            if not len(active):
                break
            done[active, best] = True
            near = self.edges[nodes[active, best]]
            fresh = (near >= 0) & ~seen[active[:, None], near]
            seen[active[:, None], np.where(fresh, near, self.start)] = True
            d = qq[active, None] + self.sq[near] - 2 * np.einsum("ij,ikj->ik", q[active], self.x[near])
            d = np.where(fresh, np.maximum(d, 0), _INF)
            all_d = np.concatenate([dist[active], d], 1)
            order = np.argpartition(all_d, width - 1, axis=1)[:, :width]
            all_n = np.concatenate([nodes[active], near], 1)
            all_done = np.concatenate([done[active], ~fresh], 1)
            dist[active] = np.take_along_axis(all_d, order, 1)
            nodes[active] = np.take_along_axis(all_n, order, 1)
            done[active] = np.take_along_axis(all_done, order, 1) | ~np.isfinite(dist[active])
        order = np.argsort(dist, axis=1, kind="stable")
        dist = np.take_along_axis(dist, order, 1)
        return np.where(np.isfinite(dist), np.take_along_axis(nodes, order, 1), -1), dist

    def prune(self, at: np.ndarray, candidates: np.ndarray, alpha: float) -> np.ndarray:
        """Robust pruning for several nodes at once: from each row of candidates (-1: none) repeatedly keep the
        nearest and drop those that lie ``alpha`` times nearer to it than to the node."""
        c = np.where(candidates == at[:, None], -1, candidates)
        c = np.sort(c, axis=1)
        c[:, 1:][c[:, 1:] == c[:, :-1]] = -1
        v = self.x[c]
        d = np.maximum(self.sq[at][:, None] + self.sq[c] - 2 * np.einsum("ij,ikj->ik", self.x[at], v), 0)
        d = np.where(c >= 0, d, _INF)
        between = np.maximum(self.sq[c][:, :, None] + self.sq[c][:, None, :] - 2 * v @ v.transpose(0, 2, 1), 0)
        out = np.full((len(at), DEGREE), -1, np.int32)
        rows, alive = np.arange(len(at)), d.copy()
        for k in range(DEGREE):
            p = alive.argmin(1)
            ok = np.isfinite(alive[rows, p])
            if not ok.any():
                break
            out[ok, k] = c[rows, p][ok]
            covered = np.float32(alpha * alpha) * between[rows, p] <= d
            alive = np.where(covered & ok[:, None], _INF, alive)
            alive[rows, p] = _INF
        return out

    def build(self, seed: int = 17) -> Graph:
        """Insert all nodes in batches, twice; the first pass prunes without relaxation."""
        n = len(self.x)
        if n <= DEGREE + 1:
            for i in range(n):
                others = [j for j in range(n) if j != i]
                self.edges[i, :len(others)] = others
            return self
        rng = np.random.Generator(np.random.PCG64(seed))
        for i in range(n):  # random edges to start from
            self.edges[i, :4] = [(i + 1 + j) % n for j in rng.choice(n - 1, 4, replace=False)]
        for alpha in (1.0, ALPHA):
            order = rng.permutation(n)
            for a in range(0, n, BATCH):
                self._insert(order[a:a + BATCH], alpha)
        return self

    def _insert(self, at: np.ndarray, alpha: float) -> None:
        found, _ = self.beam(self.x[at], BEAM_BUILD)
        new = self.prune(at, np.concatenate([found, self.edges[at]], 1), alpha)
        self.edges[at] = new
        back_to, back_from = new.ravel(), np.repeat(at, DEGREE)
        real = back_to >= 0
        order = np.argsort(back_to[real], kind="stable")
        to, frm = back_to[real][order], back_from[real][order]
        targets, first, count = np.unique(to, return_index=True, return_counts=True)
        add = np.full((len(targets), int(count.max(initial=0))), -1, np.int32)
        add[np.repeat(np.arange(len(targets)), count), np.arange(len(to)) - np.repeat(first, count)] = frm
        old = self.edges[targets]
        room = (old >= 0).sum(1) + count <= DEGREE
        for t, f, c in zip(targets[room], first[room], count[room], strict=True):
            have = self.edges[t]
            extra = [x for x in frm[f:f + c] if x not in have]
            k = int((have >= 0).sum())
            self.edges[t] = np.r_[have[have >= 0], extra, np.full(DEGREE - k - len(extra), -1)]
        full = ~room
        for a in range(0, int(full.sum()), BATCH):
            part = np.flatnonzero(full)[a:a + BATCH]
            self.edges[targets[part]] = self.prune(targets[part], np.concatenate([old[part], add[part]], 1), alpha)


def usable(vector: Column) -> Column:
    """Whether a vector takes part."""
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))))
    return F.coalesce((F.size(vector) > 0) & finite & F.exists(vector, lambda v: v != 0), F.lit(False))


def nodes(table: DataFrame, k: int) -> DataFrame:
    """One row per distinct vector with its smallest ``k + 1`` ids. Rows that repeat an id and a vector are merged first,
    in the map tasks already, and ids beyond the smallest are dropped before the next shuffle, task by task, so a vector
    that a third of all rows hold stays small."""
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")) \
        .filter(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    rows = rows.withColumn("embedding", F.transform("embedding", lambda v: F.when(v == 0, F.lit(0.0)).otherwise(v)))
    first = Window.partitionBy("embedding").orderBy("vec_id")
    few = rows.dropDuplicates(["vec_id", "embedding"]).withColumn("pos", F.row_number().over(first)).filter(F.col("pos") <= k + 1)
    return few.groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from .common import grouped

    for shard in grouped(batches, "shard"):
        size = shard.column("dim")[0].as_py()
        flat = np.asarray(shard.column("embedding").combine_chunks().flatten())
        graph = Graph(flat.reshape(-1, size)).build()
        ids = shard.column("ids").combine_chunks()
        counts = np.asarray(pa.compute.list_value_length(ids)).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [shard.column("shard").slice(0, 1).combine_chunks(), pa.array([size], pa.int32()), pa.array([graph.start], pa.int32()),
             pa.array([flat.astype(np.float64).tobytes()], pa.binary()), pa.array([graph.edges.tobytes()], pa.binary()),
             pa.array([np.asarray(ids.flatten()).astype(np.int64).tobytes()], pa.binary()), pa.array([counts.tobytes()], pa.binary())],
            ["shard", "dim", "start", "vectors", "edges", "ids", "counts"])


_GRAPH_SCHEMA = "shard long, dim int, start int, vectors binary, edges binary, ids binary, counts binary"


def build(table: DataFrame, k: int = K, shard_nodes: int = SHARD_NODES) -> DataFrame:
    """One row per shard: the packed graph over its distinct vectors."""
    distinct = stored(nodes(table, k).withColumn("dim", F.size("embedding")), "vector-nodes")
    sizes = {r["dim"]: r["n"] for r in distinct.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()}
    shards = {d: max(1, math.ceil(n / shard_nodes)) for d, n in sizes.items()}
    count = F.coalesce(*[F.when(F.col("dim") == d, F.lit(s)) for d, s in shards.items()], F.lit(1)) if shards else F.lit(1)
    dealt = distinct.withColumn("shard", F.col("dim").cast("long") * F.lit(1 << 40) + F.pmod(F.xxhash64("embedding"), count))
    total = max(1, sum(shards.values()))
    dealt = dealt.repartitionByRange(min(total, 100_000), "shard").sortWithinPartitions("shard", F.element_at("ids", 1))
    return stored(dealt.select("shard", "dim", "embedding", "ids").mapInArrow(trimmed(_build), _GRAPH_SCHEMA), "vector-graphs")


def _search(k: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(n)[i] for n in batch.schema.names}
                size = row["dim"].as_py()
                x = np.frombuffer(row["vectors"].as_buffer(), np.float64).reshape(-1, size)
                graph = Graph(x, np.frombuffer(row["edges"].as_buffer(), np.int32).reshape(-1, DEGREE), row["start"].as_py())
                ids, counts = np.frombuffer(row["ids"].as_buffer(), np.int64), np.frombuffer(row["counts"].as_buffer(), np.int32)
                first = np.r_[0, np.cumsum(counts)]
                queries = np.asarray(row["queries"].values.flatten()).reshape(-1, size)
                own = np.asarray(row["query_ids"].values)
                found, _ = graph.beam(queries, max(width, k + 1))
                exact = np.sqrt(((x[found] - queries[:, None, :]) ** 2).sum(2))
                exact[found < 0] = np.inf
                out = []
                for q in range(len(queries)):
                    best = []
                    for j in np.argsort(exact[q], kind="stable"):
                        if not np.isfinite(exact[q, j]) or len(best) >= k and exact[q, j] > best[k - 1][0]:
                            break
                        node = found[q, j]
                        best += [(exact[q, j], v) for v in ids[first[node]:first[node + 1]] if v != own[q]]
                        best.sort()
                    out += [(own[q], v, s) for s, v in best[:k]]
                if out:
                    a, b, c = zip(*out, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.float64())],
                                                     ["query_id", "vec_id", "score"])
    return run


def search(queries: DataFrame, graphs: DataFrame, k: int = K, width: int = BEAM_SEARCH, block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found to each row of ``queries`` (vec_id, embedding).

    Queries are packed into blocks of at most about ``block`` rows; each block meets each graph of its dimension
    once, in a task that holds one graph and one block."""
    q = queries.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")) \
        .filter(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).dropDuplicates(["vec_id", "embedding"])
    q = q.withColumn("dim", F.size("embedding"))
    n = q.count()
    blocks = max(1, math.ceil(n / block))
    packed = q.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks))).groupBy("dim", "block") \
        .agg(F.sort_array(F.collect_list(F.struct("vec_id", "embedding"))).alias("rows"))
    packed = stored(packed.select("dim", "block", F.col("rows.vec_id").alias("query_ids"), F.col("rows.embedding").alias("queries")), "query-blocks")
    # one narrow row per (shard, block) decides the task; graph and block are fetched by key
    shards = graphs.select("shard", "dim")
    tasks = packed.select("dim", "block").join(shards, "dim").withColumn("task", F.xxhash64("shard", "block"))
    work = tasks.join(graphs.drop("dim"), "shard").join(packed, ["dim", "block"])
    work = work.repartition(F.col("task")).select("dim", "start", "vectors", "edges", "ids", "counts", "query_ids", "queries")
    found = work.mapInArrow(trimmed(_search(k, width)), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    best = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def nearest(table: DataFrame, k: int = K, every: int = 100) -> DataFrame:
    """Searches the whole table for its rows whose id is divisible by ``every``."""
    return search(table.filter(F.col("vec_id") % every == 0), build(table, k), k)
