"""Approximate nearest neighbours by learned partitions.

On a bounded sample, a graph of nearest neighbours is cut into balanced parts with few edges between them, and a small
classifier learns which parts a vector's neighbours lie in. The classifier puts every row into its likeliest part and
sends each query to several parts, where all rows are compared exactly.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablevitals.llm.common import ref
from tablevitals.session import materialize


def nearest(points: np.ndarray, k: int, block: int = 512) -> np.ndarray:
    """The k nearest other points of each point, by blocks."""
    norms = (points * points).sum(axis=1)
    found = np.empty((len(points), k), np.int64)
    for at in range(0, len(points), block):
        mine = slice(at, at + block)
        far = norms[None, :] - 2 * (points[mine] @ points.T)
        far[np.arange(len(far)), np.arange(at, at + len(far))] = np.inf
        found[mine] = np.argpartition(far, k - 1, axis=1)[:, :k]
    return found


def cut_graph(points: np.ndarray, graph: np.ndarray, parts: int, rounds: int = 30, slack: float = 1.05) -> np.ndarray:
    """Parts of nearly equal size with few edges between them.

    Starts from halving along the direction of most variance, again and again, and then moves points to the part
    of most of their neighbours, the largest gains first, as long as that part has room.
    """
    label = np.zeros(len(points), np.int64)
    n = 1
    while n < parts:
        for p in range(n):
            own = np.flatnonzero(label == p)
            centred = points[own] - points[own].mean(axis=0)
            axis = np.linalg.eigh(centred.T @ centred)[1][:, -1]
            label[own[np.argsort(centred @ axis, kind="stable")[len(own) // 2:]]] = p + n
        n *= 2
    room = math.ceil(slack * len(points) / n)
    ends = np.repeat(np.arange(len(points)), graph.shape[1])
    for _ in range(rounds):
        votes = np.zeros((len(points), n))
        np.add.at(votes, (ends, label[graph].reshape(-1)), 1)
        np.add.at(votes, (graph.reshape(-1), label[ends]), 1)
        best = votes.argmax(axis=1)
        gain = votes[np.arange(len(points)), best] - votes[np.arange(len(points)), label]
        sizes = np.bincount(label, minlength=n)
        moved = 0
        for i in np.argsort(-gain, kind="stable")[:int((gain > 0).sum())]:
            if sizes[best[i]] < room:
                sizes[label[i]] -= 1
                sizes[best[i]] += 1
                label[i] = best[i]
                moved += 1
        if moved < len(points) // 500:
            break
    return label


@dataclass
class Router:
    """A classifier with one hidden layer over standardised vectors, and how many parts a query visits."""
    mean: np.ndarray
    scale: float
    weights: list[np.ndarray]
    visits: int

    def shares(self, points: np.ndarray) -> np.ndarray:
        hidden, out = self.weights[:2], self.weights[2:]
        logits = np.maximum((points - self.mean) / self.scale @ hidden[0] + hidden[1], 0) @ out[0] + out[1]
        logits -= logits.max(axis=1, keepdims=True)
        shares = np.exp(logits)
        return shares / shares.sum(axis=1, keepdims=True)


def fit_router(points: np.ndarray, parts: int, k: int, recall: float, hidden: int = 64, epochs: int = 30,
               seed: int = 11) -> Router:
    """Learns where neighbours lie; ``visits`` is the least number of parts that reaches ``recall`` on the sample."""
    points = points.astype(np.float64)
    dims = points.shape[1]
    mean, scale = (points.mean(axis=0), float(points.std()) or 1.0) if len(points) else (np.zeros(dims), 1.0)
    if parts == 1 or len(points) <= k:
        return Router(mean, scale, [np.zeros((dims, 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1)], 1)
    graph = nearest(points, k)
    label = cut_graph(points, graph, parts)
    parts = int(label.max()) + 1
    wanted = np.zeros((len(points), parts))
    np.add.at(wanted, (np.repeat(np.arange(len(points)), k), label[graph].reshape(-1)), 1)
    wanted[np.arange(len(points)), label] += 1
    wanted /= wanted.sum(axis=1, keepdims=True)
    draw = np.random.Generator(np.random.PCG64(seed))
    weights = [draw.standard_normal((dims, hidden)) * (2 / dims) ** 0.5, np.zeros(hidden),
               draw.standard_normal((hidden, parts)) * hidden ** -0.5, np.zeros(parts)]
    router = Router(mean, scale, weights, parts)
    ready = (points - mean) / scale
    first, second, step = [0.0] * 4, [0.0] * 4, 0
    for epoch in range(epochs):
        order = draw.permutation(len(points))
        for at in range(0, len(order), 256):
            x, y = ready[order[at:at + 256]], wanted[order[at:at + 256]]
            inner = np.maximum(x @ weights[0] + weights[1], 0)
            off = (router.shares(points[order[at:at + 256]]) - y) / len(x)
            back = (off @ weights[2].T) * (inner > 0)
            step += 1
            for i, grad in enumerate((x.T @ back, back.sum(axis=0), inner.T @ off, off.sum(axis=0))):
                first[i] = 0.9 * first[i] + 0.1 * grad
                second[i] = 0.999 * second[i] + 0.001 * grad * grad
                weights[i] -= 0.005 * (1 - epoch / epochs) * (first[i] / (1 - 0.9 ** step)) / (
                    np.sqrt(second[i] / (1 - 0.999 ** step)) + 1e-8)
    shares = router.shares(points)
    home = shares.argmax(axis=1)
    rank = np.argsort(np.argsort(-shares, axis=1, kind="stable"), axis=1)
    needed = np.take_along_axis(rank, home[graph], axis=1).reshape(-1)
    router.visits = int(np.searchsorted(np.cumsum(np.bincount(needed, minlength=parts)) / len(needed), recall) + 1)
    return router


def _usable(vector: Column, dims: int | Column) -> Column:
    """Whether a vector has this many components, all there and finite, not all of them zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(vector) == dims) & ~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dims)


def _homes(router: Router, dims: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches):
        for batch in batches:
            home = router.shares(_matrix(batch.column("vector"), dims)).argmax(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(home.astype(np.int32))],
                                             names=[*batch.schema.names, "part"])
    return run


def _visited(router: Router, dims: int, sizes: np.ndarray, k: int) -> Callable:
    """Each query once per part it visits; further parts until these hold k rows besides the query."""
    def run(batches):
        for batch in batches:
            order = np.argsort(-router.shares(_matrix(batch.column("vector"), dims)), axis=1, kind="stable")
            before = np.cumsum(sizes[order], axis=1) - sizes[order]
            query, rank = np.nonzero((np.arange(order.shape[1]) < router.visits) | (before <= k))
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id").take(pa.array(query)), batch.column("vector").take(pa.array(query)),
                 pa.array(order[query, rank].astype(np.int32))], names=["vec_id", "vector", "part"])
    return run


def _compare(dims: int, k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
        """The k nearest rows of this block for each query, ties to the smaller id, by exact distances."""
        order = np.argsort(ids := rows["vec_id"].to_numpy(), kind="stable")
        ids = ids[order]
        points = _matrix(rows["vector"].combine_chunks(), dims)[order] if len(ids) else np.zeros((0, dims))
        asked = queries["vec_id"].to_numpy()
        vectors = _matrix(queries["vector"].combine_chunks(), dims) if len(asked) else np.zeros((0, dims))
        found: list[tuple[np.ndarray, ...]] = []
        norms = (points * points).sum(axis=1)
        for at in range(0, len(asked), 256):
            q, own = vectors[at:at + 256], asked[at:at + 256]
            lengths = (q * q).sum(axis=1)
            rough = lengths[:, None] + norms[None, :] - 2 * (q @ points.T)
            # Rounding can hide the last neighbours; what is this close to the limit is measured exactly.
            blur = 1e-9 * (lengths[:, None] + norms[None, :])
            if len(ids) > k:
                limit = np.partition(rough + blur, k, axis=1)[:, k]
                near = rough - blur <= limit[:, None]
            else:
                near = np.ones(rough.shape, bool)
            near &= own[:, None] != ids[None, :]
            i, j = np.nonzero(near)
            exact = np.empty(len(i))
            for lo in range(0, len(i), 100_000):
                part = slice(lo, lo + 100_000)
                exact[part] = np.sqrt(((q[i[part]] - points[j[part]]) ** 2).sum(axis=1))
            sort = np.lexsort((ids[j], exact, i))
            i, j, exact = i[sort], j[sort], exact[sort]
            begin = np.searchsorted(i, np.arange(len(q)))
            best = np.arange(len(i)) - begin[i] < k
            found.append((own[i[best]], ids[j[best]], exact[best]))
        columns = [np.concatenate(c) for c in zip(*found)] if found else [np.zeros(0, np.int64)] * 2 + [np.zeros(0)]
        return pa.table({"query_id": pa.array(columns[0]), "vec_id": pa.array(columns[1]), "score": pa.array(columns[2])})
    return run


def nearest_neighbours(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id",
                       vector_col: str = "embedding", sample_rows: int = 8192, part_rows: int = 512,
                       most_parts: int = 64, recall: float = 0.97, block: int = 8192, asked: int = 2048,
                       seed: int = 4) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows found of every query, by Euclidean distance.

    Every row is indexed and every query answered. Vectors that are missing, zero or hold missing or non-finite
    components take no part, nor those of another length than the commonest, nor rows without an id. A query's own
    id isn't among its neighbours; equal distances go to the smaller id. Rows alike in id and vector count as one.
    Queries with fewer candidates get all of them. Other columns are ignored whatever their names.

    The index is learnt from ``sample_rows`` rows at most, in parts of ``part_rows`` rows of that sample. Rows of a
    part are compared in blocks of about ``block`` rows with ``asked`` queries at a time, whatever the part's size.
    """
    given = vectors.select(ref(id_col).cast("long").alias("vec_id"), ref(vector_col).alias("vector"),
                           is_query.alias("is_query")).where("vec_id IS NOT NULL")
    lengths = given.where("size(vector) > 0").groupBy(F.size("vector").alias("n")).count()
    common = lengths.orderBy(F.desc("count"), "n").first()
    dims = common["n"] if common else 1
    rows = given.where(_usable(F.col("vector"), dims))
    order = F.xxhash64("vec_id", F.lit(seed))
    sample = rows.select("vec_id", "vector").orderBy(order, "vec_id").limit(sample_rows).toArrow()
    points = _matrix(sample["vector"].combine_chunks(), dims) if sample.num_rows else np.zeros((0, dims))
    distinct = np.unique(points, axis=0)
    parts = 1 << int(math.log2(max(1, min(most_parts, len(distinct) // part_rows))))
    router = fit_router(distinct, parts, k, recall)

    kind = rows.schema["vector"].dataType.simpleString()
    homes = materialize(rows.distinct().mapInArrow(
        _homes(router, dims), f"vec_id long, vector {kind}, is_query boolean, part int"))
    sizes = np.zeros(router.weights[3].shape[0], np.int64)
    for row in homes.groupBy("part").count().collect():
        sizes[row["part"]] = row["count"]
    visits = materialize(homes.where("is_query").select("vec_id", "vector").mapInArrow(
        _visited(router, dims, sizes, k), f"vec_id long, vector {kind}, part int"))
    blocks = homes.sparkSession.createDataFrame(
        [(p, max(1, -(-int(n) // block))) for p, n in enumerate(sizes)], "part int, blocks int")
    chunks = visits.groupBy("part").agg(F.ceil(F.count("*") / asked).cast("int").alias("chunks"))
    # One row per part, most_parts at most.
    plan = F.broadcast(materialize(blocks.join(chunks, "part")))
    left = homes.join(plan, "part").select(
        "vec_id", "vector", "part", F.pmod(F.xxhash64("vec_id"), "blocks").cast("int").alias("block"),
        F.explode(F.expr("sequence(0, chunks - 1)")).alias("chunk"))
    right = visits.join(plan, "part").select(
        "vec_id", "vector", "part", F.explode(F.expr("sequence(0, blocks - 1)")).alias("block"),
        F.pmod(F.xxhash64("vec_id", F.lit(1)), "chunks").cast("int").alias("chunk"))
    keys = ["part", "block", "chunk"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(
        _compare(dims, k), "query_id long, vec_id long, score double")
    ranked = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", ranked).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
