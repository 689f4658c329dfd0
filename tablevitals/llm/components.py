"""Connected components of an edge table: local contraction, then alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablevitals.llm.common import hot_join
from tablevitals.session import materialize

#: Edges that a task contracts at once.
EDGES = 1 << 21


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All nodes of some edges, in order, and the smallest node that each reaches over them."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[:len(a)], ends[len(a):]
    root = np.arange(len(nodes))
    while True:
        of_x, of_y = root[x], root[y]
        apart = of_x != of_y
        if not apart.any():
            return nodes, nodes[root]
        x, y, of_x, of_y = x[apart], y[apart], of_x[apart], of_y[apart]
        np.minimum.at(root, np.maximum(of_x, of_y), np.minimum(of_x, of_y))
        while (root != root[root]).any():
            root = root[root]


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (a, b) of a partition as stars around the smallest nodes they reach there."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def stars() -> pa.RecordBatch:
        nodes, root = roots(*map(np.concatenate, zip(*held)))
        return pa.RecordBatch.from_arrays([pa.array(nodes[nodes != root]), pa.array(root[nodes != root])], names=["a", "b"])

    for batch in batches:
        held.append((batch.column("a").to_numpy(), batch.column("b").to_numpy()))
        if sum(len(a) for a, _ in held) >= EDGES:
            yield stars()
            held = []
    if held:
        yield stars()


def _settled(edges: DataFrame) -> bool:
    """Whether every node has one edge to a smaller node, or only edges from larger ones."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        edges.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    sums = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return sums.where("up > 1 OR (up > 0 AND down > 0)").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b); the component is its smallest node.

    Edges lie in portions of about ``EDGES``, each of which is contracted in one task; that is all if there is one such
    portion. Else edges are joined with one minimum per node, split where a node has very many (``hot_join``), so a
    star's edges never meet in one task. Each round is a written table; their number grows with the logarithm of the
    longest path. ``links`` is read twice, so it should be a written table.
    """
    def contracted(edges: DataFrame, portions: int) -> DataFrame:
        return materialize(edges.where("a <> b").coalesce(portions).mapInArrow(_contracted, "a long, b long"))

    links = links.select("a", "b")
    portions = -(-max(1, links.count()) // EDGES)
    edges = contracted(links, portions)
    while portions > 1 and not _settled(edges):
        both = materialize(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))))
        lowest = materialize(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low"), F.count("*").alias("n")))
        large = hot_join(both.where("b > a"), lowest.drop("n"), ["a"], ["b"], lowest).select(F.col("b").alias("a"), F.col("low").alias("b"))
        large = materialize(large.where("a <> b").distinct())
        lowest = materialize(large.groupBy("a").agg(F.min("b").alias("low"), F.count("*").alias("n")))
        small = hot_join(large, lowest.drop("n"), ["a"], ["b"], lowest).select(F.explode(F.array(
            F.struct("a", F.col("low").alias("b")), F.struct(F.col("b").alias("a"), F.col("low").alias("b")))).alias("e"))
        edges = materialize(small.select("e.*").where("a <> b").distinct())
        edges = contracted(edges, -(-max(1, edges.count()) // EDGES))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
