"""Hard negatives by Strassen products of integer tiles and mergeable heaps.

Anchors and candidates meet in tiles of bounded size. A tile's scores are one integer matrix product, multiplied by
Strassen's recursion: seven products of half the size instead of eight, exact in 64-bit integers. A first pass keeps a
heap of the best rows of its own label for each anchor; with these positives known, a second pass keeps, for each anchor
and positive, a heap of the best rows of other labels whose scores lie in the positive's window. Heaps of a task take in
one tile after another and are merged across tasks by rank.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablevitals.llm.common import ref
from tablevitals.session import materialize

#: Sides of matrices from which on Strassen's recursion goes on; smaller ones are multiplied directly.
LEAF = 32
#: Rows of candidates scored at once.
TILE = 2048
#: Scaled components beyond this size could give scores beyond 64 bits.
MOST_COMPONENT, MOST_DIMS = 1 << 22, 1 << 10
NOTHING = np.iinfo(np.int64).min


def _halved(m: np.ndarray) -> tuple[np.ndarray, ...]:
    """The four quarters of a matrix, padded by zeros to even sides."""
    rows, columns = (m.shape[0] + 1) // 2, (m.shape[1] + 1) // 2
    if m.shape != (2 * rows, 2 * columns):
        padded = np.zeros((2 * rows, 2 * columns), np.int64)
        padded[:m.shape[0], :m.shape[1]] = m
        m = padded
    return m[:rows, :columns], m[:rows, columns:], m[rows:, :columns], m[rows:, columns:]


def strassen(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The product of two int64 matrices; exact as long as its entries fit into 64 bits, whatever lies between."""
    if min(a.shape[0], a.shape[1], b.shape[1]) <= LEAF:
        return a @ b
    a11, a12, a21, a22 = _halved(a)
    b11, b12, b21, b22 = _halved(b)
    m1, m2 = strassen(a11 + a22, b11 + b22), strassen(a21 + a22, b11)
    m3, m4 = strassen(a11, b12 - b22), strassen(a22, b21 - b11)
    m5, m6, m7 = strassen(a11 + a12, b22), strassen(a21 - a11, b11 + b12), strassen(a12 - a22, b21 + b22)
    out = np.empty((2 * a11.shape[0], 2 * b11.shape[1]), np.int64)
    rows, columns = a11.shape[0], b11.shape[1]
    out[:rows, :columns] = m1 + m4 - m5 + m7
    out[:rows, columns:] = m3 + m5
    out[rows:, :columns] = m2 + m4
    out[rows:, columns:] = m1 - m2 + m3 + m6
    return out[:a.shape[0], :b.shape[1]]


class Heaps:
    """The ``k`` best (score, id) of each of some owners, larger scores first, then smaller ids."""

    def __init__(self, owners: int, k: int):
        self.k = k
        self.owner, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))
        self.least = np.full(owners, NOTHING)  # what a score must reach to get in

    def push(self, owner: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(owner):
            return
        owner, score, ids = (np.concatenate(p) for p in ((self.owner, owner), (self.score, score), (self.id, ids)))
        order = np.lexsort((ids, -score, owner))
        owner, score, ids = owner[order], score[order], ids[order]
        place = np.arange(len(owner)) - np.searchsorted(owner, owner)
        top = place < self.k
        self.owner, self.score, self.id = owner[top], score[top], ids[top]
        full = place == self.k - 1
        self.least[owner[full]] = score[full]


def _matrix(vectors: pa.ChunkedArray, dims: int) -> np.ndarray:
    """Components times 256, rounded down; shorter vectors are padded with zeros."""
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    lengths = vectors.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(vectors), dims), np.int64)
    values = np.floor(vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * 256)
    out[np.arange(dims)[None, :] < lengths[:, None]] = values.astype(np.int64)
    return out


def _tiles(rows: pa.Table, dims: int):
    """Ids, labels and transposed matrix of the candidates of a block, tile by tile."""
    for at in range(0, rows.num_rows, TILE):
        part = rows.slice(at, TILE)
        yield part["vec_id"].to_numpy(), part["label"].to_numpy(), _matrix(part["vector"], dims).T


def _positives(dims: int, k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        own_id, own_label = anchors["own_id"].to_numpy(), anchors["own_label"].to_numpy()
        own, heaps = _matrix(anchors["own_vector"], dims), Heaps(anchors.num_rows, k)
        for ids, labels, matrix in _tiles(rows, dims):
            scores = strassen(own, matrix)
            i, j = np.nonzero((own_label[:, None] == labels[None, :]) & (own_id[:, None] != ids[None, :])
                              & (scores >= heaps.least[:, None]))
            heaps.push(i, scores[i, j], ids[j])
        return pa.table({"anchor_id": own_id[heaps.owner], "positive_id": heaps.id, "positive_score": heaps.score})
    return run


def _negatives(dims: int, k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        own_label, own = anchors["own_label"].to_numpy(), _matrix(anchors["own_vector"], dims)
        lists = anchors["positives"].combine_chunks()
        owner = np.repeat(np.arange(anchors.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
        positive, reached = (lists.flatten().field(n).to_numpy() for n in ("positive_id", "positive_score"))
        low, high = -(-30 * reached // 100), 90 * reached // 100
        heaps = Heaps(len(owner), k)
        for ids, labels, matrix in _tiles(rows, dims):
            scores = strassen(own, matrix)
            for at in range(0, len(owner), 256):  # some windows at a time
                mine = owner[at:at + 256]
                of = scores[mine]
                i, j = np.nonzero((of >= np.maximum(low, heaps.least)[at:at + 256, None]) & (of <= high[at:at + 256, None])
                                  & (own_label[mine][:, None] != labels[None, :]))
                heaps.push(i + at, of[i, j], ids[j])
        return pa.table({"anchor_id": anchors["own_id"].to_numpy()[owner[heaps.owner]],
                         "positive_id": positive[heaps.owner], "positive_score": reached[heaps.owner],
                         "negative_id": heaps.id, "negative_score": heaps.score})
    return run


def hard_negatives(vectors: DataFrame, is_anchor: Column, label: Column, k: int = 10, positives: int = 5,
                   id_col: str = "vec_id", vector_col: str = "embedding", block: int = 32768,
                   chunk: int = 4096) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score (ids and scores long, rank int).

    Components count times 256, rounded down, and a score is the inner product with the anchor. An anchor's positives
    are its ``positives`` best other rows of its label; its negatives, for each positive, the ``k`` best rows of other
    labels whose score is 30 to 90 % of the positive's, ranked from 1. Ties go to the smaller id. Where fewer rows
    qualify, all are returned; an anchor without positives, or whose positive has a negative score, gives none.

    Rows without id, label or vector, or with a missing or non-finite component, take no part, nor do those with over
    1,024 components or one of 16,384 or more in size, whose scores might leave 64 bits. Shorter vectors end in zeros.
    Rows alike in id, label and vector are one; rows that share an id are no candidates of each other's as positives.
    An empty table gives none; other columns are ignored whatever their names.

    Rows lie in blocks of about ``block``, anchors in chunks of about ``chunk``; each pair of them is one group of a
    shuffle, so no task holds more, whatever a label's share, and heaps leave a task with k rows for each owner.
    """
    vector = F.col("vector")
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) * 256 >= MOST_COMPONENT))
    rows = materialize(vectors.select(
        ref(id_col).cast("long").alias("vec_id"), label.cast("long").alias("label"), ref(vector_col).alias("vector"),
        F.coalesce(is_anchor, F.lit(False)).alias("is_anchor"))
        .where("vec_id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL").where(
            ~F.coalesce(bad, F.lit(True)) & (F.size(vector) <= MOST_DIMS)).distinct())
    n, n_anchors, dims = rows.agg(F.count("*"), F.count_if("is_anchor"), F.max(F.size("vector"))).first()
    blocks, chunks, dims = max(1, -(-n // block)), max(1, -(-n_anchors // chunk)), max(1, dims or 1)
    spread = F.xxhash64("vec_id", "label", "vector")
    left = rows.select("vec_id", "label", "vector", F.pmod(spread, F.lit(blocks)).alias("block"),
                       F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"))

    def groups(anchors: DataFrame):
        placed = anchors.withColumn("chunk", F.pmod(F.xxhash64("own_id", F.lit(1)), F.lit(chunks)).cast("int")).withColumn(
            "block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
        return left.groupBy("block", "chunk").cogroup(placed.groupBy("block", "chunk"))

    def best(found: DataFrame, by: list[str], score: str, other: str, most: int) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score), other))
        return found.withColumn("rank", rank).where(F.col("rank") <= most)

    anchors = rows.where("is_anchor").toDF("own_id", "own_label", "own_vector", "is_anchor").drop("is_anchor")
    near = best(groups(anchors).applyInArrow(_positives(dims, positives),
                                             "anchor_id long, positive_id long, positive_score long"),
                ["anchor_id"], "positive_score", "positive_id", positives)
    lists = materialize(near.groupBy("anchor_id").agg(
        F.collect_list(F.struct("positive_id", "positive_score")).alias("positives")))
    ready = anchors.join(lists, F.col("own_id") == F.col("anchor_id")).drop("anchor_id")
    found = groups(ready).applyInArrow(
        _negatives(dims, k), "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long")
    return best(found, ["anchor_id", "positive_id"], "negative_score", "negative_id", k).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
