"""Isolation forest (Liu, Ting, Zhou 2008).

A tree needs a few hundred rows, so fitting is a sampling job: Spark draws the rows of every tree in
one scan, one small group per tree is built in a Python worker, and the finished trees (their number
and size are parameters, not data) go to all tasks for scoring.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablevitals.config import ForestParams
from tablevitals.functions.columns import clean, zero_imputed

#: Trees x nodes that may be sent to every task: 16 bytes each, so 128 MB.
MAX_NODES = 8_000_000

#: Candidates drawn per tree, as a multiple of the sample size; too few are then out of the question.
OVERDRAW = 2

#: Rows scored at a time, so that the working arrays stay in the CPU cache.
ROWS_PER_STEP = 4096

TREE_SCHEMA = "tree int, feature array<int>, threshold array<double>, path array<double>"


def expected_path(size: float) -> float:
    """Average depth of an unsuccessful search in a binary tree of ``size`` points."""
    if size <= 1:
        return 0.0
    if size == 2:
        return 1.0
    return 2.0 * (math.log(size - 1.0) + 0.5772156649015329) - 2.0 * (size - 1.0) / size


def draw_samples(df: DataFrame, columns: Sequence[str], params: ForestParams, n_rows: int,
                 key: Sequence[str] = ()) -> DataFrame:
    """The rows of all trees: tree, f0..fk.

    The draw depends on the key and the features of a row alone, whatever the partitioning. Without a key that
    identifies rows, those with the same features are counted first and draw by their number. Rows serve as many
    trees as their share of the draw asks for, rounded up or down at random: none or one in a large table, all
    of them where a tree needs every row.
    """
    psi, trees = min(params.max_samples, n_rows), params.n_estimators
    names = [f"f{i}" for i in range(len(columns))]
    rows = df.select(*[zero_imputed(df, c).alias(f) for f, c in zip(names, columns)],
                     F.xxhash64(F.lit(params.random_state), *[clean(df, k) for k in key]).alias("of_key"))
    rows = (rows.withColumn("copies", F.lit(1)) if key
            else rows.groupBy(*names, "of_key").agg(F.count(F.lit(1)).alias("copies")))
    rows = rows.withColumn("draw", F.xxhash64("of_key", *names))
    share = min(1.0, OVERDRAW * psi / n_rows + 64.0 / n_rows)  # of the rows, per tree
    serves = F.floor(F.col("copies") * (trees * share) + _uniform(F.xxhash64("draw", F.lit(0)))).cast("int")
    # Steps that share no factor with the number of trees meet every tree before any one twice.
    steps = [s for s in range(1, trees + 1) if math.gcd(s, trees) == 1]
    step = F.get(F.array(*[F.lit(s) for s in steps]), F.pmod(F.xxhash64("draw", F.lit(1)), F.lit(len(steps))).cast("int"))
    first = F.pmod(F.xxhash64("draw", F.lit(2)), F.lit(trees)).cast("int")
    rows = rows.withColumn("serves", serves).filter("serves > 0").withColumns({"step": step, "first": first})
    # All trees together draw n_estimators x (2 x max_samples + 64) rows or so, whatever the table's size.
    drawn = rows.withColumn("k", F.explode(F.expr("sequence(0, serves - 1)"))).withColumn(
        "tree", F.expr(f"CAST((first + CAST(k AS BIGINT) * step) % {trees} AS INT)"))
    order = F.xxhash64("draw", "tree", "k")
    rank = F.row_number().over(Window.partitionBy("tree").orderBy(order, *names))
    return drawn.withColumn("rank", rank).filter(F.col("rank") <= psi).select("tree", "rank", *names)


def _uniform(hashed: Column) -> Column:
    """[0, 1) from the upper 53 bits of a hash."""
    return F.shiftrightunsigned(hashed, 11) / F.lit(float(2 ** 53))


def grow_tree(x: np.ndarray, depth: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One tree as a complete binary tree in level order.

    Inner node i has children 2i+1 and 2i+2 and sends values below its threshold left. A node that
    stops early keeps an infinite threshold, so its rows fall through the left to the bottom level,
    whose ``path`` entry holds the path length of the leaf.
    """
    feature = np.zeros(2 ** depth - 1, dtype=np.int32)
    threshold = np.full(2 ** depth - 1, np.inf)
    path = np.zeros(2 ** depth)
    stack = [(0, 0, np.arange(len(x)))]
    while stack:
        node, level, rows = stack.pop()
        part = x[rows]
        low, high = part.min(axis=0), part.max(axis=0)
        usable = np.flatnonzero(low < high)
        if level == depth or len(rows) <= 1 or len(usable) == 0:
            bottom = node
            for _ in range(depth - level):
                bottom = 2 * bottom + 1
            path[bottom - (2 ** depth - 1)] = level + expected_path(len(rows))
            continue
        chosen = usable[rng.integers(len(usable))]
        cut = low[chosen] + rng.random() * (high[chosen] - low[chosen])
        if not low[chosen] < cut <= high[chosen]:
            cut = high[chosen]
        feature[node], threshold[node] = chosen, cut
        left = part[:, chosen] < cut
        stack.append((2 * node + 1, level + 1, rows[left]))
        stack.append((2 * node + 2, level + 1, rows[~left]))
    return feature, threshold, path


def fit_forest(df: DataFrame, columns: Sequence[str], params: ForestParams = ForestParams(),
               key: Sequence[str] = (), n_rows: int | None = None) -> dict:
    """Fit the forest; returns plain arrays: feature, threshold, path (one row per tree) and scale."""
    n_rows = df.count() if n_rows is None else n_rows
    if n_rows == 0:
        raise ValueError("no rows to fit")
    psi = min(params.max_samples, n_rows)
    depth = max(1, math.ceil(math.log2(max(psi, 2))))
    if params.n_estimators * 2 ** (depth + 1) > MAX_NODES:
        raise ValueError(f"n_estimators x max_samples asks for more than {MAX_NODES} nodes")
    seed, names = params.random_state, [f"f{i}" for i in range(len(columns))]

    def build(group: pd.DataFrame) -> pd.DataFrame:
        tree = int(group["tree"].iloc[0])
        x = group.sort_values("rank")[names].to_numpy(dtype=float)
        parts = grow_tree(x, depth, np.random.default_rng([seed, tree]))
        return pd.DataFrame({"tree": [tree], "feature": [parts[0]], "threshold": [parts[1]], "path": [parts[2]]})

    samples = draw_samples(df, columns, params, n_rows, key)
    # A fixed partition count: adaptive execution would merge these small groups into one task.
    tasks = min(params.n_estimators, df.sparkSession.sparkContext.defaultParallelism)
    grown = samples.repartition(tasks, "tree").groupBy("tree").applyInPandas(build, TREE_SCHEMA)
    trees = sorted(grown.collect(), key=lambda t: t["tree"])
    return {
        "feature": np.array([t["feature"] for t in trees], dtype=np.int64),
        "threshold": np.array([t["threshold"] for t in trees]),
        "path": np.array([t["path"] for t in trees]),
        "depth": depth,
        "scale": expected_path(psi) or 1.0,
    }


def forest_scores(x: np.ndarray, forest: dict) -> np.ndarray:
    """2 ** (-mean path / expected path) per row: close to 1 isolates fast, below 0.5 is ordinary."""
    n, k = x.shape
    out = np.empty(n)
    bottom = 2 ** forest["depth"] - 1
    for start in range(0, n, ROWS_PER_STEP):
        block = np.ascontiguousarray(x[start:start + ROWS_PER_STEP])
        flat, first = block.ravel(), np.arange(len(block)) * k
        total = np.zeros(len(block))
        for feature, threshold, path in zip(forest["feature"], forest["threshold"], forest["path"]):
            node = np.zeros(len(block), dtype=np.int64)
            for _ in range(forest["depth"]):
                right = flat.take(first + feature.take(node)) >= threshold.take(node)
                node += node + 1
                node += right
            total += path.take(node - bottom)
        out[start:start + ROWS_PER_STEP] = total
    return np.exp2(-out / len(forest["path"]) / forest["scale"])


def as_matrix(batch: tuple[pd.Series, ...] | pd.Series) -> np.ndarray:
    """Rows x features of a UDF batch; Spark hands over a bare Series where there is one feature."""
    return np.column_stack([s.to_numpy(dtype=float) for s in (batch if isinstance(batch, tuple) else (batch,))])


def forest_score(df: DataFrame, columns: Sequence[str], forest: dict) -> Column:
    """The anomaly score as a Column; only the feature columns travel to the Python workers."""
    model = df.sparkSession.sparkContext.broadcast(forest)

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(forest_scores(as_matrix(batch), model.value))

    return score(*[zero_imputed(df, c) for c in columns])
