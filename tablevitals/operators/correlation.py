"""Pearson correlation of all numeric column pairs, each over the rows where both are present."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablevitals.functions.columns import as_double, chunks, finite_double, numeric_columns, union_all
from tablevitals.operators.moments import centers

#: Pairs above this absolute correlation are reported (fixed value).
HIGH_CORRELATION = 0.8

#: Columns of a tile.
TILE = 512

PAIR_SUMS = "i int, j int, n double, si double, sj double, sii double, sjj double, sij double"


def correlation_pairs(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row per pair i < j in column order: feature1, feature2, correlation.

    NULL where a column is constant over the shared rows. Infinite cells count as missing.
    """
    columns = list(columns if columns is not None else numeric_columns(df))
    if len(columns) < 2:
        return df.sparkSession.createDataFrame([], "feature1 string, feature2 string, correlation double")
    sums = pair_sums(df, columns)
    n = F.col("n")
    cross = F.col("sij") - F.try_divide(F.col("si") * F.col("sj"), n)
    var_i = F.col("sii") - F.try_divide(F.col("si") * F.col("si"), n)
    var_j = F.col("sjj") - F.try_divide(F.col("sj") * F.col("sj"), n)
    # What rounding leaves of a zero variance lies far below the sums it came from.
    varies = (var_i > 1e-14 * F.col("sii")) & (var_j > 1e-14 * F.col("sjj"))
    names = F.array(*[F.lit(c) for c in columns])
    return sums.select(
        F.get(names, F.col("i")).alias("feature1"), F.get(names, F.col("j")).alias("feature2"),
        correlation_of(cross, var_i, var_j, varies).alias("correlation"))


def correlation_of(cross: Column, var_i: Column, var_j: Column, varies: Column) -> Column:
    """The coefficient from centred sums, NULL where one of both doesn't vary."""
    r = F.when(varies, F.try_divide(cross, F.sqrt(var_i) * F.sqrt(var_j)))
    # Rounding may leave the unit range; greatest and least would turn a NULL into a bound.
    return F.when(r.isNotNull() & ~F.isnan(r), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)))


def pair_sums(df: DataFrame, columns: Sequence[str], means: Sequence[float] | None = None) -> DataFrame:
    """One row per pair of columns, see ``PAIR_SUMS``: sums over the rows where both are present.

    Deviations from the column means keep the sums of products free of cancellation; ``means`` (or numbers near them)
    spare the scan that finds them. Columns go in tiles. Each pair of tiles is one scan of their columns, and a task
    of it holds and hands in the products of ``TILE`` x ``TILE`` columns at most, however many there are.
    """
    tiles = [range(at, min(at + TILE, len(columns))) for at in range(0, len(columns), TILE)]
    if means is None and len(tiles) > 1:  # one number per column, found once for all tiles
        means = []
        for group in chunks(columns, 100):
            found = df.agg(*[F.coalesce(F.avg(finite_double(df, c)), F.lit(0.0)).alias(f"c{i}") for i, c in enumerate(group)])
            means += list(found.first())
    return union_all([_tile_sums(df, columns, means, tiles[p], tiles[q])
                      for p in range(len(tiles)) for q in range(p, len(tiles))])


def _tile_sums(df: DataFrame, columns: Sequence[str], means: Sequence[float] | None, first: range, second: range) -> DataFrame:
    places = sorted({*first, *second})
    names = [columns[k] for k in places]
    own, other = len(first), len(second)
    if means is None:
        data = df.select(*[finite_double(df, c).alias(f"x{i}") for i, c in enumerate(names)], centers(df, names, finite_double).alias("center"))
        data = data.select([(F.col(f"x{i}") - F.col(f"center.c{i}")).alias(f"d{i}") for i in range(len(names))])
        near = np.zeros(len(names))
    else:
        data = df.select([as_double(df, c).alias(f"d{i}") for i, c in enumerate(names)])
        near = np.array([float(means[k]) for k in places])

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, si, sj, sii, sjj, sij = sums = [np.zeros((own, other)) for _ in range(6)]
        for batch in batches:
            every = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns])
            every = np.where(np.isfinite(every), every, np.nan) - near
            x, y = every[:, :own], every[:, -other:]
            in_x, in_y = (~np.isnan(x)).astype(float), (~np.isnan(y)).astype(float)
            x, y = np.nan_to_num(x), np.nan_to_num(y)
            n += in_x.T @ in_y
            si += x.T @ in_y
            sj += in_x.T @ y
            sii += (x * x).T @ in_y
            sjj += in_x.T @ (y * y)
            sij += x.T @ y
        i, j = np.triu_indices(own, 1) if first == second else map(np.ravel, np.indices((own, other)))
        for at in range(0, len(i), 50_000):
            a, b = i[at:at + 50_000], j[at:at + 50_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array(a + first.start, pa.int32()), pa.array(b + second.start, pa.int32()), *[pa.array(m[a, b]) for m in sums]],
                names=["i", "j", "n", "si", "sj", "sii", "sjj", "sij"])

    parts = data.mapInArrow(products, PAIR_SUMS)
    return parts.groupBy("i", "j").agg(*[F.sum(s).alias(s) for s in ("n", "si", "sj", "sii", "sjj", "sij")])


def correlation_matrix(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """The full symmetric matrix in long form: feature1, feature2, correlation.

    A column's correlation with itself is 1, or NULL when it is constant or has under two values.
    """
    columns = list(columns if columns is not None else numeric_columns(df))
    pairs = correlation_pairs(df, columns)
    if len(columns) < 2:
        return pairs
    spread = df.agg(*[F.struct(F.min(finite_double(df, c)).alias("lo"), F.max(finite_double(df, c)).alias("hi")).alias(f"e{i}")
                      for i, c in enumerate(columns)])
    own = spread.select(F.inline(F.array(*[F.struct(
        F.lit(c).alias("feature1"), F.lit(c).alias("feature2"),
        F.when(F.col(f"e{i}.lo") < F.col(f"e{i}.hi"), F.lit(1.0)).alias("correlation"))
        for i, c in enumerate(columns)])))
    both = pairs.select(F.explode(F.array(
        F.struct("feature1", "feature2", "correlation"),
        F.struct(F.col("feature2").alias("feature1"), F.col("feature1").alias("feature2"), "correlation"),
    )).alias("p")).select("p.*")
    return both.unionByName(own)


def high_correlations(df: DataFrame, columns: Sequence[str] | None = None,
                      threshold: float = HIGH_CORRELATION) -> DataFrame:
    """Pairs with an absolute correlation strictly above the threshold."""
    return correlation_pairs(df, columns).filter(F.abs("correlation") > threshold)
