"""Reconstruction error of a linear autoencoder, which principal components give in closed form.

The components come from a matrix sketch of a few hundred rows: Frequent Directions, which merges, so every task
sketches its own rows and the sketches meet in a tree. Up to ``SKETCH_ROWS`` features it loses nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablevitals.config import AutoencoderParams
from tablevitals.functions.columns import chunks, zero_imputed
from tablevitals.operators.anomaly.forest import as_matrix

#: Rows of a sketch. With A for the table, B for the sketch, and what is left of A without its c strongest components,
#: no direction's energy in A'A and B'B differs by more than |A - A_c|^2 / (SKETCH_ROWS - c) for any c below.
SKETCH_ROWS = 512
#: Sketches that one task merges.
FAN_IN = 32


def feature_stats(df: DataFrame, columns: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Mean and population sd per feature (NULL as 0); sd 0 becomes 1."""
    means, deviations = [], []
    for group in chunks(columns, 15):
        row = df.agg(*[f(zero_imputed(df, c)).alias(f"{f.__name__}{i}")
                       for i, c in enumerate(group) for f in (F.avg, F.stddev_pop)]).first()
        means += [row[f"avg{i}"] for i in range(len(group))]
        deviations += [row[f"stddev_pop{i}"] for i in range(len(group))]
    sd = np.array(deviations, dtype=float)
    return np.array(means, dtype=float), np.where(sd == 0, 1.0, sd)


def standardized(df: DataFrame, columns: Sequence[str], mean: np.ndarray, sd: np.ndarray) -> list[Column]:
    return [(zero_imputed(df, c) - float(m)) / float(s) for c, m, s in zip(columns, mean, sd)]


def shrunk(rows: np.ndarray, most: int) -> np.ndarray:
    """``most`` rows at most with nearly the same products: the energy of the strongest one left out is taken from all."""
    k = rows.shape[1]
    if k <= most:  # the products themselves are no larger
        values, vectors = np.linalg.eigh(rows.T @ rows)
        return np.sqrt(np.maximum(values, 0.0))[:, None] * vectors.T
    if len(rows) <= most:
        return rows
    _, strength, axes = np.linalg.svd(rows, full_matrices=False)
    return np.sqrt(strength[:most] ** 2 - strength[most] ** 2)[:, None] * axes[:most]


def _sketcher(k: int, most: int, columns: Callable[[pa.RecordBatch], np.ndarray]) -> Callable:
    """Sketches all rows of a partition; gives rows of components, and no more of them than a sketch has."""
    step = max(4 * most, 4096) if k <= most else 2 * most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            rows = columns(batch)
            for at in range(0, len(rows), step):
                held.append(rows[at:at + step])
                if sum(map(len, held)) >= step:
                    held = [shrunk(np.concatenate(held), most)]
        if held:
            rows = shrunk(np.concatenate(held), most)
            rows = rows[np.abs(rows).max(axis=1) > 0]
            yield pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array(rows.ravel()), k).cast(
                pa.list_(pa.float64()))], names=["row"])
    return run


def sketch_of(data: DataFrame, most: int = SKETCH_ROWS) -> np.ndarray:
    """Frequent Directions of a table of doubles: ``most`` rows, or one per column if these are fewer.

    Partitions are sketched where they lie, and ``FAN_IN`` sketches at a time are merged; the driver gets the last.
    """
    k = len(data.columns)

    def stacked(batch: pa.RecordBatch) -> np.ndarray:
        return np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])

    def listed(batch: pa.RecordBatch) -> np.ndarray:
        return batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, k)

    parts = data.rdd.getNumPartitions()
    sketches = data.mapInArrow(_sketcher(k, most, stacked), "row array<double>")
    while parts > 1:
        parts = -(-parts // FAN_IN)
        sketches = sketches.repartition(parts).mapInArrow(_sketcher(k, most, listed), "row array<double>")
    found = sketches.toArrow()["row"].combine_chunks()
    return found.flatten().to_numpy(zero_copy_only=False).reshape(-1, k)


def fit_pca(df: DataFrame, columns: Sequence[str], params: AutoencoderParams = AutoencoderParams()) -> dict:
    """Fit; returns mean, sd and the directions that are kept (``axes``, one column each).

    ``params.encoding_dim`` directions are kept, but half of them at most: keeping all would reproduce every row.
    """
    mean, sd = feature_stats(df, columns)
    data = df.select([z.alias(f"z{i}") for i, z in enumerate(standardized(df, columns, mean, sd))])
    kept = min(params.encoding_dim, len(columns) // 2)
    axes = np.zeros((len(columns), kept))
    found = np.linalg.svd(sketch_of(data), full_matrices=False)[2][:kept].T
    axes[:, :found.shape[1]] = found
    return {"mean": mean, "sd": sd, "axes": axes, "n_components": kept}


def pca_error(df: DataFrame, columns: Sequence[str], model: dict) -> Column:
    """Mean squared reconstruction error per row: what its projection on the kept directions leaves."""
    z = standardized(df, columns, model["mean"], model["sd"])
    axes, k = model["axes"], len(columns)

    @F.pandas_udf("double")
    def error(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for batch in batches:
            rows = as_matrix(batch)
            left = rows - (rows @ axes) @ axes.T
            yield pd.Series((left * left).sum(axis=1) / k)

    return error(*z)
