"""Interquartile-range outliers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablevitals.functions.columns import as_double, chunks, col, finite_double, numeric_columns, union_all
from tablevitals.operators.quantiles import quantile_values

#: Fences lie this many interquartile ranges outside the quartiles (fixed value).
IQR_MULTIPLIER = 1.5

#: A z-score beyond this marks an outlier (fixed value).
ZSCORE_LIMIT = 3.0

COLUMNS_PER_AGGREGATE = 30


def iqr_fences(df: DataFrame, columns: Sequence[str] | None = None, multiplier: float = IQR_MULTIPLIER,
               method: str = "exact") -> dict[str, tuple[float | None, float | None]]:
    """Lower and upper fence per numeric column."""
    quartiles = quantile_values(df, [0.25, 0.75], columns, method)
    return {name: fences_of(q1, q3, multiplier) for name, (q1, q3) in quartiles.items()}


def fences_of(q1: float | None, q3: float | None,
              multiplier: float = IQR_MULTIPLIER) -> tuple[float | None, float | None]:
    if q1 is None:
        return None, None
    return q1 - multiplier * (q3 - q1), q3 + multiplier * (q3 - q1)


def iqr_outliers(df: DataFrame, columns: Sequence[str] | None = None, multiplier: float = IQR_MULTIPLIER,
                 method: str = "exact", fences: dict | None = None) -> DataFrame:
    """One row per numeric column: n_rows, lower, upper, outliers (strictly outside the fences).

    ``fences`` takes ends that are known already, which saves the search for the quartiles.
    """
    columns = list(columns if columns is not None else numeric_columns(df))
    schema = "column string, n_rows long, lower double, upper double, outliers long"
    if not columns:
        return df.sparkSession.createDataFrame([], schema)
    fences = iqr_fences(df, columns, multiplier, method) if fences is None else fences
    parts = []
    for group in chunks(columns, COLUMNS_PER_AGGREGATE):
        counts = []
        for i, c in enumerate(group):
            lower, upper = (F.lit(x).cast("double") for x in fences[c])
            x = as_double(df, c)
            counts.append(F.count(F.when((x < lower) | (x > upper), 1)).alias(f"o{i}"))
        counted = df.agg(F.count(F.lit(1)).alias("n_rows"), *counts)
        rows = [F.struct(F.lit(c).alias("column"), F.col("n_rows"),
                         F.lit(fences[c][0]).cast("double").alias("lower"),
                         F.lit(fences[c][1]).cast("double").alias("upper"),
                         F.col(f"o{i}").alias("outliers")) for i, c in enumerate(group)]
        parts.append(counted.select(F.inline(F.array(*rows))))
    return union_all(parts)


def zscore_outliers(df: DataFrame, columns: Sequence[str] | None = None, limit: float = ZSCORE_LIMIT) -> DataFrame:
    """One row per numeric column: n, mean, std (n-1), outliers (more than ``limit`` deviations off the mean).

    A constant column has none. Infinite cells are left out.
    """
    columns = list(columns if columns is not None else numeric_columns(df))
    parts = []
    for group in chunks(columns, COLUMNS_PER_AGGREGATE // 2):
        cells = [finite_double(df, c) for c in group]
        spread = df.agg(F.struct(*[f(x).alias(f"{f.__name__}{i}") for i, x in enumerate(cells)
                                   for f in (F.avg, F.stddev_samp)]).alias("s")).scalar()
        data = df.select(*[x.alias(f"x{i}") for i, x in enumerate(cells)], spread.alias("s"))
        far = [F.count_if(F.abs(F.col(f"x{i}") - F.col(f"s.avg{i}")) > limit * F.col(f"s.stddev_samp{i}")).alias(f"o{i}")
               for i in range(len(group))]
        counted = data.agg(F.any_value("s").alias("s"), *far, *[F.count(f"x{i}").alias(f"n{i}") for i in range(len(group))])
        rows = [F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("n"), F.col(f"s.avg{i}").alias("mean"),
                         F.col(f"s.stddev_samp{i}").alias("std"), F.col(f"o{i}").alias("outliers")) for i, c in enumerate(group)]
        parts.append(counted.select(F.inline(F.array(*rows))))
    if not parts:
        return df.sparkSession.createDataFrame([], "column string, n long, mean double, std double, outliers long")
    return union_all(parts)


def outlier_total(outliers: DataFrame) -> DataFrame:
    """One row over ``iqr_outliers``: total_outliers and the unrounded share of all numeric cells."""
    return outliers.agg(
        F.sum("outliers").alias("total_outliers"),
        (F.try_divide(F.sum("outliers"), F.sum("n_rows")) * 100).alias("outlier_share"),
    )


def iqr_keep_mask(df: DataFrame, columns: Sequence[str], keep: Sequence[str],
                  multiplier: float = IQR_MULTIPLIER) -> DataFrame:
    """``keep`` columns plus ``<column>_ok``: the value lies within the fences (ends included).

    A NULL value is not ok; it does not spoil the other rows.
    """
    fences = iqr_fences(df, columns, multiplier)
    masks = []
    for c in columns:
        lower, upper = (F.lit(x).cast("double") for x in fences[c])
        masks.append(F.coalesce(as_double(df, c).between(lower, upper), F.lit(False)).alias(f"{c}_ok"))
    return df.select(*[col(c) for c in keep], *masks)
