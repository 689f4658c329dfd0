"""Feature columns as the detectors see them: imputed and scaled."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablevitals.functions.columns import col, zero_imputed


def impute_zero(df: DataFrame, columns: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """``keep`` columns plus the feature columns with NULL and NaN as 0 and +-inf clamped."""
    return df.select(*[col(c) for c in keep], *[zero_imputed(df, c).alias(c) for c in columns])


def standard_scale(df: DataFrame, columns: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """(x - mean) / population sd, NULL counted as 0 beforehand; sd 0 divides by 1."""
    stats = []
    for i, c in enumerate(columns):
        x = zero_imputed(df, c)
        stats += [F.avg(x).alias(f"mean{i}"), F.stddev_pop(x).alias(f"sd{i}")]
    fitted = df.agg(F.struct(*stats).alias("fitted")).scalar()
    names = [f"k{i}" for i in range(len(keep))]
    data = df.select(*[col(c).alias(n) for c, n in zip(keep, names)],
                     *[zero_imputed(df, c).alias(f"x{i}") for i, c in enumerate(columns)], fitted.alias("fitted"))
    scaled = []
    for i, c in enumerate(columns):
        sd = F.when(F.col(f"fitted.sd{i}") == 0, F.lit(1.0)).otherwise(F.col(f"fitted.sd{i}"))
        scaled.append(((F.col(f"x{i}") - F.col(f"fitted.mean{i}")) / sd).alias(c))
    return data.select(*[F.col(n).alias(c) for n, c in zip(names, keep)], *scaled)
