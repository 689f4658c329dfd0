"""Moments of numeric columns."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablevitals.functions.columns import as_double, chunks, numeric_columns, union_all

#: Columns per aggregate: eight buffer fields each stay below Spark's limit of 100 for code generation,
#: and the generated methods below the 8000 bytes that the JVM compiles.
COLUMNS_PER_AGGREGATE = 9

#: A second central moment below this is rounding noise of a constant column (fixed value).
ZERO_MOMENT = 1e-14


def centers(df: DataFrame, columns: Sequence[str], value: Callable[[DataFrame, str], Column] = as_double) -> Column:
    """The column means as one struct, computed by a scalar subquery of the using query."""
    means = [F.coalesce(F.avg(value(df, c)), F.lit(0.0)).alias(f"c{i}") for i, c in enumerate(columns)]
    return df.agg(F.struct(*means).alias("centers")).scalar()


def numeric_moments(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row per numeric column: n, mean, std (n-1), min, max, skewness, kurtosis (bias-corrected)."""
    columns = list(columns if columns is not None else numeric_columns(df))
    if not columns:
        return df.sparkSession.createDataFrame(
            [], "column string, n long, mean double, std double, min double, max double, "
                "skewness double, kurtosis double")
    return shape(central_sums(df, columns))


def central_sums(df: DataFrame, columns: Sequence[str], means: Sequence[float] | None = None) -> DataFrame:
    """One row per column: column, n, mean, min, max and m2 to m4, the sums of powers of deviations from the mean.

    Power sums around the mean are plain sums: cheaper per value than Spark's moment aggregates,
    one of which each of std, skewness and kurtosis would need, and as exact as the two-pass method. ``means`` (or
    numbers near them), where they are known, spare the scan that finds them.
    """
    parts = []
    places = {c: i for i, c in enumerate(columns)}
    for group in chunks(columns, COLUMNS_PER_AGGREGATE):
        # The subquery's struct becomes one column, so that it is planned once, not once per use.
        near = centers(df, group) if means is None else F.struct(
            *[F.lit(float(means[places[c]])).alias(f"c{i}") for i, c in enumerate(group)])
        data = df.select(*[as_double(df, c).alias(f"x{i}") for i, c in enumerate(group)], near.alias("center"))
        data = data.selectExpr("*", *[f"x{i} - center.c{i} AS d{i}" for i in range(len(group))])
        powers = {"s1": "d{i}", "s2": "d{i} * d{i}", "s3": "d{i} * d{i} * d{i}", "s4": "d{i} * d{i} * d{i} * d{i}"}
        sums = data.selectExpr(*[text for i in range(len(group)) for text in (
            f"count(x{i}) AS n{i}", f"avg(x{i}) AS mean{i}", f"min(x{i}) AS min{i}", f"max(x{i}) AS max{i}",
            *[f"sum({term.format(i=i)}) AS {name}_{i}" for name, term in powers.items()])])
        rows = [F.struct(F.lit(c).alias("column"), F.expr(
            f"struct(n{i} AS n, mean{i} AS mean, min{i} AS min, max{i} AS max, s1_{i} AS s1, s2_{i} AS s2, "
            f"s3_{i} AS s3, s4_{i} AS s4)").alias("sums")) for i, c in enumerate(group)]
        parts.append(sums.select(F.inline(F.array(*rows))).select("column", "sums.*"))
    n = F.col("n").cast("double")
    shift = F.try_divide(F.col("s1"), n)
    m2 = F.col("s2") - n * shift * shift
    m3 = F.col("s3") - 3 * shift * F.col("s2") + 2 * n * shift * shift * shift
    m4 = (F.col("s4") - 4 * shift * F.col("s3") + 6 * shift * shift * F.col("s2")
          - 3 * n * shift * shift * shift * shift)
    return union_all(parts).select("column", "n", "mean", "min", "max", m2.alias("m2"), m3.alias("m3"), m4.alias("m4"))


def shape(sums: DataFrame) -> DataFrame:
    """Sample statistics from ``central_sums``."""
    n = F.col("n").cast("double")
    flat = F.col("m2") < ZERO_MOMENT
    variance = F.try_divide(F.col("m2"), n)
    g1 = F.try_divide(F.try_divide(F.col("m3"), n), variance * F.sqrt(variance))
    g2 = F.try_divide(F.try_divide(F.col("m4"), n), variance * variance) - 3
    skewness = F.try_divide(g1 * F.sqrt(n * (n - 1)), n - 2)
    kurtosis = F.try_divide((n - 1) * ((n + 1) * g2 + 6), (n - 2) * (n - 3))
    return sums.select(
        "column", "n", "mean",
        F.when(n >= 2, F.sqrt(F.greatest(F.try_divide(F.col("m2"), n - 1), F.lit(0.0)))).alias("std"),
        "min", "max",
        F.when(n >= 3, F.when(flat, F.lit(0.0)).otherwise(skewness)).alias("skewness"),
        F.when(n >= 4, F.when(flat, F.lit(0.0)).otherwise(kurtosis)).alias("kurtosis"),
    )
