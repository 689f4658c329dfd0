"""Class balance of a label column and low-cardinality columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablevitals.functions.columns import (chunks, clean, col, pick_target, string_columns, union_all)

#: A label column has fewer distinct values than this (fixed value).
MAX_CLASSES = 20

#: A distinct-count sketch above this proves at least MAX_CLASSES distinct values: 19 values fill at
#: most 19 of the sketch's 512 registers, which it reads as 19 or 20 by linear counting.
SKETCH_LIMIT = 64


def class_distribution(df: DataFrame, target: str | None = None) -> DataFrame:
    """Row count per non-null label value, most frequent first: label, count."""
    target = target or pick_target(df)
    return (
        df.select(clean(df, target).alias("label")).filter("label IS NOT NULL")
        .groupBy("label").agg(F.count(F.lit(1)).alias("count"))
        .orderBy(F.desc("count"), "label")
    )


def class_balance(df: DataFrame, target: str | None = None) -> DataFrame:
    """One row: target, n_classes, max_count, min_count, imbalance_ratio.

    A column with 20 or more values, or none, is no label: everything but ``target`` is NULL then.
    Such a column may have as many values as the table has rows, so a sketch (one pass, no shuffle
    of values) decides first whether the rows go into the count at all.
    """
    target = target or pick_target(df)
    values = df.select(clean(df, target).alias("label")).filter("label IS NOT NULL")
    sketch = values.agg(F.approx_count_distinct("label").alias("n")).scalar()
    counts = values.filter(sketch <= SKETCH_LIMIT).groupBy("label").agg(F.count(F.lit(1)).alias("count"))
    totals = counts.agg(
        F.count(F.lit(1)).alias("n_classes"), F.max("count").alias("max_count"), F.min("count").alias("min_count"))
    is_label = (F.col("n_classes") > 0) & (F.col("n_classes") < MAX_CLASSES)
    return totals.select(
        F.lit(target).alias("target"),
        *[F.when(is_label, F.col(c)).alias(c) for c in ["n_classes", "max_count", "min_count"]],
        F.when(is_label, F.try_divide("max_count", "min_count")).alias("imbalance_ratio"),
    )


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Balanced weights n / (k * count) per label value: label, count, weight."""
    counts = (
        df.select(clean(df, label).alias("label")).filter("label IS NOT NULL")
        .groupBy("label").agg(F.count(F.lit(1)).alias("count"))
    )
    totals = counts.agg(F.struct(F.sum("count").alias("n"), F.count(F.lit(1)).alias("k")).alias("t")).scalar()
    return counts.withColumn("weight", totals["n"] / (totals["k"] * F.col("count").cast("double")))


def categorical_columns(df: DataFrame, threshold: int = 10) -> DataFrame:
    """String columns, and columns with at most ``threshold`` distinct values: column, n_distinct.

    One sketch pass rules out the columns with clearly more values; the exact count then runs over
    few distinct values only, which Spark collapses inside the map tasks. ``n_distinct`` is NULL for
    string columns, which need no count.
    """
    texts = string_columns(df)
    others = [c for c in df.columns if c not in texts]
    small = []
    for group in chunks(others, 40):
        sketch = df.agg(*[F.approx_count_distinct(clean(df, c)).alias(f"n{i}") for i, c in enumerate(group)]).first()
        # A sketch of few values is nearly exact; four times the threshold is far beyond its error.
        small += [c for i, c in enumerate(group) if sketch[i] <= max(SKETCH_LIMIT, 4 * threshold)]
    parts = []
    if texts:
        rows = [(df.columns.index(c), c, None) for c in texts]
        parts.append(df.sparkSession.createDataFrame(rows, "position int, column string, n_distinct long"))
    for group in chunks(small, 10):
        # The sketch leaves columns of few values, so that a set per column stays small.
        counted = df.agg(*[F.size(F.collect_set(clean(df, c))).cast("long").alias(f"n{i}") for i, c in enumerate(group)])
        rows = [F.struct(F.lit(df.columns.index(c)).alias("position"), F.lit(c).alias("column"),
                         F.col(f"n{i}").alias("n_distinct")) for i, c in enumerate(group)]
        parts.append(counted.select(F.inline(F.array(*rows))).filter(F.col("n_distinct") <= threshold))
    if not parts:
        return df.sparkSession.createDataFrame([], "position int, column string, n_distinct long")
    return union_all(parts).orderBy("position")


def label_values(df: DataFrame, label: str) -> DataFrame:
    """The distinct labels as rows, so any number of them stays distributed: label, count."""
    return df.groupBy(col(label).alias("label")).agg(F.count(F.lit(1)).alias("count"))
