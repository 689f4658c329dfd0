"""Facts about a loaded dataset, and its first rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablevitals.functions.columns import col
from tablevitals.functions.scalars import round_exact
from tablevitals.sources.readers import Dataset, list_files


def table_metadata(df: DataFrame) -> DataFrame:
    """One row per column: position, column, type, with n_samples and n_features on each."""
    rows = [F.struct(F.lit(i).alias("position"), F.lit(f.name).alias("column"),
                     F.lit(f.dataType.simpleString()).alias("type")) for i, f in enumerate(df.schema.fields)]
    counted = df.agg(F.count(F.lit(1)).alias("n_samples"))
    return counted.select("n_samples", F.lit(len(rows)).alias("n_features"), F.inline(F.array(*rows)))


def label_metadata(df: DataFrame, label: str) -> DataFrame:
    """One row: n_samples, n_classes (distinct labels; ``label_values`` lists them as rows)."""
    return df.agg(F.count(F.lit(1)).alias("n_samples"), F.count_distinct(col(label)).alias("n_classes"))


def files_size(spark: SparkSession, path: str) -> DataFrame:
    """One row: n_files, file_size_mb of all files below the path."""
    return list_files(spark, path).agg(
        F.count(F.lit(1)).alias("n_files"), round_exact(F.sum("bytes") / float(1024 ** 2), 2).alias("file_size_mb"))


def dataset_metadata(dataset: Dataset) -> DataFrame:
    """One row: file_path, file_name, dataset_type, file_size_mb, n_samples, n_features, columns,
    dtypes, n_classes (texts and images only)."""
    df = dataset.data
    size = files_size(df.sparkSession, dataset.path).select("file_size_mb").scalar()
    labelled = dataset.kind != "tabular" and "label" in df.columns
    classes = F.count_distinct("label") if labelled else F.lit(None).cast("long")
    dtypes = [F.lit(x) for f in df.schema.fields for x in (f.name, f.dataType.simpleString())]
    return df.agg(F.count(F.lit(1)).alias("n_samples"), classes.alias("n_classes")).select(
        F.lit(dataset.path).alias("file_path"),
        F.lit(dataset.path.rstrip("/").rsplit("/", 1)[-1]).alias("file_name"),
        F.lit(dataset.kind).alias("dataset_type"),
        size.alias("file_size_mb"),
        "n_samples",
        F.lit(len(df.columns)).alias("n_features"),
        F.array(*[F.lit(c) for c in df.columns]).alias("columns"),
        F.create_map(*dtypes).alias("dtypes"),
        "n_classes",
    )


def preview(df: DataFrame, n: int = 5, key: Sequence[str] = ()) -> DataFrame:
    """The first ``n`` rows, in ``key`` order if given."""
    return df.orderBy(*[col(k) for k in key]).limit(n) if key else df.limit(n)
