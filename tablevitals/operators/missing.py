"""Missing cells, basic table facts and logical size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablevitals.functions.columns import chunks, clean, col, finite_double, union_all
from tablevitals.functions.scalars import percentage, round_exact

#: One aggregate keeps at most this many counters, so that it stays in whole-stage code generation
#: and its methods below the 8000 bytes that the JVM compiles.
COUNTERS_PER_AGGREGATE = 60

#: Bytes of one value of the fixed-width types (fixed values).
TYPE_WIDTHS = {
    "boolean": 1,
    "tinyint": 1,
    "smallint": 2,
    "int": 4,
    "bigint": 8,
    "float": 4,
    "double": 8,
    "date": 4,
    "timestamp": 8,
    "timestamp_ntz": 8,
}


def basic_info(df: DataFrame) -> DataFrame:
    """One row: n_rows, n_columns, column_names."""
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.lit(len(df.columns)).alias("n_columns"),
        F.lit(",".join(df.columns)).alias("column_names"),
    )


def missing_counts(df: DataFrame) -> DataFrame:
    """One row per column: column, n_rows, missing. Zero rows give missing 0."""
    parts = []
    for group in chunks(df.columns, COUNTERS_PER_AGGREGATE):
        counted = df.agg(
            F.count(F.lit(1)).alias("n_rows"),
            *[F.count(clean(df, c)).alias(f"present_{i}") for i, c in enumerate(group)],
        )
        rows = [F.struct(F.lit(c).alias("column"), F.col("n_rows"),
                         (F.col("n_rows") - F.col(f"present_{i}")).alias("missing")) for i, c in enumerate(group)]
        parts.append(counted.select(F.inline(F.array(*rows))))
    return union_all(parts)


def missing_by_column(df: DataFrame) -> DataFrame:
    """Columns that miss values, worst first: column, missing, missing_pct."""
    return (
        missing_counts(df)
        .filter("missing > 0")
        .select("column", "missing", percentage(F.col("missing"), F.col("n_rows")).alias("missing_pct"))
        .orderBy(F.desc("missing_pct"), "column")
    )


def missing_total(df: DataFrame) -> DataFrame:
    """One row: n_rows, n_columns, total_missing, missing_percentage (NULL for an empty table)."""
    return missing_counts(df).agg(
        F.max("n_rows").alias("n_rows"),
        F.count(F.lit(1)).cast("int").alias("n_columns"),
        F.sum("missing").alias("total_missing"),
        round_exact(F.try_divide(F.sum("missing"), F.sum("n_rows")) * 100, 2).alias("missing_percentage"),
    )


def missing_pattern(df: DataFrame, key: str, buckets: int = 50) -> DataFrame:
    """Null rate per equal-width range of a numeric ``key`` x column.

    Stands for the null-mask heat map: the picture's resolution is fixed, whatever the row count. Rows whose
    key isn't a finite number have no place.
    """
    place = finite_double(df, key)
    ends = df.agg(F.struct(F.min(place).alias("lo"), F.max(place).alias("hi")).alias("ends")).scalar()
    share = F.try_divide(place - ends["lo"], ends["hi"] - ends["lo"])
    bucket = F.least(F.floor(F.coalesce(share, F.lit(0.0)) * buckets), F.lit(buckets - 1)).cast("int")
    parts = []
    for group in chunks(df.columns, COUNTERS_PER_AGGREGATE):
        counted = df.filter(place.isNotNull()).groupBy(bucket.alias("bucket")).agg(
            F.count(F.lit(1)).alias("n_rows"),
            *[F.count(clean(df, c)).alias(f"present_{i}") for i, c in enumerate(group)],
        )
        rows = [F.struct(F.lit(c).alias("column"),
                         (F.col("n_rows") - F.col(f"present_{i}")).alias("missing")) for i, c in enumerate(group)]
        parts.append(counted.select("bucket", "n_rows", F.inline(F.array(*rows))))
    return union_all(parts).select(
        "bucket", "column", "n_rows", "missing", F.round(F.col("missing") / F.col("n_rows"), 6).alias("null_rate"))


def value_bytes(df: DataFrame, name: str) -> Column:
    """Summed bytes of one column."""
    dtype = df.schema[name].dataType
    width = TYPE_WIDTHS.get(dtype.simpleString())
    if isinstance(dtype, T.DecimalType):
        width = 8 if dtype.precision <= 18 else 16
    if width is not None:
        return F.count(F.lit(1)) * width
    if isinstance(dtype, (T.StringType, T.CharType, T.VarcharType, T.BinaryType)):
        return F.coalesce(F.sum(F.octet_length(col(name))), F.lit(0))
    if isinstance(dtype, (T.ArrayType, T.MapType, T.StructType)):
        return F.coalesce(F.sum(F.octet_length(F.to_json(col(name)))), F.lit(0))
    return F.coalesce(F.sum(F.octet_length(col(name).cast("string"))), F.lit(0))


def logical_size(df: DataFrame) -> DataFrame:
    """One row per column: column, bytes, mb. Text counts its UTF-8 bytes, the rest their width."""
    parts = []
    for group in chunks(df.columns, COUNTERS_PER_AGGREGATE):
        sized = df.agg(*[value_bytes(df, c).alias(f"b{i}") for i, c in enumerate(group)])
        rows = [F.struct(F.lit(c).alias("column"), F.col(f"b{i}").cast("long").alias("bytes"))
                for i, c in enumerate(group)]
        parts.append(sized.select(F.inline(F.array(*rows))))
    return union_all(parts).withColumn("mb", round_exact(F.col("bytes") / float(1024 ** 2), 2))
