"""Quality checks: status and severity cascades as Column expressions, and the five table checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablevitals.config import Cascade, Thresholds
from tablevitals.functions.columns import numeric_columns
from tablevitals.functions.scalars import round_exact
from tablevitals.operators.classes import class_balance
from tablevitals.operators.duplicates import duplicate_summary
from tablevitals.operators.missing import logical_size, missing_total
from tablevitals.operators.outliers import iqr_outliers, outlier_total
from tablevitals.operators.text_types import numeric_as_string


def status(value: Column, limits: Cascade) -> Column:
    """excellent / good / fair / poor, or not_applicable without a value."""
    return (
        F.when(value.isNull(), "not_applicable")
        .when(value < limits.excellent, "excellent")
        .when(value < limits.good, "good")
        .when(value < limits.fair, "fair")
        .otherwise("poor")
    )


def severity(status_column: Column) -> Column:
    return F.when(status_column == "poor", "high").when(status_column == "fair", "medium").otherwise("low")


def outlier_severity(status_column: Column) -> Column:
    return F.when(status_column.isin("fair", "poor"), "medium").otherwise("low")


def check_missing(df: DataFrame, thresholds: Thresholds = Thresholds()) -> DataFrame:
    """One row: status, severity, missing_percentage."""
    state = status(F.col("missing_percentage"), thresholds.missing_values)
    return missing_total(df).select(
        state.alias("status"), severity(state).alias("severity"), "missing_percentage")


def check_duplicates(df: DataFrame, thresholds: Thresholds = Thresholds()) -> DataFrame:
    """One row: status, severity, duplicate_percentage."""
    state = status(F.col("duplicate_percentage"), thresholds.duplicates)
    return duplicate_summary(df).select(
        state.alias("status"), severity(state).alias("severity"), "duplicate_percentage")


def check_balance(df: DataFrame, thresholds: Thresholds = Thresholds(), target: str | None = None) -> DataFrame:
    """One row: status, severity, target, imbalance_ratio; not_applicable without a label column."""
    state = status(F.col("imbalance_ratio"), thresholds.class_imbalance)
    return class_balance(df, target).select(
        state.alias("status"), severity(state).alias("severity"), "target", "imbalance_ratio")


def check_outliers(df: DataFrame, thresholds: Thresholds = Thresholds(), method: str = "exact") -> DataFrame:
    """One row: status, severity, outlier_percentage (two decimals; the status uses the full value)."""
    state = status(F.col("outlier_share"), thresholds.outliers)
    return outlier_total(iqr_outliers(df, method=method)).select(
        state.alias("status"), outlier_severity(state).alias("severity"),
        round_exact(F.col("outlier_share"), 2).alias("outlier_percentage"))


def check_types(df: DataFrame) -> DataFrame:
    """One row: status, severity, issues (columns holding numbers as strings)."""
    names = F.sort_array(F.collect_list(F.when(F.col("numeric_as_string"), F.col("column"))))
    found = numeric_as_string(df).agg(names.alias("columns"))  # at most one entry per column
    return found.select(
        F.when(F.size("columns") == 0, "good").otherwise("fair").alias("status"),
        F.lit("low").alias("severity"),
        F.transform("columns", lambda c: F.concat(c, F.lit(": numeric values stored as strings"))).alias("issues"),
    )


def rated(parts: DataFrame, thresholds: Thresholds = Thresholds()) -> DataFrame:
    """Statuses and severities of a measured row: structs missing, duplicates, balance, outliers and types.

    Columns of other names pass through.
    """
    states = {
        "missing": status(F.col("missing.missing_percentage"), thresholds.missing_values),
        "duplicates": status(F.col("duplicates.duplicate_percentage"), thresholds.duplicates),
        "balance": status(F.col("balance.imbalance_ratio"), thresholds.class_imbalance),
        "outliers": status(F.col("outliers.outlier_share"), thresholds.outliers),
    }
    # A table with rows and no numeric column has no outliers, though the check does not apply.
    outlier_percentage = F.coalesce(round_exact(F.col("outliers.outlier_share"), 2),
                                    F.when(F.col("missing.n_rows") > 0, F.lit(0.0)))
    return parts.select(
        "missing.n_rows", "missing.n_columns", "missing.total_missing", "missing.missing_percentage",
        "duplicates.n_duplicates", "duplicates.duplicate_percentage",
        "balance.target", "balance.n_classes", "balance.imbalance_ratio",
        "outliers.total_outliers", outlier_percentage.alias("outlier_percentage"),
        *[state.alias(f"{name}_status") for name, state in states.items()],
        F.col("types.status").alias("types_status"), F.col("types.issues").alias("types_issues"),
        F.lit(None).cast("double").alias("anomaly_percentage"),
        F.lit(None).cast("long").alias("n_anomalies"),
        *[c for c in parts.columns if c not in ("missing", "duplicates", "balance", "outliers", "types")],
    ).withColumns({
        f"{name}_severity": (outlier_severity if name == "outliers" else severity)(F.col(f"{name}_status"))
        for name in states
    })


def validate_table(df: DataFrame) -> DataFrame:
    """One row: is_valid, n_rows, n_cols, has_duplicates, has_missing, size_mb."""
    missing = missing_total(df).select(F.struct("*").alias("m")).scalar()
    doubles = duplicate_summary(df).select(F.struct("*").alias("d")).scalar()
    size = logical_size(df).agg(F.sum("bytes").alias("bytes")).scalar()
    return df.sparkSession.range(1).select(
        (missing["n_rows"] > 0).alias("is_valid"),
        missing["n_rows"].alias("n_rows"),
        missing["n_columns"].alias("n_cols"),
        (doubles["n_duplicates"] > 0).alias("has_duplicates"),
        (missing["total_missing"] > 0).alias("has_missing"),
        size.alias("bytes"),
    ).select("is_valid", "n_rows", "n_cols", "has_duplicates", "has_missing",
             round_exact(F.col("bytes") / float(1024 ** 2)).alias("size_mb"))
