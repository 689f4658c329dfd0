"""Everything an audit needs to know about each column that one pass can tell."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablevitals.functions.columns import as_double, chunks, clean, col, role_of, union_all
from tablevitals.functions.scalars import is_numeric_text, percentage
from tablevitals.operators.classes import SKETCH_LIMIT
from tablevitals.operators.missing import value_bytes

#: Columns per aggregate: eight buffer fields each stay below Spark's limit of 100 for code generation.
COLUMNS_PER_AGGREGATE = 9

SCHEMA = ("position int, column string, type string, role string, n_rows long, missing long, missing_pct double, "
          "bytes long, min double, max double, mean double, few_values boolean, numeric_as_string boolean")


def column_profile(df: DataFrame) -> DataFrame:
    """One row per column, see ``SCHEMA``.

    min, max and mean are those of numeric columns. ``few_values``: a sketch doesn't rule out that the column has
    few distinct values (see ``classes``); NULL where values can't be compared. ``numeric_as_string``: a string
    column of numbers; NULL for other types.
    """
    parts = [_of_group(df, group) for group in chunks(df.columns, COLUMNS_PER_AGGREGATE)]
    return union_all(parts)


def _of_group(df: DataFrame, names: list[str]) -> DataFrame:
    fields = {f.name: f for f in df.schema.fields}
    wanted: list[Column] = [F.count(F.lit(1)).alias("n_rows")]
    for i, name in enumerate(names):
        role = role_of(fields[name].dataType)
        wanted += [F.count(clean(df, name)).alias(f"present{i}"), value_bytes(df, name).alias(f"bytes{i}")]
        if role == "numeric":
            wanted += [f(as_double(df, name)).alias(f"{f.__name__}{i}") for f in (F.min, F.max, F.avg)]
        if role == "categorical":
            wanted.append(F.coalesce(F.bool_and(is_numeric_text(col(name))), F.lit(True)).alias(f"text{i}"))
        if comparable(fields[name].dataType):
            wanted.append(F.approx_count_distinct(clean(df, name)).alias(f"distinct{i}"))
    counted = df.agg(*wanted)

    def measured(name: str, kind: str) -> Column:
        return (F.col(name) if name in counted.columns else F.lit(None)).cast(kind)

    rows = [F.struct(
        F.lit(df.columns.index(name)).alias("position"), F.lit(name).alias("column"),
        F.lit(fields[name].dataType.simpleString()).alias("type"),
        F.lit(role_of(fields[name].dataType)).cast("string").alias("role"), "n_rows",
        (F.col("n_rows") - F.col(f"present{i}")).alias("missing"),
        percentage(F.col("n_rows") - F.col(f"present{i}"), F.col("n_rows")).alias("missing_pct"),
        F.col(f"bytes{i}").cast("long").alias("bytes"),
        measured(f"min{i}", "double").alias("min"), measured(f"max{i}", "double").alias("max"),
        measured(f"avg{i}", "double").alias("mean"),
        (measured(f"distinct{i}", "long") <= SKETCH_LIMIT).alias("few_values"),
        measured(f"text{i}", "boolean").alias("numeric_as_string")) for i, name in enumerate(names)]
    return counted.select(F.inline(F.array(*rows)))


def comparable(kind) -> bool:
    return not kind.simpleString().startswith(("map", "variant", "interval"))
