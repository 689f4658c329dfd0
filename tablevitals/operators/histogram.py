"""Equal-width histograms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablevitals.functions.columns import as_double, numeric_columns


def histogram(df: DataFrame, columns: Sequence[str] | None = None, bins: int = 30) -> DataFrame:
    """Bin counts of all numeric columns (or the given ones): column, bin, low, high, count.

    Bins split min..max evenly and the last one is closed; a constant column sits in the middle of a
    range of width 1. Infinite values have no bin. Empty bins have no row.
    """
    columns = list(columns if columns is not None else numeric_columns(df))
    infinite = [F.lit(float("inf")), F.lit(float("-inf"))]
    finite = df.select([F.when(~as_double(df, c).isin(infinite), as_double(df, c)).alias(f"v{i}")
                        for i, c in enumerate(columns)])
    first = finite.agg(F.array(*[F.struct(F.min(f"v{i}").alias("lo"), F.max(f"v{i}").alias("hi"))
                                 for i in range(len(columns))]).alias("ends"))
    # A constant column gets a range of width 1 around its value.
    ends = first.select(F.transform("ends", lambda e: F.struct(
        F.when(e["lo"] == e["hi"], e["lo"] - 0.5).otherwise(e["lo"]).alias("lo"),
        F.when(e["lo"] == e["hi"], e["hi"] + 0.5).otherwise(e["hi"]).alias("hi"))).alias("ends")).scalar()
    keys = []
    for i in range(len(columns)):
        x, lo, hi = F.col(f"v{i}"), F.col("ends")[i]["lo"], F.col("ends")[i]["hi"]
        position = F.least(F.floor((x - lo) / (hi - lo) * bins), F.lit(bins - 1)).cast("int")
        keys.append(F.when(x.isNotNull(), position + i * bins))
    # Column and bin as one number keep the map-side hash tables small.
    counted = (
        finite.select("*", ends.alias("ends")).select(F.explode(F.array(*keys)).alias("key"))
        .filter("key IS NOT NULL").groupBy("key").agg(F.count(F.lit(1)).alias("count"))
    )
    names = F.array(*[F.lit(c) for c in columns])
    placed = counted.select(
        F.floor(F.col("key") / bins).cast("int").alias("i"), (F.col("key") % bins).alias("bin"), "count",
        ends.alias("ends"),
    ).select(F.get(names, F.col("i")).alias("column"), "bin", F.get("ends", F.col("i")).alias("end"), "count")
    width = (F.col("end.hi") - F.col("end.lo")) / bins
    return placed.select(
        "column", "bin",
        (F.col("end.lo") + F.col("bin") * width).alias("low"),
        (F.col("end.lo") + (F.col("bin") + 1) * width).alias("high"),
        "count",
    )
