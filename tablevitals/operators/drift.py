"""Drift of numeric columns between two tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablevitals.functions.columns import finite_double, numeric_columns
from tablevitals.session import materialize

#: Shares below this count as this, so that an empty bin leaves the index finite (fixed value).
LEAST_SHARE = 1e-4

#: An index above this is called drift (fixed value).
DRIFT_INDEX = 0.2


def drift(reference: DataFrame, current: DataFrame, columns: Sequence[str] | None = None, bins: int = 10) -> DataFrame:
    """One row per numeric column: column, psi, ks, drifted.

    ``psi`` is the population stability index over equal bins of the reference's range, whose outer bins take what lies
    beyond. ``ks`` is the two-sample Kolmogorov-Smirnov statistic, exact: the largest distance between the shares of
    rows up to any value. Columns without a finite value in either table are left out.
    """
    columns = list(columns if columns is not None else [c for c in numeric_columns(reference) if c in current.columns])
    ends = reference.agg(F.array(*[F.struct(F.min(finite_double(reference, c)).alias("lo"),
                                            F.max(finite_double(reference, c)).alias("hi")) for c in columns]).alias("e"))
    sides = [_binned(frame, columns, ends, bins).withColumnRenamed("rows", name)
             for frame, name in ((reference, "before"), (current, "now"))]
    both = sides[0].join(sides[1], ["i", "bin"], "full_outer").fillna(0, ["before", "now"])
    whole = Window.partitionBy("i")  # as many rows as bins
    p, q = (F.try_divide(c, F.sum(c).over(whole)) for c in ("before", "now"))
    shares = both.select("i", F.greatest(p, F.lit(LEAST_SHARE)).alias("p"), F.greatest(q, F.lit(LEAST_SHARE)).alias("q"),
                         (p.isNull() | q.isNull()).alias("bare"))
    found = shares.groupBy("i").agg(F.sum((F.col("p") - F.col("q")) * F.log(F.col("p") / F.col("q"))).alias("psi"),
                                    F.bool_or("bare").alias("bare"))
    found = found.join(kolmogorov_smirnov(reference, current, columns), "i", "left")
    names = F.array(*[F.lit(c) for c in columns])
    return found.where("NOT bare").select(F.get(names, F.col("i")).alias("column"), "psi", "ks",
                                          (F.col("psi") > DRIFT_INDEX).alias("drifted"))


def kolmogorov_smirnov(reference: DataFrame, current: DataFrame, columns: Sequence[str]) -> DataFrame:
    """i (the column's number), ks: the largest distance of both tables' cumulated shares, over all values.

    Equal values are counted before the shuffle. Values then lie in ranges over all tasks; a range's shares begin where
    the totals of the ranges before it end, so a column is summed up side by side, and what is summed in one place
    is one total per range and column.
    """
    def counted(frame: DataFrame, old: int) -> DataFrame:
        cells = F.array(*[F.struct(F.lit(i).alias("i"), (finite_double(frame, c) + 0.0).alias("x")) for i, c in enumerate(columns)])
        return frame.select(F.explode(cells).alias("c")).select("c.*", F.lit(old).alias("old")).where("x IS NOT NULL")

    values = counted(reference, 1).unionByName(counted(current, 0)).groupBy("i", "x").agg(
        F.sum("old").alias("before"), F.sum(1 - F.col("old")).alias("now"))
    ranges = materialize(values.repartitionByRange("i", "x").withColumn("part", F.spark_partition_id()))
    totals = ranges.groupBy("i", "part").agg(F.sum("before").alias("b"), F.sum("now").alias("n"))
    whole = Window.partitionBy("i")  # one row per range
    earlier = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("i", "part", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_offset") for c in ("b", "n")],
                            *[F.sum(c).over(whole).alias(f"{c}_all") for c in ("b", "n")])
    upto = Window.partitionBy("i", "part").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    shares = [(F.col(f"{c}_offset") + F.sum(name).over(upto)) / F.col(f"{c}_all") for c, name in (("b", "before"), ("n", "now"))]
    both = ranges.join(offsets, ["i", "part"]).where("b_all > 0 AND n_all > 0")
    return both.select("i", F.abs(shares[0] - shares[1]).alias("gap")).groupBy("i").agg(F.max("gap").alias("ks"))


def _binned(df: DataFrame, columns: Sequence[str], ends: DataFrame, bins: int) -> DataFrame:
    """Rows per column number and bin: i, bin, rows."""
    cells = df.select(*[finite_double(df, c).alias(f"v{i}") for i, c in enumerate(columns)], ends.scalar().alias("e"))
    keys = []
    for i in range(len(columns)):
        share = F.try_divide(F.col(f"v{i}") - F.col("e")[i]["lo"], F.col("e")[i]["hi"] - F.col("e")[i]["lo"])
        place = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor(F.coalesce(share, F.lit(0.0)) * bins)))
        keys.append(F.when(F.col(f"v{i}").isNotNull() & F.col("e")[i]["lo"].isNotNull(), place + i * bins))
    return (cells.select(F.explode(F.array(*keys)).alias("key")).filter("key IS NOT NULL").groupBy("key")
            .agg(F.count(F.lit(1)).alias("rows"))
            .select(F.floor(F.col("key") / bins).cast("int").alias("i"), (F.col("key") % bins).alias("bin"), "rows"))
