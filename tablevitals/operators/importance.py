"""Feature importance: how much each column tells about the label."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablevitals.functions.columns import clean, col, finite_double, pick_target, role_of

#: Equal bins of a numeric column's range.
BINS = 10
#: A text column of more values than about this names rows rather than groups of them, and has no importance.
MOST_VALUES = 1000


def feature_importance(df: DataFrame, target: str | None = None, columns: Sequence[str] | None = None, bins: int = BINS) -> DataFrame:
    """One row per numeric or text column: column, mutual_information (nats), importance (its share of the label's entropy, 0 to 1).

    Numeric columns count by ``bins`` equal bins over their finite range, text columns by value; missing and infinite
    cells are a bin of their own. Rows without a label take no part. Importance is NULL where the label has one value
    only, both are NULL for text columns of over ``MOST_VALUES`` values (estimated). Two passes: one finds ranges, one
    counts all columns' bins with the label, summed up in the tasks, so what is shuffled are those counts.
    """
    target = target or pick_target(df)
    given = list(columns if columns is not None else df.columns)
    roles = {c: role_of(df.schema[c].dataType) for c in given if c != target}
    names = [c for c, role in roles.items() if role in ("numeric", "categorical")]
    if not names:
        return df.sparkSession.createDataFrame([], "column string, mutual_information double, importance double")
    labelled = df.where(clean(df, target).isNotNull())
    found = labelled.agg(*[
        F.struct(F.min(finite_double(df, c)).alias("lo"), F.max(finite_double(df, c)).alias("hi")).alias(f"e{i}")
        if roles[c] == "numeric" else F.approx_count_distinct(col(c)).alias(f"e{i}") for i, c in enumerate(names)]).first()
    kept = [i for i, c in enumerate(names) if roles[c] == "numeric" or found[i] <= MOST_VALUES]

    def bin_of(i: int) -> Column:
        if roles[names[i]] != "numeric":
            return F.concat(F.lit("="), col(names[i]))
        low, high = found[i]
        if low is None or low == high:
            return F.when(finite_double(df, names[i]).isNotNull(), "0")
        place = F.floor((finite_double(df, names[i]) - F.lit(low)) / F.lit(high - low) * bins)
        return F.least(place, F.lit(bins - 1)).cast("string")

    cells = F.array(*[F.struct(F.lit(i).alias("i"), bin_of(i).alias("bin")) for i in kept])
    counts = labelled.select(col(target).cast("string").alias("label"), F.explode(cells).alias("c")).groupBy(
        "c.i", "c.bin", "label").agg(F.count(F.lit(1)).alias("n"))
    whole, by_bin, by_label = (Window.partitionBy(*keys) for keys in (["i"], ["i", "bin"], ["i", "label"]))
    rows, of_bin, of_label = (F.sum("n").over(w) for w in (whole, by_bin, by_label))
    parts = counts.select("i", (F.col("n") / rows).alias("p"), (of_bin / rows).alias("px"), (of_label / rows).alias("py"))
    told = parts.groupBy("i").agg(
        F.sum(F.col("p") * F.log(F.col("p") / (F.col("px") * F.col("py")))).alias("told"), (-F.sum(F.col("p") * F.log("py"))).alias("all"))
    every = df.sparkSession.createDataFrame(list(enumerate(names)), "i int, column string")
    return every.join(told, "i", "left").select(
        "column", F.greatest("told", F.when(F.col("told").isNotNull(), 0.0)).alias("mutual_information"),
        F.when(F.col("all") > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("told") / F.col("all")))).alias("importance"))
