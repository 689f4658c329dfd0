"""Duplicate rows: counting and listing.

Rows are compared by a digest of 16 bytes, so wide rows and long texts never enter a shuffle. Equal digests are found
by grouping, which Spark pre-aggregates inside every map task: a row repeated a billion times leaves each task as
one record, and no task ever holds a whole group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablevitals.functions.columns import chunks, clean, col
from tablevitals.functions.scalars import round_exact

#: Up to this many rows per group, Spark cuts groups before the shuffle (its own default).
GROUP_LIMIT = 1000
#: Portions of a group for longer lists.
PORTIONS = 64


def _comparable(df: DataFrame, name: str) -> Column:
    """What equal values share: NaN as NULL, 0.0 as -0.0 (by the hash itself), nested values as JSON.

    Hashes skip NULLs inside nested values, which JSON spells out; maps go by their sorted entries.
    """
    kind, value = df.schema[name].dataType, clean(df, name)
    if isinstance(kind, (T.ArrayType, T.StructType, T.MapType)):
        value = F.array_sort(F.map_entries(value)) if isinstance(kind, T.MapType) else value
        return F.when(value.isNotNull(), F.to_json(F.struct(value.alias("v")), {"ignoreNullFields": "false"}))
    return value


def row_digest(df: DataFrame, subset: Sequence[str] | None = None) -> list[Column]:
    """Two independent 64-bit hashes of the compared columns: d0, d1.

    Spark's hashes skip NULLs, so bits that tell which values are NULL are hashed along. Two unequal rows of a
    table of 10^12 rows are taken for copies with a probability of about 10^-15.
    """
    names = list(subset or df.columns)
    values = [_comparable(df, c) for c in names]
    missing = []
    for group in chunks(range(len(names)), 60):
        bits = F.lit(0).cast("long")
        for place, i in enumerate(group):
            bits = bits + F.when(values[i].isNull(), F.lit(1 << place).cast("long")).otherwise(F.lit(0).cast("long"))
        missing.append(bits)
    return [F.xxhash64(F.lit(seed), *missing, *values).alias(f"d{seed}") for seed in (0, 1)]


def _copy_groups(df: DataFrame, subset: Sequence[str] | None, keep: Sequence[str] = ()) -> DataFrame:
    """One row per distinct row: d0, d1, copies, and the smallest of each ``keep`` column as k0, k1, ..."""
    rows = df.select(*row_digest(df, subset), *[col(c).alias(f"k{i}") for i, c in enumerate(keep)])
    kept = [F.min(f"k{i}").alias(f"k{i}") for i in range(len(keep))]
    return rows.groupBy("d0", "d1").agg(F.count(F.lit(1)).alias("copies"), *kept)


def copies_of(df: DataFrame, subset: Sequence[str] | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """The rows that occur more than once, see ``_copy_groups``: what ``count_of`` and ``list_of`` read."""
    return _copy_groups(df, subset, keep).filter("copies > 1")


def count_of(copies: DataFrame) -> int:
    """Copies beyond the first."""
    return copies.agg(F.coalesce(F.sum(F.col("copies") - 1), F.lit(0))).first()[0]


def list_of(copies: DataFrame, key: Sequence[str], n: int) -> DataFrame:
    """The first ``n`` copies in ``key`` order: the key columns and ``copy``."""
    names = [f"k{i}" for i in range(len(key))]
    first = copies.orderBy(*names, "d0", "d1").limit(n)
    numbers = F.sequence(F.lit(1), F.least(F.col("copies") - 1, F.lit(n)).cast("int"))
    listed = first.select(*[F.col(x).alias(c) for x, c in zip(names, key)], F.explode(numbers).alias("copy"))
    return listed.orderBy(*[col(c) for c in key], "copy").limit(n)


def duplicate_summary(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """One row: n_rows, n_duplicates (copies beyond the first), duplicate_percentage.

    NULLs equal each other, NaN equals NULL, 0.0 equals -0.0. ``subset`` limits the comparison.
    """
    totals = _copy_groups(df, subset).agg(
        F.coalesce(F.sum("copies"), F.lit(0)).alias("n_rows"),
        F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("n_duplicates"),
    )
    return totals.withColumn("duplicate_percentage", round_exact(
        F.try_divide("n_duplicates", "n_rows") * 100, 2))


def duplicate_rows(df: DataFrame, key: Sequence[str], subset: Sequence[str] | None = None,
                   n: int = 100) -> DataFrame:
    """The first ``n`` duplicate rows in ``key`` order: the key columns and ``copy`` (1, 2, ...).

    Without ``subset`` whole rows are compared, key included, so the copies of a row share its key: the first
    ``n`` groups hold the first ``n`` copies. With ``subset`` the row with the smallest key, which must identify
    rows, is the original, and the others are its copies in order. Only the first ``n`` + 1 rows of a group matter, so a
    task hands on no more of each, whatever the length of the group.
    """
    key = list(key)
    names = [f"k{i}" for i in range(len(key))]
    if subset is None:
        return list_of(copies_of(df, None, key), key, n)
    rows = df.select(*[col(c).alias(x) for x, c in zip(names, key)], *row_digest(df, subset))
    if n >= GROUP_LIMIT:
        # Spark cuts groups before the shuffle up to that length only; longer lists are cut in portions first.
        rows = _first_of_groups(rows.withColumn("salt", F.pmod(F.xxhash64(*names), F.lit(PORTIONS))), ["d0", "d1", "salt"],
                                names, n + 1).drop("salt")
    ranked = _first_of_groups(rows, ["d0", "d1"], names, n + 1).filter("place > 1")
    listed = ranked.select(*[F.col(x).alias(c) for x, c in zip(names, key)], (F.col("place") - 1).cast("int").alias("copy"),
                           "d0", "d1")
    first = listed.orderBy(*[col(c) for c in key], "copy", "d0", "d1").limit(n).drop("d0", "d1")
    return first.orderBy(*[col(c) for c in key], "copy")


def _first_of_groups(rows: DataFrame, group: list[str], order: list[str], n: int) -> DataFrame:
    """The first ``n`` rows of each group, numbered as ``place``; what is past them leaves no task that reads it."""
    place = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return rows.withColumn("place", place).filter(F.col("place") <= n)
