"""A profile that grows with its data: new files are scanned once, what was learnt of them is kept and merged.

A store holds, for every update, one row per column (counts, moments, a sketch of distinct values and one of quantiles),
one per pair of numeric columns (co-moments), and the files they came from. All of it merges, so the profile of all
files is read off the store, whatever their number and however large they are.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablevitals.functions.columns import as_double, chunks, clean, numeric_columns, role_of, union_all
from tablevitals.functions.scalars import percentage
from tablevitals.operators.correlation import correlation_of, pair_sums
from tablevitals.operators.moments import central_sums, shape
from tablevitals.operators.profile import comparable, column_profile
from tablevitals.session import exists, materialize

#: Size of the quantile sketches: a rank is off by 0.2 % of the rows at most, with 99 % certainty.
SKETCH_SIZE = 2048

#: Columns per aggregate of sketches.
COLUMNS_PER_AGGREGATE = 20


def profile_state(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What a store keeps of a table: a row per column and a row per pair of numeric columns; four scans."""
    profile = materialize(column_profile(df))
    columns = numeric_columns(df)
    found = {r["column"]: r["mean"] for r in profile.select("column", "mean").where("mean IS NOT NULL").collect()}
    means = [found[c] if math.isfinite(found.get(c, math.nan)) else 0.0 for c in columns]
    state = profile.select("position", "column", "type", "role", "n_rows", "missing", "bytes", "min", "max")
    sketches = value_sketches(df)
    if columns:
        sums = central_sums(df, columns, means).select("column", "n", "mean", "m2", "m3", "m4")
    else:
        sums = state.selectExpr("column", "0L AS n", *[f"CAST(NULL AS DOUBLE) AS {c}" for c in ("mean", "m2", "m3", "m4")])
    state = state.join(sums, "column", "left").join(sketches, "column")
    return state, pair_state(df, columns, means)


def pair_state(df: DataFrame, columns: Sequence[str], means: Sequence[float]) -> DataFrame:
    """feature1, feature2, n, the means of both over the shared rows, and their centred sums c11, c22, c12."""
    schema = "feature1 string, feature2 string, n double, mean1 double, mean2 double, c11 double, c22 double, c12 double"
    if len(columns) < 2:
        return df.sparkSession.createDataFrame([], schema)
    names, near = F.array(*[F.lit(c) for c in columns]), F.array(*[F.lit(float(m)) for m in means])
    off1, off2 = F.try_divide("si", "n"), F.try_divide("sj", "n")
    return pair_sums(df, columns, means).select(
        F.get(names, F.col("i")).alias("feature1"), F.get(names, F.col("j")).alias("feature2"), "n",
        (F.get(near, F.col("i")) + off1).alias("mean1"), (F.get(near, F.col("j")) + off2).alias("mean2"),
        (F.col("sii") - off1 * F.col("si")).alias("c11"), (F.col("sjj") - off2 * F.col("sj")).alias("c22"),
        (F.col("sij") - off1 * F.col("sj")).alias("c12"))


def value_sketches(df: DataFrame) -> DataFrame:
    """column, distinct_sketch (of hashes of the values) and value_sketch (of numeric columns)."""
    parts = []
    for group in chunks(df.columns, COLUMNS_PER_AGGREGATE):
        wanted: list[Column] = []
        for i, name in enumerate(group):
            kind = df.schema[name].dataType
            if comparable(kind):
                wanted.append(F.hll_sketch_agg(F.when(clean(df, name).isNotNull(), F.xxhash64(clean(df, name)))).alias(f"d{i}"))
            if role_of(kind) == "numeric":
                wanted.append(F.kll_sketch_agg_double(as_double(df, name), SKETCH_SIZE).alias(f"v{i}"))
        counted = df.agg(F.count(F.lit(1)).alias("rows"), *wanted)
        rows = [F.struct(F.lit(name).alias("column"), *[
            (F.col(f"{short}{i}") if f"{short}{i}" in counted.columns else F.lit(None)).cast("binary").alias(long)
            for short, long in (("d", "distinct_sketch"), ("v", "value_sketch"))]) for i, name in enumerate(group)]
        parts.append(counted.select(F.inline(F.array(*rows))))
    return union_all(parts)


def merged_state(states: DataFrame) -> DataFrame:
    """One row per column of all updates: counts add up, moments go over to the common mean, sketches are united.

    Rows of updates in which a column did not exist count as missing in it. Type, role and place are the latest ones.
    """
    each = Window.partitionBy("column")
    common = F.try_divide(F.sum(F.col("n") * F.col("mean")).over(each), F.sum("n").over(each))
    n, off = F.col("n"), F.col("off")
    moved = states.withColumn("off", F.col("mean") - common).withColumns({
        "p2": F.col("m2") + n * off * off,
        "p3": F.col("m3") + 3 * off * F.col("m2") + n * off * off * off,
        "p4": F.col("m4") + 4 * off * F.col("m3") + 6 * off * off * F.col("m2") + n * off * off * off * off})
    total = states.groupBy("batch").agg(F.max("n_rows").alias("n_rows")).agg(F.sum("n_rows")).scalar()
    latest = F.max_by(F.struct("position", "type", "role"), "batch")
    merged = moved.groupBy("column").agg(
        latest.alias("latest"), F.sum(F.col("n_rows") - F.col("missing")).alias("present"), F.sum("bytes").alias("bytes"),
        F.min("min").alias("min"), F.max("max").alias("max"), F.sum("n").alias("n"),
        F.try_divide(F.sum(F.col("n") * F.col("mean")), F.sum("n")).alias("mean"),
        *[F.sum(f"p{k}").alias(f"m{k}") for k in (2, 3, 4)],
        F.hll_union_agg("distinct_sketch").alias("distinct_sketch"),
        F.kll_merge_agg_double("value_sketch").alias("value_sketch"))
    return merged.select(
        "latest.position", "column", "latest.type", "latest.role", total.alias("n_rows"),
        (total - F.col("present")).alias("missing"), "bytes", "min", "max", "n", "mean", "m2", "m3", "m4", "distinct_sketch",
        "value_sketch")


def update_profile(spark: SparkSession, source: str, store: str,
                   read: Callable[[list[str]], DataFrame] | None = None, exclude: Sequence[str] = ()) -> int:
    """Scans the files below ``source`` that ``store`` doesn't know, and adds what they hold; returns their number.

    ``read`` gives the table in some files, without it Parquet is read. An update counts once its list of files is
    written, which is last; one that broke off is written anew. One update may run at a time. A known file that has
    changed stops the update, as what was learnt of it can't be taken back; one that is gone stays counted.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(source).select(
        "path", "modificationTime", "length")
    done = _updates(spark, store)
    if done:
        known = spark.read.parquet(*[f"{store}/files/{n:08d}" for n in range(done)])
        changed = listed.join(known.toDF("path", "then", "size"), "path").where(
            "modificationTime <> then OR length <> size").select("path").first()
        if changed:
            raise ValueError(f"{changed[0]} has changed since it was profiled")
        listed = listed.join(known.select("path"), "path", "left_anti")
    files = materialize(listed)
    paths = [r["path"] for r in files.select("path").orderBy("path").collect()]
    if not paths:
        return 0
    table = read(paths) if read else spark.read.option("basePath", source).parquet(*paths)
    columns, pairs = profile_state(table.drop(*exclude))
    for name, frame in (("columns", columns), ("pairs", pairs), ("files", files)):
        frame.coalesce(1).write.mode("overwrite").parquet(f"{store}/{name}/{done:08d}")
    return len(paths)


def _updates(spark: SparkSession, store: str) -> int:
    """How many updates are complete."""
    n = 0
    while exists(spark, f"{store}/files/{n:08d}/_SUCCESS"):
        n += 1
    return n


def stored_state(spark: SparkSession, store: str, name: str = "columns") -> DataFrame:
    """The rows of all complete updates, with the number of each as ``batch``."""
    done = _updates(spark, store)
    if not done:
        raise ValueError(f"nothing is profiled in {store}")
    frames = spark.read.option("basePath", f"{store}/{name}").parquet(*[f"{store}/{name}/{n:08d}" for n in range(done)])
    return frames.withColumn("batch", F.regexp_extract(F.col("_metadata.file_path"), r"/(\d{8})/[^/]*$", 1).cast("int"))


def stored_profile(spark: SparkSession, store: str) -> DataFrame:
    """One row per column of all files: position, column, type, role, n_rows, missing, missing_pct, bytes, n_distinct (estimated),
    and mean, std, min, max, skewness and kurtosis of numeric ones. Reads the store alone."""
    merged = materialize(merged_state(stored_state(spark, store)))
    shapes = shape(merged.where("n > 0").select("column", "n", "mean", "min", "max", "m2", "m3", "m4")).drop("n", "min", "max")
    return merged.join(shapes.withColumnsRenamed({"mean": "average"}), "column", "left").select(
        "position", "column", "type", "role", "n_rows", "missing", percentage(F.col("missing"), F.col("n_rows")).alias("missing_pct"),
        "bytes", F.hll_sketch_estimate("distinct_sketch").alias("n_distinct"), F.col("average").alias("mean"), "std", "min", "max",
        "skewness", "kurtosis")


def stored_quantiles(spark: SparkSession, store: str, probabilities: Sequence[float]) -> DataFrame:
    """column, p, value: values of numeric columns whose rank is off by 0.2 % of the rows at most (99 % certainty)."""
    merged = merged_state(stored_state(spark, store)).where("n > 0")
    wanted = F.array(*[F.lit(float(p)) for p in probabilities])
    return merged.select("column", F.explode(F.arrays_zip(
        wanted.alias("p"), F.kll_sketch_get_quantile_double("value_sketch", wanted).alias("value"))).alias("q")).select("column", "q.*")


def stored_correlations(spark: SparkSession, store: str) -> DataFrame:
    """feature1, feature2, correlation of all files, each pair over the rows that have both."""
    states = stored_state(spark, store, "pairs").where("n > 0")
    each = Window.partitionBy("feature1", "feature2")

    def off(mean: str) -> Column:
        return F.col(mean) - F.sum(F.col("n") * F.col(mean)).over(each) / F.sum("n").over(each)

    moved = states.withColumns({"off1": off("mean1"), "off2": off("mean2")})
    n, off1, off2 = F.col("n"), F.col("off1"), F.col("off2")
    sums = moved.groupBy("feature1", "feature2").agg(
        F.sum(F.col("c11") + n * off1 * off1).alias("c11"), F.sum(F.col("c22") + n * off2 * off2).alias("c22"),
        F.sum(F.col("c12") + n * off1 * off2).alias("c12"), F.sum("n").alias("n"), F.max(F.abs("mean1")).alias("size1"),
        F.max(F.abs("mean2")).alias("size2"))
    # A column that doesn't vary leaves no more than the rounding of its values.
    varies = [F.col(f"c{k}{k}") > 1e-24 * n * F.col(f"size{k}") * F.col(f"size{k}") for k in (1, 2)]
    return sums.select("feature1", "feature2", correlation_of(F.col("c12"), F.col("c11"), F.col("c22"), varies[0] & varies[1]).alias("correlation"))
