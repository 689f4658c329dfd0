"""The profile that grows with its data: merges, new files alone, broken updates, new and empty columns."""

import math

import pytest
from pyspark.sql import functions as F

from tablevitals.operators.correlation import correlation_pairs
from tablevitals.operators.moments import numeric_moments
from tablevitals.plans import incremental


def some_rows(spark, low, high, **more):
    rows = spark.range(low, high).select(
        "id", (F.pow(F.col("id") % 37, 2) / 7 + 1e6).alias("x"), F.when(F.col("id") % 5 > 0, F.sin("id")).alias("y"),
        F.lit(None).cast("double").alias("empty"), F.lit(3.5).alias("same"), (F.col("id") % 9).cast("string").alias("word"))
    return rows.withColumns({name: F.expr(text) for name, text in more.items()})


def as_map(frame):
    return {r["column"]: r.asDict() for r in frame.collect()}


def read_paths(paths, spark, seen):
    seen.append(len(paths))
    return spark.read.parquet(*paths)


def test_updates_equal_one_profile_and_scan_new_files_alone(spark, tmp_path):
    folder, store, seen = f"{tmp_path}/in", f"{tmp_path}/store", []
    for low, high, parts in ((0, 500, 3), (500, 900, 1), (900, 903, 2)):
        some_rows(spark, low, high).coalesce(parts).repartition(parts).write.mode("append").parquet(folder)
        assert incremental.update_profile(spark, folder, store, lambda p: read_paths(p, spark, seen)) == parts
    assert incremental.update_profile(spark, folder, store, lambda p: read_paths(p, spark, seen)) == 0
    assert seen == [3, 1, 2]
    whole = some_rows(spark, 0, 903)
    found = as_map(incremental.stored_profile(spark, store))
    assert [*sorted(found, key=lambda c: found[c]["position"])] == whole.columns
    for name, want in as_map(numeric_moments(whole)).items():
        for value in ("mean", "std", "min", "max", "skewness", "kurtosis"):
            assert found[name][value] == (None if want[value] is None else pytest.approx(want[value], rel=1e-9, abs=1e-9)), (name, value)
    assert found["y"]["missing"] == 181 and found["empty"]["missing"] == 903 and found["word"]["n_rows"] == 903
    assert found["word"]["n_distinct"] == 9 and abs(found["id"]["n_distinct"] - 903) < 30 and found["empty"]["n_distinct"] == 0
    pairs = {(r.feature1, r.feature2): r.correlation for r in correlation_pairs(whole).collect()}
    got = {(r.feature1, r.feature2): r.correlation for r in incremental.stored_correlations(spark, store).collect()}
    for pair, want in pairs.items():
        assert got.get(pair) == (None if want is None else pytest.approx(want, abs=1e-9)), pair


def test_quantiles_of_the_store(spark, tmp_path):
    folder, store = f"{tmp_path}/in", f"{tmp_path}/store"
    for k in range(4):
        spark.range(k * 20_000, (k + 1) * 20_000).select(F.xxhash64("id").cast("double").alias("v"), "id").write.mode("append").parquet(folder)
        incremental.update_profile(spark, folder, store)
    values = sorted(r.v for r in spark.read.parquet(folder).select("v").collect())
    for row in incremental.stored_quantiles(spark, store, [0.01, 0.5, 0.9]).where("column = 'v'").collect():
        rank = sum(v <= row.value for v in values) / len(values)
        assert abs(rank - row.p) < 0.005


def test_an_update_that_broke_off_counts_once(spark, tmp_path):
    folder, store = f"{tmp_path}/in", f"{tmp_path}/store"
    some_rows(spark, 0, 100).write.parquet(folder)
    incremental.update_profile(spark, folder, store)
    some_rows(spark, 100, 160).write.mode("append").parquet(folder)
    some_rows(spark, 0, 7).drop("y").write.parquet(f"{store}/columns/00000001")  # columns written, files not
    assert as_map(incremental.stored_profile(spark, store))["id"]["n_rows"] == 100
    assert incremental.update_profile(spark, folder, store) > 0
    assert as_map(incremental.stored_profile(spark, store))["id"]["n_rows"] == 160


def test_new_columns_changed_files_and_empty_stores(spark, tmp_path):
    folder, store = f"{tmp_path}/in", f"{tmp_path}/store"
    with pytest.raises(ValueError, match="nothing is profiled"):
        incremental.stored_profile(spark, store)
    some_rows(spark, 0, 40).coalesce(1).write.parquet(folder)
    incremental.update_profile(spark, folder, store)
    some_rows(spark, 40, 60, late="id * 2.0D").coalesce(1).write.mode("append").parquet(folder)
    incremental.update_profile(spark, folder, store)
    found = as_map(incremental.stored_profile(spark, store))
    assert found["late"]["missing"] == 40 and found["late"]["n_rows"] == 60 and found["late"]["mean"] == pytest.approx(99.0)
    some_rows(spark, 0, 5).coalesce(1).write.mode("overwrite").parquet(folder)
    files = spark.read.parquet(f"{store}/files/00000000").toPandas()
    spark.createDataFrame(files.assign(path=spark.read.format("binaryFile").load(folder).select("path").first()[0])).write.mode(
        "overwrite").parquet(f"{store}/files/00000000")
    with pytest.raises(ValueError, match="has changed"):
        incremental.update_profile(spark, folder, store)


def test_values_that_arent_finite(spark, tmp_path):
    folder, store = f"{tmp_path}/in", f"{tmp_path}/store"
    spark.createDataFrame([(1.0, 1.0), (math.inf, 2.0), (math.nan, 3.0), (None, 5.0)], "a double, b double").write.parquet(folder)
    incremental.update_profile(spark, folder, store)
    found = as_map(incremental.stored_profile(spark, store))
    assert found["a"]["missing"] == 2 and found["a"]["max"] == math.inf and found["b"]["std"] == pytest.approx(1.7078, abs=1e-4)
