"""Operators on small fixtures, against pandas or by hand."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablevitals.functions import scalars
from tablevitals.functions.columns import normalize, pick_target
from tablevitals.operators import (classes, correlation, drift, duplicates, features, histogram, importance, missing, moments,
                                   outliers, profile, quantiles, text_types)
from tablevitals.plans import checks

NAN = float("nan")
INF = float("inf")


def rows(frame):
    return [r.asDict(recursive=True) for r in frame.collect()]


def by_column(frame):
    return {r["column"]: r for r in rows(frame)}


@pytest.fixture(scope="module")
def mixed(spark):
    """Gaps, NaN beside NULL, a constant, skewed and tied values."""
    rng = np.random.default_rng(7)
    n = 3000
    data = pd.DataFrame({
        "normal": rng.normal(10, 3, n),
        "skewed": np.exp(rng.normal(0, 2, n)),
        "tied": rng.integers(0, 5, n).astype(float),
        "flat": np.full(n, 7.25),
    })
    data["linked"] = data["normal"] * -2 + rng.normal(0, 0.5, n)
    for c in ("normal", "tied", "linked"):
        data.loc[rng.random(n) < 0.1, c] = np.nan
    frame = spark.createDataFrame(data)
    # Half of the gaps as NULL, the others stay NaN.
    frame = frame.withColumn("tied", F.when(F.isnan("tied") & (F.rand(1) < 0.5), None).otherwise(F.col("tied")))
    return data, frame.repartition(5).persist()


def test_normalize_turns_nan_into_null(spark):
    frame = spark.createDataFrame([(1.0, "a"), (NAN, "b"), (None, "c")], "x double, s string")
    assert [r["x"] for r in rows(normalize(frame).orderBy("s"))] == [1.0, None, None]


def test_moments_match_pandas(mixed):
    data, frame = mixed
    found = by_column(moments.numeric_moments(frame))
    for c in data.columns:
        expected = [data[c].mean(), data[c].std(), data[c].min(), data[c].max(), data[c].skew(), data[c].kurtosis()]
        got = [found[c][k] for k in ("mean", "std", "min", "max", "skewness", "kurtosis")]
        assert got == pytest.approx(expected, rel=1e-9, abs=1e-9), c
        assert found[c]["n"] == data[c].count()


def test_moments_of_few_rows(spark):
    frame = spark.createDataFrame([(1.0, 5.0, None), (2.0, None, None)], "a double, b double, c double")
    found = by_column(moments.numeric_moments(frame))
    assert found["a"]["std"] == pytest.approx(math.sqrt(0.5))
    assert found["a"]["skewness"] is None and found["a"]["kurtosis"] is None
    assert found["b"]["std"] is None and found["b"]["mean"] == 5.0
    assert found["c"]["n"] == 0 and found["c"]["mean"] is None


def test_standard_scale_zero_sd_divides_by_one(spark):
    frame = spark.createDataFrame([(1, 4.0, 1.0), (2, 4.0, 3.0)], "id int, flat double, x double")
    scaled = rows(features.standard_scale(frame, ["flat", "x"], ["id"]).orderBy("id"))
    assert [r["flat"] for r in scaled] == [0.0, 0.0]
    assert [r["x"] for r in scaled] == [-1.0, 1.0]


@pytest.mark.parametrize("few_rows", [10**9, 0])
def test_quantiles_match_pandas(mixed, few_rows):
    data, frame = mixed
    probabilities = [0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 1.0]
    found = quantiles.quantile_values(frame, probabilities, few_rows=few_rows)
    for c in data.columns:
        assert found[c] == pytest.approx(list(data[c].quantile(probabilities)), rel=1e-12), c


def test_quantiles_narrow_repeatedly(mixed, monkeypatch):
    """Coarse sketches and small budgets force many passes; the ranks stay exact."""
    data, frame = mixed
    monkeypatch.setattr(quantiles, "ACCURACY", 8)
    found = quantiles.quantile_values(frame, [0.1, 0.5, 0.9], few_rows=3)
    for c in data.columns:
        assert found[c] == pytest.approx(list(data[c].quantile([0.1, 0.5, 0.9])), rel=1e-12), c


def test_quantiles_with_infinities_and_extremes(spark):
    values = [-INF, -1e308, -5.0, 0.0, 5e-324, 1.0, 2.0, 1e308, INF, INF]
    frame = spark.createDataFrame([(v,) for v in values], "x double")
    expected = [sorted(values)[i] for i in (0, 3, 9)]
    found = quantiles.quantile_values(frame, [0.0, 3 / 9, 1.0], few_rows=0)["x"]
    assert found == expected


def test_quantiles_one_hot_value(spark):
    """A third and more of the rows share a value."""
    frame = spark.range(30000).select(F.when(F.col("id") % 3 > 0, 5.0).otherwise(F.col("id").cast("double")).alias("x"))
    expected = frame.toPandas()["x"].quantile([0.25, 0.5, 0.9]).tolist()
    assert quantiles.quantile_values(frame, [0.25, 0.5, 0.9], few_rows=0)["x"] == pytest.approx(expected)


def test_quantiles_of_nothing(spark):
    frame = spark.createDataFrame([], "x double")
    assert quantiles.quantile_values(frame, [0.5])["x"] == [None]
    assert quantiles.quantile_values(frame, [0.5], few_rows=-1)["x"] == [None]


def test_approximate_quantiles_are_close(mixed):
    data, frame = mixed
    found = quantiles.quantile_values(frame, [0.5], ["normal"], method="approx")["normal"][0]
    assert abs(found - data["normal"].median()) < 0.05


def test_correlations_match_pandas(mixed):
    data, frame = mixed
    expected = data.corr()
    found = {(r["feature1"], r["feature2"]): r["correlation"] for r in rows(correlation.correlation_matrix(frame))}
    assert len(found) == 25
    for a in data.columns:
        for b in data.columns:
            if math.isnan(expected.loc[a, b]):
                assert found[a, b] is None, (a, b)
            else:
                assert found[a, b] == pytest.approx(expected.loc[a, b], abs=1e-9), (a, b)
    high = rows(correlation.high_correlations(frame))
    assert [(r["feature1"], r["feature2"]) for r in high] == [("normal", "linked")]


def test_correlations_leave_infinite_cells_out(spark):
    data = [(1.0, 2.0), (2.0, 4.5), (3.0, INF), (4.0, 7.5), (-INF, 1.0), (5.0, 11.0)]
    frame = spark.createDataFrame(data, "x double, y double")
    found = rows(correlation.correlation_pairs(frame))[0]["correlation"]
    assert found == pytest.approx(np.corrcoef(np.array([r for r in data if abs(r[0]) + abs(r[1]) < INF]).T)[0, 1])


def test_rounding_goes_by_the_binary_value(spark):
    values = [2.675, 1.005, 0.125, 0.375, 52.45, -2.675, 107 / 4000 * 100, 1e300, 0.0, INF, 5e-324, 123456789.125, None]
    values += [k / 1000 for k in range(-3000, 3000, 5)]
    frame = spark.createDataFrame([(v,) for v in values], "x double")
    found = [r["r"] for r in rows(frame.select(scalars.round_exact(F.col("x")).alias("r")))]
    assert found == [None if v is None else v if abs(v) > 1e16 else round(v, 2) for v in values]


def test_dotted_names(spark):
    frame = spark.createDataFrame([(1.0, None), (2.0, "x"), (NAN, "y"), (3.0, None)], "`a.b` double, `c d` string")
    found = rows(missing.missing_pattern(frame, "a.b", 2))
    assert sum(r["missing"] for r in found if r["column"] == "c d") == 2 and sum(r["n_rows"] for r in found) == 6
    assert [r["normalized"] for r in rows(scalars.normalize_scores(frame, "a.b"))][:2] == [0.0, 50.0]
    assert rows(duplicates.duplicate_rows(frame, ["a.b"], ["c d"])) == [{"a.b": 3.0, "copy": 1}]


def test_null_elements_are_told_apart(spark):
    data = [([1, None], (None, 2)), ([None, 1], (None, 2)), ([1, None], (2, None)), ([1, None], (None, 2)), (None, None)]
    frame = spark.createDataFrame(data, "a array<int>, s struct<x:int,y:int>")
    assert rows(duplicates.duplicate_summary(frame))[0]["n_duplicates"] == 1


def test_exchange_carries_digest_and_count_only(spark, sf):
    frame = spark.read.parquet(f"{sf}/documents.parquet")
    text = duplicates.duplicate_summary(frame)._jdf.queryExecution().executedPlan().toString()
    shuffled = [line for line in text.splitlines() if "Exchange hashpartitioning" in line]
    assert shuffled and all("d0" in line and "d1" in line and "text" not in line for line in shuffled)


def test_column_profile_of_odd_columns(spark):
    schema = "f double, m map<string,int>, a array<int>, s string, b boolean, d decimal(10,2), n string"
    frame = spark.createDataFrame([(NAN, {"k": 1}, [1], "1", True, None, None), (INF, None, None, " 2 ", None, None, None)], schema)
    found = {r["column"]: r for r in rows(profile.column_profile(frame).orderBy("position"))}
    assert list(found) == ["f", "m", "a", "s", "b", "d", "n"]
    assert [found[c]["missing"] for c in found] == [1, 1, 1, 0, 1, 2, 2]
    assert found["f"]["max"] == INF and found["s"]["numeric_as_string"] and found["n"]["numeric_as_string"]
    assert found["m"]["few_values"] is None and found["b"]["role"] is None and found["d"]["min"] is None
    empty = rows(profile.column_profile(frame.limit(0)))
    assert {r["n_rows"] for r in empty} == {0} and {r["missing_pct"] for r in empty} == {0.0}


def test_drift_of_equal_and_shifted_tables(spark):
    frame = spark.range(1000).select((F.col("id") % 100).cast("double").alias("x"), F.lit(None).cast("double").alias("none"),
                                     F.lit(4.0).alias("flat"))
    same = by_column(drift.drift(frame, frame))
    assert set(same) == {"x", "flat"} and same["x"] == {"column": "x", "psi": 0.0, "ks": 0.0, "drifted": False}
    moved = by_column(drift.drift(frame, frame.withColumn("x", F.col("x") / 10 + 200)))
    assert moved["x"]["drifted"] and moved["x"]["ks"] == 1.0 and not moved["flat"]["drifted"]
    assert rows(drift.drift(frame, frame.limit(0))) == []


def test_zscores(spark):
    frame = spark.createDataFrame([(float(v), 1.0) for v in [0] * 50 + [1] * 50 + [40, INF, NAN]], "x double, flat double")
    found = by_column(outliers.zscore_outliers(frame))
    assert (found["x"]["outliers"], found["x"]["n"], found["flat"]["outliers"]) == (1, 101, 0)
    assert rows(outliers.zscore_outliers(frame.select(F.lit("s").alias("s")))) == []


def test_text_checks(spark):
    frame = spark.createDataFrame([("ok",), ("",), ("  ",), (None,), ("b\ufffdd",), ("n\0l",), ("é" * 9,)], "s string")
    found = by_column(text_types.text_checks(frame, longest=8))["s"]
    assert found == {"column": "s", "n": 6, "missing": 1, "blank": 2, "too_short": 1, "too_long": 1, "broken": 2,
                     "min_length": 0, "mean_length": pytest.approx(19 / 6), "max_length": 9}


def test_correlation_needs_two_columns(spark):
    assert rows(correlation.correlation_matrix(spark.createDataFrame([(1.0,)], "x double"))) == []


def test_iqr_outliers(spark):
    values = [1.0, 2.0, 3.0, 4.0, 100.0, None]
    frame = spark.createDataFrame([(v, i) for i, v in enumerate(values)], "x double, id int")
    found = by_column(outliers.iqr_outliers(frame, ["x"]))["x"]
    assert (found["lower"], found["upper"], found["outliers"], found["n_rows"]) == (-1.0, 7.0, 1, 6)
    mask = {r["id"]: r["x_ok"] for r in rows(outliers.iqr_keep_mask(frame, ["x"], ["id"]))}
    assert mask == {0: True, 1: True, 2: True, 3: True, 4: False, 5: False}


def test_duplicates_treat_missing_values_as_equal(spark):
    data = [(None, "a", 0.0), (None, "a", -0.0), ("a", None, 0.0), (None, "a", 0.0), ("a", None, NAN), ("a", None, None)]
    frame = spark.createDataFrame(data, "s string, t string, x double")
    found = rows(duplicates.duplicate_summary(frame))[0]
    assert found == {"n_rows": 6, "n_duplicates": 3, "duplicate_percentage": 50.0}


def test_duplicates_of_long_and_short_strings(spark):
    long, short = "x" * 5000, "y" * 31
    frame = spark.createDataFrame([(long,), (long,), (long + "z",), (short,), (short,), ("y" * 32,), ("",), (None,)], "s string")
    assert rows(duplicates.duplicate_summary(frame))[0]["n_duplicates"] == 2


def test_duplicates_of_nested_columns(spark):
    schema = "a array<int>, s struct<x:int>, m map<string,int>"
    data = [([1, 2], (1,), {"k": 1}), ([1, 2], (1,), {"k": 1}), ([2, 1], (1,), {"k": 1})]
    assert rows(duplicates.duplicate_summary(spark.createDataFrame(data, schema)))[0]["n_duplicates"] == 1


def test_duplicate_rows_of_a_hot_row(spark):
    """A third of the rows are copies of one row."""
    frame = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), F.lit("v").alias("v"))
    found = rows(duplicates.duplicate_rows(frame, ["k"]))
    assert found == [{"k": 0, "copy": i} for i in range(1, 101)]
    assert rows(duplicates.duplicate_summary(frame))[0]["n_duplicates"] == 999


def test_duplicate_rows_with_a_text_key(spark):
    frame = spark.createDataFrame([("k" * 40, 1), ("a", 1), ("k" * 40, 1), ("a", 2), ("k" * 40, 1)], "name string, v int")
    assert rows(duplicates.duplicate_rows(frame, ["name"])) == [{"name": "k" * 40, "copy": 1}, {"name": "k" * 40, "copy": 2}]


def test_duplicate_rows_over_a_subset(spark):
    frame = spark.range(1000).select("id", (F.col("id") % 300).alias("v"))
    found = rows(duplicates.duplicate_rows(frame, ["id"], ["v"], n=3))
    assert found == [{"id": 300, "copy": 1}, {"id": 301, "copy": 1}, {"id": 302, "copy": 1}]


def test_duplicate_rows_of_a_key_that_repeats(spark):
    data = [(1, "a"), (1, "a"), (1, "a"), (2, "a"), (2, "b"), (3, "b"), (4, "c"), (3, "b")]
    frame = spark.createDataFrame(data, "k int, v string")
    found = rows(duplicates.duplicate_rows(frame, ["k"], ["v"]))
    assert [(r["k"], r["copy"]) for r in found] == [(1, 1), (1, 2), (2, 3), (3, 1), (3, 2)]
    assert found[:2] == rows(duplicates.duplicate_rows(frame, ["k"], ["v"], n=2))


@pytest.mark.parametrize("n_values, applicable", [(19, True), (20, False), (21, False)])
def test_class_limit(spark, n_values, applicable):
    frame = spark.range(100).select((F.col("id") % n_values).alias("y"))
    found = rows(classes.class_balance(frame))[0]
    assert (found["n_classes"] == n_values) if applicable else found["n_classes"] is None
    status = rows(checks.check_balance(frame))[0]["status"]
    assert (status != "not_applicable") == applicable


def test_class_balance_of_a_column_full_of_values(spark):
    frame = spark.range(50000).withColumnRenamed("id", "label")
    assert rows(classes.class_balance(frame))[0] == {
        "target": "label", "n_classes": None, "max_count": None, "min_count": None, "imbalance_ratio": None}


def test_all_null_target_is_not_applicable(spark):
    frame = spark.createDataFrame([(1, None), (2, None)], "x int, target string")
    assert rows(checks.check_balance(frame))[0]["status"] == "not_applicable"


def test_target_choice(spark):
    assert pick_target(spark.createDataFrame([], "y int, label int, z int")) == "label"
    assert pick_target(spark.createDataFrame([], "a int, b int")) == "b"


def test_class_weights(spark):
    frame = spark.createDataFrame([("a",)] * 3 + [("b",)], "label string")
    found = {r["label"]: r["weight"] for r in rows(classes.class_weights(frame, "label"))}
    assert found == {"a": pytest.approx(4 / 6), "b": pytest.approx(2.0)}


def test_categorical_columns(spark):
    frame = spark.range(5000).select(
        F.col("id"), (F.col("id") % 10).alias("ten"), (F.col("id") % 11).alias("eleven"),
        F.when(F.col("id") % 2 == 0, True).alias("flag"), F.lit("x").alias("text"))
    found = [(r["column"], r["n_distinct"]) for r in rows(classes.categorical_columns(frame))]
    assert found == [("ten", 10), ("flag", 1), ("text", None)]


def test_missing_counts(spark):
    frame = spark.createDataFrame([(1.0, None, None), (NAN, "a", None), (None, "b", None)], "x double, s string, n int")
    found = by_column(missing.missing_by_column(frame))
    assert {c: (r["missing"], r["missing_pct"]) for c, r in found.items()} == {
        "x": (2, 66.67), "s": (1, 33.33), "n": (3, 100.0)}
    assert rows(missing.missing_total(frame))[0]["missing_percentage"] == 66.67


def test_missing_over_many_columns(spark):
    frame = spark.range(10).select(*[F.when(F.col("id") >= i % 4, F.col("id")).alias(f"c{i}") for i in range(200)])
    assert rows(missing.missing_total(frame))[0]["total_missing"] == sum(i % 4 for i in range(200))
    assert len(rows(moments.numeric_moments(frame))) == 200


def test_empty_table(spark):
    frame = spark.createDataFrame([], "x double, s string")
    assert rows(missing.missing_total(frame))[0]["missing_percentage"] is None
    assert rows(duplicates.duplicate_summary(frame))[0]["duplicate_percentage"] is None
    assert rows(checks.check_missing(frame))[0]["status"] == "not_applicable"
    assert rows(checks.check_outliers(frame))[0]["status"] == "not_applicable"
    assert rows(checks.validate_table(frame))[0]["is_valid"] is False


def test_odd_column_names(spark):
    frame = spark.createDataFrame([(1.0, 2.0, "a"), (2.0, 4.5, None)], "`a.b` double, `c d` double, `e``f` string")
    assert by_column(missing.missing_by_column(frame))["e`f"]["missing"] == 1
    assert by_column(moments.numeric_moments(frame))["a.b"]["mean"] == 1.5
    assert quantiles.quantile_values(frame, [0.5])["c d"] == [3.25]
    assert rows(duplicates.duplicate_summary(frame))[0]["n_duplicates"] == 0
    assert len(rows(correlation.correlation_pairs(frame))) == 1


def test_numeric_text(spark):
    passing = ["", " 2 ", "1e5", "inf", "-Infinity", "+.5", "3.", None]
    failing = ["nan", "1d", "1.5f", "0x1F", "1_000", "1,000", "abc", "1e", ".", "--1"]
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(passing + failing)], "i int, s string")
    flags = [r["f"] for r in rows(frame.select("i", scalars.is_numeric_text(F.col("s")).alias("f")).orderBy("i"))]
    assert flags == [True] * len(passing) + [False] * len(failing)


def test_numeric_as_string(spark):
    frame = spark.createDataFrame([("1", "x", None), (" 2 ", "3", None), (None, "4", None)], "a string, b string, c string")
    found = {r["column"]: r["numeric_as_string"] for r in rows(text_types.numeric_as_string(frame))}
    assert found == {"a": True, "b": False, "c": True}
    check = rows(checks.check_types(frame))[0]
    assert check["status"] == "fair"
    assert check["issues"] == ["a: numeric values stored as strings", "c: numeric values stored as strings"]


def test_histogram_matches_numpy(spark):
    values = np.random.default_rng(3).normal(size=2000)
    frame = spark.createDataFrame([(float(v), 4.0) for v in values] + [(None, 4.0), (INF, 4.0)], "x double, flat double")
    found = rows(histogram.histogram(frame, bins=10))
    counts, _ = np.histogram(values, bins=10)
    assert {r["bin"]: r["count"] for r in found if r["column"] == "x"} == {i: c for i, c in enumerate(counts) if c}
    flat = [r for r in found if r["column"] == "flat"]
    assert [(r["bin"], r["count"], r["low"], r["high"]) for r in flat] == [(5, 2002, pytest.approx(4.0), pytest.approx(4.1))]


def test_missing_pattern_is_whole(spark):
    frame = spark.range(1000).select(F.col("id").alias("k"), F.when(F.col("id") < 500, 1).alias("x"))
    found = rows(missing.missing_pattern(frame, "k", buckets=4))
    assert sum(r["n_rows"] for r in found if r["column"] == "x") == 1000
    assert {r["bucket"]: r["null_rate"] for r in found if r["column"] == "x"}[3] == 1.0


def test_roles(spark):
    schema = "i int, d decimal(5,2), s string, t timestamp_ntz, day date, b boolean, a array<int>"
    found = {r["column"]: r["role"] for r in rows(profile.column_profile(spark.createDataFrame([], schema)))}
    assert found == {"i": "numeric", "d": "numeric", "s": "categorical", "t": "datetime", "day": "datetime",
                     "b": None, "a": None}


def test_scalar_functions(spark):
    frame = spark.createDataFrame([(0, 0, 512, "a" * 101), (1, 3, 1536, "b" * 100)], "p int, w int, n long, s string")
    first, second = rows(frame.select(
        scalars.percentage(F.col("p"), F.col("w")).alias("pct"), scalars.format_bytes(F.col("n")).alias("size"),
        scalars.truncate_text(F.col("s")).alias("text")))
    assert first == {"pct": 0.0, "size": "512.00 B", "text": "a" * 97 + "..."}
    assert second == {"pct": 33.33, "size": "1.50 KB", "text": "b" * 100}


def test_normalize_scores_of_a_constant(spark):
    frame = spark.createDataFrame([(3.0,), (3.0,), (None,)], "s double")
    found = sorted((r["normalized"] for r in rows(scalars.normalize_scores(frame, "s"))), key=lambda v: v is None)
    assert found == [50.0, 50.0, None]


def test_strip_removes_all_whitespace(spark):
    text = "　\t\x1c a b  \n\xa0"
    assert spark.createDataFrame([(text,)], "s string").select(scalars.strip(F.col("s"))).first()[0] == text.strip()


def test_suffixes(spark):
    cases = {"a/b.csv": "tabular", "x.JPG": "image", "t.txt": "text", "d/.csv": "unknown", "noext": "unknown",
             "a.tar.parquet": "tabular", "b.csv/": "tabular", "c.json": "tabular", "e.xlsx": "tabular"}
    frame = spark.createDataFrame([(c,) for c in cases], T.StructType([T.StructField("p", T.StringType())]))
    assert {r["p"]: r["k"] for r in rows(frame.select("p", scalars.dataset_kind(F.col("p")).alias("k")))} == cases


def test_text_column(spark):
    frame = spark.createDataFrame([("x", "y" * 60, "z" * 90)], "a string, b string, c string")
    assert rows(text_types.find_text_column(frame)) == [{"text_column": "b", "label_column": "a"}]
    assert rows(text_types.find_text_column(frame.select("a"))) == [{"text_column": None, "label_column": None}]


def test_materialize_keeps_every_type(spark):
    from tablevitals.session import materialize

    frame = spark.sql("SELECT 1 AS a, 'x' AS `b c`, array(1, 2) AS d, timestamp_ntz'2024-01-01' AS t, NULL AS nothing, "
                      "INTERVAL '3' DAY AS i, CAST(1.5 AS DECIMAL(9, 2)) AS e")
    for columns in (frame.columns, ["a", "b c", "d", "t", "e"]):
        part = frame.select(*[f"`{c}`" for c in columns])
        stored = materialize(part)
        assert stored.dtypes == part.dtypes and rows(stored) == rows(part)


def shuffled_sizes(frame, *keys):
    """Rows per partition where rows meet by their key."""
    return sorted(r["count"] for r in frame.repartition(8, *keys).groupBy(F.spark_partition_id()).count().collect())


def test_copies_of_a_hot_group_leave_tasks_cut(spark):
    """A text on half of all rows: its first copies are found, and no task gets more than a few of its rows."""
    frame = spark.range(0, 40_000, 1, 8).select("id", F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("t"), "id")).alias("text"))
    found = duplicates.duplicate_rows(frame, ["id"], ["text"], 50)
    assert [tuple(r) for r in found.collect()] == [(2 * k, k) for k in range(1, 51)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Partial" in plan and "WindowGroupLimit" in plan
    rows = frame.select(F.col("id").alias("k0"), *duplicates.row_digest(frame, ["text"]))
    handed_on = rows.mapInArrow(_cut_groups, rows.schema)  # what the partial limit does within a task
    sizes = shuffled_sizes(handed_on, "d0", "d1")
    assert sizes[-1] <= 2 * sizes[4]


def _cut_groups(batches, n=51):
    import pyarrow as pa

    table = pa.Table.from_batches(batches).to_pandas().sort_values("k0")
    for batch in pa.Table.from_pandas(table.groupby(["d0", "d1"]).head(n), preserve_index=False).to_batches():
        yield batch


@pytest.mark.parametrize("n", [3, 1200])
def test_copies_by_subset_are_numbered_in_order(spark, n):
    frame = spark.createDataFrame([(k, [None, "a", "b", "a"][k % 4]) for k in range(3000)] + [(5000, "once"), (5001, "b")], "id long, s string")
    seen, want = {}, []
    for row in sorted(frame.collect()):
        if row.s in seen:
            want.append((row.id, seen[row.s]))
        seen[row.s] = seen.get(row.s, 0) + 1
    assert [tuple(r) for r in duplicates.duplicate_rows(frame.repartition(5), ["id"], ["s"], n).collect()] == want[:n]


def test_correlation_of_two_thousand_columns(spark, tmp_path, monkeypatch):
    """Columns go in tiles: no task hands in more pairs than a tile has, and all pairs are right."""
    k = 2000
    draw = np.random.default_rng(1)
    data = draw.normal(size=(40, k))
    data[3, 7] = np.nan
    data[:, 11] = data[:, 1500] * 2 + 1
    pd.DataFrame(data, columns=[f"c{i}" for i in range(k)]).to_parquet(f"{tmp_path}/wide.parquet")
    frame = spark.read.parquet(f"{tmp_path}/wide.parquet")
    means = np.nanmean(data, axis=0)
    sums = correlation.pair_sums(frame, frame.columns, means)
    most = correlation.TILE ** 2
    parts = sums.groupBy(F.floor(F.col("i") / correlation.TILE), F.floor(F.col("j") / correlation.TILE)).count().collect()
    assert len(parts) == 10 and max(r["count"] for r in parts) <= most and sum(r["count"] for r in parts) == k * (k - 1) // 2
    some = sums.where("(i = 11 AND j = 1500) OR (i = 7 AND j = 1999) OR (i = 0 AND j = 1)").collect()
    for r in some:
        both = data[~np.isnan(data[:, r.i]) & ~np.isnan(data[:, r.j])]
        want = np.corrcoef(both[:, r.i], both[:, r.j])[0, 1]
        got = (r.sij - r.si * r.sj / r.n) / np.sqrt((r.sii - r.si ** 2 / r.n) * (r.sjj - r.sj ** 2 / r.n))
        assert got == pytest.approx(want, abs=1e-9)
    assert len(some) == 3


def test_tiles_change_no_correlation(spark, monkeypatch):
    frame = spark.range(200).select(*[F.sin(F.col("id") * (i + 1)).alias(f"c{i}") for i in range(7)], F.when(
        F.col("id") % 3 > 0, F.cos("id")).alias("gaps"))
    whole = {(r.feature1, r.feature2): r.correlation for r in correlation.correlation_pairs(frame).collect()}
    monkeypatch.setattr(correlation, "TILE", 3)
    tiled = {(r.feature1, r.feature2): r.correlation for r in correlation.correlation_pairs(frame).collect()}
    assert tiled == pytest.approx(whole, abs=1e-12) and len(tiled) == 28


def test_exact_two_sample_distance(spark):
    draw = np.random.default_rng(6)
    old, new = np.round(draw.normal(size=500), 1), np.round(draw.normal(0.3, 2, size=300), 1)
    frames = [spark.createDataFrame([(float(v),) for v in x] + [(None,), (float("inf"),)], "x double").repartition(4) for x in (old, new)]
    values = np.unique(np.concatenate([old, new]))
    want = max(abs((old <= v).mean() - (new <= v).mean()) for v in values)
    row = drift.kolmogorov_smirnov(*frames, ["x"]).first()
    assert row.ks == pytest.approx(want, abs=1e-12)


def test_texts_that_were_decoded_twice(spark):
    good = ["plain", "café", "«É» dit-il", "naïve – “quote”", "Straße", "漢字", "", "price €5", "tilde ˜", "é"]
    bad = ["cafÃ©", "naÃ¯ve and 漢", "itâ€™s", "StraÃŸe", "æ¼¢å­—", "ðŸ˜€"]
    frame = spark.createDataFrame([(t, t in bad) for t in good + bad], "t string, bad boolean")
    wrong = frame.where(text_types.double_encoded(F.col("t")) != F.col("bad")).collect()
    assert wrong == []
    row = text_types.encoding_checks(frame.unionByName(frame.sparkSession.createDataFrame([(None, None), ("x�", None)], frame.schema))).first()
    assert (row.column, row.n, row.replaced, row.double_encoded, row.broken) == ("t", len(good + bad) + 1, 1, len(bad), len(bad) + 1)
    assert text_types.encoding_checks(spark.range(3)).collect() == []


def test_importance_of_columns(spark):
    rows = spark.range(4000).select(
        (F.col("id") % 2).alias("label"), (F.col("id") % 2 * 3.0).alias("same"), F.lit(1.5).alias("constant"), F.lit(None).cast("double").alias("empty"),
        F.when(F.col("id") % 2 == 0, "even").alias("word"), F.concat(F.lit("n"), "id").alias("name"),
        F.when(F.col("id") % 4 < 2, float("inf")).otherwise(1.0).alias("infinite"), (F.floor(F.col("id") / 2) % 7).alias("nothing"))
    found = by_column(importance.feature_importance(rows.union(rows.limit(3).withColumn("label", F.lit(None).cast("long"))), "label"))
    assert found["same"]["importance"] == pytest.approx(1) and found["word"]["mutual_information"] == pytest.approx(np.log(2), rel=1e-3)
    for name in ("constant", "empty", "nothing", "infinite"):
        assert found[name]["importance"] == pytest.approx(0, abs=1e-5)
    assert found["name"]["importance"] is None and "label" not in found
    flat = by_column(importance.feature_importance(rows.withColumn("label", F.lit(1)), "label"))
    assert flat["same"]["importance"] is None and importance.feature_importance(rows.select("label"), "label").collect() == []
