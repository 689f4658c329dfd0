"""The whole audit: load, profile, check, detect, score, report."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablevitals.config import Config, Thresholds
from tablevitals.functions.columns import pick_target
from tablevitals.functions.scalars import round_exact
from tablevitals.operators.anomaly.detect import Detection, anomaly_threshold, detect
from tablevitals.operators.classes import MAX_CLASSES, class_distribution, label_values
from tablevitals.operators.correlation import HIGH_CORRELATION, correlation_matrix
from tablevitals.operators.duplicates import copies_of, count_of, list_of
from tablevitals.operators.histogram import histogram
from tablevitals.operators.missing import missing_pattern
from tablevitals.operators.moments import numeric_moments
from tablevitals.operators.outliers import fences_of, iqr_outliers
from tablevitals.operators.profile import column_profile
from tablevitals.operators.quantiles import quantile_values
from tablevitals.plans.checks import rated
from tablevitals.plans.scoring import (COMPONENTS, health_score, key_findings, recommendations, score_details,
                                       score_formula, weighted_components)
from tablevitals.session import delete, materialize, scratch, spread
from tablevitals.sources.metadata import dataset_metadata
from tablevitals.sources.readers import Dataset, load
from tablevitals.sources.writers import save_flags, save_json


QUARTILES = (0.25, 0.5, 0.75)

#: Bins of the anomaly score plot (fixed value).
SCORE_BINS = 50


@dataclass
class Profile:
    """What an audit has found out about a table: small tables, worked out once and kept.

    ``columns``: see ``column_profile``; ``statistics``: moments and median per numeric column; ``correlations``: the
    whole matrix; ``outliers``: per numeric column; ``classes``: rows per label, if the table has a label column;
    ``first_duplicates``: the first hundred, if a key was given.
    """

    df: DataFrame
    columns: DataFrame
    statistics: DataFrame | None
    quartiles: dict[str, list[float | None]]
    correlations: DataFrame | None
    outliers: DataFrame
    classes: DataFrame
    target: str
    n_rows: int
    n_duplicates: int
    first_duplicates: DataFrame | None = None
    key: Sequence[str] = ()

    @property
    def missing(self) -> DataFrame:
        return (self.columns.filter("missing > 0").select("column", "missing", "missing_pct")
                .orderBy(F.desc("missing_pct"), "column"))

    @property
    def high_correlations(self) -> DataFrame:
        """Each pair once, as the matrix holds it in column order."""
        places = self.columns.select("column", "position")  # one row per column

        def placed(pairs: DataFrame, feature: str) -> DataFrame:
            return pairs.join(F.broadcast(places.toDF(feature, f"{feature}_place")), feature)

        high = self.correlations.filter(F.abs("correlation") > HIGH_CORRELATION)
        return placed(placed(high, "feature1"), "feature2").filter("feature1_place < feature2_place").select(
            self.correlations.columns)

    def names(self, role: str) -> list[str]:
        return [row["column"] for row in self.columns.filter(F.col("role") == role).orderBy("position").collect()]


@dataclass
class AuditResult:
    """``report`` and ``scores`` are one row each; ``detection`` holds the labels and scores per row.

    What isn't written to an output folder lies in ``scratch`` until ``close``.
    """

    report: DataFrame
    scores: DataFrame | None
    profile: Profile | None
    detection: Detection | None
    metadata: DataFrame | None = None
    paths: dict[str, str] = field(default_factory=dict)
    scratch: str | None = None

    def close(self) -> None:
        if self.scratch:
            delete(self.report.sparkSession, self.scratch)
            self.scratch = None


def _kept(rows: list[Row], like: DataFrame) -> DataFrame:
    """A small table as plain rows: no later use computes it again."""
    return like.sparkSession.createDataFrame(rows, like.schema)


def profile_table(df: DataFrame, key: Sequence[str] = (), config: Config = Config(),
                  target: str | None = None) -> Profile:
    """Profile a table, every part of it once. A table of few partitions is first spread over all cores."""
    return _profile(spread(df), key, config, target)


def _profile(df: DataFrame, key: Sequence[str], config: Config, target: str | None, scores_only: bool = False,
             fences: dict | None = None) -> Profile:
    """``scores_only`` leaves out what no score needs: moments, correlations and the list of duplicates."""
    spark, target = df.sparkSession, target or pick_target(df)

    def kept(frame: DataFrame) -> DataFrame:
        return _kept(frame.collect(), frame)

    def start(work, *args, **options):
        return pool.submit(inheritable_thread_target(spark)(work), *args, **options)

    with ThreadPoolExecutor(5) as pool:  # independent jobs, which fill each other's idle cores
        quartiles = start(quantile_values, df, QUARTILES, method=config.quantile_method) if fences is None else None
        profiled = start(lambda: kept(column_profile(df)))
        moments = None if scores_only else start(lambda: kept(numeric_moments(df)))
        correlations = None if scores_only else start(lambda: materialize(correlation_matrix(df)))
        copies = start(lambda: count_of(copies_of(df)) if scores_only else materialize(copies_of(df, keep=key)))
        columns = profiled.result()
        found = columns.collect()  # one row per column
        labels = start(lambda: kept(_label_counts(df, target, found)))
        if fences is None:
            fences = {c: fences_of(q[0], q[2]) for c, q in quartiles.result().items()}
        checked = [c for c in fences if c not in config.exclude]
        outliers = start(lambda: kept(iqr_outliers(df, checked, fences=fences)))
        n_rows, repeated = found[0]["n_rows"] if found else 0, copies.result()
        if scores_only:
            return Profile(df, columns, None, {}, None, outliers.result(), labels.result(), target, n_rows, repeated)
        medians = [(c, values[1]) for c, values in quartiles.result().items()]
        median = spark.createDataFrame(medians, "column string, median double")
        first = kept(list_of(repeated, key, 100)) if key else None
        return Profile(
            df, columns, kept(moments.result().join(F.broadcast(median), "column")), quartiles.result(),
            correlations.result(), outliers.result(), labels.result(), target, n_rows, count_of(repeated), first, key)


def _label_counts(df: DataFrame, target: str, profiled: list[Row]) -> DataFrame:
    """Rows per label: MAX_CLASSES of them at most, one more than a label column may have."""
    few = next(row["few_values"] for row in profiled if row["column"] == target)
    return class_distribution(df, target).limit(MAX_CLASSES if few else 0)


def _measured(profile: Profile) -> DataFrame:
    """The row that the rules rate, from what the profile holds."""
    found, outliers, classes = (frame.collect() for frame in (profile.columns, profile.outliers, profile.classes))
    is_label = 0 < len(classes) < MAX_CLASSES
    counts = [row["count"] for row in classes]
    texts = [row["column"] for row in found if row["numeric_as_string"]]
    values = (profile.n_rows, len(found), sum(row["missing"] for row in found), sum(row["n_rows"] for row in found),
              profile.n_duplicates, profile.target, len(classes) if is_label else None,
              max(counts) / min(counts) if is_label else None,
              sum(row["outliers"] for row in outliers) if outliers else None,
              sum(row["n_rows"] for row in outliers), [f"{c}: numeric values stored as strings" for c in sorted(texts)])
    row = profile.df.sparkSession.createDataFrame(
        [values], "n_rows long, n_columns int, total_missing long, cells long, n_duplicates long, target string, "
                  "n_classes long, imbalance_ratio double, total_outliers long, checked long, issues array<string>")

    def percent(part: str, whole: str):
        return F.try_divide(part, whole) * 100

    return row.select(
        F.struct("n_rows", "n_columns", "total_missing",
                 round_exact(percent("total_missing", "cells"), 2).alias("missing_percentage")).alias("missing"),
        F.struct("n_duplicates", round_exact(percent("n_duplicates", "n_rows"), 2).alias("duplicate_percentage")).alias(
            "duplicates"),
        F.struct("target", "n_classes", "imbalance_ratio").alias("balance"),
        F.struct("total_outliers", percent("total_outliers", "checked").alias("outlier_share")).alias("outliers"),
        F.struct(F.when(F.size("issues") == 0, "good").otherwise("fair").alias("status"), "issues").alias("types"))


def table_metrics(df: DataFrame, thresholds: Thresholds = Thresholds(), method: str = "exact", target: str | None = None,
                  fences: dict | None = None, exclude: Sequence[str] = ()) -> DataFrame:
    """One metrics row for the scoring rules, worked out here: the same fused passes that an audit makes."""
    config = Config(thresholds=thresholds, quantile_method=method, exclude=tuple(exclude))
    return rated(_measured(_profile(spread(df), (), config, target, scores_only=True, fences=fences)), thresholds)


def score_table(df: DataFrame, detection: Detection | None = None, config: Config = Config(),
                target: str | None = None, fences: dict | None = None) -> DataFrame:
    """One scored row of a table; the anomaly columns are filled in when a detection is given."""
    metrics = table_metrics(df, config.thresholds, config.quantile_method, target, fences, config.exclude)
    if detection is not None and detection.usable:
        found = detection.summary().select(F.struct("*").alias("s")).scalar()
        metrics = metrics.withColumns({"anomaly_percentage": found["anomaly_percentage"],
                                       "n_anomalies": found["n_anomalies"]})
    return score_details(health_score(metrics, config.weights))


def audit_table(df: DataFrame, key: Sequence[str] = (), config: Config = Config(),
                target: str | None = None) -> AuditResult:
    """Audit a table. ``key`` names the columns that identify a row, for the per-row results.

    The profile, the detectors' scores and the scored row are worked out here, once each; the report and the plot
    tables are put together from them.
    """
    data = spread(df)
    with ThreadPoolExecutor(1) as pool:
        found = pool.submit(inheritable_thread_target(df.sparkSession)(detect), data, key, config=config, spread=False) \
            if config.detectors else None
        profile = _profile(data, key, config, target)
        detection = found.result() if found else None
    metrics = rated(_measured(profile), config.thresholds)
    summary = detection.summary().first() if detection and detection.usable else None
    if summary:
        metrics = metrics.withColumns({"anomaly_percentage": F.lit(summary["anomaly_percentage"]),
                                       "n_anomalies": F.lit(summary["n_anomalies"])})
    scored = score_details(health_score(metrics, config.weights))
    scores = _kept(scored.collect(), scored)
    return AuditResult(_report(scores, profile, detection, config), scores, profile, detection)


def _report(scores: DataFrame, profile: Profile, detection: Detection | None, config: Config) -> DataFrame:
    """One nested row, all of it from values that are known by now."""
    spark = scores.sparkSession
    lists: dict[str, tuple[list, T.DataType]] = {}

    def listed(name: str, frame: DataFrame | None) -> None:
        if frame is not None:
            lists[name] = (frame.collect(), frame.schema)

    listed("missing_columns", profile.missing)
    listed("first", profile.first_duplicates)
    listed("statistics", profile.statistics.orderBy("column"))
    listed("high_correlations", profile.high_correlations.orderBy("feature1", "feature2"))
    listed("outliers_per_column", profile.outliers.select("column", "lower", "upper", "outliers"))
    label = profile.classes if profile.classes.count() < MAX_CLASSES else profile.classes.limit(0)
    listed("class_distribution", label.withColumn("label", F.col("label").cast("string")))
    lists["detectors"] = (_detector_rows(detection), T._parse_datatype_string(
        "detector string, status string, n_anomalies bigint, anomaly_percentage double, threshold double"))
    shares = config.weights.normalized()
    weights = T._parse_datatype_string(", ".join(f"{c} double" for c in shares))
    roles = {f"{role}_columns": profile.names(role) for role in ("numeric", "categorical", "datetime")}
    names = [row["column"] for row in profile.columns.orderBy("position").collect()]
    n_bytes = sum(row["bytes"] or 0 for row in profile.columns.collect())
    known = spark.createDataFrame(
        [(*[rows for rows, _ in lists.values()], tuple(shares.values()), *roles.values(), names, n_bytes,
          *scores.first())],
        T.StructType([*[T.StructField(n, T.ArrayType(kind)) for n, (_, kind) in lists.items()],
                      T.StructField("weights", weights),
                      *[T.StructField(n, T.ArrayType(T.StringType())) for n in (*roles, "column_names")],
                      T.StructField("bytes", T.LongType()), *scores.schema.fields]))
    check_columns = ["missing_percentage", "duplicate_percentage", "imbalance_ratio", "outlier_percentage"]
    check_columns += [c for c in scores.columns if c.endswith(("_status", "_severity", "_issues"))]
    score_columns = ["overall_score", "rating", "recommendation", "integrity_source", *COMPONENTS]
    score_columns += [f"{c}_details" for c in COMPONENTS]
    return known.select(
        F.struct(
            F.struct("n_rows", "n_columns", "bytes", F.col("column_names").alias("columns")).alias("basic_info"),
            F.struct("total_missing", "missing_percentage", F.col("missing_columns").alias("columns")).alias("missing_values"),
            F.struct("n_duplicates", "duplicate_percentage", *["first"] * ("first" in lists)).alias("duplicates"),
            F.struct(*roles).alias("data_types"),
            "statistics", "high_correlations",
        ).alias("profile"),
        F.struct(*check_columns, "target", "class_distribution", "outliers_per_column").alias("checks"),
        F.struct("anomaly_percentage", "n_anomalies", "detectors").alias("anomalies"),
        F.struct(*score_columns, "weights", score_formula(config.weights).alias("calculation")).alias("scores"),
        recommendations().alias("recommendations"),
        key_findings().alias("key_findings"),
        F.current_timestamp().alias("timestamp"),
    )


def _detector_rows(detection: Detection | None) -> list[tuple]:
    """detector, status, n_anomalies, anomaly_percentage, threshold of each detector."""
    if detection is None:
        return []
    good = [n for n, state in detection.status.items() if state == "ok"]
    counted = {}
    if good:
        row = detection.rows.agg(F.count(F.lit(1)).alias("n"), *[F.sum(f"{n}_label").alias(n) for n in good]).select(
            *[F.struct(F.col(n).alias("n"), round_exact(F.try_divide(n, "n") * 100, 2).alias("share")).alias(n)
              for n in good]).first()
        counted = {n: (row[n]["n"], row[n]["share"], float(detection.thresholds[n])) for n in good}
    return [(n, state, *counted.get(n, (None, None, None))) for n, state in detection.status.items()]


def plot_tables(result: AuditResult) -> dict[str, DataFrame]:
    """The numbers behind each plot of an audited table: small tables whatever the table's size."""
    profile, detection = result.profile, result.detection
    numeric = profile.names("numeric")
    tables = {
        "components": weighted_components(result.scores, ["overall_score", "rating"]),
        "missing_values": profile.missing,
        "correlations": profile.correlations,
    }
    if numeric:
        tables["feature_distributions"] = histogram(profile.df)
    position = next((k for k in profile.key if k in numeric), None)
    if position:
        tables["missing_pattern"] = missing_pattern(profile.df, position)
    # Only a label column has a class plot; the others would have as many bars as values.
    is_label = 0 < profile.classes.count() < MAX_CLASSES
    tables["class_distribution"] = profile.classes if is_label else profile.classes.limit(0)
    if detection and detection.usable:
        cut = anomaly_threshold(detection.rows).first()["threshold"]
        scores = histogram(detection.rows, ["anomaly_score"], SCORE_BINS)
        tables["anomaly_scores"] = scores.withColumn("threshold", F.lit(cut))
    return tables


def audit_dataset(spark: SparkSession, path: str, output: str | None = None, key: Sequence[str] = (),
                  config: Config = Config(), kind: str | None = None, format: str | None = None,
                  multiline: bool = False) -> AuditResult:
    """Load a dataset, audit it and write report, plot tables and per-row flags below ``output``.

    Texts and images have no table checks; their report holds the metadata and no score, and their labels are a table. What the audit itself
    writes goes when it is done; without ``output`` the result needs it, so it goes with ``result.close()``.
    """
    with scratch(spark, keep=output is None) as folder:
        result = _audit_dataset(spark, path, output, key, config, kind, format, multiline)
        result.scratch = None if output else folder
        return result


def _audit_dataset(spark, path, output, key, config, kind, format, multiline) -> AuditResult:
    dataset: Dataset = load(spark, path, kind, format, multiline)
    metadata = dataset_metadata(dataset)
    metadata = _kept(metadata.collect(), metadata)
    if dataset.kind != "tabular":
        result = AuditResult(metadata, None, None, None, metadata)
        if output:
            result.paths["report"] = f"{output.rstrip('/')}/audit_report"
            save_json(metadata, result.paths["report"])
            if "label" in dataset.data.columns:
                result.paths["labels"] = f"{output.rstrip('/')}/labels"
                save_json(label_values(dataset.data, "label"), result.paths["labels"])
        return result
    # An audit reads the table several times, a few columns at a time; what can't be read so is copied once.
    result = audit_table(dataset.data if dataset.columnar else materialize(dataset.data), key, config)
    result.metadata = metadata
    described = metadata.select(F.struct("*").alias("r")).scalar()
    result.report = result.report.select(described.alias("metadata"), "*")
    if not output:
        return result
    result.paths["report"] = f"{output.rstrip('/')}/audit_report"
    save_json(result.report, result.paths["report"])
    for name, plot in plot_tables(result).items():
        result.paths[name] = f"{output.rstrip('/')}/plots/{name}"
        save_json(plot, result.paths[name])
    profile = result.profile
    profile.correlations = spark.read.schema(profile.correlations.schema).json(result.paths["correlations"])
    profile.df = dataset.data
    if result.detection and result.detection.usable:
        result.paths["flags"] = f"{output.rstrip('/')}/anomaly_flags"
        save_flags(result.detection.rows, result.paths["flags"])
        result.detection.rows = spark.read.parquet(result.paths["flags"])
    return result
