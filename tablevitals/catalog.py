"""The registered queries: every operator on the driver's tables, with its SQL counterpart.

Most run on ``dirty``, a view of lineitem with missing cells, duplicate rows, price spikes, numbers
stored as text and an uneven label, because the shipped tables have none of these.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablevitals.config import AutoencoderParams, Config, Thresholds
from tablevitals.functions import scalars
from tablevitals.functions.columns import normalize, union_all
from tablevitals.operators import (classes, correlation, drift, duplicates, features, histogram, importance, missing, moments, outliers,
                                   profile, quantiles, text_types)
from tablevitals.operators.anomaly import detect as anomaly
from tablevitals.operators.anomaly.embeddings import embedding_outliers
from tablevitals.operators.anomaly.forest import fit_forest, forest_score
from tablevitals.operators.anomaly.network import fit_network, network_error
from tablevitals.operators.anomaly.reconstruction import fit_pca, pca_error
from tablevitals.plans import checks, incremental, scoring
from tablevitals.plans.audit import audit_table, plot_tables, score_table
from tablevitals.session import materialize, scratch_path, spread
from tablevitals.sources import metadata, readers, writers
from tablevitals.sources.sample_data import sample_rows
from tablevitals.streaming.quality import run_to_end, window_quality

KEY = ["l_orderkey", "l_linenumber"]
DIRTY_NUMERIC = ["l_orderkey", "l_linenumber", "quantity", "qty_scaled", "price", "target"]

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query and, where SQL can say the same, its oracle."""
    def register(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function
    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return readers.scan_parquet(spark, f"{sf}/{name}.parquet")


def dirty(spark: SparkSession, sf: str) -> DataFrame:
    """lineitem with flaws; the duplicate rows come from repeating rows within the one scan."""
    order = F.col("l_orderkey")
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber",
        F.when(order % 13 != 0, F.col("l_quantity")).alias("quantity"),
        (F.col("l_quantity") * 2 + F.col("l_tax")).alias("qty_scaled"),
        F.when(order % 997 == 0, F.col("l_extendedprice") * 20).otherwise(F.col("l_extendedprice")).alias("price"),
        F.when(order % 17 != 0, F.col("l_returnflag")).alias("returnflag"),
        F.col("l_quantity").cast("bigint").cast("string").alias("qty_text"),
        F.when(order % 8 == 0, 1).otherwise(0).alias("target"),
        F.explode(F.array_repeat(F.lit(0), F.when(order % 50 == 0, 2).otherwise(1))).alias("copy"),
    ).drop("copy")


DIRTY = """WITH base AS (
  SELECT l_orderkey, l_linenumber,
    CASE WHEN l_orderkey % 13 = 0 THEN NULL ELSE l_quantity END AS quantity,
    l_quantity * 2 + l_tax AS qty_scaled,
    CASE WHEN l_orderkey % 997 = 0 THEN l_extendedprice * 20 ELSE l_extendedprice END AS price,
    CASE WHEN l_orderkey % 17 = 0 THEN NULL ELSE l_returnflag END AS returnflag,
    CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS qty_text,
    CASE WHEN l_orderkey % 8 = 0 THEN 1 ELSE 0 END AS target
  FROM lineitem),
dirty AS (
  SELECT * FROM base
  UNION ALL
  SELECT * FROM base WHERE l_orderkey % 50 = 0)
"""
DIRTY_COLUMNS = ["l_orderkey", "l_linenumber", "quantity", "qty_scaled", "price", "returnflag", "qty_text", "target"]


def metric_rows(spark: SparkSession, sf: str) -> DataFrame:
    """One row of quality metrics per line item, so that the scoring rules meet all their branches."""
    limits = Thresholds()
    rows = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber",
        (F.col("l_discount") * 300 + F.col("l_orderkey") % 7 / 8).alias("missing_percentage"),
        (F.col("l_tax") * F.col("l_tax") * 2500).alias("duplicate_percentage"),
        F.when(F.col("l_linenumber") < 7, F.col("l_quantity") / 2 + F.col("l_orderkey") % 13 / 40).alias("imbalance_ratio"),
        (F.col("l_extendedprice") / 5000).alias("outlier_percentage"),
        F.when(F.col("l_returnflag") != "N", F.col("l_partkey") % 800 / 20).alias("anomaly_percentage"),
        F.col("l_suppkey").alias("n_anomalies"),
    )
    states = {"missing": ("missing_percentage", limits.missing_values),
              "duplicates": ("duplicate_percentage", limits.duplicates),
              "balance": ("imbalance_ratio", limits.class_imbalance)}
    rows = rows.withColumns({f"{n}_status": checks.status(F.col(c), limit) for n, (c, limit) in states.items()})
    return rows.withColumns({f"{n}_severity": checks.severity(F.col(f"{n}_status")) for n in states})


def _status_sql(value: str, excellent: float, good: float, fair: float) -> str:
    return (f"CASE WHEN {value} IS NULL THEN 'not_applicable' WHEN {value} < {excellent} THEN 'excellent' "
            f"WHEN {value} < {good} THEN 'good' WHEN {value} < {fair} THEN 'fair' ELSE 'poor' END")


def _severity_sql(status: str) -> str:
    return f"CASE WHEN {status} = 'poor' THEN 'high' WHEN {status} = 'fair' THEN 'medium' ELSE 'low' END"


COMPONENTS_SQL = """
    CASE WHEN missing_percentage < 1 THEN 100.0 WHEN missing_percentage < 5 THEN 90.0
      WHEN missing_percentage < 10 THEN 75.0 WHEN missing_percentage < 20 THEN 60.0
      ELSE greatest(0.0, 60.0 - (missing_percentage - 20) * 2) END::DOUBLE AS completeness,
    CASE WHEN duplicate_percentage = 0 THEN 100.0 WHEN duplicate_percentage < 1 THEN 95.0
      WHEN duplicate_percentage < 5 THEN 85.0 WHEN duplicate_percentage < 10 THEN 70.0
      ELSE greatest(0.0, 70.0 - (duplicate_percentage - 10) * 3.5) END::DOUBLE AS consistency,
    CASE WHEN balance_status = 'not_applicable' THEN 100.0 WHEN imbalance_ratio < 2 THEN 100.0
      WHEN imbalance_ratio < 5 THEN 90.0 WHEN imbalance_ratio < 10 THEN 75.0 WHEN imbalance_ratio < 20 THEN 60.0
      ELSE greatest(50.0, 60.0 - (imbalance_ratio - 20) * 0.5) END::DOUBLE AS balance,
    CASE WHEN anomaly_percentage IS NOT NULL THEN
        CASE WHEN anomaly_percentage < 5 THEN 100.0 WHEN anomaly_percentage < 10 THEN 90.0
          WHEN anomaly_percentage < 15 THEN 75.0 WHEN anomaly_percentage < 25 THEN 60.0
          ELSE greatest(40.0, 60.0 - (anomaly_percentage - 25) * 1.5) END
      ELSE CASE WHEN outlier_percentage < 5 THEN 100.0 WHEN outlier_percentage < 10 THEN 90.0
          WHEN outlier_percentage < 15 THEN 75.0 ELSE greatest(50.0, 75.0 - (outlier_percentage - 15)) END
      END::DOUBLE AS integrity,
    CASE WHEN anomaly_percentage IS NULL THEN 'outliers' ELSE 'detectors' END AS integrity_source"""

ADVICE_SQL = """
    printf('%.2f', (overall)::DOUBLE)::DOUBLE AS overall_score,
    CASE WHEN overall >= 90 THEN 'Excellent' WHEN overall >= 80 THEN 'Very Good' WHEN overall >= 70 THEN 'Good'
      WHEN overall >= 60 THEN 'Acceptable' WHEN overall >= 50 THEN 'Fair' ELSE 'Poor' END AS rating,
    CASE WHEN overall >= 90 THEN 'Dataset is production-ready with excellent quality.'
      WHEN overall >= 80 THEN 'Dataset quality is very good and suitable for immediate use.'
      WHEN overall >= 70 THEN
        CASE WHEN completeness = least(completeness, consistency, balance, integrity)
            THEN printf('%.1f%% missing values detected. Apply imputation.', missing_percentage)
          WHEN consistency = least(consistency, balance, integrity)
            THEN printf('%.1f%% duplicates detected. Deduplication recommended.', duplicate_percentage)
          WHEN balance <= integrity THEN printf(
            'Class imbalance detected (%.1f:1). Apply class weights or resampling.', coalesce(imbalance_ratio, 1.0))
          ELSE 'Review detected anomalies to separate valid outliers from errors.' END
      WHEN overall >= 60 THEN 'Dataset usable but requires cleaning before training.'
      WHEN overall >= 50 THEN 'Dataset has multiple quality issues requiring attention.'
      ELSE 'Major quality issues detected. Not suitable for immediate training.' END AS recommendation"""

OVERALL_SQL = "completeness * 0.25::DOUBLE + consistency * 0.25::DOUBLE + balance * 0.25::DOUBLE + integrity * 0.25::DOUBLE"

METRIC_ROWS = f"""WITH measured AS (
  SELECT l_orderkey, l_linenumber,
    l_discount * 300 + (l_orderkey % 7)::DOUBLE / 8 AS missing_percentage,
    l_tax * l_tax * 2500 AS duplicate_percentage,
    CASE WHEN l_linenumber < 7 THEN l_quantity / 2 + (l_orderkey % 13)::DOUBLE / 40 END AS imbalance_ratio,
    l_extendedprice / 5000 AS outlier_percentage,
    CASE WHEN l_returnflag <> 'N' THEN (l_partkey % 800)::DOUBLE / 20 END AS anomaly_percentage,
    l_suppkey AS n_anomalies
  FROM lineitem),
rated AS (
  SELECT *, {_status_sql('missing_percentage', 2, 5, 15)} AS missing_status,
    {_status_sql('duplicate_percentage', 1, 3, 10)} AS duplicates_status,
    {_status_sql('imbalance_ratio', 1.5, 3, 5)} AS balance_status
  FROM measured),
metric_rows AS (
  SELECT *, {_severity_sql('missing_status')} AS missing_severity,
    {_severity_sql('duplicates_status')} AS duplicates_severity,
    {_severity_sql('balance_status')} AS balance_severity
  FROM rated),
components AS (SELECT *, {COMPONENTS_SQL} FROM metric_rows),
overall AS (SELECT *, {OVERALL_SQL} AS overall FROM components),
scored AS (SELECT *, {ADVICE_SQL} FROM overall)
"""

MISSING_SQL = "(" + " UNION ALL ".join(
    f"SELECT {i} AS position, '{c}' AS \"column\", count(*) AS n_rows, count(*) - count({c}) AS missing FROM dirty"
    for i, c in enumerate(DIRTY_COLUMNS)) + ")"
OUTLIERS_SQL = "(" + " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count(*) AS n_rows, min(lower) AS lower, min(upper) AS upper,
    count(*) FILTER (x < lower OR x > upper) AS outliers
  FROM (SELECT {c}::DOUBLE AS x, q1 - 1.5::DOUBLE * (q3 - q1) AS lower, q3 + 1.5::DOUBLE * (q3 - q1) AS upper
    FROM dirty, (SELECT quantile_cont({c}::DOUBLE, 0.25) AS q1, quantile_cont({c}::DOUBLE, 0.75) AS q3 FROM dirty))"""
    for c in DIRTY_NUMERIC) + ")"
PAIRS_SQL = "(" + " UNION ALL ".join(
    f"SELECT '{a}' AS feature1, '{b}' AS feature2, corr({a}, {b}) AS correlation FROM dirty"
    for i, a in enumerate(DIRTY_NUMERIC) for b in DIRTY_NUMERIC[i + 1:]) + ")"
NUMERIC_RE = scalars.NUMERIC_TEXT
TYPES_SQL = "(" + " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", coalesce(bool_and({c} IS NULL OR trim({c}) = ''
      OR regexp_matches(trim({c}), '{NUMERIC_RE}')), true) AS numeric_as_string FROM dirty"""
    for c in ["returnflag", "qty_text"]) + ")"


# Sources ------------------------------------------------------------------------------------------

@query("scan_parquet", "SELECT * FROM documents")
def scan_parquet(spark, sf):
    return table(spark, sf, "documents")


@query("scan_csv_infer", DIRTY + """SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, quantity, qty_scaled,
  price, returnflag, qty_text::BIGINT AS qty_text, target::BIGINT AS target FROM dirty""")
def scan_csv_infer(spark, sf):
    path = scratch_path(spark, "dirty_csv")
    writers.save_csv(dirty(spark, sf), path)
    return readers.scan_csv(spark, path)


@query("scan_json", "SELECT conv_id, turn, role, text FROM conversations")
def scan_json(spark, sf):
    path = scratch_path(spark, "conversations_json")
    writers.save_json(table(spark, sf, "conversations"), path)
    return readers.scan_json(spark, path, lines=True)


@query("load_json_lines", "SELECT conv_id, turn, role, text FROM conversations")
def load_json_lines(spark, sf):
    """A folder of line files, loaded without a hint."""
    path = f"{scratch_path(spark, 'conversations')}.json"
    writers.save_json(table(spark, sf, "conversations").repartition(3), path)
    return readers.load(spark, path).data


@query("load_json_documents", "SELECT conv_id, turn, role, text FROM conversations")
def load_json_documents(spark, sf):
    """One document per conversation, an array over several lines, loaded without a hint."""
    path = f"{scratch_path(spark, 'conversations')}.json"
    turns = table(spark, sf, "conversations").groupBy("conv_id").agg(F.collect_list(F.struct("*")).alias("turns"))
    body = F.replace(F.to_json("turns"), F.lit("},{"), F.lit("},\n{")).alias("value")
    writers.save_text_files(turns.select(body, F.col("conv_id").alias("of")), path, "value", "of")
    return readers.load(spark, path).data.select("conv_id", "turn", "role", "text")


@query("detect_kind", """WITH paths AS (
  SELECT url || ending AS url FROM pages,
    (VALUES (''), ('.csv'), ('.xls'), ('.parquet'), ('.json'), ('.jsonl'), ('.jpeg'), ('.txt')) v(ending)),
suffixed AS (
  SELECT url, lower(regexp_extract(regexp_extract(rtrim(url, '/'), '[^/]*$'), '^.+[.]([^.]+)$', 1)) AS suffix FROM paths)
SELECT url, CASE WHEN suffix IN ('xlsx', 'xls') THEN 'excel' WHEN suffix IN ('jpg', 'jpeg', 'png', 'bmp') THEN 'image'
    WHEN suffix = 'txt' THEN 'text' WHEN suffix IN ('jsonl', 'ndjson') THEN 'json' WHEN suffix IN ('csv', 'parquet', 'json') THEN suffix ELSE 'unknown' END AS file_type,
  CASE WHEN suffix IN ('csv', 'xlsx', 'xls', 'parquet', 'json', 'jsonl', 'ndjson') THEN 'tabular'
    WHEN suffix IN ('jpg', 'jpeg', 'png', 'bmp') THEN 'image' WHEN suffix = 'txt' THEN 'text' ELSE 'unknown' END AS kind
FROM suffixed""")
def detect_kind(spark, sf):
    """Page addresses as they are, and with each kind of suffix."""
    endings = F.array(*[F.lit(s) for s in ["", ".csv", ".XLS", ".parquet", ".json", ".JSONL", ".JPEG", ".txt"]])
    paths = table(spark, sf, "pages").select("url", F.explode(endings).alias("ending"))
    path = F.concat("url", "ending")
    return paths.select(F.concat("url", F.lower("ending")).alias("url"),
                        scalars.file_type(path).alias("file_type"), scalars.dataset_kind(path).alias("kind"))


@query("detect_kind_dir", """SELECT conv_id, n_files, n_images, n_texts, CASE WHEN n_images * 2 > n_files THEN 'image'
  WHEN n_texts * 2 > n_files THEN 'text' ELSE 'tabular' END AS kind
FROM (SELECT conv_id, count(*) AS n_files, count(*) FILTER (conv_id % 4 < 2 AND (turn + conv_id) % 3 = 0) AS n_images,
  count(*) FILTER (conv_id % 4 > 0 AND (turn + conv_id) % 3 > 0) AS n_texts FROM conversations GROUP BY conv_id)""")
def detect_kind_dir(spark, sf):
    """A folder per conversation with a file name per turn: images, texts, tables, and none in the majority."""
    third = (F.col("turn") + F.col("conv_id")) % 3
    of = F.col("conv_id") % 4
    name = F.when((of < 2) & (third == 0), "a.jpg").when((of > 0) & (third > 0), "b.txt").otherwise("c.csv")
    files = table(spark, sf, "conversations").select("conv_id", scalars.dataset_kind(name).alias("kind"))
    return readers.directory_kind(files, ["conv_id"])


@query("scan_text_lines", f"""SELECT trim(line, '{scalars.WHITESPACE}') AS text
FROM (SELECT unnest(regexp_split_to_array(text, '\\r\\n|\\r|\\n')) AS line FROM documents)
WHERE trim(line, '{scalars.WHITESPACE}') <> ''""")
def scan_text_lines(spark, sf):
    path = scratch_path(spark, "lines")
    table(spark, sf, "documents").select("text").write.text(path)
    return readers.scan_text_lines(spark, path)


def _text_files(spark, sf):
    """documents as text files, one per document, named by its id, in a folder per language."""
    path = scratch_path(spark, "corpus")
    docs = spread(table(spark, sf, "documents").select("doc_id", "text", "lang"))
    writers.save_text_files(docs, path, "text", "doc_id", ["lang"])
    return path


@query("scan_text_dir", f"""SELECT 'lang=' || lang AS label, doc_id, trim(text, '{scalars.WHITESPACE}') AS text
FROM documents WHERE trim(text, '{scalars.WHITESPACE}') <> ''""")
def scan_text_dir(spark, sf):
    files = readers.scan_text_dir(spark, _text_files(spark, sf))
    return files.select("label", F.regexp_extract("path", "doc_id=([0-9]+)", 1).cast("long").alias("doc_id"), "text")


@query("find_text_column", """SELECT CASE WHEN avg(length(text)) > 50 THEN 'text' WHEN avg(length(lang)) > 50 THEN 'lang'
  WHEN avg(length(source)) > 50 THEN 'source' END AS text_column,
  CASE WHEN greatest(avg(length(text)), avg(length(lang)), avg(length(source))) > 50 THEN 'doc_id' END AS label_column
FROM documents""")
def find_text_column(spark, sf):
    return text_types.find_text_column(table(spark, sf, "documents"))


@query("dataset_metadata", """SELECT n_samples, 5 AS n_features, position, "column",
  CASE kind WHEN 'BIGINT' THEN 'bigint' WHEN 'VARCHAR' THEN 'string' ELSE kind END AS type
FROM (""" + " UNION ALL ".join(
    f"SELECT count(*) AS n_samples, {i} AS position, '{c}' AS \"column\", typeof(min({c})) AS kind FROM documents"
    for i, c in enumerate(["doc_id", "text", "lang", "source", "n_chars"])) + ")")
def dataset_metadata(spark, sf):
    return metadata.table_metadata(table(spark, sf, "documents"))


@query("dataset_metadata_texts", f"""SELECT 'text' AS dataset_type, count(*) FILTER (trim(text, '{scalars.WHITESPACE}') <> '') AS n_samples,
  count(DISTINCT lang) AS n_classes, printf('%.2f', (sum(strlen(text) + 1) / 1048576.0)::DOUBLE)::DOUBLE AS file_size_mb
FROM documents""")
def dataset_metadata_texts(spark, sf):
    """A folder of text files, loaded as such: samples, labels and bytes of its files."""
    found = metadata.dataset_metadata(readers.load(spark, _text_files(spark, sf), kind="text"))
    return found.select("dataset_type", "n_samples", "n_classes", "file_size_mb")


@query("label_metadata", "SELECT count(*) AS n_samples, count(DISTINCT lang) AS n_classes FROM documents")
def label_metadata(spark, sf):
    return metadata.label_metadata(table(spark, sf, "documents"), "lang")


@query("label_values", "SELECT source AS label, count(*) AS count FROM documents GROUP BY source")
def label_values(spark, sf):
    return classes.label_values(table(spark, sf, "documents"), "source")


@query("preview_topn", "SELECT * FROM customer ORDER BY c_custkey LIMIT 5")
def preview_topn(spark, sf):
    return metadata.preview(table(spark, sf, "customer"), 5, ["c_custkey"])


@query("gen_sample")
def gen_sample(spark, sf):
    """A synthetic row for every order."""
    ids = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"))
    return sample_rows(ids, ids.count(), keep=("id",))


@query("gen_sample_facts", """SELECT count(*) AS n_rows, 13 AS n_columns, true AS missing_share, true AS categories,
  true AS minority_share, true AS centred FROM orders""")
def gen_sample_facts(spark, sf):
    """What is laid down about the synthetic rows: their number and columns, and shares up to chance."""
    rows = gen_sample(spark, sf)
    features = [c for c in rows.columns if c.startswith("feature_")]
    cells = [F.avg(F.col(c).isNull().cast("int")).between(0.04, 0.06) for c in features]
    return rows.agg(
        F.count(F.lit(1)).alias("n_rows"), F.lit(len(rows.columns)).alias("n_columns"),
        reduce(and_, cells).alias("missing_share"),
        (F.sort_array(F.collect_set("category")) == F.array(*map(F.lit, "ABC"))).alias("categories"),
        F.avg("target").between(0.27, 0.33).alias("minority_share"),
        reduce(and_, [F.abs(F.avg(c)) < 0.2 for c in features]).alias("centred"))


# Sinks --------------------------------------------------------------------------------------------

@query("sink_json_roundtrip", "SELECT * FROM customer")
def sink_json_roundtrip(spark, sf):
    data, path = table(spark, sf, "customer"), scratch_path(spark, "customer_json")
    writers.save_json(data, path)
    return writers.load_json(spark, path, data.schema)


@query("sink_csv_roundtrip", """SELECT p_partkey, p_name, p_brand, p_type, p_size::BIGINT AS p_size, p_retailprice
FROM part""")
def sink_csv_roundtrip(spark, sf):
    path = scratch_path(spark, "part_csv")
    writers.save_csv(table(spark, sf, "part"), path)
    return readers.scan_csv(spark, path)


@query("sink_flags_roundtrip", """SELECT o_orderkey,
  CASE WHEN o_totalprice > (SELECT quantile_cont(o_totalprice, 0.95) FROM orders) THEN 1 ELSE 0 END AS anomaly_label,
  round((o_totalprice - (SELECT min(o_totalprice) FROM orders))
    / ((SELECT max(o_totalprice) - min(o_totalprice) FROM orders) + 1e-8::DOUBLE), 9) AS anomaly_score
FROM orders""")
def sink_flags_roundtrip(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    flagged = anomaly.minmax_score(anomaly.percentile_labels(orders, "o_totalprice", 0.95), "o_totalprice")
    path = scratch_path(spark, "flags")
    writers.save_flags(flagged.select("o_orderkey", "anomaly_label", F.round("anomaly_score", 9).alias("anomaly_score")), path)
    return spark.read.parquet(path)


# Projections and filters --------------------------------------------------------------------------

PROFILE_SQL = "(" + " UNION ALL ".join(
    f"""SELECT {i} AS position, '{c}' AS "column", '{kind}' AS type, '{role}' AS role, count(*) AS n_rows,
    count(*) - count({c}) AS missing, printf('%.2f', ((count(*) - count({c})) / count(*) * 100)::DOUBLE)::DOUBLE AS missing_pct,
    ({'sum(strlen(' + c + '))' if kind == 'string' else f'count(*) * {width}'})::BIGINT AS bytes,
    {'NULL::DOUBLE' if kind == 'string' else f'min({c})::DOUBLE'} AS min,
    {'NULL::DOUBLE' if kind == 'string' else f'max({c})::DOUBLE'} AS max,
    {'NULL::DOUBLE' if kind == 'string' else f'round(avg({c}), 6)'} AS mean, count(DISTINCT {c}) <= 64 AS few_values,
    {'bool_and(coalesce(' + c + " ~ '[0-9]+', true))" if kind == 'string' else 'NULL::BOOLEAN'} AS numeric_as_string
  FROM dirty""" for i, (c, kind, role, width) in enumerate([
    ("l_orderkey", "bigint", "numeric", 8), ("l_linenumber", "int", "numeric", 4), ("quantity", "double", "numeric", 8),
    ("qty_scaled", "double", "numeric", 8), ("price", "double", "numeric", 8), ("returnflag", "string", "categorical", 0),
    ("qty_text", "string", "categorical", 0), ("target", "int", "numeric", 4)])) + ")"


@query("column_profile", DIRTY + f"SELECT * FROM {PROFILE_SQL}")
def column_profile(spark, sf):
    return profile.column_profile(dirty(spark, sf)).withColumn("mean", F.round("mean", 6))


@query("categorical_columns", DIRTY + """SELECT position, "column", CASE WHEN text THEN NULL ELSE n END AS n_distinct
FROM (""" + " UNION ALL ".join(
    f"SELECT {i} AS position, '{c}' AS \"column\", {str(c in ('returnflag', 'qty_text')).lower()} AS text, "
    f"count(DISTINCT {c}) AS n FROM dirty" for i, c in enumerate(DIRTY_COLUMNS)) + ") WHERE text OR n <= 10")
def categorical_columns(spark, sf):
    return classes.categorical_columns(dirty(spark, sf))


@query("normalize_nan", """SELECT event_id, CASE WHEN value > 10 THEN NULL ELSE value END AS value FROM events""")
def normalize_nan(spark, sf):
    events = table(spark, sf, "events").select(
        "event_id", F.when(F.col("value") > 10, F.lit(float("nan"))).otherwise(F.col("value")).alias("value"))
    return normalize(events)


@query("impute_zero", DIRTY + """SELECT l_orderkey, l_linenumber, coalesce(quantity, 0.0::DOUBLE) AS quantity, price,
  target::DOUBLE AS target FROM dirty""")
def impute_zero(spark, sf):
    return features.impute_zero(dirty(spark, sf), ["quantity", "price", "target"], KEY)


@query("standard_scale", DIRTY + """SELECT l_orderkey, l_linenumber,
  round((coalesce(quantity, 0) - (SELECT avg(coalesce(quantity, 0)) FROM dirty))
    / (SELECT stddev_pop(coalesce(quantity, 0)) FROM dirty), 6) AS quantity,
  round((price - (SELECT avg(price) FROM dirty)) / (SELECT stddev_pop(price) FROM dirty), 6) AS price,
  round((target - (SELECT avg(target) FROM dirty)) / (SELECT stddev_pop(target) FROM dirty), 6) AS target
FROM dirty""")
def standard_scale(spark, sf):
    scaled = features.standard_scale(dirty(spark, sf), ["quantity", "price", "target"], KEY)
    return scaled.select(*KEY, *[F.round(c, 6).alias(c) for c in ["quantity", "price", "target"]])


@query("duplicate_rows_top100", DIRTY + """SELECT l_orderkey, l_linenumber, (rn - 1)::INTEGER AS copy FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber, quantity, qty_scaled, price, returnflag, qty_text,
    target ORDER BY l_orderkey, l_linenumber) AS rn FROM dirty)
WHERE rn > 1 ORDER BY l_orderkey, l_linenumber, rn LIMIT 100""")
def duplicate_rows_top100(spark, sf):
    return duplicates.duplicate_rows(dirty(spark, sf), KEY)


@query("duplicate_texts_top100", """SELECT doc_id, (rn - 1)::INTEGER AS copy FROM (
  SELECT doc_id, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn FROM documents)
WHERE rn > 1 ORDER BY doc_id LIMIT 100""")
def duplicate_texts_top100(spark, sf):
    return duplicates.duplicate_rows(table(spark, sf, "documents"), ["doc_id"], ["text"])


@query("duplicate_orders_top5000", """SELECT o_orderkey, (rn - 1)::INTEGER AS copy FROM (
  SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderstatus, o_orderpriority ORDER BY o_orderkey) AS rn FROM orders)
WHERE rn > 1 ORDER BY o_orderkey LIMIT 5000""")
def duplicate_orders_top5000(spark, sf):
    """A few groups that hold all rows, and a long list."""
    return duplicates.duplicate_rows(table(spark, sf, "orders"), ["o_orderkey"], ["o_orderstatus", "o_orderpriority"], n=5000)


@query("iqr_keep_mask", DIRTY + """SELECT l_orderkey, l_linenumber,
  coalesce(quantity BETWEEN q1 - 1.5::DOUBLE * (q3 - q1) AND q3 + 1.5::DOUBLE * (q3 - q1), false) AS quantity_ok,
  price BETWEEN p1 - 1.5::DOUBLE * (p3 - p1) AND p3 + 1.5::DOUBLE * (p3 - p1) AS price_ok
FROM dirty, (SELECT quantile_cont(quantity, 0.25) AS q1, quantile_cont(quantity, 0.75) AS q3,
  quantile_cont(price, 0.25) AS p1, quantile_cont(price, 0.75) AS p3 FROM dirty)""")
def iqr_keep_mask(spark, sf):
    return outliers.iqr_keep_mask(dirty(spark, sf), ["quantity", "price"], KEY)


@query("high_correlations", DIRTY + f"""SELECT feature1, feature2, round(correlation, 6) AS correlation
FROM {PAIRS_SQL} WHERE abs(correlation) > 0.8""")
def high_correlations(spark, sf):
    found = correlation.high_correlations(dirty(spark, sf))
    return found.withColumn("correlation", F.round("correlation", 6))


# Aggregations -------------------------------------------------------------------------------------

@query("basic_info", DIRTY + f"""SELECT count(*) AS n_rows, 8 AS n_columns, '{','.join(DIRTY_COLUMNS)}' AS column_names
FROM dirty""")
def basic_info(spark, sf):
    return missing.basic_info(dirty(spark, sf))


@query("logical_size", DIRTY + """SELECT "column", bytes, printf('%.2f', (bytes / 1048576.0::DOUBLE)::DOUBLE)::DOUBLE AS mb FROM (""" + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", ({size})::BIGINT AS bytes FROM dirty" for c, size in zip(DIRTY_COLUMNS, [
        "count(*) * 8", "count(*) * 4", "count(*) * 8", "count(*) * 8", "count(*) * 8",
        "sum(strlen(returnflag))", "sum(strlen(qty_text))", "count(*) * 4"])) + ")")
def logical_size(spark, sf):
    return missing.logical_size(dirty(spark, sf))


@query("logical_size_documents", """SELECT "column", bytes, printf('%.2f', (bytes / 1048576.0::DOUBLE)::DOUBLE)::DOUBLE AS mb FROM (""" + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", ({size})::BIGINT AS bytes FROM documents" for c, size in [
        ("doc_id", "count(*) * 8"), ("text", "sum(strlen(text))"), ("lang", "sum(strlen(lang))"),
        ("source", "sum(strlen(source))"), ("n_chars", "count(*) * 8")]) + ")")
def logical_size_documents(spark, sf):
    return missing.logical_size(table(spark, sf, "documents"))


@query("missing_by_column", DIRTY + f"""SELECT "column", missing, printf('%.2f', (missing / n_rows * 100)::DOUBLE)::DOUBLE AS missing_pct
FROM {MISSING_SQL} WHERE missing > 0""")
def missing_by_column(spark, sf):
    return missing.missing_by_column(dirty(spark, sf))


@query("missing_total", DIRTY + f"""SELECT max(n_rows) AS n_rows, count(*)::INTEGER AS n_columns,
  sum(missing)::BIGINT AS total_missing, printf('%.2f', (sum(missing) / sum(n_rows) * 100)::DOUBLE)::DOUBLE AS missing_percentage
FROM {MISSING_SQL}""")
def missing_total(spark, sf):
    return missing.missing_total(dirty(spark, sf))


@query("missing_pattern", DIRTY + """, counted AS (
  SELECT least(floor((l_orderkey - lo) / (hi - lo) * 50), 49)::INTEGER AS bucket, count(*) AS n_rows, """ + ", ".join(
    f"count(*) - count({c}) AS m{i}" for i, c in enumerate(DIRTY_COLUMNS)) + """
  FROM dirty, (SELECT min(l_orderkey) AS lo, max(l_orderkey) AS hi FROM dirty) GROUP BY 1)
SELECT bucket, "column", n_rows, missing, round(missing / n_rows, 6) AS null_rate FROM (""" + " UNION ALL ".join(
    f"SELECT bucket, '{c}' AS \"column\", n_rows, m{i} AS missing FROM counted" for i, c in enumerate(DIRTY_COLUMNS)) + ")")
def missing_pattern(spark, sf):
    return missing.missing_pattern(dirty(spark, sf), "l_orderkey")


@query("duplicate_summary", DIRTY + """SELECT sum(n)::BIGINT AS n_rows, sum(n - 1)::BIGINT AS n_duplicates,
  printf('%.2f', (sum(n - 1) / sum(n) * 100)::DOUBLE)::DOUBLE AS duplicate_percentage
FROM (SELECT count(*) AS n FROM dirty GROUP BY ALL, l_orderkey, l_linenumber, quantity, qty_scaled, price, returnflag,
  qty_text, target)""".replace("GROUP BY ALL, ", "GROUP BY "))
def duplicate_summary(spark, sf):
    return duplicates.duplicate_summary(dirty(spark, sf))


@query("duplicate_texts", """SELECT sum(n)::BIGINT AS n_rows, sum(n - 1)::BIGINT AS n_duplicates,
  printf('%.2f', (sum(n - 1) / sum(n) * 100)::DOUBLE)::DOUBLE AS duplicate_percentage FROM (SELECT count(*) AS n FROM documents GROUP BY text)""")
def duplicate_texts(spark, sf):
    return duplicates.duplicate_summary(table(spark, sf, "documents"), ["text"])


@query("numeric_moments", DIRTY + " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count({c}) AS n, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std,
  min({c})::DOUBLE AS min, max({c})::DOUBLE AS max, round(skewness({c}), 6) AS skewness,
  round(kurtosis({c}), 6) AS kurtosis FROM dirty""" for c in DIRTY_NUMERIC))
def numeric_moments(spark, sf):
    found = moments.numeric_moments(dirty(spark, sf))
    return found.select("column", "n", *[F.round(c, 6).alias(c) if c not in ("min", "max") else c
                                         for c in found.columns[2:]])


@query("numeric_quantiles", DIRTY + " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", {p}::DOUBLE AS p, round(quantile_cont({c}::DOUBLE, {p}), 6) AS value FROM dirty"""
    for c in DIRTY_NUMERIC for p in (0.05, 0.25, 0.5, 0.75, 0.95)))
def numeric_quantiles(spark, sf):
    found = quantiles.quantiles(dirty(spark, sf), [0.05, 0.25, 0.5, 0.75, 0.95])
    return found.withColumn("value", F.round("value", 6))


@query("correlation_matrix", DIRTY + f""", pairs AS (SELECT * FROM {PAIRS_SQL})
SELECT feature1, feature2, round(correlation, 6) AS correlation FROM pairs
UNION ALL SELECT feature2, feature1, round(correlation, 6) FROM pairs
UNION ALL SELECT c, c, 1.0::DOUBLE FROM (VALUES {', '.join(f"('{c}')" for c in DIRTY_NUMERIC)}) v(c)""")
def correlation_matrix(spark, sf):
    found = correlation.correlation_matrix(dirty(spark, sf))
    return found.withColumn("correlation", F.round("correlation", 6))


LINEITEM_NUMERIC = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
                    "l_discount", "l_tax"]


@query("correlation_wide", " UNION ALL ".join(
    f"SELECT '{a}' AS feature1, '{b}' AS feature2, round(corr({a}, {b}), 6) + 0.0 AS correlation FROM lineitem"
    for i, a in enumerate(LINEITEM_NUMERIC) for b in LINEITEM_NUMERIC[i + 1:]))
def correlation_wide(spark, sf):
    found = correlation.correlation_pairs(table(spark, sf, "lineitem"))
    return found.withColumn("correlation", F.round("correlation", 6) + 0.0)


@query("correlation_infinite", """SELECT 'event_id' AS feature1, 'user_id' AS feature2, round(corr(event_id, user_id), 6) AS correlation
FROM events UNION ALL SELECT 'event_id', 'spiky', round(corr(event_id, value) FILTER (event_id % 7 <> 0), 6) FROM events
UNION ALL SELECT 'user_id', 'spiky', round(corr(user_id, value) FILTER (event_id % 7 <> 0), 6) FROM events""")
def correlation_infinite(spark, sf):
    """Infinite cells count as missing, pair by pair."""
    spike = F.when(F.col("event_id") % 14 == 0, float("inf")).when(F.col("event_id") % 7 == 0, float("-inf"))
    events = table(spark, sf, "events").select("event_id", "user_id", spike.otherwise(F.col("value")).alias("spiky"))
    return correlation.correlation_pairs(events).withColumn("correlation", F.round("correlation", 6))


BALANCE_SQL = """SELECT count(*) AS n_classes, max(n) AS max_count, min(n) AS min_count,
  max(n)::DOUBLE / min(n) AS imbalance_ratio"""


@query("class_balance", DIRTY + f"""SELECT 'target' AS target, * FROM ({BALANCE_SQL}
FROM (SELECT count(*) AS n FROM dirty GROUP BY target))""")
def class_balance(spark, sf):
    return classes.class_balance(dirty(spark, sf))


@query("class_balance_last_column", f"""SELECT 'c_mktsegment' AS target, * FROM ({BALANCE_SQL}
FROM (SELECT count(*) AS n FROM customer GROUP BY c_mktsegment))""")
def class_balance_last_column(spark, sf):
    return classes.class_balance(table(spark, sf, "customer"))


@query("class_balance_not_applicable", """SELECT 'text' AS target, CASE WHEN n < 20 THEN n END AS n_classes,
  CASE WHEN n < 20 THEN hi END AS max_count, CASE WHEN n < 20 THEN lo END AS min_count,
  CASE WHEN n < 20 THEN hi::DOUBLE / lo END AS imbalance_ratio
FROM (SELECT count(*) AS n, max(c) AS hi, min(c) AS lo FROM (SELECT count(*) AS c FROM benchmark GROUP BY text))""")
def class_balance_not_applicable(spark, sf):
    return classes.class_balance(table(spark, sf, "benchmark"))


@query("class_distribution", DIRTY + "SELECT target AS label, count(*) AS count FROM dirty GROUP BY target")
def class_distribution(spark, sf):
    return classes.class_distribution(dirty(spark, sf))


@query("iqr_outliers", DIRTY + f"""SELECT "column", n_rows, round(lower, 6) AS lower, round(upper, 6) AS upper, outliers
FROM {OUTLIERS_SQL}""")
def iqr_outliers(spark, sf):
    found = outliers.iqr_outliers(dirty(spark, sf))
    return found.withColumns({c: F.round(c, 6) for c in ("lower", "upper")})


@query("class_weights", """SELECT source AS label, count(*) AS count,
  round((SELECT count(*) FROM documents) / ((SELECT count(DISTINCT source) FROM documents) * count(*)), 9) AS weight
FROM documents GROUP BY source""")
def class_weights(spark, sf):
    found = classes.class_weights(table(spark, sf, "documents"), "source")
    return found.withColumn("weight", F.round("weight", 9))


@query("validate_table", DIRTY + f"""SELECT count(*) > 0 AS is_valid, count(*) AS n_rows, 8 AS n_cols,
  (SELECT count(*) FROM dirty) > (SELECT count(*) FROM (SELECT DISTINCT * FROM dirty)) AS has_duplicates,
  (SELECT sum(missing) FROM {MISSING_SQL}) > 0 AS has_missing,
  printf('%.2f', ((count(*) * 40 + sum(strlen(returnflag)) + sum(strlen(qty_text)))::DOUBLE / 1048576)::DOUBLE)::DOUBLE AS size_mb
FROM dirty""")
def validate_table(spark, sf):
    return checks.validate_table(dirty(spark, sf))


@query("numeric_as_string", DIRTY + f"SELECT * FROM {TYPES_SQL}")
def numeric_as_string(spark, sf):
    return text_types.numeric_as_string(dirty(spark, sf))


@query("histogram_numeric", DIRTY + ", cells AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", {c}::DOUBLE AS x FROM dirty WHERE {c} IS NOT NULL" for c in DIRTY_NUMERIC) + """),
ends AS (SELECT "column", min(x) AS lo, max(x) AS hi FROM cells GROUP BY ALL)
SELECT "column", bin, round(lo + bin * ((hi - lo) / 30), 6) AS low, round(lo + (bin + 1) * ((hi - lo) / 30), 6) AS high,
  count(*) AS count
FROM (SELECT "column", lo, hi, least(floor((x - lo) / (hi - lo) * 30), 29)::INTEGER AS bin FROM cells JOIN ends USING ("column"))
GROUP BY "column", bin, lo, hi""")
def histogram_numeric(spark, sf):
    found = histogram.histogram(dirty(spark, sf))
    return found.withColumns({c: F.round(c, 6) for c in ("low", "high")})


# Optional extensions ------------------------------------------------------------------------------

@query("zscore_outliers", DIRTY + " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count({c}) AS n, round(min(m), 6) AS mean, round(min(s), 6) AS std,
  count(*) FILTER (abs({c} - m) > 3 * s) AS outliers
FROM dirty, (SELECT avg({c}) AS m, stddev_samp({c}) AS s FROM dirty)""" for c in DIRTY_NUMERIC))
def zscore_outliers(spark, sf):
    found = outliers.zscore_outliers(dirty(spark, sf))
    return found.withColumns({c: F.round(c, 6) for c in ("mean", "std")})


DRIFT_COLUMNS = ["c_acctbal", "c_nationkey"]


@query("drift", """WITH cells AS (
  SELECT 'c_acctbal' AS "column", true AS old, c_acctbal AS x FROM customer UNION ALL SELECT 'c_acctbal', false, s_acctbal FROM supplier
  UNION ALL SELECT 'c_nationkey', true, c_nationkey::DOUBLE FROM customer UNION ALL SELECT 'c_nationkey', false, s_nationkey::DOUBLE / 2 FROM supplier),
ends AS (SELECT "column", min(x) AS lo, max(x) AS hi FROM cells WHERE old GROUP BY "column"),
counted AS (SELECT "column", greatest(0, least(9, floor((x - lo) / (hi - lo) * 10))) AS bin, count(*) FILTER (old) AS b,
  count(*) FILTER (NOT old) AS n FROM cells JOIN ends USING ("column") GROUP BY ALL),
shares AS (SELECT "column", b / sum(b) OVER w AS p, n / sum(n) OVER w AS q FROM counted WINDOW w AS (PARTITION BY "column")),
steps AS (SELECT "column", sum(old::INTEGER) OVER o / sum(old::INTEGER) OVER w - sum((NOT old)::INTEGER) OVER o / sum((NOT old)::INTEGER) OVER w AS gap
  FROM cells WINDOW w AS (PARTITION BY "column"), o AS (PARTITION BY "column" ORDER BY x)),
exact AS (SELECT "column", round(max(abs(gap)), 6) AS ks FROM steps GROUP BY "column")
SELECT "column", round(sum((greatest(p, 1e-4::DOUBLE) - greatest(q, 1e-4::DOUBLE)) * ln(greatest(p, 1e-4::DOUBLE) / greatest(q, 1e-4::DOUBLE))), 6) AS psi,
  any_value(ks) AS ks, sum((greatest(p, 1e-4::DOUBLE) - greatest(q, 1e-4::DOUBLE)) * ln(greatest(p, 1e-4::DOUBLE) / greatest(q, 1e-4::DOUBLE))) > 0.2 AS drifted
FROM shares JOIN exact USING ("column") GROUP BY "column\"""")
def drift_query(spark, sf):
    """Suppliers held against customers."""
    now = table(spark, sf, "supplier").select(F.col("s_acctbal").alias("c_acctbal"), (F.col("s_nationkey") / 2).alias("c_nationkey"))
    found = drift.drift(table(spark, sf, "customer"), now, DRIFT_COLUMNS)
    return found.withColumns({c: F.round(c, 6) for c in ("psi", "ks")})


@query("text_checks", " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count({c}) AS n, count(*) - count({c}) AS missing, count(*) FILTER (trim({c}) = '') AS blank,
  count(*) FILTER (length({c}) < 100) AS too_short, count(*) FILTER (length({c}) > 5000) AS too_long,
  count(*) FILTER (contains({c}, chr(65533)) OR contains({c}, chr(0))) AS broken, min(length({c}))::INTEGER AS min_length,
  round(avg(length({c})), 6) AS mean_length, max(length({c}))::INTEGER AS max_length FROM documents""" for c in ("text", "lang", "source")))
def text_checks(spark, sf):
    found = text_types.text_checks(table(spark, sf, "documents"), shortest=100, longest=5000)
    return found.withColumn("mean_length", F.round("mean_length", 6))


#: Well-formed UTF-8 beyond ASCII, byte by byte, as characters of the same codes.
UTF8_RUN = ("([\u00c2-\u00df][\u0080-\u00bf]|\u00e0[\u00a0-\u00bf][\u0080-\u00bf]|[\u00e1-\u00ec\u00ee\u00ef][\u0080-\u00bf]{2}|"
            "\u00ed[\u0080-\u009f][\u0080-\u00bf]|\u00f0[\u0090-\u00bf][\u0080-\u00bf]{2}|[\u00f1-\u00f3][\u0080-\u00bf]{3}|"
            "\u00f4[\u0080-\u008f][\u0080-\u00bf]{2})+")


@query("encoding_checks", f"""WITH planted AS (
  SELECT CASE WHEN doc_id % 7 = 0 THEN replace(text, 'é', 'Ã©') WHEN doc_id % 7 = 1 THEN text || ' â€™' WHEN doc_id % 7 = 2 THEN text || chr(65533)
    ELSE text END AS text, lang FROM documents),
cells AS (SELECT 'text' AS "column", text AS t FROM planted UNION ALL SELECT 'lang', lang FROM planted),
flags AS (SELECT "column", t, contains(t, chr(65533)) OR contains(t, chr(0)) AS replaced, len(list_filter(regexp_extract_all(
    translate(t, '{"".join(text_types.WINDOWS_1252.values())}', '{"".join(map(chr, text_types.WINDOWS_1252))}'), '[\u0080-\u00ff]+'),
    lambda r: regexp_full_match(r, '{UTF8_RUN}'))) > 0 AS doubled FROM cells)
SELECT "column", count(t) AS n, count(*) FILTER (replaced) AS replaced, count(*) FILTER (doubled) AS double_encoded,
  count(*) FILTER (replaced OR doubled) AS broken, printf('%.2f', (count(*) FILTER (replaced OR doubled))::DOUBLE / count(t) * 100)::DOUBLE AS broken_pct
FROM flags GROUP BY "column\"""")
def encoding_checks(spark, sf):
    """documents with accents encoded twice in every seventh text, a quote in another, a replacement character in a third."""
    part, text = F.col("doc_id") % 7, F.col("text")
    planted = F.when(part == 0, F.replace(text, F.lit("é"), F.lit("Ã©"))).when(part == 1, F.concat(text, F.lit(" â€™"))).when(
        part == 2, F.concat(text, F.lit("\ufffd"))).otherwise(text)
    return text_types.encoding_checks(table(spark, sf, "documents").select(planted.alias("text"), "lang"))


IMPORTANCE_CELLS = " UNION ALL ".join(
    [f"""SELECT '{c}' AS "column", target AS label, least(9, floor(({c} - (SELECT min({c}) FROM dirty)) / ((SELECT max({c}) FROM dirty)
  - (SELECT min({c}) FROM dirty)) * 10))::VARCHAR AS bin FROM dirty""" for c in ("l_orderkey", "l_linenumber", "quantity", "qty_scaled", "price")]
    + [f"""SELECT '{c}', target, '=' || {c} FROM dirty""" for c in ("returnflag", "qty_text")])


@query("feature_importance", DIRTY + f""", cells AS ({IMPORTANCE_CELLS}),
counts AS (SELECT "column", bin, label, count(*)::DOUBLE AS n FROM cells GROUP BY ALL),
parts AS (SELECT "column", n / sum(n) OVER (PARTITION BY "column") AS p, sum(n) OVER (PARTITION BY "column", bin) / sum(n) OVER (PARTITION BY "column") AS px,
  sum(n) OVER (PARTITION BY "column", label) / sum(n) OVER (PARTITION BY "column") AS py FROM counts)
SELECT "column", round(greatest(sum(p * ln(p / (px * py))), 0), 9) AS mutual_information,
  round(greatest(0, least(1, sum(p * ln(p / (px * py))) / -sum(p * ln(py)))), 9) AS importance FROM parts GROUP BY "column\"""")
def feature_importance(spark, sf):
    found = importance.feature_importance(dirty(spark, sf), "target")
    return found.withColumns({c: F.round(c, 9) for c in ("mutual_information", "importance")})


@query("stream_quality", """WITH e AS (SELECT date_trunc('day', ts) AS day, event_type, CASE WHEN event_id % 5 > 0 THEN value END AS value FROM events)
SELECT strftime(day, '%Y-%m-%d') AS day, 'value' AS "column", count(*) AS n_rows, count(*) - count(value) AS missing,
  count(*) FILTER (value > 100) AS invalid, printf('%.2f', (count(*) - count(value))::DOUBLE / count(*) * 100)::DOUBLE AS missing_pct FROM e GROUP BY day
UNION ALL SELECT strftime(day, '%Y-%m-%d'), 'event_type', count(*), 0, 0, 0.0::DOUBLE FROM e GROUP BY day""")
def stream_quality(spark, sf):
    """events as a stream of files, every fifth value missing: all days, closed or still open when the files end."""
    source = spark.readStream.schema(table(spark, sf, "events").schema).parquet(f"{sf}/events*.parquet")
    events = source.withColumn("value", F.when(F.col("event_id") % 5 > 0, F.col("value")))
    quality = window_quality(events, "ts", ["value", "event_type"], {"value": F.col("value") <= 100})
    found = run_to_end(quality, scratch_path(spark, "checkpoint"), scratch_path(spark, "windows"), open_windows=True).windows
    return found.withColumn("day", F.date_format("window_start", "yyyy-MM-dd")).drop("window_start")


@query("embedding_outliers")
def embedding_outliers_query(spark, sf):
    return embedding_outliers(table(spark, sf, "embeddings"), "vec_id", "embedding")


# Profile of growing data ----------------------------------------------------------------------------

ORDERS_COLUMNS = {"o_orderkey": "bigint", "o_custkey": "bigint", "o_orderstatus": "string", "price": "double",
                  "o_orderdate": "timestamp_ntz", "o_orderpriority": "string"}
ORDERS_SQL = """WITH o AS (SELECT o_orderkey, o_custkey, o_orderstatus,
  CASE WHEN o_orderkey % 11 > 0 THEN o_totalprice END AS price, o_orderdate, o_orderpriority FROM orders)
"""


def _monthly_store(spark: SparkSession, sf: str) -> tuple[str, str]:
    """orders as a folder of months that fills up in three steps, each followed by an update of the profile."""
    folder, store = scratch_path(spark, "orders"), scratch_path(spark, "profile")
    months = table(spark, sf, "orders").withColumn("price", F.when(F.col("o_orderkey") % 11 > 0, F.col("o_totalprice"))).select(
        *ORDERS_COLUMNS, F.date_format("o_orderdate", "yyyy-MM").alias("month"))
    for low, high in (("0000", "1994-07"), ("1994-07", "1996-02"), ("1996-02", "9999")):
        months.where((F.col("month") >= low) & (F.col("month") < high)).repartition("month").write.mode("append").partitionBy(
            "month").parquet(folder)
        incremental.update_profile(spark, folder, store, exclude=["month"])
    return folder, store


def _column_sql(name: str, kind: str) -> str:
    number = kind in ("bigint", "double")
    numbers = [f"round({f}({name}), {d})" if number else "CAST(NULL AS DOUBLE)" for f, d in (
        ("avg", 4), ("stddev_samp", 4), ("skewness", 6), ("kurtosis", 6))]
    ends = [f"{f}({name})::DOUBLE" if number else "CAST(NULL AS DOUBLE)" for f in ("min", "max")]
    role = "numeric" if number else "categorical" if kind == "string" else "datetime"
    return (f"""SELECT '{name}' AS "column", '{kind}' AS type, '{role}' AS role, count(*) AS n_rows, count(*) - count({name}) AS missing,
  printf('%.2f', (count(*) - count({name}))::DOUBLE / count(*) * 100)::DOUBLE AS missing_pct, {numbers[0]} AS mean, {numbers[1]} AS std,
  {ends[0]} AS min, {ends[1]} AS max, {numbers[2]} AS skewness, {numbers[3]} AS kurtosis, TRUE AS distinct_close FROM o""")


@query("incremental_profile", ORDERS_SQL + " UNION ALL ".join(_column_sql(*c) for c in ORDERS_COLUMNS.items()))
def incremental_profile(spark, sf):
    """Three updates, merged. Distinct counts are estimates: within 5 % of the true number, as SQL says."""
    folder, store = _monthly_store(spark, sf)
    rows = spark.read.parquet(folder)
    true = rows.agg(*[F.count_distinct(c).alias(c) for c in ORDERS_COLUMNS]).unpivot(
        [], list(ORDERS_COLUMNS), "name", "true")
    found = incremental.stored_profile(spark, store).join(true, F.col("column") == F.col("name"))
    return found.select(
        "column", "type", "role", "n_rows", "missing", "missing_pct", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"),
        "min", "max", F.round("skewness", 6).alias("skewness"), F.round("kurtosis", 6).alias("kurtosis"),
        (F.abs(F.col("n_distinct") - F.col("true")) <= 0.05 * F.col("true")).alias("distinct_close"))


@query("incremental_correlations", ORDERS_SQL + """SELECT 'o_orderkey' AS feature1, 'o_custkey' AS feature2, round(corr(o_orderkey, o_custkey), 6) AS correlation FROM o
UNION ALL SELECT 'o_orderkey', 'price', round(corr(o_orderkey, price), 6) FROM o
UNION ALL SELECT 'o_custkey', 'price', round(corr(o_custkey, price), 6) FROM o""")
def incremental_correlations(spark, sf):
    store = _monthly_store(spark, sf)[1]
    return incremental.stored_correlations(spark, store).withColumn("correlation", F.round("correlation", 6))


@query("incremental_quantiles", " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", {p}::DOUBLE AS p, TRUE AS within FROM (SELECT 1)""" for c in ("o_orderkey", "o_custkey", "price")
    for p in (0.05, 0.25, 0.5, 0.75, 0.95)))
def incremental_quantiles(spark, sf):
    """Whether the true rank of each quantile is off by 0.5 % of the rows at most; SQL states that it is."""
    folder, store = _monthly_store(spark, sf)
    found = materialize(incremental.stored_quantiles(spark, store, [0.05, 0.25, 0.5, 0.75, 0.95]))
    rows = spark.read.parquet(folder)
    cells = rows.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x"))
                                            for c in ("o_orderkey", "o_custkey", "price")])).alias("c")).select("c.*").where("x IS NOT NULL")
    ranks = cells.join(F.broadcast(found), "column").groupBy("column", "p").agg(
        (F.count_if(F.col("x") < F.col("value")) / F.count("x")).alias("below"),
        (F.count_if(F.col("x") <= F.col("value")) / F.count("x")).alias("upto"))
    return ranks.select("column", "p", ((F.col("below") - 0.005 <= F.col("p")) & (F.col("p") <= F.col("upto") + 0.005)).alias("within"))


# Scalar functions ---------------------------------------------------------------------------------

@query("fn_percentage", """SELECT l_orderkey, l_linenumber, CASE WHEN l_tax = 0 THEN 0.0::DOUBLE
  ELSE printf('%.2f', (l_discount / l_tax * 100)::DOUBLE)::DOUBLE END AS pct FROM lineitem""")
def fn_percentage(spark, sf):
    pct = scalars.percentage(F.col("l_discount"), F.col("l_tax"))
    return table(spark, sf, "lineitem").select(*KEY, pct.alias("pct"))


@query("fn_normalize", """SELECT c_custkey, round((c_acctbal - lo) / (hi - lo) * 100, 6) AS normalized
FROM customer, (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer)""")
def fn_normalize(spark, sf):
    scaled = scalars.normalize_scores(table(spark, sf, "customer").select("c_custkey", "c_acctbal"), "c_acctbal")
    return scaled.select("c_custkey", F.round("normalized", 6).alias("normalized"))


@query("fn_truncate_text", """SELECT doc_id, CASE WHEN length(text) > 100 THEN substring(text, 1, 97) || '...'
  ELSE text END AS text FROM documents""")
def fn_truncate_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", scalars.truncate_text(F.col("text")).alias("text"))


@query("fn_format_bytes", """SELECT doc_id, power, CASE WHEN b < 1024 THEN printf('%.2f B', b)
  WHEN b < 1048576 THEN printf('%.2f KB', b / 1024) WHEN b < 1073741824 THEN printf('%.2f MB', b / 1048576)
  WHEN b < 1099511627776 THEN printf('%.2f GB', b / 1073741824)
  WHEN b < 1125899906842624 THEN printf('%.2f TB', b / 1099511627776)
  ELSE printf('%.2f PB', b / 1125899906842624) END AS size
FROM (SELECT doc_id, power, n_chars * pow(1000.0::DOUBLE, power) AS b FROM documents, (VALUES (0), (1), (2), (3), (4), (5)) v(power))""")
def fn_format_bytes(spark, sf):
    powers = table(spark, sf, "documents").select("doc_id", "n_chars", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("power"))
    size = F.col("n_chars") * F.pow(F.lit(1000.0), F.col("power"))
    return powers.select("doc_id", "power", scalars.format_bytes(size).alias("size"))


# Checks and scores --------------------------------------------------------------------------------

MISSING_PCT_SQL = f"(SELECT printf('%.2f', (sum(missing) / sum(n_rows) * 100)::DOUBLE)::DOUBLE AS missing_percentage FROM {MISSING_SQL})"
DUPLICATE_PCT_SQL = """(SELECT printf('%.2f', (sum(n - 1) / sum(n) * 100)::DOUBLE)::DOUBLE AS duplicate_percentage FROM (
  SELECT count(*) AS n FROM dirty GROUP BY l_orderkey, l_linenumber, quantity, qty_scaled, price, returnflag, qty_text, target))"""
RATIO_SQL = """(SELECT max(n)::DOUBLE / min(n) AS imbalance_ratio FROM (
  SELECT count(*) AS n FROM dirty GROUP BY target))"""
SHARE_SQL = f"(SELECT sum(outliers)::DOUBLE / sum(n_rows) * 100 AS share FROM {OUTLIERS_SQL})"


@query("check_missing", DIRTY + f"""SELECT status, {_severity_sql('status')} AS severity, missing_percentage
FROM (SELECT *, {_status_sql('missing_percentage', 2, 5, 15)} AS status FROM {MISSING_PCT_SQL})""")
def check_missing(spark, sf):
    return checks.check_missing(dirty(spark, sf))


@query("check_duplicates", DIRTY + f"""SELECT status, {_severity_sql('status')} AS severity, duplicate_percentage
FROM (SELECT *, {_status_sql('duplicate_percentage', 1, 3, 10)} AS status FROM {DUPLICATE_PCT_SQL})""")
def check_duplicates(spark, sf):
    return checks.check_duplicates(dirty(spark, sf))


@query("check_balance", DIRTY + f"""SELECT status, {_severity_sql('status')} AS severity, 'target' AS target, imbalance_ratio
FROM (SELECT *, {_status_sql('imbalance_ratio', 1.5, 3, 5)} AS status FROM {RATIO_SQL})""")
def check_balance(spark, sf):
    return checks.check_balance(dirty(spark, sf))


@query("check_outliers", DIRTY + f"""SELECT status, CASE WHEN status IN ('fair', 'poor') THEN 'medium' ELSE 'low' END AS severity,
  printf('%.2f', (share)::DOUBLE)::DOUBLE AS outlier_percentage
FROM (SELECT *, {_status_sql('share', 2, 5, 10)} AS status FROM {SHARE_SQL})""")
def check_outliers(spark, sf):
    return checks.check_outliers(dirty(spark, sf))


@query("check_types", DIRTY + f"""SELECT CASE WHEN n = 0 THEN 'good' ELSE 'fair' END AS status, 'low' AS severity,
  coalesce(issues, '') AS issues
FROM (SELECT count(*) FILTER (numeric_as_string) AS n,
  string_agg("column" || ': numeric values stored as strings', '; ' ORDER BY "column") FILTER (numeric_as_string) AS issues
  FROM {TYPES_SQL})""")
def check_types(spark, sf):
    return checks.check_types(dirty(spark, sf)).withColumn("issues", F.concat_ws("; ", "issues"))


@query("score_components", METRIC_ROWS + """SELECT l_orderkey, l_linenumber, completeness, consistency, balance,
  integrity, integrity_source FROM components""")
def score_components(spark, sf):
    scored = scoring.score_components(metric_rows(spark, sf))
    return scored.select(*KEY, *scoring.COMPONENTS, "integrity_source")


@query("score_overall", METRIC_ROWS + """SELECT l_orderkey, l_linenumber, overall_score, rating, recommendation
FROM scored""")
def score_overall(spark, sf):
    return scoring.health_score(metric_rows(spark, sf)).select(*KEY, "overall_score", "rating", "recommendation")


@query("score_details", METRIC_ROWS + """SELECT l_orderkey, l_linenumber,
  CASE WHEN completeness >= 90 THEN 'Excellent data coverage' WHEN completeness >= 75 THEN 'Low missing values'
    WHEN completeness >= 60 THEN 'Moderate missing values' ELSE 'High missing values' END AS completeness_text,
  CASE WHEN consistency >= 95 THEN 'No duplicates' WHEN consistency >= 85 THEN 'Minor duplicates'
    WHEN consistency >= 70 THEN 'Deduplication recommended' ELSE 'Significant duplicates' END AS consistency_text,
  CASE WHEN balance >= 95 THEN 'Well-balanced classes' WHEN balance >= 75 THEN 'Mild imbalance'
    WHEN balance >= 60 THEN 'Moderate imbalance' ELSE 'Severe imbalance' END AS balance_text,
  CASE WHEN integrity >= 90 THEN 'Minimal anomalies' WHEN integrity >= 75 THEN 'Some anomalies'
    WHEN integrity >= 60 THEN 'Notable anomalies' ELSE 'High anomaly rate' END AS integrity_text,
  coalesce(anomaly_percentage, 0)::DOUBLE AS integrity_metric, printf('%.2f', (integrity)::DOUBLE)::DOUBLE AS integrity_score
FROM scored""")
def score_details(spark, sf):
    detailed = scoring.score_details(scoring.health_score(metric_rows(spark, sf)))
    return detailed.select(
        *KEY, *[F.col(f"{c}_details.interpretation").alias(f"{c}_text") for c in scoring.COMPONENTS],
        F.col("integrity_details.metric").alias("integrity_metric"),
        F.col("integrity_details.score").alias("integrity_score"))


@query("score_formula", METRIC_ROWS + f"""SELECT l_orderkey, l_linenumber,
  printf('(%.1f × 0.25) + (%.1f × 0.25) + (%.1f × 0.25) + (%.1f × 0.25) = %.2f', completeness, consistency,
    balance, integrity, {OVERALL_SQL}) AS formula FROM components""")
def score_formula(spark, sf):
    scored = scoring.score_components(metric_rows(spark, sf))
    return scored.select(*KEY, scoring.score_formula().alias("formula"))


@query("weighted_components", METRIC_ROWS + " UNION ALL ".join(
    f"SELECT l_orderkey, l_linenumber, '{c}' AS component, {c} AS score, printf('%.2f', ({c} * 0.25::DOUBLE)::DOUBLE)::DOUBLE AS weighted FROM components"
    for c in scoring.COMPONENTS))
def weighted_components(spark, sf):
    return scoring.weighted_components(scoring.score_components(metric_rows(spark, sf)), KEY)


@query("recommendations", METRIC_ROWS + r""", lines AS (
  SELECT l_orderkey, l_linenumber, list_concat(
    CASE WHEN missing_severity <> 'low' THEN
      ['Apply imputation strategies for missing values (KNN, median, or mode imputation)'] ELSE [] END,
    CASE WHEN duplicates_severity <> 'low' THEN
      ['Remove duplicate records before model training to avoid data leakage'] ELSE [] END,
    CASE WHEN balance_severity = 'low' THEN [] WHEN imbalance_ratio < 10 THEN
      [printf('Mild class imbalance (%.1f:1) is common in real-world datasets', imbalance_ratio),
       '  Optional: Apply SMOTE, class weights, or stratified sampling if needed']
      ELSE [printf('Address significant class imbalance (%.1f:1 ratio) using advanced techniques (SMOTE, ensemble methods, or cost-sensitive learning)', imbalance_ratio)] END,
    CASE WHEN anomaly_percentage IS NULL THEN [] WHEN anomaly_percentage > 15 THEN
      [printf('%d statistical outliers detected (%.1f%%) by ML models', n_anomalies, anomaly_percentage),
       '  These are model-flagged anomalies, not confirmed errors',
       '  Recommended: Manual review to distinguish legitimate edge cases from data errors',
       '  Consider: Domain expert validation for high-impact decisions']
      WHEN anomaly_percentage > 5 THEN
      [printf('%d statistical outliers detected (%.1f%%)--typical for real-world data', n_anomalies, anomaly_percentage),
       '  Most are likely legitimate extreme values or rare combinations',
       '  Optional: Review top outliers for domain-specific relevance']
      ELSE [printf('Low outlier rate (%.1f%%)--within expected statistical variation', anomaly_percentage)] END,
    [CASE WHEN overall_score >= 90 THEN 'Dataset quality is excellent--proceed with model training confidently'
      WHEN overall_score >= 80 THEN 'Dataset quality is very good--suitable for immediate use with minor preprocessing'
      WHEN overall_score >= 70 THEN 'Dataset quality is good--address minor issues for optimal model performance'
      WHEN overall_score >= 60 THEN 'Dataset requires targeted cleaning based on findings above before training'
      ELSE 'Major quality issues detected--comprehensive data cleaning required' END]) AS texts FROM scored)
SELECT l_orderkey, l_linenumber, unnest(range(len(texts)))::INTEGER AS position, unnest(texts) AS recommendation FROM lines""")
def recommendations(spark, sf):
    scored = scoring.health_score(metric_rows(spark, sf))
    return scored.select(*KEY, F.posexplode(scoring.recommendations()).alias("position", "recommendation"))


@query("key_findings", METRIC_ROWS + r""", lines AS (
  SELECT l_orderkey, l_linenumber, list_concat(
    [printf('Missing Values: %.2f%% [%s]', missing_percentage, upper(missing_status)),
     printf('Duplicates: %.2f%% [%s]', duplicate_percentage, upper(duplicates_status))],
    CASE WHEN imbalance_ratio IS NULL THEN [] ELSE [printf('Class Imbalance: %.2f:1 [%s]', imbalance_ratio, upper(balance_status))] END,
    CASE WHEN imbalance_ratio > 5 THEN ['  Common in churn/attrition datasets; manageable with standard techniques'] ELSE [] END,
    CASE WHEN anomaly_percentage IS NULL THEN [] ELSE
      [printf('Statistical Outliers: %d detected (%.2f%%)', n_anomalies, anomaly_percentage),
       '  ML-based detection; not necessarily data errors',
       '  Includes rare combinations, edge cases, legitimate extremes'] END,
    CASE WHEN anomaly_percentage < 15 THEN ['  Rate is within acceptable range for real-world data'] ELSE [] END) AS texts
  FROM scored)
SELECT l_orderkey, l_linenumber, unnest(range(len(texts)))::INTEGER AS position, unnest(texts) AS finding FROM lines""")
def key_findings(spark, sf):
    scored = scoring.health_score(metric_rows(spark, sf))
    return scored.select(*KEY, F.posexplode(scoring.key_findings()).alias("position", "finding"))


@query("health_score", DIRTY + f""", metrics AS (
  SELECT *, printf('%.2f', (share)::DOUBLE)::DOUBLE AS outlier_percentage, NULL::DOUBLE AS anomaly_percentage,
    {_status_sql('imbalance_ratio', 1.5, 3, 5)} AS balance_status
  FROM {MISSING_PCT_SQL}, {DUPLICATE_PCT_SQL}, {RATIO_SQL}, {SHARE_SQL}),
components AS (SELECT *, {COMPONENTS_SQL} FROM metrics),
overall AS (SELECT *, {OVERALL_SQL} AS overall FROM components)
SELECT missing_percentage, duplicate_percentage, imbalance_ratio, outlier_percentage, completeness, consistency,
  balance, integrity, {ADVICE_SQL} FROM overall""")
def health_score(spark, sf):
    return score_table(dirty(spark, sf)).select(
        "missing_percentage", "duplicate_percentage", "imbalance_ratio", "outlier_percentage",
        *scoring.COMPONENTS, "overall_score", "rating", "recommendation")


# Anomaly detection --------------------------------------------------------------------------------

@query("minmax_score", """SELECT event_id, round((value - lo) / (hi - lo + 1e-8::DOUBLE), 9) AS anomaly_score
FROM events, (SELECT min(value) AS lo, max(value) AS hi FROM events)""")
def minmax_score(spark, sf):
    scored = anomaly.minmax_score(table(spark, sf, "events").select("event_id", "value"), "value")
    return scored.select("event_id", F.round("anomaly_score", 9).alias("anomaly_score"))


@query("percentile_labels", """SELECT l_orderkey, l_linenumber, l_extendedprice,
  CASE WHEN l_extendedprice > (SELECT quantile_cont(l_extendedprice, 0.95) FROM lineitem) THEN 1 ELSE 0 END AS anomaly_label
FROM lineitem""")
def percentile_labels(spark, sf):
    scores = table(spark, sf, "lineitem").select(*KEY, "l_extendedprice")
    return anomaly.percentile_labels(scores, "l_extendedprice", 0.95)


COMBINED_SQL = """WITH ends AS (
  SELECT min(l_extendedprice) AS p_lo, max(l_extendedprice) AS p_hi, quantile_cont(l_extendedprice, 0.9) AS p_cut,
    min(l_quantity) AS q_lo, max(l_quantity) AS q_hi, quantile_cont(l_quantity, 0.95) AS q_cut FROM lineitem),
combined AS (SELECT l_orderkey, l_linenumber,
  CASE WHEN l_extendedprice > p_cut OR l_quantity > q_cut THEN 1 ELSE 0 END AS anomaly_label,
  ((l_extendedprice - p_lo) / (p_hi - p_lo + 1e-8::DOUBLE) + (l_quantity - q_lo) / (q_hi - q_lo + 1e-8::DOUBLE)) / 2 AS anomaly_score
FROM lineitem, ends)
"""


def _combined(spark, sf):
    """Price and quantity as the scores of two detectors."""
    rows = table(spark, sf, "lineitem").select(*KEY, "l_extendedprice", "l_quantity")
    rows = anomaly.percentile_labels(rows, "l_extendedprice", 0.9, "price_label")
    rows = anomaly.percentile_labels(rows, "l_quantity", 0.95, "quantity_label")
    rows = anomaly.minmax_score(anomaly.minmax_score(rows, "l_extendedprice", "price_score"), "l_quantity", "quantity_score")
    label, score = anomaly.combine([F.col("price_label"), F.col("quantity_label")],
                                   [F.col("price_score"), F.col("quantity_score")])
    return rows.select(*KEY, label.alias("anomaly_label"), score.alias("anomaly_score"))


@query("anomaly_combine", COMBINED_SQL + """SELECT l_orderkey, l_linenumber, anomaly_label,
  round(anomaly_score, 9) AS anomaly_score FROM combined""")
def anomaly_combine(spark, sf):
    return _combined(spark, sf).withColumn("anomaly_score", F.round("anomaly_score", 9))


@query("anomaly_summary", COMBINED_SQL + """SELECT count(*) AS n_rows, sum(anomaly_label)::BIGINT AS n_anomalies,
  printf('%.2f', (sum(anomaly_label) / count(*) * 100)::DOUBLE)::DOUBLE AS anomaly_percentage FROM combined""")
def anomaly_summary(spark, sf):
    return anomaly.anomaly_summary(_combined(spark, sf))


@query("anomaly_threshold", COMBINED_SQL + """SELECT round(coalesce(min(anomaly_score) FILTER (anomaly_label = 1), 0.8), 9)
  AS threshold FROM combined""")
def anomaly_threshold(spark, sf):
    found = anomaly.anomaly_threshold(_combined(spark, sf))
    return found.withColumn("threshold", F.round("threshold", 9))


@query("anomaly_score_histogram", COMBINED_SQL + """, ends2 AS (SELECT min(anomaly_score) AS lo, max(anomaly_score) AS hi FROM combined)
SELECT 'anomaly_score' AS "column", bin, count(*) AS count FROM (
  SELECT least(floor((anomaly_score - lo) / (hi - lo) * 50), 49)::INTEGER AS bin FROM combined, ends2) GROUP BY bin""")
def anomaly_score_histogram(spark, sf):
    return histogram.histogram(_combined(spark, sf), ["anomaly_score"], bins=50).select("column", "bin", "count")


@query("anomaly_labels_of_scores", """WITH scored AS (
  SELECT event_id, abs(value) AS error, (user_id % 97)::DOUBLE AS isolation FROM events),
ends AS (SELECT min(error) AS e_lo, max(error) AS e_hi, quantile_cont(error, 0.95) AS e_cut, min(isolation) AS i_lo,
  max(isolation) AS i_hi, quantile_cont(isolation, 0.9) AS i_cut FROM scored)
SELECT event_id, (isolation > i_cut)::INTEGER AS isolation_forest_label, (error > e_cut)::INTEGER AS autoencoder_label,
  round((isolation - i_lo) / (i_hi - i_lo + 1e-8::DOUBLE), 9) AS isolation_forest_score,
  round((error - e_lo) / (e_hi - e_lo + 1e-8::DOUBLE), 9) AS autoencoder_score,
  (isolation > i_cut OR error > e_cut)::INTEGER AS anomaly_label,
  round(((isolation - i_lo) / (i_hi - i_lo + 1e-8::DOUBLE) + (error - e_lo) / (e_hi - e_lo + 1e-8::DOUBLE)) / 2, 9) AS anomaly_score
FROM scored, ends""")
def anomaly_labels_of_scores(spark, sf):
    """Thresholds, scaling and ensemble of the detector run, on raw scores that SQL knows too."""
    raw = table(spark, sf, "events").select("event_id", F.abs("value").alias("autoencoder"),
                                            (F.col("user_id") % 97).cast("double").alias("isolation_forest"))
    rows, _ = anomaly.labelled(raw, ["event_id"], ["isolation_forest", "autoencoder"], Config())
    return rows.withColumns({c: F.round(c, 9) for c in rows.columns if c.endswith("_score")})


@query("pca_error_two_features", """WITH f AS (SELECT event_id, user_id::DOUBLE AS a, value AS b FROM events),
z AS (SELECT event_id, (a - avg(a) OVER ()) / stddev_pop(a) OVER () AS z1, (b - avg(b) OVER ()) / stddev_pop(b) OVER () AS z2 FROM f)
SELECT event_id, round(power(z1 - sign(avg(z1 * z2) OVER ()) * z2, 2) / 4, 6) AS error FROM z""")
def pca_error_two_features(spark, sf):
    """Two standardised features have the axes (1, 1) and (1, -1); the weaker one is given up."""
    data, features = table(spark, sf, "events"), ["user_id", "value"]
    error = pca_error(data, features, fit_pca(data, features))
    return data.select("event_id", F.round(error, 6).alias("error"))


#: Two small trees: split feature, threshold and path length of each leaf, in level order.
FIXED_FOREST = {"feature": [[0, 1, 1], [1, 0, 0]],
                "threshold": [[200.0, 20.0, 60.0], [45.0, 80.0, float("inf")]],
                "path": [[2.0, 3.5, 2.5, 2.0], [4.0, 2.0, 3.0, 9.0]], "depth": 2, "scale": 3.0}


@query("forest_score_fixed", """SELECT event_id, round(power(2, -(path1 + path2) / 2 / 3), 9) AS score FROM (
  SELECT event_id, CASE WHEN user_id < 200 THEN CASE WHEN value < 20 THEN 2 ELSE 3.5 END
      ELSE CASE WHEN value < 60 THEN 2.5 ELSE 2 END END::DOUBLE AS path1,
    CASE WHEN value < 45 THEN CASE WHEN user_id < 80 THEN 4 ELSE 2 END ELSE 3 END::DOUBLE AS path2 FROM events)""")
def forest_score_fixed(spark, sf):
    """Scoring alone, with trees that are given."""
    forest = {k: np.array(v) if isinstance(v, list) else v for k, v in FIXED_FOREST.items()}
    data = table(spark, sf, "events")
    score = forest_score(data, ["user_id", "value"], forest)
    return data.select("event_id", F.round(score, 9).alias("score"))


@query("iforest_score")
def iforest_score(spark, sf):
    config = Config(detectors=("isolation_forest",))
    return anomaly.detect(dirty(spark, sf), KEY, config=config).rows.select(*KEY, "anomaly_label", "anomaly_score")


@query("iforest_raw_score")
def iforest_raw_score(spark, sf):
    data, features = table(spark, sf, "events"), ["user_id", "value"]
    forest = fit_forest(data, features, key=["event_id"])
    return data.select("event_id", forest_score(data, features, forest).alias("score"))


@query("pca_recon_score")
def pca_recon_score(spark, sf):
    config = Config(detectors=("autoencoder",))
    return anomaly.detect(dirty(spark, sf), KEY, config=config).rows.select(*KEY, "anomaly_label", "anomaly_score")


@query("pca_recon_error")
def pca_recon_error(spark, sf):
    data = table(spark, sf, "embeddings")
    width = data.agg(F.max(F.size("embedding"))).first()[0]
    wide = data.select("vec_id", *[F.get("embedding", F.lit(i)).alias(f"e{i}") for i in range(width)])
    columns = wide.columns[1:]
    return wide.select("vec_id", pca_error(wide, columns, fit_pca(wide, columns)).alias("error"))


@query("autoencoder_score")
def autoencoder_score(spark, sf):
    data, features = table(spark, sf, "events"), ["user_id", "value"]
    model = fit_network(data, features, AutoencoderParams(kind="mlp", epochs=30), ["event_id"])
    return data.select("event_id", network_error(data, features, model).alias("error"))


@query("anomaly_ensemble")
def anomaly_ensemble(spark, sf):
    return anomaly.detect(dirty(spark, sf), KEY).rows


def _facts(section: str, frame: DataFrame, *names: str) -> DataFrame:
    """Rows of section, name (the first column) and value (the others), numbers with six decimals."""
    def text(name: str):
        kind = dict(frame.dtypes)[name]
        return F.format_string("%.6f", F.col(name)) if kind == "double" else F.col(name).cast("string")
    values = [F.coalesce(text(c), F.lit("-")) for c in names[1:]]
    return frame.select(F.lit(section).alias("section"), F.col(names[0]).cast("string").alias("name"),
                        F.concat_ws(" ", *values).alias("value"))


def _number_sql(value: str) -> str:
    return f"coalesce(printf('%.6f', ({value})::DOUBLE), '-')"


REPORT_SQL = DIRTY + f""", typed AS (SELECT * FROM {TYPES_SQL})
SELECT 'rows' AS section, 'n_rows' AS name, count(*)::VARCHAR AS value FROM dirty
UNION ALL SELECT 'duplicates', 'n_duplicates', n_duplicates::VARCHAR FROM (SELECT sum(n - 1)::BIGINT AS n_duplicates FROM (
  SELECT count(*) AS n FROM dirty GROUP BY {', '.join(DIRTY_COLUMNS)}))
UNION ALL SELECT 'missing', "column", missing::VARCHAR || ' ' || {_number_sql("printf('%.2f', missing / n_rows * 100)::DOUBLE")}
  FROM {MISSING_SQL} WHERE missing > 0
UNION ALL SELECT 'outliers', "column", outliers::VARCHAR || ' ' || {_number_sql('lower')} || ' ' || {_number_sql('upper')} FROM {OUTLIERS_SQL}
UNION ALL SELECT 'classes', target::VARCHAR, count(*)::VARCHAR FROM dirty GROUP BY target
UNION ALL SELECT 'high_correlations', feature1, feature2 || ' ' || {_number_sql('correlation')} FROM {PAIRS_SQL} WHERE abs(correlation) > 0.8
UNION ALL SELECT 'weights', c, '0.250000' FROM (VALUES ('completeness'), ('consistency'), ('balance'), ('integrity')) v(c)
UNION ALL SELECT 'types', "column" || ': numeric values stored as strings', '' FROM typed WHERE numeric_as_string
UNION ALL SELECT 'statistics', c, n::VARCHAR || ' ' || {_number_sql('mean')} || ' ' || {_number_sql('median')} FROM (""" + " UNION ALL ".join(
    f"SELECT '{c}' AS c, count({c}) AS n, avg({c}) AS mean, quantile_cont({c}::DOUBLE, 0.5) AS median FROM dirty"
    for c in DIRTY_NUMERIC) + ")"


@query("audit_report_facts", REPORT_SQL)
def audit_report_facts(spark, sf):
    """The report without detectors, its sections as rows."""
    report = audit_table(dirty(spark, sf), KEY, Config(detectors=())).report

    def rows(path: str) -> DataFrame:
        return report.select(F.inline(path))

    weights = report.select("scores.weights.*")
    parts = [
        _facts("rows", report.select(F.lit("n_rows").alias("k"), "profile.basic_info.n_rows"), "k", "n_rows"),
        _facts("duplicates", report.select(F.lit("n_duplicates").alias("k"), "profile.duplicates.n_duplicates"), "k", "n_duplicates"),
        _facts("missing", rows("profile.missing_values.columns"), "column", "missing", "missing_pct"),
        _facts("outliers", rows("checks.outliers_per_column"), "column", "outliers", "lower", "upper"),
        _facts("classes", rows("checks.class_distribution"), "label", "count"),
        _facts("high_correlations", rows("profile.high_correlations"), "feature1", "feature2", "correlation"),
        _facts("weights", weights.select(F.inline(F.array(*[F.struct(F.lit(c).alias("k"), F.col(c).alias("v"))
                                                            for c in weights.columns]))), "k", "v"),
        _facts("types", report.select(F.explode("checks.types_issues").alias("k")), "k"),
        _facts("statistics", rows("profile.statistics"), "column", "n", "mean", "median"),
    ]
    return union_all(parts)


PLOT_SQL = DIRTY + f"""SELECT 'missing_values' AS plot, "column" AS name, missing::VARCHAR AS value FROM {MISSING_SQL} WHERE missing > 0
UNION ALL SELECT 'correlations', feature1 || ' ' || feature2, {_number_sql('correlation')} FROM {PAIRS_SQL}
UNION ALL SELECT 'correlations', feature2 || ' ' || feature1, {_number_sql('correlation')} FROM {PAIRS_SQL}
UNION ALL SELECT 'correlations', c || ' ' || c, '1.000000' FROM (VALUES {', '.join(f"('{c}')" for c in DIRTY_NUMERIC)}) v(c)
UNION ALL SELECT 'class_distribution', target::VARCHAR, count(*)::VARCHAR FROM dirty GROUP BY target
UNION ALL SELECT 'feature_distributions', "column", count(*)::VARCHAR FROM (""" + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", {c}::DOUBLE AS x FROM dirty WHERE {c} IS NOT NULL" for c in DIRTY_NUMERIC) + """) GROUP BY "column"
"""


@query("plot_table_facts", PLOT_SQL)
def plot_table_facts(spark, sf):
    """The plot tables that need no detector; the histograms by their totals."""
    tables = plot_tables(audit_table(dirty(spark, sf), KEY, Config(detectors=())))
    pairs = tables["correlations"].withColumn("pair", F.concat_ws(" ", "feature1", "feature2"))
    bars = tables["feature_distributions"].groupBy("column").agg(F.sum("count").alias("count"))
    parts = [_facts("missing_values", tables["missing_values"], "column", "missing"),
             _facts("correlations", pairs, "pair", "correlation"),
             _facts("class_distribution", tables["class_distribution"], "label", "count"),
             _facts("feature_distributions", bars, "column", "count")]
    return union_all(parts).withColumnRenamed("section", "plot")


@query("plot_tables")
def plot_tables_query(spark, sf):
    """The numbers behind all plots, as rows of plot name and JSON."""
    result = audit_table(dirty(spark, sf), KEY)
    parts = [frame.select(F.lit(name).alias("plot"), F.to_json(F.struct("*")).alias("row"))
             for name, frame in plot_tables(result).items()]
    return union_all(parts)


@query("audit_report")
def audit_report(spark, sf):
    return audit_table(dirty(spark, sf), KEY).report.drop("timestamp")
