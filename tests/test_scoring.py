"""Scores, statuses and texts by hand-worked rows."""

import pytest
from pyspark.sql import functions as F

from tablevitals.config import FILE_THRESHOLDS, Config, Thresholds, Weights
from tablevitals.plans import checks, scoring

SCHEMA = ("name string, missing_percentage double, duplicate_percentage double, balance_status string, "
          "imbalance_ratio double, outlier_percentage double, anomaly_percentage double, n_anomalies long, "
          "missing_severity string, duplicates_severity string, balance_severity string, "
          "missing_status string, duplicates_status string")

CASES = [
    ("perfect", 0.0, 0.0, "excellent", 1.2, None, 2.0, 20, "low", "low", "low", "excellent", "excellent"),
    ("churn", 0.0, 0.0, "good", 6.0, None, 13.5, 135, "low", "low", "medium", "excellent", "excellent"),
    ("poor", 35.0, 15.0, "poor", 50.0, None, 40.0, 400, "high", "high", "high", "poor", "poor"),
    ("example", 0.0, 0.0, "good", 6.0, None, 7.0, 92, "low", "low", "low", "excellent", "excellent"),
    ("fallback", 1.69, 1.92, "poor", 6.9131, 2.12, None, None, "low", "low", "high", "excellent", "good"),
    ("weak", 21.0, 0.5, "not_applicable", None, 17.0, None, None, "high", "low", "low", "poor", "excellent"),
]

# completeness, consistency, balance, integrity, overall, rating
EXPECTED = {
    "perfect": (100, 100, 100, 100, 100.0, "Excellent"),
    "churn": (100, 100, 75, 75, 87.5, "Very Good"),
    "poor": (30, 52.5, 50, 40, 43.12, "Poor"),
    "example": (100, 100, 75, 90, 91.25, "Excellent"),
    "fallback": (90, 85, 75, 100, 87.5, "Very Good"),
    "weak": (58, 95, 100, 73, 81.5, "Very Good"),
}


@pytest.fixture(scope="module")
def scored(spark):
    metrics = spark.createDataFrame(CASES, SCHEMA)
    frame = scoring.score_details(scoring.health_score(metrics)).select(
        "*", scoring.recommendations().alias("advice"), scoring.key_findings().alias("findings"),
        scoring.score_formula().alias("formula"))
    return {r["name"]: r for r in frame.collect()}


@pytest.mark.parametrize("name", EXPECTED)
def test_scores(scored, name):
    row = scored[name]
    assert tuple(row[c] for c in (*scoring.COMPONENTS, "overall_score", "rating")) == EXPECTED[name]


def test_formula(scored):
    assert scored["example"]["formula"] == (
        "(100.0 × 0.25) + (100.0 × 0.25) + (75.0 × 0.25) + (90.0 × 0.25) = 91.25")


def test_details(scored):
    assert scored["example"]["balance_details"].asDict() == {
        "score": 75.0, "metric": 6.0, "interpretation": "Mild imbalance"}
    assert scored["fallback"]["integrity_source"] == "outliers"
    assert scored["fallback"]["integrity_details"]["metric"] == 0.0
    assert scored["poor"]["completeness_details"]["interpretation"] == "High missing values"


def test_recommendations(scored):
    assert scored["perfect"]["advice"] == [
        "Low outlier rate (2.0%)--within expected statistical variation",
        "Dataset quality is excellent--proceed with model training confidently"]
    churn = scored["churn"]["advice"]
    assert churn[0] == "Mild class imbalance (6.0:1) is common in real-world datasets"
    assert churn[2].startswith("135 statistical outliers detected (13.5%)--typical")
    poor = scored["poor"]["advice"]
    assert [t.split()[0] for t in poor[:3]] == ["Apply", "Remove", "Address"]
    assert poor[-1].startswith("Major quality issues")
    assert len(poor) == 8


def test_findings(scored):
    assert scored["poor"]["findings"][:4] == [
        "Missing Values: 35.00% [POOR]", "Duplicates: 15.00% [POOR]", "Class Imbalance: 50.00:1 [POOR]",
        "  Common in churn/attrition datasets; manageable with standard techniques"]
    assert not any("Class Imbalance" in t for t in scored["weak"]["findings"])


def test_advice_names_the_weakest_component(spark):
    """Overall 70 to 80, each component weakest in turn, and a tie that the first one wins."""
    cases = [("a", 45.0, 0.0, 1.0, 0.0), ("b", 0.0, 25.0, 1.0, 0.0), ("c", 0.0, 3.0, 40.0, 20.0),
             ("d", 0.0, 0.0, 15.0, 39.0), ("tie", 5.0, 5.5, 5.0, 10.0)]
    frame = spark.createDataFrame(cases, "name string, missing_percentage double, duplicate_percentage double, "
                                         "imbalance_ratio double, anomaly_percentage double")
    frame = frame.withColumns({"balance_status": F.lit("good"), "outlier_percentage": F.lit(0.0)})
    found = {r["name"]: (r["overall_score"], r["recommendation"]) for r in scoring.health_score(frame).collect()}
    assert found == {
        "a": (77.5, "45.0% missing values detected. Apply imputation."),
        "b": (79.38, "25.0% duplicates detected. Deduplication recommended."),
        "c": (73.75, "Class imbalance detected (40.0:1). Apply class weights or resampling."),
        "d": (75.0, "Review detected anomalies to separate valid outliers from errors."),
        "tie": (73.75, "5.5% duplicates detected. Deduplication recommended."),
    }


def test_nothing_measured_gives_no_score(spark):
    frame = spark.createDataFrame([(None, None, "not_applicable", None, None, None)],
                                  "missing_percentage double, duplicate_percentage double, balance_status string, "
                                  "imbalance_ratio double, outlier_percentage double, anomaly_percentage double")
    row = scoring.health_score(frame).first()
    assert row["overall_score"] is None and row["rating"] is None and row["recommendation"] is None


def test_weights_are_normalized(spark):
    weights = Weights(completeness=2, consistency=1, balance=1, integrity=0)
    assert weights.normalized() == {"completeness": 0.5, "consistency": 0.25, "balance": 0.25, "integrity": 0.0}
    metrics = spark.createDataFrame(CASES, SCHEMA)
    row = scoring.health_score(metrics, weights).filter("name = 'poor'").first()
    assert row["overall_score"] == 40.62  # 40.625, half to even
    shares = {r["component"]: r["weighted"] for r in scoring.weighted_components(
        scoring.score_components(metrics), ["name"]).filter("name = 'example'").collect()}
    assert shares == {"completeness": 25.0, "consistency": 25.0, "balance": 18.75, "integrity": 22.5}


@pytest.mark.parametrize("value, expected", [(1.99, "excellent"), (2.0, "good"), (4.99, "good"), (5.0, "fair"),
                                             (15.0, "poor"), (None, "not_applicable")])
def test_status_limits(spark, value, expected):
    frame = spark.createDataFrame([(value,)], "v double")
    state = checks.status(F.col("v"), Thresholds().missing_values)
    assert frame.select(state.alias("s")).first()["s"] == expected


def test_severity(spark):
    frame = spark.createDataFrame([("poor",), ("fair",), ("good",)], "s string")
    assert [r[0] for r in frame.select(checks.severity(F.col("s"))).collect()] == ["high", "medium", "low"]
    assert [r[0] for r in frame.select(checks.outlier_severity(F.col("s"))).collect()] == ["medium", "medium", "low"]


def test_config_from_dict(tmp_path):
    config = Config.from_dict({
        "quality_thresholds": {"missing_values": {"excellent": 1, "good": 5, "fair": 10, "poor": 20},
                               "outliers": {"iqr_multiplier": 1.5}},
        "scoring": {"balance_weight": 0.5, "score_ranges": {"excellent": 90}},
        "ml_models": {"isolation_forest": {"contamination": 0.05, "n_jobs": -1},
                      "autoencoder": {"hidden_layers": [8, 4], "epochs": 30}},
    })
    assert config.thresholds.missing_values == FILE_THRESHOLDS.missing_values
    assert config.thresholds.outliers == Thresholds().outliers
    assert config.weights.balance == 0.5
    assert config.forest.contamination == 0.05 and config.forest.n_estimators == 100
    assert config.autoencoder.hidden_layers == (8, 4)
    path = tmp_path / "settings.json"
    path.write_text('{"scoring": {"balance_weight": 1}}')
    assert Config.load(str(path)).weights.balance == 1.0
