"""Scores, rating and recommendations: Column expressions over rows of quality metrics.

Expected columns: missing_percentage, duplicate_percentage, balance_status, imbalance_ratio,
outlier_percentage, anomaly_percentage (NULL where no detector ran), n_anomalies, and for the
recommendations missing_severity, duplicates_severity, balance_severity.
The rules work on any number of rows, one per table, group or day.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablevitals.config import Weights
from tablevitals.functions.scalars import round_exact

COMPONENTS = ("completeness", "consistency", "balance", "integrity")

# Score rules (fixed values): (limit, score) steps, then slope and floor beyond the last limit.
COMPLETENESS_STEPS = [(1, 100), (5, 90), (10, 75), (20, 60)]
CONSISTENCY_STEPS = [(1, 95), (5, 85), (10, 70)]
BALANCE_STEPS = [(2, 100), (5, 90), (10, 75), (20, 60)]
ANOMALY_STEPS = [(5, 100), (10, 90), (15, 75), (25, 60)]
OUTLIER_STEPS = [(5, 100), (10, 90), (15, 75)]

# Ratings by overall score (fixed values).
RATINGS = [(90, "Excellent"), (80, "Very Good"), (70, "Good"), (60, "Acceptable"), (50, "Fair"), (None, "Poor")]

# Interpretations by component score (fixed texts).
INTERPRETATIONS = {
    "completeness": [(90, "Excellent data coverage"), (75, "Low missing values"),
                     (60, "Moderate missing values"), (None, "High missing values")],
    "consistency": [(95, "No duplicates"), (85, "Minor duplicates"),
                    (70, "Deduplication recommended"), (None, "Significant duplicates")],
    "balance": [(95, "Well-balanced classes"), (75, "Mild imbalance"),
                (60, "Moderate imbalance"), (None, "Severe imbalance")],
    "integrity": [(90, "Minimal anomalies"), (75, "Some anomalies"),
                  (60, "Notable anomalies"), (None, "High anomaly rate")],
}

# Recommendation texts (fixed texts); {} takes one formatted number.
OVERALL_ADVICE = {
    90: "Dataset is production-ready with excellent quality.",
    80: "Dataset quality is very good and suitable for immediate use.",
    60: "Dataset usable but requires cleaning before training.",
    50: "Dataset has multiple quality issues requiring attention.",
    None: "Major quality issues detected. Not suitable for immediate training.",
}
WEAKEST_ADVICE = {
    "balance": "Class imbalance detected (%.1f:1). Apply class weights or resampling.",
    "completeness": "%.1f%% missing values detected. Apply imputation.",
    "consistency": "%.1f%% duplicates detected. Deduplication recommended.",
    "integrity": "Review detected anomalies to separate valid outliers from errors.",
}
IMPUTE = "Apply imputation strategies for missing values (KNN, median, or mode imputation)"
DEDUPLICATE = "Remove duplicate records before model training to avoid data leakage"
MILD_IMBALANCE = [
    "Mild class imbalance (%.1f:1) is common in real-world datasets",
    "  Optional: Apply SMOTE, class weights, or stratified sampling if needed",
]
STRONG_IMBALANCE = ("Address significant class imbalance (%.1f:1 ratio) using advanced techniques "
                    "(SMOTE, ensemble methods, or cost-sensitive learning)")
MANY_ANOMALIES = [
    "%d statistical outliers detected (%.1f%%) by ML models",
    "  These are model-flagged anomalies, not confirmed errors",
    "  Recommended: Manual review to distinguish legitimate edge cases from data errors",
    "  Consider: Domain expert validation for high-impact decisions",
]
SOME_ANOMALIES = [
    "%d statistical outliers detected (%.1f%%)--typical for real-world data",
    "  Most are likely legitimate extreme values or rare combinations",
    "  Optional: Review top outliers for domain-specific relevance",
]
FEW_ANOMALIES = "Low outlier rate (%.1f%%)--within expected statistical variation"
CLOSING = [
    (90, "Dataset quality is excellent--proceed with model training confidently"),
    (80, "Dataset quality is very good--suitable for immediate use with minor preprocessing"),
    (70, "Dataset quality is good--address minor issues for optimal model performance"),
    (60, "Dataset requires targeted cleaning based on findings above before training"),
    (None, "Major quality issues detected--comprehensive data cleaning required"),
]


def _text(pattern: str, *values: Column) -> Column:
    """Formatted text; floats are rounded exactly first, as Java's own rule goes by the decimal text."""
    digits = [int(d) if d else None for d in re.findall(r"%(?:[.](\d))?[dfs]", pattern)]
    return F.format_string(pattern, *[v if d is None else round_exact(v, d) for v, d in zip(values, digits)])


def _below(value: Column, steps: list[tuple[float, float]], beyond: Column) -> Column:
    out = F.when(value.isNull(), F.lit(None).cast("double"))
    for limit, score in steps:
        out = out.when(value < limit, F.lit(float(score)))
    return out.otherwise(beyond)


def _from(value: Column, levels: list[tuple[float | None, str]]) -> Column:
    out = F.when(value.isNull(), F.lit(None).cast("string"))
    for limit, text in levels:
        out = out.otherwise(text) if limit is None else out.when(value >= limit, text)
    return out


def completeness_score(missing: Column) -> Column:
    return _below(missing, COMPLETENESS_STEPS, F.greatest(F.lit(0.0), 60.0 - (missing - 20) * 2.0))


def consistency_score(duplicates: Column) -> Column:
    beyond = F.greatest(F.lit(0.0), 70.0 - (duplicates - 10) * 3.5)
    return F.when(duplicates == 0, 100.0).otherwise(_below(duplicates, CONSISTENCY_STEPS, beyond))


def balance_score(balance_status: Column, ratio: Column) -> Column:
    beyond = F.greatest(F.lit(50.0), 60.0 - (ratio - 20) * 0.5)
    return F.when(balance_status == "not_applicable", 100.0).otherwise(_below(ratio, BALANCE_STEPS, beyond))


def integrity_score(anomalies: Column, outliers: Column) -> Column:
    """From the detectors' anomaly percentage, or the outlier percentage where no detector ran."""
    detected = _below(anomalies, ANOMALY_STEPS, F.greatest(F.lit(40.0), 60.0 - (anomalies - 25) * 1.5))
    fenced = _below(outliers, OUTLIER_STEPS, F.greatest(F.lit(50.0), 75.0 - (outliers - 15)))
    return F.when(anomalies.isNotNull(), detected).otherwise(fenced)


def score_components(metrics: DataFrame) -> DataFrame:
    """Add the four component scores and ``integrity_source`` (detectors or outliers)."""
    return metrics.select(
        "*",
        completeness_score(F.col("missing_percentage").cast("double")).alias("completeness"),
        consistency_score(F.col("duplicate_percentage").cast("double")).alias("consistency"),
        balance_score(F.col("balance_status"), F.col("imbalance_ratio").cast("double")).alias("balance"),
        integrity_score(F.col("anomaly_percentage").cast("double"),
                        F.col("outlier_percentage").cast("double")).alias("integrity"),
        F.when(F.col("anomaly_percentage").isNotNull(), "detectors").otherwise("outliers").alias("integrity_source"),
    )


def weighted_sum(weights: Weights = Weights()) -> Column:
    total = None
    for name, weight in weights.normalized().items():
        term = F.col(name) * F.lit(weight)
        total = term if total is None else total + term
    return total


def rating(overall: Column) -> Column:
    return _from(overall, RATINGS)


def weakest_component() -> Column:
    """Lowest component; the first of completeness, consistency, balance, integrity wins ties."""
    ranked = [F.struct(F.col(c).alias("score"), F.lit(i).alias("order"), F.lit(c).alias("name"))
              for i, c in enumerate(COMPONENTS)]
    return F.array_min(F.array(*ranked))["name"]


def _advice(overall: Column) -> Column:
    weakest = weakest_component()
    by_weakest = (
        F.when(weakest == "balance", _text(
            WEAKEST_ADVICE["balance"], F.coalesce(F.col("imbalance_ratio").cast("double"), F.lit(1.0))))
        .when(weakest == "completeness", _text(
            WEAKEST_ADVICE["completeness"], F.col("missing_percentage").cast("double")))
        .when(weakest == "consistency", _text(
            WEAKEST_ADVICE["consistency"], F.col("duplicate_percentage").cast("double")))
        .otherwise(WEAKEST_ADVICE["integrity"])
    )
    return (
        F.when(overall.isNull(), F.lit(None).cast("string"))
        .when(overall >= 90, OVERALL_ADVICE[90]).when(overall >= 80, OVERALL_ADVICE[80])
        .when(overall >= 70, by_weakest)
        .when(overall >= 60, OVERALL_ADVICE[60]).when(overall >= 50, OVERALL_ADVICE[50])
        .otherwise(OVERALL_ADVICE[None])
    )


def health_score(metrics: DataFrame, weights: Weights = Weights()) -> DataFrame:
    """Add components, overall_score (two decimals), rating and recommendation."""
    scored = score_components(metrics).withColumn("overall", weighted_sum(weights))
    overall = F.col("overall")
    return scored.select(
        *[c for c in scored.columns if c != "overall"],
        round_exact(overall, 2).alias("overall_score"),
        rating(overall).alias("rating"),
        _advice(overall).alias("recommendation"),
    )


def interpretation(component: str) -> Column:
    return _from(F.col(component), INTERPRETATIONS[component])


def score_details(scored: DataFrame) -> DataFrame:
    """Add one struct per component: score, the metric behind it, interpretation."""
    # Without a detector nothing was flagged; the outlier share that the score then uses has its own column.
    source = F.coalesce(F.col("anomaly_percentage"), F.lit(0.0))
    measured = {"completeness": F.col("missing_percentage"), "consistency": F.col("duplicate_percentage"),
                "balance": F.col("imbalance_ratio"), "integrity": source}
    details = [F.struct(round_exact(F.col(c), 2).alias("score"), measured[c].cast("double").alias("metric"),
                        interpretation(c).alias("interpretation")).alias(f"{c}_details") for c in COMPONENTS]
    return scored.select("*", *details)


def weighted_components(scored: DataFrame, keep: list[str], weights: Weights = Weights()) -> DataFrame:
    """Long form: ``keep`` columns, component, score, weighted (score x weight, two decimals)."""
    rows = [F.struct(F.lit(c).alias("component"), F.col(c).alias("score"),
                     round_exact(F.col(c) * F.lit(w), 2).alias("weighted"))
            for c, w in weights.normalized().items()]
    return scored.select(*keep, F.inline(F.array(*rows)))


def score_formula(weights: Weights = Weights()) -> Column:
    """``(100.0 × 0.25) + ... = 91.25``."""
    shares = weights.normalized()
    terms = " + ".join(["(%.1f × %.2f)"] * len(COMPONENTS)) + " = %.2f"
    numbers = [x for c in COMPONENTS for x in (F.col(c), F.lit(shares[c]))]
    return _text(terms, *numbers, weighted_sum(weights))


def recommendations() -> Column:
    """Ordered list of advice for one scored metrics row."""
    ratio, share = F.col("imbalance_ratio").cast("double"), F.col("anomaly_percentage").cast("double")
    count, overall = F.col("n_anomalies").cast("long"), F.col("overall_score")

    def alarming(name: str) -> Column:
        return F.col(name).isin("high", "medium")

    mild, strong = alarming("balance_severity") & (ratio < 10), alarming("balance_severity") & (ratio >= 10)
    many, some, few = share > 15, (share > 5) & (share <= 15), share <= 5
    lines = [
        F.when(alarming("missing_severity"), IMPUTE),
        F.when(alarming("duplicates_severity"), DEDUPLICATE),
        F.when(mild, _text(MILD_IMBALANCE[0], ratio)),
        F.when(mild, MILD_IMBALANCE[1]),
        F.when(strong, _text(STRONG_IMBALANCE, ratio)),
        F.when(many, _text(MANY_ANOMALIES[0], count, share)),
        *[F.when(many, text) for text in MANY_ANOMALIES[1:]],
        F.when(some, _text(SOME_ANOMALIES[0], count, share)),
        *[F.when(some, text) for text in SOME_ANOMALIES[1:]],
        F.when(few, _text(FEW_ANOMALIES, share)),
        _from(overall, CLOSING),
    ]
    return F.array_compact(F.array(*lines))


def key_findings() -> Column:
    """Short findings of a scored metrics row, in the order of the console summary."""
    ratio, share = F.col("imbalance_ratio").cast("double"), F.col("anomaly_percentage").cast("double")

    def measured(label: str, value: str, state: str) -> Column:
        return F.when(F.col(value).isNotNull(), _text(
            label + ": %.2f%% [%s]", F.col(value).cast("double"), F.upper(state)))

    balanced = F.col("balance_status") != "not_applicable"
    lines = [
        measured("Missing Values", "missing_percentage", "missing_status"),
        measured("Duplicates", "duplicate_percentage", "duplicates_status"),
        F.when(balanced, _text("Class Imbalance: %.2f:1 [%s]", ratio, F.upper("balance_status"))),
        F.when(balanced & (ratio > 5),
               "  Common in churn/attrition datasets; manageable with standard techniques"),
        F.when(share.isNotNull(), _text(
            "Statistical Outliers: %d detected (%.2f%%)", F.col("n_anomalies").cast("long"), share)),
        F.when(share.isNotNull(), "  ML-based detection; not necessarily data errors"),
        F.when(share.isNotNull(), "  Includes rare combinations, edge cases, legitimate extremes"),
        F.when(share < 15, "  Rate is within acceptable range for real-world data"),
    ]
    return F.array_compact(F.array(*lines))
