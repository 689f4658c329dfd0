"""A synthetic table with anomalies and missing cells, the same under any partitioning."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablevitals.operators.quantiles import value_at_rank

MISSING_SHARE = 0.05
ANOMALY_SCALE = 5.0
CATEGORIES = ("A", "B", "C")
TARGET_SHARE = 0.3


def _uniform(purpose: str, seed: int) -> Column:
    """(0, 1) from a hash of the row id; every cell has its own ``purpose``."""
    hashed = F.shiftrightunsigned(F.xxhash64("id", F.lit(purpose), F.lit(seed)), 11)
    return (hashed + 0.5) / float(2 ** 53)


def _normal(purpose: str, seed: int) -> Column:
    """Standard normal by Box and Muller."""
    radius = F.sqrt(-2.0 * F.log(_uniform(purpose + "/r", seed)))
    return radius * F.cos(2 * math.pi * _uniform(purpose + "/a", seed))


def create_sample_data(spark: SparkSession, n_samples: int = 1000, n_features: int = 10,
                       anomaly_ratio: float = 0.1, seed: int = 42) -> DataFrame:
    """feature_0.., category and target; ``anomaly_ratio`` of the rows are spread by another five standard deviations,
    and five percent of all cells are missing."""
    return sample_rows(spark.range(n_samples), n_samples, n_features, anomaly_ratio, seed)


def sample_rows(ids: DataFrame, n_samples: int, n_features: int = 10, anomaly_ratio: float = 0.1,
                seed: int = 42, keep: tuple[str, ...] = ()) -> DataFrame:
    """One synthetic row per value of the column ``id``; ``keep`` columns come along.

    Exactly ``int(n_samples * anomaly_ratio)`` rows are anomalies: those with the smallest hashes, up
    to the hash at that rank.
    """
    n_anomalies = int(n_samples * anomaly_ratio)
    draw = _uniform("anomaly", seed)
    if n_anomalies:
        last = value_at_rank(ids.select(draw.alias("u")), "u", n_anomalies - 1)
        anomalous = (draw <= F.lit(last)).cast("double")
    else:
        anomalous = F.lit(0.0)
    rows = ids.withColumn("anomalous", anomalous)

    def holed(value: Column, name: str) -> Column:
        return F.when(_uniform("missing/" + name, seed) >= MISSING_SHARE, value).alias(name)

    features = []
    for i in range(n_features):
        spread = F.col("anomalous") * ANOMALY_SCALE * _normal(f"spread/{i}", seed)
        features.append(holed(_normal(f"feature/{i}", seed) + spread, f"feature_{i}"))
    category = F.element_at(F.array(*[F.lit(c) for c in CATEGORIES]),
                            (F.floor(_uniform("category", seed) * len(CATEGORIES)) + 1).cast("int"))
    target = (_uniform("target", seed) < TARGET_SHARE).cast("int")
    return rows.select(*keep, *features, holed(category, "category"), holed(target, "target"))
