"""Outliers among embedding vectors: far from every cluster centre."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablevitals.functions.columns import col
from tablevitals.operators.anomaly.detect import percentile_labels
from tablevitals.session import materialize

#: Principal components kept, cluster centres, and the share of distances below the threshold (fixed values).
COMPONENTS, CLUSTERS, PERCENTILE = 50, 5, 0.95


def embedding_outliers(df: DataFrame, key: str, vector: str, components: int = COMPONENTS, clusters: int = CLUSTERS,
                       percentile: float = PERCENTILE, seed: int = 42) -> DataFrame:
    """One row per usable vector: the key, cluster, distance to its centre, and label (1: beyond the percentile).

    Vectors are those of the commonest length without missing or non-finite components; others are left out. They
    are projected to their principal components first, stored, and clustered by k-means.
    """
    given = df.select(col(key).alias("key"), col(vector).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    usable = given.filter(F.size("v") > 0).filter(F.coalesce(finite, F.lit(False)))
    length = usable.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if length is None:
        return df.sparkSession.createDataFrame([], f"{key} {given.schema['key'].dataType.simpleString()}, cluster int, "
                                                   "distance double, label int")
    rows = usable.filter(F.size("v") == length["n"]).select("key", array_to_vector("v").alias("features"))
    pca = PCA(k=min(components, length["n"]), inputCol="features", outputCol="projected").fit(rows)
    projected = materialize(pca.transform(rows).select("key", vector_to_array("projected").alias("p")))
    points = projected.select("key", "p", array_to_vector("p").alias("features"))
    model = KMeans(k=clusters, seed=seed, featuresCol="features", predictionCol="cluster").fit(points)
    centres = F.array(*[F.array(*[F.lit(float(x)) for x in centre]) for centre in model.clusterCenters()])
    gaps = F.zip_with("p", F.get(centres, F.col("cluster")), lambda a, b: (a - b) * (a - b))
    distance = F.sqrt(F.aggregate(gaps, F.lit(0.0), lambda total, x: total + x))
    scored = materialize(model.transform(points).select("key", "cluster", distance.alias("distance")))
    return percentile_labels(scored, "distance", percentile, "label").withColumnRenamed("key", key)
