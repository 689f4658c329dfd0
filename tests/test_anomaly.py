"""Detectors: planted outliers, shares, determinism, failures, whole audits."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablevitals.config import AutoencoderParams, Config, ForestParams
from tablevitals.operators.anomaly import detect as detect_module
from tablevitals.operators.anomaly.detect import (anomaly_summary, anomaly_threshold, detect, minmax_score,
                                                  percentile_labels)
from tablevitals.operators.anomaly.embeddings import embedding_outliers
from tablevitals.operators.anomaly.forest import (draw_samples, expected_path, fit_forest, forest_score,
                                                  forest_scores, grow_tree)
from tablevitals.operators.anomaly.network import fit_network, gradient, initial_weights, layer_sizes, network_error, reconstruct
from tablevitals.operators.anomaly.reconstruction import fit_pca, pca_error, sketch_of
from tablevitals.plans.audit import audit_table, plot_tables, score_table

FEATURES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def planted(spark):
    """2000 rows on a plane with noise; the last 20 lie far off."""
    rng = np.random.default_rng(0)
    n = 2000
    a, b = rng.normal(0, 1, n), rng.normal(0, 1, n)
    data = pd.DataFrame({"id": np.arange(n), "a": a, "b": b, "c": a + b + rng.normal(0, 0.1, n)})
    data.loc[n - 20:, "c"] += rng.choice([-12.0, 12.0], 20)
    data.loc[5, "a"] = np.nan
    return spark.createDataFrame(data).repartition(4).persist()


def worst(frame, score, n=20):
    return {r["id"] for r in frame.orderBy(F.desc(score)).limit(n).collect()}


PLANTED_IDS = set(range(1980, 2000))


def test_expected_path():
    assert [expected_path(n) for n in (0, 1, 2)] == [0.0, 0.0, 1.0]
    harmonic = sum(1 / i for i in range(1, 256))
    assert expected_path(256) == pytest.approx(2 * harmonic - 2 * 255 / 256, abs=0.01)


def test_tree_against_a_plain_walk():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(64, 3))
    feature, threshold, path = grow_tree(x, 6, np.random.default_rng(2))
    forest = {"feature": feature[None].astype(np.int64), "threshold": threshold[None], "path": path[None], "depth": 6, "scale": 2.0}
    found = forest_scores(x, forest)
    for row, score in zip(x, found):
        node = 0
        for _ in range(6):
            node = 2 * node + 1 + int(row[feature[node]] >= threshold[node])
        assert score == pytest.approx(2 ** (-path[node - 63] / 2.0))
    # Every leaf's depth plus the search in its rows adds up to a sensible mean.
    assert 2 < -np.log2(found).mean() * 2.0 < 12


def test_scores_agree_with_a_textbook_forest():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(1000, 3))
    x[:15] *= 6

    def grow(part, level):
        usable = [j for j in range(3) if part[:, j].min() < part[:, j].max()] if len(part) > 1 else []
        if level == 8 or not usable:
            return level + expected_path(len(part))
        j = rng.choice(usable)
        cut = rng.uniform(part[:, j].min(), part[:, j].max())
        return j, cut, grow(part[part[:, j] < cut], level + 1), grow(part[part[:, j] >= cut], level + 1)

    def walk(row, node):
        while isinstance(node, tuple):
            node = node[2] if row[node[0]] < node[1] else node[3]
        return node

    plain = [grow(x[rng.choice(1000, 256, False)], 0) for _ in range(100)]
    expected = np.array([2 ** (-np.mean([walk(row, t) for t in plain]) / expected_path(256)) for row in x])
    trees = [grow_tree(x[rng.choice(1000, 256, False)], 8, rng) for _ in range(100)]
    forest = {"feature": np.array([t[0] for t in trees], dtype=np.int64), "threshold": np.array([t[1] for t in trees]),
              "path": np.array([t[2] for t in trees]), "depth": 8, "scale": expected_path(256)}
    found = forest_scores(x, forest)
    assert np.corrcoef(found, expected)[0, 1] > 0.97
    assert abs(found.mean() - expected.mean()) < 0.03


def test_constant_rows_cannot_be_split():
    feature, threshold, path = grow_tree(np.ones((10, 2)), 4, np.random.default_rng(0))
    assert np.isinf(threshold).all() and path[0] == expected_path(10)


@pytest.mark.parametrize("n_rows, params", [(2000, ForestParams(n_estimators=7, max_samples=50)),
                                            (2000, ForestParams(n_estimators=3, max_samples=64)),
                                            (100, ForestParams(n_estimators=5, max_samples=256))])
def test_samples_have_the_asked_size(planted, n_rows, params):
    frame = planted.filter(F.col("id") < n_rows)
    drawn = draw_samples(frame, FEATURES, params, n_rows, ["id"])
    counts = {r["tree"]: r["count"] for r in drawn.groupBy("tree").count().collect()}
    assert counts == {t: min(params.max_samples, n_rows) for t in range(params.n_estimators)}


def test_large_table_draw(spark):
    """One draw per row: every tree is full and no row serves two trees."""
    frame = spark.range(200_000).select("id", F.rand(3).alias("x"))
    params = ForestParams(n_estimators=100, max_samples=256)
    drawn = draw_samples(frame, ["x"], params, 200_000, ["id"])
    assert drawn.count() == 25_600
    assert drawn.select("f0").distinct().count() > 25_500


def test_draw_from_trillions_does_not_overflow(spark):
    frame = spark.range(1000).select("id", F.rand(3).alias("x"))
    assert draw_samples(frame, ["x"], ForestParams(), 5 * 10 ** 12, ["id"]).count() == 0


def test_copies_weigh_in_by_number_without_a_key(spark):
    """A third of the rows are the same; so is about a third of each sample."""
    frame = spark.range(60_000).select(F.when(F.col("id") % 3 == 0, 1.0).otherwise(F.rand(5)).alias("x"))
    drawn = draw_samples(frame, ["x"], ForestParams(n_estimators=50), 60_000)
    share = drawn.agg(F.avg((F.col("f0") == 1.0).cast("int"))).first()[0]
    assert 0.30 < share < 0.37


def test_forest_finds_planted_rows(planted):
    forest = fit_forest(planted, FEATURES, key=["id"])
    scored = planted.select("id", forest_score(planted, FEATURES, forest).alias("s"))
    assert PLANTED_IDS <= worst(scored, "s", 100)
    low, high = scored.agg(F.min("s"), F.max("s")).first()
    assert 0.3 < low < 0.5 < high < 1.0


def test_forest_does_not_depend_on_partitions(planted):
    first = fit_forest(planted.repartition(2), FEATURES, key=["id"])
    second = fit_forest(planted.repartition(11), FEATURES, key=["id"])
    assert all(np.array_equal(first[k], second[k]) for k in ("feature", "threshold", "path"))


def test_forest_size_is_bounded(planted):
    with pytest.raises(ValueError):
        fit_forest(planted, FEATURES, ForestParams(n_estimators=100_000), n_rows=2000)


def test_pca_error_against_numpy(planted, monkeypatch):
    model = fit_pca(planted, FEATURES)
    assert model["n_components"] == 1
    x = planted.orderBy("id").toPandas()[FEATURES].fillna(0.0).to_numpy()
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    _, vectors = np.linalg.eigh(z.T @ z / len(z))
    kept = vectors[:, -1:]
    expected = np.square(z - z @ kept @ kept.T).mean(axis=1)
    found = [r["e"] for r in planted.select("id", pca_error(planted, FEATURES, model).alias("e")).orderBy("id").collect()]
    assert found == pytest.approx(list(expected), rel=1e-6, abs=1e-9)
    wider = fit_pca(planted, [*FEATURES, *FEATURES], AutoencoderParams(encoding_dim=2))
    assert (model["n_components"], wider["n_components"], wider["axes"].shape) == (1, 2, (6, 2))


@pytest.mark.parametrize("most", [30, 200])
def test_sketch_keeps_its_error_bound(spark, most):
    """Frequent Directions over many partitions, against the exact products."""
    draw, k = np.random.default_rng(3), 120
    a = draw.normal(size=(3000, 8)) @ draw.normal(size=(8, k)) * 3 + draw.normal(size=(3000, k))
    frame = spark.createDataFrame(pd.DataFrame(a, columns=[f"c{i}" for i in range(k)])).repartition(70)
    b = sketch_of(frame, most)
    assert len(b) <= min(most, k)
    off, energy = np.linalg.norm(a.T @ a - b.T @ b, 2), np.linalg.svd(a, compute_uv=False) ** 2
    if most >= k:
        assert off < 1e-8 * energy.sum()
    else:
        assert off <= min(energy[c:].sum() / (most - c) for c in range(most))
        strong = np.linalg.svd(b)[2][:8]
        assert np.square(a - a @ strong.T @ strong).sum() <= 1.02 * energy[8:].sum()


def test_components_of_many_columns(spark):
    """More columns than a sketch has rows: the planted rows still stand out most."""
    draw, k, names = np.random.default_rng(4), 560, [f"c{i}" for i in range(560)]
    a = draw.normal(size=(900, 3)) @ draw.normal(size=(3, k)) + 0.1 * draw.normal(size=(900, k))
    a[:5] = 3 * draw.normal(size=(5, k))
    frame = spark.createDataFrame(pd.DataFrame(a, columns=names).assign(id=range(900)))
    model = fit_pca(frame, names, AutoencoderParams(encoding_dim=3))
    top = frame.select("id", pca_error(frame, names, model).alias("e")).orderBy(F.desc("e")).limit(5).collect()
    assert {r.id for r in top} == set(range(5))


def test_network_gradient_against_differences():
    sizes = layer_sizes(3, AutoencoderParams(hidden_layers=(5,), encoding_dim=2))
    # Biases off zero, where relu has no derivative.
    flat = initial_weights(sizes, 0) + np.random.default_rng(2).normal(0, 0.1, 65)
    x = np.random.default_rng(1).normal(size=(8, 3))

    def loss(w):
        return np.square(reconstruct(x, w, sizes)[-1] - x).mean()

    g = gradient(x, flat, sizes)
    for i in range(0, len(flat), 7):
        step = np.zeros_like(flat)
        step[i] = 1e-6
        assert g[i] == pytest.approx((loss(flat + step) - loss(flat - step)) / 2e-6, abs=1e-6)


def test_network_learns(planted):
    params = AutoencoderParams(kind="mlp", epochs=15)
    model = fit_network(planted, FEATURES, params, ["id"])
    assert 1 <= model["epochs"] <= 15 and model["validation_loss"] < 0.5
    scored = planted.select("id", network_error(planted, FEATURES, model).alias("e"))
    assert len(worst(scored, "e") & PLANTED_IDS) >= 15


def test_detect_shares_and_columns(planted):
    found = detect(planted, ["id"], FEATURES)
    assert found.status == {"isolation_forest": "ok", "autoencoder": "ok"}
    rows = found.rows
    assert rows.columns == ["id", "isolation_forest_label", "isolation_forest_score", "autoencoder_label",
                            "autoencoder_score", "anomaly_label", "anomaly_score"]
    stats = rows.agg(F.sum("isolation_forest_label"), F.sum("autoencoder_label"), F.count("*"),
                     F.min("isolation_forest_score"), F.max("autoencoder_score")).first()
    assert stats[0] == 200 and stats[1] == 100 and stats[2] == 2000
    assert stats[3] == 0.0 and stats[4] == pytest.approx(1.0, abs=1e-6)
    either = rows.filter("anomaly_label != greatest(isolation_forest_label, autoencoder_label)").count()
    assert either == 0
    summary = found.summary().first()
    assert summary["anomaly_percentage"] == round(summary["n_anomalies"] / 2000 * 100, 2)


def test_network_as_detector(planted):
    config = Config(detectors=("autoencoder",), autoencoder=AutoencoderParams(kind="mlp", epochs=2))
    assert detect(planted, ["id"], FEATURES, config).summary().first()["n_anomalies"] == 100


def test_failed_detector_does_not_stop_the_other(planted, monkeypatch):
    def broken(*args, **kwargs):
        raise RuntimeError("no forest today")

    monkeypatch.setattr(detect_module, "fit_forest", broken)
    found = detect(planted, ["id"], FEATURES)
    assert found.status == {"isolation_forest": "failed: no forest today", "autoencoder": "ok"}
    assert found.rows.columns[-2:] == ["anomaly_label", "anomaly_score"]


def test_failed_scoring_is_told_apart(planted, monkeypatch):
    def broken_score(df, columns, model):
        return F.raise_error(F.lit("cannot score")).cast("double")

    monkeypatch.setattr(detect_module, "forest_score", broken_score)
    found = detect(planted, ["id"], FEATURES)
    assert found.status["autoencoder"] == "ok" and "cannot score" in found.status["isolation_forest"]
    assert found.usable


def test_shared_key_does_not_starve_its_rows(spark):
    """A third of the rows share one key: they draw by their features, and turn up in the samples all the same."""
    frame = spark.range(60_000).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"),
        F.when(F.col("id") % 3 == 0, F.randn(1) + 50).otherwise(F.randn(2)).alias("x"))
    found = detect(frame, ["k"], ["x"], Config(detectors=("isolation_forest",)))
    labelled = found.rows.filter("k = 0").agg(F.avg("anomaly_label")).first()[0]
    assert labelled < 0.3 and found.rows.count() == 60_000


@pytest.mark.parametrize("n_rows", [3, 200, 700, 20_000])
def test_one_draw_rule_for_every_size(spark, n_rows):
    """Each tree gets its number of distinct rows, and the draw doesn't depend on the partitions."""
    frame = spark.range(n_rows).select("id", (F.col("id") * 7.5).alias("x"))
    params = ForestParams(n_estimators=20, max_samples=64)
    drawn = draw_samples(frame, ["x"], params, n_rows, ["id"])
    counts = drawn.groupBy("tree").agg(F.count("*").alias("n"), F.count_distinct("f0").alias("d")).collect()
    assert len(counts) == 20 and {(r["n"], r["d"]) for r in counts} == {(min(64, n_rows),) * 2}
    again = draw_samples(frame.repartition(7), ["x"], params, n_rows, ["id"])
    assert sorted(drawn.collect()) == sorted(again.collect())


@pytest.mark.parametrize("kind", ["pca", "mlp"])
def test_one_feature(planted, kind):
    config = Config(autoencoder=AutoencoderParams(kind=kind, epochs=1))
    found = detect(planted, ["id"], ["c"], config)
    assert set(found.status.values()) == {"ok"}
    assert PLANTED_IDS <= worst(found.rows, "isolation_forest_score", 40)


def test_nothing_to_detect(spark):
    texts = spark.createDataFrame([("a",)], "s string")
    assert detect(texts).status == {"isolation_forest": "skipped: no numeric columns",
                                    "autoencoder": "skipped: no numeric columns"}
    assert not detect(spark.createDataFrame([], "x double")).usable


def test_all_detectors_failing_falls_back_to_outliers(planted, monkeypatch):
    def broken(*args, **kwargs):
        raise RuntimeError("no")

    monkeypatch.setattr(detect_module, "fit_forest", broken)
    monkeypatch.setattr(detect_module, "fit_pca", broken)
    found = detect(planted, ["id"], FEATURES)
    assert not found.usable
    assert score_table(planted, found).first()["integrity_source"] == "outliers"


def test_labels_and_threshold(spark):
    frame = spark.range(100).select("id", F.col("id").cast("double").alias("s"))
    labelled = minmax_score(percentile_labels(frame, "s", 0.95), "s")
    assert anomaly_summary(labelled).first()["n_anomalies"] == 5
    assert anomaly_threshold(labelled).first()["threshold"] == pytest.approx(95 / 99)
    nobody = labelled.withColumn("anomaly_label", F.lit(0))
    assert anomaly_threshold(nobody).first()["threshold"] == 0.8


def test_embedding_outliers(spark):
    rng = np.random.default_rng(4)
    rows = [(i, (np.eye(8)[i % 3] * 10 + rng.normal(0, 0.1, 8)).tolist()) for i in range(300)]
    rows += [(1000, [40.0] * 8), (1001, None), (1002, [1.0]), (1003, [float("nan")] * 8), (1004, [])]
    frame = spark.createDataFrame(rows, "id long, v array<double>")
    found = {r["id"]: r for r in embedding_outliers(frame, "id", "v", components=4, clusters=3, percentile=0.99).collect()}
    assert len(found) == 301 and sum(r["label"] for r in found.values()) == 3
    spread = [r["distance"] for r in found.values() if r["id"] != 1000]
    assert max(spread) < 20 and all(r["distance"] >= 0 for r in found.values())
    assert embedding_outliers(frame.filter("id > 1000 AND id <> 1002"), "id", "v").collect() == []


def test_single_row_and_constant_table(spark):
    one = spark.createDataFrame([(1.0, 2.0)], "x double, y double")
    assert detect(one).rows.count() == 1
    flat = spark.range(50).select(F.lit(3.0).alias("x"), F.lit(1.0).alias("y"))
    summary = detect(flat).summary().first()
    assert summary["n_rows"] == 50 and summary["n_anomalies"] == 0


def test_audit_of_a_table(planted):
    result = audit_table(planted.withColumn("label", F.when(F.col("id") % 8 == 0, "x").otherwise("y")), ["id"])
    report = result.report.first().asDict(recursive=True)
    assert report["profile"]["basic_info"]["n_rows"] == 2000
    assert report["profile"]["missing_values"]["total_missing"] == 1
    assert report["profile"]["missing_values"]["columns"][0]["column"] == "a"
    assert {s["column"] for s in report["profile"]["statistics"]} == {"id", "a", "b", "c"}
    assert report["checks"]["imbalance_ratio"] == 7.0
    assert report["scores"]["integrity_source"] == "detectors"
    assert [d["status"] for d in report["anomalies"]["detectors"]] == ["ok", "ok"]
    assert report["recommendations"] and report["key_findings"]
    assert result.profile.first_duplicates.count() == 0
    assert report["scores"]["weights"] == dict.fromkeys(["completeness", "consistency", "balance", "integrity"], 0.25)
    assert {r["label"]: r["count"] for r in report["checks"]["class_distribution"]} == {"x": 250, "y": 1750}
    assert {r["column"] for r in report["checks"]["outliers_per_column"]} == {"id", "a", "b", "c"}
    for found in report["anomalies"]["detectors"]:
        assert found["n_anomalies"] > 0 and found["threshold"] is not None
        assert found["anomaly_percentage"] == pytest.approx(found["n_anomalies"] / 20, abs=0.006)
    assert {(r["feature1"], r["feature2"]) for r in result.profile.high_correlations.collect()} <= {
        ("a", "c"), ("b", "c")}


def test_audit_without_the_label_and_key(planted):
    data = planted.withColumn("label", (F.col("id") % 8 == 0).cast("int"))
    result = audit_table(data, ["id"], Config(exclude=("id", "label")))
    assert result.scores.first()["total_outliers"] < 100
    tables = plot_tables(result)
    assert set(tables) == {"components", "missing_values", "correlations", "feature_distributions", "missing_pattern",
                           "class_distribution", "anomaly_scores"}
    assert {r["label"]: r["count"] for r in tables["class_distribution"].collect()} == {0: 1750, 1: 250}
    assert tables["anomaly_scores"].agg(F.sum("count")).first()[0] == 2000
    assert plot_tables(audit_table(planted, ["id"]))["class_distribution"].count() == 0


def test_report_and_scores_read_no_table_again(planted):
    """All that report and scores need is known when the audit is done."""
    result = audit_table(planted, ["id"], Config(detectors=()))
    for frame in (result.report, result.scores, result.profile.missing, result.profile.statistics):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "FileScan" not in plan and "InMemory" not in plan and "Exchange hashpartitioning" not in plan


def test_many_columns_keep_their_sections(spark):
    frame = spark.range(40).select("id", *[F.pmod(F.xxhash64("id", F.lit(i)), F.lit(1000)).alias(f"x{i}") for i in range(110)])
    result = audit_table(frame, ["id"], Config(detectors=()))
    assert result.profile.correlations.count() == 111 ** 2
    report = result.report.first()
    assert len(report["profile"]["statistics"]) == len(report["checks"]["outliers_per_column"]) == 111
    assert plot_tables(result)["feature_distributions"].select("column").distinct().count() == 111


def test_audit_of_texts_only(spark):
    frame = spark.createDataFrame([("a", "x"), ("b", "y"), ("a", "x")], "s string, label string")
    row = audit_table(frame).scores.first()
    assert row["outliers_status"] == "not_applicable" and row["integrity"] == 100.0
    assert row["duplicate_percentage"] == 33.33


def test_audit_of_an_empty_table(spark):
    row = audit_table(spark.createDataFrame([], "x double, s string")).scores.first()
    assert row["overall_score"] is None and row["missing_status"] == "not_applicable"
