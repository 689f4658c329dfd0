"""From raw detector scores to labels, and both detectors run together."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablevitals.config import Config
from tablevitals.functions.columns import col, numeric_columns
from tablevitals.functions.scalars import round_exact
from tablevitals.operators.anomaly.forest import fit_forest, forest_score
from tablevitals.operators.anomaly.network import fit_network, network_error
from tablevitals.operators.anomaly.reconstruction import fit_pca, pca_error
from tablevitals.operators.quantiles import quantile_values
from tablevitals.session import materialize, spread as spread_rows

#: Added to the span of a min-max score (fixed value).
SPAN_GUARD = 1e-8

#: Threshold shown when no row is labelled (fixed value).
DEFAULT_THRESHOLD = 0.8


def minmax_score(df: DataFrame, column: str, output: str = "anomaly_score") -> DataFrame:
    """(x - min) / (max - min + 1e-8) over the whole column."""
    ends = df.agg(F.struct(F.min(col(column)).alias("lo"), F.max(col(column)).alias("hi")).alias("e")).scalar()
    return df.withColumn(output, (col(column) - ends["lo"]) / (ends["hi"] - ends["lo"] + SPAN_GUARD))


def percentile_labels(df: DataFrame, column: str, percentile: float, output: str = "anomaly_label") -> DataFrame:
    """1 where the score lies strictly above its given percentile (0..1), else 0."""
    threshold = quantile_values(df, [percentile], [column])[column][0]
    above = col(column) > F.lit(threshold).cast("double")
    return df.withColumn(output, F.coalesce(above.cast("int"), F.lit(0)))


def combine(labels: Sequence[Column], scores: Sequence[Column]) -> tuple[Column, Column]:
    """Ensemble label (any detector's) and score (mean over the detectors)."""
    label = F.greatest(*labels) if len(labels) > 1 else labels[0]
    total = scores[0]
    for score in scores[1:]:
        total = total + score
    return label, total / float(len(scores))


def anomaly_summary(rows: DataFrame, label: str = "anomaly_label") -> DataFrame:
    """One row: n_rows, n_anomalies, anomaly_percentage (two decimals)."""
    return rows.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.coalesce(F.sum(label), F.lit(0)).cast("long").alias("n_anomalies"),
        round_exact(F.try_divide(F.sum(label), F.count(F.lit(1))) * 100, 2).alias("anomaly_percentage"),
    )


def anomaly_threshold(rows: DataFrame, label: str = "anomaly_label", score: str = "anomaly_score") -> DataFrame:
    """One row: the lowest score of a labelled row, 0.8 without any."""
    lowest = F.min(F.when(F.col(label) == 1, F.col(score)))
    return rows.agg(F.coalesce(lowest, F.lit(DEFAULT_THRESHOLD)).alias("threshold"))



@dataclass
class Detection:
    """``rows``: key columns, label and score per detector, anomaly_label and anomaly_score.

    ``rows`` is None when no detector gave a result. ``status`` maps detector -> ok, skipped or
    failed, with the reason.
    """

    rows: DataFrame | None
    status: dict[str, str]
    #: The raw score above which a detector labels a row.
    thresholds: dict[str, float] = field(default_factory=dict)

    @property
    def usable(self) -> bool:
        return self.rows is not None

    def summary(self) -> DataFrame | None:
        return anomaly_summary(self.rows) if self.usable else None


def _fit(name: str, df: DataFrame, columns: list[str], key: Sequence[str], config: Config, n_rows: int) -> Column:
    if name == "isolation_forest":
        return forest_score(df, columns, fit_forest(df, columns, config.forest, key, n_rows))
    if name != "autoencoder":
        raise ValueError(f"unknown detector {name}")
    if config.autoencoder.kind == "pca":
        return pca_error(df, columns, fit_pca(df, columns, config.autoencoder))
    return network_error(df, columns, fit_network(df, columns, config.autoencoder, key))


def detect(df: DataFrame, key: Sequence[str] = (), columns: Sequence[str] | None = None,
           config: Config = Config(), spread: bool = True, n_rows: int | None = None) -> Detection:
    """Run the configured detectors over the numeric columns.

    The raw scores of all detectors are computed side by side in one pass and stored (reliably, with
    the key columns, not the whole rows); thresholds, scaling and labels then read that narrow table.
    A detector that fails does not stop the other one. ``spread`` lets a table of few partitions use all
    cores; ``n_rows`` saves counting where it is known.
    """
    columns = list(columns if columns is not None else numeric_columns(df, config.exclude))
    status: dict[str, str] = {}
    if not columns:
        return Detection(None, {name: "skipped: no numeric columns" for name in config.detectors})
    n_rows = df.count() if n_rows is None else n_rows
    if not n_rows:
        return Detection(None, {name: "skipped: no rows" for name in config.detectors})
    df = df.select(*[col(c) for c in dict.fromkeys([*key, *columns])])
    if spread:
        df = spread_rows(df)
    raw: dict[str, Column] = {}
    with ThreadPoolExecutor(len(config.detectors)) as pool:  # the fits share the cluster
        fit_in_thread = inheritable_thread_target(df.sparkSession)(_fit)
        fits = {name: pool.submit(fit_in_thread, name, df, columns, key, config, n_rows)
                for name in config.detectors}
    for name, fit in fits.items():
        try:
            raw[name] = fit.result()
        except Exception as error:  # noqa: BLE001 - any failure is reported, the others still run
            status[name] = f"failed: {error}"
    scored = _store(df, key, raw, status)
    if scored is None:
        return Detection(None, status)
    names = [c for c in config.detectors if c in scored.columns]
    rows, cuts = labelled(scored, key, names, config)
    status.update(dict.fromkeys(names, "ok"))
    return Detection(rows, status, cuts)


def labelled(scored: DataFrame, key: Sequence[str], names: Sequence[str],
             config: Config) -> tuple[DataFrame, dict[str, float]]:
    """From stored raw scores, a column per detector, to the result rows; and each detector's threshold."""
    ends = scored.agg(*[f(n).alias(f"{f.__name__}_{n}") for n in names for f in (F.min, F.max)]).first()
    percentile = {"isolation_forest": 1 - config.forest.contamination,
                  "autoencoder": config.autoencoder.threshold_percentile / 100}
    # All thresholds come from the same passes; each detector takes its own.
    asked = sorted({percentile[n] for n in names})
    found = quantile_values(scored, asked, names, config.quantile_method)
    cuts = {n: found[n][asked.index(percentile[n])] for n in names}
    labels, scores = {}, {}
    for name in names:
        low, high = ends[f"min_{name}"], ends[f"max_{name}"]
        labels[name] = (F.col(name) > cuts[name]).cast("int")
        scores[name] = (F.col(name) - low) / (high - low + SPAN_GUARD)
    label, score = combine(list(labels.values()), list(scores.values()))
    parts = [c for n in names for c in (labels[n].alias(f"{n}_label"), scores[n].alias(f"{n}_score"))]
    return scored.select(*[col(k) for k in key], *parts, label.alias("anomaly_label"), score.alias("anomaly_score")), cuts


def _store(df: DataFrame, key: Sequence[str], raw: dict[str, Column], status: dict[str, str]) -> DataFrame | None:
    """The score table; if scoring fails, the detectors are tried one by one to find the culprit."""
    keys = [col(k) for k in key]

    def stored(names: list[str]) -> DataFrame:
        return materialize(df.select(*keys, *[raw[n].alias(n) for n in names]))

    if not raw:
        return None
    try:
        return stored(list(raw))
    except Exception as error:  # noqa: BLE001
        if len(raw) == 1:
            status[next(iter(raw))] = f"failed: {error}"
            return None
    good = []
    for name in raw:
        try:
            df.select(raw[name].alias(name)).agg(F.sum(name)).first()
            good.append(name)
        except Exception as error:  # noqa: BLE001
            status[name] = f"failed: {error}"
    return stored(good) if good else None
