"""Settings: thresholds in percent, score weights, detector parameters."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace


@dataclass(frozen=True)
class Cascade:
    """Strict upper limits of the statuses excellent, good and fair; anything else is poor."""

    excellent: float
    good: float
    fair: float


@dataclass(frozen=True)
class Thresholds:
    """Percent for missing cells, duplicates and outliers, a ratio for class imbalance (fixed values)."""

    missing_values: Cascade = Cascade(2.0, 5.0, 15.0)
    duplicates: Cascade = Cascade(1.0, 3.0, 10.0)
    class_imbalance: Cascade = Cascade(1.5, 3.0, 5.0)
    outliers: Cascade = Cascade(2.0, 5.0, 10.0)


#: The stricter and laxer limits that a configuration file would usually carry (fixed values).
FILE_THRESHOLDS = Thresholds(
    missing_values=Cascade(1.0, 5.0, 10.0),
    duplicates=Cascade(0.5, 1.0, 5.0),
    class_imbalance=Cascade(2.0, 5.0, 10.0),
)


@dataclass(frozen=True)
class Weights:
    completeness: float = 0.25
    consistency: float = 0.25
    balance: float = 0.25
    integrity: float = 0.25

    def normalized(self) -> dict[str, float]:
        """Weights in component order, scaled to sum 1."""
        values = {"completeness": self.completeness, "consistency": self.consistency,
                  "balance": self.balance, "integrity": self.integrity}
        total = sum(values.values())
        return {name: value / total for name, value in values.items()}


@dataclass(frozen=True)
class ForestParams:
    n_estimators: int = 100
    max_samples: int = 256
    contamination: float = 0.1
    random_state: int = 42


@dataclass(frozen=True)
class AutoencoderParams:
    """``kind="pca"`` is the linear autoencoder in closed form, ``"mlp"`` the trained network."""

    kind: str = "pca"
    encoding_dim: int = 16
    hidden_layers: tuple[int, ...] = (64, 32)
    learning_rate: float = 0.001
    epochs: int = 50
    batch_size: int = 32
    validation_split: float = 0.2
    early_stopping_patience: int = 5
    threshold_percentile: float = 95.0
    random_state: int = 42


@dataclass(frozen=True)
class Config:
    thresholds: Thresholds = field(default_factory=Thresholds)
    weights: Weights = field(default_factory=Weights)
    forest: ForestParams = field(default_factory=ForestParams)
    autoencoder: AutoencoderParams = field(default_factory=AutoencoderParams)
    detectors: tuple[str, ...] = ("isolation_forest", "autoencoder")
    quantile_method: str = "exact"
    #: Columns left out of the outlier check and the detectors, such as keys or the label.
    exclude: tuple[str, ...] = ()

    @staticmethod
    def from_dict(data: dict) -> "Config":
        """Read the nested sections quality_thresholds, scoring and ml_models; the rest is ignored.

        Missing keys keep their defaults. Thresholds are percent; fractions are not converted.
        """
        config = Config()
        limits = config.thresholds
        for name, values in data.get("quality_thresholds", {}).items():
            if hasattr(limits, name) and isinstance(values, dict) and "excellent" in values:
                known = {k: float(v) for k, v in values.items() if k in ("excellent", "good", "fair")}
                limits = replace(limits, **{name: replace(getattr(limits, name), **known)})
        shares = {k.removesuffix("_weight"): float(v) for k, v in data.get("scoring", {}).items()
                  if k.endswith("_weight")}
        models = data.get("ml_models", {})
        return replace(
            config, thresholds=limits, weights=replace(config.weights, **shares),
            forest=_known(config.forest, models.get("isolation_forest", {})),
            autoencoder=_known(config.autoencoder, models.get("autoencoder", {})),
        )

    @staticmethod
    def load(path: str) -> "Config":
        """Read a JSON file, or a YAML file where PyYAML is installed."""
        with open(path, encoding="utf-8") as handle:
            if path.endswith((".yaml", ".yml")):
                import yaml

                return Config.from_dict(yaml.safe_load(handle) or {})
            return Config.from_dict(json.load(handle))


def _known(params, values: dict):
    known = {k: tuple(v) if isinstance(v, list) else v for k, v in values.items() if hasattr(params, k)}
    return replace(params, **known)
