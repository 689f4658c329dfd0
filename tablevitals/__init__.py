"""Data-quality audits of tables of any size, as plain Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# Python workers get the package's small helpers with the task, so nothing needs installing there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"

from tablevitals.config import FILE_THRESHOLDS, Config, Thresholds, Weights  # noqa: E402
from tablevitals.operators.anomaly.detect import detect  # noqa: E402
from tablevitals.plans.audit import audit_dataset, audit_table, profile_table, score_table, table_metrics  # noqa: E402
from tablevitals.sources.readers import load  # noqa: E402
from tablevitals.sources.sample_data import create_sample_data  # noqa: E402

__all__ = ["FILE_THRESHOLDS", "Config", "Thresholds", "Weights", "audit_dataset", "audit_table",
           "create_sample_data", "detect", "load", "profile_table", "score_table", "table_metrics"]
