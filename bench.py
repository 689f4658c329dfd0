"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Two untimed queries first warm up the JVM and the Python workers.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tablevitals.catalog import QUERIES  # noqa: E402
from tablevitals.session import local_session  # noqa: E402

HEADLINE = [
    "missing_total", "missing_by_column", "logical_size", "duplicate_summary", "duplicate_rows_top100",
    "duplicate_texts", "numeric_moments", "numeric_quantiles", "correlation_matrix", "correlation_wide",
    "high_correlations", "class_balance", "iqr_outliers", "numeric_as_string", "histogram_numeric",
    "missing_pattern", "categorical_columns", "standard_scale", "validate_table", "scan_text_lines",
    "score_components", "health_score", "percentile_labels", "anomaly_combine",
    "iforest_score", "pca_recon_score", "anomaly_ensemble", "audit_report",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    chosen = sys.argv[1:] or HEADLINE
    for name in ("basic_info", "iforest_raw_score"):
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in chosen:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
