"""Command line: ``spark-submit``-able, or ``python -m tablevitals audit --file data.csv``."""

from __future__ import annotations

import argparse
import logging

from pyspark.sql import SparkSession

from tablevitals.config import Config
from tablevitals.plans.audit import audit_dataset
from tablevitals.plans.scoring import weighted_components
from tablevitals.sources.sample_data import create_sample_data
from tablevitals.sources.writers import save_csv


# The names, short forms and defaults of the options are the fixed command line interface.

def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="tablevitals", description="Audit the quality of a dataset")
    commands = parser.add_subparsers(dest="command", required=True)
    audit = commands.add_parser("audit", help="audit a file or folder")
    audit.add_argument("--file", "-f", required=True)
    audit.add_argument("--output", "-o", help="folder for the report and the per-row flags")
    audit.add_argument("--config", "-c", help="JSON or YAML settings")
    audit.add_argument("--key", default="", help="comma-separated columns that identify a row")
    audit.add_argument("--kind", choices=["tabular", "image", "text"])
    audit.add_argument("--format", choices=["csv", "json", "jsonl", "parquet"])
    audit.add_argument("--multiline", action="store_true", help="CSV cells may hold line breaks")
    audit.add_argument("--verbose", "-v", action="store_true")
    sample = commands.add_parser("generate-sample", help="write a synthetic table as CSV")
    sample.add_argument("--output", "-o", default="sample_dataset.csv")
    sample.add_argument("--samples", "-n", type=int, default=1000)
    sample.add_argument("--features", "-f", type=int, default=10)
    sample.add_argument("--anomaly-ratio", "-a", type=float, default=0.1)
    return parser


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = _parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("tablevitals").getOrCreate()
    if args.command == "generate-sample":
        save_csv(create_sample_data(spark, args.samples, args.features, args.anomaly_ratio), args.output)
        print(f"Sample dataset: {args.output} ({args.samples} rows, {args.features} features)")
        return 0
    logging.basicConfig(level=logging.INFO if args.verbose else logging.WARNING)
    config = Config.load(args.config) if args.config else Config()
    key = [k for k in args.key.split(",") if k]
    result = audit_dataset(spark, args.file, args.output, key, config, args.kind, args.format, args.multiline)
    if result.scores is None:
        print(result.metadata.first().asDict())
        return 0
    report = result.report
    row = report.select("scores", "recommendations", "key_findings").first()
    scores = row["scores"]
    print(f"Health score: {scores['overall_score']}/100 ({scores['rating']})")
    for part in weighted_components(report.select("scores.*"), [], config.weights).collect():
        print(f"  {part['component']}: {part['weighted']} ({part['score']:.0f}%)")
    print(scores["calculation"])
    print(scores["recommendation"])
    print("\n".join(["Findings:", *row["key_findings"], "Recommendations:", *row["recommendations"]]))
    for name, path in result.paths.items():
        print(f"{name}: {path}")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
