"""Sinks: each writes a folder of part files, so any size is written by all executors."""

from __future__ import annotations

import os
import re
import uuid
import zlib
from collections.abc import Iterator, Sequence
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablevitals.functions.columns import col
from tablevitals.session import local_folder, materialize

#: What Spark writes as %XX in the name of a partition's folder, and the name of a missing value's.
ESCAPED = re.compile(r"""[\x01-\x1f"#%'*/:=?\\\x7f{\[\]^]""")
NO_VALUE = "__HIVE_DEFAULT_PARTITION__"


def save_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Header row, NULL as an empty cell, an empty string as ``""``."""
    df.write.mode(mode).option("header", "true").option("escape", '"').csv(path)


def save_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One JSON record per line; NULL fields are kept."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def load_json(spark: SparkSession, path: str, schema=None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.json(path)


def save_flags(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Per-row anomaly labels and scores as Parquet."""
    rows.write.mode(mode).parquet(path)


def save_text_files(rows: DataFrame, path: str, text: str, name: str, folders: Sequence[str] = ()) -> None:
    """A text file for each value of ``name`` and ``folders``; its rows are its lines.

    Only rows that share a file are brought together, the others stay in their tasks; to tell them, ``rows`` is computed
    twice, or three times where files have several rows, and must be the same each time.
    On a file system, which all executors share, tasks write files straight to their places, each under a name of its
    own first, so a task done again replaces them: part=7/folder=value/name=value.txt, 256 parts by hash. Spark's writer,
    which needs folders of their own for each file and moves them up to three times, serves all other stores:
    name=value/folder=value/.
    """
    keys = [name, *folders]
    values = [F.nullif(col(c).cast("string"), F.lit("")).alias(c) for c in keys]
    lines = rows.select(col(text), *values)
    root = local_folder(rows.sparkSession, path)
    if root is None:
        dealt = lines.repartition(*map(col, keys))
        dealt.write.mode("append").partitionBy(*keys).option("lineSep", "\n").text(path)
        return

    def place(key: tuple) -> tuple[str, str]:
        shown = [ESCAPED.sub(lambda m: f"%{ord(m[0]):02X}", v) if v else NO_VALUE for v in key]
        file, *within = [f"{c}={v}" for c, v in zip(keys, shown)]
        return "/".join([root, f"part={zlib.crc32(file.encode()) % 256}", *within]), f"{file}.txt"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        written = 0
        found = (line for batch in batches for line in zip(*(c.to_pylist() for c in batch.columns)))
        for key, own in groupby(found, lambda line: line[1:]):
            folder, file = place(key)
            os.makedirs(folder, exist_ok=True)
            hidden = f"{folder}/.{uuid.uuid4()}"
            with open(hidden, "w", encoding="utf-8", newline="") as out:
                out.writelines(f"{line[0] or ''}\n" for line in own)
            os.replace(hidden, f"{folder}/{file}")
            written += 1
        yield pa.RecordBatch.from_pydict({"files": pa.array([written], pa.int64())})

    counted = lines.groupBy(*map(col, keys)).agg(F.count(F.lit(1)).alias("_lines")).filter("_lines > 1")
    shared = materialize(counted.select(*[col(c).alias(f"_shared_{c}") for c in keys]))
    parts = [lines]
    if not shared.isEmpty():
        same = [col(c).eqNullSafe(col(f"_shared_{c}")) for c in keys]
        alone, together = lines.join(shared, same, "left_anti"), lines.join(shared, same, "left_semi")
        parts = [alone, together.repartition(*map(col, keys)).sortWithinPartitions(*map(col, keys))]
    for part in parts:
        part.mapInArrow(write, "files long").agg(F.sum("files")).collect()
