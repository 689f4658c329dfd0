"""Missing and invalid values of a stream, per window of event time."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablevitals.functions.columns import clean, col
from tablevitals.functions.scalars import percentage
from tablevitals.session import exists


def window_quality(events: DataFrame, time: str, columns: Sequence[str], valid: Mapping[str, Column] | None = None,
                   width: str = "1 day", delay: str = "1 day") -> DataFrame:
    """One row per window and column: window_start, column, n_rows, missing, invalid, missing_pct.

    Works on streams and tables alike. A row is ``invalid`` in a column where the condition in ``valid`` is false. On
    a stream, a window is given once, when an event has come that is ``delay`` or more past its end; events that come
    for it later are left out. The state holds a few counters per window that is still open.
    """
    rules = dict(valid or {})
    counts = [F.count(clean(events, c)).alias(f"present{i}") for i, c in enumerate(columns)]
    broken = [F.count_if(~rules[c]).alias(f"invalid{i}") if c in rules else F.lit(0).cast("long").alias(f"invalid{i}")
              for i, c in enumerate(columns)]
    timed = events.withColumn("_time", col(time).cast("timestamp")).withWatermark("_time", delay)
    counted = timed.groupBy(F.window("_time", width).alias("w")).agg(F.count(F.lit(1)).alias("n_rows"), *counts, *broken)
    rows = [F.struct(F.lit(c).alias("column"), (F.col("n_rows") - F.col(f"present{i}")).alias("missing"),
                     F.col(f"invalid{i}").alias("invalid")) for i, c in enumerate(columns)]
    parted = counted.select(F.col("w.start").alias("window_start"), "n_rows", F.explode(F.array(*rows)).alias("r"))
    return parted.select("window_start", F.col("r.column").alias("column"), "n_rows", F.col("r.missing").alias("missing"),
                         F.col("r.invalid").alias("invalid"), percentage(F.col("r.missing"), F.col("n_rows")).alias("missing_pct"))


@dataclass(frozen=True)
class StreamRun:
    """Windows so far, with what the run itself tells: rows that came too late and most windows open at once."""

    windows: DataFrame
    late_rows: int
    most_open: int


def store_batch(batch: DataFrame, number: int, output: str) -> None:
    """Writes a batch to a folder of its own; the same batch written again replaces it."""
    batch.write.mode("overwrite").parquet(f"{output}/batch={number}")


def _newest(written: DataFrame, names: list[str]) -> DataFrame:
    """Each window and column as its last batch gave it."""
    last = written.groupBy("window_start", "column").agg(F.max_by(F.struct(*names), "batch").alias("last"))
    return last.select("last.*")


def run_to_end(quality: DataFrame, checkpoint: str, output: str, open_windows: bool = False) -> StreamRun:
    """Runs a stream over what its source holds now; ``windows`` are those of this run and of all before it.

    They are the closed ones, appended as they close. With ``open_windows`` they are all: each batch writes the windows
    that it changed, and the newest row of a window counts. Keep to one of both for a checkpoint and its output.

    The checkpoint lets a restarted run go on where the last one ended. A batch that a run had begun when it died is
    done again with the same events and number, and replaces what it had written, so each window is there once.
    """
    mode = "update" if open_windows else "append"
    running = (quality.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", checkpoint)
               .foreachBatch(lambda batch, number: store_batch(batch, number, output)).start())
    running.awaitTermination()
    states = [s for p in running.recentProgress for s in p["stateOperators"]]
    spark = quality.sparkSession
    stored = T.StructType([*quality.schema.fields, T.StructField("batch", T.LongType())])
    windows = (_newest(spark.read.schema(stored).parquet(output), quality.columns) if exists(spark, output)
               else spark.createDataFrame([], quality.schema))
    return StreamRun(windows, sum(s["numRowsDroppedByWatermark"] for s in states), max((s["numRowsTotal"] for s in states), default=0))
