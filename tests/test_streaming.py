"""Windowed quality of streams: against the same table as a batch, late events, bounded state, runs that die."""

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from tablevitals.streaming import quality as streaming
from tablevitals.streaming.quality import run_to_end, window_quality

SCHEMA = "ts timestamp, v double"


def write(spark, folder, rows):
    spark.createDataFrame(rows, "ts string, v double").select(F.to_timestamp("ts").alias("ts"), "v").coalesce(1).write.mode(
        "append").parquet(folder)


def quality(events):
    return window_quality(events, "ts", ["v"], {"v": F.col("v") >= 0})


def stream(spark, folder, files=1000):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files).parquet(folder)


def closed(spark, folder, until):
    """What the table gives for the days before ``until``."""
    return sorted(quality(spark.read.schema(SCHEMA).parquet(folder)).where(F.col("window_start") < until).collect())


def test_windows_come_once_they_are_closed(spark, tmp_path):
    folder = f"{tmp_path}/in"

    def run():
        return run_to_end(quality(stream(spark, folder)), f"{tmp_path}/checkpoint", f"{tmp_path}/out")

    write(spark, folder, [("2024-01-01 01:00:00", 1.0), ("2024-01-01 23:00:00", None), ("2024-01-02 05:00:00", -4.0)])
    assert run().windows.collect() == []
    write(spark, folder, [("2024-01-02 06:00:00", float("nan")), ("2024-01-03 00:00:00", 2.0)])
    first = run()
    assert sorted(first.windows.collect()) == closed(spark, folder, "2024-01-02")
    assert [(r.n_rows, r.missing, r.invalid, r.missing_pct) for r in first.windows.collect()] == [(2, 1, 0, 50.0)]
    write(spark, folder, [("2024-01-09 06:00:00", 2.0)])
    assert sorted(run().windows.collect()) == closed(spark, folder, "2024-01-09")
    assert run().windows.count() == 3  # nothing new, nothing twice


def test_late_events_are_left_out(spark, tmp_path):
    folder = f"{tmp_path}/in"
    for k, day in enumerate(("2024-01-01", "2024-01-02", "2024-01-05")):
        write(spark, folder, [(f"{day} 12:00:00", float(k))])
        run = run_to_end(quality(stream(spark, folder)), f"{tmp_path}/checkpoint", f"{tmp_path}/out")
        assert run.late_rows == 0
    write(spark, folder, [("2024-01-01 13:00:00", 9.0), ("2024-01-04 13:00:00", 9.0), ("2024-01-08 00:00:00", 9.0)])
    run = run_to_end(quality(stream(spark, folder)), f"{tmp_path}/checkpoint", f"{tmp_path}/out")
    assert run.late_rows == 1
    assert [(str(r.window_start)[:10], r.n_rows) for r in run.windows.orderBy("window_start").collect()] == [
        ("2024-01-01", 1), ("2024-01-02", 1), ("2024-01-04", 1), ("2024-01-05", 1)]


def test_state_holds_open_windows_only(spark, tmp_path):
    folder = f"{tmp_path}/in"
    spark.range(24 * 40).select(F.expr("timestamp'2024-01-01' + make_interval(0, 0, 0, 0, id)").alias("ts"), F.col("id").cast(
        "double").alias("v")).coalesce(1).write.option("maxRecordsPerFile", 48).parquet(folder)
    run = run_to_end(quality(stream(spark, folder, 1)), f"{tmp_path}/checkpoint", f"{tmp_path}/out")
    assert run.most_open <= 8 and run.windows.count() == 38
    assert sorted(run.windows.collect()) == closed(spark, folder, "2024-02-08")


@pytest.mark.parametrize("after_writing", [False, True])
def test_a_run_that_dies_gives_each_window_once(spark, tmp_path, monkeypatch, after_writing):
    folder, calls = f"{tmp_path}/in", []
    for day in range(1, 8):
        write(spark, folder, [(f"2024-01-0{day} 12:00:00", float(day)), (f"2024-01-0{day} 18:00:00", None)])
    whole = streaming.store_batch

    def dying(batch, number, output):
        calls.append(number)
        if after_writing:
            whole(batch, number, output)
        if len(calls) == 4:
            raise RuntimeError("the driver is gone")
        if not after_writing:
            whole(batch, number, output)

    monkeypatch.setattr(streaming, "store_batch", dying)
    with pytest.raises(StreamingQueryException):
        run_to_end(quality(stream(spark, folder, 1)), f"{tmp_path}/checkpoint", f"{tmp_path}/out")
    run = run_to_end(quality(stream(spark, folder, 1)), f"{tmp_path}/checkpoint", f"{tmp_path}/out")
    assert calls[4] == calls[3]  # the same batch again
    assert sorted(run.windows.collect()) == closed(spark, folder, "2024-01-06")


def test_open_windows_are_given_as_they_are(spark, tmp_path):
    folder = f"{tmp_path}/in"

    def run():
        return run_to_end(quality(stream(spark, folder, 1)), f"{tmp_path}/checkpoint", f"{tmp_path}/out", open_windows=True)

    write(spark, folder, [("2024-01-01 01:00:00", 1.0), ("2024-01-02 05:00:00", -4.0)])
    assert sorted(run().windows.collect()) == closed(spark, folder, "2025-01-01")
    write(spark, folder, [("2024-01-02 06:00:00", float("nan")), ("2024-01-05 00:00:00", 2.0)])
    write(spark, folder, [("2024-01-06 06:00:00", None)])
    second = run()
    assert sorted(second.windows.collect()) == closed(spark, folder, "2025-01-01")
    write(spark, folder, [("2024-01-02 07:00:00", 9.0), ("2024-01-06 07:00:00", 9.0)])
    third = run()
    assert third.late_rows == 1 and third.windows.count() == 4
    assert [r.n_rows for r in third.windows.orderBy("window_start").collect()] == [1, 2, 1, 2]


def test_query_covers_every_day(spark, sf):
    from tablevitals import catalog

    days = spark.read.parquet(f"{sf}/events.parquet").select(F.date_format("ts", "yyyy-MM-dd").alias("day"))
    found = catalog.QUERIES["stream_quality"](spark, sf)
    assert found.agg(F.max("day")).first() == days.agg(F.max("day")).first()
    assert found.where("column = 'value'").agg(F.sum("n_rows")).first()[0] == days.count()
