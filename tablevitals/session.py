"""Session helpers: a local session for tests and the shared scratch folder."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", memory: str = "16g", shuffle_partitions: int = 8) -> SparkSession:
    """A local[*] session for tests and benchmarks; on a cluster bring your own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tablevitals")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, named by ``spark.checkpoint.dir``.

    Only a local master may run without the setting; it gets a temporary folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    context = spark.sparkContext
    if context.getCheckpointDir():
        return context.getCheckpointDir()
    if context.master != "local" and not context.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="tablevitals-")
    context.setCheckpointDir(folder)
    return folder


#: Local property that names the folder of the running audit.
SCRATCH = "tablevitals.scratch"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, or below the folder that ``scratch`` has opened."""
    folder = spark.sparkContext.getLocalProperty(SCRATCH) or shared_folder(spark)
    return f"{folder}/tablevitals-{uuid.uuid4().hex}/{name}"


def _located(spark: SparkSession, path: str):
    """The store of a path, and the path in it."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), hadoop_path


def local_folder(spark: SparkSession, path: str) -> str | None:
    """The folder, made if need be, as ``open`` knows it; None in a store that isn't a file system."""
    store, hadoop_path = _located(spark, path)
    if store.getScheme() != "file":
        return None
    store.mkdirs(hadoop_path)
    return hadoop_path.toUri().getPath()


def existing_folder(spark: SparkSession, path: str) -> str | None:
    """A folder that is there, as ``open`` knows it; None for patterns, files and what lies in a store that isn't a file system."""
    if re.search(r"[{}\[\]*?\\]", path):
        return None
    store, hadoop_path = _located(spark, path)
    if store.getScheme() != "file" or not store.isDirectory(hadoop_path):
        return None
    return store.makeQualified(hadoop_path).toUri().getPath()


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, in whatever store."""
    store, hadoop_path = _located(spark, path)
    return store.exists(hadoop_path)


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder in whatever store it lies."""
    store, hadoop_path = _located(spark, path)
    store.delete(hadoop_path, True)


#: Most tasks among which Spark deals the folders that it lists.
LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


@contextmanager
def few_listing_tasks(spark: SparkSession) -> Iterator[None]:
    """Folders that are opened in here are listed by eight tasks a core; else each of up to 10,000 has one of its own."""
    before = spark.conf.get(LISTING)
    spark.conf.set(LISTING, str(min(int(before), 8 * spark.sparkContext.defaultParallelism)))
    try:
        yield
    finally:
        spark.conf.set(LISTING, before)


def gathered(df: DataFrame) -> DataFrame:
    """Lets a task read up to 32 partitions of a scan, one after the other, as long as each core has eight tasks.

    Spark counts a file as 4 MB at least, so small files get many more tasks than their bytes ask for.
    """
    parts, least = df.rdd.getNumPartitions(), 8 * df.sparkSession.sparkContext.defaultParallelism
    return df.coalesce(max(least, -(-parts // 32))) if parts > least else df


@contextmanager
def scratch(spark: SparkSession, keep: bool = False) -> Iterator[str]:
    """Everything written to ``scratch_path`` in here lies in one folder, which goes at the end.

    With ``keep`` it goes on failure only. Threads started through ``inheritable_thread_target`` share it.
    """
    context = spark.sparkContext
    outer, folder = context.getLocalProperty(SCRATCH), scratch_path(spark, "scratch").rsplit("/", 1)[0]
    context.setLocalProperty(SCRATCH, folder)
    done = False
    try:
        yield folder
        done = True
    finally:
        context.setLocalProperty(SCRATCH, outer)
        if not (keep and done):
            delete(spark, folder)


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage: write the table to the shared folder and read it back.

    A lost executor then costs no recomputation, and later passes read only the columns they use.
    What Parquet cannot hold (intervals, untyped NULLs) goes through a reliable checkpoint.
    """
    path = scratch_path(df.sparkSession, "table")
    try:
        df.write.parquet(path)
    except AnalysisException:
        if not df.sparkSession.sparkContext.getCheckpointDir():
            df.sparkSession.sparkContext.setCheckpointDir(shared_folder(df.sparkSession))
        return df.checkpoint(eager=True)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Give a table that has fewer partitions than there are cores one for each.

    Such a table, of whatever size, leaves cores idle in every pass over it: a small file is one split, and so is a
    large compressed text. It is copied once; any other table is returned as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return materialize(df.repartition(cores))
