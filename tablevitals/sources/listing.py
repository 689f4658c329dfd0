"""Files of a file system, listed and read by tasks. Spark's own readers hold every file of a folder on the driver, more than once."""

from __future__ import annotations

import errno
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablevitals.session import existing_folder, scratch_path

#: Paths are bytes, as names need not be UTF-8.
ENTRIES = "path binary, bytes long, folder boolean"
CONTENTS = "path string, content binary"

#: Entries that a task lists below a folder it was given, before it hands on the folders that are left.
WALK = 10_000

#: Entries, files and bytes that a task holds at once.
HELD_ENTRIES, HELD_FILES, HELD_BYTES = 10_000, 1000, 4 << 20

#: Files and bytes for a task to read.
TASK_FILES, TASK_BYTES = 8192, 32 << 20

#: What a path shows as %XX where it is written as an address.
QUOTED = re.compile("[\\x00-\\x20\"#%<>?\\[\\\\\\]^`{|}\\x7f-\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]")


def files_below(spark: SparkSession, path: str) -> DataFrame | None:
    """The files that Spark would find below a folder, empty and hidden ones left out: path (as ``open`` knows it), bytes.

    None where only Spark's readers know the way: other stores, patterns, single files, and what isn't there. A task that
    was given a folder lists what lies below it, too, up to ``WALK`` entries; folders left over are dealt out again.
    """
    root = existing_folder(spark, path)
    if root is None:
        return None
    level, written = spark.range(0, 1, 1, 1).select(F.lit(root).cast("binary").alias("path")), []
    while True:
        written.append(scratch_path(spark, "files"))
        level.mapInArrow(_listed, ENTRIES).write.parquet(written[-1])
        left = spark.read.schema(ENTRIES).parquet(written[-1]).filter("folder").select("path")
        if left.isEmpty():
            break
        level = left.repartition(8 * spark.sparkContext.defaultParallelism)
    return spark.read.schema(ENTRIES).parquet(*written).filter("NOT folder").select("path", "bytes")


def contents(files: DataFrame) -> DataFrame:
    """Reads each file of ``files_below`` as a whole: path (as an address), content."""
    total = files.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")).first()
    least = min(total["files"], 8 * files.sparkSession.sparkContext.defaultParallelism)
    tasks = max(1, least, -(-total["files"] // TASK_FILES), -(-total["bytes"] // TASK_BYTES))
    return files.select("path").repartition(tasks).mapInArrow(_read, CONTENTS)


def _listed(batches: Iterator[pa.RecordBatch], walk: int = WALK) -> Iterator[pa.RecordBatch]:
    found: list[tuple[str, int, bool]] = []
    for folder in (os.fsdecode(path) for batch in batches for path in batch.column(0).to_pylist()):
        pending, seen = [folder], 0
        while pending:
            inside = pending.pop()
            if seen >= walk:
                found.append((inside, 0, True))
                continue
            with os.scandir(inside) as entries:
                for entry in entries:
                    seen += 1
                    size = _size(entry)
                    if size is None and seen < walk:
                        pending.append(entry.path)
                    elif size is None or size > 0:
                        found.append((entry.path, size or 0, size is None))
                    if len(found) >= HELD_ENTRIES:
                        yield _entries(found)
                        found = []
    yield _entries(found)


def _size(entry: os.DirEntry) -> int | None:
    """The bytes of a file, none for what Spark passes by, and None for a folder."""
    hidden = entry.name.startswith(".") or entry.name.startswith("_") and "=" not in entry.name
    try:
        if entry.is_dir():
            known = entry.name.startswith(("_metadata", "_common_metadata"))
            return 0 if (hidden or entry.name.endswith("._COPYING_")) and not known else None
        return 0 if hidden or entry.name.endswith("._COPYING_") else entry.stat().st_size
    except OSError as e:
        if e.errno not in (errno.ENOENT, errno.ELOOP):  # gone meanwhile, or a link to nowhere
            raise
        return 0


def _entries(found: list[tuple[str, int, bool]]) -> pa.RecordBatch:
    path, size, folder = zip(*found) if found else ((), (), ())
    return pa.RecordBatch.from_arrays(
        [pa.array(map(os.fsencode, path), pa.binary()), pa.array(size, pa.int64()), pa.array(folder, pa.bool_())], ["path", "bytes", "folder"])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    paths: list[str] = []
    texts: list[bytes] = []
    held = 0
    for path in (path for batch in batches for path in batch.column(0).to_pylist()):
        with open(path, "rb") as file:
            text = file.read()
        if paths and held + len(text) > HELD_BYTES or len(paths) >= HELD_FILES:
            yield _contents(paths, texts)
            paths, texts, held = [], [], 0
        paths.append("file:" + QUOTED.sub(lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), path.decode(errors="replace")))
        texts.append(text)
        held += len(text)
    yield _contents(paths, texts)


def _contents(paths: list[str], texts: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(texts, pa.binary())], ["path", "content"])
