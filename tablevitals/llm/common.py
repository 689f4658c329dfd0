"""Column helpers shared by the corpus operators."""

from __future__ import annotations

import string
import sys
from collections.abc import Callable, Hashable, Iterator
from contextlib import contextmanager
from typing import TypeVar

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ref(name: str) -> Column:
    """The column of exactly this name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def whole_text(text: Column) -> Column:
    """The text, a missing one as empty."""
    return F.coalesce(text, F.lit(""))


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, every other character untouched.

    ``lower`` also changes other alphabets, so only pure ASCII texts take that faster path.
    """
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def fold(doc_id: Column, folds: int) -> Column:
    """The fold of a document: crc32 of its id as text, by remainder; a missing id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


#: Bytes of text that a Python worker takes on at a time; a longer text stays whole.
TEXT_BYTES = 2 << 20
#: Size of the record batches that Spark hands to Python workers in ``small_batches``.
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"

#: A key of more than one in so many rows is hot.
SHARES = 1000

T = TypeVar("T")


def per_process(key: Hashable, make: Callable[[], T]) -> T:
    """What ``make`` gives, once per Python process.

    The package's code travels with each task, so its own globals don't outlive one; a module of Python does.
    """
    held = vars(sys).setdefault("_tablevitals_held", {})
    if key not in held:
        held[key] = make()
    return held[key]


def slices(texts: pa.Array, most_bytes: int = TEXT_BYTES) -> Iterator[slice]:
    """Cuts an array of texts into runs of at most ``most_bytes``, so that memory is bounded whatever their lengths."""
    sizes = np.array([len(t.as_buffer()) if t.is_valid else 0 for t in texts], np.int64)
    ends, at = np.cumsum(sizes), 0
    while at < len(sizes):
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most_bytes, "right")))
        yield slice(at, upto)
        at = upto
    pa.default_memory_pool().release_unused()  # a worker that waits for its next batch hands back what it doesn't use


@contextmanager
def small_batches(spark: SparkSession, size: str = "8m") -> Iterator[None]:
    """Queries that run in here hand their rows to Python workers in small batches."""
    before = spark.conf.get(BATCH_BYTES)
    spark.conf.set(BATCH_BYTES, size)
    try:
        yield
    finally:
        spark.conf.set(BATCH_BYTES, before)


def hot_join(rows: DataFrame, facts: DataFrame, keys: list[str], spread: list[str], counts: DataFrame | None = None,
             shares: int = SHARES) -> DataFrame:
    """Inner join of ``rows`` (any number per key) with ``facts`` (one row per key); keys aren't missing.

    Keys of more than one in ``shares`` rows, less than ``shares`` of them, are split: their rows are dealt by
    ``spread`` over as many tasks as they have such portions, and their fact is copied to each. Nothing but the list of
    these keys goes to the driver, and back as constants by the keys' hashes, so no row is joined to be looked up; a key
    that shares a hot one's hash is split like it, which changes nothing but its tasks. ``counts`` (keys, n) is how many
    rows each key that has a fact has, where that is known already.
    """
    if counts is None:
        total, counts = rows.agg(F.count("*")).scalar(), rows.groupBy(*keys).agg(F.count("*").alias("n"))
    else:
        total = counts.agg(F.sum("n")).scalar()
    salted = counts.where(F.col("n") * shares > total).select(
        F.xxhash64(*keys).alias("place"), F.ceil(F.col("n") * shares / total).alias("salts"))
    hot = dict(sorted(tuple(r) for r in salted.collect()))
    if not hot:
        return rows.join(facts, keys)
    place = F.xxhash64(*keys)
    known = F.expr(f"map({', '.join(f'{k}L, {n}L' for k, n in hot.items())})")
    salts = F.when(place.isin(list(hot)), F.element_at(known, place)).otherwise(F.lit(1).cast("long"))

    left = rows.withColumn("salt", F.pmod(F.xxhash64(*spread), salts))
    right = facts.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1)))
    return left.join(right, [*keys, "salt"]).drop("salt")
