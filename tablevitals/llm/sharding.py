"""Contiguous shards of nearly equal bytes from global prefix sums.

Rows are dealt out by ranges of the id. Each range adds up its own sizes; the totals of the ranges, one row
each, give every range its offset, and so every row its place in the whole corpus without any global sort.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablevitals.llm.common import ref, whole_text
from tablevitals.session import materialize

ROW_BYTES = 8


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the range's number, the bytes before each row and its row number, both within the range."""
    part, size_before, rows_before = TaskContext.get().partitionId(), 0, 0
    for batch in batches:
        sizes = batch.column("size").to_numpy()
        ends = size_before + np.cumsum(sizes)
        numbers = np.arange(rows_before, rows_before + len(sizes))
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(np.full(len(sizes), part, "int32")), pa.array(ends - sizes), pa.array(numbers)],
            names=[*batch.schema.names, "part", "local_start", "local_row"])
        if len(sizes):
            size_before, rows_before = int(ends[-1]), rows_before + len(sizes)


def shard_by_bytes(docs: DataFrame, n_shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    The corpus is laid out by id and cut at equal byte targets; a document belongs to the shard that holds its
    middle, so shards differ from the target by one document at most at each end. ``slot`` numbers the documents
    of a shard from 0. A missing text has size 8 and the crc of nothing; missing ids come first; rows of one id
    follow each other by crc and size, and rows alike in all three are interchangeable. Fewer documents than
    shards leave shards empty. Other columns are ignored whatever their names.
    """
    text = ref(text_col)
    sized = materialize(docs.select(
        ref(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(whole_text(text).cast("binary")).alias("text_crc32")))
    order = ["doc_id", "text_crc32", "size"]
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # The last key splits a run of rows alike in all others; which of them comes first makes no difference.
    ranged = (sized.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(parts, *order, "tie")
              .sortWithinPartitions(*order).drop("tie"))
    schema = "doc_id {}, size long, text_crc32 long, part int, local_start long, local_row long"
    placed = materialize(ranged.mapInArrow(_running, schema.format(sized.schema["doc_id"].dataType.simpleString())))

    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (placed.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
               .select("part", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("start"),
                       F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("row"),
                       F.sum("bytes").over(Window.partitionBy()).alias("total")))
    # One row per range of the exchange above: bounded by spark.sql.shuffle.partitions.
    whole = placed.join(F.broadcast(offsets), "part").withColumn(
        "shard", F.least(F.lit(n_shards - 1), F.expr(
            f"((2 * (start + local_start) + size) * {n_shards}) div (2 * total)")).cast("int")).withColumn(
        "row", F.col("row") + F.col("local_row"))
    first = whole.groupBy("shard").agg(F.min("row").alias("first_row"))
    return whole.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("row") - F.col("first_row")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
