"""Exact dedup with a heavy-hitter split.

Misra-Gries summaries find the digests that fill a large share of the table. Their winners, counted exactly,
are broadcast: rows of a winner learn their group on the map side and never meet in one task. All other
digests go through an ordinary shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablevitals.llm.common import ascii_lower, ref, whole_text
from tablevitals.session import materialize


def misra_gries(batches: Iterator[pa.RecordBatch], counters: int) -> Iterator[pa.RecordBatch]:
    """Lower bounds of the commonest digests of one partition, each short by n / (counters + 1) at most.

    A batch is counted exactly and merged in; when more than ``counters`` digests remain, the next largest
    count is taken from all of them, which keeps the bound of the one-by-one algorithm.
    """
    held: dict[bytes, int] = {}
    for batch in batches:
        for entry in pc.value_counts(batch.column(0)).to_pylist():
            held[entry["values"]] = held.get(entry["values"], 0) + entry["counts"]
        if len(held) > counters:
            cut = sorted(held.values(), reverse=True)[counters]
            held = {digest: n - cut for digest, n in held.items() if n > cut}
    if held:
        yield pa.RecordBatch.from_pydict({"digest": pa.array(held.keys(), pa.binary()),
                                          "at_least": pa.array(held.values(), pa.int64())})


def heavy_groups(digests: DataFrame, counters: int) -> DataFrame:
    """Digests of at least 2 / (counters + 1) of all rows, with their exact group; never over ``counters`` rows.

    Such a digest loses less than half its count in the summaries, so a lower bound of 1 / (counters + 1) of the
    rows finds it. The bounds add up to the row count at most, so ``counters`` digests at most reach that.
    """
    share = digests.count() / (counters + 1)
    bounds = (digests.select("digest").mapInArrow(lambda b: misra_gries(b, counters), "digest binary, at_least long")
              .groupBy("digest").agg(F.sum("at_least").alias("at_least")))
    candidates = materialize(bounds.where(F.col("at_least") >= share).select("digest"))
    groups = (digests.join(F.broadcast(candidates), "digest").groupBy("digest")
              .agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")))
    return materialize(groups.where(F.col("group_size") >= 2 * share))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = 1024) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; a missing text counts as empty. The largest id of a
    group stays. A missing id is smaller than any other; a group without any id keeps all its rows, and so do
    repeated rows of the id that stays. Other columns are ignored whatever their names; an empty table gives none.
    """
    digests = materialize(docs.select(
        ref(id_col).alias("doc_id"),
        F.unhex(F.sha2(ascii_lower(whole_text(ref(text_col))), 256)).alias("digest")))
    heavy = heavy_groups(digests, counters)
    of_heavy = digests.join(F.broadcast(heavy), "digest")
    light = digests.join(F.broadcast(heavy.select("digest")), "digest", "left_anti")
    groups = light.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    return of_heavy.unionByName(light.join(groups, "digest")).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"))
