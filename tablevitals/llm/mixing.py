"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source wants the same share of its words: target / source size copies. The whole part is
given at once. The fractions are rounded in pairs: words pass at random from one document to the other, without
changing the sum, until one of the two has a whole number of copies. Blocks of a source do that side by side; the
one document each leaves over meets those of other blocks in a reduction tree, up to one per source.
"""

from __future__ import annotations

import random
from collections.abc import Callable
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablevitals.llm.common import WORD, ref, whole_text
from tablevitals.session import materialize

#: Weights of the sources in order, repeated.
WEIGHTS = (5, 2, 1)
#: No source gives more than this many times its own words.
MOST_REPEATS = 3


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """Adds source_no, target and share to one row per source (source, source_size, n_docs).

    A target is the smaller of ``most`` times the source's size and the weight times one common level, which
    is where handing on the excess by weight ends. Filling sources in order of their limit per weight, the level
    is the largest of (what is left) / (weight that is left).
    """
    everything = Window.partitionBy()
    numbered = sizes.withColumn("source_no", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weighed = (numbered.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)),
                                                          F.col("source_no") % len(weights) + 1))
               .withColumn("most", F.col("source_size") * most))
    filled = Window.orderBy(F.col("most") / F.col("weight"), "source_no")
    before = filled.rowsBetween(Window.unboundedPreceding, -1)
    left: Column = F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0))
    weight_left = F.sum("weight").over(filled.rowsBetween(0, Window.unboundedFollowing))
    level = weighed.withColumn("level", left / weight_left)
    target = F.least(F.col("most").cast("double"), F.max("level").over(everything) * F.col("weight"))
    return level.withColumn("target", target).withColumn(
        "share", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)).drop(
        "weight", "most", "level")


def settle(sizes: list[int], parts: list[float], draw: random.Random) -> tuple[list[float], int | None]:
    """Rounds the fractions pair by pair, keeping the sum of size x part; returns them and who is left over, if any."""
    parts, carried = list(parts), None
    for j, (size, part) in enumerate(zip(sizes, parts, strict=True)):
        if size == 0 or part <= 0 or part >= 1:
            parts[j] = 0.0 if size == 0 else part
            continue
        if carried is None:
            carried = j
            continue
        i = carried
        to_i, to_j = (1 - parts[i]) * sizes[i], (1 - part) * size  # room for words
        of_i, of_j = parts[i] * sizes[i], part * size  # words to give
        up, down = min(to_i, of_j), min(of_i, to_j)
        if draw.random() * (up + down) < down:  # the mean stays: i gains `up` with probability down / (up + down)
            i_done, j_done, moved = to_i <= of_j, of_j <= to_i, up
            ends = (1.0, 0.0)
        else:
            i_done, j_done, moved = of_i <= to_j, to_j <= of_i, -down
            ends = (0.0, 1.0)
        parts[i] = ends[0] if i_done else parts[i] + moved / sizes[i]
        parts[j] = ends[1] if j_done else part - moved / size
        carried = None if i_done and j_done else j if i_done else i
    return parts, carried


def round_last(sizes: list[int], wanted: list[float], parts: list[float], left: int | None) -> list[float]:
    """Rounds the last document of a source to the nearer side, then hands on what that adds or leaves out.

    From the largest down, a document changes sides where that brings the words taken nearer to those wanted.
    """
    if left is None:
        return parts
    parts = list(parts)
    missing = sizes[left] * (parts[left] - round(parts[left]))
    parts[left] = float(round(parts[left]))
    for k in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        gain = sizes[k] if parts[k] == 0 else -sizes[k]
        if k != left and 0 < wanted[k] < 1 and abs(missing - gain) < abs(missing):
            parts[k], missing = 1 - parts[k], missing - gain
    return parts


def _settle_blocks(level: int, seed: int) -> Callable[[pa.Table], pa.Table]:
    def settle_block(rows: pa.Table) -> pa.Table:
        """One block: the largest documents first, so that what is left over tends to be small."""
        order = pc.sort_indices(rows, [("size", "descending"), ("doc_id", "ascending"), ("text_hash", "ascending")], null_placement="at_start")
        rows = rows.take(order)
        draw = random.Random(f"{seed} {level} {rows['source_no'][0]} {rows['block'][0]}")
        sizes, wanted = rows["size"].to_pylist(), rows["part"].to_pylist()
        parts, left = settle(sizes, wanted, draw)
        if rows["blocks"][0].as_py() == 1:
            parts, left = round_last(sizes, wanted, parts, left), None
        is_open = pa.array([k == left for k in range(len(parts))])
        for name, values in (("part", pa.array(parts, pa.float64())), ("open", is_open)):
            rows = rows.set_column(rows.schema.get_field_index(name), name, values)
        return rows
    return settle_block


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                weights: tuple[int, ...] = WEIGHTS, block_rows: int = 1024, fan_in: int = 64,
                seed: int = 20) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies, taken, text_hash (xxhash64).

    Size is the number of words; a missing text has none and takes none. A missing source is a source of its
    own, the last in order. The words taken of a source miss its target by half a document at most, mostly by
    much less (see ``round_last``); where the target is ``MOST_REPEATS`` times the source, they meet it. The draw
    depends on ids, texts and ``seed`` alone, so reruns agree; rows alike in all columns are interchangeable. An
    empty table gives none; other columns are ignored whatever their names.
    """
    # Rows alike are counted first: they enter a block once, however many they are.
    sized = materialize(docs.select(
        ref(id_col).alias("doc_id"), ref(source_col).alias("source"),
        F.regexp_count(whole_text(ref(text_col)), F.lit(WORD)).cast("long").alias("size"),
        F.xxhash64(ref(text_col)).alias("text_hash"))
        .groupBy("doc_id", "source", "size", "text_hash").agg(F.count("*").alias("alike")))
    sizes = sized.groupBy("source").agg(F.sum(F.col("size") * F.col("alike")).alias("source_size"), F.count("*").alias("n_docs"))
    targets = materialize(source_targets(sizes, weights).withColumn("blocks", F.ceil(F.col("n_docs") / block_rows))
                          .withColumnRenamed("source", "of"))
    whole = F.floor(F.col("share") + 1e-12)
    # What rows alike want together beyond the whole part: some of them get one more, and a fraction is left to round.
    more = F.when(F.col("size") > 0, F.greatest(F.lit(0.0), F.col("share") - whole) * F.col("alike")).otherwise(0.0)
    rows = (sized.join(targets, F.col("source").eqNullSafe(F.col("of"))).select(
        "doc_id", "text_hash", "source_no", "size", "alike", whole.alias("whole"), F.floor(more + 1e-9).alias("extra"),
        F.greatest(F.lit(0.0), more - F.floor(more + 1e-9)).alias("part"),
        F.pmod(F.xxhash64("doc_id", "text_hash", F.lit(seed)), "blocks").alias("block"), "blocks",
        F.lit(True).alias("open")))
    blocks = targets.agg(F.max("blocks")).first()[0] or 1
    done, level, kind = [], 0, rows.schema
    while True:
        groups = materialize(rows.groupBy("source_no", "block").applyInArrow(
            _settle_blocks(level, seed), kind))
        done.append(groups.where("NOT open"))
        rows = groups.where("open").withColumns({"block": F.floor(F.col("block") / fan_in),
                                                 "blocks": F.ceil(F.col("blocks") / fan_in)})
        if blocks <= 1:
            break
        blocks, level = -(-blocks // fan_in), level + 1
    result = reduce(DataFrame.unionByName, done)
    each = result.withColumn("nth", F.explode(F.expr("sequence(1L, alike)")))
    return each.join(targets, "source_no").withColumn(
        "copies", F.col("whole") + (F.col("nth") <= F.col("extra") + F.col("part")).cast("long")).select(
        "doc_id", F.col("of").alias("source"), "size", "source_size", "target", "copies",
        (F.col("copies") * F.col("size")).alias("taken"), "text_hash")
