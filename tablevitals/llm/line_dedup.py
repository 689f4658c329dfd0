"""Line dedup over overlapping windows of three lines.

Three consecutive lines are hashed together. Windows that occur more than once anywhere in the corpus are found
by counting hashes; every occurrence but the first has its lines covered, overlapping covers merge, and covered
lines go. If asked to, long lines are broken at places that their words give, and windows are made of the parts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablevitals.llm.common import WORD, hot_join, ref, whole_text
from tablevitals.session import materialize

#: White space that leaves a line blank.
BLANK = " \t\n\r\x0b\x0c"
#: Rows handed to Spark at once, whatever the length of the texts.
OUT_ROWS = 50_000
#: A long line is broken before the word whose hash is the least of so many to either side.
REACH = 3
#: Words of a window that holds a part of a line, at least.
LEAST_WORDS = 15


def filled_lines(text: str) -> list[tuple[int, str]]:
    """The lines that aren't blank, each with its place among all lines."""
    return [(k, line) for k, line in enumerate(text.split("\n")) if line.strip(BLANK)]


def parts_of(line: str, break_over: int | None) -> list[tuple[int, int]]:
    """Where the parts of a line begin and end: the line as it is, or without ``break_over`` words at most its pieces.

    Only the words around it say whether a place is a break, so a passage is broken alike wherever it lies.
    """
    whole = [(0, len(line))]
    words = list(re.finditer(WORD, line)) if break_over is not None and len(line) > 2 * break_over else []
    if not words or len(words) <= max(break_over, 2 * REACH):
        return whole
    hashes = np.array([xxhash.xxh3_64_intdigest(f"{a.group()} {b.group()}") for a, b in zip(words, words[1:])], np.uint64)
    around = np.lib.stride_tricks.sliding_window_view(hashes, 2 * REACH + 1)
    least = (around[:, REACH, None] < np.delete(around, REACH, axis=1)).all(axis=1)
    begins = [0, *(words[k + REACH].start() for k in np.flatnonzero(least)), len(line)]
    return list(zip(begins, begins[1:]))


def units(text: str, break_over: int | None) -> list[tuple[int, int, int, bool]]:
    """What windows are made of: line, begin and end in it, and whether it is only a part of the line."""
    found = []
    for k, line in filled_lines(text):
        parts = parts_of(line, break_over)
        found += [(k, begin, end, len(parts) > 1) for begin, end in parts]
    return found


def window_bodies(text: str, width: int, break_over: int | None) -> Iterator[tuple[int, str]]:
    """Start, in units, and body of each window; those of parts that hold too few words say nothing."""
    lines, own = text.split("\n"), units(text, break_over)
    bodies = [lines[k][begin:end].strip(BLANK) if part else lines[k] for k, begin, end, part in own]
    for start in range(len(own) - width + 1):
        body = "\n".join(bodies[start:start + width])
        if not any(part for *_, part in own[start:start + width]) or len(re.findall(WORD, body)) >= LEAST_WORDS:
            yield start, body


def _windows(batches: Iterator[pa.RecordBatch], width: int, break_over: int | None) -> Iterator[pa.RecordBatch]:
    """(high, low, doc, tie, start) of each window; start counts units."""
    names = ["high", "low", "doc", "tie", "start"]

    def out(rows, schema):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema, strict=True)],
                                          names=names)

    rows: list[tuple] = []
    for batch in batches:
        kinds = [pa.int64(), pa.int64(), batch.schema.field("doc").type, pa.int64(), pa.int32()]
        for doc, tie, text in zip(batch.column("doc").to_pylist(), batch.column("tie").to_pylist(),
                                  batch.column("text"), strict=True):
            for start, body in window_bodies(text.as_py(), width, break_over):
                digest = xxhash.xxh3_128_digest(body.encode())
                rows.append((int.from_bytes(digest[:8], signed=True), int.from_bytes(digest[8:], signed=True),
                             doc, tie, start))
                if len(rows) >= OUT_ROWS:
                    yield out(rows, kinds)
                    rows = []
    if rows:
        yield out(rows, kinds)


def without_lines(text: str, covers: list[dict] | None, break_over: int | None = None) -> tuple[str, int, int]:
    """The text without its covered lines and parts of lines, how many lines it had and how many went whole."""
    n_lines = text.count("\n") + 1 if text else 0
    if not covers:
        return text, n_lines, 0
    lines, own = text.split("\n"), units(text, break_over)
    gone = {k for cover in covers for k in range(cover["since"], cover["until"])}
    left: dict[int, list[str]] = {}
    for k, (line, begin, end, _) in enumerate(own):
        left.setdefault(line, []).extend([] if k in gone else [lines[line][begin:end]])
    return ("\n".join("".join(left.get(k, [line])) for k, line in enumerate(lines) if left.get(k, True)), n_lines,
            sum(not rest for rest in left.values()))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3,
               break_over: int | None = None) -> DataFrame:
    """The documents, all columns, with ``text_col`` cleaned and n_lines and n_removed (long) appended.

    Lines are what line feeds part; blank lines take part in no window and stay. Windows are equal when their
    ``width`` lines are identical. The first occurrence in order of id (a missing id first) and place stays; every
    later one loses its lines, except those it shares with the first within one document. Texts of fewer filled
    lines stay as they are, a missing text stays missing with 0 lines, and a text may end up empty. Rows of one
    id and one text share their fate. Columns of the input named n_lines or n_removed are replaced.

    A repeated passage that isn't ``width`` whole lines stays. With ``break_over``, lines of more words are broken into
    parts of some words, windows are ``width`` parts or lines, and covered parts go out of their lines, too; n_removed
    counts lines that went whole. A few words at either end of a passage stay, and so does a line of one word over and over.
    """
    text = ref(text_col)
    keyed = docs.select(ref(id_col).alias("doc"), F.xxhash64(text).alias("tie"), text.alias("text")).where(
        F.octet_length("text") > 0)
    kind = keyed.schema["doc"].dataType.simpleString()
    windows = materialize(keyed.mapInArrow(lambda batches: _windows(batches, width, break_over),
                                           f"high long, low long, doc {kind}, tie long, start int"))
    place = F.struct("doc", "tie", "start")
    repeated = materialize(windows.groupBy("high", "low").agg(F.min(place).alias("first"), F.count("*").alias("n"))
                           .where("n > 1"))
    same = F.col("doc").eqNullSafe(F.col("first.doc")) & (F.col("tie") == F.col("first.tie"))
    later = (hot_join(windows, repeated.drop("n"), ["high", "low"], ["doc", "tie", "start"], repeated)
             .withColumn("since", F.when(same, F.greatest("start", F.col("first.start") + width))
                         .otherwise(F.col("start")))
             .withColumn("until", F.col("start") + width)
             .where("NOT (doc <=> first.doc AND tie = first.tie AND start = first.start)"))
    covers = later.groupBy("doc", "tie").agg(F.collect_set(F.struct("since", "until")).alias("covers"))

    names = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    packed = docs.select(F.struct(*map(ref, names)).alias("row"), ref(id_col).alias("id"), text.alias("text"),
                         F.xxhash64(text).alias("hash"))
    cleaned = packed.join(covers, F.col("id").eqNullSafe(F.col("doc")) & (F.col("hash") == F.col("tie")), "left")
    clean = _cleaner(break_over)
    return cleaned.withColumn("clean", clean(whole_text(F.col("text")), "covers")).select(
        *[F.when(F.col("text").isNotNull(), F.col("clean.text")).alias(c) if c == text_col
          else F.col("row").getField(c).alias(c) for c in names],
        F.col("clean.n_lines").alias("n_lines"), F.col("clean.n_removed").alias("n_removed"))


def _cleaner(break_over: int | None):
    @F.arrow_udf("text string, n_lines long, n_removed long")
    def clean(text: pa.Array, covers: pa.Array) -> pa.Array:
        rows = [without_lines(t.as_py(), c.as_py(), break_over) for t, c in zip(text, covers, strict=True)]
        return pa.StructArray.from_arrays(
            [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()),
             pa.array([r[2] for r in rows], pa.int64())], names=["text", "n_lines", "n_removed"])
    return clean
