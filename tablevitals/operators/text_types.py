"""Numbers stored as strings, and finding the text column of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablevitals.functions.columns import chunks, col, string_columns, union_all
from tablevitals.functions.scalars import is_numeric_text, percentage

#: A text column's values are longer than this on average (fixed value).
TEXT_MIN_LENGTH = 50


def numeric_as_string(df: DataFrame) -> DataFrame:
    """One row per string column: column, numeric_as_string (every non-null value parses)."""
    parts = []
    for group in chunks(string_columns(df), 80):
        flags = df.agg(*[F.coalesce(F.bool_and(is_numeric_text(col(c))), F.lit(True)).alias(f"f{i}")
                         for i, c in enumerate(group)])
        rows = [F.struct(F.lit(c).alias("column"), F.col(f"f{i}").alias("numeric_as_string"))
                for i, c in enumerate(group)]
        parts.append(flags.select(F.inline(F.array(*rows))))
    if not parts:
        return df.sparkSession.createDataFrame([], "column string, numeric_as_string boolean")
    return union_all(parts)


def find_text_column(df: DataFrame) -> DataFrame:
    """One row: text_column (first string column longer than 50 characters on average) and
    label_column (first other column); both NULL if there is no text column."""
    texts = string_columns(df)
    if not texts:
        return df.sparkSession.createDataFrame([(None, None)], "text_column string, label_column string")
    lengths = df.agg(*[F.avg(F.length(col(c))).alias(f"l{i}") for i, c in enumerate(texts)])
    found = F.coalesce(*[F.when(F.col(f"l{i}") > TEXT_MIN_LENGTH, F.lit(c)) for i, c in enumerate(texts)])
    first, second = df.columns[0], df.columns[1] if len(df.columns) > 1 else None
    label = F.when(F.col("text_column") == first, F.lit(second)).when(
        F.col("text_column").isNotNull(), F.lit(first))
    return lengths.select(found.alias("text_column")).withColumn("label_column", label)


#: What Windows-1252 has in place of the control characters from U+0080 on, by code (fixed values).
WINDOWS_1252 = {
    0x80: "\u20ac", 0x82: "\u201a", 0x83: "\u0192", 0x84: "\u201e", 0x85: "\u2026", 0x86: "\u2020", 0x87: "\u2021",
    0x88: "\u02c6", 0x89: "\u2030", 0x8a: "\u0160", 0x8b: "\u2039", 0x8c: "\u0152", 0x8e: "\u017d", 0x91: "\u2018",
    0x92: "\u2019", 0x93: "\u201c", 0x94: "\u201d", 0x95: "\u2022", 0x96: "\u2013", 0x97: "\u2014", 0x98: "\u02dc",
    0x99: "\u2122", 0x9a: "\u0161", 0x9b: "\u203a", 0x9c: "\u0153", 0x9e: "\u017e", 0x9f: "\u0178",
}


def double_encoded(text: Column) -> Column:
    """Whether a text holds UTF-8 that was read as Latin-1 or Windows-1252, such as two characters in place of an accented one.

    Its runs of characters that a single byte stands for in these are turned back into bytes; where the bytes of a
    whole run are UTF-8, its characters were bytes before. Text proper hardly ever has such runs, as an accented letter
    would have to be followed by a mark like ``»``.
    """
    bytes_again = F.translate(text, "".join(WINDOWS_1252.values()), "".join(map(chr, WINDOWS_1252)))
    runs = F.regexp_extract_all(bytes_again, F.lit("[\u0080-\u00ff]+"), F.lit(0))
    return F.exists(runs, lambda run: F.is_valid_utf8(F.encode(run, "ISO-8859-1").cast("string")))


def encoding_checks(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row per string column: column, n, replaced, double_encoded, broken (either) and broken_pct of its texts.

    ``replaced`` texts hold the replacement character or a NUL character.
    """
    parts = []
    for group in chunks(columns if columns is not None else string_columns(df), 10):
        flags = [F.struct((F.contains(col(c), F.lit("\ufffd")) | F.contains(col(c), F.lit("\0"))).alias("replaced"),
                          double_encoded(col(c)).alias("doubled"), col(c).isNotNull().alias("there")).alias(f"f{i}")
                 for i, c in enumerate(group)]
        counted = df.select(*flags).agg(*[F.count_if(F.expr(f"f{i}.{rule}")).alias(f"{name}{i}") for i in range(len(group)) for name, rule in (
            ("n", "there"), ("replaced", "replaced"), ("doubled", "doubled"), ("broken", f"replaced OR f{i}.doubled"))])
        rows = [F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("n"), F.col(f"replaced{i}").alias("replaced"),
                         F.col(f"doubled{i}").alias("double_encoded"), F.col(f"broken{i}").alias("broken"),
                         percentage(F.col(f"broken{i}"), F.col(f"n{i}")).alias("broken_pct")) for i, c in enumerate(group)]
        parts.append(counted.select(F.inline(F.array(*rows))))
    if not parts:
        return df.sparkSession.createDataFrame(
            [], "column string, n long, replaced long, double_encoded long, broken long, broken_pct double")
    return union_all(parts)


def text_checks(df: DataFrame, columns: list[str] | None = None, shortest: int = 1, longest: int = 100_000) -> DataFrame:
    """One row per string column: column, n, missing, blank, too_short, too_long, broken, min, mean and max length.

    Lengths are in characters. ``broken`` texts hold the replacement character, the mark of a wrong decoding, or a
    NUL character.
    """
    parts = []
    for group in chunks(columns if columns is not None else string_columns(df), 10):
        measured = []
        for i, c in enumerate(group):
            text, length = col(c), F.char_length(col(c))
            measured += [
                F.count(text).alias(f"n{i}"), F.count_if(F.btrim(text) == "").alias(f"blank{i}"),
                F.count_if(length < shortest).alias(f"short{i}"), F.count_if(length > longest).alias(f"long{i}"),
                F.count_if(F.contains(text, F.lit("\ufffd")) | F.contains(text, F.lit("\0"))).alias(f"broken{i}"),
                F.min(length).alias(f"min{i}"), F.avg(length).alias(f"mean{i}"), F.max(length).alias(f"max{i}")]
        counted = df.agg(F.count(F.lit(1)).alias("rows"), *measured)
        rows = [F.struct(
            F.lit(c).alias("column"), F.col(f"n{i}").alias("n"), (F.col("rows") - F.col(f"n{i}")).alias("missing"),
            F.col(f"blank{i}").alias("blank"), F.col(f"short{i}").alias("too_short"), F.col(f"long{i}").alias("too_long"),
            F.col(f"broken{i}").alias("broken"), F.col(f"min{i}").alias("min_length"), F.col(f"mean{i}").alias("mean_length"),
            F.col(f"max{i}").alias("max_length")) for i, c in enumerate(group)]
        parts.append(counted.select(F.inline(F.array(*rows))))
    if not parts:
        return df.sparkSession.createDataFrame([], "column string, n long, missing long, blank long, too_short long, "
                                                   "too_long long, broken long, min_length int, mean_length double, max_length int")
    return union_all(parts)
