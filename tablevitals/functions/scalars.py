"""Scalar helpers as Column expressions (they stay inside whole-stage code generation)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: File suffix -> file type (fixed values).
FILE_TYPES = {
    "csv": "csv",
    "xlsx": "excel",
    "xls": "excel",
    "parquet": "parquet",
    "jpg": "image",
    "jpeg": "image",
    "png": "image",
    "bmp": "image",
    "txt": "text",
    "json": "json",
    "jsonl": "json",
    "ndjson": "json",
}

#: File type -> dataset kind (fixed values).
KINDS = {
    "csv": "tabular",
    "excel": "tabular",
    "parquet": "tabular",
    "json": "tabular",
    "image": "image",
    "text": "text",
}

#: What Python's ``str.strip`` removes: every Unicode whitespace character (fixed values).
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

#: A string that parses as a number (fixed pattern). ``nan``, ``1d``, ``0x1F`` and ``1,000`` do not.
NUMERIC_TEXT = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$|^[+-]?([iI][nN][fF]([iI][nN][iI][tT][yY])?)$"


def round_exact(value: Column, digits: int = 2) -> Column:
    """Rounded by the number's exact binary value, whose true ties alone go to the even digit, as Python rounds.

    Spark rounds the shortest decimal text, which turns 2.675 (a little less in binary) into 2.68 instead of 2.67.
    Where the scaled number looks like a tie, the rounding error of the scaling, which the two halves of its
    digits give exactly, tells which side it lies on.
    """
    scale = float(10 ** digits)

    def rounded(x: Column) -> Column:
        scaled, split = x * scale, x * 134217729.0
        upper = split - (split - x)
        lost = (upper * scale - scaled) + (x - upper) * scale
        nearest = F.rint(scaled)
        tie = (F.abs(scaled - nearest) == 0.5) & (lost != 0)
        return F.when(tie, scaled + F.signum(lost) * 0.5).otherwise(nearest) / scale

    return F.get(F.transform(F.array(value.cast("double")), rounded), F.lit(0))


def percentage(part: Column, whole: Column) -> Column:
    """``part`` in percent of ``whole``, two decimals; 0.0 when ``whole`` is 0."""
    part, whole = part.cast("double"), whole.cast("double")
    share = round_exact(F.try_divide(part, whole) * 100, 2)
    return F.when(whole == 0, F.lit(0.0)).otherwise(share)


def strip(text: Column) -> Column:
    """Remove Unicode whitespace on both ends."""
    return F.btrim(text, F.lit(WHITESPACE))


def truncate_text(text: Column, max_length: int = 100) -> Column:
    """Texts longer than ``max_length`` keep their first ``max_length - 3`` characters plus dots."""
    cut = F.concat(F.substring(text, 1, max_length - 3), F.lit("..."))
    return F.when(F.length(text) > max_length, cut).otherwise(text)


def format_bytes(size: Column) -> Column:
    """A byte count with two decimals and the largest fitting unit, in steps of 1024."""
    size = size.cast("double")
    label = None
    for power, unit in enumerate(["B", "KB", "MB", "GB", "TB"]):
        scaled = F.format_string("%.2f " + unit, round_exact(size / float(1024 ** power), 2))
        fits = size < float(1024 ** (power + 1))
        label = F.when(fits, scaled) if label is None else label.when(fits, scaled)
    return label.otherwise(F.format_string("%.2f PB", round_exact(size / float(1024 ** 5), 2)))


def _lookup(table: dict[str, str], key: Column, default: str) -> Column:
    pairs = F.create_map(*[F.lit(x) for item in table.items() for x in item])
    return F.coalesce(F.try_element_at(pairs, key), F.lit(default))


def suffix(path: Column) -> Column:
    """Lower-case suffix of the last path segment without the dot ('' if there is none)."""
    name = F.regexp_extract(path, r"([^/]*)/*$", 1)
    # A leading dot starts a hidden file's name; it is no suffix.
    return F.lower(F.regexp_extract(name, r"^.+[.]([^.]+)$", 1))


def file_type(path: Column) -> Column:
    """csv / excel / parquet / json / image / text / unknown, from the suffix."""
    return _lookup(FILE_TYPES, suffix(path), "unknown")


def dataset_kind(path: Column) -> Column:
    """tabular / image / text / unknown, from the suffix."""
    return _lookup(KINDS, file_type(path), "unknown")


def is_numeric_text(text: Column) -> Column:
    """NULL, blank and numeric strings pass.

    The first character rules out most prose before the pattern sees the text.
    """
    trimmed = F.trim(text)
    may_start = F.substring(trimmed, 1, 1).isin(*"+-.0123456789iI")
    return text.isNull() | (trimmed == "") | (may_start & trimmed.rlike(NUMERIC_TEXT))


def normalize_scores(df: DataFrame, column: str, low: float = 0.0, high: float = 100.0,
                     output: str = "normalized") -> DataFrame:
    """Min-max scaling of a score column into [low, high]; a constant column maps to the middle."""
    score = F.nanvl(F.col("`" + column.replace("`", "``") + "`").cast("double"), F.lit(None))
    ends = df.agg(F.struct(F.min(score).alias("lo"), F.max(score).alias("hi")).alias("ends")).scalar()
    span = ends["hi"] - ends["lo"]
    scaled = F.try_divide(score - ends["lo"], span) * (high - low) + low
    middle = F.when(score.isNotNull(), F.lit((low + high) / 2))
    return df.withColumn(output, F.when(span == 0, middle).otherwise(scaled))
