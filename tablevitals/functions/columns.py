"""Column roles and the NaN -> NULL cleaning every operator starts from."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Label column names tried in this order before falling back to the last column (fixed values).
TARGET_NAMES = ("target", "label", "class", "y")

MAX_DOUBLE = 1.7976931348623157e308


def col(name: str) -> Column:
    """Column by exact name, also when the name holds dots or blanks."""
    return F.col("`" + name.replace("`", "``") + "`")


def role_of(dtype: T.DataType) -> str | None:
    """``numeric``, ``categorical``, ``datetime`` or None (booleans, nested types, ...)."""
    if isinstance(dtype, T.NumericType):
        return "numeric"
    if isinstance(dtype, (T.StringType, T.CharType, T.VarcharType)):
        return "categorical"
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "datetime"
    return None


def columns_with_role(df: DataFrame, role: str, exclude: Iterable[str] = ()) -> list[str]:
    skip = set(exclude)
    return [f.name for f in df.schema.fields if role_of(f.dataType) == role and f.name not in skip]


def numeric_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    return columns_with_role(df, "numeric", exclude)


def string_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    return columns_with_role(df, "categorical", exclude)


def clean(df: DataFrame, name: str) -> Column:
    """The column with NaN turned into NULL; a missing value then looks the same everywhere."""
    if isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType)):
        return F.nanvl(col(name), F.lit(None))
    return col(name)


def as_double(df: DataFrame, name: str) -> Column:
    """The cleaned numeric column as double."""
    return clean(df, name).cast("double")


def finite_double(df: DataFrame, name: str) -> Column:
    """The numeric column as double, everything not finite as NULL."""
    value = as_double(df, name)
    return F.when(F.abs(value) <= MAX_DOUBLE, value)


def normalize(df: DataFrame) -> DataFrame:
    """NaN -> NULL on every float and double column; the other columns pass through."""
    return df.select([clean(df, c).alias(c) for c in df.columns])


def pick_target(df: DataFrame) -> str:
    """The label column: the first well-known name present, else the last column."""
    for name in TARGET_NAMES:
        if name in df.columns:
            return name
    return df.columns[-1]


def zero_imputed(df: DataFrame, name: str) -> Column:
    """Feature value for a detector: NULL and NaN become 0, +-inf the largest finite double."""
    filled = F.coalesce(as_double(df, name), F.lit(0.0))
    return F.greatest(F.lit(-MAX_DOUBLE), F.least(F.lit(MAX_DOUBLE), filled))


def chunks(items: Sequence[str], size: int) -> list[list[str]]:
    return [list(items[i:i + size]) for i in range(0, len(items), size)]


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out
