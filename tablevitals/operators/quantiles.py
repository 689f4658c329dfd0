"""Exact quantiles with bounded memory.

Spark's ``percentile`` keeps every distinct value of a group in one buffer of one task, which no memory holds once a
column has billions of distinct values. Here a sketch gives two values around every wanted rank, counting tells
how many values lie below, on, between and above them, and the rank is then either one of the two values or among the
few rows strictly between. Those are sketched again while they are many, and read off by counting once they are
few. Three scans serve most tables; what is shuffled and collected depends on the number of columns and ranks only.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablevitals.functions.columns import as_double, chunks, numeric_columns

#: A range with at most this many rows is read off by counting its values.
FEW_ROWS = 200_000

#: Accuracy of the sketches: ranks are off by one part in so many at most.
ACCURACY = 10_000

#: Columns per scan: the JVM compiles generated methods up to 8000 bytes only.
COLUMNS_PER_SCAN = 10

SCHEMA = "column string, p double, value double"


@dataclass(frozen=True)
class _Range:
    """The values of ``column`` strictly between ``low`` and ``high`` (None: no limit), which hold the ranks.

    ``rows`` of them are there, with ``below`` values up to ``low``.
    """

    column: str
    low: float | None
    high: float | None
    below: int
    rows: int
    ranks: tuple[int, ...]

    @property
    def holds(self) -> str:
        limits = [f"{self.column} {sign} {_literal(end)}" for sign, end in ((">", self.low), ("<", self.high))
                  if end is not None]
        return f"({' AND '.join(limits or [f'{self.column} IS NOT NULL'])})"


def _literal(value: float) -> str:
    if math.isinf(value):
        return "double('Infinity')" if value > 0 else "double('-Infinity')"
    return f"{value!r}D"


def quantiles(df: DataFrame, probabilities: Sequence[float], columns: Sequence[str] | None = None,
              method: str = "exact", few_rows: int = FEW_ROWS) -> DataFrame:
    """Quantiles with linear interpolation over the non-null values: column, p, value.

    ``method="approx"`` uses ``percentile_approx`` (rank error 1/10000) in a single pass.
    """
    found = quantile_values(df, probabilities, columns, method, few_rows)
    rows = [(c, float(p), found[c][i]) for c in found for i, p in enumerate(probabilities)]
    return df.sparkSession.createDataFrame(rows, SCHEMA)


def quantile_values(df: DataFrame, probabilities: Sequence[float], columns: Sequence[str] | None = None,
                    method: str = "exact", few_rows: int = FEW_ROWS) -> dict[str, list[float | None]]:
    """The same as plain values: per column one number per probability (None without values)."""
    columns = list(columns if columns is not None else numeric_columns(df))
    found: dict[str, list[float | None]] = {}
    for group in chunks(columns, COLUMNS_PER_SCAN):
        # Short aliases keep odd column names out of the expressions below.
        data = df.select([as_double(df, c).alias(f"v{i}") for i, c in enumerate(group)])
        values = _approximate(data, probabilities) if method == "approx" else _exact(data, probabilities, few_rows)
        found.update({c: values[f"v{i}"] for i, c in enumerate(group)})
    return found


def value_at_rank(df: DataFrame, column: str, rank: int, few_rows: int = FEW_ROWS) -> float:
    """The ``rank``-th smallest non-null value of a column, counted from 0."""
    data = df.select(as_double(df, column).alias("v0"))
    rows = data.selectExpr("count(v0) AS n").first()["n"]
    if not 0 <= rank < rows:
        raise ValueError(f"rank {rank} of {rows} values")
    whole = _Range("v0", None, None, 0, rows, (rank,))
    return _select(data, [whole], _sketched(data, [whole]), few_rows)["v0", rank]


def _approximate(data: DataFrame, probabilities: Sequence[float]) -> dict[str, list[float | None]]:
    points = F.array(*[F.lit(float(p)) for p in probabilities])
    row = data.agg(*[F.percentile_approx(c, points, ACCURACY).alias(c) for c in data.columns]).first()
    return {c: list(row[c]) if row[c] is not None else [None] * len(probabilities) for c in data.columns}


def _around(share: float) -> tuple[float, float]:
    """Shares whose sketched values have the wanted rank between them."""
    return max(0.0, share - 2 / ACCURACY), min(1.0, share + 2 / ACCURACY)


def _exact(data: DataFrame, probabilities: Sequence[float], few_rows: int) -> dict[str, list[float | None]]:
    # The first sketch asks by share, so that it needs no row count and joins the counting pass.
    points = ", ".join(f"{x!r}D" for p in probabilities for x in _around(p))
    row = data.selectExpr(*[e for c in data.columns for e in (
        f"count({c}) AS n_{c}", f"percentile_approx({c}, array({points}), {ACCURACY}) AS s_{c}")]).first()
    wanted, ranges, ends = {}, [], []
    for c in data.columns:
        n = row[f"n_{c}"]
        for i, p in enumerate(probabilities if n else ()):
            wanted[c, i] = (math.floor(p * (n - 1)), math.ceil(p * (n - 1)))
            ranges.append(_Range(c, None, None, 0, n, tuple(sorted(set(wanted[c, i])))))
            ends.append((row[f"s_{c}"][2 * i], row[f"s_{c}"][2 * i + 1]))
    at_rank = _select(data, ranges, ends, few_rows)
    out: dict[str, list[float | None]] = {}
    for c in data.columns:
        out[c] = []
        for i, p in enumerate(probabilities):
            if (c, i) not in wanted:
                out[c].append(None)
                continue
            low, high = wanted[c, i]
            a, b = at_rank[c, low], at_rank[c, high]
            out[c].append(a if a == b else a + (b - a) * (p * (row[f"n_{c}"] - 1) - low))
    return out


def _sketched(data: DataFrame, ranges: Sequence[_Range]) -> list[tuple[float, float]]:
    """Two values around the ranks of every range, from within the range."""
    asked = []
    for i, r in enumerate(ranges):
        low, high = _around((r.ranks[0] - r.below) / r.rows)[0], _around((r.ranks[-1] - r.below) / r.rows)[1]
        asked.append(f"percentile_approx(CASE WHEN {r.holds} THEN {r.column} END, array({low!r}D, {high!r}D), "
                     f"{ACCURACY}) AS q{i}")
    return [tuple(q) for q in data.selectExpr(*asked).first()]


def _select(data: DataFrame, ranges: list[_Range], ends: list[tuple[float, float]],
            few_rows: int) -> dict[tuple[str, int], float]:
    """The value at every wanted rank (0-based) of every range; ``ends`` are two values around its ranks."""
    found: dict[tuple[str, int], float] = {}
    few: list[_Range] = []
    while ranges:
        narrowed = _counted(data, ranges, ends, found)
        few += [r for r in narrowed if r.rows <= few_rows]
        ranges = [r for r in narrowed if r.rows > few_rows]
        ends = _sketched(data, ranges) if ranges else []
    return found | _read_off(data, few)


def _counted(data: DataFrame, ranges: list[_Range], ends: list[tuple[float, float]],
             found: dict[tuple[str, int], float]) -> list[_Range]:
    """Places every rank on one of the two end values (then it is found), or in a range beside or between them.

    A value's place among all limits of its column is one number: twice the limits below it, one more if it
    is a limit itself. One row per column and place comes back.
    """
    limits: dict[str, list[float]] = {}
    for r, pair in zip(ranges, ends):
        limits.setdefault(r.column, []).extend(x for x in (r.low, r.high, *pair) if x is not None)
    limits = {c: sorted(set(values)) for c, values in limits.items()}
    width = 2 * max(map(len, limits.values())) + 1
    places = []
    for i, (c, values) in enumerate(limits.items()):
        first = i * width
        steps = " ".join(f"WHEN {c} < {_literal(x)} THEN {first + 2 * k} WHEN {c} = {_literal(x)} THEN {first + 2 * k + 1}"
                         for k, x in enumerate(values))
        places.append(f"CASE {steps} WHEN {c} IS NOT NULL THEN {first + 2 * len(values)} END")
    counted = (data.selectExpr(f"explode(array({', '.join(places)})) AS place").filter("place IS NOT NULL")
               .groupBy("place").agg(F.count(F.lit(1)).alias("rows")))
    rows = {row["place"]: row["rows"] for row in counted.collect()}
    out: dict[tuple, _Range] = {}
    for r in ranges:
        column, values = list(limits).index(r.column), limits[r.column]
        below = 0
        for place in range(2 * len(values) + 1):
            n = rows.get(column * width + place, 0)
            ranks = tuple(k for k in r.ranks if below <= k < below + n)
            if ranks and place % 2:
                found.update({(r.column, k): values[place // 2] for k in ranks})
            elif ranks:
                low = values[place // 2 - 1] if place else None
                high = values[place // 2] if place < 2 * len(values) else None
                held = out.get((r.column, low))
                merged = tuple(sorted({*ranks, *(held.ranks if held else ())}))
                out[r.column, low] = _Range(r.column, low, high, below, n, merged)
            below += n
    return list(out.values())


def _read_off(data: DataFrame, ranges: list[_Range]) -> dict[tuple[str, int], float]:
    """The values at the ranks of ranges with few rows."""
    if not ranges:
        return {}
    names = list(dict.fromkeys(r.column for r in ranges))
    cells = []
    for name in names:
        cases = [f"WHEN {r.holds} THEN {i}" for i, r in enumerate(ranges) if r.column == name]
        cells.append(f"CASE {' '.join(cases)} END")
    column_of = ", ".join(str(names.index(r.column)) for r in ranges)
    value = f"get(array({', '.join(names)}), get(array({column_of}), range)) AS x"
    counted = (
        data.filter(" OR ".join(r.holds for r in ranges))
        .selectExpr(*names, f"explode(array({', '.join(cells)})) AS range").filter("range IS NOT NULL")
        .selectExpr("range", value).groupBy("range", "x").agg(F.count(F.lit(1)).alias("rows"))
    )
    upto = F.sum("rows").over(Window.partitionBy("range").orderBy("x"))  # few_rows rows each at most
    keep = " OR ".join(f"(range = {i} AND upto > {k - r.below} AND upto - rows <= {k - r.below})"
                       for i, r in enumerate(ranges) for k in r.ranks)
    found = {}
    for row in counted.withColumn("upto", upto).filter(keep).collect():  # one row per wanted rank at most
        r = ranges[row["range"]]
        first = r.below + row["upto"] - row["rows"]
        found.update({(r.column, k): row["x"] for k in r.ranks if first <= k < first + row["rows"]})
    return found
