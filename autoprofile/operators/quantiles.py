"""Exact quantiles of any number of columns without sorting or gathering a column.

The built-in exact percentile keeps a map of every distinct value and merges all maps in one
task.  Here the rows that hold the wanted ranks are closed in on instead: a histogram with a
fixed number of cells per column tells which cell holds each rank, and only rows of that cell
are looked at in the next round, until a bracket is small enough to count value by value.
Every round is one scan of the columns still open with a small grouped count.  Every bracket
splits at each round because its smallest and largest value land in different cells, so the
search always ends: with n rows it takes about log(n / LEAF_ROWS) / log(CELLS) rounds and one
more for the leaves, two or three for a trillion rows that are spread evenly.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from autoprofile.functions.coerce import quoted
from autoprofile.operators.wide import chunked

CELLS = 2048
#: columns that one aggregation goes through; a wider table takes several in one job
CHUNK = 32
#: brackets of at most this many rows are counted value by value
LEAF_ROWS = 50_000


@dataclass(frozen=True)
class Bracket:
    """Rows of one column with ``low <= value <= high``, and the ranks wanted among them."""

    column: str
    low: float
    high: float
    rows: int
    rows_below: int
    ranks: tuple[int, ...]


#: how the cell of a value is found: the value itself, equal steps, or equal steps of a
#: logarithm for values above zero, below zero, or on both sides
LEAF, LINEAR, POSITIVE, NEGATIVE, BOTH = range(5)
TOP = sys.float_info.max


def _is_wide(low: float, high: float) -> bool:
    """Does the range span so many magnitudes that equal cells would be mostly empty?"""
    small, large = sorted((abs(low), abs(high)))
    return math.isinf(high - low) or (low > 0) != (high > 0) or large > 1000 * small


def _scale(bracket: Bracket, leaf_rows: int) -> tuple[int, float, float]:
    """The kind of cells of a bracket, and its ends on their scale."""
    low, high = bracket.low, bracket.high
    if bracket.rows <= leaf_rows:
        return LEAF, 0.0, 1.0
    if not _is_wide(low, high):
        return LINEAR, low, high
    if low > 0:
        return POSITIVE, math.log(low), math.log(min(high, TOP))
    if high < 0:
        return NEGATIVE, -math.log(min(-low, TOP)), -math.log(-high)
    ends = [math.copysign(math.log1p(min(abs(v), TOP)), v) for v in (low, high)]
    return BOTH, ends[0], ends[1]


def _listed(values: Sequence[float | int | None]) -> Column:
    """A constant array, as one expression however long it is."""

    def written(v: float | int | None) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, int):
            return f"{v}L"
        if math.isinf(v):
            return f"double('{'-' if v < 0 else ''}Infinity')"
        return f"{v!r}D"

    return F.expr(f"array({', '.join(map(written, values))})")


def _cell(value: Column, bracket: Column, scales: list[tuple[int, float, float]]) -> Column:
    """Cell number inside the bracket, growing with the value; the value itself in a leaf."""
    kinds = _listed([k for k, _, _ in scales])
    low = F.get(_listed([float(a) for _, a, _ in scales]), bracket)
    spread = F.get(_listed([float(b - a) for _, a, b in scales]), bracket)
    kind = F.get(kinds, bracket)
    size = F.least(F.abs(value), F.lit(TOP))
    position = (
        F.when(kind == LINEAR, value)
        .when(kind == POSITIVE, F.ln(size))
        .when(kind == NEGATIVE, -F.ln(size))
        .otherwise(F.signum(value) * F.log1p(size))
    )
    cell = F.floor((position - low) / spread * CELLS).cast("double")
    inside = F.greatest(F.lit(0.0), F.least(F.lit(CELLS - 1.0), cell))
    return F.when(kind == LEAF, value).otherwise(inside)


def counted_cells(
    df: DataFrame,
    values: Mapping[str, Column],
    brackets: Sequence[Bracket],
    leaf_rows: int = LEAF_ROWS,
) -> DataFrame:
    """(bracket, cell, rows, low, high) of the cells that any row of a bracket falls into.

    Columns are turned into rows (slot, value), and what belongs to a slot is looked up in
    constant arrays, so the expressions do not grow with the number of columns.
    """
    scales = [_scale(b, leaf_rows) for b in brackets]
    parts = []
    for columns in chunked(sorted({b.column for b in brackets}), CHUNK):
        own: dict[str, list[int]] = {c: [] for c in columns}
        for number, b in enumerate(brackets):
            if b.column in own:
                own[b.column].append(number)
        slot, value = F.col("slot").cast("int"), F.col("value")
        bracket = None
        for k in range(max(map(len, own.values()))):
            numbers = [n[k] if k < len(n) else None for n in own.values()]
            low, high = (
                F.get(_listed([None if n is None else float(getattr(brackets[n], end))
                               for n in numbers]), slot)
                for end in ("low", "high")
            )
            inside, number = value.between(low, high), F.get(_listed(numbers), slot)
            bracket = F.when(inside, number) if bracket is None else bracket.when(inside, number)
        names = [str(i) for i in range(len(columns))]
        parts.append(
            df.select(*[values[c].alias(n) for c, n in zip(columns, names)])
            .unpivot([], [quoted(n) for n in names], "slot", "value")
            .select(bracket.cast("int").alias("bracket"), "value")
            .where(F.col("bracket").isNotNull())
            .select("bracket", _cell(value, F.col("bracket"), scales).alias("cell"), "value")
            .groupBy("bracket", "cell")
            .agg(
                F.count(F.lit(1)).alias("rows"),
                F.min("value").alias("low"),
                F.max("value").alias("high"),
            )
        )
    return reduce(DataFrame.unionByName, parts)


def _found_cells(
    df: DataFrame, values: Mapping[str, Column], brackets: Sequence[Bracket], leaf_rows: int
) -> list:
    """The cells that hold a wanted rank, with their extent: a few rows per bracket."""
    width = max(len(b.ranks) for b in brackets)
    wanted = [
        F.get(_listed([b.ranks[k] - b.rows_below if k < len(b.ranks) else None
                       for b in brackets]), F.col("bracket"))
        for k in range(width)
    ]
    upto = Window.partitionBy("bracket").orderBy("cell")
    return (
        counted_cells(df, values, brackets, leaf_rows)
        .withColumn("before", F.sum("rows").over(upto) - F.col("rows"))
        .withColumn(
            "held",
            F.filter(
                F.array_compact(F.array(*wanted)),
                lambda r: (r >= F.col("before")) & (r < F.col("before") + F.col("rows")),
            ),
        )
        .where(F.size("held") > 0)
        .collect()
    )


def values_at_ranks(
    df: DataFrame,
    values: Mapping[str, Column],
    brackets: Sequence[Bracket],
    leaf_rows: int = LEAF_ROWS,
) -> dict[tuple[str, int], float]:
    """(column, 0-based rank) -> value, for all ranks named in ``brackets``."""
    found: dict[tuple[str, int], float] = {}
    open_brackets = [b for b in brackets if b.ranks]
    while open_brackets:
        unsettled = []
        for bracket in open_brackets:
            if bracket.low == bracket.high:
                found.update({(bracket.column, r): bracket.low for r in bracket.ranks})
            else:
                unsettled.append(bracket)
        if not unsettled:
            break
        open_brackets = [
            replace(
                unsettled[row["bracket"]],
                low=row["low"],
                high=row["high"],
                rows=row["rows"],
                rows_below=unsettled[row["bracket"]].rows_below + row["before"],
                ranks=tuple(r + unsettled[row["bracket"]].rows_below for r in row["held"]),
            )
            for row in _found_cells(df, values, unsettled, leaf_rows)
        ]
    return found


def exact_quantiles(
    df: DataFrame,
    values: Mapping[str, Column],
    extents: Mapping[str, tuple[int, float, float]],
    shares: Sequence[float],
    leaf_rows: int = LEAF_ROWS,
) -> dict[str, list[float | None]]:
    """Quantiles by linear interpolation between ranks.

    ``extents`` gives (non-null rows, minimum, maximum) of every column, which the caller has
    from an earlier pass.  A column without rows gets ``None`` for every share.
    """
    wanted, brackets = {}, []
    for column, (rows, low, high) in extents.items():
        if not rows:
            continue
        spots = [share * (rows - 1) for share in shares]
        wanted[column] = [
            (math.floor(s), min(math.floor(s) + 1, rows - 1), s - math.floor(s)) for s in spots
        ]
        ranks = sorted({r for lower, upper, _ in wanted[column] for r in (lower, upper)})
        brackets.append(Bracket(column, low, high, rows, 0, tuple(ranks)))
    at = values_at_ranks(df, values, brackets, leaf_rows)

    def interpolate(column: str, spot: tuple[int, int, float]) -> float:
        lower, upper = at[column, spot[0]], at[column, spot[1]]
        return lower if lower == upper else lower * (1 - spot[2]) + upper * spot[2]

    return {
        column: [interpolate(column, spot) for spot in wanted[column]]
        if column in wanted
        else [None] * len(shares)
        for column in extents
    }
