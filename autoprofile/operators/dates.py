"""Which layout the dates of a text column are written in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from autoprofile.functions.coerce import (
    as_timestamp,
    family,
    maybe_date,
    quoted,
    timestamps_of,
)
from autoprofile.operators.wide import per_column


def layout_counts(candidate: Column) -> Column:
    """Aggregate over :func:`maybe_date`: how many values each layout reads."""
    return F.array(*[F.count(found) for found in timestamps_of(candidate)])


def date_layouts(df: DataFrame, names: list[str]) -> dict[str, int | None]:
    """The layout of each text column: the one that reads most values, the first of equals.

    One scan of these columns; None for a column without any date.
    """
    texts = [n for n in names if family(df.schema[n].dataType) == "string"]
    if not texts:
        return {}
    candidates = df.select(*[maybe_date(quoted(n)).alias(f"t{i}") for i, n in enumerate(texts)])
    facts = [
        [F.lit(n).alias("name"), layout_counts(F.col(f"t{i}")).alias("counts")]
        for i, n in enumerate(texts)
    ]
    found = {}
    for row in per_column(candidates, facts, fields_per_column=10).collect():
        most = max(row["counts"])
        found[row["name"]] = row["counts"].index(most) if most else None
    return found


def date_columns(df: DataFrame, names: list[str]) -> dict[str, Column]:
    """Columns as timestamps.  Text is read in its column's layout, the rest is NULL: day and
    month are never guessed value by value."""
    layouts = date_layouts(df, names)
    return {n: as_timestamp(n, df.schema[n].dataType, layouts.get(n)) for n in names}


def with_timestamps(df: DataFrame, names: list[str]) -> DataFrame:
    """The table with these columns as timestamps."""
    texts = [n for n in names if family(df.schema[n].dataType) == "string"]
    if not texts:
        return df
    found = date_columns(df, texts)
    return df.select(
        *[found[f].alias(f) if f in found else quoted(f) for f in df.columns]
    )
