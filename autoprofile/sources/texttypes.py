"""Physical types for tables that were read as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from autoprofile.functions.coerce import INTEGER_PATTERN, family, quoted, strip, text_number
from autoprofile.operators.wide import per_column

# Texts that stand for a missing value in delimited files.
MISSING_MARKERS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


def unless_missing(text: Column) -> Column:
    """NULL for the texts that mean "missing"."""
    return F.when(~text.isin(*MISSING_MARKERS), text)


def blank_markers(df: DataFrame) -> DataFrame:
    """Texts that mean "missing" become NULL."""
    return df.select(
        *[
            unless_missing(quoted(f.name)).alias(f.name)
            if family(f.dataType) == "string"
            else quoted(f.name)
            for f in df.schema
        ]
    )


def _as_integer(text: Column) -> Column:
    stripped = strip(text)
    return F.when(stripped.rlike(INTEGER_PATTERN), stripped.try_cast("bigint"))


def _as_boolean(text: Column) -> Column:
    return F.when(text.isin("True", "TRUE", "true"), True).when(
        text.isin("False", "FALSE", "false"), False
    )


def narrow_types(df: DataFrame) -> DataFrame:
    """Text columns whose every value is an integer, a number or a truth value get that type.

    One scan decides for all columns.  Dates stay texts; they are recognised later, as a
    business type.
    """
    texts = [f.name for f in df.schema if family(f.dataType) == "string"]
    if not texts:
        return df
    facts = []
    for name in texts:
        column = quoted(name)
        facts.append([
            F.lit(name).alias("column"),
            F.count(column).alias("present"),
            F.count(_as_integer(column)).alias("integers"),
            F.count(text_number(column, strip_commas=False)).alias("numbers"),
            F.count(_as_boolean(column)).alias("booleans"),
        ])
    casts: dict[str, Column] = {}
    for row in per_column(df, facts, fields_per_column=4).collect():
        name, present = row["column"], row["present"]
        if not present:
            continue
        if row["integers"] == present:
            casts[name] = _as_integer(quoted(name))
        elif row["numbers"] == present:
            casts[name] = text_number(quoted(name), strip_commas=False)
        elif row["booleans"] == present:
            casts[name] = _as_boolean(quoted(name))
    return df.select(*[casts.get(c, quoted(c)).alias(c) for c in df.columns])
