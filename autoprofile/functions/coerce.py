"""Null-safe coercions: text to number, text to timestamp, NaN to NULL.

All are plain column expressions.  None of them raises under ANSI mode: a value that
does not parse becomes NULL.  The cheap shape test always comes first in a CASE, so long
free text is rejected on its first characters and never reaches a cast.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The characters that count as white space at either end of a text.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

NUMBER_PATTERN = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
INTEGER_PATTERN = r"^[+-]?\d+$"
ISO_PATTERN = (
    r"^\d{4}-\d{1,2}-\d{1,2}([ T]\d{1,2}:\d{2}(:\d{2}(\.\d{1,9})?)?(Z|[+-]\d{2}:\d{2})?)?$"
)

# Accepted non-ISO date layouts (shape, format).  A purely numeric text is
# never a date.  A column has one layout: the one most of its values have, the first of
# equals.
DATE_LAYOUTS = (
    (r"^\d{4}/\d{1,2}/\d{1,2}$", "yyyy/M/d"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "d/M/yyyy"),
    (r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}(:\d{2})?$", "M/d/yyyy H:mm[:ss]"),
    (r"^\d{1,2}-\d{1,2}-\d{4}$", "d-M-yyyy"),
    (r"^\d{1,2}\.\d{1,2}\.\d{4}$", "d.M.yyyy"),
    (r"^\d{1,2} [A-Z][a-z]{2} \d{4}$", "d MMM yyyy"),
    (r"^[A-Z][a-z]{2} \d{1,2}, \d{4}$", "MMM d, yyyy"),
    (r"^\d{1,2}-[A-Z][a-z]{2}-\d{4}$", "d-MMM-yyyy"),
)

NUMERIC_TYPES = (T.NumericType,)
DATETIME_TYPES = (T.TimestampType, T.TimestampNTZType, T.DateType)


def family(dtype: T.DataType) -> str:
    """Which inference path a physical type takes."""
    if isinstance(dtype, T.BooleanType):
        return "boolean"
    if isinstance(dtype, NUMERIC_TYPES):
        return "number"
    if isinstance(dtype, DATETIME_TYPES):
        return "datetime"
    if isinstance(dtype, (T.StringType, T.VarcharType, T.CharType)):
        return "string"
    if isinstance(dtype, T.NullType):
        return "void"
    return "nested"


def value_kind(dtype: T.DataType) -> str | None:
    """The common type in which distinct values of this type are compared."""
    kind = family(dtype)
    if kind in ("nested", "void"):
        return None
    if isinstance(dtype, T.IntegralType):
        return "long"
    if isinstance(dtype, (T.FloatType, T.DoubleType, T.DateType)):
        return dtype.typeName()
    return "timestamp" if kind == "datetime" else "string"


def quoted(name: str) -> Column:
    """The column called ``name``, whatever characters the name holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN is the missing-value marker of float columns: make it NULL."""
    floats = {
        f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))
    }
    if not floats:
        return df
    return df.select(
        *[
            F.nanvl(quoted(f.name), F.lit(None).cast(f.dataType)).alias(f.name)
            if f.name in floats
            else quoted(f.name)
            for f in df.schema
        ]
    )


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE))


def text_number(text: Column, strip_commas: bool = True) -> Column:
    """Number written in ``text`` as a double, else NULL."""
    stripped = strip(text)
    digits = strip(F.replace(stripped, F.lit(","), F.lit(""))) if strip_commas else stripped
    return F.when(
        stripped.rlike(r"^[+\-.,\d]") & digits.rlike(NUMBER_PATTERN), digits.try_cast("double")
    )


def maybe_date(text: Column) -> Column:
    """The stripped text if it begins as a date does, else NULL."""
    stripped = strip(text)
    return F.when(stripped.rlike(r"^(\d|[A-Z][a-z]{2} )"), stripped)


def layout_timestamps(text: Column) -> list[Column]:
    """For each layout, ISO first, the date or time that ``text`` writes in it, else NULL."""
    return timestamps_of(maybe_date(text))


def timestamps_of(candidate: Column) -> list[Column]:
    """The same from :func:`maybe_date`."""
    found = [F.when(candidate.rlike(ISO_PATTERN), candidate.try_cast("timestamp"))]
    return found + [
        F.when(candidate.rlike(shape), F.try_to_timestamp(candidate, F.lit(layout)))
        for shape, layout in DATE_LAYOUTS
    ]


def text_timestamp(text: Column) -> Column:
    """Date or time written in ``text`` in any layout, else NULL."""
    return F.coalesce(*layout_timestamps(text))


def moment(value: dt.datetime) -> Column:
    """A timestamp literal; a naive ``value`` is read in the session's time zone."""
    if value.tzinfo is not None:
        since = (value - dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)).total_seconds()
        return F.timestamp_micros(F.lit(round(since * 1_000_000)))
    return F.lit(value.isoformat(sep=" ")).cast("timestamp")


def as_number(name: str, dtype: T.DataType, strip_commas: bool = True) -> Column:
    """Column ``name`` as a double, NaN and unparsable text as NULL."""
    column = quoted(name)
    kind = family(dtype)
    if kind == "string":
        return text_number(column, strip_commas)
    if kind == "boolean":
        return column.cast("int").cast("double")
    if kind != "number":
        return F.lit(None).cast("double")
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return F.nanvl(column.cast("double"), F.lit(None).cast("double"))
    return column.cast("double")


def as_timestamp(name: str, dtype: T.DataType, layout: int | None = None) -> Column:
    """Column ``name`` as a timestamp; text in the given layout, other text as NULL."""
    kind = family(dtype)
    if kind == "string" and layout is not None:
        return layout_timestamps(quoted(name))[layout]
    if kind == "datetime":
        return quoted(name).cast("timestamp")
    return F.lit(None).cast("timestamp")


def number_columns(df: DataFrame, names: list[str]) -> dict[str, Column]:
    return {n: as_number(n, df.schema[n].dataType) for n in names}
