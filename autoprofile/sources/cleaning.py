"""Columns and rows without any value."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from autoprofile.functions.coerce import nan_to_null, quoted
from autoprofile.functions.numeric import any_of
from autoprofile.operators.tables import null_profile


def empty_columns(df: DataFrame) -> list[str]:
    """Columns without a single value; one scan, one row per column."""
    rows = null_profile(df).where(F.col("non_null_count") == 0).collect()
    found = {r["column"] for r in rows}
    return [c for c in df.columns if c in found]


def drop_empty_rows(df: DataFrame) -> DataFrame:
    """Rows with at least one value."""
    if not df.columns:
        return df
    return df.where(any_of([quoted(c).isNotNull() for c in df.columns]))


def drop_empty(df: DataFrame) -> DataFrame:
    """The table without all-null columns and then without all-null rows."""
    clean = nan_to_null(df)
    gone = set(empty_columns(clean))
    return drop_empty_rows(clean.select(*[quoted(c) for c in clean.columns if c not in gone]))
