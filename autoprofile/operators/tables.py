"""Whole-table figures: nulls, complete rows, duplicates, time span, dataset summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from autoprofile.functions.coerce import nan_to_null, quoted
from autoprofile.functions.keys import row_fingerprint
from autoprofile.functions.numeric import all_of, percent
from autoprofile.operators.dates import date_columns
from autoprofile.operators.wide import local_frame, per_column

DAY_IN_MICROS = 86_400_000_000


def null_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Null count and share per column; NaN counts as null."""
    names = columns if columns is not None else df.columns
    clean = nan_to_null(df)
    facts = [
        [
            F.lit(name).alias("column"),
            F.count(F.lit(1)).alias("total_rows"),
            F.count(quoted(name)).alias("present"),
        ]
        for name in names
    ]
    missing = F.col("total_rows") - F.col("present")
    schema = "column string, total_rows long, present long"
    return per_column(clean, facts, fields_per_column=2, schema=schema).select(
        "column",
        "total_rows",
        missing.alias("null_count"),
        F.col("present").alias("non_null_count"),
        percent(missing, F.col("total_rows")).alias("null_pct"),
    )


def datetime_summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """First and last date and the whole days between, per time column."""
    facts = []
    for name, moment in date_columns(df, columns).items():
        facts.append([
            F.lit(name).alias("column"),
            F.min(moment).alias("first"),
            F.max(moment).alias("last"),
        ])
    span = F.unix_micros("last") - F.unix_micros("first")
    return (
        per_column(
            df, facts, fields_per_column=2, schema="column string, first timestamp, last timestamp"
        )
        .where(F.col("first").isNotNull())
        .select(
            "column",
            F.to_date("first").alias("date_min"),
            F.to_date("last").alias("date_max"),
            F.floor(span / F.lit(DAY_IN_MICROS)).cast("long").alias("date_range_days"),
        )
    )


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows that repeat an earlier one; nulls equal each other.

    Only 16 bytes per distinct row are shuffled, and copies are merged before the shuffle, so
    neither wide rows nor one row copied a billion times makes a heavy task.
    """
    copies = (
        nan_to_null(df)
        .select(*row_fingerprint(df))
        .groupBy("fingerprint_a", "fingerprint_b")
        .agg(F.count(F.lit(1)).alias("copies"))
    )
    return copies.agg(
        F.coalesce(F.sum("copies"), F.lit(0)).alias("rows"),
        F.count(F.lit(1)).alias("distinct_rows"),
        F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("duplicate_rows"),
    )


def complete_rows(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rows without a null in any of ``columns`` (default: all columns)."""
    names = columns if columns is not None else df.columns
    whole: Column = all_of([quoted(n).isNotNull() for n in names])
    return nan_to_null(df).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(whole).alias("complete_rows")
    )


def _complete_count(df: DataFrame, catalog_rows: list, total: int) -> int:
    """Only columns known to hold some nulls are read; often there are none."""
    gaps = [r["column_name"] for r in catalog_rows if r["null_count"]]
    if not gaps:
        return total
    if any(r["non_null_count"] == 0 for r in catalog_rows):
        return 0
    return complete_rows(df, gaps).first()["complete_rows"]


def _duplicate_count(df: DataFrame, catalog_rows: list, total: int, exact: bool) -> int:
    """A column without nulls or repeats proves that no row repeats."""
    if exact and any(r["unique_count"] == total for r in catalog_rows):
        return 0
    return duplicate_rows(df).first()["duplicate_rows"]


def dataset_summary(df: DataFrame, catalog: DataFrame, exact_distinct: bool = True) -> DataFrame:
    """Rows, columns, complete rows and duplicates of a table whose catalog is known.

    Set ``exact_distinct=False`` when the catalog holds estimated distinct counts.
    """
    rows = catalog.collect()
    total = rows[0]["total_rows"] if rows else df.count()
    complete = _complete_count(df, rows, total) if total else 0
    duplicates = _duplicate_count(df, rows, total, exact_distinct) if total else 0
    summary = local_frame(
        df.sparkSession,
        [(total, len(df.columns), sum(not r["ignore"] for r in rows), complete, duplicates)],
        "rows long, columns int, analysis_columns int, complete_rows long, duplicate_rows long",
    )
    return summary.select(
        "rows",
        "columns",
        "analysis_columns",
        "complete_rows",
        percent(F.col("complete_rows"), F.col("rows")).alias("complete_row_pct"),
        "duplicate_rows",
    )
