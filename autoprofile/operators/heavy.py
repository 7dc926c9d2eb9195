"""The most frequent values of columns with very many distinct values, in two scans.

The first scan counts rows by a hash bucket of the value: a table of fixed size per task, which
merges by addition.  A bucket's total bounds the count of every value in it.  The second scan
counts exactly, but only the values of the fullest buckets.  If no other bucket holds as many
rows as the last of the top N values, no value outside can be among them, or tie with them.
Where this proof fails, the buckets in doubt are opened as well, and a column in which too many
are in doubt (a key, a flat distribution) is counted whole.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from autoprofile.functions.coerce import nan_to_null, quoted, value_kind
from autoprofile.operators.wide import empty_frame, local_frame

#: rows per column and task that the first scan sends, at most
BUCKETS = 1 << 16
#: buckets are opened at first from this share of the rows of the top N's fullest on
SHARE = 0.5
#: a column with more buckets in doubt is counted whole
DOUBTFUL = 1000

TOTALS_SCHEMA = "column string, non_null_count long"


@dataclass(frozen=True)
class Summary:
    """The fullest buckets of a column, fullest first, and what all buckets hold."""

    fullest: list[tuple[int, int]]  # (rows, bucket)
    rows: int
    whole: bool  # no bucket is left out of ``fullest``

    def first(self, top_n: int) -> set[int] | None:
        """The buckets to open at first; None for all."""
        if len(self.fullest) < top_n:
            return self.opened_for(1)
        return self.opened_for(max(1, int(SHARE * self.fullest[top_n - 1][0])))

    def opened_for(self, least: int) -> set[int] | None:
        """The buckets that can hold a value as frequent as ``least``; None for all."""
        if not self.whole and self.fullest[-1][0] >= least:
            return None
        return {bucket for rows, bucket in self.fullest if rows >= least}


def _typed(df: DataFrame, name: str) -> Column:
    """The value in the type in which it is counted; both zeros are one value."""
    kind = value_kind(df.schema[name].dataType)
    value = quoted(name).cast(kind)
    if kind in ("double", "float"):
        value = F.when(value == 0, F.lit(0.0).cast(kind)).otherwise(value)
    return value


def _bucket(df: DataFrame, name: str) -> Column:
    value = _typed(df, name)
    return F.when(value.isNotNull(), F.pmod(F.xxhash64(value), F.lit(BUCKETS)).cast("int"))


def summaries(df: DataFrame, columns: list[str]) -> dict[str, Summary]:
    """One scan and one shuffle for all columns; comes back: up to ``DOUBTFUL`` buckets each."""
    names = [c for c in columns if value_kind(df.schema[c].dataType) is not None]
    if not names:
        return {}
    buckets = (
        nan_to_null(df)
        .select(*[_bucket(df, c).alias(c) for c in names])
        .unpivot([], [quoted(c) for c in names], "column", "bucket")
        .where(F.col("bucket").isNotNull())
        .groupBy("column", "bucket")
        .agg(F.count(F.lit(1)).alias("rows"))
    )
    of_column = Window.partitionBy("column")  # at most BUCKETS rows each
    found = (
        buckets.select(
            "*",
            F.row_number().over(of_column.orderBy(F.desc("rows"), "bucket")).alias("place"),
            F.sum("rows").over(of_column).alias("total"),
            F.count(F.lit(1)).over(of_column).alias("buckets"),
        )
        .where(F.col("place") <= DOUBTFUL)
        .toArrow()
        .to_pylist()
    )
    by_column: dict[str, list[dict]] = {}
    for row in sorted(found, key=lambda r: r["place"]):
        by_column.setdefault(row["column"], []).append(row)
    return {
        name: Summary(
            [(r["rows"], r["bucket"]) for r in rows],
            rows[0]["total"],
            rows[0]["buckets"] == len(rows),
        )
        for name, rows in by_column.items()
    }


def _only(df: DataFrame, name: str, opened: set[int] | None, value: Column) -> Column:
    """``value`` in the opened buckets, else NULL."""
    if opened is None:
        return value
    return F.when(_bucket(df, name).isin(*sorted(opened)), value)


def heavy(
    df: DataFrame,
    columns: list[str],
    top_n: int,
    count: Callable[[DataFrame, dict[str, Column]], DataFrame],
    rank: Callable[[DataFrame], DataFrame],
    key: Callable[[Column], Column] = lambda value: value,
) -> tuple[DataFrame, DataFrame]:
    """(the top values, the non-null rows per column).

    ``count`` counts values by column, ``rank`` cuts counts to the top values and pins them, and
    ``key`` is what a value is counted by.  Null and NaN are no values; a column without values
    has no rows.
    """
    if top_n < 1:
        raise ValueError(f"top_n must be positive, not {top_n}")
    known = summaries(df, columns)
    opened = {name: known[name].first(top_n) for name in known}
    top = rank(count(df, {n: _only(df, n, opened[n], key(quoted(n))) for n in known}))
    wider = {}
    for name, least in _least(top, top_n, list(known)).items():
        needed = known[name].opened_for(least)
        if opened[name] is not None and (needed is None or needed - opened[name]):
            wider[name] = needed
    if wider:
        again = rank(count(df, {n: _only(df, n, wider[n], key(quoted(n))) for n in wider}))
        top = top.where(~F.col("column").isin(*wider)).unionByName(again)
    totals = [(name, summary.rows) for name, summary in known.items()]
    spark = df.sparkSession
    return top, (
        local_frame(spark, totals, TOTALS_SCHEMA) if totals else empty_frame(spark, TOTALS_SCHEMA)
    )


def _least(top: DataFrame, top_n: int, names: list[str]) -> dict[str, int]:
    """How many rows a value needs at least to be among the top; 1 while they are too few."""
    found = top.where(F.col("rank") == top_n).select("column", "count").collect()
    return {**dict.fromkeys(names, 1), **{r["column"]: r["count"] for r in found}}
