"""Value frequencies: top values, shares, label variants, dimension values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from autoprofile.functions.coerce import family, nan_to_null, quoted, strip, value_kind
from autoprofile.functions.keys import text_key
from autoprofile.functions.numeric import percent
from autoprofile.operators.digests import first_by_text
from autoprofile.operators.heavy import heavy
from autoprofile.operators.wide import empty_frame, local_frame, pin

COUNTS_SCHEMA = "column string, value string, count long"
DIMENSION_VALUES = 50
BAR_CATEGORIES = 15


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value as text, count) over the non-null values of ``columns``.

    One shuffle for all columns of a kind; numbers become text only after it.  Repeated values
    are counted before it, so a value that fills a third of the table costs one row per task.
    Meant for columns of labels, which travel whole; :func:`frequent_values` is for columns of
    very many values, :func:`top_texts` for long texts.
    """
    return _counts(df, {c: quoted(c) for c in columns})


def _counts(df: DataFrame, values: dict[str, Column]) -> DataFrame:
    clean = nan_to_null(df)
    groups: dict[str, list[str]] = {}
    for name in values:
        kind = value_kind(df.schema[name].dataType)
        if kind is not None:
            groups.setdefault(kind, []).append(name)
    if not groups:
        return empty_frame(df.sparkSession, COUNTS_SCHEMA)
    return reduce(
        DataFrame.unionByName,
        [
            clean.select(*[values[c].cast(kind).alias(c) for c in members])
            .unpivot([], [quoted(c) for c in members], "column", "value")
            .where(F.col("value").isNotNull())
            .groupBy("column", "value")
            .agg(F.count(F.lit(1)).alias("count"))
            .select("column", F.col("value").cast("string").alias("value"), "count")
            for kind, members in groups.items()
        ],
    )


def top_of(counts: DataFrame, top_n: int) -> DataFrame:
    """The ``top_n`` most frequent values of every column, ties by value.

    The rank filter becomes a per-task limit before the shuffle, so a column of a billion
    categories sends ``top_n`` rows per task.
    """
    order = Window.partitionBy("column").orderBy(F.desc("count"), "value")
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_n)


def top_values(df: DataFrame, columns: list[str], top_n: int = 15) -> DataFrame:
    """Most frequent values with their share of the column's non-null rows, in percent."""
    return with_share(value_counts(df, columns), top_n)


def with_share(counts: DataFrame, top_n: int = 15) -> DataFrame:
    return _shared(top_of(counts, top_n), counts)


def _shared(top: DataFrame, counts: DataFrame) -> DataFrame:
    return _shared_in(
        top, counts.groupBy("column").agg(F.sum("count").alias("non_null_count"))
    )


def _shared_in(top: DataFrame, totals: DataFrame) -> DataFrame:
    return (
        top.join(F.broadcast(totals), "column")  # one row per column
        .select(
            "column",
            "rank",
            "value",
            "count",
            percent(F.col("count"), F.col("non_null_count")).alias("pct"),
        )
    )


def frequent_values(df: DataFrame, columns: list[str], top_n: int = 15) -> DataFrame:
    """:func:`top_values` for columns of very many distinct values, which never move: only the
    values of the fullest buckets are counted, and no other value can be among the top
    (:mod:`autoprofile.operators.heavy`)."""

    def rank(counts: DataFrame) -> DataFrame:
        return pin(top_of(counts, top_n))  # top_n rows per column

    return _shared_in(*heavy(df, columns, top_n, _counts, rank))


def top_texts(df: DataFrame, columns: list[str], top_n: int = 15) -> DataFrame:
    """:func:`frequent_values` for columns of long texts.

    Texts are counted by digest, so that whole texts are not shuffled; only the few that are
    among the most frequent are looked up again.  Ties go by text.
    """

    def rank(counts: DataFrame) -> DataFrame:
        return pin(first_by_text(
            df, counts, ["column"], ["count"], columns, "column", "value", top_n
        ))

    return _shared_in(*heavy(df, columns, top_n, _counts, rank, text_key))


def top_value(top: DataFrame, columns: list[str]) -> DataFrame:
    """The most frequent value per column; NULL and 0 for a column without values."""
    names = local_frame(top.sparkSession, [(c,) for c in columns], "column string")
    first = top.where(F.col("rank") == 1)
    return names.join(first, "column", "left").select(
        "column",
        F.col("value").alias("top_value"),
        F.coalesce("pct", F.lit(0.0)).alias("top_value_pct"),
    )


def category_share(top: DataFrame, shown: int = BAR_CATEGORIES) -> DataFrame:
    """Share of each shown category in the sum of the shown ones, in percent."""
    whole = Window.partitionBy("column")  # at most ``shown`` rows each
    return (
        top.where(F.col("rank") <= shown)
        .withColumn("shown_total", F.sum("count").over(whole))
        .select(
            "column",
            "rank",
            "value",
            "count",
            percent(F.col("count"), F.col("shown_total")).alias("shown_pct"),
        )
    )


def normalized_label(value: Column) -> Column:
    return F.lower(strip(value))


def variants_of(counts: DataFrame) -> DataFrame:
    """Labels per column that differ from another one only in case or edge white space."""
    return (
        counts.groupBy("column", normalized_label(F.col("value")).alias("label"))
        .agg(F.count(F.lit(1)).alias("spellings"))
        .groupBy("column")
        .agg(
            F.sum("spellings").alias("raw_labels"),
            F.count(F.lit(1)).alias("distinct_labels"),
            (F.sum("spellings") - F.count(F.lit(1))).alias("variants"),
        )
    )


def label_variants(df: DataFrame, columns: list[str]) -> DataFrame:
    return variants_of(value_counts(df, _text_columns(df, columns)))


def _text_columns(df: DataFrame, columns: list[str]) -> list[str]:
    return [c for c in columns if family(df.schema[c].dataType) == "string"]


def dimension_values_of(counts: DataFrame, limit: int = DIMENSION_VALUES) -> DataFrame:
    """The ``limit`` smallest distinct values of every column as one sorted array."""
    order = Window.partitionBy("column").orderBy("value")
    return (
        counts.withColumn("place", F.row_number().over(order))
        .where(F.col("place") <= limit)
        .groupBy("column")
        .agg(F.array_sort(F.collect_list("value")).alias("values"))
    )


def dimension_values(
    df: DataFrame, columns: list[str], limit: int = DIMENSION_VALUES
) -> DataFrame:
    return dimension_values_of(value_counts(df, columns), limit)
