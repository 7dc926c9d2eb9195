"""Measures over calendar periods and their linear trend."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from autoprofile.operators.dates import date_columns
from autoprofile.operators.sums import exact_sums, summable_columns
from autoprofile.operators.wide import empty_frame

SERIES_SCHEMA = (
    "time_column string, measure_no int, measure string, period string, value double"
)
MIN_TREND_PERIODS = 3

# How a period of each granularity is written.
PERIOD_FORMATS = {
    "day": "yyyy-MM-dd",
    "month": "yyyy-MM",
    "quarter": "yyyy'Q'Q",
    "year": "yyyy",
}


def period_label(start: Column, granularity: str) -> Column:
    return F.date_format(start, PERIOD_FORMATS[granularity])


def _one_series(
    df: DataFrame,
    time_column: str,
    moment: Column,
    measures: list[str],
    min_points: int,
    granularity: str,
) -> DataFrame:
    values = summable_columns(df, measures)
    inputs = [f"m{i}" for i in range(len(measures))]
    dated = df.select(
        F.date_trunc(granularity, moment).alias("start"),
        *[values[m].alias(name) for m, name in zip(measures, inputs)],
    ).where(F.col("start").isNotNull())
    totals = exact_sums(dated, ["start"], inputs).select(
        "start",
        F.col("rows").alias("points"),
        *[F.coalesce(f"{name}_total", F.lit(0.0)).alias(name) for name in inputs],
    )
    # from here on there is one row per calendar period, so one task may see them all
    every_period = Window.partitionBy(F.lit(1))
    enough = totals.withColumn("all_points", F.sum("points").over(every_period)).where(
        F.col("all_points") >= min_points
    )
    cells = F.array(
        *[
            F.struct(
                F.lit(i).alias("measure_no"),
                F.lit(m).alias("measure"),
                F.col(name).alias("value"),
            )
            for i, (m, name) in enumerate(zip(measures, inputs))
        ]
    )
    return enough.select("start", F.inline(cells)).select(
        F.lit(time_column).alias("time_column"),
        "measure_no",
        "measure",
        period_label(F.col("start"), granularity).alias("period"),
        "value",
    )


def period_series(
    df: DataFrame,
    time_columns: list[str],
    measures: list[str],
    min_points: int = 10,
    granularity: str = "month",
) -> DataFrame:
    """Sum of every measure per period that occurs; periods without rows are left out.

    A time column with fewer than ``min_points`` dated rows has no series.  The sums are taken
    before the shuffle, which carries one row per task and period.
    """
    if granularity not in PERIOD_FORMATS:
        raise ValueError(f"granularity must be one of {sorted(PERIOD_FORMATS)}")
    if not time_columns or not measures:
        return empty_frame(df.sparkSession, SERIES_SCHEMA)
    return reduce(
        DataFrame.unionByName,
        [
            _one_series(df, t, moment, measures, min_points, granularity)
            for t, moment in date_columns(df, time_columns).items()
        ],
    )


def monthly_series(
    df: DataFrame,
    time_columns: list[str],
    measures: list[str],
    min_points: int = 10,
    granularity: str = "month",
    digits: int = 4,
) -> DataFrame:
    return period_series(df, time_columns, measures, min_points, granularity).select(
        "time_column", "measure", "period", F.round("value", digits).alias("value")
    )


def trends_of(series: DataFrame, digits: int = 4) -> DataFrame:
    """Least-squares slope over the period's position, and how well the line fits.

    Fewer than three periods count as stable; a flat series explains nothing (r squared 0).
    """
    place = Window.partitionBy("time_column", "measure_no").orderBy("period")
    placed = series.withColumn("x", (F.row_number().over(place) - 1).cast("double"))
    enough = F.col("periods") >= MIN_TREND_PERIODS
    flat = F.col("spread") == 0
    slope = F.when(enough, F.col("fit_slope")).otherwise(0.0)
    r_squared = F.when(enough & ~flat, F.col("fit_r2")).otherwise(0.0)
    return (
        placed.groupBy("time_column", "measure_no", "measure")
        .agg(
            F.count(F.lit(1)).alias("periods"),
            F.regr_slope("value", "x").alias("fit_slope"),
            F.regr_r2("value", "x").alias("fit_r2"),
            F.var_pop("value").alias("spread"),
        )
        .select(
            "time_column",
            "measure_no",
            "measure",
            "periods",
            F.when(~enough, "stable")
            .when(slope > 0, "upward")
            .otherwise("downward")
            .alias("trend_direction"),
            F.round(slope, digits).alias("slope"),
            F.round(r_squared, digits).alias("r_squared"),
        )
    )


def monthly_trend(
    df: DataFrame,
    time_columns: list[str],
    measures: list[str],
    min_points: int = 10,
    granularity: str = "month",
    digits: int = 4,
) -> DataFrame:
    series = period_series(df, time_columns, measures, min_points, granularity)
    return trends_of(series, digits).drop("measure_no")


def trend_fit(trends: DataFrame) -> DataFrame:
    """In words, how well each trend line fits."""
    r2 = F.col("r_squared")
    return trends.withColumn(
        "fit", F.when(r2 > 0.7, "Strong").when(r2 > 0.4, "Moderate").otherwise("Weak")
    )
