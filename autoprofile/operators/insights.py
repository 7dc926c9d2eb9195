"""Prioritised findings about a table, and how far to trust them.

Every rule is a small DataFrame over results that are already reduced to a few rows per
column, segment or series; the rules are united, ranked and capped at the end.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from autoprofile import messages
from autoprofile.config import InsightRules

def _finding(
    rule_no: int, item_no: Column, priority: int, category: str, title: Column, detail: Column,
    confidence: float, subject: Column, value: Column,
) -> list[Column]:
    return [
        F.lit(rule_no).alias("rule_no"),
        item_no.cast("int").alias("item_no"),
        F.lit(priority).alias("priority"),
        F.lit(category).alias("category"),
        title.alias("title"),
        detail.alias("detail"),
        F.lit(confidence).alias("confidence"),
        subject.alias("subject"),
        value.cast("double").alias("value"),
    ]


def overview_insight(summary: DataFrame) -> DataFrame:
    c = F.col
    return summary.select(
        *_finding(
            1, F.lit(0), 1, "Dataset Overview",
            F.format_string(messages.OVERVIEW_TITLE, F.format_number("rows", 0), c("columns")),
            F.format_string(
                messages.OVERVIEW_DETAIL,
                c("complete_row_pct").cast("string"),
                F.format_number("duplicate_rows", 0),
            ),
            0.99, F.lit("dataset"), c("rows"),
        )
    )


def null_insight(columns: DataFrame, rules: InsightRules = InsightRules()) -> DataFrame:
    """One finding for all columns with many nulls.  ``columns``: position, column, null_pct."""
    named = F.format_string("'%s' (%.0f%%)", "column", "null_pct")
    high = columns.where(F.col("null_pct") > rules.high_null_pct).agg(
        F.count(F.lit(1)).alias("found"),
        F.array_sort(F.collect_list(F.struct("position", named.alias("text")))).alias("names"),
    )
    first = F.array_join(F.transform(F.slice("names", 1, rules.names), lambda n: n["text"]), ", ")
    return high.where(F.col("found") > 0).select(
        *_finding(
            2, F.lit(0), 2, "Data Quality",
            F.format_string(messages.NULLS_TITLE, F.col("found")),
            F.format_string(messages.NULLS_DETAIL, first),
            0.95, first, F.col("found"),
        )
    )


def extreme_insights(
    columns: DataFrame, numbers: DataFrame, rules: InsightRules = InsightRules()
) -> DataFrame:
    """``numbers``: rounded numeric summary (column, mean, max)."""
    mean, top = F.col("mean"), F.col("max")
    extreme = (mean != 0) & (top != 0) & (top > mean * rules.extreme_factor)
    return (
        columns.select("position", "column")
        .join(F.broadcast(numbers), "column")
        .where(extreme)
        .select(
            *_finding(
                3, F.col("position"), 4, "Distribution",
                F.format_string(
                    messages.EXTREME_TITLE, "column", F.format_number("max", 2),
                    F.format_number("mean", 2),
                ),
                F.format_string(messages.EXTREME_DETAIL, top / mean),
                0.85, F.col("column"), F.round(top / mean, 4),
            )
        )
    )


def correlation_insights(
    strong: DataFrame, rules: InsightRules = InsightRules()
) -> DataFrame:
    """``strong``: strong pairs with their matrix position (i, j)."""
    order = Window.orderBy("i", "j")  # pairs of columns, not table rows
    return (
        strong.withColumn("place", F.row_number().over(order))
        .where(F.col("place") <= rules.correlations)
        .select(
            *_finding(
                4, F.col("place"), 3, "Correlation",
                F.format_string(
                    messages.CORRELATION_TITLE, "strength", "col1", "col2",
                    F.col("correlation").cast("string"),
                ),
                F.lit(messages.CORRELATION_DETAIL),
                0.90, F.concat_ws(" ~ ", "col1", "col2"), F.col("correlation"),
            )
        )
    )


def trend_insights(
    trends: DataFrame, time_columns: list[str], rules: InsightRules = InsightRules()
) -> DataFrame:
    """The first measures of every time column, if a line explains most of the variance."""
    r2 = F.col("r_squared")
    position = F.array_position(F.array(*[F.lit(t) for t in time_columns]), F.col("time_column"))
    return trends.where(
        (F.col("measure_no") < rules.trends_per_time_column) & (r2 > rules.min_trend_r2)
    ).select(
        *_finding(
            5, position * rules.trends_per_time_column + F.col("measure_no"), 3, "Trend",
            F.format_string(messages.TREND_TITLE, "measure", "trend_direction", r2),
            F.format_string(messages.TREND_DETAIL, r2 * 100, "measure"),
            0.85, F.col("measure"), r2,
        )
    )


def segment_insights(grid: DataFrame, rules: InsightRules = InsightRules()) -> DataFrame:
    """Share of the top segment in the segments shown, first combinations."""
    shown = Window.partitionBy("dimension_no", "measure_no")  # at most top_n rows
    combinations = Window.orderBy("dimension_no", "measure_no")
    share = F.try_divide(F.col("total") * 100, F.col("shown_total"))
    return (
        grid.withColumn("shown_total", F.sum("total").over(shown))
        .where(F.col("rank") == 1)
        .withColumn("result_no", F.row_number().over(combinations))
        .where((F.col("result_no") <= rules.segment_results) & (F.col("shown_total") != 0))
        .withColumn("share", share)
        .select(
            *_finding(
                6, F.col("result_no"), 3, "Segmentation",
                F.format_string(messages.SEGMENT_TITLE, "segment", "measure", "dimension", "share"),
                F.format_string(messages.SEGMENT_DETAIL, "share", "measure"),
                0.88, F.concat_ws("/", "dimension", "measure", "segment"), F.round("share", 4),
            )
        )
    )


def dominant_insights(
    columns: DataFrame, tops: DataFrame, rules: InsightRules = InsightRules()
) -> DataFrame:
    """``tops``: column, top_value, top_value_pct of categorical and boolean columns."""
    return (
        columns.select("position", "column")
        .join(F.broadcast(tops), "column")
        .where(F.col("top_value_pct") > rules.dominant_pct)
        .select(
            *_finding(
                7, F.col("position"), 4, "Distribution",
                F.format_string(messages.DOMINANT_TITLE, "column", "top_value", "top_value_pct"),
                F.lit(messages.DOMINANT_DETAIL),
                0.80, F.col("column"), F.col("top_value_pct"),
            )
        )
    )


def ranked(rules: list[DataFrame], max_insights: int = 20) -> DataFrame:
    """Findings by priority, then in the order of the rules, capped."""
    order = Window.orderBy("priority", "rule_no", "item_no")
    return (
        reduce(DataFrame.unionByName, rules)
        .withColumn("seq", F.row_number().over(order))
        .where(F.col("seq") <= max_insights)
        .orderBy("seq")
        .select(
            "seq", "priority", "category", "title", "detail", "confidence", "subject", "value"
        )
    )


def confidence_score(columns: DataFrame, rows: Column | int) -> DataFrame:
    """Trust in the analysis: less for nulls and for small tables, between 0.5 and 1.

    ``columns`` has the null_pct of every analysed column.
    """
    rows = F.lit(rows) if isinstance(rows, int) else rows
    size_penalty = F.when(rows < 50, 0.2).when(rows < 200, 0.1).otherwise(0.0)
    average = F.coalesce(F.avg("null_pct"), F.lit(0.0))
    score = F.lit(1.0) - average / 100 * 0.3 - size_penalty
    return columns.agg(
        F.round(F.greatest(F.lit(0.5), F.least(F.lit(1.0), score)), 2).alias("confidence_score")
    )
