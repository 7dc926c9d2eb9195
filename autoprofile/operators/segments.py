"""Measures rolled up by the values of dimension columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from autoprofile.config import AnalysisRules
from autoprofile.functions.coerce import family, nan_to_null, quoted
from autoprofile.functions.keys import text_key
from autoprofile.operators.digests import first_by_text
from autoprofile.operators.sums import exact_sums, summable_columns
from autoprofile.operators.wide import empty_frame

GRID_SCHEMA = (
    "dimension_no int, measure_no int, dimension string, measure string, rank int, "
    "segment string, total double, avg double, count long"
)


def segment_grid(
    df: DataFrame,
    dimensions: list[str],
    measures: list[str],
    top_n: int = 15,
    null_label: str = "nan",
    digits: int = 4,
) -> DataFrame:
    """Sum, mean and count of every measure for the top segments of every dimension.

    All dimensions are rolled up in one grouped aggregation.  Sums are formed before the
    shuffle, so a segment that holds a third of the table is not a hot key; the rank filter
    then keeps ``top_n`` rows per task and combination before ranking them together.
    """
    if not dimensions or not measures:
        return empty_frame(df.sparkSession, GRID_SCHEMA)
    clean = nan_to_null(df)
    long_labels = _text_dimensions(clean, dimensions)
    values = summable_columns(clean, measures)
    labels = [f"d{i}" for i in range(len(dimensions))]
    inputs = [f"m{i}" for i in range(len(measures))]
    narrow = clean.select(
        *[
            F.coalesce(_label(d, d in long_labels), F.lit(null_label)).alias(label)
            for d, label in zip(dimensions, labels)
        ],
        *[values[m].alias(name) for m, name in zip(measures, inputs)],
    )
    rolled = exact_sums(
        narrow.unpivot(inputs, labels, "label", "segment"), ["label", "segment"], inputs
    )
    cells = F.array(
        *[
            F.struct(
                F.lit(i).alias("measure_no"),
                F.lit(name).alias("measure"),
                F.round(F.coalesce(f"{m}_total", F.lit(0.0)), digits).alias("total"),
                F.round(
                    F.try_divide(F.col(f"{m}_total"), F.col(f"{m}_count")), digits
                ).alias("avg"),
                F.col(f"{m}_count").alias("count"),
            )
            for i, (m, name) in enumerate(zip(inputs, measures))
        ]
    )
    number = F.substring("label", 2, 10).cast("int")
    names = F.array(*[F.lit(d) for d in dimensions])
    grid = rolled.select(number.alias("dimension_no"), "segment", F.inline(cells)).withColumn(
        "dimension", names[F.col("dimension_no")]
    )
    groups = ["dimension_no", "measure_no"]
    if long_labels:
        # texts are rolled up by digest; ties go by the texts themselves
        grid = first_by_text(
            clean, grid, groups, ["total"], long_labels, "dimension", "segment", top_n
        )
    else:
        order = Window.partitionBy(*groups).orderBy(F.desc("total"), "segment")
        grid = grid.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_n)
    return grid.select(
        "dimension_no", "measure_no", "dimension", "measure", "rank", "segment", "total",
        "avg", "count",
    )


def _text_dimensions(df: DataFrame, dimensions: list[str]) -> list[str]:
    return [d for d in dimensions if family(df.schema[d].dataType) == "string"]


def _label(dimension: str, is_text: bool) -> Column:
    return text_key(quoted(dimension)) if is_text else quoted(dimension).cast("string")


def segment_rollup(
    df: DataFrame,
    dimension: str,
    measure: str,
    top_n: int = 15,
    null_label: str = "nan",
    digits: int = 4,
) -> DataFrame:
    """Top segments of one dimension by the total of one measure."""
    grid = segment_grid(df, [dimension], [measure], top_n, null_label, digits)
    return grid.select("segment", "total", "avg", "count")


def first_grid(
    df: DataFrame, dimensions: list[str], measures: list[str], rules: AnalysisRules
) -> DataFrame:
    """The grid over the first dimensions and measures the rules allow."""
    return segment_grid(
        df,
        dimensions[: rules.segment_dimensions],
        measures[: rules.segment_measures],
        rules.top_n,
        rules.null_label,
    )


def segment_bars(grid: DataFrame, results: int = 4, shown: int = 15) -> DataFrame:
    """Bars of the first ``results`` dimension and measure combinations."""
    order = Window.orderBy("dimension_no", "measure_no")  # a grid has few rows
    return (
        grid.withColumn("result_no", F.dense_rank().over(order))
        .where((F.col("result_no") <= results) & (F.col("rank") <= shown))
        .select("result_no", "dimension", "measure", "rank", "segment", "total", "avg")
    )
