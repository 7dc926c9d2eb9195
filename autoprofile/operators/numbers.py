"""Distribution of numeric columns: moments, quartiles, outliers, box statistics."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from math import sqrt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from autoprofile.config import Config
from autoprofile.functions.coerce import number_columns, quoted
from autoprofile.operators.quantiles import CHUNK, exact_quantiles
from autoprofile.operators.sums import (
    exact_totals,
    limb_sums,
    totals_of,
    unbounded_kind,
    usual_share,
    window_of,
)
from autoprofile.operators.wide import chunked, local_frame, per_column

MIN_OUTLIER_VALUES = 4
MIN_BOX_VALUES = 10


@dataclass(frozen=True)
class Distribution:
    """All figures of one column, unrounded.  ``None`` where a figure is undefined."""

    column: str
    count: int
    sum: float | None
    mean: float | None
    std: float | None
    min: float | None
    max: float | None
    skewness: float | None
    kurtosis: float | None
    q1: float | None
    median: float | None
    q3: float | None

    @property
    def population_std(self) -> float | None:
        if not self.count:
            return None
        if self.count == 1:
            return 0.0
        return self.std * sqrt((self.count - 1) / self.count)

    def fences(self, factor: float) -> tuple[float, float] | None:
        if self.count < MIN_OUTLIER_VALUES:
            return None
        spread = self.q3 - self.q1
        return self.q1 - factor * spread, self.q3 + factor * spread


MOMENT_NAMES = ("count", "sum", "std", "min", "max", "skewness", "kurtosis")


def moments(df: DataFrame, columns: list[str]) -> DataFrame:
    """Count, sum, extremes and the first four moments per column, in one scan.

    Skewness and kurtosis are the population figures, kurtosis as excess over the normal.
    ``sum`` is that of the values in the usual range, whatever their order; ``beyond`` counts
    the others, which :func:`distributions` sums in a scan of their own.  Columns are turned into
    rows first, so a wide table needs no wide aggregation; what is shuffled is one row per task
    and column.
    """
    parts = []
    total = F.when(F.col("count") > 0, F.get(totals_of("parts", "kinds", "0", "0"), F.lit(0)))
    for names in chunked(list(columns), CHUNK):
        values = number_columns(df, names)
        slots = [str(i) for i in range(len(names))]
        labels = F.array(*[F.lit(n) for n in names])
        parts.append(
            df.select(*[values[n].alias(s) for n, s in zip(names, slots)])
            .unpivot([], [quoted(s) for s in slots], "slot", "value")
            .select(
                F.col("slot").cast("int").alias("slot"),
                "value",
                (window_of("value") != 0).alias("far"),
                usual_share("value").alias("share"),
                unbounded_kind("value").alias("kind"),
            )
            .groupBy("slot")
            .agg(
                F.count("value").alias("count"),
                F.array(
                    F.struct(F.lit(0).alias("window"), F.array(limb_sums("share")).alias("limbs"))
                ).alias("parts"),
                F.array(F.bit_or("kind")).alias("kinds"),
                F.count_if("far").alias("beyond"),
                F.stddev_samp("value").alias("std"),
                F.min("value").alias("min"),
                F.max("value").alias("max"),
                F.skewness("value").alias("skewness"),
                F.kurtosis("value").alias("kurtosis"),
            )
            .withColumn("sum", total)
            .select(F.get(labels, F.col("slot")).alias("column"), *MOMENT_NAMES, "beyond")
        )
    return reduce(DataFrame.unionByName, parts)


def distributions(df: DataFrame, columns: list[str]) -> list[Distribution]:
    """Moments and exact quartiles; a handful of small jobs, one result per column."""
    if not columns:
        return []
    # a table without rows has no row per column
    nothing = {**dict.fromkeys(MOMENT_NAMES), "count": 0}
    found = {r["column"]: r.asDict() for r in moments(df, columns).collect()}
    beyond = [c for c, row in found.items() if row.pop("beyond")]
    if beyond:
        for total in exact_totals(df, number_columns(df, beyond)).collect():
            found[total["column"]]["sum"] = total["total"]
    rows = {c: found.get(c) or {"column": c, **nothing} for c in columns}
    quartiles = exact_quantiles(
        df,
        number_columns(df, columns),
        {c: (rows[c]["count"], rows[c]["min"], rows[c]["max"]) for c in columns},
        (0.25, 0.5, 0.75),
    )
    results = []
    for name in columns:
        row = rows[name]
        q1, median, q3 = quartiles[name]
        mean = row["sum"] / row["count"] if row["count"] else None
        results.append(Distribution(mean=mean, q1=q1, median=median, q3=q3, **row))
    return results


SUMMARY_SCHEMA = (
    "column string, count long, mean double, median double, std double, min double, "
    "max double, q1 double, q3 double, sum double, skewness double"
)
MOMENTS_SCHEMA = (
    "column string, mean double, median double, std double, min double, max double, "
    "q1 double, q3 double, skewness double, kurtosis double"
)


OUTLIER_SCHEMA = (
    "column string, iqr_outlier_count long, zscore_outlier_count long, iqr_lower double, "
    "iqr_upper double, whisker_low double, whisker_high double"
)


def _frame(
    spark: SparkSession, found: list[Distribution], schema: str, digits: int
) -> DataFrame:
    names = [part.split()[0] for part in schema.split(", ")]
    rows = [tuple(getattr(d, n) for n in names) for d in found]
    frame = local_frame(spark, rows, schema)
    return frame.select(
        *[
            F.round(n, digits).alias(n) if kind == "double" else F.col(n)
            for n, kind in frame.dtypes
        ]
    )


def summary_frame(spark: SparkSession, found: list[Distribution], digits: int = 4) -> DataFrame:
    return _frame(spark, [d for d in found if d.count], SUMMARY_SCHEMA, digits)


def moments_frame(spark: SparkSession, found: list[Distribution], digits: int = 4) -> DataFrame:
    return _frame(spark, [d for d in found if d.count], MOMENTS_SCHEMA, digits)


def numeric_summary(df: DataFrame, columns: list[str], digits: int = 4) -> DataFrame:
    """count, mean, median, std, min, max, quartiles, sum and skewness of each column.

    A column without any number has no row.
    """
    return summary_frame(df.sparkSession, distributions(df, columns), digits)


def distribution_moments(df: DataFrame, columns: list[str], digits: int = 4) -> DataFrame:
    """Mean, median, spread, extremes, quartiles, skewness and excess kurtosis."""
    return moments_frame(df.sparkSession, distributions(df, columns), digits)


# ------------------------------------------------------------------ outliers


def _beyond(value: Column, fences: tuple[float, float] | None) -> Column:
    if fences is None:
        return F.lit(False)
    return (value < F.lit(fences[0])) | (value > F.lit(fences[1]))


def outlier_counts(
    df: DataFrame, found: list[Distribution], factor: float = 1.5, zscore: float = 3.0
) -> DataFrame:
    """Second scan: values beyond the quartile fences and beyond ``zscore`` deviations.

    Also the whiskers, the most extreme values inside the fences.  Columns with fewer than
    four values have no fences and no outliers.
    """
    facts = []
    values = number_columns(df, [d.column for d in found])
    for d in found:
        value, fences, deviation = values[d.column], d.fences(factor), d.population_std
        outside = _beyond(value, fences)
        far = F.lit(False)
        if fences is not None and deviation:
            far = F.abs((value - F.lit(d.mean)) / F.lit(deviation)) > zscore
        low, high = fences or (None, None)
        facts.append([
            F.lit(d.column).alias("column"),
            F.count_if(outside).alias("iqr_outlier_count"),
            F.count_if(far).alias("zscore_outlier_count"),
            F.lit(low).cast("double").alias("iqr_lower"),
            F.lit(high).cast("double").alias("iqr_upper"),
            F.min(F.when(~outside, value)).alias("whisker_low"),
            F.max(F.when(~outside, value)).alias("whisker_high"),
        ])
    return per_column(df, facts, fields_per_column=6, schema=OUTLIER_SCHEMA)


def detect_outliers(
    df: DataFrame, columns: list[str], config: Config | None = None, digits: int = 4
) -> DataFrame:
    """Outlier counts by quartile fences and by z-score, with the fences."""
    rules = (config or Config()).quality
    counts = outlier_counts(df, distributions(df, columns), rules.iqr_factor, rules.zscore_limit)
    return counts.select(
        "column",
        "iqr_outlier_count",
        "zscore_outlier_count",
        F.round("iqr_lower", digits).alias("iqr_lower"),
        F.round("iqr_upper", digits).alias("iqr_upper"),
    )


def box_frame(
    df: DataFrame, found: list[Distribution], counts: DataFrame, digits: int = 4
) -> DataFrame:
    """Box-plot figures of the columns that have at least ten values."""
    summary = summary_frame(df.sparkSession, found, digits).where(
        F.col("count") >= MIN_BOX_VALUES
    )
    return summary.join(F.broadcast(counts), "column").select(
        "column", "q1", "median", "q3", "mean",
        F.round("whisker_low", digits).alias("whisker_low"),
        F.round("whisker_high", digits).alias("whisker_high"),
        F.col("iqr_outlier_count").alias("outliers"),
    )


def box_stats(df: DataFrame, columns: list[str], digits: int = 4) -> DataFrame:
    found = distributions(df, columns)
    return box_frame(df, found, outlier_counts(df, found), digits)
