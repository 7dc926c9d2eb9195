"""The whole analysis of one table in one call."""

from __future__ import annotations

import datetime as dt
import time
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from autoprofile.config import Config
from autoprofile.functions.coerce import nan_to_null
from autoprofile.operators import charts, insights
from autoprofile.operators.catalog import analysis_columns, column_catalog, type_distribution
from autoprofile.operators.correlation import mirrored, strong_of, upper_triangle
from autoprofile.operators.dates import with_timestamps
from autoprofile.operators.frequencies import (
    category_share,
    dimension_values_of,
    top_texts,
    top_value,
    value_counts,
    with_share,
)
from autoprofile.operators.numbers import (
    box_frame,
    distributions,
    outlier_counts,
    summary_frame,
)
from autoprofile.operators.quality import (
    column_quality_of,
    issues_of,
    judge_columns,
    quality_overview,
)
from autoprofile.operators.segments import first_grid, segment_bars
from autoprofile.operators.semantic import (
    evaluate_kpis,
    kpi_catalog,
    lineage,
    role_name,
    semantic_fields,
    semantic_summary,
)
from autoprofile.operators.series import period_series, trend_fit, trends_of
from autoprofile.operators.tables import dataset_summary, datetime_summary
from autoprofile.operators.wide import empty_frame, local_frame, pin
from autoprofile.sources.readers import LoadedTable, is_row_format, load
from autoprofile.sources.sinks import stage


#: labels up to this many are kept on the driver while the sections read them
LOCAL_LABELS = 100_000


@dataclass(frozen=True)
class Results:
    """Every section of an analysis as a DataFrame."""

    metadata: DataFrame
    column_catalog: DataFrame
    type_distribution: DataFrame
    column_quality: DataFrame
    issues: DataFrame
    quality_overview: DataFrame
    semantic_fields: DataFrame
    lineage: DataFrame
    kpis: DataFrame
    kpi_values: DataFrame
    semantic_summary: DataFrame
    dataset_summary: DataFrame
    numeric_summary: DataFrame
    top_values: DataFrame
    datetime_summary: DataFrame
    correlations: DataFrame
    strong_correlations: DataFrame
    series: DataFrame
    trends: DataFrame
    segments: DataFrame
    insights: DataFrame
    confidence: DataFrame
    chart_plan: DataFrame
    null_ranking: DataFrame
    histograms: DataFrame
    histogram_notes: DataFrame
    box_stats: DataFrame
    category_bars: DataFrame
    segment_bars: DataFrame
    scatter_points: DataFrame
    scatter_fits: DataFrame
    kpi_card: DataFrame

    def sections(self) -> dict[str, DataFrame]:
        return {f.name: getattr(self, f.name) for f in fields(self)}


def analyze(
    df: DataFrame,
    config: Config | None = None,
    name: str = "table",
    as_of: dt.datetime | None = None,
    rows_raw: int | None = None,
) -> Results:
    """Profile, check and analyse a table.

    The catalog is computed first because it decides which column plays which role.  After that
    every section is its own aggregation over just the columns it needs, and the sections are
    submitted side by side.  What is kept between them is one row per column, segment, period
    or top value, never table rows.
    """
    cfg = config or Config()
    spark, started = df.sparkSession, time.time()
    df = nan_to_null(df)

    catalog = pin(column_catalog(df, cfg))
    typed = analysis_columns(catalog)
    measures = [c for c, t in typed if t == "numeric"]
    times = [c for c, t in typed if t == "datetime"]
    dimensions = [c for c, t in typed if role_name(t) == "dimension"]
    valued = [c for c, t in typed if t in ("categorical", "boolean")]

    dated = with_timestamps(df, times)  # the layout of text dates is found once
    with ThreadPoolExecutor(max_workers=6) as sections:
        counts_job = sections.submit(_label_counts, df, catalog, valued)
        numbers_job = sections.submit(
            _numbers_and_quality, df, catalog, typed, measures, cfg, as_of, counts_job
        )
        labels_job = sections.submit(_labels, counts_job, catalog, cfg)
        summary_job = sections.submit(
            lambda: pin(dataset_summary(df, catalog, cfg.schema.distinct == "exact"))
        )
        triangle_job = sections.submit(_correlations, df, measures, cfg)
        series_job = sections.submit(_series_and_trends, dated, times, measures, cfg)
        texts = [c for c in dimensions[: cfg.charts.bar_charts] if c not in valued]
        texts_job = sections.submit(lambda: pin(top_texts(df, texts, cfg.charts.bar_categories)))
        grid_job = sections.submit(
            lambda: pin(first_grid(df, dimensions, measures, cfg.analysis))
        )
        found, outliers, judged = numbers_job.result()
        top, semantic, kpis = labels_job.result()
        summary, triangle = summary_job.result(), triangle_job.result()
        text_bars = texts_job.result()
        (series, trends), grid = series_job.result(), grid_job.result()

    issues = issues_of(judged)
    overview = quality_overview(catalog.select("total_rows", "null_count"), issues)
    numbers = summary_frame(spark, found)
    top_shown = top.where(F.col("rank") <= cfg.analysis.top_n)
    strong = strong_of(triangle, cfg.analysis.strong_correlation)
    positions = pin(judged.select("position", "column", "null_pct"))
    ranked = _ranked_insights(
        cfg, summary, positions, numbers, triangle, trends, times, grid,
        top_value(top, valued),
    )
    total = catalog.agg(F.max("total_rows")).first()[0] or 0
    strong_pairs = [(r["col1"], r["col2"]) for r in strong.collect()]

    return Results(
        metadata=_metadata(spark, name, total if rows_raw is None else rows_raw, total, started),
        column_catalog=catalog,
        type_distribution=type_distribution(catalog),
        column_quality=column_quality_of(judged),
        issues=issues,
        quality_overview=overview,
        semantic_fields=semantic,
        lineage=lineage(semantic),
        kpis=kpis,
        kpi_values=evaluate_kpis(df, kpis, sums={d.column: (d.sum, d.count) for d in found}),
        semantic_summary=semantic_summary(semantic, kpis),
        dataset_summary=summary,
        numeric_summary=numbers,
        top_values=top_shown,
        datetime_summary=datetime_summary(dated, times),
        correlations=mirrored(triangle).orderBy("i", "j").drop("i", "j"),
        strong_correlations=strong,
        series=series.drop("measure_no").withColumn("value", F.round("value", 4)),
        trends=trend_fit(trends).drop("measure_no"),
        segments=grid.drop("dimension_no", "measure_no"),
        insights=ranked,
        confidence=insights.confidence_score(positions, total),
        chart_plan=_chart_plan(
            cfg, catalog, found, dimensions, trends, times, measures, strong_pairs, grid
        ),
        null_ranking=charts.null_ranking(catalog),
        histograms=charts.histogram_of(df, found[: cfg.charts.histograms]),
        histogram_notes=charts.histogram_notes(df, found[: cfg.charts.histograms]),
        box_stats=box_frame(df, found[: cfg.charts.box_plots], outliers),
        category_bars=category_share(
            top.unionByName(text_bars).where(
                F.col("column").isin(*dimensions[: cfg.charts.bar_charts])
            ),
            cfg.charts.bar_categories,
        ),
        segment_bars=segment_bars(grid, cfg.charts.segment_bars),
        scatter_points=_scatter_points(df, strong_pairs, dimensions, cfg),
        scatter_fits=_scatter_fits(df, strong_pairs, dimensions, cfg),
        kpi_card=charts.kpi_card_of(spark, found, rules=cfg.charts),
    )


def analyze_path(
    spark: SparkSession,
    path: str,
    format: str | None = None,
    config: Config | None = None,
    as_of: dt.datetime | None = None,
    **options,
) -> Results:
    """Load a table and analyse it.  Tables from text or JSON are staged as Parquet first."""
    loaded: LoadedTable = load(spark, path, format, config=config, **options)
    df = stage(loaded.df) if is_row_format(path, format) else loaded.df
    return analyze(df, config, loaded.name, as_of, loaded.rows_raw)


def _numbers_and_quality(df, catalog, typed, measures, cfg: Config, as_of, counts_job):
    found = distributions(df, measures)
    outliers = pin(
        outlier_counts(df, found, cfg.quality.iqr_factor, cfg.quality.zscore_limit)
    )
    counts = counts_job.result()
    return found, outliers, judge_columns(
        df, typed, cfg, as_of, found, outliers, catalog, counts
    )


def _label_counts(df: DataFrame, catalog: DataFrame, valued: list[str]) -> DataFrame:
    """The frequencies of all labels, which several sections read.

    Counted once: kept on the driver where the catalog says they are few, else written to the
    folder the cluster shares; a session without one counts them for each section.
    """
    counts = value_counts(df, valued)
    labels = sum(
        r["unique_count"] for r in catalog.collect() if r["column_name"] in set(valued)
    )
    return pin(counts) if labels <= LOCAL_LABELS else stage(counts)


def _labels(counts_job, catalog: DataFrame, cfg: Config):
    counts = counts_job.result()
    top = pin(with_share(counts, max(cfg.analysis.top_n, cfg.charts.bar_categories)))
    known = pin(dimension_values_of(counts, cfg.semantic.dimension_values))
    semantic = pin(semantic_fields(catalog, cfg, known))
    return top, semantic, pin(kpi_catalog(semantic, cfg))


def _correlations(df: DataFrame, measures: list[str], cfg: Config) -> DataFrame:
    if len(measures) < cfg.analysis.min_correlation_columns:
        return upper_triangle(df, [])
    return upper_triangle(df, measures)


def _series_and_trends(df: DataFrame, times: list[str], measures: list[str], cfg: Config):
    rules = cfg.analysis
    series = pin(period_series(df, times, measures, rules.min_time_points, rules.granularity))
    return series, pin(trends_of(series))


def _metadata(
    spark: SparkSession, name: str, rows_raw: int, rows: int, started: float
) -> DataFrame:
    return local_frame(
        spark,
        [(name, rows_raw, rows, dt.datetime.now(dt.timezone.utc), round(time.time() - started, 2))],
        "name string, rows_raw long, rows long, run_at timestamp, elapsed_seconds double",
    )


def _ranked_insights(
    cfg: Config,
    summary: DataFrame,
    positions: DataFrame,
    numbers: DataFrame,
    triangle: DataFrame,
    trends: DataFrame,
    times: list[str],
    grid: DataFrame,
    tops: DataFrame,
) -> DataFrame:
    limit = cfg.analysis.strong_correlation
    r = F.col("correlation")
    strong = triangle.where((F.col("i") < F.col("j")) & (F.abs(r) >= limit)).select(
        "i", "j", "col1", "col2",
        F.round(r, 4).alias("correlation"),
        F.when(r >= limit, "strong positive").otherwise("strong negative").alias("strength"),
    )
    limits = cfg.insights
    rules = [
        insights.overview_insight(summary),
        insights.null_insight(positions, limits),
        insights.extreme_insights(positions, numbers, limits),
        insights.correlation_insights(strong, limits),
        insights.segment_insights(grid, limits),
        insights.dominant_insights(positions, tops, limits),
    ]
    if times:
        rules.append(insights.trend_insights(trends, times, limits))
    return pin(insights.ranked(rules, cfg.report.max_insights))


def _chart_plan(
    cfg, catalog, found, dimensions, trends, times, measures, strong_pairs, grid
) -> DataFrame:
    have_trend = {(r["time_column"], r["measure"]) for r in trends.collect()}
    drawn = {(r["dimension_no"], r["measure_no"], r["dimension"], r["measure"])
             for r in grid.where(F.col("rank") == 1).collect()}
    return charts.chart_plan(
        catalog,
        found,
        dimensions,
        [(t, m) for t in times for m in measures if (t, m) in have_trend],
        strong_pairs,
        [(d, m) for _, _, d, m in sorted(drawn)],
        cfg.charts,
    )


def _scatter_points(
    df: DataFrame, strong_pairs: list[tuple[str, str]], dimensions: list[str], cfg: Config
) -> DataFrame:
    color = dimensions[0] if dimensions else None
    points = empty_frame(
        df.sparkSession,
        "x double, y double, color string, x_column string, y_column string",
    )
    for x, y in strong_pairs[: cfg.charts.scatter_plots]:
        drawn = charts.scatter_sample(df, x, y, color, cfg.charts.max_scatter_points)
        points = points.unionByName(
            drawn.withColumn("x_column", F.lit(x)).withColumn("y_column", F.lit(y))
        )
    return points


def _scatter_fits(
    df: DataFrame, strong_pairs: list[tuple[str, str]], dimensions: list[str], cfg: Config
) -> DataFrame:
    color = dimensions[0] if dimensions else None
    parts = empty_frame(
        df.sparkSession,
        "x_column string, y_column string, color string, points long, slope double, "
        "intercept double",
    )
    for x, y in strong_pairs[: cfg.charts.scatter_plots]:
        fit = charts.scatter_fit(df, x, y, color)
        parts = parts.unionByName(
            fit.withColumn("x_column", F.lit(x)).withColumn("y_column", F.lit(y))
        )
    return parts
