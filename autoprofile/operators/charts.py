"""Data behind the charts: the plan of charts and the rows each one draws."""

from __future__ import annotations

from dataclasses import dataclass
from math import isfinite, isqrt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from autoprofile import messages
from autoprofile.config import ChartRules
from autoprofile.functions.coerce import nan_to_null, number_columns, quoted, value_kind
from autoprofile.operators.numbers import Distribution, distributions
from autoprofile.operators.sums import exact_totals
from autoprofile.operators.wide import empty_frame, local_frame, per_column, pin

MIN_HISTOGRAM_VALUES = 5
MAX_BINS = 50
SAMPLE_SEED = 42
#: hex digits of the draw that the first cut looks at
DRAW_DIGITS = 12
HISTOGRAM_SCHEMA = "column string, bin int, bin_from double, bin_to double, count long"


def null_ranking(catalog: DataFrame) -> DataFrame:
    """Analysed columns with nulls, the emptiest first."""
    return (
        catalog.where(~F.col("ignore") & (F.col("null_pct") > 0))
        .orderBy(F.desc("null_pct"), "ordinal")
        .select(F.col("column_name").alias("column"), "null_pct")
    )


# ------------------------------------------------------------------ histograms


def bin_count(values: int) -> int:
    return min(MAX_BINS, isqrt(values) + 10)


@dataclass(frozen=True)
class Extent:
    """The finite numbers of a column, and how many are infinite."""

    column: str
    count: int
    min: float | None
    max: float | None
    not_finite: int


def extents(df: DataFrame, columns: list[str]) -> list[Extent]:
    """One scan; one row per column comes back."""
    facts = []
    for name, value in number_columns(df, columns).items():
        infinite = value.isin(float("inf"), float("-inf"))
        finite = F.when(~infinite, value)
        facts.append([
            F.lit(name).alias("column"),
            F.count(finite).alias("count"),
            F.min(finite).alias("min"),
            F.max(finite).alias("max"),
            F.count_if(infinite).alias("not_finite"),
        ])
    schema = "column string, count long, min double, max double, not_finite long"
    rows = per_column(df, facts, fields_per_column=4, schema=schema).collect()
    return [Extent(**r.asDict()) for r in rows]


def _extents_of(df: DataFrame, found: list[Distribution]) -> list[Extent]:
    """What the distributions know; only columns with an infinite number are looked at again."""
    odd = [d.column for d in found if d.count and not (isfinite(d.min) and isfinite(d.max))]
    looked = {e.column: e for e in extents(df, odd)} if odd else {}
    return [
        looked.get(d.column) or Extent(d.column, d.count, d.min, d.max, 0) for d in found
    ]


def histogram_of(df: DataFrame, found: list[Distribution], digits: int = 4) -> DataFrame:
    """Equal-width bins over the finite values of columns; empty bins included."""
    return _binned(df, _extents_of(df, found), digits)


def _binned(df: DataFrame, found: list[Extent], digits: int) -> DataFrame:
    """Only bin numbers are counted, at most fifty per column, so the shuffle stays tiny."""
    drawn = [d for d in found if d.count >= MIN_HISTOGRAM_VALUES]
    if not drawn:
        return empty_frame(df.sparkSession, HISTOGRAM_SCHEMA)
    values = number_columns(df, [d.column for d in drawn])
    placed = []
    for i, d in enumerate(drawn):
        bins, spread = bin_count(d.count), d.max - d.min
        inside = values[d.column].between(d.min, d.max)
        if spread > 0:
            share = (values[d.column] - F.lit(d.min)) / F.lit(spread)
            number = F.least(F.floor(share * bins).cast("int"), F.lit(bins - 1))
        else:
            number = F.lit(0)
        placed.append(F.when(inside, number).alias(f"b{i}"))
    labels = [f"b{i}" for i in range(len(drawn))]
    counted = (
        df.select(*placed)
        .unpivot([], labels, "label", "bin")
        .where(F.col("bin").isNotNull())
        .groupBy("label", "bin")
        .agg(F.count(F.lit(1)).alias("count"))
    )
    frame = local_frame(
        df.sparkSession,
        [(i, f"b{i}", d.column, d.min, d.max, bin_count(d.count)) for i, d in enumerate(drawn)],
        "position int, label string, column string, low double, high double, bins int",
    )
    edges = frame.withColumn("bin", F.explode(F.sequence(F.lit(0), F.col("bins") - 1)))
    width = (F.col("high") - F.col("low")) / F.col("bins")
    return (
        edges.join(F.broadcast(counted), ["label", "bin"], "left")
        .orderBy("position", "bin")
        .select(
            "column",
            "bin",
            F.round(F.col("low") + F.col("bin") * width, digits).alias("bin_from"),
            F.round(F.col("low") + (F.col("bin") + 1) * width, digits).alias("bin_to"),
            F.coalesce("count", F.lit(0)).alias("count"),
        )
    )


def histogram(df: DataFrame, columns: list[str], digits: int = 4) -> DataFrame:
    """Needs only the extent and number of values: one scan for these, one for the bins."""
    return _binned(df, extents(df, columns), digits)


def histogram_notes(df: DataFrame, found: list[Distribution], digits: int = 4) -> DataFrame:
    """Mean, median, spread and sample-adjusted skewness shown under each histogram, and how
    many infinite values it leaves out."""
    rows = []
    infinite = {e.column: e.not_finite for e in _extents_of(df, found)}
    for d in found:
        if d.count < MIN_HISTOGRAM_VALUES:
            continue
        skew = d.skewness
        if skew is not None:
            skew = skew * (d.count * (d.count - 1)) ** 0.5 / (d.count - 2)
        side = None
        if skew is not None and abs(skew) > 0.5:
            side = "right" if skew > 0 else "left"
        rows.append((d.column, d.mean, d.median, d.std, skew, side, infinite[d.column]))
    notes = local_frame(
        df.sparkSession,
        rows,
        "column string, mean double, median double, std double, skewness double, "
        "skewed string, not_finite long",
    )
    return notes.select(
        "column",
        *[F.round(n, digits).alias(n) for n in ("mean", "median", "std", "skewness")],
        "skewed",
        "not_finite",
    )


# ------------------------------------------------------------------ scatter


def _pairs(
    df: DataFrame, x: str, y: str, color: str | None, *more: Column
) -> DataFrame:
    clean = nan_to_null(df)
    values = number_columns(clean, [x, y])
    label = quoted(color).cast("string") if color else F.lit(None).cast("string")
    return clean.select(
        values[x].alias("x"), values[y].alias("y"), label.alias("color"), *more
    ).where(F.col("x").isNotNull() & F.col("y").isNotNull())


def scatter_sample(
    df: DataFrame,
    x: str,
    y: str,
    color: str | None = None,
    max_points: int = 5000,
    seed: int = SAMPLE_SEED,
    identity: list[str] | None = None,
) -> DataFrame:
    """A uniform sample of exactly ``max_points`` pairs (all pairs if there are fewer).

    Every row draws the SHA-256 of the seed and its values in ``identity`` (default: all
    columns), and the smallest draws are kept: the same rows, however the table is laid out.
    Rows equal in all of these are interchangeable.  A first cut keeps about twice the points
    needed, so the selection handles thousands of rows however many the table has; should the
    cut ever keep too few, the selection runs without it.
    """
    clean = nan_to_null(df)
    names = identity or [
        f.name for f in clean.schema if value_kind(f.dataType) is not None
    ]
    parts = [F.coalesce(quoted(n).cast("string"), F.lit("")) for n in names]
    draw = F.sha2(F.concat_ws("|", F.lit(str(seed)), *parts), 256)
    drawn = _pairs(clean, x, y, color, draw.alias("draw"))
    total = drawn.count()
    if total <= max_points:
        return drawn.drop("draw")
    order = ["draw", "x", "y", "color"]
    share = min(1.0, 2.0 * max_points / total)
    limit = f"{min(16**DRAW_DIGITS - 1, int(share * 16**DRAW_DIGITS)):0{DRAW_DIGITS}x}"
    cut = drawn.where(F.substring("draw", 1, DRAW_DIGITS) <= limit)
    chosen = pin(cut.orderBy(*order).limit(max_points))
    if chosen.count() < max_points:
        chosen = drawn.orderBy(*order).limit(max_points)
    return chosen.drop("draw")


def scatter_fit(
    df: DataFrame, x: str, y: str, color: str | None = None, digits: int = 4
) -> DataFrame:
    """Least-squares line of ``y`` over ``x`` per colour, over all pairs."""
    return (
        _pairs(df, x, y, color)
        .groupBy("color")
        .agg(
            F.count(F.lit(1)).alias("points"),
            F.regr_slope("y", "x").alias("slope"),
            F.regr_intercept("y", "x").alias("intercept"),
        )
        .select(
            "color",
            "points",
            F.round("slope", digits).alias("slope"),
            F.round("intercept", digits).alias("intercept"),
        )
    )


# ------------------------------------------------------------------ KPI card and chart plan


def kpi_card(
    df: DataFrame, measures: list[str], digits: int = 4, rules: ChartRules = ChartRules()
) -> DataFrame:
    """Sum of the first measures that hold any number."""
    shown = measures[: rules.kpi_measures]
    totals = exact_totals(df, number_columns(df, shown)).where(F.col("count") > 0)
    return totals.select("column", F.round("total", digits).alias("total"))


def kpi_card_of(
    spark: SparkSession,
    found: list[Distribution],
    digits: int = 4,
    rules: ChartRules = ChartRules(),
) -> DataFrame:
    """The same from distributions, without a scan."""
    rows = [(d.column, d.sum) for d in found[: rules.kpi_measures] if d.sum is not None]
    totals = local_frame(spark, rows, "column string, total double")
    return totals.withColumn("total", F.round("total", digits))


def chart_plan(
    catalog: DataFrame,
    found: list[Distribution],
    dimensions: list[str],
    trends: list[tuple[str, str]],
    strong_pairs: list[tuple[str, str]],
    segments: list[tuple[str, str]],
    rules: ChartRules = ChartRules(),
) -> DataFrame:
    """Which charts to draw, in order, with the columns each one reads.

    ``found`` covers the measures, ``dimensions`` the dimensions (an analysed column always has
    values), ``trends`` (time column, measure) and ``segments`` (dimension, measure) in order.
    """
    plan: list[tuple[str, str, list[str]]] = []
    gaps = [r["column"] for r in null_ranking(catalog).collect()]
    if gaps:
        plan.append(("bar_horizontal", messages.NULLS_CHART, gaps))
    for d in found[: rules.histograms]:
        if d.count >= MIN_HISTOGRAM_VALUES:
            plan.append(("histogram", messages.HISTOGRAM_CHART.format(d.column), [d.column]))
    for d in found[: rules.box_plots]:
        if d.count >= 10:
            plan.append(("box", messages.BOX_CHART.format(d.column), [d.column]))
    for name in dimensions[: rules.bar_charts]:
        plan.append(("bar", messages.BAR_CHART.format(name), [name]))
    seen: dict[str, int] = {}
    for time_column, measure in trends:
        seen[time_column] = seen.get(time_column, 0) + 1
        if seen[time_column] <= rules.trends_per_time_column:
            plan.append(("line", messages.LINE_CHART.format(measure), [time_column, measure]))
    if len(found) >= 2:
        plan.append(("heatmap", messages.HEATMAP_CHART, [d.column for d in found]))
    for x, y in strong_pairs[: rules.scatter_plots]:
        plan.append(("scatter", messages.SCATTER_CHART.format(x, y), [x, y]))
    for dimension, measure in segments[: rules.segment_bars]:
        title = messages.SEGMENT_CHART.format(measure, dimension)
        plan.append(("bar_segment", title, [dimension, measure]))
    totals = [d.column for d in found[: rules.kpi_measures] if d.count]
    if totals:
        plan.append(("kpi_card", messages.KPI_CHART, totals))
    rows = [(i + 1, *entry) for i, entry in enumerate(plan[: rules.max_charts])]
    return local_frame(
        catalog.sparkSession,
        rows,
        "seq int, chart_type string, title string, columns array<string>",
    )
