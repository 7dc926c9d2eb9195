"""Correlation, series and trends, segments, scatter fits."""

from pyspark.sql import functions as F

from autoprofile.operators.charts import scatter_fit, scatter_sample
from autoprofile.operators.correlation import (
    correlation_matrix,
    heatmap,
    strong_correlations,
)
from autoprofile.operators.segments import segment_bars, segment_grid, segment_rollup
from autoprofile.operators.series import monthly_series, monthly_trend, trend_fit
from driver_queries.inputs import GAPPY_LINES_SQL, gappy_lines
from driver_queries.registry import query, r, table

MEASURES = ["quantity", "weight", "discount", "tax", "fixed"]


def pair_sql(source, x, y, i, j):
    both = f"{x} IS NOT NULL AND {y} IS NOT NULL"
    value = (
        f"(SELECT covar_pop({x}, {y}) / nullif(stddev_pop({x}) * stddev_pop({y}), 0.0) "
        f"FROM {source} WHERE {both})"
    )
    return f"SELECT {i} AS i, {j} AS j, '{x}' AS col1, '{y}' AS col2, {value} AS correlation"


def triangle_sql(source, names):
    return "\nUNION ALL ".join(
        pair_sql(source, names[i], names[j], i, j)
        for i in range(len(names))
        for j in range(i, len(names))
    )


GAPPY = GAPPY_LINES_SQL + " AS t"

MATRIX_SQL = f"""
WITH half AS ({triangle_sql(GAPPY, MEASURES)})
SELECT col1, col2, {r('correlation')} AS correlation FROM half
UNION ALL SELECT col2, col1, {r('correlation')} FROM half WHERE i < j"""


@query("correlation_matrix", MATRIX_SQL)
def matrix(spark, sf_dir):
    return correlation_matrix(gappy_lines(spark, sf_dir), MEASURES)


@query(
    "strong_correlations",
    f"""SELECT col1, col2, {r('correlation')} AS correlation,
        CASE WHEN correlation >= 0.7 THEN 'strong positive' ELSE 'strong negative' END AS strength
        FROM ({triangle_sql(GAPPY, MEASURES)}) AS half
        WHERE i < j AND abs(correlation) >= 0.7""",
)
def strong(spark, sf_dir):
    return strong_correlations(gappy_lines(spark, sf_dir), MEASURES)


@query(
    "correlation_heatmap",
    f"""SELECT col1, max(correlation) FILTER (col2 = 'quantity') AS quantity,
        max(correlation) FILTER (col2 = 'weight') AS weight,
        max(correlation) FILTER (col2 = 'discount') AS discount
        FROM ({MATRIX_SQL}) AS m WHERE col1 IN ('quantity', 'weight', 'discount') GROUP BY col1""",
)
def wide_matrix(spark, sf_dir):
    names = MEASURES[:3]
    return heatmap(correlation_matrix(gappy_lines(spark, sf_dir), names), names)


# ------------------------------------------------------------------ series

PERIODS = {
    "day": "strftime({0}, '%Y-%m-%d')",
    "month": "strftime({0}, '%Y-%m')",
    "quarter": "concat(year({0}), 'Q', quarter({0}))",
    "year": "strftime({0}, '%Y')",
}


def series_sql(source, time, measures, granularity="month", digits=4):
    label = PERIODS[granularity].format(time)
    parts = [
        f"""SELECT '{time}' AS time_column, '{m}' AS measure, {label} AS period,
        {r(f'coalesce(sum(cast({m} AS DOUBLE)), 0)', digits)} AS value FROM {source}
        WHERE {time} IS NOT NULL GROUP BY {label}"""
        for m in measures
    ]
    return "\nUNION ALL ".join(parts)


def trend_sql(source, time, measures, granularity="month", digits=4):
    return f"""
SELECT time_column, measure, periods,
  CASE WHEN periods < 3 THEN 'stable' WHEN slope > 0 THEN 'upward' ELSE 'downward' END
    AS trend_direction,
  {r('CASE WHEN periods < 3 THEN 0.0 ELSE slope END', digits)} AS slope,
  {r('CASE WHEN periods < 3 OR spread = 0 THEN 0.0 ELSE r2 END', digits)} AS r_squared
FROM (
  SELECT time_column, measure, count(*) AS periods, regr_slope(value, x) AS slope,
    regr_r2(value, x) AS r2, var_pop(value) AS spread
  FROM (SELECT *, row_number() OVER (PARTITION BY measure ORDER BY period) - 1 AS x
        FROM ({series_sql(source, time, measures, granularity, 6)}) AS s) AS placed
  GROUP BY time_column, measure) AS fitted"""


LINE_MEASURES = ["l_quantity", "l_tax"]


@query("monthly_series", series_sql("lineitem", "l_shipdate", LINE_MEASURES))
def series_of_lines(spark, sf_dir):
    return monthly_series(table(spark, sf_dir, "lineitem"), ["l_shipdate"], LINE_MEASURES)


@query(
    "monthly_series_gaps",
    series_sql(
        """(SELECT CASE WHEN month(o_orderdate) <> 3 THEN o_orderdate END AS ordered,
            CASE WHEN month(o_orderdate) <> 7 THEN o_custkey END AS customers FROM orders) AS t""",
        "ordered", ["customers"],
    ),
)
def series_with_gaps(spark, sf_dir):
    month = F.month("o_orderdate")
    orders = table(spark, sf_dir, "orders").select(
        F.when(month != 3, F.col("o_orderdate")).alias("ordered"),
        F.when(month != 7, F.col("o_custkey")).alias("customers"),
    )
    return monthly_series(orders, ["ordered"], ["customers"])


@query(
    "series_reserved_names",
    """SELECT 'start' AS time_column, 'points' AS measure, strftime(l_shipdate, '%Y-%m') AS period,
         round(sum(l_quantity), 4) AS value FROM lineitem GROUP BY period
       UNION ALL
       SELECT 'start', 'all_points', strftime(l_shipdate, '%Y-%m') AS period,
         round(sum(l_tax), 4) AS value FROM lineitem GROUP BY period
       UNION ALL
       SELECT 'start', 'time_column', strftime(l_shipdate, '%Y-%m') AS period,
         round(sum(l_discount), 4) AS value FROM lineitem GROUP BY period""",
)
def series_reserved_names(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_shipdate").alias("start"),
        F.col("l_quantity").alias("points"),
        F.col("l_tax").alias("all_points"),
        F.col("l_discount").alias("time_column"),
    )
    return monthly_series(lines, ["start"], ["points", "all_points", "time_column"])


@query("daily_series", series_sql("events", "ts", ["value"], "day"))
def daily_series(spark, sf_dir):
    return monthly_series(table(spark, sf_dir, "events"), ["ts"], ["value"], granularity="day")


@query(
    "quarterly_and_yearly_series",
    series_sql("orders", "o_orderdate", ["o_custkey"], "quarter")
    + "\nUNION ALL "
    + series_sql("orders", "o_orderdate", ["o_custkey"], "year"),
)
def longer_series(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    quarters, years = (
        monthly_series(orders, ["o_orderdate"], ["o_custkey"], granularity=g)
        for g in ("quarter", "year")
    )
    return quarters.unionByName(years)


@query("monthly_trend", trend_sql("lineitem", "l_shipdate", LINE_MEASURES))
def trend_of_lines(spark, sf_dir):
    return monthly_trend(table(spark, sf_dir, "lineitem"), ["l_shipdate"], LINE_MEASURES)


@query(
    "monthly_trend_flat",
    trend_sql("(SELECT l_shipdate, 0 AS nothing FROM lineitem) AS t", "l_shipdate", ["nothing"]),
)
def trend_of_nothing(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_shipdate", F.lit(0).alias("nothing"))
    return monthly_trend(lines, ["l_shipdate"], ["nothing"])


@query(
    "trend_fit",
    f"""SELECT *, CASE WHEN r_squared > 0.7 THEN 'Strong' WHEN r_squared > 0.4 THEN 'Moderate'
        ELSE 'Weak' END AS fit FROM ({trend_sql('orders', 'o_orderdate', ['o_custkey'], 'year')})
        AS t""",
)
def fit_of_orders(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return trend_fit(
        monthly_trend(orders, ["o_orderdate"], ["o_custkey"], granularity="year")
    )


# ------------------------------------------------------------------ segments


def grid_sql(source, dimensions, measures, top_n=15, digits=4, null_label="nan"):
    parts = []
    for i, d in enumerate(dimensions):
        for j, m in enumerate(measures):
            segment = f"coalesce(cast({d} AS VARCHAR), '{null_label}')"
            parts.append(
                f"""SELECT {i} AS dimension_no, {j} AS measure_no, '{d}' AS dimension,
                '{m}' AS measure, {segment} AS segment,
                {r(f'coalesce(sum(cast({m} AS DOUBLE)), 0)', digits)} AS total,
                {r(f'avg(cast({m} AS DOUBLE))', digits)} AS avg, count({m}) AS count
                FROM {source} GROUP BY {segment}"""
            )
    united = "\nUNION ALL ".join(parts)
    return f"""
SELECT dimension_no, measure_no, dimension, measure, cast(rank AS INTEGER) AS rank, segment,
  total, avg, count
FROM (SELECT *, row_number() OVER (PARTITION BY dimension_no, measure_no
        ORDER BY total DESC, segment) AS rank FROM ({united}) AS rolled) AS ranked
WHERE rank <= {top_n}"""


@query(
    "segment_rollup",
    f"SELECT segment, total, avg, count FROM ({grid_sql('events', ['event_type'], ['value'])})"
    " AS g",
)
def rollup_of_events(spark, sf_dir):
    return segment_rollup(table(spark, sf_dir, "events"), "event_type", "value")


@query(
    "segment_rollup_lines",
    f"""SELECT segment, total, avg, count
        FROM ({grid_sql('lineitem', ['l_returnflag'], ['l_extendedprice'], digits=2)}) AS g""",
)
def rollup_of_lines(spark, sf_dir):
    return segment_rollup(
        table(spark, sf_dir, "lineitem"), "l_returnflag", "l_extendedprice", digits=2
    )


# every segment has the same total and begins alike: only the whole text tells the first ones
TITLED_SQL = """(SELECT concat(repeat('shared title ', 8), o_orderkey) AS label, 1 AS one
  FROM orders) AS t"""


@query("segment_ties_texts", grid_sql(TITLED_SQL, ["label"], ["one"]))
def ties_of_titles(spark, sf_dir):
    titled = table(spark, sf_dir, "orders").select(
        F.concat(F.repeat(F.lit("shared title "), 8), F.col("o_orderkey")).alias("label"),
        F.lit(1).alias("one"),
    )
    return segment_grid(titled, ["label"], ["one"])


GRID_DIMENSIONS = ["l_linenumber", "l_returnflag", "l_linestatus", "l_suppkey"]
GRID_MEASURES = ["l_quantity", "l_discount", "l_partkey"]


@query("segment_grid", grid_sql("lineitem", GRID_DIMENSIONS, GRID_MEASURES))
def grid_of_lines(spark, sf_dir):
    return segment_grid(table(spark, sf_dir, "lineitem"), GRID_DIMENSIONS, GRID_MEASURES)


@query("segment_grid_gaps", grid_sql(GAPPY, ["returnflag", "linestatus"], ["quantity", "tax"], 3))
def grid_with_gaps(spark, sf_dir):
    return segment_grid(
        gappy_lines(spark, sf_dir), ["returnflag", "linestatus"], ["quantity", "tax"], 3
    )


@query("segment_grid_texts", grid_sql("documents", ["text", "lang"], ["n_chars"]))
def grid_of_texts(spark, sf_dir):
    return segment_grid(table(spark, sf_dir, "documents"), ["text", "lang"], ["n_chars"])


@query(
    "segment_bars",
    f"""SELECT cast(result_no AS INTEGER) AS result_no, dimension, measure, rank, segment, total,
        avg FROM (
          SELECT *, dense_rank() OVER (ORDER BY dimension_no, measure_no) AS result_no
          FROM ({grid_sql('lineitem', GRID_DIMENSIONS, GRID_MEASURES)}) AS g) AS numbered
        WHERE result_no <= 4 AND rank <= 15""",
)
def bars_of_segments(spark, sf_dir):
    return segment_bars(
        segment_grid(table(spark, sf_dir, "lineitem"), GRID_DIMENSIONS, GRID_MEASURES)
    )


# ------------------------------------------------------------------ scatter


@query(
    "scatter_fit",
    f"""SELECT returnflag AS color, count(*) AS points, {r('regr_slope(weight, quantity)')} AS slope,
        {r('regr_intercept(weight, quantity)')} AS intercept FROM {GAPPY}
        WHERE quantity IS NOT NULL AND weight IS NOT NULL GROUP BY returnflag""",
)
def fit_by_flag(spark, sf_dir):
    return scatter_fit(gappy_lines(spark, sf_dir), "quantity", "weight", "returnflag")


LINE_IDENTITY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


@query(
    "scatter_sample",
    f"""SELECT l_quantity AS x, l_extendedprice AS y, l_returnflag AS color FROM (
          SELECT *, sha256(concat_ws('|', '42', {', '.join(
              f"CAST({c} AS VARCHAR)" for c in LINE_IDENTITY)})) AS draw FROM lineitem) AS drawn
        WHERE l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL
        ORDER BY draw, x, y, color LIMIT 5000""",
)
def sample_points(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    return scatter_sample(
        lines, "l_quantity", "l_extendedprice", "l_returnflag", identity=LINE_IDENTITY
    )


@query(
    "scatter_sample_size",
    f"""SELECT least(count(*), 5000) AS points, 0 AS incomplete, 0 AS strangers FROM {GAPPY}
        WHERE quantity IS NOT NULL AND weight IS NOT NULL""",
)
def sample_size(spark, sf_dir):
    lines = gappy_lines(spark, sf_dir)
    points = scatter_sample(lines, "quantity", "weight")
    # every sampled pair lies on weight = 2 * quantity + tax with a tax of 0 to 8 percent
    stray = F.abs(F.col("y") - F.col("x") * 2 - 0.04) > 0.0401
    return points.agg(
        F.count(F.lit(1)).alias("points"),
        F.count_if(F.col("x").isNull() | F.col("y").isNull()).cast("int").alias("incomplete"),
        F.count_if(stray).cast("int").alias("strangers"),
    )
