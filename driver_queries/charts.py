"""Chart data."""

from autoprofile.operators.catalog import column_catalog
from autoprofile.operators.charts import (
    chart_plan,
    histogram,
    histogram_notes,
    kpi_card,
    null_ranking,
)
from autoprofile.operators.numbers import box_stats, distributions
from driver_queries.inputs import GAPPY_LINES_SQL, gappy_lines
from driver_queries.numbers import nulls_sql, quartile
from driver_queries.registry import query, r, table

GAPPY = GAPPY_LINES_SQL + " AS t"


@query(
    "null_ranking",
    f"""SELECT "column", null_pct
        FROM ({nulls_sql(GAPPY, ['quantity', 'tax', 'returnflag'])}) AS n WHERE null_pct > 0""",
)
def emptiest(spark, sf_dir):
    lines = gappy_lines(spark, sf_dir).select("quantity", "tax", "returnflag", "linestatus")
    return null_ranking(column_catalog(lines))


def histogram_sql(source, name):
    c = f"cast({name} AS DOUBLE)"
    return f"""
SELECT '{name}' AS "column", cast(b AS INTEGER) AS bin,
  {r('any_value(lo) + b * any_value(w)')} AS bin_from,
  {r('any_value(lo) + (b + 1) * any_value(w)')} AS bin_to, count(v) AS count
FROM (SELECT lo, hi, bins, (hi - lo) / bins AS w, unnest(range(bins)) AS b FROM (
        SELECT min({c}) AS lo, max({c}) AS hi,
          least(50, cast(floor(sqrt(count({name}))) AS BIGINT) + 10) AS bins
        FROM {source}) AS extent) AS edges
LEFT JOIN (SELECT {c} AS v FROM {source}) AS x
  ON v IS NOT NULL AND b = least(cast(floor((v - lo) / (hi - lo) * bins) AS BIGINT), bins - 1)
GROUP BY b"""


@query("histogram", histogram_sql("events", "value"))
def bins_of_events(spark, sf_dir):
    return histogram(table(spark, sf_dir, "events"), ["value"])


@query(
    "histogram_documents",
    histogram_sql("documents", "n_chars")
    + "\nUNION ALL "
    + histogram_sql("documents", "doc_id"),
)
def bins_of_documents(spark, sf_dir):
    return histogram(table(spark, sf_dir, "documents"), ["n_chars", "doc_id"])


@query(
    "histogram_notes",
    f"""SELECT 'value' AS "column", {r('avg(value)')} AS mean, {r('median(value)')} AS median,
        {r('stddev_samp(value)')} AS std, {r('skewness(value)')} AS skewness,
        CASE WHEN skewness(value) > 0.5 THEN 'right' WHEN skewness(value) < -0.5 THEN 'left' END
          AS skewed, 0::BIGINT AS not_finite FROM events""",
)
def notes(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return histogram_notes(events, distributions(events, ["value"]))


def box_sql(source, name, digits=4):
    c = f"cast({name} AS DOUBLE)"
    return f"""
SELECT '{name}' AS "column", {r('any_value(q1)', digits)} AS q1,
  {r('any_value(med)', digits)} AS median, {r('any_value(q3)', digits)} AS q3,
  {r('any_value(m)', digits)} AS mean,
  {r('min(v) FILTER (v >= lo AND v <= hi)', digits)} AS whisker_low,
  {r('max(v) FILTER (v >= lo AND v <= hi)', digits)} AS whisker_high,
  count(*) FILTER (v < lo OR v > hi) AS outliers
FROM (SELECT {c} AS v FROM {source}) AS x, (
  SELECT *, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM (
    SELECT {quartile(c, 0.25)} AS q1, {quartile(c, 0.5)} AS med, {quartile(c, 0.75)} AS q3,
      avg({c}) AS m FROM {source}) AS q) AS f"""


@query("box_stats", box_sql("events", "value") + "\nUNION ALL " + box_sql("events", "user_id"))
def boxes(spark, sf_dir):
    return box_stats(table(spark, sf_dir, "events"), ["value", "user_id"])


@query(
    "kpi_card",
    "\nUNION ALL ".join(
        f"""SELECT '{c}' AS "column", {r(f'sum({c})', 2)} AS total FROM lineitem"""
        for c in ("l_quantity", "l_extendedprice", "l_discount", "l_partkey")
    ),
)
def card(spark, sf_dir):
    names = ["l_quantity", "l_extendedprice", "l_discount", "l_partkey"]
    return kpi_card(table(spark, sf_dir, "lineitem"), names, digits=2)


# the plan follows from the roles of the columns of events, which the type queries check
@query(
    "chart_plan",
    """SELECT cast(row_number() OVER (ORDER BY place) AS INTEGER) AS seq, chart_type, title FROM (
         VALUES (1, 'histogram', 'Distribution of user_id'),
           (2, 'histogram', 'Distribution of value'), (3, 'box', 'Box Plot: user_id'),
           (4, 'box', 'Box Plot: value'), (5, 'bar', 'Distribution of event_type'),
           (6, 'bar', 'Distribution of props'), (7, 'line', 'Time Trend: user_id'),
           (8, 'line', 'Time Trend: value'), (9, 'heatmap', 'Correlation Heatmap'),
           (10, 'bar_segment', 'user_id by event_type'),
           (11, 'bar_segment', 'value by event_type'), (12, 'bar_segment', 'user_id by props'),
           (13, 'bar_segment', 'value by props'), (14, 'kpi_card', 'KPI Overview')
       ) AS plan(place, chart_type, title) WHERE (SELECT count(*) FROM events) > 10""",
)
def plan_of_events(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    measures, dimensions = ["user_id", "value"], ["event_type", "props"]
    plan = chart_plan(
        column_catalog(events),
        distributions(events, measures),
        dimensions,
        [("ts", m) for m in measures],
        [],
        [(d, m) for d in dimensions for m in measures],
    )
    return plan.select("seq", "chart_type", "title")
