"""Insights, confidence and the whole pipeline."""

import datetime as dt
from functools import reduce

from pyspark.sql import functions as F

from autoprofile.config import Config, ReportRules, SchemaRules
from autoprofile.operators.insights import confidence_score
from autoprofile.operators.tables import null_profile
from autoprofile.plans.pipeline import analyze
from driver_queries.inputs import GAPPY_LINES_SQL, gappy_lines
from driver_queries.numbers import nulls_sql, top_sql
from driver_queries.registry import COLUMNS, pct, query, r, table, types_sql
from driver_queries.relations import grid_sql, trend_sql

AS_OF = dt.datetime(2030, 1, 1)


def overview_sql(source, columns):
    return f"""SELECT 1 AS priority, 'Dataset Overview' AS category, 'dataset' AS subject,
      cast(count(*) AS DOUBLE) AS value FROM {source}"""


def dominance_sql(source, dimensions, measures):
    return f"""SELECT 3 AS priority, 'Segmentation' AS category,
      concat(dimension, '/', measure, '/', segment) AS subject, {r('share')} AS value FROM (
      SELECT *, total * 100 / nullif(sum(total) OVER (PARTITION BY dimension_no, measure_no), 0)
          AS share, dense_rank() OVER (ORDER BY dimension_no, measure_no) AS place
      FROM ({grid_sql(source, dimensions, measures)}) AS g) AS shares
      WHERE rank = 1 AND place <= 3 AND share IS NOT NULL"""


def extreme_sql(source, measures):
    return "\nUNION ALL ".join(
        f"""SELECT 4, 'Distribution', '{m}', {r(f"{r(f'max({m})')} / {r(f'avg({m})')}")}
        FROM {source} HAVING {r(f'max({m})')} > 5 * {r(f'avg({m})')} AND {r(f'avg({m})')} <> 0"""
        for m in measures
    )


def dominant_sql(source, names):
    return f"""SELECT 4, 'Distribution', "column", pct FROM ({top_sql(source, names)}) AS t
      WHERE rank = 1 AND pct > 60"""


def _brief(results):
    return results.insights.select("priority", "category", "subject", "value")


@query(
    "insights",
    overview_sql("events", 6)
    + "\nUNION ALL "
    + dominance_sql("events", ["event_type", "props"], ["user_id", "value"])
    + "\nUNION ALL "
    + extreme_sql("events", ["user_id", "value"])
    + "\nUNION ALL "
    + dominant_sql("events", ["event_type", "props"]),
)
def insights_of_events(spark, sf_dir):
    return _brief(analyze(table(spark, sf_dir, "events"), as_of=AS_OF))


# order, cap, wording and confidence: rules in their order within a priority
RANKED_SQL = f"""
SELECT cast(row_number() OVER (ORDER BY priority, rule_no, item_no) AS INTEGER) AS seq,
  category, title, confidence FROM (
    SELECT 1 AS priority, 1 AS rule_no, 0 AS item_no, 'Dataset Overview' AS category,
      concat('Dataset contains ', format('{{:,}}', count(*)), ' records across 6 columns')
        AS title, 0.99::DOUBLE AS confidence FROM events
    UNION ALL
    SELECT 3, 6, place, 'Segmentation', concat(chr(39), segment, chr(39), ' dominates ', chr(39),
      measure, chr(39), ' by ', dimension, ' (', format('{{:.1f}}', share), '%)'), 0.88::DOUBLE
    FROM (SELECT *, total * 100 / nullif(sum(total) OVER (PARTITION BY dimension_no, measure_no), 0)
            AS share, dense_rank() OVER (ORDER BY dimension_no, measure_no) AS place
          FROM ({grid_sql("events", ["event_type", "props"], ["user_id", "value"])}) AS g) AS s
    WHERE rank = 1 AND place <= 3
    UNION ALL
    SELECT 4, 7, 0, 'Distribution', concat(chr(39), "column", chr(39), ' is dominated by ',
      chr(39), value, chr(39), ' (', cast(round(pct) AS INTEGER), '% of values)'), 0.80::DOUBLE
    FROM ({top_sql("events", ["event_type", "props"])}) AS t WHERE rank = 1 AND pct > 60
  ) AS findings"""


@query("insights_ranked", f"SELECT * FROM ({RANKED_SQL}) AS f WHERE seq <= 3")
def first_insights(spark, sf_dir):
    config = Config(report=ReportRules(max_insights=3))
    found = analyze(table(spark, sf_dir, "events"), config, as_of=AS_OF).insights
    return found.select("seq", "category", "title", "confidence")


GAP_SOURCE = f"""(SELECT quantity, weight, l_shipdate,
  returnflag, linestatus, CASE WHEN l_linenumber = 5 THEN 'rare' ELSE 'usual' END AS kind,
  CASE WHEN l_linenumber % 2 = 0 THEN quantity * quantity * quantity * quantity END AS fourth
  FROM {GAPPY_LINES_SQL} AS g) AS t"""


def gap_source(spark, sf_dir):
    quantity = F.col("quantity")
    number = F.col("l_linenumber")
    return gappy_lines(spark, sf_dir).select(
        "quantity", "weight", "l_shipdate", "returnflag", "linestatus",
        F.when(number == 5, "rare").otherwise("usual").alias("kind"),
        F.when(number % 2 == 0, quantity * quantity * quantity * quantity).alias("fourth"),
    )


@query(
    "insights_gaps",
    overview_sql(GAP_SOURCE, 7)
    + f"""
UNION ALL SELECT 2, 'Data Quality', string_agg(concat('''', "column", ''' (',
    cast(round(null_pct) AS INTEGER), '%)'), ', '), cast(count(*) AS DOUBLE)
  FROM ({nulls_sql(GAP_SOURCE, ['quantity', 'returnflag', 'fourth'])}) AS n WHERE null_pct > 30
UNION ALL SELECT 3, 'Correlation', concat(x, ' ~ ', y), value FROM (
  SELECT 'quantity' AS x, 'weight' AS y, {r('corr(quantity, weight)')} AS value FROM {GAP_SOURCE}
  UNION ALL SELECT 'quantity', 'fourth', {r('corr(quantity, fourth)')} FROM {GAP_SOURCE}
  UNION ALL SELECT 'weight', 'fourth', {r('corr(weight, fourth)')} FROM {GAP_SOURCE}
) AS c WHERE abs(value) >= 0.7
UNION ALL """
    + dominance_sql(
        GAP_SOURCE, ["returnflag", "linestatus", "kind"], ["quantity", "weight", "fourth"]
    )
    + "\nUNION ALL "
    + extreme_sql(GAP_SOURCE, ["quantity", "weight"])
    + "\nUNION ALL "
    + dominant_sql(GAP_SOURCE, ["returnflag", "linestatus", "kind"]),
)
def insights_with_gaps(spark, sf_dir):
    rules = SchemaRules(
        type_overrides={"quantity": "numeric", "weight": "numeric", "fourth": "numeric"}
    )
    return _brief(analyze(gap_source(spark, sf_dir), Config(schema=rules), as_of=AS_OF))


RISING_SOURCE = """(SELECT l_shipdate, l_returnflag,
  date_diff('month', DATE '1990-01-01', cast(l_shipdate AS DATE)) * 100.0::DOUBLE
    / count(*) OVER (PARTITION BY date_trunc('month', l_shipdate)) AS rising
  FROM lineitem) AS t"""


@query(
    "insights_trend",
    f"""SELECT 3 AS priority, 'Trend' AS category, measure AS subject, r_squared AS value
        FROM ({trend_sql(RISING_SOURCE, 'l_shipdate', ['rising'])}) AS t WHERE r_squared > 0.5""",
)
def insights_of_a_trend(spark, sf_dir):
    """A measure whose monthly sum grows by the month."""
    lines = table(spark, sf_dir, "lineitem").withColumn(
        "start", F.date_trunc("month", "l_shipdate")
    )
    rows = lines.groupBy("start").agg(F.count(F.lit(1)).alias("lines"))
    number = (F.year("start") - 1990) * 12 + F.month("start") - 1
    rising = lines.join(F.broadcast(rows), "start").select(  # one row per month
        "l_shipdate", "l_returnflag", (number * 100.0 / F.col("lines")).alias("rising")
    )
    rules = SchemaRules(type_overrides={"rising": "numeric"})
    results = analyze(rising, Config(schema=rules), as_of=AS_OF)
    return _brief(results).where("category = 'Trend'")


@query(
    "confidence_score",
    f"""SELECT {r('''greatest(0.5, least(1.0, 1.0 - avg(null_pct) / 100 * 0.3 -
        CASE WHEN max(total_rows) < 50 THEN 0.2 WHEN max(total_rows) < 200 THEN 0.1
        ELSE 0.0 END))''', 2)} AS confidence_score
        FROM ({nulls_sql(GAPPY_LINES_SQL + ' AS t', ['quantity', 'tax', 'returnflag'])}) AS n""",
)
def confidence(spark, sf_dir):
    lines = gappy_lines(spark, sf_dir)
    nulls = null_profile(lines, ["quantity", "tax", "returnflag"])
    return confidence_score(nulls, F.max("total_rows"))


@query(
    "pipeline_summary",
    f"""SELECT n AS rows_raw, n AS rows, {pct('complete', 'n')} AS complete_row_pct,
          n - (SELECT count(*) FROM (SELECT DISTINCT * FROM lineitem) AS d) AS duplicate_rows
        FROM (SELECT count(*) AS n, count(*) FILTER ({' AND '.join(
            f'{c} IS NOT NULL' for c, _ in COLUMNS['lineitem'])}) AS complete
          FROM lineitem) AS counted""",
)
def pipeline_summary(spark, sf_dir):
    results = analyze(table(spark, sf_dir, "lineitem"), name="lineitem", as_of=AS_OF)
    about = results.metadata.select("rows_raw", "rows")
    return about.join(
        results.dataset_summary.select("rows", "complete_row_pct", "duplicate_rows"), "rows"
    )


def sections_sql(source, columns):
    """How many rows the sections have that follow from types and counts alone."""
    typed = f"SELECT * FROM ({types_sql(source, columns)}) AS c"
    kept = f"SELECT * FROM ({typed}) AS k WHERE NOT ignore"

    def of_type(kind, n="count(*)"):
        return f"SELECT {n} AS n FROM ({kept}) AS t WHERE inferred_type IN ({kind})"

    counts = {
        "metadata": "SELECT 1 AS n",
        "column_catalog": f"SELECT count(*) AS n FROM ({typed}) AS t",
        "type_distribution": f"SELECT count(DISTINCT inferred_type) AS n FROM ({typed}) AS t",
        "column_quality": f"SELECT count(*) AS n FROM ({kept}) AS t",
        "semantic_fields": f"SELECT count(*) AS n FROM ({kept}) AS t",
        "dataset_summary": "SELECT 1 AS n",
        "numeric_summary": of_type("'numeric'"),
        "datetime_summary": of_type("'datetime'"),
        "top_values": of_type(
            "'categorical', 'boolean'", "coalesce(sum(least(unique_count, 15)), 0)"
        ),
        "correlations": of_type(
            "'numeric'", "CASE WHEN count(*) > 1 THEN count(*) * count(*) ELSE 0 END"
        ),
        "null_ranking": f"SELECT count(*) AS n FROM ({kept}) AS t WHERE present < total_rows",
        "confidence": "SELECT 1 AS n",
        "quality_overview": "SELECT 1 AS n",
        "kpi_card": of_type("'numeric'", "least(count(*), 6)"),
    }
    return "\nUNION ALL ".join(
        f"SELECT '{name}' AS section, cast((SELECT n FROM ({sql}) AS s) AS BIGINT) AS n_rows"
        for name, sql in counts.items()
    ), list(counts)


SECTIONS_SQL, COUNTED_SECTIONS = sections_sql("events", COLUMNS["events"])


def _section_rows(results, names):
    parts = [
        frame.agg(F.lit(name).alias("section"), F.count(F.lit(1)).alias("n_rows"))
        for name, frame in results.sections().items()
        if name in names
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


@query("pipeline_sections", SECTIONS_SQL)
def pipeline_sections(spark, sf_dir):
    """Rows of the sections whose number follows from types and counts."""
    results = analyze(table(spark, sf_dir, "events"), name="events", as_of=AS_OF)
    return _section_rows(results, COUNTED_SECTIONS)


@query("pipeline_all_sections")
def pipeline_all_sections(spark, sf_dir):
    """Rows of every section of a full analysis; a broad smoke check."""
    results = analyze(table(spark, sf_dir, "documents"), name="documents", as_of=AS_OF)
    return _section_rows(results, list(results.sections()))
