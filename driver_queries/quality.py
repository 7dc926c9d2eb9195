"""Quality rules, issues and the score."""

import datetime as dt

from pyspark.sql import functions as F

from autoprofile.functions.coerce import INTEGER_PATTERN, nan_to_null
from autoprofile.operators.quality import (
    date_bounds,
    judge_columns,
    column_quality_of,
    mixed_shapes,
    quality_issues,
    quality_overview,
    quality_score,
    whitespace_values,
)
from autoprofile.operators.tables import null_profile
from driver_queries.inputs import (
    GAPPY_LINES_SQL,
    TEXT_ORDERS_SQL,
    gappy_lines,
    text_orders,
)
from driver_queries.numbers import nulls_sql, outliers_sql, population_skewness, variants_sql
from driver_queries.registry import (
    COLUMNS,
    pct,
    query,
    r,
    sql_any_date,
    sql_date,
    sql_number,
    stripped,
    table,
)

AS_OF = dt.datetime(1998, 6, 1)
AS_OF_SQL = "TIMESTAMP '1998-06-01 00:00:00'"


# ------------------------------------------------------------------ single checks


@query(
    "whitespace_values",
    "\nUNION ALL ".join(
        f"""SELECT '{n}' AS "column", count(*) FILTER ({n} <> {stripped(n)}) AS padded_count
        FROM {TEXT_ORDERS_SQL} AS t"""
        for n in ("price", "finished", "priority", "note")
    ),
)
def padded(spark, sf_dir):
    return whitespace_values(text_orders(spark, sf_dir), ["price", "finished", "priority", "note"])


@query(
    "whitespace_texts",
    f"""SELECT 'text' AS "column", count(*) FILTER (text <> {stripped('text')}) AS padded_count
        FROM documents""",
)
def padded_texts(spark, sf_dir):
    return whitespace_values(table(spark, sf_dir, "documents"), ["text"])


def shapes_sql(source, names):
    parts = []
    for n in names:
        text = stripped(n)
        shape = f"""CASE WHEN lower({text}) IN ('true', 'false') THEN 'bool'
          WHEN regexp_matches({text}, '{INTEGER_PATTERN}') THEN 'int'
          WHEN regexp_matches({text}, '^[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?$') THEN 'float'
          WHEN {sql_any_date(n)} IS NOT NULL THEN 'date' ELSE 'text' END"""
        parts.append(
            f"""SELECT '{n}' AS "column", {shape} AS shape FROM {source} WHERE {n} IS NOT NULL"""
        )
    shaped = "\nUNION ALL ".join(parts)
    counts = ", ".join(
        f"count(*) FILTER (shape = '{s}') AS {s}_count"
        for s in ("bool", "date", "float", "int", "text")
    )
    return f"""
SELECT *, CASE
    WHEN (bool_count > 0)::INT + (date_count > 0)::INT + (float_count > 0)::INT
       + (int_count > 0)::INT > 1 THEN 'mixed'
    WHEN (int_count > 0 OR float_count > 0) AND text_count > 0 THEN 'non_string'
    ELSE 'uniform' END AS verdict
FROM (SELECT "column", {counts} FROM ({shaped}) AS s GROUP BY "column") AS c"""


SHAPED = ["mixed", "note", "price", "ordered", "finished"]


@query("mixed_shapes", shapes_sql(TEXT_ORDERS_SQL + " AS t", SHAPED))
def shapes(spark, sf_dir):
    return mixed_shapes(text_orders(spark, sf_dir), SHAPED).drop("shapes")


@query("mixed_shapes_texts", shapes_sql("documents", ["text", "source"]))
def shapes_of_texts(spark, sf_dir):
    return mixed_shapes(table(spark, sf_dir, "documents"), ["text", "source"]).drop("shapes")


@query(
    "future_dates",
    f"""SELECT 'o_orderdate' AS "column",
        count(*) FILTER (o_orderdate > {AS_OF_SQL}) AS future_count,
        count(*) FILTER (o_orderdate < TIMESTAMP '1900-01-01') AS old_count FROM orders""",
)
def future_dates(spark, sf_dir):
    return date_bounds(table(spark, sf_dir, "orders"), ["o_orderdate"], AS_OF)


SHIFTED_SQL = """(SELECT CASE WHEN o_orderkey % 10 = 0
  THEN o_orderdate - INTERVAL 1200 MONTH ELSE o_orderdate END AS ordered FROM orders) AS t"""


@query(
    "old_dates",
    f"""SELECT 'ordered' AS "column", count(*) FILTER (ordered > {AS_OF_SQL}) AS future_count,
        count(*) FILTER (ordered < TIMESTAMP '1900-01-01') AS old_count FROM {SHIFTED_SQL}""",
)
def old_dates(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(
        F.expr(
            "CASE WHEN o_orderkey % 10 = 0 THEN o_orderdate - INTERVAL '1200' MONTH "
            "ELSE o_orderdate END"
        ).alias("ordered")
    )
    return date_bounds(orders, ["ordered"], AS_OF)


# ------------------------------------------------------------------ all rules


def issue_parts(source, numbers=(), times=(), texts=(), categories=(), everything=()):
    """SQL of the issues of typed columns: column, severity, rule, value."""
    parts = []
    for n in everything:
        share = pct(f"count(*) - count({n})", "count(*)")
        parts.append(
            f"""SELECT '{n}' AS "column", 'warning' AS severity, 'high_nulls' AS rule,
            {share} AS value FROM {source} HAVING {share} / 100 >= 0.5"""
        )
    for name, c in numbers:
        parts.append(
            f"""SELECT "column", 'warning', 'outliers', cast(iqr_outlier_count AS DOUBLE)
            FROM ({outliers_sql(source, [(name, c)])}) AS o WHERE iqr_outlier_count > 0"""
        )
        skew = r(population_skewness(c))
        parts.append(
            f"""SELECT '{name}', 'info', 'skewness', {skew} FROM {source}
            HAVING abs({skew}) > 1.0"""
        )
    for n, moment in times:
        parts.append(
            f"""SELECT '{n}', 'warning', 'future_dates',
            cast(count(*) FILTER ({moment} > {AS_OF_SQL}) AS DOUBLE) FROM {source}
            HAVING count(*) FILTER ({moment} > {AS_OF_SQL}) > 0"""
        )
    for n in texts:
        parts.append(
            f"""SELECT '{n}', 'info', 'edge_whitespace',
            cast(count(*) FILTER ({n} <> {stripped(n)}) AS DOUBLE) FROM {source}
            HAVING count(*) FILTER ({n} <> {stripped(n)}) > 0"""
        )
    for n in categories:
        parts.append(
            f"""SELECT "column", 'info', 'label_variants', cast(variants AS DOUBLE)
            FROM ({variants_sql(source, [n])}) AS v WHERE variants > 0"""
        )
        parts.append(
            f"""SELECT "column", 'warning', 'mixed_types', cast((bool_count > 0)::INT
            + (date_count > 0)::INT + (float_count > 0)::INT + (int_count > 0)::INT AS DOUBLE)
            FROM ({shapes_sql(source, [n])}) AS s WHERE verdict <> 'uniform'"""
        )
    return "\nUNION ALL ".join(parts)


EVENT_TYPES = [
    ("ts", "datetime"), ("user_id", "numeric"), ("event_type", "categorical"),
    ("value", "numeric"), ("props", "categorical"),
]
EVENT_ISSUES_SQL = issue_parts(
    "events",
    [(n, f"cast({n} AS DOUBLE)") for n in ("user_id", "value")],
    [("ts", "ts")],
    ["event_type", "props"],
    ["event_type", "props"],
    [c for c, _ in EVENT_TYPES],
)


@query("quality_issues", EVENT_ISSUES_SQL)
def issues_of_events(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return quality_issues(events, EVENT_TYPES, as_of=AS_OF).drop("message")


TEXT_TYPES = [
    ("price", "numeric"), ("ordered", "datetime"), ("finished", "boolean"),
    ("priority", "categorical"), ("mixed", "categorical"), ("note", "categorical"),
]
TEXT_ISSUES_SQL = issue_parts(
    TEXT_ORDERS_SQL + " AS t",
    [("price", f"({sql_number('price')})")],
    [("ordered", f"({sql_date('ordered', TEXT_ORDERS_SQL + ' AS o')})")],
    [c for c, _ in TEXT_TYPES],
    ["priority", "mixed", "note"],
    [c for c, _ in TEXT_TYPES],
)


@query("quality_issues_texts", TEXT_ISSUES_SQL)
def issues_of_texts(spark, sf_dir):
    orders = text_orders(spark, sf_dir).drop("o_orderkey")
    return quality_issues(orders, TEXT_TYPES, as_of=AS_OF).drop("message")


GAP_TYPES = [
    ("quantity", "numeric"), ("weight", "numeric"), ("tax", "numeric"),
    ("returnflag", "categorical"), ("linestatus", "categorical"),
]
GAP_NAMES = [c for c, _ in GAP_TYPES]
GAP_ISSUES_SQL = issue_parts(
    GAPPY_LINES_SQL + " AS t",
    [(n, n) for n in ("quantity", "weight", "tax")],
    categories=["returnflag", "linestatus"],
    texts=["returnflag", "linestatus"],
    everything=GAP_NAMES,
)


@query("quality_issues_gaps", GAP_ISSUES_SQL)
def issues_with_gaps(spark, sf_dir):
    lines = gappy_lines(spark, sf_dir).select(*GAP_NAMES)
    return quality_issues(lines, GAP_TYPES).drop("message")


@query(
    "high_null_columns",
    f"""SELECT "column", null_pct FROM ({nulls_sql(GAPPY_LINES_SQL + ' AS t', GAP_NAMES)}) AS n
        WHERE null_pct / 100 >= 0.5""",
)
def high_nulls(spark, sf_dir):
    lines = gappy_lines(spark, sf_dir).select(*GAP_NAMES)
    issues = quality_issues(lines, GAP_TYPES)
    return issues.where("rule = 'high_nulls'").select("column", F.col("value").alias("null_pct"))


def overview_sql(source, names, issues):
    return f"""
SELECT total_rows, {len(names)} AS total_columns, total_cells, total_nulls,
  {pct('total_nulls', 'total_cells')} AS overall_null_pct, total_issues, warnings, infos,
  0::BIGINT AS errors,
  {r('''greatest(0.0, least(100.0, 100.0 - cast(total_nulls AS DOUBLE) / total_cells * 40
    - 2 * warnings - 0.5 * infos))''', 1)} AS quality_score
FROM (SELECT max(total_rows) AS total_rows, cast(sum(total_rows) AS BIGINT) AS total_cells,
        cast(sum(null_count) AS BIGINT) AS total_nulls
      FROM ({nulls_sql(source, names)}) AS n) AS cells,
     (SELECT count(*) AS total_issues, count(*) FILTER (severity = 'warning') AS warnings,
        count(*) FILTER (severity = 'info') AS infos FROM ({issues}) AS i) AS found"""


@query("quality_score", overview_sql("events", [c for c, _ in COLUMNS["events"]], EVENT_ISSUES_SQL))
def score_of_events(spark, sf_dir):
    return quality_score(table(spark, sf_dir, "events"), EVENT_TYPES, as_of=AS_OF)


@query("quality_score_gaps", overview_sql(GAPPY_LINES_SQL + " AS t", GAP_NAMES, GAP_ISSUES_SQL))
def score_with_gaps(spark, sf_dir):
    lines = nan_to_null(gappy_lines(spark, sf_dir).select(*GAP_NAMES))
    return quality_overview(null_profile(lines), quality_issues(lines, GAP_TYPES))


@query(
    "column_quality",
    f"""SELECT n.*, round(100 - null_pct, 2) AS non_null_pct, coalesce(found, 0) AS issues,
        o.iqr_outlier_count, o.iqr_lower, o.iqr_upper
        FROM ({nulls_sql(GAPPY_LINES_SQL + ' AS t', GAP_NAMES)}) AS n
        LEFT JOIN (SELECT "column", cast(count(*) AS INTEGER) AS found
                   FROM ({GAP_ISSUES_SQL}) AS i GROUP BY "column") AS c USING ("column")
        LEFT JOIN ({outliers_sql(GAPPY_LINES_SQL + ' AS t',
                                 [(n, n) for n in ('quantity', 'weight', 'tax')])}) AS o
          USING ("column")""",
)
def quality_of_columns(spark, sf_dir):
    lines = gappy_lines(spark, sf_dir).select(*GAP_NAMES)
    judged = column_quality_of(judge_columns(lines, GAP_TYPES))
    return judged.select(
        "column", "total_rows", "null_count", "non_null_count", "null_pct", "non_null_pct",
        F.size("issues").alias("issues"),
        "outliers.iqr_outlier_count", "outliers.iqr_lower", "outliers.iqr_upper",
    )
