"""Roles, names, KPIs and their values."""

from pyspark.sql import functions as F

from autoprofile.config import BUSINESS_SYNONYMS, Config, SchemaRules, SemanticRules
from autoprofile.operators.catalog import column_catalog
from autoprofile.operators.semantic import (
    build_semantic_layer,
    evaluate_kpis,
    kpi_catalog,
    lineage,
    semantic_fields,
    semantic_summary,
)
from driver_queries.registry import COLUMNS, query, r, table, types_sql

ROLE = """CASE WHEN inferred_type = 'datetime' THEN 'time' WHEN inferred_type = 'identifier'
  THEN 'entity' WHEN inferred_type = 'numeric' THEN 'measure' ELSE 'dimension' END"""
AVERAGES = "rate|ratio|average|avg|score|percent|pct|satisfaction|rating|age"
COUNTS = "count|cnt|num|number|id"
CURRENCY = "price|revenue|cost|amount|sales|profit|income"


def named_types(source, columns):
    return f"({types_sql(source, columns)}) AS c"


@query(
    "semantic_fields",
    f"""SELECT ordinal, column_name AS raw_column, column_name AS semantic_name,
        total_rows > present AS nullable, {ROLE} AS semantic_type,
        CASE WHEN inferred_type <> 'numeric' THEN NULL
          WHEN regexp_matches(column_name, '{AVERAGES}') THEN 'avg'
          WHEN regexp_matches(column_name, '{COUNTS}') THEN 'count' ELSE 'sum' END AS aggregation,
        CASE WHEN inferred_type <> 'numeric' THEN NULL
          WHEN regexp_matches(column_name, '{CURRENCY}') THEN 'currency'
          WHEN regexp_matches(column_name, 'pct|percent|rate|ratio') THEN 'percentage'
          ELSE 'number' END AS format,
        CASE WHEN inferred_type = 'datetime' THEN 'day|month|quarter|year' END AS granularities,
        CASE WHEN column_name IN ('event_type', 'props') THEN
          (SELECT string_agg(v, '|' ORDER BY v) FROM (
             SELECT DISTINCT event_type AS v, 'event_type' AS n FROM events
             UNION SELECT * FROM (SELECT DISTINCT props, 'props' FROM events
                                  ORDER BY 1 LIMIT 50)) AS d WHERE n = column_name) END
          AS listed
        FROM {named_types('events', COLUMNS['events'])} WHERE NOT ignore""",
)
def fields_of_events(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    fields = build_semantic_layer(events, column_catalog(events))
    return fields.select(
        "ordinal", "raw_column", "semantic_name", "nullable", "semantic_type", "aggregation",
        "format",
        F.array_join("granularities", "|").alias("granularities"),
        F.array_join("values", "|").alias("listed"),
    )


def _entities():
    return Config(semantic=SemanticRules(include_identifiers=True))


@query(
    "semantic_entities",
    f"""SELECT column_name AS raw_column,
        concat('Unique identifier: ', CASE column_name WHEN 'o_orderkey' THEN 'O Orderkey'
          ELSE 'O Totalprice' END) AS description
        FROM {named_types('orders', COLUMNS['orders'])} WHERE inferred_type = 'identifier'""",
)
def entities(spark, sf_dir):
    catalog = column_catalog(table(spark, sf_dir, "orders"))
    fields = semantic_fields(catalog, _entities())
    return fields.where("semantic_type = 'entity'").select("raw_column", "description")


@query(
    "lineage",
    f"""SELECT column_name AS raw_column, CASE column_name WHEN 'value' THEN 'amount'
          WHEN 'event_type' THEN 'event_category' ELSE column_name END AS semantic_name
        FROM {named_types('events', COLUMNS['events'])} WHERE NOT ignore""",
)
def names_by_token(spark, sf_dir):
    config = Config(semantic=SemanticRules(synonyms=BUSINESS_SYNONYMS))
    catalog = column_catalog(table(spark, sf_dir, "events"))
    return lineage(semantic_fields(catalog, config))


@query(
    "lineage_substring",
    f"""SELECT column_name AS raw_column, CASE column_name
          WHEN 'l_linenumber' THEN 'l_linequantityber' WHEN 'l_discount' THEN 'l_disquantity'
          ELSE column_name END AS semantic_name
        FROM {named_types('lineitem', COLUMNS['lineitem'])} WHERE NOT ignore""",
)
def names_by_substring(spark, sf_dir):
    rules = SemanticRules(synonyms=BUSINESS_SYNONYMS, match="substring")
    catalog = column_catalog(table(spark, sf_dir, "lineitem"))
    return lineage(semantic_fields(catalog, Config(semantic=rules)))


@query(
    "semantic_summary",
    f"""SELECT role AS semantic_type, count(column_name) AS fields,
        coalesce(string_agg(column_name, '|' ORDER BY ordinal), '') AS first_names
        FROM (VALUES ('dimension'), ('measure'), ('time'), ('entity')) AS roles(role)
        LEFT JOIN (SELECT *, {ROLE} AS has_role
                   FROM {named_types('lineitem', COLUMNS['lineitem'])} WHERE NOT ignore) AS f
          ON role = has_role
        GROUP BY role""",
)
def summary_of_roles(spark, sf_dir):
    fields = semantic_fields(column_catalog(table(spark, sf_dir, "lineitem")))
    summary = semantic_summary(fields, kpi_catalog(fields)).where("semantic_type <> 'kpi'")
    return summary.withColumn("first_names", F.array_join("first_names", "|"))


# ------------------------------------------------------------------ KPIs

SALES_SQL = """(
SELECT l_extendedprice AS order_amount, cast(l_quantity AS BIGINT) AS units_sold,
  l_tax * (l_linenumber + 10) AS tax_rate, l_returnflag AS flag, l_linestatus AS status
FROM lineitem)"""


def sales(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_extendedprice").alias("order_amount"),
        F.col("l_quantity").cast("bigint").alias("units_sold"),
        (F.col("l_tax") * (F.col("l_linenumber") + 10)).alias("tax_rate"),
        F.col("l_returnflag").alias("flag"),
        F.col("l_linestatus").alias("status"),
    )


def sales_kpis(spark, sf_dir):
    frame = sales(spark, sf_dir)
    rules = SchemaRules(float_identifiers=False)
    fields = build_semantic_layer(frame, column_catalog(frame, Config(schema=rules)))
    return frame, kpi_catalog(fields)


# the types behind these names follow from the generated data: three measures, two dimensions
@query(
    "kpi_catalog",
    """SELECT seq, name, formula, format FROM (VALUES
         (1, 'total_order_amount', 'SUM(order_amount)', 'currency'),
         (2, 'total_units_sold', 'SUM(units_sold)', 'number'),
         (3, 'avg_tax_rate', 'AVG(tax_rate)', 'percentage'),
         (4, 'revenue_per_unit', 'SUM(order_amount) / SUM(units_sold)', 'currency'),
         (5, 'record_count_by_flag', 'COUNT(*) GROUP BY flag', 'number'),
         (6, 'record_count_by_status', 'COUNT(*) GROUP BY status', 'number')
       ) AS k(seq, name, formula, format)""",
)
def kpis_of_sales(spark, sf_dir):
    return sales_kpis(spark, sf_dir)[1].select("seq", "name", "formula", "format")


@query(
    "kpi_totals",
    f"""SELECT 'total_order_amount' AS name, {r('sum(order_amount)', 2)} AS value
        FROM {SALES_SQL} AS t
        UNION ALL SELECT 'total_units_sold', {r('sum(units_sold)', 2)} FROM {SALES_SQL} AS t
        UNION ALL SELECT 'avg_tax_rate', {r('avg(tax_rate)', 2)} FROM {SALES_SQL} AS t
        UNION ALL SELECT 'revenue_per_unit',
          {r('sum(order_amount) / cast(sum(units_sold) AS DOUBLE)', 2)} FROM {SALES_SQL} AS t""",
)
def kpi_totals(spark, sf_dir):
    frame, kpis = sales_kpis(spark, sf_dir)
    values = evaluate_kpis(frame, kpis.where("operation <> 'count_by'"), digits=2)
    return values.select("name", "value")


@query(
    "kpi_count_by",
    f"""SELECT 'record_count_by_flag' AS name, flag AS segment, cast(count(*) AS DOUBLE) AS value
        FROM {SALES_SQL} AS t GROUP BY flag
        UNION ALL SELECT 'record_count_by_status', status, cast(count(*) AS DOUBLE)
        FROM {SALES_SQL} AS t GROUP BY status""",
)
def kpi_count_by(spark, sf_dir):
    frame, kpis = sales_kpis(spark, sf_dir)
    return evaluate_kpis(frame, kpis.where("operation = 'count_by'"))
