"""Business types and the data dictionary."""

from pyspark.sql import functions as F

from autoprofile.config import Config, SchemaRules
from autoprofile.functions.coerce import as_number, text_number
from autoprofile.operators.catalog import (
    column_catalog,
    distinct_profile,
    infer_types,
    select_analysis_columns,
    truth_word,
    type_distribution,
)
from autoprofile.operators.dates import date_columns, with_timestamps
from driver_queries.inputs import (
    GAPPY_LINES_SQL,
    TEXT_ORDERS_COLUMNS,
    TEXT_ORDERS_SQL,
    gappy_lines,
    text_orders,
)
from driver_queries.registry import (
    COLUMNS,
    facts_sql,
    pct,
    query,
    r,
    sql_date,
    sql_date_count,
    sql_number,
    stripped,
    table,
    types_sql,
)

GAPPY_COLUMNS = [
    ("l_linenumber", "number"), ("l_shipdate", "datetime"), ("quantity", "double"),
    ("weight", "double"), ("discount", "double"), ("tax", "double"), ("returnflag", "string"),
    ("linestatus", "string"), ("fixed", "double"),
]


def _register_type_queries():
    for name, columns in COLUMNS.items():

        def infer(spark, sf_dir, name=name):
            return infer_types(table(spark, sf_dir, name))

        query(
            f"infer_types_{name}",
            f"SELECT column_name, inferred_type FROM ({types_sql(name, columns)}) AS c",
        )(infer)


_register_type_queries()


@query(
    "infer_types_text",
    f"""SELECT column_name, inferred_type
        FROM ({types_sql(TEXT_ORDERS_SQL + ' AS t', TEXT_ORDERS_COLUMNS)}) AS c""",
)
def infer_types_text(spark, sf_dir):
    return infer_types(text_orders(spark, sf_dir))


@query(
    "infer_types_gaps",
    f"""SELECT column_name, inferred_type
        FROM ({types_sql(GAPPY_LINES_SQL + ' AS t', GAPPY_COLUMNS)}) AS c""",
)
def infer_types_gaps(spark, sf_dir):
    return infer_types(gappy_lines(spark, sf_dir))


@query(
    "infer_types_measures",
    f"""SELECT column_name, CASE WHEN column_name = 'o_custkey' THEN 'identifier'
          WHEN column_name = 'o_totalprice' THEN 'numeric' ELSE inferred_type END AS inferred_type
        FROM ({types_sql('orders', COLUMNS['orders'])}) AS c""",
)
def infer_types_measures(spark, sf_dir):
    rules = SchemaRules(type_overrides={"o_custkey": "identifier"}, float_identifiers=False)
    return infer_types(table(spark, sf_dir, "orders"), Config(schema=rules))


# sketches decide only far from a threshold, so the types equal the exact ones
@query(
    "infer_types_approx",
    f"SELECT column_name, inferred_type FROM ({types_sql('lineitem', COLUMNS['lineitem'])}) AS c",
)
def infer_types_approx(spark, sf_dir):
    rules = SchemaRules(distinct="approx")
    return infer_types(table(spark, sf_dir, "lineitem"), Config(schema=rules))


def _samples_sql(source, columns):
    parts = [
        f"SELECT '{name}' AS column_name, string_agg(cast(v AS VARCHAR), '|' ORDER BY v) AS samples "
        f"FROM (SELECT DISTINCT {name} AS v FROM {source} WHERE {name} IS NOT NULL "
        f"ORDER BY v LIMIT 5) AS d"
        for name, kind in columns
        if kind != "nested"
    ]
    return "\nUNION ALL ".join(parts)


def _dictionary_sql(source, columns):
    return f"""
WITH typed AS ({types_sql(source, columns)}), samples AS ({_samples_sql(source, columns)})
SELECT t.column_name, t.ordinal, t.inferred_type, t.total_rows,
  t.total_rows - t.present AS null_count, t.present AS non_null_count,
  {pct('t.total_rows - t.present', 't.total_rows')} AS null_pct,
  round(100 - {pct('t.total_rows - t.present', 't.total_rows')}, 2) AS non_null_pct,
  t.unique_count, {r('coalesce(t.ratio, 0)')} AS unique_ratio,
  coalesce(s.samples, '') AS samples, t.ignore,
  CASE t.inferred_type WHEN 'empty' THEN 'Column is fully empty'
    WHEN 'constant' THEN concat('Column has only one unique value: ', s.samples)
    WHEN 'identifier' THEN concat('High-cardinality identifier column (unique ratio=',
      format('{{:.2f}}', t.ratio * 100), '%)')
    WHEN 'nested' THEN 'Nested type' ELSE '' END AS ignore_reason
FROM typed AS t LEFT JOIN samples AS s USING (column_name)"""


def _flat_dictionary(df):
    return column_catalog(df).select(
        "column_name", "ordinal", "inferred_type", "total_rows", "null_count", "non_null_count",
        "null_pct", "non_null_pct", "unique_count", "unique_ratio",
        F.array_join("sample_values", "|").alias("samples"), "ignore", "ignore_reason",
    )


@query("data_dictionary", _dictionary_sql("customer", COLUMNS["customer"]))
def data_dictionary(spark, sf_dir):
    return _flat_dictionary(table(spark, sf_dir, "customer"))


@query(
    "data_dictionary_gaps",
    _dictionary_sql(GAPPY_LINES_SQL + " AS t", [c for c in GAPPY_COLUMNS if c[1] != "datetime"]),
)
def data_dictionary_gaps(spark, sf_dir):
    # the time column is left out: the two engines write timestamps differently as text
    return _flat_dictionary(gappy_lines(spark, sf_dir).drop("l_shipdate"))


@query(
    "anomalies",
    f"""SELECT column_name, 'Numeric values stored as text; will be coerced during analysis.'
          AS anomaly FROM ({types_sql(TEXT_ORDERS_SQL + ' AS t', TEXT_ORDERS_COLUMNS)}) AS c
        WHERE kind = 'string' AND not_word > 0 AND dates / present < 0.85
          AND numbers / present >= 0.9
        UNION ALL
        SELECT column_name, concat('Mixed datetime parsing success (',
          cast(round(dates / present * 100) AS INTEGER), '%); may be noisy dates.')
        FROM ({types_sql(TEXT_ORDERS_SQL + ' AS t', TEXT_ORDERS_COLUMNS)}) AS c
        WHERE kind = 'string' AND not_word > 0 AND dates > 0 AND dates / present < 0.85""",
)
def anomalies(spark, sf_dir):
    orders = text_orders(spark, sf_dir)
    catalog = column_catalog(orders)
    return catalog.select("column_name", F.explode("anomalies").alias("anomaly"))


@query(
    "type_distribution",
    f"""SELECT inferred_type, count(*) AS columns
        FROM ({types_sql('lineitem', COLUMNS['lineitem'])}) AS c GROUP BY inferred_type""",
)
def types_of_lines(spark, sf_dir):
    return type_distribution(column_catalog(table(spark, sf_dir, "lineitem")))


@query(
    "distinct_counts",
    f"SELECT ordinal, unique_count FROM ({facts_sql('lineitem', COLUMNS['lineitem'])}) AS f",
)
def distinct_counts(spark, sf_dir):
    return distinct_profile(table(spark, sf_dir, "lineitem")).select("ordinal", "unique_count")


@query(
    "distinct_texts",
    f"SELECT ordinal, unique_count FROM ({facts_sql('documents', COLUMNS['documents'])}) AS f",
)
def distinct_texts(spark, sf_dir):
    return distinct_profile(table(spark, sf_dir, "documents")).select("ordinal", "unique_count")


@query(
    "sample_values",
    f"SELECT * FROM ({_samples_sql('part', COLUMNS['part'])}) AS s",
)
def sample_values(spark, sf_dir):
    return column_catalog(table(spark, sf_dir, "part")).select(
        "column_name", F.array_join("sample_values", "|").alias("samples")
    )


@query(
    "sample_texts",
    """SELECT 'text' AS column_name, string_agg(text, '|' ORDER BY text) AS samples FROM (
         SELECT DISTINCT text FROM documents ORDER BY text LIMIT 5) AS d""",
)
def sample_texts(spark, sf_dir):
    return column_catalog(table(spark, sf_dir, "documents").select("text")).select(
        "column_name", F.array_join("sample_values", "|").alias("samples")
    )


@query(
    "ignored_columns",
    f"""SELECT column_name, inferred_type
        FROM ({types_sql('orders', COLUMNS['orders'])}) AS c WHERE ignore""",
)
def ignored_columns(spark, sf_dir):
    catalog = column_catalog(table(spark, sf_dir, "orders"))
    return catalog.where("ignore").select("column_name", "inferred_type")


@query("analysis_columns", "SELECT c_nationkey, c_mktsegment FROM customer")
def analysis_columns(spark, sf_dir):
    customers = table(spark, sf_dir, "customer")
    return select_analysis_columns(customers, column_catalog(customers))


# ------------------------------------------------------------------ coercions


@query(
    "text_number_check",
    f"""SELECT count(*) AS n_rows, count({sql_number('price')}) AS with_commas,
        count(CASE WHEN regexp_matches({stripped('price')}, '^[+-]?(\\d+\\.?\\d*|\\.\\d+)$')
          THEN 1 END) AS without_commas,
        count({sql_number('mixed')}) AS mixed_numbers,
        {r("sum(" + sql_number('price') + ")", 2)} AS total
        FROM {TEXT_ORDERS_SQL} AS t""",
)
def text_number_check(spark, sf_dir):
    orders = text_orders(spark, sf_dir)
    price = as_number("price", orders.schema["price"].dataType)
    return orders.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count(price).alias("with_commas"),
        F.count(text_number(F.col("price"), strip_commas=False)).alias("without_commas"),
        F.count(as_number("mixed", orders.schema["mixed"].dataType)).alias("mixed_numbers"),
        F.round(F.sum(price), 2).alias("total"),
    )


ORDERED_SQL = sql_date("ordered", TEXT_ORDERS_SQL + " AS o")


@query(
    "text_date_check",
    f"""SELECT count(*) AS n_rows, count({ORDERED_SQL}) AS dates,
        {sql_date_count('mixed')} AS mixed_dates,
        cast(min({ORDERED_SQL}) AS DATE) AS first_day,
        cast(max({ORDERED_SQL}) AS DATE) AS last_day
        FROM {TEXT_ORDERS_SQL} AS t""",
)
def text_date_check(spark, sf_dir):
    orders = text_orders(spark, sf_dir)
    dates = date_columns(orders, ["ordered", "mixed"])
    return orders.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count(dates["ordered"]).alias("dates"),
        F.count(dates["mixed"]).alias("mixed_dates"),
        F.to_date(F.min(dates["ordered"])).alias("first_day"),
        F.to_date(F.max(dates["ordered"])).alias("last_day"),
    )


# every third date has a day that could be a month: only the whole column tells which it is
@query(
    "text_dates_day_first",
    """SELECT strftime(o_orderdate, '%Y-%m') AS period, count(*) AS orders FROM orders
       GROUP BY period""",
)
def text_dates_day_first(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(
        F.date_format("o_orderdate", "dd/MM/yyyy").alias("day")
    )
    days = with_timestamps(orders, ["day"])
    return days.groupBy(F.date_format("day", "yyyy-MM").alias("period")).agg(
        F.count("day").alias("orders")
    )


@query(
    "text_boolean_check",
    f"""SELECT bool_and(lower({stripped('finished')}) IN ('true','yes','1','y','t','false','no',
          '0','n','f')) AS finished,
        bool_and(lower({stripped('priority')}) IN ('true','yes','1','y','t','false','no','0',
          'n','f')) AS priority,
        count(*) FILTER (lower({stripped('mixed')}) IN ('true','yes','1','y','t','false','no',
          '0','n','f')) AS mixed_words
        FROM {TEXT_ORDERS_SQL} AS t""",
)
def text_boolean_check(spark, sf_dir):
    rules = SchemaRules()
    words = (*rules.true_words, *rules.false_words)
    return text_orders(spark, sf_dir).agg(
        F.bool_and(truth_word(F.col("finished"), words)).alias("finished"),
        F.bool_and(truth_word(F.col("priority"), words)).alias("priority"),
        F.count_if(truth_word(F.col("mixed"), words)).alias("mixed_words"),
    )
