"""Derived inputs, built the same way in Spark and in SQL.

The shared tables hold no nulls, no copies and no untidy texts, so operators that deal with
those get a table with a rule-made share of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driver_queries.registry import table

# ---- lineitem with gaps and a column that nearly repeats another one

GAPPY_LINES_SQL = """(
SELECT l_linenumber, l_shipdate,
  CASE WHEN l_linenumber % 7 <> 0 THEN l_quantity END AS quantity,
  l_quantity * 2 + l_tax AS weight,
  l_discount AS discount,
  CASE WHEN l_linenumber % 5 = 0 THEN l_tax END AS tax,
  CASE WHEN l_linenumber <> 3 THEN l_returnflag END AS returnflag,
  l_linestatus AS linestatus,
  5.0::DOUBLE AS fixed
FROM lineitem)"""


def gappy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.col("l_linenumber")
    return table(spark, sf_dir, "lineitem").select(
        "l_linenumber",
        "l_shipdate",
        F.when(number % 7 != 0, F.col("l_quantity")).alias("quantity"),
        (F.col("l_quantity") * 2 + F.col("l_tax")).alias("weight"),
        F.col("l_discount").alias("discount"),
        F.when(number % 5 == 0, F.col("l_tax")).alias("tax"),
        F.when(number != 3, F.col("l_returnflag")).alias("returnflag"),
        F.col("l_linestatus").alias("linestatus"),
        F.lit(5.0).alias("fixed"),
    )


# ---- orders read as text: numbers with commas, dates in two layouts, yes and no

TEXT_ORDERS_SQL = """(
SELECT o_orderkey,
  CASE WHEN o_orderkey % 50 = 0 THEN 'n/a'
       ELSE concat(' ', format('{:,.2f}', o_totalprice)) END AS price,
  CASE WHEN o_orderkey % 20 = 0 THEN strftime(o_orderdate, '%m/%d/%Y')
       WHEN o_orderkey % 33 = 0 THEN 'unknown'
       ELSE strftime(o_orderdate, '%Y-%m-%d') END AS ordered,
  CASE o_orderstatus WHEN 'F' THEN 'Yes' WHEN 'O' THEN 'no ' ELSE ' TRUE' END AS finished,
  CASE WHEN o_orderkey % 3 = 0 THEN upper(o_orderpriority)
       WHEN o_orderkey % 3 = 1 THEN concat(lower(o_orderpriority), ' ')
       ELSE o_orderpriority END AS priority,
  CASE o_orderkey % 6 WHEN 0 THEN 'abc' WHEN 1 THEN '123' WHEN 2 THEN 'true'
       WHEN 3 THEN '3.14' WHEN 4 THEN '1.5d' ELSE '2024-02-29' END AS mixed,
  concat('ref ', o_orderkey % 10) AS note
FROM orders)"""

TEXT_ORDERS_COLUMNS = [("o_orderkey", "number")] + [
    (c, "string") for c in ("price", "ordered", "finished", "priority", "mixed", "note")
]


def text_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, status, priority = F.col("o_orderkey"), F.col("o_orderstatus"), F.col("o_orderpriority")
    mixed = F.array(
        *[F.lit(v) for v in ("abc", "123", "true", "3.14", "1.5d", "2024-02-29")]
    )
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.when(key % 50 == 0, "n/a")
        .otherwise(F.concat(F.lit(" "), F.format_number("o_totalprice", 2)))
        .alias("price"),
        F.when(key % 20 == 0, F.date_format("o_orderdate", "MM/dd/yyyy"))
        .when(key % 33 == 0, "unknown")
        .otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
        .alias("ordered"),
        F.when(status == "F", "Yes").when(status == "O", "no ").otherwise(" TRUE")
        .alias("finished"),
        F.when(key % 3 == 0, F.upper(priority))
        .when(key % 3 == 1, F.concat(F.lower(priority), F.lit(" ")))
        .otherwise(priority)
        .alias("priority"),
        mixed[(key % 6).cast("int")].alias("mixed"),
        F.concat(F.lit("ref "), (key % 10).cast("string")).alias("note"),
    )


# ---- events with every third row of one type copied

COPIED_EVENTS_SQL = """(
SELECT event_type, value, props FROM events
UNION ALL
SELECT event_type, value, props FROM events WHERE event_id % 3 = 0)"""


def copied_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    names = ["event_type", "value", "props"]
    return events.select(*names).unionByName(events.where("event_id % 3 = 0").select(*names))
