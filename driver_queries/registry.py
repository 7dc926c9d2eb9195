"""The registry, table access, and SQL fragments used by many queries."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from autoprofile.functions.coerce import WHITESPACE
from autoprofile.sources.sinks import shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function as query ``name``, with its SQL twin if there is one."""

    def add(function):
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql
        return function

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new folder on shared storage: below the checkpoint folder the cluster names.  A session
    on one machine without that setting gets one below the warehouse."""
    base = shared_folder(spark)
    if not base:
        if not spark.conf.get("spark.master").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    return f"{base}/{uuid.uuid4().hex}"


# ------------------------------------------------------------------ SQL fragments

NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
ISO_DATE = (
    r"^\d{4}-\d{1,2}-\d{1,2}([ T]\d{1,2}:\d{2}(:\d{2}(\.\d{1,9})?)?(Z|[+-]\d{2}:\d{2})?)?$"
)
TRUTH = "('true','yes','1','y','t','false','no','0','n','f')"


def r(expression: str, digits: int = 4) -> str:
    """Rounded, and never negative zero."""
    return f"(round({expression}, {digits}) + 0.0)"


def pct(part: str, whole: str, digits: int = 2) -> str:
    return (
        f"(round(coalesce(cast({part} AS DOUBLE) * 100 / nullif(cast({whole} AS DOUBLE), 0), 0),"
        f" {digits}) + 0.0)"
    )


def stripped(column: str) -> str:
    return f"trim({column}, '{WHITESPACE}')"


def sql_number(column: str) -> str:
    plain = f"trim(replace({stripped(column)}, ',', ''), '{WHITESPACE}')"
    return (
        f"CASE WHEN regexp_matches({stripped(column)}, '^[+\\-.,\\d]') "
        f"AND regexp_matches({plain}, '{NUMBER}') THEN try_cast({plain} AS DOUBLE) END"
    )


def sql_layouts(column: str) -> list[str]:
    """The date that a text writes, for each layout the inputs have, in documented order."""
    text = stripped(column)
    return [
        f"CASE WHEN regexp_matches({text}, '{ISO_DATE}') THEN try_cast({text} AS TIMESTAMP) END",
        f"CASE WHEN regexp_matches({text}, '^\\d{{1,2}}/\\d{{1,2}}/\\d{{4}}$') "
        f"THEN try_strptime({text}, '%m/%d/%Y') END",
        f"CASE WHEN regexp_matches({text}, '^\\d{{1,2}}/\\d{{1,2}}/\\d{{4}}$') "
        f"THEN try_strptime({text}, '%d/%m/%Y') END",
        f"CASE WHEN regexp_matches({text}, '^\\d{{1,2}} [A-Z][a-z]{{2}} \\d{{4}}$') "
        f"THEN try_strptime({text}, '%d %b %Y') END",
    ]


def sql_any_date(column: str) -> str:
    """A date in any layout."""
    return f"coalesce({', '.join(sql_layouts(column))})"


def sql_date_count(column: str) -> str:
    """Aggregate: values in the layout that most of the column has."""
    return f"greatest({', '.join(f'count({x})' for x in sql_layouts(column))})"


def sql_date(column: str, source: str) -> str:
    """A date in the layout that most of the column of ``source`` has, the first of equals."""
    layouts = sql_layouts(column)
    counts = ", ".join(f"count({x}) AS n{i}" for i, x in enumerate(layouts))
    most = f"greatest({', '.join(f'n{i}' for i in range(len(layouts)))})"
    chosen = " ".join(f"WHEN n{i} = {most} THEN {i}" for i in range(len(layouts)))
    layout = f"(SELECT CASE {chosen} END FROM (SELECT {counts} FROM {source}) AS counted)"
    picked = " ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(layouts))
    return f"CASE {layout} {picked} END"


def facts_sql(source: str, columns: list[tuple[str, str]]) -> str:
    """One row per column with the counts the type decision needs.

    ``columns``: (name, kind) with kind number, double, datetime, boolean, string or nested.
    """
    parts = []
    for ordinal, (name, kind) in enumerate(columns):
        number, text = kind in ("number", "double"), kind == "string"
        unique = "0" if kind == "nested" else f"count(DISTINCT {name})"
        beyond = f"count(*) FILTER ({name} NOT IN (0, 1))" if number else "NULL"
        words = f"lower({stripped(name)})"
        miss = f"count(*) FILTER ({words} NOT IN {TRUTH})" if text else "NULL"
        dates = sql_date_count(name) if text else "NULL"
        numbers = f"count({sql_number(name)})" if text else "NULL"
        parts.append(
            f"SELECT {ordinal} AS ordinal, '{name}' AS column_name, "
            f"'{'number' if number else kind}' AS kind, count(*) AS total_rows, "
            f"count({name}) AS present, {unique} AS unique_count, {beyond} AS beyond, "
            f"{miss} AS not_word, {dates} AS dates, {numbers} AS numbers FROM {source}"
        )
    return "\nUNION ALL ".join(parts)


def types_sql(source: str, columns: list[tuple[str, str]]) -> str:
    """The facts with inferred_type and ignore added."""
    number_type = (
        "CASE WHEN ratio >= 0.95 AND unique_count > 50 THEN 'identifier' "
        "WHEN unique_count <= 2 AND beyond = 0 THEN 'boolean' "
        "WHEN ratio <= 0.20 AND unique_count <= 30 THEN 'categorical' ELSE 'numeric' END"
    )
    return f"""
SELECT *, inferred_type IN ('empty', 'constant', 'identifier', 'nested') AS ignore
FROM (
  SELECT *, CASE
    WHEN present = 0 THEN 'empty'
    WHEN kind = 'nested' THEN 'nested'
    WHEN unique_count <= 1 THEN 'constant'
    WHEN kind = 'boolean' THEN 'boolean'
    WHEN kind = 'number' THEN {number_type}
    WHEN kind = 'datetime' THEN 'datetime'
    WHEN not_word = 0 THEN 'boolean'
    WHEN dates / present >= 0.85 THEN 'datetime'
    WHEN numbers / present >= 0.90 THEN {number_type}
    WHEN ratio >= 0.95 AND present > 100 THEN 'identifier'
    WHEN ratio <= 0.20 THEN 'categorical'
    ELSE 'text' END AS inferred_type
  FROM (SELECT *, cast(unique_count AS DOUBLE) / nullif(present, 0) AS ratio
        FROM ({facts_sql(source, columns)}) AS counted) AS shares
) AS typed"""


# (column, kind) of the shared tables
COLUMNS: dict[str, list[tuple[str, str]]] = {
    "region": [("r_regionkey", "number"), ("r_name", "string")],
    "nation": [("n_nationkey", "number"), ("n_name", "string"), ("n_regionkey", "number")],
    "customer": [("c_custkey", "number"), ("c_name", "string"), ("c_nationkey", "number"),
                 ("c_acctbal", "double"), ("c_mktsegment", "string")],
    "supplier": [("s_suppkey", "number"), ("s_name", "string"), ("s_nationkey", "number"),
                 ("s_acctbal", "double")],
    "part": [("p_partkey", "number"), ("p_name", "string"), ("p_brand", "string"),
             ("p_type", "string"), ("p_size", "number"), ("p_retailprice", "double")],
    "orders": [("o_orderkey", "number"), ("o_custkey", "number"), ("o_orderstatus", "string"),
               ("o_totalprice", "double"), ("o_orderdate", "datetime"),
               ("o_orderpriority", "string")],
    "lineitem": [("l_orderkey", "number"), ("l_partkey", "number"), ("l_suppkey", "number"),
                 ("l_linenumber", "number"), ("l_quantity", "double"),
                 ("l_extendedprice", "double"), ("l_discount", "double"), ("l_tax", "double"),
                 ("l_returnflag", "string"), ("l_linestatus", "string"),
                 ("l_shipdate", "datetime")],
    "events": [("event_id", "number"), ("ts", "datetime"), ("user_id", "number"),
               ("event_type", "string"), ("value", "double"), ("props", "string")],
    "documents": [("doc_id", "number"), ("text", "string"), ("lang", "string"),
                  ("source", "string"), ("n_chars", "number")],
    "embeddings": [("vec_id", "number"), ("embedding", "nested"), ("label", "number")],
    "pages": [("page_id", "number"), ("url", "string"), ("html", "string")],
    "benchmark": [("item_id", "number"), ("text", "string")],
    "labels": [("doc_id", "number"), ("quality", "number"), ("toxic", "number")],
    "conversations": [("conv_id", "number"), ("turn", "number"), ("role", "string"),
                      ("text", "string")],
}
