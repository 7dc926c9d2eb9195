"""Every registered query against its SQL twin, and against plan rules."""

import contextlib
import io
import os

import duckdb
import pytest

import __spark_entry__ as entry
from driver_queries import QUERIES, SQL

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
SQL_TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
    "boolean": "BOOLEAN", "date": "DATE", "timestamp": "TIMESTAMP",
}
#: operators that would not scale, or would leave the JVM
FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "MapInPandas",
             "FlatMapGroups", "MapInArrow")

#: correlations are matrix products over Arrow batches, and files whose quoted cells hold line
#: breaks are cut into records line after line; nothing else leaves the JVM
IN_ARROW = ("correlation", "insights", "pipeline", "quoted_breaks")
ARROW_WORDS = ("MapInArrow", "FlatMapGroups")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return connection


def plan_of(frame):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        frame.explain()
    return out.getvalue()


def sortable(row):
    return tuple((v is None, str(v)) for v in row)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, executed_plans, name):
    frame = QUERIES[name](spark, SF_DIR)
    plan = plan_of(frame)
    allowed = ARROW_WORDS if any(word in name for word in IN_ARROW) else ()
    assert not [word for word in FORBIDDEN if word not in allowed and word in plan]
    columns = sorted(frame.columns)
    rows = sorted((tuple(r[c] for c in columns) for r in frame.collect()), key=sortable)
    assert rows
    # operators run jobs of their own before they return: those plans count as well
    ran = executed_plans()
    assert ran
    assert not [w for w in FORBIDDEN for p in ran if w not in allowed and w in p]
    sql = SQL.get(name)
    if sql is None:
        return
    relation = duck.sql(sql)
    assert sorted(relation.columns) == columns
    types = dict(zip(relation.columns, map(str, relation.types)))
    assert {c: SQL_TYPES[t] for c, t in frame.dtypes} == types
    places = [relation.columns.index(c) for c in columns]
    expected = sorted((tuple(r[i] for i in places) for r in relation.fetchall()), key=sortable)
    assert rows == expected


def test_every_sql_twin_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).columns[0] == "dimension_no"
