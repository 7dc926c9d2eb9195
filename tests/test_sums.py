"""Sums that do not depend on order, against exact fractions."""

import math
import random
from fractions import Fraction

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from autoprofile.operators.charts import kpi_card
from autoprofile.operators.numbers import distributions
from autoprofile.operators.segments import segment_rollup
from autoprofile.operators.series import period_series
from autoprofile.operators.sums import exact_sums, exact_totals, summable_columns

RANDOM = random.Random(11)
CASES = {
    "money": [round(RANDOM.uniform(900, 100_000), 2) for _ in range(4000)],
    "cancelling": [1e300, 1.0, -1e300, 1e-300, 3.5, -3.5],
    "only the tail is left": [2.0**60, 0.1, -(2.0**60)],
    "all powers": [RANDOM.choice((-1, 1)) * 2.0 ** RANDOM.randint(-1074, 1010) for _ in range(900)],
    "edges of windows": [
        x * s
        for k in range(-18, 18)
        for b in (2.0 ** max(-1074, 60 * k - 30),)
        for x in (b, math.nextafter(b, 0), math.nextafter(b, math.inf))
        for s in (1, -0.5)
    ],
    "denormal": [5e-324] * 7 + [-5e-324] * 2 + [2.2e-308],
    "largest": [1.7e308, 1.7e308, -1.7e308, -1e308],
    "minus one at the end": [-(2.0**-90), 2.0**40, -(2.0**40)],
    "zeros": [0.0, -0.0, 0.0],
    "one": [0.1],
}


def frame(spark, values, parts):
    rows = [(None if v is None else float(v),) for v in values]
    return spark.createDataFrame(rows, "v double").repartition(parts)


def total(df):
    return exact_totals(df, {"v": F.col("v")}).first()["total"]


def near(found, values):
    exact = sum(map(Fraction, values))
    return abs(Fraction(found) - exact) <= Fraction(math.ulp(float(exact)))


@pytest.mark.parametrize("name", CASES)
def test_totals_are_exact_and_have_no_order(spark, name):
    values = CASES[name]
    first = total(frame(spark, values, 1))
    assert near(first, values)
    mixed = RANDOM.sample(values, len(values))
    for parts, order in ((3, mixed), (7, sorted(values))):
        assert total(frame(spark, order, parts)).hex() == first.hex()


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.floats(allow_nan=False, allow_infinity=False, width=64,
                          min_value=-1e305, max_value=1e305), min_size=1, max_size=60))
def test_any_finite_values(spark, values):
    assert near(total(frame(spark, values, 2)), values)


@pytest.mark.parametrize(
    "values, expected",
    [
        ([1.0, math.inf], math.inf),
        ([-math.inf, 1e300], -math.inf),
        ([math.inf, -math.inf], math.nan),
        ([1.7e308, 1.7e308], math.inf),
        ([None, None], None),
        ([None, 2.0], 2.0),
    ],
)
def test_infinite_and_missing_values(spark, values, expected):
    found = total(frame(spark, values, 2))
    assert found == expected or (expected is not None and math.isnan(expected) and math.isnan(found))


def test_empty_tables(spark):
    empty = frame(spark, [], 1)
    assert exact_totals(empty, {"v": F.col("v")}).count() == 0
    row = exact_sums(empty, [], ["v"]).first()
    assert (row["rows"], row["v_total"], row["v_count"]) == (0, None, 0)


def test_groups_with_measures_in_several_windows(spark):
    rows = [
        (k, RANDOM.choice((1e-200, 0.5, 3e12)) * RANDOM.random(),
         None if RANDOM.random() < 0.2 else RANDOM.uniform(-1e6, 1e6))
        for k in "abbc" * 50
    ]
    df = spark.createDataFrame(rows, "k string, `a.b` double, b double")
    for row in exact_sums(df.repartition(5), ["k"], ["a.b", "b"]).collect():
        mine = [r for r in rows if r[0] == row["k"]]
        assert row["rows"] == len(mine)
        for place, name in ((1, "a.b"), (2, "b")):
            values = [r[place] for r in mine if r[place] is not None]
            assert row[f"{name}_count"] == len(values)
            assert near(row[f"{name}_total"], values)


def test_operators_take_these_sums(spark):
    rows = [("x", f"2024-01-{i % 28 + 1:02d}", v) for i, v in enumerate(CASES["cancelling"] * 3)]
    df = spark.createDataFrame(rows, "s string, d string, v double").repartition(4)
    df = df.withColumn("d", F.col("d").cast("date"))
    values = [r[2] for r in rows]
    assert near(distributions(df, ["v"])[0].sum, values)
    assert segment_rollup(df, "s", "v", digits=10).first()["total"] == 3.0
    assert kpi_card(df, ["v"]).first()["total"] == 3.0
    series = period_series(df, ["d"], ["v"])
    assert series.first()["value"] == math.fsum(values)


def test_one_row_per_group_and_window_is_shuffled(spark):
    """The first exchange carries partial sums, not rows."""
    df = spark.range(1000).select(F.col("id").cast("double").alias("v"), (F.col("id") % 3).alias("k"))
    plan = exact_sums(df, ["k"], ["v"])._jdf.queryExecution().executedPlan().toString()
    assert plan.index("partial_sum") > plan.index("Exchange hashpartitioning(k")
    assert "Python" not in plan


def test_exact_types_are_summed_as_they_are(spark):
    """Whole numbers and decimals, alone and beside doubles, in one exchange where alone."""
    rows = 3000
    df = spark.range(rows).selectExpr(
        "id % 7 AS k", "9007199254740993 + id AS big", "cast(id % 256 - 128 AS tinyint) AS small",
        "cast(id AS decimal(22,2)) + 0.1 AS money", "id * 0.1D AS d",
        "CASE WHEN id % 7 > 1 THEN cast(id AS int) END AS gap",
    )
    names = ["big", "small", "money", "gap"]
    exact = df.select("k", *[v.alias(n) for n, v in summable_columns(df, names).items()], "d")
    alone = exact_sums(exact, ["k"], names)
    assert alone._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    mixed = {r["k"]: r for r in exact_sums(exact, ["k"], ["big", "d", *names[1:]]).collect()}
    for row in alone.collect():
        ids = [i for i in range(rows) if i % 7 == row["k"]]
        big = sum(9007199254740993 + i for i in ids)
        money = sum(Fraction(10 * i + 1, 10) for i in ids)
        small = sum(i % 256 - 128 for i in ids)
        assert (row["rows"], row["big_total"], row["small_total"]) == (len(ids), float(big), small)
        assert row["money_total"] == float(money)
        gap = (None, 0) if row["k"] < 2 else (sum(ids), len(ids))
        assert (row["gap_total"], row["gap_count"]) == gap
        other = mixed[row["k"]]
        assert [other[c] for c in alone.columns] == list(row)
        assert near(other["d_total"], [i * 0.1 for i in ids])
    empty = exact_sums(exact.limit(0), [], names).first()
    assert (empty["rows"], empty["big_total"], empty["big_count"]) == (0, None, 0)
