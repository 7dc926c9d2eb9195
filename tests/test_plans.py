"""What the physical plans must look like to hold at a much larger scale."""

import contextlib
import io
import re

import pytest

from autoprofile.functions.coerce import number_columns
from autoprofile.operators.charts import histogram
from autoprofile.operators.quantiles import Bracket, counted_cells
from autoprofile.operators.catalog import distinct_profile
from autoprofile.operators.correlation import _over_pairs, pearson
from autoprofile.operators.frequencies import top_values
from autoprofile.operators.segments import segment_grid
from autoprofile.operators.series import monthly_series
from autoprofile.operators.tables import duplicate_rows
from autoprofile.operators.wide import per_column
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def wide_table(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("wide") / "t.parquet")
    spark.range(1000).selectExpr(
        "id", "id % 5 AS d1", "concat('k', id % 50) AS d2", "id * 0.5 AS m1", "id * 0.25 AS m2",
        "timestamp_seconds(id * 86400) AS at", "repeat('text ', 100) AS long_text",
    ).write.parquet(path)
    return spark.read.parquet(path)


def plan_of(frame):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        frame.explain()
    return out.getvalue()


def read_columns(plan):
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", plan)
    return {name for s in schemas for name in re.findall(r"(\w+):", s)}


def test_grid_reads_and_shuffles_little(wide_table):
    plan = plan_of(segment_grid(wide_table, ["d1"], ["m1"]))
    assert read_columns(plan) == {"d1", "m1"}
    assert "partial_sum" in plan
    # ranks are limited per task before the second shuffle
    assert re.search(r"WindowGroupLimit.*Partial", plan)
    assert plan.count("Exchange hashpartitioning") == 2


def test_top_values_limit_before_the_shuffle(wide_table):
    plan = plan_of(top_values(wide_table, ["d1", "d2"]))
    assert read_columns(plan) == {"d1", "d2"}
    assert re.search(r"WindowGroupLimit.*Partial", plan)


def test_series_shuffles_periods_only(wide_table):
    plan = plan_of(monthly_series(wide_table, ["at"], ["m1", "m2"]))
    assert read_columns(plan) == {"at", "m1", "m2"}
    assert "partial_sum" in plan


def test_time_filter_reaches_the_scan(wide_table):
    plan = plan_of(monthly_series(wide_table.where("m1 > 100"), ["at"], ["m2"]))
    assert "GreaterThan(m1" in plan


def test_distinct_values_drop_repeats_before_the_shuffle(wide_table):
    plan = plan_of(distinct_profile(wide_table.select("long_text")))
    assert "sha2" in plan and "partial_count" in plan
    shuffled = [line for line in plan.splitlines() if "Exchange hashpartitioning(ordinal" in line]
    assert shuffled


def test_duplicates_shuffle_fingerprints_only(wide_table):
    plan = plan_of(duplicate_rows(wide_table))
    exchange = next(line for line in plan.splitlines() if "Exchange hashpartitioning" in line)
    assert "long_text" not in exchange and "fingerprint_a" in exchange


def test_correlation_needs_no_keyed_shuffle(wide_table):
    centred = wide_table.select(F.col("m1").alias("v0"), F.col("m2").alias("v1"))
    pairs = [(0, 0), (0, 1), (1, 1)]
    plan = plan_of(_over_pairs(centred, pairs, lambda x, y: [pearson(x, y).alias("r")]))
    assert "hashpartitioning" not in plan
    assert read_columns(plan) == {"m1", "m2"}


def test_very_wide_tables_are_split(spark):
    names = [f"c{i}" for i in range(250)]
    frame = spark.range(10).select(*[(F.col("id") + i).alias(n) for i, n in enumerate(names)])
    facts = [[F.lit(n).alias("column"), F.count(n).alias("n"), F.sum(n).alias("s")] for n in names]
    result = per_column(frame, facts, fields_per_column=2)
    assert result.count() == 250
    assert {r["column"]: r["s"] for r in result.collect()}["c249"] == 45 + 2490


def test_quantile_rounds_do_not_grow_with_the_columns(spark):
    names = [f"c{i}" for i in range(100)]
    frame = spark.range(10).select(*[(F.col("id") + i).cast("double").alias(n)
                                     for i, n in enumerate(names)])
    brackets = [Bracket(n, float(i), float(i + 9), 10, 0, (2, 5)) for i, n in enumerate(names)]
    cells = counted_cells(frame, number_columns(frame, names), brackets)
    plan = plan_of(cells)
    assert "Generate" not in plan and "partial_count" in plan
    assert plan.count("CASE WHEN") < 20
    assert cells.count() == 1000


def test_histograms_need_no_quartiles(wide_table):
    plan = plan_of(histogram(wide_table, ["m1", "m2"]))
    assert "percentile" not in plan
