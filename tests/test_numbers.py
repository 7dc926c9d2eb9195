import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from autoprofile.functions.coerce import number_columns
from autoprofile.operators.charts import bin_count, histogram, histogram_notes
from autoprofile.operators.numbers import (
    box_stats,
    detect_outliers,
    distribution_moments,
    distributions,
    moments,
    numeric_summary,
)
from autoprofile.operators.quantiles import exact_quantiles
from autoprofile.operators.tables import (
    complete_rows,
    dataset_summary,
    datetime_summary,
    duplicate_rows,
    null_profile,
)
from autoprofile.operators.catalog import column_catalog

SHARES = (0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0)


def frame_of(spark, values, name="v"):
    return spark.createDataFrame([(float(v) if v is not None else None,) for v in values],
                                 f"{name} double")


def quantiles(frame, leaf_rows, name="v"):
    row = moments(frame, [name]).first()
    extents = {name: (row["count"], row["min"], row["max"])}
    return exact_quantiles(frame, number_columns(frame, [name]), extents, SHARES, leaf_rows)[name]


RNG = np.random.default_rng(7)
SAMPLES = {
    "uniform": RNG.uniform(-5, 5, 3000),
    "heavy tail": np.exp(RNG.normal(0, 12, 3000)),
    "both signs": RNG.normal(0, 1, 3000) * 10.0 ** RNG.integers(-8, 9, 3000),
    "one hot value": np.where(RNG.random(3000) < 0.6, 42.0, RNG.uniform(0, 100, 3000)),
    "huge": np.array([1.7e308, -1.7e308, 0.0, 5e-324, 1.0] * 50),
    "near": 1e9 + RNG.integers(0, 3000, 3000) * 1e-6,
    "few": np.array([3.0, 1.0, 2.0]),
    "single": np.array([4.0]),
    "negative": -np.exp(RNG.normal(0, 12, 1000)),
    "tiny": 10.0 ** RNG.uniform(-300, -200, 500),
}


@pytest.mark.parametrize("name", SAMPLES)
def test_narrowing_equals_sorting(spark, name):
    values = SAMPLES[name]
    expected = np.quantile(values, SHARES)
    found = quantiles(frame_of(spark, values).repartition(3), leaf_rows=10)
    np.testing.assert_allclose(found, expected, rtol=1e-12)


def test_infinite_values(spark):
    values = [math.inf, -math.inf, 1.0, 2.0, 3.0] * 20
    found = quantiles(frame_of(spark, values), leaf_rows=5)
    assert found[0] == -math.inf and found[-1] == math.inf and found[3] == 2.0


@settings(max_examples=8, deadline=None,
          suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(-1e15, 1e15), min_size=1, max_size=60), st.integers(1, 30))
def test_quantiles_of_any_list(spark, values, leaf_rows):
    found = quantiles(frame_of(spark, values), leaf_rows)
    np.testing.assert_allclose(found, np.quantile(values, SHARES), rtol=1e-9, atol=1e-9)


def test_columns_are_independent(spark):
    frame = spark.createDataFrame(
        [(float(i), None if i % 2 else float(-i), "1,0%02d" % i) for i in range(100)],
        "a double, b double, c string",
    )
    rows = {r["column"]: r for r in numeric_summary(frame, ["a", "b", "c"]).collect()}
    assert (rows["a"]["q1"], rows["a"]["median"], rows["a"]["q3"]) == (24.75, 49.5, 74.25)
    assert (rows["b"]["count"], rows["b"]["median"]) == (50, -49.0)
    assert (rows["c"]["min"], rows["c"]["max"]) == (1000.0, 1099.0)


def test_outlier_golden(spark):
    frame = frame_of(spark, [*range(1, 101), 9999], "val")
    row = detect_outliers(frame, ["val"]).first()
    assert row["iqr_outlier_count"] == 1
    assert (row["iqr_lower"], row["iqr_upper"]) == (-49.0, 151.0)
    assert row["zscore_outlier_count"] == 1
    assert round(distribution_moments(frame, ["val"]).first()["skewness"], 2) == 9.89


def test_moments_against_numpy(spark):
    values = RNG.gamma(2.0, 3.0, 500)
    row = distribution_moments(frame_of(spark, values), ["v"]).first()
    centred = values - values.mean()
    deviation = centred.std()
    assert row["std"] == round(values.std(ddof=1), 4)
    assert row["skewness"] == pytest.approx((centred**3).mean() / deviation**3, abs=1e-4)
    assert row["kurtosis"] == pytest.approx((centred**4).mean() / deviation**4 - 3, abs=1e-4)


def test_degenerate_columns(spark):
    frame = spark.createDataFrame(
        [(5.0, None, 1.0), (5.0, None, None)], "fixed double, empty double, single double"
    )
    rows = {r["column"]: r for r in numeric_summary(frame, ["fixed", "empty", "single"]).collect()}
    assert set(rows) == {"fixed", "single"}
    assert rows["fixed"]["std"] == 0.0 and rows["fixed"]["skewness"] is None
    assert rows["single"]["std"] is None and rows["single"]["median"] == 1.0
    outliers = {r["column"]: r for r in detect_outliers(frame, ["fixed", "empty"]).collect()}
    assert outliers["fixed"]["iqr_outlier_count"] == 0
    assert outliers["empty"]["iqr_lower"] is None
    assert box_stats(frame, ["fixed", "empty", "single"]).count() == 0


def test_constant_column_has_no_outliers(spark):
    row = detect_outliers(frame_of(spark, [3.0] * 10), ["v"]).first()
    assert (row["iqr_outlier_count"], row["zscore_outlier_count"]) == (0, 0)


def test_box_whiskers(spark):
    row = box_stats(frame_of(spark, [*range(1, 101), 9999]), ["v"]).first()
    assert (row["whisker_low"], row["whisker_high"], row["outliers"]) == (1.0, 100.0, 1)


def test_histogram_counts_every_value(spark):
    values = RNG.normal(0, 1, 400)
    rows = histogram(frame_of(spark, values), ["v"]).collect()
    counts, edges = np.histogram(values, bins=bin_count(400))
    assert [r["count"] for r in rows] == counts.tolist()
    np.testing.assert_allclose([r["bin_from"] for r in rows], edges[:-1], atol=1e-4)


def test_histogram_edge_cases(spark):
    assert histogram(frame_of(spark, [1.0, 2.0]), ["v"]).count() == 0
    rows = histogram(frame_of(spark, [7.0] * 6), ["v"]).collect()
    assert [r["count"] for r in rows][0] == 6 and sum(r["count"] for r in rows) == 6
    assert bin_count(100) == 20 and bin_count(10**12) == 50


def test_histogram_note(spark):
    values = RNG.exponential(1.0, 300)
    frame = frame_of(spark, values)
    row = histogram_notes(frame, distributions(frame, ["v"])).first()
    n, centred = 300, values - values.mean()
    population = (centred**3).mean() / centred.std() ** 3
    adjusted = population * math.sqrt(n * (n - 1)) / (n - 2)
    assert row["skewness"] == pytest.approx(adjusted, abs=1e-4)
    assert row["skewed"] == "right"


# ------------------------------------------------------------------ whole tables


def test_duplicate_rows(spark):
    frame = spark.createDataFrame(
        [(1, "x"), (2, "y"), (1, "x"), (3, "z"), (2, "y")], "a int, b string"
    )
    assert duplicate_rows(frame).first()["duplicate_rows"] == 2


def test_duplicates_tell_null_positions_apart(spark):
    nan = float("nan")
    frame = spark.createDataFrame(
        [(1.0, None), (None, 1.0), (None, 1.0), (nan, 1.0), (1.0, None), (None, None)],
        "a double, b double",
    )
    assert duplicate_rows(frame).first()["duplicate_rows"] == 3
    texts = spark.createDataFrame([("ab", "c"), ("a", "bc"), ("", "abc")], "a string, b string")
    assert duplicate_rows(texts).first()["duplicate_rows"] == 0
    nested = spark.createDataFrame(
        [([1, None],), ([None, 1],), ([1],), ([1],), (None,)], "a array<int>"
    )
    assert duplicate_rows(nested).first()["duplicate_rows"] == 1


def test_no_rows(spark):
    frame = spark.createDataFrame([], "a int, b string")
    assert tuple(duplicate_rows(frame).first()) == (0, 0, 0)
    assert [r["null_pct"] for r in null_profile(frame).collect()] == [0.0, 0.0]
    assert dataset_summary(frame, column_catalog(frame)).first()["complete_row_pct"] == 0.0


def test_dataset_summary(spark):
    frame = spark.createDataFrame(
        [(1, "x", 1.0), (1, "x", 1.0), (2, None, float("nan")), (3, "y", 2.0)],
        "a int, b string, c double",
    )
    row = dataset_summary(frame, column_catalog(frame)).first()
    assert (row["rows"], row["columns"], row["complete_rows"]) == (4, 3, 3)
    assert (row["complete_row_pct"], row["duplicate_rows"]) == (75.0, 1)
    assert tuple(complete_rows(frame, ["a", "b"]).first()) == (4, 3)


def test_datetime_summary_counts_whole_days(spark):
    frame = spark.createDataFrame(
        [("2024-01-01 23:00:00", "x"), ("2024-01-03 01:00:00", "y")], "at string, no string"
    )
    row = datetime_summary(frame, ["at", "no"]).collect()
    assert [(r["column"], str(r["date_min"]), str(r["date_max"]), r["date_range_days"])
            for r in row] == [("at", "2024-01-01", "2024-01-03", 1)]
