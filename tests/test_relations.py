import numpy as np
import pytest

from autoprofile.operators.charts import (
    histogram,
    histogram_notes,
    histogram_of,
    scatter_fit,
    scatter_sample,
)
from autoprofile.operators.correlation import (
    correlation_matrix,
    heatmap,
    strong_correlations,
)
from autoprofile.operators.frequencies import (
    category_share,
    dimension_values,
    top_texts,
    top_value,
    top_values,
)
from autoprofile.operators.segments import segment_bars, segment_grid, segment_rollup
from autoprofile.operators.numbers import distributions
from autoprofile.operators.dates import with_timestamps
from autoprofile.operators.series import monthly_series, monthly_trend


def test_pairwise_complete_correlation(spark):
    rng = np.random.default_rng(3)
    data = rng.normal(size=(200, 8))
    data[:, 3] = data[:, 0] * 2 + data[:, 3] * 0.1
    holes = rng.random(data.shape) < 0.2
    rows = [tuple(None if h else float(v) for v, h in zip(r, hr)) for r, hr in zip(data, holes)]
    names = [f"m{i}" for i in range(8)]
    frame = spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names))
    found = {(r["col1"], r["col2"]): r["correlation"]
             for r in correlation_matrix(frame, names).collect()}
    assert len(found) == 64
    for i in range(8):
        for j in range(8):
            both = ~holes[:, i] & ~holes[:, j]
            expected = np.corrcoef(data[both, i], data[both, j])[0, 1]
            assert found[names[i], names[j]] == pytest.approx(expected, abs=1e-4)
    strong = strong_correlations(frame, names).collect()
    assert [(r["col1"], r["col2"], r["strength"]) for r in strong] == [
        ("m0", "m3", "strong positive")
    ]


def test_hard_correlations(spark):
    """Far from zero, constant on the shared rows only, and of very different size."""
    rng = np.random.default_rng(5)
    far = 1e9 + rng.normal(size=300)
    rows = [
        (float(f), float(f) * -3.0, 0.1, None if i % 3 else 0.7, 1e-12 * float(f), float(i))
        for i, f in enumerate(far)
    ]
    names = ["far", "mirror", "same", "part", "tiny", "place"]
    frame = spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names)).repartition(3)
    found = {(r["col1"], r["col2"]): r["correlation"]
             for r in correlation_matrix(frame, names).collect()}
    assert found["far", "mirror"] == -1.0 and found["far", "tiny"] == 1.0
    assert found["far", "same"] is None and found["part", "place"] is None
    assert found["part", "part"] is None and found["place", "place"] == 1.0
    expected = np.corrcoef(far, np.arange(300))[0, 1]
    assert found["far", "place"] == pytest.approx(expected, abs=1e-4)


def test_correlation_on_a_shifted_subset(spark):
    """The rows shared with another column lie far from the column's own mean."""
    rng = np.random.default_rng(6)
    noise = rng.normal(size=100)
    rows = [(1e7 + float(v), float(v)) for v in noise] + [(-1e7, None)] * 100
    frame = spark.createDataFrame(rows, "x double, y double")
    found = {(r["col1"], r["col2"]): r["correlation"]
             for r in correlation_matrix(frame, ["x", "y"]).collect()}
    assert found["x", "y"] == 1.0


def test_constant_measures_have_no_correlation(spark):
    frame = spark.createDataFrame([(1.0, 5.0, -1.0), (2.0, 5.0, -2.0)],
                                  "a double, b double, c double")
    found = {(r["col1"], r["col2"]): r["correlation"]
             for r in correlation_matrix(frame, ["a", "b", "c"]).collect()}
    assert found["a", "b"] is None and found["b", "b"] is None
    assert found["a", "c"] == -1.0
    assert strong_correlations(frame, ["a", "b", "c"]).first()["strength"] == "strong negative"
    wide = heatmap(correlation_matrix(frame, ["a", "c"]), ["a", "c"])
    assert sorted(map(tuple, wide.collect())) == [("a", 1.0, -1.0), ("c", -1.0, 1.0)]


def test_too_few_measures(spark):
    assert correlation_matrix(spark.range(3).selectExpr("id * 1.0 AS a"), ["a"]).count() == 0


def days(spark, rows):
    return spark.createDataFrame(rows, "day string, m double")


def test_series_leaves_gaps_and_sums_nulls_to_zero(spark):
    rows = [("2024-01-05", 1.0)] * 6 + [("2024-03-01", None)] * 4 + [("soon", 9.0), (None, 9.0)]
    found = monthly_series(days(spark, rows), ["day"], ["m"]).collect()
    assert sorted((r["period"], r["value"]) for r in found) == [("2024-01", 6.0), ("2024-03", 0.0)]
    trend = monthly_trend(days(spark, rows), ["day"], ["m"]).first()
    assert (trend["trend_direction"], trend["slope"], trend["r_squared"]) == ("stable", 0.0, 0.0)


def test_series_needs_enough_rows(spark):
    rows = [(f"2024-{m:02d}-01", 1.0) for m in range(1, 10)]
    assert monthly_series(days(spark, rows), ["day"], ["m"]).count() == 0
    assert monthly_series(days(spark, rows), ["day"], ["m"], min_points=9).count() == 9


def test_flat_and_rising_trends(spark):
    flat = [(f"2024-{m:02d}-01", 2.0) for m in range(1, 13)]
    row = monthly_trend(days(spark, flat), ["day"], ["m"]).first()
    assert (row["trend_direction"], row["r_squared"]) == ("downward", 0.0)
    rising = [(f"2024-{m:02d}-01", 3.0 * m) for m in range(1, 13)]
    row = monthly_trend(days(spark, rising), ["day"], ["m"]).first()
    assert (row["trend_direction"], row["slope"], row["r_squared"]) == ("upward", 3.0, 1.0)


@pytest.mark.parametrize(
    "granularity, periods",
    [("day", ["2024-01-05", "2024-11-05"]), ("quarter", ["2024Q1", "2024Q4"]), ("year", ["2024"])],
)
def test_granularities(spark, granularity, periods):
    rows = [("2024-01-05", 1.0)] * 5 + [("2024-11-05", 1.0)] * 5
    found = monthly_series(days(spark, rows), ["day"], ["m"], granularity=granularity)
    assert sorted(r["period"] for r in found.collect()) == periods


def test_unknown_granularity(spark):
    with pytest.raises(ValueError):
        monthly_series(days(spark, [("2024-01-05", 1.0)]), ["day"], ["m"], granularity="week")


# ------------------------------------------------------------------ segments and values


def test_segments_with_nulls_and_ties(spark):
    rows = [("b", 2.0), ("a", 2.0), (None, 5.0), ("c", None), ("d", float("nan"))]
    frame = spark.createDataFrame(rows, "d string, m double")
    found = [tuple(r) for r in segment_rollup(frame, "d", "m").collect()]
    assert found == [
        ("nan", 5.0, 5.0, 1), ("a", 2.0, 2.0, 1), ("b", 2.0, 2.0, 1),
        ("c", 0.0, None, 0), ("d", 0.0, None, 0),
    ]
    assert segment_rollup(frame, "d", "m", top_n=2, null_label="-").collect()[0]["segment"] == "-"


def test_grid_equals_single_rollups(spark):
    frame = spark.range(2000).selectExpr(
        "id % 7 AS d1", "concat('k', id % 40) AS d2", "id % 2 = 0 AS d3",
        "id * 1.5 AS m1", "IF(id % 3 = 0, NULL, id) AS m2",
    )
    grid = segment_grid(frame, ["d1", "d2", "d3"], ["m1", "m2"], top_n=5).collect()
    for d in ("d1", "d2", "d3"):
        for m in ("m1", "m2"):
            part = [(r["segment"], r["total"], r["avg"], r["count"])
                    for r in sorted(grid, key=lambda r: r["rank"])
                    if (r["dimension"], r["measure"]) == (d, m)]
            alone = [tuple(r) for r in segment_rollup(frame, d, m, top_n=5).collect()]
            assert part == alone


def test_long_segment_names_come_back_whole(spark):
    long_a, long_b = "a" * 300, "é" * 33
    rows = [(long_a, 5.0), (long_a, 1.0), (long_b, 4.0), ("short", 3.0)]
    frame = spark.createDataFrame(rows, "d string, m double")
    assert [(r["segment"], r["total"]) for r in segment_rollup(frame, "d", "m").collect()] == [
        (long_a, 6.0), (long_b, 4.0), ("short", 3.0)
    ]


def test_segment_bars_show_first_results(spark):
    frame = spark.range(100).selectExpr("id % 3 AS a", "id % 4 AS b", "id AS m", "id * 2 AS n")
    bars = segment_bars(segment_grid(frame, ["a", "b"], ["m", "n"]), results=3, shown=2).collect()
    assert sorted({(r["result_no"], r["dimension"], r["measure"]) for r in bars}) == [
        (1, "a", "m"), (2, "a", "n"), (3, "b", "m")
    ]
    assert max(r["rank"] for r in bars) == 2


def test_top_values(spark):
    rows = [("x", True)] * 3 + [("y", None)] * 3 + [("z", False), (None, None)]
    frame = spark.createDataFrame(rows, "c string, b boolean")
    found = [tuple(r) for r in top_values(frame, ["c"], 2).orderBy("rank").collect()]
    assert found == [("c", 1, "x", 3, 42.86), ("c", 2, "y", 3, 42.86)]
    shares = category_share(top_values(frame, ["c"], 2)).orderBy("rank").collect()
    assert [r["shown_pct"] for r in shares] == [50.0, 50.0]
    tops = {r["column"]: (r["top_value"], r["top_value_pct"])
            for r in top_value(top_values(frame, ["c", "b"]), ["c", "b", "none"]).collect()}
    assert tops == {"c": ("x", 42.86), "b": ("true", 75.0), "none": (None, 0.0)}


def test_top_texts_come_back_whole(spark):
    rows = [("x" * 100,)] * 3 + [("é" * 50,)] * 2 + [("short",), (None,)]
    frame = spark.createDataFrame(rows, "t string")
    found = [(r["value"], r["count"]) for r in top_texts(frame, ["t"]).orderBy("rank").collect()]
    assert found == [("x" * 100, 3), ("é" * 50, 2), ("short", 1)]
    assert top_texts(frame, []).count() == 0


def test_values_of_all_kinds_as_text(spark):
    frame = spark.range(2).selectExpr(
        "id", "id + 0.5D AS d", "CAST(id AS DECIMAL(5,2)) AS e", "id = 0 AS b",
        "DATE '2024-01-01' AS at", "array(id) AS nested",
    )
    found = {(r["column"], r["value"]): r["count"]
             for r in top_values(frame, frame.columns).collect()}
    assert found == {
        ("id", "0"): 1, ("id", "1"): 1, ("d", "0.5"): 1, ("d", "1.5"): 1, ("e", "0.00"): 1,
        ("e", "1.00"): 1, ("b", "true"): 1, ("b", "false"): 1, ("at", "2024-01-01"): 2,
    }


def test_dimension_values_are_capped_and_sorted(spark):
    frame = spark.range(200).selectExpr("lpad(id, 3, '0') AS c")
    values = dimension_values(frame, ["c"]).first()["values"]
    assert values == [f"{i:03d}" for i in range(50)]


# ------------------------------------------------------------------ scatter


def test_scatter_sample_is_exact_in_size(spark):
    frame = spark.range(20_000).selectExpr("id AS x", "id * 2 AS y", "id % 2 AS c")
    points = scatter_sample(frame, "x", "y", "c", max_points=300).collect()
    assert len(points) == 300
    assert all(p["y"] == 2 * p["x"] for p in points)
    assert 4000 < np.mean([p["x"] for p in points]) < 16_000
    assert scatter_sample(frame.limit(50), "x", "y").count() == 50


def test_scatter_sample_does_not_depend_on_the_layout(spark):
    frame = spark.range(20000).selectExpr("id % 977 AS x", "id * 0.5 AS y", "id % 3 AS c")
    drawn = [
        sorted(map(tuple, scatter_sample(frame.repartition(n), "x", "y", "c", 500).collect()))
        for n in (3, 8)
    ]
    assert drawn[0] == drawn[1] and len(drawn[0]) == 500


def test_histogram_leaves_infinite_values_out(spark):
    values = [float(v) for v in range(100)] + [float("inf"), float("-inf"), None]
    frame = spark.createDataFrame([(v,) for v in values], "v double")
    for bins in (histogram(frame, ["v"]), histogram_of(frame, distributions(frame, ["v"]))):
        rows = bins.collect()
        assert sum(r["count"] for r in rows) == 100
        assert (rows[0]["bin_from"], rows[-1]["bin_to"]) == (0.0, 99.0)
    notes = histogram_notes(frame, distributions(frame, ["v"])).first()
    assert notes["not_finite"] == 2


@pytest.mark.parametrize("name", ["points", "start", "all_points", "time_column", "m0"])
def test_series_of_any_column_name(spark, name):
    rows = [(f"2024-{1 + i % 3:02d}-05", float(i)) for i in range(12)]
    frame = spark.createDataFrame(rows, f"day string, {name} double")
    found = monthly_series(frame, ["day"], [name]).collect()
    assert {(r["measure"], r["period"]): r["value"] for r in found} == {
        (name, "2024-01"): 18.0, (name, "2024-02"): 22.0, (name, "2024-03"): 26.0,
    }


def test_dates_are_read_in_the_layout_of_their_column(spark):
    days = spark.range(365).selectExpr(
        "date_add(DATE '2023-01-01', CAST(id AS INT)) AS day",
    ).selectExpr("day", "date_format(day, 'dd/MM/yyyy') AS text")
    found = with_timestamps(days, ["text"])
    assert found.filter("text <> day OR text IS NULL").count() == 0
    mixed = spark.createDataFrame([("2024-05-01",), ("2024-05-02",), ("3/5/2024",)], "t string")
    assert with_timestamps(mixed, ["t"]).filter("t IS NULL").count() == 1


def test_scatter_sample_of_one_repeated_point(spark):
    frame = spark.range(5000).selectExpr("1 AS x", "2 AS y")
    assert scatter_sample(frame, "x", "y", max_points=100).count() == 100


def test_scatter_fit_per_color(spark):
    rows = [(float(i), 2.0 * i + 1, "a") for i in range(5)] + [(float(i), -i + 3.0, "b")
                                                               for i in range(5)]
    frame = spark.createDataFrame(rows + [(None, 1.0, "a")], "x double, y double, c string")
    fits = {r["color"]: (r["points"], r["slope"], r["intercept"])
            for r in scatter_fit(frame, "x", "y", "c").collect()}
    assert fits == {"a": (5, 2.0, 1.0), "b": (5, -1.0, 3.0)}


def test_correlation_over_many_blocks(spark):
    rng = np.random.default_rng(11)
    data = rng.normal(size=(300, 150))
    data[:, 149] = data[:, 0] - 0.5 * data[:, 70]
    names = [f"c{i}" for i in range(150)]
    frame = spark.createDataFrame([tuple(map(float, row)) for row in data],
                                  ", ".join(f"{n} double" for n in names)).repartition(3)
    found = {(r["col1"], r["col2"]): r["correlation"]
             for r in correlation_matrix(frame, names).collect()}
    expected = np.corrcoef(data.T)
    assert len(found) == 150 * 150
    for i, j in ((0, 0), (0, 149), (70, 149), (63, 64), (128, 5)):
        assert abs(found[f"c{i}", f"c{j}"] - expected[i, j]) < 1e-4
