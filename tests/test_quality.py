import datetime as dt

import pytest

from autoprofile.config import Config, QualityRules
from autoprofile.operators.quality import (
    column_quality_of,
    judge_columns,
    mixed_shapes,
    quality_issues,
    quality_score,
    whitespace_values,
)


def rules_found(frame, typed, **kwargs):
    return [(r["column"], r["severity"], r["rule"], r["value"])
            for r in quality_issues(frame, typed, **kwargs).collect()]


def test_null_share(spark):
    frame = spark.createDataFrame([(1.0,), (None,), (3.0,), (float("nan"),), (5.0,)], "a double")
    row = column_quality_of(judge_columns(frame, [("a", "numeric")])).first()
    assert (row["null_pct"], row["non_null_pct"]) == (40.0, 60.0)


def test_outliers_and_skew(spark):
    frame = spark.createDataFrame([(i,) for i in [*range(1, 101), 9999]], "val long")
    issues = quality_issues(frame, [("val", "numeric")]).collect()
    assert [r["message"] for r in issues] == [
        "1 outlier(s) detected (IQR method, range: [-49.00, 151.00])",
        "Skewed distribution (skewness=9.89)",
    ]
    row = column_quality_of(judge_columns(frame, [("val", "numeric")])).first()
    assert row["outliers"]["iqr_outlier_count"] == 1
    assert row["numeric_stats"]["median"] == 51.0
    assert len(row["issues"]) == 2


def test_fully_null_column_is_flagged(spark):
    frame = spark.createDataFrame([(1, None), (2, None), (3, None)], "a long, b double")
    found = rules_found(frame, [("a", "numeric"), ("b", "numeric")])
    assert ("b", "warning", "high_nulls", 100.0) in found


def test_half_null_counts_as_high(spark):
    frame = spark.createDataFrame([(1,), (None,)], "a int")
    assert rules_found(frame, [("a", "numeric")]) == [("a", "warning", "high_nulls", 50.0)]
    strict = Config(quality=QualityRules(high_null_share=0.6))
    assert rules_found(frame, [("a", "numeric")], config=strict) == []


def test_score_falls_with_nulls(spark):
    clean = spark.createDataFrame([(1.0,), (2.0,), (3.0,)], "a double")
    gaps = spark.createDataFrame([(1.0,), (None,), (None,)], "a double")
    typed = [("a", "numeric")]
    best, worse = (quality_score(f, typed).first() for f in (clean, gaps))
    assert best["quality_score"] == 100.0
    # two thirds of the cells are null and there is one warning
    assert worse["quality_score"] == pytest.approx(100 - 40 * 2 / 3 - 2, abs=0.05)
    assert (worse["total_cells"], worse["total_nulls"], worse["overall_null_pct"]) == (3, 2, 66.67)


def test_bad_data_does_not_crash(spark):
    frame = spark.createDataFrame(
        [("abc", None), ("123", None), (None, None), ("true", None), ("3.14", None)],
        "mixed string, all_null double",
    )
    typed = [("mixed", "text"), ("all_null", "numeric")]
    found = rules_found(frame, typed)
    assert ("mixed", "warning", "mixed_types", 3.0) in found
    assert quality_score(frame, typed).first()["quality_score"] < 100
    message = quality_issues(frame, typed).where("rule = 'mixed_types'").first()["message"]
    assert message == "Mixed value types detected: bool, float, int"


def test_numbers_among_texts(spark):
    frame = spark.createDataFrame(
        [("abc", "1", "x"), ("12", "2", "y"), ("13", "3", "z")], "a string, b string, c string"
    )
    verdicts = {r["column"]: r["verdict"] for r in mixed_shapes(frame, ["a", "b", "c"]).collect()}
    assert verdicts == {"a": "non_string", "b": "uniform", "c": "uniform"}


def test_edge_white_space(spark):
    values = [" a", "a\t", "\na ", " a", "a b", "", None, "　a"]
    frame = spark.createDataFrame([(v,) for v in values], "c string")
    assert whitespace_values(frame, ["c"]).first()["padded_count"] == 5


def test_label_variants(spark):
    frame = spark.createDataFrame(
        [(v,) for v in ["Yes", "yes", "YES ", "no", "no", None]], "c string"
    )
    found = rules_found(frame, [("c", "categorical")])
    assert ("c", "info", "label_variants", 2.0) in found
    assert ("c", "info", "edge_whitespace", 1.0) in found


def test_checks_of_texts_and_labels_agree(spark):
    rows = [(f"{v}", f"{v}") for v in [" 1", "x ", "2.5", "2.5", "x", None] * 3]
    frame = spark.createDataFrame(rows, "a string, b string")
    found = rules_found(frame, [("a", "categorical"), ("b", "text")])
    as_label = {f[1:] for f in found if f[0] == "a" and f[2] != "label_variants"}
    as_text = {f[1:] for f in found if f[0] == "b"}
    assert as_label == as_text


def test_implausible_dates(spark):
    frame = spark.createDataFrame(
        [("1899-12-31",), ("2024-06-01",), ("2024-06-02",), ("never",)], "d string"
    )
    as_of = dt.datetime(2024, 6, 1, tzinfo=dt.timezone.utc)
    assert rules_found(frame, [("d", "datetime")], as_of=as_of) == [
        ("d", "warning", "future_dates", 1.0),
        ("d", "warning", "old_dates", 1.0),
    ]


def test_no_columns_to_check(spark):
    assert quality_issues(spark.range(3), []).count() == 0
