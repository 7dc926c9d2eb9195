import datetime as dt
import random

import pytest

from autoprofile.config import Config, SchemaRules
from autoprofile.functions.coerce import nan_to_null, text_number, text_timestamp
from autoprofile.operators.catalog import (
    analysis_columns,
    column_catalog,
    estimated_distinct,
    select_analysis_columns,
    type_distribution,
)
from pyspark.sql import functions as F


def types(frame, **rules):
    config = Config(schema=SchemaRules(**rules))
    return {r["column_name"]: r["inferred_type"] for r in column_catalog(frame, config).collect()}


def one(spark, values, kind="string"):
    return spark.createDataFrame([(v,) for v in values], f"c {kind}")


@pytest.mark.parametrize(
    "values, kind, expected",
    [
        ([100.0, 200.5, 300.1], "double", "numeric"),
        (["North", "South"] * 10, "string", "categorical"),
        (["2023-01-01", "2023-02-15", "2023-06-30"], "string", "datetime"),
        ([True, False, True, False], "boolean", "boolean"),
        ([None, None], "string", "empty"),
        ([5, 5, None], "int", "constant"),
        (["same", "same"], "string", "constant"),
        ([0, 1, 1, None], "int", "boolean"),
        ([0.0, 1.0], "double", "boolean"),
        ([1, 2], "int", "numeric"),
        ([1, 2] * 10, "int", "categorical"),
        (list(range(51)), "int", "identifier"),
        (list(range(50)), "int", "numeric"),
        (["Yes", "no ", " TRUE", "f"], "string", "boolean"),
        (["1,200", " 7 ", "3.5", "-1e3"], "string", "numeric"),
        ([str(i) for i in range(60)], "string", "identifier"),
        (["3", "4"] * 20, "string", "categorical"),
        ([f"name {i}" for i in range(101)], "string", "identifier"),
        ([f"name {i}" for i in range(100)], "string", "text"),
        (["1.5d", "1_000", "x"], "string", "text"),
        ([dt.date(2020, 1, 1), dt.date(2020, 1, 2)], "date", "datetime"),
        ([[1], [2]], "array<int>", "nested"),
    ],
)
def test_type_of_one_column(spark, values, kind, expected):
    assert types(one(spark, values, kind))["c"] == expected


def test_decimal_takes_the_numeric_path(spark):
    frame = spark.range(10).selectExpr("CAST(id AS DECIMAL(10,2)) AS c")
    assert types(frame)["c"] == "numeric"


def test_empty_columns_are_left_out(spark):
    frame = spark.createDataFrame([(1, None), (2, None), (3, None)], "a long, empty string")
    catalog = column_catalog(frame)
    assert analysis_columns(catalog) == [("a", "numeric")]
    assert select_analysis_columns(frame, catalog).columns == ["a"]


def test_one_row_per_column(spark):
    catalog = column_catalog(spark.createDataFrame([(1, "a"), (2, "b")], "x long, y string"))
    assert [r["column_name"] for r in catalog.collect()] == ["x", "y"]


def test_null_share_counts_nan(spark):
    frame = spark.createDataFrame([(1.0,), (float("nan"),), (3.0,), (None,)], "val double")
    row = column_catalog(frame).first()
    assert (row["null_count"], row["null_pct"], row["non_null_pct"]) == (2, 50.0, 50.0)
    assert row["unique_count"] == 2


def test_identifier_and_measure(spark):
    rng = random.Random(1)
    rows = [(f"ORD-{i}", rng.uniform(100, 1000)) for i in range(150)]
    frame = spark.createDataFrame(rows, "order_id string, revenue double")
    catalog = column_catalog(frame).collect()
    assert catalog[0]["inferred_type"] == "identifier"
    assert catalog[0]["ignore"]
    assert catalog[0]["ignore_reason"] == (
        "High-cardinality identifier column (unique ratio=100.00%)"
    )
    assert types(frame)["revenue"] == "identifier"
    assert types(frame, float_identifiers=False)["revenue"] == "numeric"
    assert types(frame, type_overrides={"order_id": "text"})["order_id"] == "text"


def test_samples_are_the_smallest_values(spark):
    row = column_catalog(one(spark, ["e", "b", "a", "d", "c", "f", "a", None])).first()
    assert row["sample_values"] == ["a", "b", "c", "d", "e"]
    row = column_catalog(one(spark, [30, 4, 200], "int")).first()
    assert row["sample_values"] == ["4", "30", "200"]
    row = column_catalog(one(spark, [True, False], "boolean")).first()
    assert row["sample_values"] == ["false", "true"]


def test_long_texts_are_sampled_whole(spark):
    texts = ["x" * 64, "y" * 5000, "short", "é" * 40]
    row = column_catalog(one(spark, texts + texts)).first()
    assert set(row["sample_values"]) == set(texts)
    assert row["unique_count"] == 4


def test_long_padded_texts_are_still_read(spark):
    pad = " " * 80
    dates = [f"{pad}2024-01-{d:02d}{pad}" for d in range(1, 20)]
    assert types(one(spark, dates))["c"] == "datetime"
    assert types(one(spark, [f"{pad}{d}.5" for d in range(20)]))["c"] == "numeric"
    assert types(one(spark, [pad + "yes", "no"]))["c"] == "boolean"


def test_anomalies(spark):
    row = column_catalog(one(spark, ["2024-01-01", "soon", "later", "2024-01-02"])).first()
    assert row["anomalies"] == ["Mixed datetime parsing success (50%); may be noisy dates."]
    row = column_catalog(one(spark, ["1", "2.5", "30"])).first()
    assert row["anomalies"] == [
        "Numeric values stored as text; will be coerced during analysis."
    ]


def test_zero_rows_and_zero_columns(spark):
    frame = spark.createDataFrame([], "a int, b string, c double")
    rows = column_catalog(frame).collect()
    assert [r["inferred_type"] for r in rows] == ["empty"] * 3
    assert [r["null_pct"] for r in rows] == [0.0] * 3
    assert type_distribution(column_catalog(frame)).collect() == [("empty", 3)]


def test_odd_column_names(spark):
    frame = spark.createDataFrame([(1, "x"), (2, "y")], ["a.b", "c`d e"])
    assert types(frame) == {"a.b": "numeric", "c`d e": "text"}


def test_approximate_types_agree(spark):
    frame = spark.range(5000).selectExpr(
        "id",
        "id % 7 AS few",
        "CAST(id % 31 AS STRING) AS label",
        "IF(id % 3 = 0, NULL, id * 0.37) AS measure",
        "IF(id % 2 = 0, 1, 0) AS flag",
        "concat('t', id % 1250) AS text",
        "concat('name ', id) AS name",
        "date_format(date_add(DATE '2000-01-01', CAST(id AS INT)), 'yyyy-MM-dd') AS day",
        "IF(id % 2 = 0, 'yes', 'no ') AS word",
        "CAST(id * 1.25 AS STRING) AS digits",
        "timestamp_seconds(id * 60) AS at",
        "array(id) AS list",
    )
    assert types(frame, distinct="approx") == types(frame)
    estimates = {r["ordinal"]: r["estimated_count"] for r in estimated_distinct(frame).collect()}
    assert abs(estimates[0] - 5000) < 250
    assert estimates[1] == 7


@pytest.mark.parametrize(
    "text, number",
    [
        ("1,200", 1200.0), (" 7 ", 7.0), ("+.5", 0.5), ("3.", 3.0), ("1e-2", 0.01),
        (" 12 ", 12.0), ("1.5d", None), ("1_000", None), ("inf", None), ("NaN", None),
        ("", None), ("-", None), ("0x10", None), (None, None), ("12 3", None),
    ],
)
def test_text_number(spark, text, number):
    frame = spark.createDataFrame([(text,)], "t string")
    assert frame.select(text_number(F.col("t"))).first()[0] == number


def test_plain_text_number_keeps_commas_out(spark):
    frame = spark.createDataFrame([("1,200",), ("12",)], "t string")
    values = [r[0] for r in frame.select(text_number(F.col("t"), strip_commas=False)).collect()]
    assert values == [None, 12.0]


@pytest.mark.parametrize(
    "text, day",
    [
        ("2024-02-29", "2024-02-29"), ("2024-02-30", None), ("2024-1-5 10:30", "2024-01-05"),
        ("2024-01-05T10:30:00.5Z", "2024-01-05"), ("03/04/2024", "2024-03-04"),
        ("31/12/2024", "2024-12-31"), ("5 Mar 2024", "2024-03-05"),
        ("Mar 5, 2024", "2024-03-05"), ("5.3.2024", "2024-03-05"), ("2024/3/5", "2024-03-05"),
        ("20240305", None), ("1234", None), ("3.14", None), ("soon", None), (None, None),
    ],
)
def test_text_timestamp(spark, text, day):
    frame = spark.createDataFrame([(text,)], "t string")
    found = frame.select(F.to_date(text_timestamp(F.col("t"))).cast("string")).first()[0]
    assert found == day


def test_nan_to_null_keeps_other_columns(spark):
    frame = spark.createDataFrame([(float("nan"), 1, "x")], "a double, b int, c string")
    assert tuple(nan_to_null(frame).first()) == (None, 1, "x")
    untouched = spark.range(1)
    assert nan_to_null(untouched) is untouched


def test_config_rejects_unknown_keys():
    config = Config.from_mapping({"quality": {"iqr_factor": 2.0}, "schema": {"true_words": ["ja"]}})
    assert config.quality.iqr_factor == 2.0
    assert config.schema.true_words == ("ja",)
    with pytest.raises(KeyError):
        Config.from_mapping({"quality_checks": {}})
    with pytest.raises(KeyError):
        Config.from_mapping({"quality": {"iqr": 1}})
