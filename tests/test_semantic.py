import datetime as dt
import json

import pytest

from autoprofile.config import BUSINESS_SYNONYMS, Config, SchemaRules, SemanticRules
from autoprofile.operators.catalog import column_catalog
from autoprofile.operators.semantic import (
    aggregation_of,
    build_semantic_layer,
    canonical_name,
    description_of,
    evaluate_kpis,
    format_of,
    kpi_catalog,
    lineage,
    semantic_document,
    semantic_summary,
)
from autoprofile.sources.sinks import write_semantic_layer
from pyspark.sql import functions as F


def layer(frame, **rules):
    config = Config(schema=SchemaRules(**rules), semantic=SemanticRules(include_identifiers=True))
    return build_semantic_layer(frame, column_catalog(frame, config), config)


def roles(fields):
    return {r["raw_column"]: r["semantic_type"] for r in fields.collect()}


@pytest.fixture(scope="module")
def demo(spark):
    """Five orders, with the business types given by hand."""
    days = [dt.datetime(2023, 1, d) for d in (1, 2, 1, 3, 2)]
    frame = spark.createDataFrame(
        [
            ("ORD1", days[0], "Electronics", "Phones", 1200.50, 2, 0.15, True),
            ("ORD2", days[1], "Furniture", "Chairs", 450.75, 1, 0.10, True),
            ("ORD3", days[2], "Electronics", "Laptops", 2100.00, 3, 0.15, True),
            ("ORD4", days[3], "Furniture", "Tables", 890.25, 2, 0.10, True),
            ("ORD5", days[4], "Office", "Paper", 45.00, 10, 0.05, False),
        ],
        "Order_ID string, Date timestamp, Category string, Sub_Category string, "
        "Revenue_USD double, Quantity_Sold long, Tax_Rate double, Is_Taxed boolean",
    )
    types = {
        "Order_ID": "identifier", "Date": "datetime", "Category": "categorical",
        "Sub_Category": "categorical", "Revenue_USD": "numeric", "Quantity_Sold": "numeric",
        "Tax_Rate": "numeric", "Is_Taxed": "boolean",
    }
    fields = layer(frame, type_overrides=types)
    return frame, fields, kpi_catalog(fields)


def test_demo_roles(demo):
    _, fields, kpis = demo
    found = roles(fields)
    assert [c for c, r in found.items() if r == "dimension"] == [
        "Category", "Sub_Category", "Is_Taxed"
    ]
    assert [c for c, r in found.items() if r == "measure"] == [
        "Revenue_USD", "Quantity_Sold", "Tax_Rate"
    ]
    assert found["Date"] == "time" and found["Order_ID"] == "entity"
    assert kpis.count() == 6


def test_demo_fields(demo):
    fields = {r["raw_column"]: r for r in demo[1].collect()}
    assert fields["Sub_Category"]["values"] == ["Chairs", "Laptops", "Paper", "Phones", "Tables"]
    assert fields["Sub_Category"]["description"] == "Categorical dimension: Sub Category"
    assert fields["Is_Taxed"]["values"] == ["false", "true"]
    assert fields["Is_Taxed"]["description"] == "Boolean flag: Is Taxed"
    measures = {c: (fields[c]["aggregation"], fields[c]["format"])
                for c in ("Revenue_USD", "Quantity_Sold", "Tax_Rate")}
    assert measures == {
        "Revenue_USD": ("sum", "currency"),
        "Quantity_Sold": ("sum", "number"),
        "Tax_Rate": ("avg", "percentage"),
    }
    assert fields["Date"]["granularities"] == ["day", "month", "quarter", "year"]
    assert fields["Order_ID"]["description"] == "Unique identifier: Order Id"
    assert not any(r["nullable"] for r in fields.values())


def test_demo_kpis(demo):
    rows = demo[2].collect()
    assert [(r["name"], r["formula"], r["description"]) for r in rows] == [
        ("total_revenue_usd", "SUM(Revenue_USD)", "Total Revenue USD across all records"),
        ("total_quantity_sold", "SUM(Quantity_Sold)", "Total Quantity Sold across all records"),
        ("avg_tax_rate", "AVG(Tax_Rate)", "Average Tax Rate"),
        ("revenue_per_unit", "SUM(Revenue_USD) / SUM(Quantity_Sold)",
         "Average revenue generated per unit sold"),
        ("record_count_by_category", "COUNT(*) GROUP BY Category",
         "Number of records per Category"),
        ("record_count_by_sub_category", "COUNT(*) GROUP BY Sub_Category",
         "Number of records per Sub Category"),
    ]
    assert rows[3]["source_measures"] == ["revenue_usd", "quantity_sold"]
    assert rows[4]["source_measures"] == []


def test_demo_values(demo):
    frame, _, kpis = demo
    values = {(r["name"], r["segment"]): r["value"] for r in evaluate_kpis(frame, kpis).collect()}
    assert values["total_revenue_usd", None] == 4686.50
    assert values["total_quantity_sold", None] == 18
    assert values["avg_tax_rate", None] == 0.11
    assert values["revenue_per_unit", None] == 260.3611
    assert values["record_count_by_category", "Furniture"] == 2
    assert sum(v for (n, _), v in values.items() if n == "record_count_by_sub_category") == 5


def test_demo_summary_lineage_document(demo, tmp_path, spark):
    _, fields, kpis = demo
    summary = {r["semantic_type"]: (r["fields"], r["first_names"])
               for r in semantic_summary(fields, kpis).collect()}
    assert summary == {
        "dimension": (3, ["category", "sub_category", "is_taxed"]),
        "measure": (3, ["revenue_usd", "quantity_sold", "tax_rate"]),
        "time": (1, ["date"]),
        "entity": (1, ["order_id"]),
        "kpi": (6, []),
    }
    assert lineage(fields).collect()[0] == ("Order_ID", "order_id")
    body = json.loads(semantic_document(fields, kpis).first()["document"])["semantic_layer"]
    assert list(body) == ["version", "dimensions", "measures", "time_fields", "entities", "kpis"]
    assert body["version"] == "1.0"
    assert body["dimensions"][0] == {
        "raw_column": "Category", "semantic_name": "category",
        "description": "Categorical dimension: Category", "nullable": False,
        "semantic_type": "dimension", "values": ["Electronics", "Furniture", "Office"],
    }
    write_semantic_layer(fields, kpis, str(tmp_path / "layer"))
    assert json.loads(spark.read.text(str(tmp_path / "layer")).first()[0])["semantic_layer"] == body


def test_roles_of_small_frames(spark):
    frame = spark.createDataFrame([(100.0, 50.0), (200.0, 70.0)], "revenue double, cost double")
    assert roles(layer(frame)) == {"revenue": "measure", "cost": "measure"}
    frame = spark.createDataFrame([("North",), ("South",), ("East",)], "region string")
    assert roles(layer(frame)) == {"region": "dimension"}
    days = [dt.datetime(2023, 1, 1), dt.datetime(2023, 2, 1)]
    frame = spark.createDataFrame([(d,) for d in days], "order_date timestamp")
    assert roles(layer(frame)) == {"order_date": "time"}


def test_identifiers_are_entities_only_on_request(spark):
    rows = [(f"ORD-{i}", float(i % 7)) for i in range(150)]
    frame = spark.createDataFrame(rows, "order_id string, revenue double")
    catalog = column_catalog(frame)
    assert "order_id" not in roles(build_semantic_layer(frame, catalog))
    assert roles(layer(frame))["order_id"] == "entity"


def test_ratio_of_two_measures(spark):
    frame = spark.createDataFrame([(1000.0, 10.0), (2000.0, 20.0)], "revenue double, units double")
    kpis = kpi_catalog(layer(frame))
    values = {r["name"]: r["value"] for r in evaluate_kpis(frame, kpis).collect()}
    assert values["revenue_per_unit"] == 100.0


def test_ratio_over_zero_units(spark):
    frame = spark.createDataFrame([(10.0, -1.0), (20.0, 1.0)], "revenue double, units double")
    values = {r["name"]: r["value"] for r in evaluate_kpis(frame, kpi_catalog(layer(frame))).collect()}
    assert values["revenue_per_unit"] is None


def test_no_kpis_when_switched_off(spark):
    frame = spark.createDataFrame([(1.0,), (2.0,)], "revenue double")
    off = Config(semantic=SemanticRules(auto_kpis=False))
    kpis = kpi_catalog(layer(frame), off)
    assert kpis.count() == 0
    assert evaluate_kpis(frame, kpis).count() == 0


@pytest.mark.parametrize(
    "name, by_token, by_substring",
    [
        ("category", "category", "categoryegory"),
        ("customer_rating", "customer_rating", "customeromer_rating"),
        ("discount_pct", "discount_pct", "disquantity_pct"),
        ("value", "amount", "amount"),
        ("event_type", "event_category", "event_category"),
        ("sales_rep", "revenue_rep", "revenue_rep"),
        ("sales_and_sales", "revenue_and_revenue", "revenue_and_revenue"),
        ("cat_cat_x", "category_category_x", "category_category_x"),
        (" Unit Price ", "unit_price", "unit_price"),
        ("created_at", "date", "date"),
        ("row_created_at_utc", "row_date_utc", "row_date_utc"),
    ],
)
def test_canonical_names(spark, name, by_token, by_substring):
    frame = spark.createDataFrame([(name,)], "n string")
    found = [
        frame.select(
            canonical_name(F.col("n"), SemanticRules(synonyms=BUSINESS_SYNONYMS, match=match))
        ).first()[0]
        for match in ("token", "substring")
    ]
    assert found == [by_token, by_substring]


@pytest.mark.parametrize(
    "name, aggregation, fmt",
    [
        ("Tax_Rate", "avg", "percentage"),
        ("unit_price", "sum", "currency"),
        ("order_count", "count", "number"),
        ("avg_revenue", "avg", "currency"),
        ("weight", "sum", "number"),
        ("paid", "count", "number"),
    ],
)
def test_guesses_from_names(spark, name, aggregation, fmt):
    frame = spark.createDataFrame([(name,)], "n string")
    column = F.col("n")
    assert tuple(frame.select(aggregation_of(column), format_of(column)).first()) == (
        aggregation, fmt
    )


def test_description_of_unknown_type(spark):
    frame = spark.createDataFrame([("my_col", "strange")], "n string, t string")
    assert frame.select(description_of(F.col("n"), F.col("t"))).first()[0] == "Field: My Col"
