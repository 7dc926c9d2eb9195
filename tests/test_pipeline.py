import datetime as dt

import pytest

from autoprofile.config import ChartRules, Config, ReportRules, SchemaRules
from autoprofile.operators.insights import confidence_score
from autoprofile.operators.tables import null_profile
from autoprofile.plans.pipeline import analyze, analyze_path
from autoprofile.sources import sinks
from autoprofile.sources.sinks import write_sections

AS_OF = dt.datetime(2024, 6, 1)


@pytest.fixture(scope="module")
def sales(spark):
    """A thousand orders and ten copies, with gaps, a few extreme revenues and an empty column."""
    orders = spark.range(1000).selectExpr(
        "concat('ORD-', 100000 + id) AS `Order ID`",
        "date_format(date_add(DATE '2023-01-01', CAST(id * 37 % 365 AS INT)), 'yyyy-MM-dd')"
        " AS `Order Date`",
        "element_at(array('North', 'South', 'East', 'West', 'Central'), CAST(id % 5 AS INT) + 1)"
        " AS Region",
        "element_at(array('Online', 'Retail', 'Partner'), CAST(id * 7 % 3 AS INT) + 1) AS Channel",
        "1 + id * 13 % 499 AS `Units Sold`",
        "IF(id % 12 = 0, NULL, 5 + (id * 7919 % 199500) / 100.0D) AS `Unit Price`",
        "round((id * 31 % 36) / 100.0D, 2) AS `Discount Pct`",
        "id % 12 = 5 AS `Return Flag`",
        "1 + id % 29 AS `Delivery Days`",
        "CAST(NULL AS STRING) AS Notes",
        "IF(id % 200 = 3, 500000.5D, (1 + id * 13 % 499) * 10.25D) AS Revenue",
    )
    return orders.unionByName(orders.where("`Order ID` LIKE 'ORD-1000_7'"))


@pytest.fixture(scope="module")
def results(sales, spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("sales") / "orders")
    sales.coalesce(1).write.csv(folder, header=True)
    return analyze_path(spark, folder, "csv", as_of=AS_OF)


def test_text_files_are_staged_on_shared_storage(spark, tmp_path, monkeypatch):
    (tmp_path / "t.csv").write_text("a,b\n" + "".join(f"{i % 3},{i}\n" for i in range(30)))
    monkeypatch.setattr(sinks, "shared_folder", lambda session: str(tmp_path / "shared"))
    results = analyze_path(spark, str(tmp_path / "t.csv"), as_of=AS_OF)
    assert results.dataset_summary.first()["rows"] == 30
    staged = list((tmp_path / "shared" / "autoprofile").iterdir())
    assert len(staged) == 1


def test_types(results):
    types = {r["column_name"]: r["inferred_type"] for r in results.column_catalog.collect()}
    assert types == {
        "order_id": "identifier", "order_date": "datetime", "region": "categorical",
        "channel": "categorical", "units_sold": "numeric", "unit_price": "identifier",
        "discount_pct": "numeric", "return_flag": "boolean", "delivery_days": "categorical",
        "revenue": "numeric",
    }


def test_summary_and_quality(results):
    summary = results.dataset_summary.first()
    assert (summary["rows"], summary["columns"], summary["duplicate_rows"]) == (1010, 10, 10)
    issues = {(r["column"], r["rule"]) for r in results.issues.collect()}
    assert ("revenue", "outliers") in issues and ("revenue", "skewness") in issues
    assert 0 < results.quality_overview.first()["quality_score"] < 100
    assert results.metadata.first()["rows_raw"] == 1010


def test_column_quality_has_distinct_counts(results):
    unique = {r["column"]: r["unique_count"] for r in results.column_quality.collect()}
    assert unique["region"] == 5 and unique["channel"] == 3


def test_text_columns_have_bars(spark):
    frame = spark.range(60).selectExpr("concat('a longer remark ', id % 40) AS remark", "id AS m")
    results = analyze(frame, as_of=AS_OF)
    assert results.category_bars.where("column = 'remark'").count() == 15
    assert "Distribution of remark" in [r["title"] for r in results.chart_plan.collect()]


def test_kpis_and_insights(results):
    names = [r["name"] for r in results.kpis.collect()]
    assert "total_revenue" in names and "revenue_per_unit" in names
    insights = results.insights.collect()
    assert [r["seq"] for r in insights] == list(range(1, len(insights) + 1))
    priorities = [r["priority"] for r in insights]
    assert priorities == sorted(priorities) and priorities[0] == 1
    assert insights[0]["title"] == "Dataset contains 1,010 records across 10 columns"
    dominant = [r["subject"] for r in insights if "dominated" in r["title"]]
    assert dominant == ["return_flag"]
    assert any(r["subject"] == "revenue" and "extreme" in r["title"] for r in insights)


def test_series_and_segments(results):
    assert results.series.where("measure = 'revenue'").count() == 12
    combinations = {(r["dimension"], r["measure"]) for r in results.segments.collect()}
    assert len(combinations) == 4 * 3
    assert results.confidence.first()["confidence_score"] == 1.0


def test_chart_plan_follows_caps(results):
    plan = results.chart_plan.collect()
    kinds = [r["chart_type"] for r in plan]
    assert len(plan) <= 30
    assert kinds.count("bar_segment") == 4 and kinds[-1] == "kpi_card"
    assert kinds.count("histogram") == 3 and kinds.count("line") == 3
    assert "bar_horizontal" not in kinds  # the only gaps are in an ignored column


def test_all_sections_can_be_written(results, spark, tmp_path):
    folders = write_sections(results.sections(), str(tmp_path))
    assert len(folders) == len(results.sections())
    assert spark.read.parquet(f"{tmp_path}/kpi_card").count() == 3


@pytest.mark.parametrize(
    "rows, schema",
    [
        ([], "a int, b string, c timestamp"),
        ([(1, "x", None)], "a int, b string, c timestamp"),
        ([(None, None, None)] * 3, "a int, b string, c double"),
        ([([1.0],), ([2.0],)], "v array<double>"),
        ([("only text",), ("more text",)], "t string"),
        (
            [(float(i), i % 3, f"k{i % 2}", f"2024-{i % 12 + 1:02d}-01") for i in range(24)],
            "`a.b` double, `c d` int, `e``f` string, `Größe (%)` string",
        ),
    ],
)
def test_odd_tables_run_through(spark, rows, schema):
    results = analyze(spark.createDataFrame(rows, schema), as_of=AS_OF)
    for name, frame in results.sections().items():
        frame.collect()
    assert results.dataset_summary.first()["rows"] == len(rows)


def test_insights_are_capped(spark, sales):
    config = Config(report=ReportRules(max_insights=2))
    assert analyze(sales.drop("Notes"), config, as_of=AS_OF).insights.count() == 2


def test_approximate_pipeline(spark):
    frame = spark.range(3000).selectExpr("id", "id % 5 AS few", "(id % 700) * 1.5 AS m")
    exact = analyze(frame, as_of=AS_OF)
    approx = analyze(frame, Config(schema=SchemaRules(distinct="approx")), as_of=AS_OF)
    assert approx.column_catalog.select("column_name", "inferred_type").collect() == (
        exact.column_catalog.select("column_name", "inferred_type").collect()
    )
    assert approx.insights.collect() == exact.insights.collect()


@pytest.mark.parametrize("rows, score", [(10, 0.65), (100, 0.75), (1000, 0.85)])
def test_confidence(spark, rows, score):
    frame = spark.range(rows).selectExpr("IF(id % 2 = 0, id, NULL) AS a")
    assert confidence_score(null_profile(frame), rows).first()[0] == score


def test_confidence_never_below_half(spark):
    frame = spark.createDataFrame([(None,)] * 3, "a int")
    assert confidence_score(null_profile(frame), 3).first()[0] == 0.5


def test_strong_pairs_have_points_and_lines(spark):
    frame = spark.range(400).selectExpr(
        "id % 60 AS a", "(id % 60) * 2 + id % 2 AS b", "concat('k', id % 3) AS kind"
    )
    config = Config(charts=ChartRules(max_scatter_points=100))
    results = analyze(frame, config, as_of=AS_OF)
    assert results.scatter_points.count() == 100
    fits = results.scatter_fits.collect()
    assert {r["color"] for r in fits} == {"k0", "k1", "k2"}
    assert sum(r["points"] for r in fits) == 400
