import json
import pathlib
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "6g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .config("spark.eventLog.enabled", "true")
        .config("spark.eventLog.dir", str(tmp_path_factory.mktemp("events")))
        .config("spark.eventLog.rolling.enabled", "false")
        .config("spark.eventLog.compress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def by_column():
    """Rows of a result keyed by their column name."""

    def keyed(frame, key="column"):
        return {r[key]: r for r in frame.collect()}

    return keyed


@pytest.fixture
def executed_plans(spark):
    """A call gives the plans of all queries that ran since the test began."""
    folder = pathlib.Path(spark.conf.get("spark.eventLog.dir").removeprefix("file:"))

    def text():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        return "".join(p.read_text(errors="replace") for p in folder.iterdir() if p.is_file())

    begin = len(text())

    def plans():
        events = (json.loads(x) for x in text()[begin:].split("\n") if "physicalPlanDesc" in x)
        return [e["physicalPlanDescription"] for e in events]

    return plans
