"""The most frequent values without counting every value."""

import json
import pathlib
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from autoprofile.operators import heavy as H
from autoprofile.operators.frequencies import frequent_values, top_texts, top_values


def rows_of(frame):
    return sorted(map(tuple, frame.collect()))


@pytest.fixture
def shuffled_rows(spark):
    """A call gives the rows that tasks sent through shuffles since the test began."""
    folder = pathlib.Path(spark.conf.get("spark.eventLog.dir").removeprefix("file:"))

    def total():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        lines = "".join(p.read_text() for p in folder.iterdir() if p.is_file()).split("\n")
        ends = (json.loads(x) for x in lines if x.startswith('{"Event":"SparkListenerTaskEnd"'))
        metrics = (e.get("Task Metrics") or {} for e in ends)
        return sum(m.get("Shuffle Write Metrics", {}).get("Shuffle Records Written", 0)
                   for m in metrics)

    begin = total()
    return lambda: total() - begin


def skewed(spark, rows=1_000_000, hot=40):
    """Half the rows hold few values, more of the first ones; the others are all distinct."""
    value = F.when(F.col("id") % 2 == 0, F.floor(F.sqrt(F.pmod(F.hash("id"), F.lit(hot * hot)))))
    return spark.range(rows, numPartitions=4).select(
        F.coalesce(value, F.col("id") + 1_000_000).alias("v")
    )


def test_only_candidates_move(spark, shuffled_rows):
    frame = skewed(spark)
    found = rows_of(frequent_values(frame, ["v"], 5))
    moved = shuffled_rows()
    # a row per bucket and task, and per bucket once more; of 500,040 distinct values
    assert moved < 5 * H.BUCKETS + 2000
    assert found == rows_of(top_values(frame, ["v"], 5))
    assert shuffled_rows() - moved > 500_000


def test_doubt_opens_more_buckets(spark, monkeypatch):
    monkeypatch.setattr(H, "SHARE", 1.0)
    # rare values fill buckets too, so those of the frequent ones are not the fullest
    monkeypatch.setattr(H, "BUCKETS", 64)
    rows = [(v,) for v, n in (("a", 90), ("b", 20), ("c", 20), ("d", 20)) for _ in range(n)]
    rows += [(f"rare {i % 40}",) for i in range(400)]
    frame = spark.createDataFrame(rows, "v string")
    for top_n in (1, 2, 3, 4, 10, 100):
        assert rows_of(frequent_values(frame, ["v"], top_n)) == rows_of(
            top_values(frame, ["v"], top_n))


def test_flat_columns_are_counted_whole(spark):
    frame = spark.range(5000).select("id", (F.col("id") % 3).alias("few"))
    assert rows_of(frequent_values(frame, ["id", "few"], 4)) == rows_of(
        top_values(frame, ["id", "few"], 4))
    assert H.summaries(frame, ["id"])["id"].first(4) is None


@settings(max_examples=12, deadline=None,
          suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    values=st.lists(st.one_of(st.none(), st.integers(0, 12), st.integers(0, 10**6)), max_size=80),
    top_n=st.integers(1, 6), buckets=st.sampled_from([1, 3, 16, 1 << 16]),
)
def test_equal_to_counting_everything(spark, monkeypatch, values, top_n, buckets):
    monkeypatch.setattr(H, "BUCKETS", buckets)
    monkeypatch.setattr(H, "SHARE", 1.0)
    frame = spark.createDataFrame([(v,) for v in values], "v long")
    counts = Counter(str(v) for v in values if v is not None)
    first = sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:top_n]
    found = frequent_values(frame, ["v"], top_n).orderBy("rank").collect()
    assert [(r["value"], r["count"]) for r in found] == first


def test_kinds_zeros_and_missing_values(spark):
    frame = spark.createDataFrame(
        [(0.0, True, None), (-0.0, None, None), (float("nan"), True, None), (2.5, False, None)],
        "x double, `odd.name` boolean, none string",
    )
    assert rows_of(frequent_values(frame, frame.columns, 1)) == [
        ("odd.name", 1, "true", 2, 66.67), ("x", 1, "0.0", 2, 66.67)]
    assert frequent_values(frame.limit(0), frame.columns).collect() == []
    assert frequent_values(frame.select(F.array("x").alias("a")), ["a"]).collect() == []
    with pytest.raises(ValueError, match="positive"):
        frequent_values(frame, ["x"], 0)


def test_long_texts_tie_by_text(spark, monkeypatch):
    monkeypatch.setattr(H, "BUCKETS", 8)
    monkeypatch.setattr(H, "SHARE", 1.0)
    rows = [("same begin " * 9 + str(i % 30),) for i in range(90)] + [("x" * 500,)] * 7
    frame = spark.createDataFrame(rows, "t string")
    found = [(r["value"], r["count"]) for r in top_texts(frame, ["t"], 4).orderBy("rank").collect()]
    ties = sorted("same begin " * 9 + str(i) for i in range(30))
    assert found == [("x" * 500, 7)] + [(t, 3) for t in ties[:3]]
