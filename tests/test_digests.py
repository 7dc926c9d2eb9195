"""Ranking by texts of which only keys were counted, also where very many of them tie."""

import json
import pathlib
import random
from collections import defaultdict

import pytest

from autoprofile.operators import digests, heavy
from autoprofile.operators.frequencies import top_texts
from autoprofile.operators.segments import segment_grid

TITLE = "the same long beginning of every title, " * 3


@pytest.fixture
def uncoalesced(spark):
    """Small partitions stay apart, as large ones would."""
    set_to = {"spark.sql.adaptive.coalescePartitions.enabled": "false",
              "spark.sql.shuffle.partitions": "8", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in set_to}
    for k, v in set_to.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.fixture
def most_read(spark):
    """A call gives the most shuffled rows that a task read since the test began."""
    folder = pathlib.Path(spark.conf.get("spark.eventLog.dir").removeprefix("file:"))

    def text():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        return "".join(p.read_text(errors="replace") for p in folder.iterdir() if p.is_file())

    begin = len(text())

    def most():
        ends = (json.loads(x) for x in text()[begin:].split("\n") if "Shuffle Read Metrics" in x)
        return max(e["Task Metrics"]["Shuffle Read Metrics"]["Total Records Read"]
                   for e in ends if e["Event"] == "SparkListenerTaskEnd")

    return most


def test_texts_that_tie_are_dealt_out(spark, monkeypatch, uncoalesced, most_read):
    monkeypatch.setattr(digests, "LOCAL_CANDIDATES", 50)
    rows = [(f"{TITLE}{i:05d}", 1) for i in range(6000)] + [(TITLE, 1)] * 6000
    frame = spark.createDataFrame(rows, "d string, m long").repartition(4)
    found = segment_grid(frame, ["d"], ["m"], top_n=4).orderBy("rank").collect()
    assert [(r["segment"], r["total"], r["count"]) for r in found] == [
        (TITLE, 6000.0, 6000), *((f"{TITLE}{i:05d}", 1.0, 1) for i in range(3))]
    assert most_read() < 4000  # of 12,000 rows in 4 partitions and 6001 texts in 8


def test_frequent_texts_that_tie_are_dealt_out(spark, monkeypatch, uncoalesced, most_read):
    monkeypatch.setattr(digests, "LOCAL_CANDIDATES", 50)
    monkeypatch.setattr(heavy, "BUCKETS", 64)
    frame = spark.createDataFrame([(f"{TITLE}{i:05d}",) for i in range(6000)], "t string")
    found = top_texts(frame.repartition(4), ["t"], 3).orderBy("rank").collect()
    assert [(r["value"], r["count"]) for r in found] == [
        (f"{TITLE}{i:05d}", 1) for i in range(3)]
    assert most_read() < 4000


def brute_force(rows, dimension, measure, top_n):
    totals, counts = defaultdict(float), defaultdict(int)
    for row in rows:
        segment = "nan" if row[dimension] is None else row[dimension]
        totals[segment] += row[measure] or 0
        counts[segment] += row[measure] is not None
    order = sorted(totals, key=lambda s: (-round(totals[s], 4), s.encode()))[:top_n]
    return [(s, round(totals[s], 4), counts[s]) for s in order]


@pytest.mark.parametrize("local", [0, 10_000])
def test_grid_of_texts_equals_brute_force(spark, monkeypatch, local):
    """Short and long texts, alike and unlike beginnings, missing values, ties, no ties."""
    monkeypatch.setattr(digests, "LOCAL_CANDIDATES", local)
    dice = random.Random(7)
    texts = [None, "", "short", "tîtle", "nan", TITLE, *(f"{TITLE}{i}" for i in range(40)),
             *("é" * 40 + str(i) for i in range(20)), *(f"{i} {TITLE}" for i in range(20))]
    rows = [
        (dice.choice(texts), dice.choice(texts[:30]), dice.choice([None, 1, 1, 2, -1]),
         dice.choice([None, 0.0, -0.0, 0.5]), dice.randrange(3))
        for _ in range(300)
    ]
    frame = spark.createDataFrame(rows, "a string, b string, m long, n double, c int")
    for top_n in (1, 5, 200):
        grid = segment_grid(frame, ["a", "b", "c"], ["m", "n"], top_n=top_n).collect()
        plain = [(r[0], r[1], r[2], r[3], str(r[4])) for r in rows]
        for d, dimension in ((0, "a"), (1, "b"), (4, "c")):
            for m, measure in ((2, "m"), (3, "n")):
                part = [(r["segment"], r["total"], r["count"])
                        for r in sorted(grid, key=lambda r: r["rank"])
                        if (r["dimension"], r["measure"]) == (dimension, measure)]
                assert part == brute_force(plain, d, m, top_n)
