import time
from collections import defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from autoprofile.llm.mixing import MixRules, mix, source_targets, word_count


def level_targets(words, rules=MixRules()):
    """Targets by filling up step by step, with exact fractions."""
    order = sorted((s for s in words if s is not None)) + [None] * (None in words)
    weight = {s: rules.weights[i % len(rules.weights)] for i, s in enumerate(order)}
    left = Fraction(sum(words.values())) * Fraction(rules.share)
    target = {s: Fraction(0) for s in words}
    free = set(words)
    while left > 0 and free:
        whole = sum(weight[s] for s in free)
        step = min(
            [left / whole]
            + [(rules.repeats * words[s] - target[s]) / weight[s] for s in free]
        )
        for s in free:
            target[s] += step * weight[s]
        left -= step * whole
        free = {s for s in free if target[s] < rules.repeats * words[s]}
    return {s: float(t) for s, t in target.items()}


@pytest.mark.parametrize("words", [
    {"a": 100, "b": 100, "c": 100}, {"a": 1, "b": 1000, "c": 5, "d": 10, None: 3},
    {"a": 0, "b": 7}, {"a": 10_000, "b": 1}, {None: 5}, {"a": 0},
])
def test_targets(spark, words):
    sizes = spark.createDataFrame(list(words.items()), "source string, words long")
    found = {r["source"]: r["target"] for r in source_targets(sizes, MixRules()).collect()}
    assert found == pytest.approx(level_targets(words))


def test_word_count(spark):
    texts = [None, "", " ", "a", " a\tb\n\x0b\x0cc\r ", "a b c", "\x1ca b"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in rows.select(word_count(F.col("t"))).collect()] == [0, 0, 0, 1, 3, 3, 2]


@pytest.fixture(scope="module")
def documents(spark):
    rows = [(i, "w " * (1 + i * 7 % 23), ["big", "mid", "low", None][min(3, i % 11 // 3)], "x")
            for i in range(600)]
    rows += [(600, None, "mid", "x"), (601, "", None, "x"), (5, "w w", "big", "x"),
             (5, "w w", "big", "x"), (602, "w " * 3000, "low", "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size string")


def test_mixture(documents):
    found, queue = mix(documents)
    rows = found.collect()
    assert len(rows) == 605
    target = {r["source"]: r["target"] for r in rows}
    words = {r["source"]: r["source_size"] for r in rows}
    assert target == pytest.approx(level_targets(words))
    taken = defaultdict(int)
    for r in rows:
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    for s, t in target.items():
        assert abs(taken[s] - t) <= 3000  # the words of the largest document
    ordered = queue.orderBy("words_until").collect()
    assert [r["finish"] for r in ordered] == sorted(r["finish"] for r in ordered)
    assert sum(r["size"] for r in ordered) == sum(taken.values())


def test_reruns_and_layouts_agree(documents):
    one, two = (
        sorted(map(str, mix(d)[0].collect())) for d in (documents, documents.repartition(7))
    )
    assert one == two


def test_empty_table(documents):
    found, queue = mix(documents.limit(0))
    assert found.collect() == [] and queue.collect() == []


def test_long_white_space_takes_no_longer(spark):
    blank = " \t\n\x0b\x0c\r" * 170_000
    text = f"{blank}one{blank}two three{blank}"
    df = spark.createDataFrame([(1, text), (2, blank), (3, None)], "doc_id long, text string")
    started = time.perf_counter()
    counts = {r["doc_id"]: r["n"] for r in df.select(
        "doc_id", word_count(F.col("text")).alias("n")
    ).collect()}
    assert counts == {1: 3, 2: 0, 3: 0}
    assert time.perf_counter() - started < 20
