import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from autoprofile.llm import language_id as L

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
STEMS = {"aa": "ka lo mi ta ru ne so pe".split(), "bb": "str gn ux eff wyn zor qua ij".split()}


def text_of(rnd, language, words):
    stems = STEMS[language]
    return " ".join("".join(rnd.choices(stems, k=rnd.randint(1, 4))) for _ in range(words))


@pytest.fixture(scope="module")
def labelled():
    rnd = random.Random(1)
    return [(i, text_of(rnd, lang, 40), lang) for i, lang in enumerate(["aa", "bb"] * 60)]


@pytest.fixture(scope="module")
def model(spark, labelled):
    return L.fit(spark.createDataFrame(labelled, "doc_id long, text string, lang string"))


def test_probabilities_sum_to_one(model):
    """After any context all symbols together have probability 1, under every language."""
    rnd = random.Random(3)
    letters = sorted({c for s in STEMS.values() for w in s for c in w} | {" "})
    every = np.arange(model.symbol_count)
    for _ in range(20):
        start = " " + "".join(rnd.choices(letters, k=5)).strip()
        codes, _ = L.symbols([start], model.symbol_of)
        rows = np.concatenate([np.append(codes, s) for s in every])
        owner = np.repeat(every, len(codes) + 1)
        last = (len(codes) + 1) * (every + 1) - 1
        total = np.exp2(-model.bits(rows, owner)[last].astype(float)).sum(axis=0)
        np.testing.assert_allclose(total, 1.0, rtol=1e-3)


def test_predictions_and_rejection(spark, model):
    rnd = random.Random(9)
    rows = [(1, text_of(rnd, "aa", 30)), (2, text_of(rnd, "bb", 30)), (3, None), (4, ""),
            (5, "12 -- 34 !!"), (6, "жшчщ " * 60), (7, text_of(rnd, "aa", 20_000)),
            (1, text_of(rnd, "bb", 5))]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("x"))
    found = [tuple(r) for r in L.identify(df, model).orderBy("doc_id", "lang_pred").collect()]
    assert [(r[0], r[1], r[4]) for r in found] == [
        (1, "aa", False), (1, "bb", False), (2, "bb", False), (3, "und", True), (4, "und", True),
        (5, "und", True), (6, found[6][1], True), (7, "aa", False),
    ]
    assert all(0 <= r[2] <= 1 for r in found)
    kept = L.accepted(df, model)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 1, 2, 7]


def test_nothing_to_learn(spark):
    for rows in ([], [(1, "a b", None)], [(1, None, "aa")], [(1, "123", "aa")]):
        df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
        found = L.evaluate_split(df).collect()
        assert [(r["lang_pred"], r["score"]) for r in found] == [("und", 0.0)] * len(rows)


def test_folds(spark):
    import zlib

    df = spark.range(50).select(F.col("id").alias("doc_id"), F.lit("a").alias("text"),
                                F.lit("x").alias("lang"))
    found = {r["doc_id"]: r["held_out"] for r in L.evaluate_split(df).collect()}
    assert found == {i: zlib.crc32(str(i).encode()) % 3 == 1 for i in range(50)}


def test_no_language_is_lost(spark):
    """Labels with one text, with texts far beyond the bound, and with null keys are all learnt."""
    rnd = random.Random(5)
    names = [f"l{i:02}" for i in range(40)]
    letters = {n: chr(0x4E00 + 3 * i) + chr(0x4E01 + 3 * i) for i, n in enumerate(names)}
    rows = [(i, "".join(rnd.choices(letters[n], k=30)), n) for i, n in enumerate(names)]
    large = [(100 + i, text_of(rnd, "aa", 60), "aa") for i in range(3)]
    null = [(None, text_of(rnd, "bb", 60), "bb"), (None, "123", "bb")]
    df = spark.createDataFrame(rows + large + null, "doc_id long, text string, lang string")
    model = L.fit(df, rules=L.LanguageRules(sample_chars=20))
    assert model.languages == sorted([*names, "aa", "bb"])
    assert model.judge([r[1] for r in rows])[0] == names


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")
def test_held_out_accuracy(spark):
    documents = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    found = L.evaluate_split(documents).join(documents.select("doc_id", "lang", "n_chars"), "doc_id")
    right = found.filter("held_out AND n_chars >= 20").agg(
        F.avg((F.col("lang") == F.col("lang_pred")).cast("double")),
        F.avg(F.col("rejected").cast("double")),
    ).first()
    assert right[0] >= 0.98 and right[1] <= 0.005
