import hashlib
from collections import defaultdict

import numpy as np
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from autoprofile.llm import exact_dedup
from autoprofile.llm.common import marked_among
from autoprofile.llm.exact_dedup import QuotientFilter, exact_duplicates, normalised

PRINTS = st.lists(st.integers(0, 2**40 - 1), min_size=1, max_size=60)


def counted(values):
    keys, counts = np.unique(np.array(values, dtype=np.uint64), return_counts=True)
    return keys.tolist(), counts.tolist()


@given(PRINTS, PRINTS)
def test_filters_merge_without_loss(one, two):
    filters = [QuotientFilter.of(40, np.array(x * 3, dtype=np.uint64)) for x in (one, two)]
    read = [QuotientFilter.from_bytes(f.to_bytes()) for f in filters]
    merged = QuotientFilter.merged(read)
    assert (merged.fingerprints().tolist(), merged.counts.tolist()) == counted((one + two) * 3)


def test_large_counts_survive():
    own = QuotientFilter.of(64, np.array([7, 2**63], np.uint64), np.array([10**12, 255]))
    again = QuotientFilter.from_bytes(own.to_bytes())
    assert again.counts.tolist() == [10**12, 255]
    assert again.fingerprints().tolist() == [7, 2**63]


def expected(rows):
    groups = defaultdict(list)
    for key, text in rows:
        groups[normalised((text or "").encode())].append((key, text or ""))
    out = []
    for text, members in groups.items():
        members.sort(key=lambda m: (-len(m[1]), m[0] is None, m[0]))
        keep = members[0][0]
        for place, (key, _) in enumerate(members):
            out.append((key, keep, len(members), place == 0, hashlib.sha256(text).hexdigest()))
    return sorted(out, key=str)


ROWS = [
    (4, "a b"), (2, "ab"), (3, " a  b"), (9, None), (1, ""), (5, "\t\n"), (6, "Ab"),
    (7, "a b"), (8, "x" * 50_000), (10, "x" * 50_000), (None, "solo"), (None, "a b"),
    (11, "same"), (11, "same"), (12, "é " * 40),
]


def found(df):
    return sorted(map(tuple, exact_duplicates(df).collect()), key=str)


def test_against_brute_force(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string").withColumn("n", F.lit(1))
    assert found(df) == expected(ROWS)
    assert found(df.repartition(3)) == expected(ROWS)


def test_many_slices(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "SLICE_ROWS", 16)
    rows = [(i, f"text {i % 90} {'copy' if i % 7 else ''}") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(df) == expected(rows)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert exact_duplicates(df).collect() == []


def test_only_repeated_fingerprints_are_marked(spark):
    rows = spark.range(5000).withColumn("k", F.col("id") % 4000)
    often = spark.range(1000).select(F.col("id").alias("print"))
    marked = marked_among(rows, F.col("k"), often, F.col("print"), "seen")
    found = {r["k"]: r["seen"] for r in marked.collect()}
    assert marked.count() == 5000
    assert all(found[k] for k in range(1000))
    assert sum(found.values()) <= 1010
    nothing = marked_among(rows, F.col("k"), often.limit(0), F.col("print"), "seen")
    assert not nothing.filter("seen").count()
