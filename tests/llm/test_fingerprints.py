import hashlib
import random

from pyspark.sql import functions as F

from autoprofile.llm import fingerprints as P

TEXT = "First line. More words here, and more.\nSecond line of it.\n\n \nNext section begins now."


def prints(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rows = df.select("i", P.fingerprint(F.col("t")).alias("p")).orderBy("i").collect()
    return [r["p"] for r in rows]


def test_cuts_lose_nothing(spark):
    rnd = random.Random(5)
    texts = ["".join(rnd.choices("ab. \n\t!é?,\r ", k=rnd.randint(0, 90))) for _ in range(400)]
    texts += ["", "\n", "\n\n\n", "x" * 100_000, "a b " * 9000]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    joined = F.concat_ws("", F.flatten(F.flatten(P.leaves(F.col("t"), P.TreeRules()))))
    assert df.filter(joined != F.col("t")).count() == 0


def test_equal_texts_have_equal_fingerprints(spark):
    a, b, c, empty, null = prints(spark, [TEXT, TEXT, TEXT + " ", "", None])
    assert a == b != c and empty == null != a
    assert len(set(prints(spark, ["a\nb", "a b", "ab", "a\n\nb", "a. b", "a.b"]))) == 6


def test_differing_branches_locate_an_edit(spark):
    edited = TEXT.replace("Second", "Other")
    one, two = prints(spark, [TEXT, edited])
    frame = spark.createDataFrame([(one, two)], "a string, b string")
    found = frame.select(
        P.changed_branches(F.col("a"), F.col("b")).alias("x"),
        P.changed_branches(F.col("a"), F.col("a")).alias("same"),
        P.likeness(F.col("a"), F.col("b")).alias("near"),
        P.likeness(F.col("a"), F.col("a")).alias("one"),
    ).first()
    assert [tuple(x) for x in found["x"]] == [(0, 1)]
    assert found["same"] == [] and found["one"] == 1.0 and 0.5 < found["near"] < 1


def edited_text(text, following):
    cut = len(text) // 4
    return text[: len(text) - cut] + following[:cut]


def check(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("t", F.lit(1))
    found = P.compare_with_edits(df).collect()
    assert len(found) == len(rows)
    got = sorted((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in found)
    ordered = [(k, t or "") for k, t in sorted(rows, key=lambda r: r[0])]
    expected = []
    for i, (key, text) in enumerate(ordered):
        after = ordered[(i + 1) % len(ordered)][1]
        digest = hashlib.sha256(edited_text(text, after).encode()).hexdigest()
        expected.append((key, len(text), digest))
    assert got == sorted(expected)
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in found)
    return found


def test_edits_by_the_next_document(spark):
    rnd = random.Random(2)
    words = ["wörd", "two", "three.", "🎉", "line\n", "six"]
    rows = [(i * 7 - 300, " ".join(rnd.choices(words, k=rnd.randint(0, 300)))) for i in range(150)]
    rows += [(5000, None), (5001, ""), (5002, "ab" * 60_000), (5003, "Same Same " * 4000)]
    found = check(spark, rows)
    repeated = next(r for r in found if r["doc_id"] == 5003)
    assert repeated["near_edited"] > 0.7


def test_small_tables(spark):
    check(spark, [(1, "only one document here")])
    check(spark, [(2, "b"), (1, "a longer text of words")])
    df = spark.createDataFrame([], "doc_id long, text string")
    assert P.compare_with_edits(df).collect() == []


def test_repeated_and_null_keys(spark):
    rows = [(None, "no key"), (3, "x y z w"), (3, "x y z w"), (3, "other words at all"), (1, "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert P.compare_with_edits(df).count() == 5
