"""Mixing sources to target weights by weighted fair queueing.

Every document of a source, in a shuffled order, gets a virtual finish time: the words of its
source up to its end, divided by the source's weight.  The documents of all sources are sorted
by that time over the cluster and the queue is cut where the budget is spent.  A source that is
too small for its share is gone through again, up to ``repeats`` times; what it still lacks goes
to the others, as a queue that runs empty leaves its time to the rest.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from autoprofile.llm.common import WHITE, column, running_sums, settle


#: the characters of WHITE themselves
BLANKS = " \t\n\x0b\x0c\r"


@dataclass(frozen=True)
class MixRules:
    """Weights go to the sources in order of their names (null last), again and again from the
    first; the budget is ``share`` of all words; ``seed`` decides the order within a source."""

    weights: tuple[int, ...] = (5, 2, 1)
    share: float = 1.0
    repeats: int = 3
    seed: str = "mix"


def word_count(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; 0 for null."""
    plain = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    words = F.size(F.split(plain, f"[{WHITE}]+"))
    return F.when(plain == "", F.lit(0)).otherwise(words).cast("long")


def source_targets(sizes: DataFrame, rules: MixRules) -> DataFrame:
    """source, words, weight, target, words of the sources before it, from (source, words).

    The common level ``v`` at which every source gets min(weight * v, repeats * words) and all
    together the budget is found from running sums over the sources in the order in which they
    reach their limit.
    """
    numbered = running_sums(
        sizes.withColumn("one", F.lit(1).cast("long")),
        [F.col("source").asc_nulls_last()],
        ["one", "words"],
    )
    place = (F.col("one_until") - 1) % len(rules.weights)
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in rules.weights]), (place + 1).cast("int"))
    weighted = settle(
        numbered.select(
            "source",
            "words",
            weight.cast("long").alias("weight"),
            (F.col("words") * rules.repeats).alias("cap"),
            (F.col("words_until") - F.col("words")).alias("words_before"),
        )
    )
    whole = weighted.agg(F.sum("words").alias("words"), F.sum("weight").alias("weight")).first()
    budget = (whole["words"] or 0) * rules.share
    reach = F.col("cap") / F.col("weight")
    level = F.lit(None).cast("double")
    if budget > 0:
        by_reach = running_sums(
            weighted.withColumn("reach", reach),
            [F.col("reach"), F.col("source").asc_nulls_last()],
            ["cap", "weight"],
        )
        # the level if this source and all after it in that order stay below their limit
        candidate = (F.lit(budget) - (F.col("cap_until") - F.col("cap"))) / (
            F.lit(whole["weight"]) - (F.col("weight_until") - F.col("weight"))
        )
        found = (
            by_reach.withColumn("level", candidate)
            .filter("level <= reach")
            .agg(F.min(F.struct("reach", "source", "level"))["level"].alias("level"))
            .first()["level"]
        )
        level = F.lit(found).cast("double")
    target = F.least(
        F.coalesce(F.col("weight") * level, F.col("cap").cast("double")),
        F.col("cap").cast("double"),
    )
    return settle(weighted.withColumn("target", target).drop("cap"))


def mix(
    df: DataFrame,
    keys: tuple[str, ...] = ("doc_id",),
    text: str = "text",
    source: str = "source",
    rules: MixRules = MixRules(),
) -> tuple[DataFrame, DataFrame]:
    """(documents, queue).

    documents: one row per row of ``df``: keys, source, size (words), source_size, target, copies
    and taken (words, copies counted).  queue: the mixture itself, one row per copy taken: keys,
    source, size, epoch, finish (virtual time), words_until (of the whole queue).

    Texts are counted whole, in time that grows with their length, whatever they hold.  A null
    text has no words; documents without words are never taken.  A null source is a source
    of its own, the last.  Rows that repeat keys are rows of their own.  The order within a
    source is that of the MD5 of seed and keys, so reruns agree.  A copy is taken while at least
    half of it fits the budget.  An empty table gives empty results.
    """
    names = [f"k{i}" for i in range(len(keys))]
    texts = [F.coalesce(column(df, k).cast("string"), F.lit("")) for k in keys]
    rows = settle(
        df.select(
            *[column(df, k).alias(n) for k, n in zip(keys, names, strict=True)],
            column(df, source).alias("source"),
            word_count(column(df, text).cast("string")).alias("size"),
            F.md5(F.concat_ws(":", F.lit(rules.seed), *texts)).alias("shuffled"),
        ).withColumn("row", F.monotonically_increasing_id())
    )
    targets = source_targets(
        rows.groupBy("source").agg(F.sum("size").alias("words")), rules
    )
    whole = rows.agg(F.sum("size")).first()[0] or 0
    ordered = running_sums(
        rows.filter("size > 0"),
        [F.col("source").asc_nulls_last(), F.col("shuffled"), F.col("size"), F.col("row")],
        ["size"],
    )
    by_source = targets.withColumnRenamed("source", "own")
    same = F.col("source").eqNullSafe(F.col("own"))
    position = F.col("size_until") - F.col("words_before")
    copies = (
        ordered.join(by_source, same)
        .withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(rules.repeats - 1))))
        .withColumn("finish", (F.col("epoch") * F.col("words") + position) / F.col("weight"))
        .select(*names, "source", "size", "row", "shuffled", "epoch", "finish")
    )
    queue = settle(
        running_sums(
            copies,
            [F.col("finish"), F.col("source").asc_nulls_last(), F.col("epoch"),
             F.col("shuffled"), F.col("row")],
            ["size"],
        ).filter(F.col("size_until") - F.col("size") / 2 <= F.lit(whole * rules.share))
    )
    taken = queue.groupBy("row").agg(F.count("*").alias("copies"))
    documents = (
        rows.join(taken, "row", "left")
        .join(by_source, same)
        .select(
            *[F.col(n).alias(k) for k, n in zip(keys, names, strict=True)],
            F.col("source").alias(source),
            "size",
            F.col("words").alias("source_size"),
            "target",
            F.coalesce("copies", F.lit(0)).cast("long").alias("copies"),
            (F.coalesce("copies", F.lit(0)) * F.col("size")).cast("long").alias("taken"),
        )
    )
    queue = queue.select(
        *[F.col(n).alias(k) for k, n in zip(keys, names, strict=True)],
        F.col("source").alias(source), "size", "epoch", "finish",
        F.col("size_until").alias("words_until"),
    )
    return documents, queue
