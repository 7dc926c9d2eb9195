"""Putting texts back in place of the keys they were counted by, and ranking by the texts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from autoprofile.functions.coerce import family, quoted
from autoprofile.functions.keys import LONG_TEXT, head, is_digest, text_key
from autoprofile.operators.wide import empty_frame, local_frame

#: candidates up to this many are resolved on the driver, more of them by a join
LOCAL_CANDIDATES = 10_000


def texts_behind(df: DataFrame, name: str, digests: list[str]) -> dict[str, str]:
    """The texts of column ``name`` with these keys: one filtered scan, a row per key."""
    key = text_key(quoted(name))
    rows = (
        df.where(key.isin(*digests))
        .groupBy(key.alias("digest"))
        .agg(F.any_value(quoted(name)).alias("text"))
        .collect()
    )
    return {r["digest"]: r["text"] for r in rows}


def _looked_up(df: DataFrame, rows: list, column_field: str, key_field: str) -> DataFrame:
    """(column, key, text) of the digests among few candidates."""
    digests: dict[str, set[str]] = {}
    for row in rows:
        if is_digest(row[key_field]):
            digests.setdefault(row[column_field], set()).add(row[key_field])
    found = [
        (name, digest, text)
        for name, wanted in digests.items()
        for digest, text in texts_behind(df, name, sorted(wanted)).items()
    ]
    schema = f"{column_field} string, {key_field} string, full_text string"
    return F.broadcast(local_frame(df.sparkSession, found, schema))  # a row per digest


def _joined_up(
    df: DataFrame, names: list[str], firsts: DataFrame, column_field: str, key_field: str
) -> DataFrame:
    """(column, key, text) of all long texts that begin like one of ``firsts``.

    Whatever the number of candidates, a text is shuffled once per task, however often it is
    there.
    """
    texts = [
        df.select(
            F.lit(name).alias(column_field), text_key(quoted(name)).alias(key_field),
            quoted(name).alias("full_text"),
        )
        for name in names
        if family(df.schema[name].dataType) == "string"
    ]
    if not texts:
        schema = f"{column_field} string, {key_field} string, full_text string"
        return empty_frame(df.sparkSession, schema)
    begins = firsts.select(column_field, "head").distinct()
    return (
        reduce(DataFrame.unionByName, texts)
        .where(F.octet_length("full_text") >= LONG_TEXT)
        .withColumn("head", head(F.col("full_text")))
        .join(F.broadcast(begins), [column_field, "head"], "left_semi")
        .groupBy(column_field, key_field)
        .agg(F.any_value("full_text").alias("full_text"))
    )


def first_by_text(
    df: DataFrame,
    counted: DataFrame,
    groups: list[str],
    most: list[str],
    names: list[str],
    column_field: str,
    key_field: str,
    top_n: int,
) -> DataFrame:
    """The first ``top_n`` rows of every group, those with the ``most`` first and then by text,
    with ``rank``.

    ``counted`` has keys of texts in ``key_field``, ``column_field`` tells which of the columns
    ``names`` a text is of; groups and ``most`` are never null.  Rows are pre-selected by the
    head of the key, with all that tie at the cut; the texts behind these are looked up in one
    scan, and the rank is decided by the texts themselves.  Any number of rows may tie: only the
    first ``top_n`` of a task are ranked together, others are compared with these where they are.
    """
    order = [F.desc(c) for c in most]
    headed = counted.withColumn("head", head(F.col(key_field)))
    tie = [*groups, *most, "head"]
    before = Window.partitionBy(*groups).orderBy(*order, "head")
    firsts = (
        headed.withColumn("rank", F.row_number().over(before))
        .where(F.col("rank") <= top_n)
        .select(*dict.fromkeys([*tie, column_field]))  # top_n rows per group
    )
    chosen = headed.join(F.broadcast(firsts.select(*tie)), tie, "left_semi").drop("head")
    few = chosen.limit(LOCAL_CANDIDATES + 1).toArrow()
    if few.num_rows <= LOCAL_CANDIDATES:
        chosen = df.sparkSession.createDataFrame(few, chosen.schema)
        rows = few.select([column_field, key_field]).to_pylist()
        texts = _looked_up(df, rows, column_field, key_field)
    else:
        texts = _joined_up(df, names, firsts, column_field, key_field)
    full = chosen.join(texts, [column_field, key_field], "left").select(
        *[
            F.coalesce("full_text", key_field).alias(c) if c == key_field else F.col(c)
            for c in counted.columns
        ]
    )
    final = Window.partitionBy(*groups).orderBy(*order, key_field)
    return full.withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= top_n)
