"""From raw documents to token ids: language, copies, near copies, mixture, encoding.

Every stage takes the documents that its predecessor kept and returns those it keeps, with the
columns of ``documents``; the last returns token ids.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from autoprofile.llm import byte_bpe, exact_dedup, jaccard_join, language_id, mixing
from autoprofile.llm.common import settle, table


def _unused(docs: DataFrame, name: str) -> str:
    """A column name that none of the documents' columns has."""
    return "_" * max(map(len, docs.columns)) + name


def known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text fits one of the languages learnt from the labelled documents.

    Texts that are null or have no letter are rejected, and so are texts far from every
    language.  Without any labelled document there is no language and nothing stays.
    """
    return language_id.accepted(docs, language_id.fit(docs))


def distinct_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of texts that are equal without white space.

    Rows that repeat both doc_id and text are one document.
    """
    found = exact_dedup.exact_duplicates(docs).filter("kept")
    sha, key, own = (_unused(docs, x) for x in ("sha", "id", "own"))
    kept = found.select(F.col("doc_id").alias(key), F.col("text_sha256").alias(own))
    marked = docs.withColumn(sha, exact_dedup.normalised_sha(F.col("text")))
    same = F.col("doc_id").eqNullSafe(F.col(key)) & (F.col(sha) == F.col(own))
    return marked.join(kept, same, "left_semi").dropDuplicates(["doc_id", sha]).drop(sha)


def _by_row(docs: DataFrame, row: str) -> DataFrame:
    """The documents with a number of their own in column ``row``.

    That is doc_id where it tells all rows apart.  Where some share one or have none, the
    documents are written once more, numbered.
    """
    copies = docs.groupBy("doc_id").agg(F.count("*").alias("n"))
    if copies.filter("doc_id IS NULL OR n > 1").limit(1).count():
        return settle(docs.withColumn(row, F.monotonically_increasing_id()))
    return docs.withColumn(row, F.col("doc_id").cast("long"))


def distinct_contents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near copies: the one with the smallest doc_id, null last.

    Near copies share 85 in 100 of their 4-word shingles, directly or through others.  Rows are
    told apart by content: unlike texts that share a doc_id, or have none, all stay, and of
    rows that repeat a text one does.  Documents without any word all stay.
    """
    row, own = _unused(docs, "row"), _unused(docs, "own")
    rows = _by_row(docs, row)
    found = jaccard_join.jaccard_join(rows, key=row)
    order = F.struct(F.col("doc_id").isNull(), "doc_id", row)
    first = (
        found.select(row, "component_id")
        .join(rows.select(row, "doc_id"), row)
        .groupBy("component_id")
        .agg(F.min(order)[row].alias(own))
        .select(own)
    )
    return rows.join(first, F.col(row) == F.col(own), "left_semi").drop(row)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mixture takes, each row as often as it takes that row.

    Documents without words are never taken; a null source is a source of its own.  Rows that
    repeat doc_id or text, or have null in them, are rows of their own; an empty table stays
    empty.
    """
    row, key, copies, copy = (_unused(docs, x) for x in ("row", "id", "copies", "copy"))
    rows = _by_row(docs, row)
    documents, _ = mixing.mix(rows, keys=(row,))
    taken = documents.filter("copies > 0").select(
        F.col(row).alias(key), F.col("copies").cast("int").alias(copies)
    )
    joined = rows.join(taken, F.col(row) == F.col(key)).drop(row, key)
    repeated = F.explode(F.array_repeat(F.lit(1), F.col(copies)))
    return joined.withColumn(copy, repeated).drop(copies, copy)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and the digest of what they decode to.

    A row for each row: null and empty texts have no ids, rows that repeat are rows of their own.
    """
    return byte_bpe.round_trip(
        docs,
        public_tokenizers.path("byte_bpe_50k.tiktoken"),
        public_tokenizers.PATTERN,
        with_ids=True,
    )


STAGES = [
    ("language ID", known_languages),
    ("exact dedup", distinct_texts),
    ("n-gram Jaccard join", distinct_contents),
    ("mixing sources to target weights", mixture),
    ("byte-level BPE encoding and decoding", token_ids),
]

#: language models, hashed shuffles and BPE are beyond SQL; tests hold the rows against a
#: brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
