"""The corpus operators as queries over the shared tables."""

from __future__ import annotations

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from autoprofile.llm import (
    archives,
    byte_bpe,
    exact_dedup,
    fingerprints,
    jaccard_join,
    language_id,
    mixing,
    packing,
    prefix_trie,
    pseudonyms,
    quotations,
    token_counts,
    whitening,
)
from autoprofile.llm.common import table


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_join(table(spark, sf_dir, "documents"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(
        table(spark, sf_dir, "documents"),
        public_tokenizers.path("byte_bpe_50k.tiktoken"),
        public_tokenizers.PATTERN,
    )


def op3_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the table itself quotes nothing; as mail, every message quotes the two before it
    mail = quotations.as_replies(table(spark, sf_dir, "conversations"))
    return quotations.reply_ordered(mail)


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_with_edits(table(spark, sf_dir, "documents"))


def op5_packed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(
        table(spark, sf_dir, "documents"),
        public_tokenizers.path("byte_bpe_50k.tiktoken"),
        public_tokenizers.PATTERN,
    )


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, _ = mixing.mix(table(spark, sf_dir, "documents"))
    return documents.select("doc_id", "size", "source_size", "target", "taken")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(
        table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model")
    )


#: the key of the registered query; a real one is a secret of who runs the job
PSEUDONYM_KEY = "registered query"


def op8_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = pseudonyms.PseudonymRules(key=PSEUDONYM_KEY)
    return pseudonyms.pseudonymise(table(spark, sf_dir, "documents"), rules)


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = language_id.evaluate_split(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "held_out", "lang_pred", "score")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


def op12_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = archives.archive_pages(table(spark, sf_dir, "pages"))
    return found.select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_jaccard_join": op1_jaccard_join,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_quotation_linking": op3_quotation_linking,
    "op4_fingerprints": op4_fingerprints,
    "op5_packed_ids": op5_packed_ids,
    "op6_mix_sources": op6_mix_sources,
    "op7_token_counts": op7_token_counts,
    "op8_pseudonyms": op8_pseudonyms,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_language_id": op10_language_id,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_archives": op12_archives,
    "op13_whitening": op13_whitening,
    "pipeline": corpus_pipeline.run,
}

#: exact twins in SQL, where SQL can express the operator
SQL = {
    "op6_mix_sources": r"""
WITH d AS (
  SELECT doc_id, source, md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS shuffled,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
sized AS (SELECT source, CAST(sum(size) AS BIGINT) AS words FROM d GROUP BY source),
weighted AS (
  SELECT source, words, 3 * words AS cap,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3
           WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM sized),
whole AS (SELECT sum(words) AS budget, sum(weight) AS weights FROM weighted),
levels AS (
  SELECT cap / weight AS reach, source,
         (budget - (sum(cap) OVER w - cap)) / CAST(weights - (sum(weight) OVER w - weight) AS DOUBLE)
           AS level
  FROM weighted, whole WINDOW w AS (ORDER BY cap / weight, source NULLS LAST)),
level AS (SELECT level FROM levels WHERE level <= reach ORDER BY reach, source LIMIT 1),
targets AS (
  SELECT source, words, weight,
         least(weight * coalesce((SELECT level FROM level), 0), CAST(cap AS DOUBLE)) AS target
  FROM weighted),
placed AS (
  SELECT d.doc_id, d.source, d.size, d.shuffled, t.words, t.weight,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.shuffled) AS until
  FROM d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source WHERE d.size > 0),
copies AS (
  SELECT doc_id, source, size, shuffled, epoch, (epoch * words + until) / weight AS finish
  FROM placed, (VALUES (0), (1), (2)) AS e(epoch)),
queue AS (
  SELECT doc_id, size, sum(size) OVER (
    ORDER BY finish, source NULLS LAST, epoch, shuffled
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS until FROM copies),
taken AS (
  SELECT doc_id, count(*) AS copies FROM queue, whole WHERE until - size / 2 <= budget
  GROUP BY doc_id)
SELECT d.doc_id, CAST(d.size AS BIGINT) AS size, t.words AS source_size, t.target,
       CAST(d.size * coalesce(c.copies, 0) AS BIGINT) AS taken
FROM d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
LEFT JOIN taken c ON d.doc_id = c.doc_id""",
    "op9_exact_dedup": r"""
WITH t AS (
  SELECT doc_id, coalesce(length(text), 0) AS n,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS x FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY x) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept, sha256(x) AS text_sha256
FROM t WINDOW w AS (PARTITION BY x ORDER BY n DESC, doc_id)""",
    # crc32 bit by bit; a prefix is named by the digests of its turns, in order
    "op11_prefix_trie": r"""
WITH t AS (
  SELECT conv_id, md5(len(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))
           AS said, len(coalesce(text, '')) AS points,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (
  SELECT conv_id, list(said ORDER BY place) AS said, list(points ORDER BY place) AS points,
         xor(4294967295, list_reduce(
           list_prepend(4294967295, list_transform(
             string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
           lambda crc, x: list_reduce(list_prepend(xor(crc, x), [0, 0, 0, 0, 0, 0, 0, 0]),
             lambda y, _: CASE WHEN y % 2 = 1 THEN xor(y >> 1, 3988292384) ELSE y >> 1 END))) % 6 AS h
  FROM t GROUP BY conv_id),
rebuilt AS (
  SELECT c.conv_id, list_concat(coalesce(b.said[1:c.h], []), c.said[c.h + 1:]) AS said,
         list_concat(coalesce(b.points[1:c.h], []), c.points[c.h + 1:]) AS points
  FROM c LEFT JOIN c AS b ON b.conv_id = c.conv_id - c.conv_id % 100),
prefixes AS (
  SELECT conv_id, depth, array_to_string(said[1:depth], '') AS node, len(said) = depth AS ends,
         array_to_string(said[1:depth - 1], '') AS parent,
         CASE WHEN depth > 0 THEN points[depth] ELSE 0 END AS points
  FROM rebuilt, unnest(range(0, len(said) + 1)) AS d(depth)),
nodes AS (
  SELECT depth, node, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(parent) AS parent,
         (count(*) - 1) * any_value(points) AS saved,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)
                           FILTER (ends), '')) AS ends_sha256
  FROM prefixes GROUP BY depth, node),
counted AS (
  SELECT n.*, (SELECT count(*) FROM nodes k WHERE k.depth = n.depth + 1 AND k.parent = n.node)
           AS n_children FROM nodes n),
subtrees AS (
  SELECT p.depth, p.node, sum(k.saved) AS saved_tokens,
         count(*) FILTER (k.n_children = 0) AS n_leaves
  FROM counted k JOIN prefixes p ON p.conv_id = k.conv_id AND p.depth <= k.depth
  GROUP BY p.depth, p.node)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, s.n_leaves,
       CAST(s.saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM counted n JOIN subtrees s ON s.depth = n.depth AND s.node = n.node
LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.node = n.parent""",
    "op12_archives": """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d
  FROM pages),
f AS (SELECT *, first_value(page_id) OVER w AS first_id, row_number() OVER w AS place FROM p
      WINDOW w AS (PARTITION BY d ORDER BY page_id))
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
       CASE WHEN n >= 100 AND place > 1 THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND place > 1 THEN first_id END AS refers_to
FROM f""",
}
