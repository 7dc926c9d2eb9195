"""Token counts of a piece vocabulary without encoding the documents.

A document is its pre-tokens (a run of spaces and what follows) and how often each occurs; no
piece reaches across them.  Tasks work on blocks of documents: the distinct pre-tokens of a
block go to the task of their hash, where every distinct pre-token of the corpus is counted
once, and the counts come back to the block, where they are summed by the frequencies of each
document.  Token ids of documents are never made.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from autoprofile.llm.common import byte_lengths, column, nullable, settle, text_parts

#: text of a block
BLOCK_BYTES = 8 << 20
#: text for each task that counts pre-tokens
BUCKET_BYTES = 16 << 20
#: the mark that stands for a space inside pieces; a text may hold it as well
SPACE = "▁"
PRE_TOKEN = re.compile(f"[ {SPACE}]+[^ {SPACE}]*")


class Numbers(dict):
    """Numbers its keys in the order in which they are first asked for."""

    def __missing__(self, key: str) -> int:
        number = self[key] = len(self)
        return number


class PieceCounter:
    """Counts the pieces of single pre-tokens."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = (self.model.id_to_piece(i) for i in range(self.model.get_piece_size()))
        if any(SPACE in piece.lstrip(SPACE) for piece in pieces):
            raise ValueError("the vocabulary has pieces that reach across a space")
        probe = "ﬁ  Aé "
        if self.model.decode(self.model.encode(probe)) != probe:
            raise ValueError("the vocabulary changes texts before it cuts them")
        self.alone = len(self.model.encode("a ")) - len(self.model.encode("a"))

    def count(self, pre_tokens: list[str]) -> np.ndarray:
        """Each pre-token begins with a space, which the model itself puts before a text."""
        found = self.model.encode([p[1:] for p in pre_tokens], num_threads=1)
        counts = np.fromiter(map(len, found), np.int64, len(pre_tokens))
        single = [k for k, p in enumerate(pre_tokens) if len(p) == 1]
        counts[single] = self.alone
        return counts


@lru_cache(maxsize=2)
def load(path: str) -> PieceCounter:
    """The vocabulary of a model file, once per Python worker."""
    return PieceCounter(path)


def _packed(*arrays: np.ndarray) -> bytes:
    """Arrays of unsigned numbers, byte plane by byte plane, compressed."""
    parts = [np.array([len(a) for a in arrays], "<u4").tobytes()]
    parts += [a.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes() for a in arrays]
    return zlib.compress(b"".join(parts), 1)


def _unpacked(data: bytes, arrays: int) -> list[np.ndarray]:
    data = zlib.decompress(data)
    out, at = [], 4 * arrays
    for n in np.frombuffer(data, "<u4", arrays).tolist():
        planes = np.frombuffer(data, np.uint8, 4 * n, at).reshape(4, n)
        out.append(np.ascontiguousarray(planes.T).view("<u4").reshape(n).astype(np.int64))
        at += 4 * n
    return out


def _blocks(buckets: int):
    """For each block: a row with the frequencies of its documents, and a row for each bucket
    with its distinct pre-tokens of that bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        names = ["block", "bucket", "keys", "sizes", "data"]
        for k, part in enumerate(text_parts(batches, "t", BLOCK_BYTES)):
            block = f"{task}.{k}"
            numbers = Numbers()
            ids, counts = [], []
            for text in part["t"].to_pylist():
                found = PRE_TOKEN.findall(" " + text) if text else []
                row = np.array(list(map(numbers.__getitem__, found)), dtype=np.int64)
                row.sort()
                first = np.flatnonzero(np.append(True, row[1:] != row[:-1])[: len(row)])
                ids.append(row[first])
                counts.append(np.diff(np.append(first, len(row))))
            lengths = np.array([len(x) for x in ids])
            steps = np.concatenate([np.diff(x, prepend=0) for x in ids])
            keys = part["k"].combine_chunks()
            yield pa.RecordBatch.from_arrays(
                [pa.array([block]), pa.nulls(1, pa.int32()),
                 pa.ListArray.from_arrays([0, len(keys)], keys),
                 pa.array([byte_lengths(part["t"])], pa.list_(pa.int64())),
                 pa.array([_packed(lengths, steps, np.concatenate(counts))], pa.binary())],
                names=names,
            )
            words = [w.encode() for w in numbers]
            if not words:
                continue
            place = np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % buckets
            order = np.argsort(place, kind="stable")
            used, starts = np.unique(place[order], return_index=True)
            blobs = []
            for piece in np.split(order, starts[1:]):
                own = [words[i] for i in piece.tolist()]
                size = np.array([len(w) for w in own])
                blobs.append(_strings(piece, size, b"".join(own)))
            n = len(used)
            yield pa.RecordBatch.from_arrays(
                [pa.array([block] * n), pa.array(used.astype("int32")),
                 pa.nulls(n, pa.list_(keys.type)), pa.nulls(n, pa.list_(pa.int64())),
                 pa.array(blobs, pa.binary())],
                names=names,
            )

    return run


def _strings(numbers: np.ndarray, sizes: np.ndarray, text: bytes) -> bytes:
    head = _packed(numbers, sizes)
    return len(head).to_bytes(4, "little") + head + zlib.compress(text, 1)


def _counted(vocabulary: str):
    """Count every distinct pre-token of a bucket once, and answer each of its blocks."""

    def run(bucket: pa.Table) -> pa.Table:
        numbers = Numbers()
        asked = []
        for blob in bucket["data"].to_pylist():
            cut = 4 + int.from_bytes(blob[:4], "little")
            own, sizes = _unpacked(blob[4:cut], 2)
            text = zlib.decompress(blob[cut:])
            ends = np.cumsum(sizes).tolist()
            words = (text[a:b].decode() for a, b in zip([0, *ends[:-1]], ends, strict=True))
            asked.append((own, [numbers[w] for w in words]))
        words = list(numbers)
        counter = load(vocabulary)
        counts = np.concatenate(
            [counter.count(words[i : i + 20_000]) for i in range(0, len(words), 20_000)]
        )
        return pa.table({
            "block": bucket["block"],
            "answer": pa.array([_packed(own, counts[at]) for own, at in asked], pa.binary()),
        })

    return run


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Frequencies times counts, summed for each document of a block."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1)
            lengths, steps, often = _unpacked(row.column("data")[0].as_py(), 3)
            begins = np.cumsum(lengths) - lengths
            total = np.cumsum(steps)  # steps restart at 0 for each document
            full = np.flatnonzero(lengths)
            restart = np.zeros(len(steps), dtype=np.int64)
            restart[begins[full]] = np.diff(
                np.append(0, total[begins[full][1:] - 1]) if len(full) else [], prepend=0
            )
            numbers = total - np.cumsum(restart)
            pieces = np.zeros(int(numbers.max()) + 1 if len(numbers) else 0, dtype=np.int64)
            for answer in row.column("answers")[0].as_py() or []:
                own, counts = _unpacked(answer, 2)
                pieces[own] = counts
            sums = np.zeros(len(lengths), dtype=np.int64)
            if len(full):
                sums[full] = np.add.reduceat(pieces[numbers] * often, begins[full])
            yield pa.RecordBatch.from_arrays(
                [row.column("keys").flatten(), row.column("sizes").flatten(), pa.array(sums)],
                names=["k", "n_bytes", "n_tokens"],
            )


def token_counts(
    df: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", limit: int = 4096
) -> DataFrame:
    """One row per row of ``df``: key, n_bytes (UTF-8), n_tokens, over_limit.

    ``vocabulary`` is the path of a sentencepiece model that every executor has; its byte-pair
    pieces must not reach across spaces, and it must leave texts as they are (both are checked).
    Null and empty texts have no bytes and no tokens.  Strings of special tokens inside a text
    are ordinary text.  Rows that repeat give repeated results; other columns are not read.
    """
    source = df.select(
        column(df, key).alias("k"), column(df, text).cast("string").alias("t")
    )
    size = source.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    buckets = max(1, -(-size // BUCKET_BYTES))
    schema = nullable(source.select(
        F.lit("").alias("block"), F.lit(None).cast("int").alias("bucket"),
        F.array("k").alias("keys"), F.array(F.lit(0).cast("long")).alias("sizes"),
        F.lit(b"").alias("data"),
    ))
    blocks = settle(source.mapInArrow(_blocks(buckets), schema))
    answers = (
        blocks.filter("bucket IS NOT NULL")
        .select("bucket", "block", "data")
        .groupBy("bucket")
        .applyInArrow(_counted(vocabulary), "block string, answer binary")
        .groupBy("block")
        .agg(F.collect_list("answer").alias("answers"))
    )
    documents = blocks.filter("bucket IS NULL").select("block", "keys", "sizes", "data")
    result = nullable(source.select(
        "k", F.lit(0).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_tokens")
    ))
    summed = (
        documents.join(answers, "block", "left")
        .select("keys", "sizes", "data", "answers")
        .mapInArrow(_summed, result)
    )
    return summed.select(
        F.col("k").alias(key), "n_bytes", "n_tokens",
        (F.col("n_tokens") > limit).alias("over_limit"),
    )
