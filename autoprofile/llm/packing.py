"""Packed token-id matrices for training, written as fixed-size binary rows.

Documents become pieces of at most one row's length, nothing is lost.  Pieces are dealt to
shards by a hash of their document, and every shard is packed by best-fit-decreasing: a segment
tree over the room that is left in open rows finds the fullest row that still takes a piece.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from autoprofile.llm.byte_bpe import read_ranks
from autoprofile.llm.common import column, nullable, text_parts

PART_BYTES = 4 << 20
#: text that is packed in one task
SHARD_BYTES = 16 << 20


@dataclass(frozen=True)
class PackRules:
    """``length``: ids of a row; ``end_id``: put after every document; ``pad_id``: fills a row
    up; ``id_bytes``: 2 for vocabularies below 65536, else 4."""

    length: int = 2048
    end_id: int = 50256
    pad_id: int = 50256
    id_bytes: int = 2

    @property
    def dtype(self) -> str:
        return f"<u{self.id_bytes}"


class RoomTree:
    """Rows by the room they have left; a segment tree over the room finds the least that is
    enough."""

    def __init__(self, most: int):
        self.leaves = 1 << most.bit_length()
        self.any = bytearray(2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(most + 1)]

    def add(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        node = self.leaves + room
        while node and not self.any[node]:
            self.any[node] = 1
            node >>= 1

    def take(self, size: int) -> tuple[int, int] | None:
        """(room, row) of a row with the least room that is at least ``size``; it is removed."""
        node = self.leaves + size
        while not self.any[node]:
            while node & 1:  # a right child: whatever has more room is further up
                node >>= 1
            if not node:
                return None
            node += 1
        while node < self.leaves:
            node *= 2
            node += not self.any[node]
        room = node - self.leaves
        row = self.rows[room].pop()
        if not self.rows[room]:
            self.any[node] = 0
            node >>= 1
            while node and not (self.any[2 * node] or self.any[2 * node + 1]):
                self.any[node] = 0
                node >>= 1
        return room, row


def best_fit_decreasing(sizes: list[int], length: int) -> list[list[int]]:
    """Rows of indices into ``sizes``; every size is from 1 to ``length``."""
    tree, rows = RoomTree(length), []
    for i in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        found = tree.take(sizes[i])
        if found is None:
            room, row = length, len(rows)
            rows.append([])
        else:
            room, row = found
        rows[row].append(i)
        if room > sizes[i]:
            tree.add(room - sizes[i], row)
    return rows


@lru_cache(maxsize=2)
def _encoder(vocabulary: str, pattern: str):
    import tiktoken

    return tiktoken.Encoding(
        "corpus", pat_str=pattern, mergeable_ranks=read_ranks(vocabulary), special_tokens={}
    )


def token_pieces(
    df: DataFrame,
    vocabulary: str,
    pattern: str,
    key: str = "doc_id",
    text: str = "text",
    rules: PackRules = PackRules(),
) -> DataFrame:
    """key, piece, n_tokens, ids: the ids of every document and its end id, cut into pieces of
    at most ``rules.length``; pieces in order, one after the other, are the document's ids.

    Null and empty texts have only the end id.
    """
    source = df.select(
        column(df, key).alias("k"), column(df, text).cast("string").alias("t")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(vocabulary, pattern)
        for part in text_parts(batches, "t", PART_BYTES):
            rows, pieces, sizes, blobs = [], [], [], []
            for i, text in enumerate(part["t"].to_pylist()):
                ids = encoder.encode_ordinary(text) if text else []
                ids.append(rules.end_id)
                data = np.array(ids, dtype=rules.dtype)
                for number, start in enumerate(range(0, len(data), rules.length)):
                    piece = data[start : start + rules.length]
                    rows.append(i)
                    pieces.append(number)
                    sizes.append(len(piece))
                    blobs.append(piece.tobytes())
            yield from pa.table({
                "k": part["k"].take(pa.array(rows)),
                "piece": pa.array(pieces, pa.int32()),
                "n_tokens": pa.array(sizes, pa.int32()),
                "ids": pa.array(blobs, pa.binary()),
            }).to_batches(max_chunksize=4096)

    schema = nullable(source.select(
        "k", F.lit(0).alias("piece"), F.lit(0).alias("n_tokens"), F.lit(b"").alias("ids")
    ))
    return source.mapInArrow(run, schema).withColumnRenamed("k", key)


def pack(pieces: DataFrame, shards: int, key: str = "doc_id",
         rules: PackRules = PackRules()) -> DataFrame:
    """The packed rows of ``token_pieces``: shard, row, n_tokens, input_ids, positions,
    cu_seqlens, segments.

    ``input_ids`` and ``positions`` are fixed-length binary, a line of the shard's matrix:
    ids, and places that start again at 0 with each segment (padding counts as one).
    ``cu_seqlens``: where the segments begin and the last one ends.  ``segments``: key, piece and
    length of each.  The same pieces give the same rows, however the table was laid out.
    """
    dealt = pieces.select(
        column(pieces, key).alias("k"), "piece", "n_tokens", "ids",
        F.pmod(F.xxhash64(column(pieces, key), F.col("piece")), F.lit(shards))
        .cast("int").alias("shard"),
    )
    place = np.arange(rules.length, dtype=rules.dtype)

    def run(shard: pa.Table) -> pa.Table:
        shard = shard.sort_by([("k", "ascending"), ("piece", "ascending"), ("ids", "ascending")])
        sizes = shard["n_tokens"].to_pylist()
        blobs = shard["ids"].to_pylist()
        rows = best_fit_decreasing(sizes, rules.length)
        ids, positions, ends, used, names = [], [], [], [], []
        for row in rows:
            lengths = [sizes[i] for i in row]
            total = sum(lengths)
            rest = rules.length - total
            fill = np.full(rest, rules.pad_id, dtype=rules.dtype).tobytes()
            ids.append(b"".join([blobs[i] for i in row]) + fill)
            positions.append(np.concatenate([place[:n] for n in [*lengths, rest]]).tobytes())
            ends.append(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32))
            used.append(total)
            names.append(len(row))
        order = pa.array([i for row in rows for i in row], pa.int64())
        segments = pa.StructArray.from_arrays(
            [shard[c].take(order).combine_chunks() for c in ("k", "piece", "n_tokens")],
            names=["key", "piece", "length"],
        )
        offsets = np.concatenate([[0], np.cumsum(names)]).astype(np.int32)
        return pa.table({
            "shard": pa.array([shard["shard"][0].as_py()] * len(rows), pa.int32()),
            "row": pa.array(range(len(rows)), pa.int32()),
            "n_tokens": pa.array(used, pa.int32()),
            "input_ids": pa.array(ids, pa.binary()),
            "positions": pa.array(positions, pa.binary()),
            "cu_seqlens": pa.array(ends, pa.list_(pa.int32())),
            "segments": pa.ListArray.from_arrays(pa.array(offsets), segments),
        })

    kind = dealt.schema["k"].dataType.simpleString()
    schema = (
        "shard int, row int, n_tokens int, input_ids binary, positions binary, "
        f"cu_seqlens array<int>, segments array<struct<key: {kind}, piece: int, length: int>>"
    )
    return dealt.groupBy("shard").applyInArrow(run, schema)


def packed_documents(
    df: DataFrame,
    vocabulary: str,
    pattern: str,
    key: str = "doc_id",
    text: str = "text",
    rules: PackRules = PackRules(),
) -> DataFrame:
    """``pack`` of ``token_pieces``, with a shard for every 16 MB of text.

    Every id of every document is in exactly one row; rows that repeat a key and a text are
    packed as often as they occur; an empty table gives no rows.
    """
    size = df.agg(F.sum(F.octet_length(column(df, text).cast("string")))).first()[0] or 0
    shards = max(1, -(-size // SHARD_BYTES))
    return pack(token_pieces(df, vocabulary, pattern, key, text, rules), shards, key, rules)


def write_matrices(packed: DataFrame, folder: str) -> None:
    """The packed rows as Parquet, a folder for each shard, rows in order.

    The ``input_ids`` of a shard, one after the other, are its id matrix in C order.
    """
    (
        packed.repartition("shard")
        .sortWithinPartitions("shard", "row")
        .write.partitionBy("shard")
        .parquet(folder)
    )
