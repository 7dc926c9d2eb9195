"""Byte-level BPE: encoding and decoding of whole texts.

Pre-tokens of a part of a task are encoded together, each distinct one once, by one queue
(``RankQueue``): every merge rank has a bucket of linked-list positions, a bitmap of three
levels finds the lowest rank that has any, and positions whose pair has changed since are
skipped.  The cost of a pre-token grows with its length, so very long ones are no special case.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from functools import lru_cache
from hashlib import sha256
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from autoprofile.llm.common import column, nullable, ranges, text_parts

NO_PAIR = np.int32(2**31 - 1)
#: bytes of text that a task works on at a time
PART_BYTES = 8 << 20
#: distinct pre-tokens that a Python worker keeps from part to part before it starts anew
MOST_KEPT = 500_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a rank file: one base64 token and its rank per line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(t): int(r) for t, r in (x.split() for x in lines if x.strip())}


class RankBuckets:
    """Positions by merge rank; a bitmap of three levels of 64-bit words tells which have any."""

    def __init__(self, ranks: int):
        self.buckets: list[list[np.ndarray]] = [[] for _ in range(ranks)]
        self.levels = [[0] * (-(-ranks // 64**k)) for k in (1, 2, 3)]

    def push(self, ranks: np.ndarray, positions: np.ndarray) -> None:
        """Put each position into the bucket of its rank."""
        order = np.argsort(ranks, kind="stable")
        ordered, positions = ranks[order], positions[order]
        cuts = np.flatnonzero(ordered[1:] != ordered[:-1]) + 1
        starts = [0, *cuts.tolist()]
        for rank, first, last in zip(
            ordered[starts].tolist(), starts, [*starts[1:], len(ordered)], strict=True
        ):
            bucket = self.buckets[rank]
            if not bucket:
                for level in self.levels:
                    word, bit = rank >> 6, 1 << (rank & 63)
                    level[word] |= bit
                    rank = word
            bucket.append(positions[first:last])

    def pop(self) -> tuple[int, np.ndarray] | None:
        """The lowest rank that has positions, and these in order, each once."""
        for top, word in enumerate(self.levels[2]):
            if word:
                break
        else:
            return None
        rank = top
        for level in reversed(self.levels):
            word = level[rank]
            rank = rank << 6 | (word & -word).bit_length() - 1
        positions, self.buckets[rank] = self.buckets[rank], []
        at = rank
        for level in self.levels:
            level[at >> 6] &= ~(1 << (at & 63))
            if level[at >> 6]:
                break
            at >>= 6
        found = np.sort(np.concatenate(positions))
        return rank, found[np.append(True, found[1:] != found[:-1])]


class Numbers(dict):
    """Numbers its keys in the order in which they are first asked for."""

    def __missing__(self, key: str) -> int:
        number = self[key] = len(self)
        return number


class ByteBpe:
    """A vocabulary given as token bytes and ranks; the rank of a token is its id."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        # \s means the Unicode property, as it does in the tokenizer libraries
        pattern = pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")
        self.pieces = regex.compile(pattern).findall
        self.size = max(ranks.values()) + 1
        self.token_bytes: list[bytes] = [b""] * self.size
        for token, rank in ranks.items():
            self.token_bytes[rank] = token
        self.whole = ranks
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        keys, merged = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    keys.append(left * self.size + right)
                    merged.append(rank)
        order = np.argsort(np.array(keys, dtype=np.int64))
        self.pair_keys = np.array(keys, dtype=np.int64)[order]
        self.pair_ranks = np.array(merged, dtype=np.int32)[order]
        # the lowest rank that a token can merge into: where it is above the token's own rank,
        # merging one pair of a rank can never bring a lower rank before the next pair
        lowest = np.full(self.size, NO_PAIR, dtype=np.int32)
        np.minimum.at(lowest, self.pair_keys // self.size, self.pair_ranks)
        np.minimum.at(lowest, self.pair_keys % self.size, self.pair_ranks)
        self.ascending = lowest > np.arange(self.size)
        self.forget()

    def forget(self) -> None:
        """Drop the pre-tokens that are kept from part to part."""
        self.numbers = Numbers()
        self.flat = np.zeros(0, np.int32)
        self.starts = np.zeros(0, np.int64)
        self.counts = np.zeros(0, np.int64)

    def pair_rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], NO_PAIR)

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all words, one after the other, and the number of tokens of each."""
        if not words:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        lengths = np.array([len(w) for w in words], dtype=np.int64)
        word = np.repeat(np.arange(len(words), dtype=np.int32), lengths)
        n = len(word)
        token = np.append(self.byte_ids[np.frombuffer(b"".join(words), np.uint8)], 0)
        word = np.append(word, np.int32(-1))  # one node beyond the end, of no word
        after = np.append(np.arange(1, n + 1), n)
        before = np.append(np.arange(-1, n - 1), n - 1)
        rank = np.full(n + 1, NO_PAIR, dtype=np.int32)  # of the pair that begins at a node
        inner = np.flatnonzero(word[:-1] == word[1:])
        rank[inner] = self.pair_rank(token[inner], token[inner + 1])
        alive = np.ones(n + 1, dtype=bool)
        queue = RankBuckets(self.size)
        first = np.flatnonzero(rank != NO_PAIR)
        if len(first):
            queue.push(rank[first], first)
        while (lowest := queue.pop()) is not None:
            r, at = lowest
            at = at[rank[at] == r]  # the rest are stale
            if not len(at):
                continue
            if len(at) > 1:
                if self.ascending[r]:
                    # neighbours that share a token: every second one of a run, from the left
                    joined = np.append(False, after[at[:-1]] == at[1:])
                    place = np.arange(len(at))
                    run = np.maximum.accumulate(np.where(joined, 0, place))
                    now = (place - run) % 2 == 0
                else:
                    now = np.append(True, word[at[1:]] != word[at[:-1]])
                    if not now.all():
                        queue.push(rank[at[~now]], at[~now])
                at = at[now]
            gone = after[at]
            token[at] = r
            rank[gone] = NO_PAIR
            alive[gone] = False
            behind = after[gone]
            after[at] = behind
            before[behind] = at
            front = before[at]
            front = front[(front >= 0) & (word[front] == word[at])]
            changed = np.concatenate([at, front])
            follow = after[changed]
            found = np.where(
                word[follow] == word[changed],
                self.pair_rank(token[changed], token[follow]),
                NO_PAIR,
            )
            rank[changed] = found
            kept = found != NO_PAIR
            if kept.any():
                queue.push(found[kept], changed[kept])
        alive = alive[:-1]
        counts = np.bincount(word[:-1][alive], minlength=len(words))
        return token[:-1][alive], counts

    def encode_all(self, texts: Iterable[str | None]) -> Iterator[np.ndarray]:
        """The token ids of each text; null counts as empty."""
        if len(self.numbers) > MOST_KEPT:
            self.forget()
        number = self.numbers.__getitem__
        rows = [
            np.array(list(map(number, self.pieces(text))) if text else [], dtype=np.int64)
            for text in texts
        ]
        known = len(self.counts)
        words = [p.encode() for p in islice(self.numbers, known, None)]
        ids = [self.whole.get(w) for w in words]
        split = [k for k, own in enumerate(ids) if own is None]
        whole = [k for k, own in enumerate(ids) if own is not None]
        merged, merged_counts = self.merge([words[k] for k in split])
        counts = np.ones(len(words), dtype=np.int64)
        counts[split] = merged_counts
        ends = np.cumsum(counts)
        starts = ends - counts
        flat = np.zeros(int(counts.sum()), dtype=np.int32)
        flat[ranges(starts[split], merged_counts)] = merged
        flat[starts[whole]] = [ids[k] for k in whole]
        self.starts = np.concatenate([self.starts, starts + len(self.flat)])
        self.counts = np.concatenate([self.counts, counts])
        self.flat = np.concatenate([self.flat, flat])
        for row in rows:
            yield self.flat[ranges(self.starts[row], self.counts[row])]

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.token_bytes.__getitem__, ids.tolist()))


@lru_cache(maxsize=2)
def load(path: str, pattern: str) -> ByteBpe:
    """The vocabulary of a rank file, once per Python worker."""
    return ByteBpe(read_ranks(path), pattern)


def encode(
    df: DataFrame,
    vocabulary: str,
    pattern: str,
    text: str = "text",
    keep: tuple[str, ...] = ("doc_id",),
    ids: str = "token_ids",
    part_bytes: int = PART_BYTES,
) -> DataFrame:
    """Columns ``keep`` and the token ids of ``text`` (little-endian unsigned 32-bit, binary).

    ``vocabulary`` is the path of a rank file that every executor has.  Null and empty texts
    give no ids.  Each match of ``pattern`` is encoded on its own, without special tokens.
    Repeated rows give repeated results, an empty table an empty one; other columns, whatever
    their names, are not read.
    """
    source = df.select(
        *[column(df, c).alias(f"k{i}") for i, c in enumerate(keep)], column(df, text).alias("t")
    )
    names = [f"k{i}" for i in range(len(keep))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(vocabulary, pattern)
        for part in text_parts(batches, "t", part_bytes):
            found = bpe.encode_all(part["t"].to_pylist())
            blobs = pa.array([x.astype("<u4").tobytes() for x in found], pa.binary())
            out = part.select(names).append_column("ids", blobs)
            yield from out.to_batches(max_chunksize=2048)

    schema = nullable(source.select(*names, F.lit(b"").alias("ids")))
    done = source.mapInArrow(run, schema)
    return done.select(
        *[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], F.col("ids").alias(ids)
    )


def decode(
    df: DataFrame,
    vocabulary: str,
    pattern: str,
    ids: str = "token_ids",
    keep: tuple[str, ...] = ("doc_id",),
    content: str = "content",
) -> DataFrame:
    """Columns ``keep`` and the bytes that the ids of ``encode`` stand for (null stays null)."""
    source = df.select(
        *[column(df, c).alias(f"k{i}") for i, c in enumerate(keep)], column(df, ids).alias("ids")
    )
    names = [f"k{i}" for i in range(len(keep))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(vocabulary, pattern)
        for batch in batches:
            bytes_of = [
                None if x is None else bpe.decode(np.frombuffer(x, "<u4"))
                for x in batch.column("ids").to_pylist()
            ]
            columns = [batch.column(n) for n in names]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(bytes_of, pa.binary())], names=[*names, "content"]
            )

    schema = nullable(source.select(*names, F.lit(b"").alias("content")))
    done = source.mapInArrow(run, schema)
    return done.select(
        *[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], F.col("content").alias(content)
    )


def round_trip(
    df: DataFrame,
    vocabulary: str,
    pattern: str,
    key: str = "doc_id",
    text: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """Per row: key, n_tokens, and the SHA-256 of the ids and of the bytes decoded from them;
    with ``with_ids`` also token_ids (little-endian unsigned 32-bit, binary).

    Null and empty texts have no tokens and the digests of no bytes.  Ids are decoded in the
    task that made them, and only the digests leave it.
    """
    source = df.select(column(df, key).alias("k"), column(df, text).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(vocabulary, pattern)
        for part in text_parts(batches, "t", PART_BYTES):
            counts, encoded, decoded, blobs = [], [], [], []
            for ids in bpe.encode_all(part["t"].to_pylist()):
                counts.append(len(ids))
                blob = ids.astype("<u4").tobytes()
                encoded.append(sha256(blob).hexdigest())
                decoded.append(sha256(bpe.decode(ids)).hexdigest())
                blobs.append(blob)
            columns = [part["k"], pa.array(counts, pa.int64()), pa.array(encoded, pa.string()),
                       pa.array(decoded, pa.string()), pa.array(blobs, pa.binary())]
            names = ["k", "n_tokens", "ids_sha256", "decoded_sha256", "token_ids"]
            last = 5 if with_ids else 4
            yield from pa.table(columns[:last], names=names[:last]).to_batches()

    schema = nullable(source.select(
        "k", F.lit(0).cast("long").alias("n_tokens"), F.lit("").alias("ids_sha256"),
        F.lit("").alias("decoded_sha256"), *[F.lit(b"").alias("token_ids")] * with_ids,
    ))
    return source.mapInArrow(run, schema).withColumnRenamed("k", key)
