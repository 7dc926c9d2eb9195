"""Exact duplicates: texts that are equal once white space is deleted.

Each task counts the 64-bit fingerprints of its documents in a counting quotient filter.  The
filters are cut by the leading bits of the fingerprint and merged slice by slice, a merge of
sorted remainders that loses nothing.  Only rows whose fingerprint counts more than one are
grouped, and only their texts move, one copy per task and distinct text, to be compared byte by
byte.  All other rows are told apart by the filters alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from autoprofile.llm.common import (
    WHITE,
    column,
    marked_among,
    nullable,
    perhaps_among,
    settle,
    text_parts,
)

#: what is deleted before texts are compared: space, tab, line feed, vertical tab, form feed,
#: return
DELETED = b" \t\n\x0b\x0c\r"
#: documents for each slice of the filters; a slice is merged in one task
SLICE_ROWS = 1 << 20
QUOTIENT_BITS = 10
PART_BYTES = 16 << 20


def normalised(text: bytes | None) -> bytes:
    return (text or b"").translate(None, DELETED)


def normalised_sha(text: Column) -> Column:
    """The same as a column expression: SHA-256 of the text without white space, in hex."""
    return F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), f"[{WHITE}]", ""), 256)


@dataclass
class QuotientFilter:
    """Counted fingerprints below 2**bits: a run of sorted remainders for each quotient.

    ``occupied`` has a bit for each quotient, ``run_end`` a bit for each slot that ends a run.
    """

    bits: int
    occupied: np.ndarray
    run_end: np.ndarray
    remainders: np.ndarray
    counts: np.ndarray

    @classmethod
    def of(cls, bits: int, fingerprints: np.ndarray, counts: np.ndarray | None = None):
        """``fingerprints``: unsigned 64-bit, in any order, each as often as ``counts`` says."""
        if counts is None:
            counts = np.ones(len(fingerprints), dtype=np.int64)
        order = np.argsort(fingerprints, kind="stable")
        ordered = fingerprints[order]
        first = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])[: len(ordered)])
        distinct = ordered[first]
        totals = np.add.reduceat(counts[order], first) if len(first) else counts[:0]
        shift = np.uint64(bits - QUOTIENT_BITS)
        quotient = (distinct >> shift).astype(np.int64)
        occupied = np.zeros(1 << QUOTIENT_BITS, dtype=bool)
        occupied[quotient] = True
        run_end = np.append(quotient[1:] != quotient[:-1], True)[: len(quotient)]
        return cls(bits, occupied, run_end, distinct & ((np.uint64(1) << shift) - np.uint64(1)),
                   totals)

    def fingerprints(self) -> np.ndarray:
        """All distinct fingerprints, in order."""
        run = np.append(0, np.cumsum(self.run_end[:-1]))[: len(self.run_end)].astype(np.int64)
        quotient = np.flatnonzero(self.occupied)[run].astype(np.uint64)
        return quotient << np.uint64(self.bits - QUOTIENT_BITS) | self.remainders

    @classmethod
    def merged(cls, filters: list[QuotientFilter]):
        return cls.of(
            filters[0].bits,
            np.concatenate([f.fingerprints() for f in filters]),
            np.concatenate([f.counts for f in filters]),
        )

    def to_bytes(self) -> bytes:
        wide = -(-(self.bits - QUOTIENT_BITS) // 8)  # bytes of a remainder
        slots = self.remainders.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :wide]
        often = self.counts > 254  # an escape, followed by the true count
        return b"".join([
            np.array([self.bits, len(self.counts)], dtype="<u4").tobytes(),
            np.packbits(self.occupied).tobytes(),
            np.packbits(self.run_end).tobytes(),
            np.ascontiguousarray(slots).tobytes(),
            np.where(often, 255, self.counts).astype(np.uint8).tobytes(),
            self.counts[often].astype("<i8").tobytes(),
        ])

    @classmethod
    def from_bytes(cls, data: bytes):
        bits, slots = (int(x) for x in np.frombuffer(data, "<u4", 2))
        wide = -(-(bits - QUOTIENT_BITS) // 8)
        at = 8
        parts = []
        for size in ((1 << QUOTIENT_BITS) // 8, -(-slots // 8), slots * wide, slots):
            parts.append(np.frombuffer(data, np.uint8, size, at))
            at += size
        padded = np.zeros((slots, 8), dtype=np.uint8)
        padded[:, :wide] = parts[2].reshape(slots, wide)
        counts = parts[3].astype(np.int64)
        counts[counts == 255] = np.frombuffer(data, "<i8", -1, at)
        return cls(
            bits,
            np.unpackbits(parts[0]).astype(bool),
            np.unpackbits(parts[1], count=slots).astype(bool),
            padded.view("<u8").reshape(slots),
            counts,
        )


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("t")
        shas = [
            hashlib.sha256(normalised(x)).digest() for x in texts.cast(pa.binary()).to_pylist()
        ]
        chars = pc.fill_null(pc.utf8_length(texts), 0).cast(pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), chars, pa.array(shas, pa.binary()),
             pa.array(_fingerprints(shas).view(np.int64))],
            names=["id", "n", "sha", "print"],
        )


def _fingerprints(shas: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(x[:8] for x in shas), ">u8").astype(np.uint64)


def _filters(slice_bits: int):
    """The filter of a task, a row for each slice of it."""
    bits = 64 - slice_bits

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            prints = np.sort(np.concatenate(held))
            part = (prints >> np.uint64(bits)).astype(np.int64) if slice_bits else np.zeros(
                len(prints), np.int64
            )
            low = prints & np.uint64((1 << bits) - 1) if slice_bits else prints
            names, starts = np.unique(part, return_index=True)
            blobs = [
                QuotientFilter.of(bits, x).to_bytes() for x in np.split(low, starts[1:])
            ]
            held.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(names), pa.array(blobs, pa.binary())], names=["slice", "filter"]
            )

        for batch in batches:
            if batch.num_rows:
                held.append(_fingerprints(batch.column("sha").to_pylist()))
            if sum(map(len, held)) >= SLICE_ROWS:
                yield flush()
        if held:
            yield flush()

    return build


def _repeated(slice_bits: int):
    """The fingerprints of a slice that count more than one, from all its filters."""

    def merge(slices: pa.Table) -> pa.Table:
        whole = QuotientFilter.merged(
            [QuotientFilter.from_bytes(x) for x in slices["filter"].to_pylist()]
        )
        often = whole.counts > 1
        high = np.uint64(slices["slice"][0].as_py() << (64 - slice_bits) if slice_bits else 0)
        prints = (whole.fingerprints()[often] | high).view(np.int64)
        return pa.table({"print": pa.array(prints), "copies": pa.array(whole.counts[often])})

    return merge


def _distinct_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct normalised texts of a part of a task, with the number of their copies."""
    for part in text_parts(batches, "t", PART_BYTES):
        copies: dict[bytes, int] = {}
        for text in part["t"].cast(pa.binary()).to_pylist():
            text = normalised(text)
            copies[text] = copies.get(text, 0) + 1
        shas = [hashlib.sha256(x).digest() for x in copies]
        prints = _fingerprints(shas).view(np.int64)
        whole = pa.RecordBatch.from_arrays(
            [pa.array(prints), pa.array(shas, pa.binary()), pa.array(list(copies), pa.binary()),
             pa.array(list(copies.values()), pa.int64())],
            names=["print", "sha", "text", "copies"],
        )
        for start in range(0, whole.num_rows, 512):
            yield whole.slice(start, 512)


def exact_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``df``: key, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical without the characters ``[\\x20\\x09-\\x0D]``; null counts as
    empty, so null, empty and blank texts are one group.  Of a group the row with the most code
    points in the original text stays, then the smallest key; a null key comes after all
    others.  Of rows that repeat a key and a text exactly one is kept.  Other columns are not
    read; an empty table gives an empty result.
    """
    source = df.select(column(df, key).alias("id"), column(df, text).cast("string").alias("t"))
    schema = nullable(
        source.select(
            "id", F.lit(0).cast("long").alias("n"), F.lit(b"").alias("sha"),
            F.lit(0).cast("long").alias("print"),
        )
    )
    rows = settle(
        source.mapInArrow(_digests, schema).withColumn("row", F.monotonically_increasing_id())
    )
    slice_bits = max(0, (rows.count() // SLICE_ROWS).bit_length())

    repeated = settle(
        rows.select("sha")
        .mapInArrow(_filters(slice_bits), "slice long, filter binary")
        .groupBy("slice")
        .applyInArrow(_repeated(slice_bits), "print long, copies long")
    )
    print_ = F.col("print")
    texts = source.select("t").mapInArrow(
        _distinct_texts, "print long, sha binary, text binary, copies long"
    )
    verified = settle(
        perhaps_among(texts, print_, repeated, print_)
        .groupBy("sha", "text")
        .agg(F.sum("copies").alias("copies"))
        .filter("copies > 1")
        .groupBy("sha")
        .agg(F.count("*").alias("texts"), F.sum("copies").alias("copies"))
    )
    if verified.filter("texts > 1").limit(1).count():
        raise ValueError("different texts share a SHA-256 digest")
    place = F.struct(-F.col("n"), F.col("id").isNull(), F.col("id"), F.col("row"))
    marked = marked_among(rows, print_, repeated, print_, "seen")
    groups = settle(
        marked.filter("seen")
        .groupBy("sha")
        .agg(F.min(place).alias("best"), F.count("*").alias("size"))
        .filter("size > 1")
        .join(verified.select("sha"), "sha", "left_semi")
        .select("sha", "size", F.col("best.id").alias("keep"), F.col("best.row").alias("first"))
    )
    alone = F.col("size").isNull()
    joined = marked.filter("seen").join(groups, "sha", "left").unionByName(
        marked.filter("NOT seen"), allowMissingColumns=True
    )
    return joined.select(
        F.col("id").alias(key),
        F.when(alone, F.col("id")).otherwise(F.col("keep")).alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("row") == F.col("first"))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )
