"""Records of delimited text whose quoted cells hold line breaks, read in parallel.

A file is read in blocks of lines, and whether a line starts a record depends on all the text
before it.  But a line can do only four things to the two states there are, outside and inside
quotes, whatever comes before: leave them, swap them, or end in one of them.  So every block is
folded to one such map where it lies, the maps (one row for each block) are composed from block
to block, and then every block is cut into records by itself.  Only records that reach from one
block into another travel: their pieces, at most two of each block.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from autoprofile.operators.wide import local_frame

#: a quoted cell that goes on for so many code points was never closed
LONGEST_RECORD = 64 << 20

# what a line does: the state after it if it began outside (1: inside), twice the state if inside
TO_OUTSIDE, SWAP, KEEP, TO_INSIDE = 0, 1, 2, 3

#: key of the file, first byte of the block
Block = tuple[int, int]

QUOTED = '"(?:[^"]++|"")*+'  # an opening quote and what it holds, up to its closing quote


@lru_cache
def _patterns(delimiter: str) -> dict[str, str]:
    """All loops are possessive: matching neither goes back nor grows the stack with the text."""
    if '"' in delimiter or not delimiter:
        raise ValueError(f"{delimiter!r} cannot separate cells")
    end = re.sub(r"(\W)", r"\\\1", delimiter)
    rest = f"[^{end}]*+" if len(delimiter) == 1 else f"(?:(?!{end})[\\s\\S])*+"
    cells = f'(?:(?:{QUOTED}"{rest}|(?!"){rest}){end})*+'
    return {
        "opens": f"^{cells}{QUOTED}\\z",
        "stays": f'^(?:[^"]++|"")*+(?:\\z|"{rest}{end}{cells}{QUOTED}\\z)',
        "cell": f'{end}({QUOTED}(?:"{rest})?+|(?!"){rest})',
        "value": f'^{QUOTED[0]}({QUOTED[1:]})(?:"([\\s\\S]*+))?+\\z',
    }


def cells(record: Column, delimiter: str = ",") -> Column:
    """The cells of a record: quotes around a cell go, doubled ones inside it are one."""
    p = _patterns(delimiter)

    def value(cell: Column) -> Column:
        inner = F.replace(F.regexp_extract(cell, p["value"], 1), F.lit('""'), F.lit('"'))
        bare = F.concat(inner, F.regexp_extract(cell, p["value"], 2))
        return F.when(cell.startswith('"'), bare).otherwise(cell)

    taken = F.regexp_extract_all(F.concat(F.lit(delimiter), record), F.lit(p["cell"]), 1)
    plain = F.split(record, re.sub(r"(\W)", r"\\\1", delimiter), -1)
    return F.when(record.contains('"'), F.transform(taken, value)).otherwise(plain)


def lines(spark: SparkSession, path: str, delimiter: str = ",") -> DataFrame:
    """Every line with its file, the start of its block, a number that grows in the block, and
    what it does to the state."""
    p = _patterns(delimiter)
    text = F.col("value")
    kind = F.when(
        text.contains('"'),
        text.rlike(p["opens"]).cast("int") + 2 * text.rlike(p["stays"]).cast("int"),
    ).otherwise(KEEP)
    return spark.read.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.xxhash64("_metadata.file_path").alias("key"),
        F.col("_metadata.file_block_start").alias("block_start"),
        F.monotonically_increasing_id().alias("line_id"),
        kind.cast("byte").alias("kind"),
    )


def states(kinds: np.ndarray, inside: bool) -> np.ndarray:
    """The state before each line and, as the last entry, after all, from a state before them.

    What decides is the last line that leaves no choice, and the swaps since.
    """
    swaps = np.concatenate([[0], np.cumsum(kinds == SWAP)])
    fixed = np.flatnonzero((kinds == TO_OUTSIDE) | (kinds == TO_INSIDE))
    last = np.searchsorted(fixed, np.arange(len(kinds) + 1)) - 1
    begin = np.full(len(kinds) + 1, int(inside))
    if len(fixed):
        told = ((kinds[fixed] == TO_INSIDE) + swaps[fixed + 1]) % 2
        begin = np.where(last >= 0, told[np.maximum(last, 0)], begin)
    return (begin + swaps) % 2 == 1


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[Block, int, int]]:
    """Runs of lines of one block inside a batch: the block, first line, line after the last."""
    keys, starts = (batch.column(x).to_numpy() for x in ("key", "block_start"))
    new = np.flatnonzero((keys[1:] != keys[:-1]) | (starts[1:] != starts[:-1])) + 1
    edges = [0, *new.tolist(), len(keys)]
    for first, end in zip(edges, edges[1:]):
        if end > first:
            yield (int(keys[first]), int(starts[first])), first, end


def _maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each block: the states after it from either state, and whether a line in it
    leaves the inside."""
    held: dict[Block, list] = {}
    for batch in batches:
        kinds = batch.column("kind").to_numpy()
        for block, first, end in _blocks(batch):
            out, inside, closes = held.setdefault(block, [False, True, False])
            part = kinds[first:end]
            held[block] = [
                bool(states(part, out)[-1]), bool(states(part, inside)[-1]),
                closes or bool(((part == TO_OUTSIDE) | (part == SWAP)).any()),
            ]
    rows = [(*block, *found) for block, found in held.items()]
    if rows:
        names = ["key", "block_start", "from_outside", "from_inside", "closes"]
        yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows])


def _origins(maps: list) -> tuple[dict[Block, int | None], set[Block]]:
    """For each block: where the record began that is open as the block begins, None if none is.
    And the blocks that begin or end inside a record.

    ``maps`` has one row for each block.
    """
    found: dict[Block, int | None] = {}
    cut: set[Block] = set()
    file, origin = None, None
    for row in sorted(maps, key=lambda r: (r["key"], r["block_start"])):
        block = row["key"], row["block_start"]
        if row["key"] != file:
            file, origin = row["key"], None
        found[block] = origin
        after = row["from_outside"] if origin is None else row["from_inside"]
        if after or origin is not None:
            cut.add(block)
        if not after:
            origin = None
        elif origin is None or row["closes"]:
            origin = row["block_start"]
    return found, cut


RECORDS = "key long, block_start long, line_id long, value string, origin long"


def _cut(origins: dict[Block, int | None], pieces_only: bool) -> Callable:
    """Lines into records.  ``origin`` names the record that a piece belongs to, which begins in
    the block of that name; it is null for whole records."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: dict[str, list] = {name.split()[0]: [] for name in RECORDS.split(",")}
        block, inside, begun, held, size = None, False, 0, [], 0

        def put(origin: int | None) -> None:
            if held and (origin is not None or not pieces_only):
                for name, value in zip(out, (*block, begun, "\n".join(held), origin)):
                    out[name].append(value)

        def close(open_: bool) -> None:
            """The end of a record, or of a block inside one."""
            before = origins[block]
            if before is not None and begun == -1:
                put(before)  # what began before this block
            else:
                put(block[1] if open_ else None)

        for batch in batches:
            values = batch.column("value")
            ids, kinds = (batch.column(x).to_numpy() for x in ("line_id", "kind"))
            for here, first, end in _blocks(batch):
                if here != block:
                    if block is not None and held:
                        close(inside)
                    if here not in origins:
                        raise ValueError("files were cut into other blocks than before")
                    block, held, size = here, [], 0
                    inside, begun = origins[here] is not None, -1
                now = states(kinds[first:end], inside)
                texts = values.slice(first, end - first).to_pylist()
                for text, place, open_, after in zip(texts, ids[first:end], now, now[1:]):
                    if not open_:
                        begun = int(place)
                    held.append(text)
                    size += len(text) + 1
                    if size > LONGEST_RECORD:
                        raise ValueError(
                            f"a quoted cell is never closed after line {begun} of a block"
                        )
                    if not after:
                        close(False)
                        held, size = [], 0
                inside = bool(now[-1])
            if len(out["key"]):
                yield _batch(out)
        if block is not None and held:
            close(inside)
        if out["key"]:
            yield _batch(out)

    return cut


def _batch(out: dict[str, list]) -> pa.RecordBatch:
    types = {"value": pa.string()}
    made = pa.RecordBatch.from_arrays(
        [pa.array(column, types.get(name, pa.int64())) for name, column in out.items()],
        names=list(out),
    )
    for column in out.values():
        column.clear()
    return made


def first_records(found: DataFrame, count: int, most_lines: int) -> DataFrame:
    """The first ``count`` records of each file, numbered from 0, out of its first lines.

    The line limit applies per task before the shuffle, which carries ``most_lines`` per file.
    """
    by_place = Window.partitionBy("key").orderBy("block_start", "line_id")
    until = by_place.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = by_place.rowsBetween(Window.unboundedPreceding, -1)
    swap = (F.col("kind") == SWAP).cast("int")
    told = F.when(
        F.col("kind").isin(TO_OUTSIDE, TO_INSIDE),
        (F.col("kind") == TO_INSIDE).cast("int") + F.col("swaps"),
    )
    inside = (F.coalesce("told", F.lit(0)) + F.col("swaps") - swap) % 2
    piece = F.struct("block_start", "line_id", "value")
    return (
        found.withColumn("line_no", F.row_number().over(by_place))
        .where(F.col("line_no") <= most_lines)
        .withColumn("swaps", F.sum(swap).over(until))
        .withColumn("told", F.last(told, ignorenulls=True).over(before))
        .withColumn("record_no", F.sum(1 - inside).over(until) - 1)
        .where(F.col("record_no") < count)
        .groupBy("key", "record_no")
        .agg(F.min("file").alias("file"), F.sort_array(F.collect_list(piece)).alias("p"))
        .select(
            "key", "file", "record_no",
            F.element_at("p.block_start", 1).alias("block_start"),
            F.element_at("p.line_id", 1).alias("line_id"),
            F.array_join("p.value", "\n").alias("value"),
        )
    )


def records(found: DataFrame) -> DataFrame:
    """The records of :func:`lines`: key of the file, place (block_start, line_id) and value.

    Line breaks inside quotes are single line feeds.  Files without any are read line by line
    without leaving the JVM; of the others one row for each block comes to the driver.
    """
    needed = found.select("key", "block_start", "line_id", "kind", "value")
    opening = found.where(F.col("kind") % 2 == 1).select("key").distinct()
    broken = [(r["key"],) for r in opening.collect()]  # at most a row per file
    plain = needed.drop("kind")
    if not broken:
        return plain
    files = F.broadcast(local_frame(found.sparkSession, sorted(broken), "key long"))
    plain = plain.join(files, "key", "left_anti")
    needed = needed.join(files, "key", "left_semi")
    maps = needed.select("key", "block_start", "kind").mapInArrow(
        _maps,
        "key long, block_start long, from_outside boolean, from_inside boolean, closes boolean",
    )
    origins, cut = _origins(maps.collect())
    whole = needed.mapInArrow(_cut(origins, False), RECORDS).where("origin IS NULL")
    read = plain.unionByName(whole.drop("origin"))
    if not cut:
        return read
    blocks = local_frame(found.sparkSession, sorted(cut), "key long, block_start long")
    pieces = needed.join(F.broadcast(blocks), ["key", "block_start"], "left_semi").mapInArrow(
        _cut(origins, True), RECORDS
    )
    joined = (
        pieces.groupBy("key", "origin")
        .agg(F.sort_array(F.collect_list(F.struct("block_start", "line_id", "value"))).alias("p"))
        .select(
            "key",
            F.col("origin").alias("block_start"),
            F.element_at("p.line_id", 1).alias("line_id"),
            F.array_join("p.value", "\n").alias("value"),
        )
    )
    return read.unionByName(joined)
