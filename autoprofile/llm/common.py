"""What the corpus operators share: table access, tables on shared storage, text batches."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: the characters that separate words: space, tab, line feed, vertical tab, form feed, return
WHITE = r"\x20\x09-\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the one the cluster names for checkpoints.

    A session without that setting gets a folder in its warehouse if it runs on one machine, as
    in tests; elsewhere a machine's own folder would lose tables, so it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        base = spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/corpus-{uuid.uuid4().hex}"


def settle(df: DataFrame) -> DataFrame:
    """The frame written once to shared storage and read back: a lost executor repeats nothing.

    The table stays below ``spark.checkpoint.dir`` and goes with that folder.
    """
    folder = shared_folder(df.sparkSession)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


#: bits of the map that ``perhaps_among`` broadcasts, 8 MB whatever the number of keys
MAP_BITS = 1 << 26


def marked_among(
    df: DataFrame, key: Column, wanted: DataFrame, wanted_key: Column, mark: str
) -> DataFrame:
    """The rows with the boolean ``mark``: true if the key may be among the wanted ones.

    True for all that are and for few others.  The wanted keys are hashed into a map of
    ``MAP_BITS`` bits, which every task holds, so no row travels to be told apart.  With more
    wanted keys than the map has room for, more rows are marked and the mark is as right.
    """

    def slot(k: Column) -> Column:
        return F.pmod(F.xxhash64(k), F.lit(MAP_BITS))

    slots = wanted.select(slot(wanted_key).alias("_slot"))
    bits = slots.groupBy(F.bitmap_bucket_number("_slot").alias("_bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("_slot")).alias("_bits")
    )
    marked = df.withColumn("_slot", slot(key)).withColumn(
        "_bucket", F.bitmap_bucket_number("_slot")
    )
    position = F.bitmap_bit_position("_slot").cast("int")
    byte = F.conv(
        F.hex(F.substring("_bits", F.shiftright(position, 3) + 1, F.lit(1))), 16, 10
    ).cast("int")
    held = F.expr("coalesce(shiftright(_byte, _bit) & 1, 0)") == 1
    return (
        marked.join(F.broadcast(bits), "_bucket", "left")
        .withColumns({"_byte": byte, "_bit": position % 8})
        .withColumn(mark, held)
        .drop("_slot", "_bucket", "_bits", "_byte", "_bit")
    )


def perhaps_among(df: DataFrame, key: Column, wanted: DataFrame, wanted_key: Column) -> DataFrame:
    """The rows of ``df`` whose key may be among the wanted ones: all that are, few others."""
    return marked_among(df, key, wanted, wanted_key, "_held").filter("_held").drop("_held")


def column(df: DataFrame, name: str) -> Column:
    """A column by its exact name, dots and backticks included."""
    return df["`" + name.replace("`", "``") + "`"]


def nullable(df: DataFrame) -> T.StructType:
    """The schema of a frame with every column nullable, for results that come from Python."""
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in df.schema])


def text_parts(
    batches: Iterator[pa.RecordBatch], text: str, most_bytes: int
) -> Iterator[pa.Table]:
    """The batches of a task gathered into parts of about ``most_bytes`` of text.

    A single row is never cut, so a part holds at most one row more than that.
    """
    held, size = [], 0
    for batch in batches:
        for start in range(0, batch.num_rows, 512):
            piece = batch.slice(start, 512)
            held.append(piece)
            size += byte_lengths(piece.column(text)).sum()
            if size >= most_bytes:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def byte_lengths(texts: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Bytes of UTF-8 per text, 0 for null."""
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype("int64")


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers starts[0], starts[0]+1, ... of every range, one range after the other."""
    total = int(lengths.sum())
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


def code_points(text: Column) -> Column:
    return F.length(F.coalesce(text, F.lit(""))).cast("long")


def running_sums(df: DataFrame, order: list[Column], values: list[str]) -> DataFrame:
    """The rows with ``{value}_until`` for each value: its sum over all rows up to the row.

    The order is global, yet no task sees more than its range of it: rows are range-partitioned
    and written, the totals of the ranges (one row for each) are summed, and inside a range the
    sum runs on.  Rows that tie in ``order`` are taken one after the other in any order, so the
    order should name whatever tells rows apart.
    """
    placed = settle(
        df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id())
    )
    totals = placed.groupBy("_range").agg(*[F.sum(v).alias(v) for v in values])
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    begins = totals.select(
        "_range", *[F.coalesce(F.sum(v).over(earlier), F.lit(0)).alias(f"_{v}") for v in values]
    )
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    summed = placed.select("*", *[F.sum(v).over(inside).alias(f"{v}_until") for v in values])
    return (
        summed.join(F.broadcast(begins), "_range")  # a row for each range
        .withColumns({f"{v}_until": F.col(f"{v}_until") + F.col(f"_{v}") for v in values})
        .drop("_range", *[f"_{v}" for v in values])
    )
