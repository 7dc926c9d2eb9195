"""One aggregation over a table, one result row per column.

Statistics of many columns are computed side by side in a single ``agg`` (no shuffle but
one row per task) and turned into rows afterwards.  Whole-stage code generation gives up
on plans of more than 100 fields, so a very wide table is split into several aggregations
that each read only their own columns; with a columnar source the bytes read stay the same.
"""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FIELD_BUDGET = 90


def chunked(items: list, size: int) -> list[list]:
    return [items[i : i + size] for i in range(0, len(items), max(size, 1))]


def per_column(
    df: DataFrame, facts: list[list[Column]], fields_per_column: int, schema: str = ""
) -> DataFrame:
    """``facts``: for each column the same list of aliased aggregates.

    Without columns the result is an empty frame of ``schema``.
    """
    if not facts:
        return empty_frame(df.sparkSession, schema)
    parts = []
    for group in chunked(facts, max(1, FIELD_BUDGET // fields_per_column)):
        structs = [F.struct(*columns).alias(f"c{i}") for i, columns in enumerate(group)]
        wide = df.agg(*structs)
        parts.append(
            wide.select(F.inline(F.array(*[F.col(f"c{i}") for i in range(len(group))])))
        )
    return reduce(DataFrame.unionByName, parts)


def _arrow_type(dtype: T.DataType) -> pa.DataType:
    if isinstance(dtype, T.ArrayType):
        return pa.list_(_arrow_type(dtype.elementType))
    return {
        "integer": pa.int32(),
        "long": pa.int64(),
        "double": pa.float64(),
        "string": pa.string(),
        "boolean": pa.bool_(),
        "date": pa.date32(),
        "timestamp": pa.timestamp("us", tz="UTC"),
    }[dtype.typeName()]


def local_frame(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small frame from driver rows.  Built through Arrow, so reading it needs no job."""
    struct = T.StructType.fromDDL(schema)
    columns = list(zip(*rows)) or [()] * len(struct)
    arrays = [
        pa.array(list(values), type=_arrow_type(field.dataType))
        for values, field in zip(columns, struct)
    ]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, names=struct.names), struct)


def empty_frame(spark: SparkSession, schema: str) -> DataFrame:
    return local_frame(spark, [], schema)


def pin(df: DataFrame) -> DataFrame:
    """Materialise a result whose size is bounded by the number of columns or by a top-N.

    Only for frames of that kind: they are read by several later steps and are far smaller
    than the work behind them.
    """
    return df.sparkSession.createDataFrame(df.toArrow(), df.schema)
