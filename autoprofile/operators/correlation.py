"""Pearson correlation over pairwise-complete rows.

Every pair of measures is reduced to six plain sums of the centred values.  The work per row
grows with the square of the number of measures, where generated code falls behind, so each task
multiplies its Arrow batches as matrices: measured on 600,000 rows and 16 measures, half a second
instead of five to eight with any tiling of aggregates.  Measures are taken in blocks; a task
hands on one row for each pair of blocks.

Centring on the column mean keeps the sums accurate.  Where a pair's spread all but vanishes
against its distance from that mean, so that the difference of the sums would lose its digits,
the pair is recomputed with the built-in co-moment aggregates.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from math import isfinite, sqrt

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from autoprofile.functions.coerce import number_columns
from autoprofile.operators.wide import chunked, empty_frame, local_frame, per_column

MATRIX_SCHEMA = "i int, j int, col1 string, col2 string, correlation double"
SUMS = ("n", "sx", "sy", "sxx", "syy", "sxy")
#: measures of a block, and rows that the sums of a pair of blocks are first merged into
BLOCK, MERGERS = 64, 64
#: least share of a sum of squares that must be spread for its difference to be trusted
LEAST_SPREAD = 1e-9


def pearson(x: Column, y: Column) -> Column:
    """Correlation of the rows where both are present; NULL when one side is constant."""
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    return F.try_divide(F.covar_pop(x, y), F.nullif(spread, F.lit(0.0)))


def _over_pairs(
    df: DataFrame, pairs: list[tuple[int, int]], make: Callable[[Column, Column], list[Column]]
) -> DataFrame:
    """One row per pair of the columns ``v<i>`` with the aggregates ``make`` builds."""
    used = sorted({k for pair in pairs for k in pair})
    results = [
        F.struct(
            F.lit(i).alias("i"), F.lit(j).alias("j"), *make(F.col(f"v{i}"), F.col(f"v{j}"))
        ).alias(f"p{k}")
        for k, (i, j) in enumerate(pairs)
    ]
    return (
        df.select(*[f"v{k}" for k in used])
        .agg(*results)
        .select(F.inline(F.array(*[F.col(f"p{k}") for k in range(len(pairs))])))
    )


def _block_sums(measures: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sums of all pairs over the batches of one task, as matrix products of blocks of measures:
    one row for each pair of blocks."""
    starts = range(0, measures, BLOCK)
    pairs = [(a, b) for a in starts for b in starts if a <= b]

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {pair: None for pair in pairs}
        for batch in batches:
            values = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            present = ~np.isnan(values)
            filled = np.where(present, values, 0.0)
            present = present.astype(float)
            with np.errstate(all="ignore"):
                squares = filled * filled
                for a, b in pairs:
                    x, y = slice(a, a + BLOCK), slice(b, b + BLOCK)
                    found = np.stack([
                        present[:, x].T @ present[:, y],
                        filled[:, x].T @ present[:, y],
                        present[:, x].T @ filled[:, y],
                        squares[:, x].T @ present[:, y],
                        present[:, x].T @ squares[:, y],
                        filled[:, x].T @ filled[:, y],
                    ])
                    sums[a, b] = found if sums[a, b] is None else sums[a, b] + found
        met = [pair for pair in pairs if sums[pair] is not None]
        part = TaskContext.get().partitionId() % MERGERS
        yield pa.RecordBatch.from_arrays(
            [pa.array([a for a, _ in met], pa.int32()), pa.array([b for _, b in met], pa.int32()),
             pa.array([part] * len(met), pa.int32()),
             pa.array([sums[pair].tobytes() for pair in met], pa.binary())],
            names=["a", "b", "part", "sums"],
        )

    return multiply


def _merged(rows: pa.Table) -> pa.Table:
    """The sums of several tasks as one row."""
    total = np.sum([np.frombuffer(x.as_py()) for x in rows["sums"]], axis=0)
    first = {c: pa.array([rows[c][0].as_py()], pa.int32()) for c in ("a", "b", "part")}
    return pa.table({**first, "sums": pa.array([total.tobytes()], pa.binary())})


def _all_sums(centred: DataFrame, measures: int) -> Iterator[dict]:
    """The sums of every pair i <= j.

    Blocks are merged in two steps, so no task gets a row from every task of the scan.
    """
    schema = "a int, b int, part int, sums binary"
    merged = (
        centred.mapInArrow(_block_sums(measures), schema)
        .groupBy("a", "b", "part").applyInArrow(_merged, schema)
        .groupBy("a", "b").applyInArrow(_merged, schema)
    )
    found = {(r["a"], r["b"]): r["sums"] for r in merged.collect()}
    for i in range(measures):
        for j in range(i, measures):
            a, b = i // BLOCK * BLOCK, j // BLOCK * BLOCK
            sums = [0.0] * len(SUMS)
            if (a, b) in found:
                shape = (len(SUMS), min(BLOCK, measures - a), min(BLOCK, measures - b))
                sums = np.frombuffer(found[a, b]).reshape(shape)[:, i - a, j - b].tolist()
            yield {"i": i, "j": j, **dict(zip(SUMS, sums))}


def _from_sums(row: dict) -> tuple[float | None, bool]:
    """(correlation, whether it can be trusted)."""
    if not row["n"]:
        return None, True
    spread_x = row["sxx"] - row["sx"] ** 2 / row["n"]
    spread_y = row["syy"] - row["sy"] ** 2 / row["n"]
    trusted = (
        isfinite(spread_x * spread_y)
        and spread_x > LEAST_SPREAD * row["sxx"]
        and spread_y > LEAST_SPREAD * row["syy"]
    )
    if not trusted:
        return None, False
    r = (row["sxy"] - row["sx"] * row["sy"] / row["n"]) / (sqrt(spread_x) * sqrt(spread_y))
    return max(-1.0, min(1.0, r)), True


def upper_triangle(
    df: DataFrame, columns: list[str], means: dict[str, float | None] | None = None
) -> DataFrame:
    """Unrounded correlations of every pair i <= j, one local row per pair.

    ``means`` saves a scan where the column means are known already.
    """
    if not columns:
        return empty_frame(df.sparkSession, MATRIX_SCHEMA)
    values = number_columns(df, columns)
    if means is None:
        facts = [
            [F.lit(c).alias("column"), F.avg(value).alias("mean")] for c, value in values.items()
        ]
        means = {
            r["column"]: r["mean"] for r in per_column(df, facts, fields_per_column=2).collect()
        }
    plain = df.select(*[values[c].alias(f"v{k}") for k, c in enumerate(columns)])
    centred = df.select(
        *[(values[c] - F.lit(means[c] or 0.0)).alias(f"v{k}") for k, c in enumerate(columns)]
    )
    found: dict[tuple[int, int], float | None] = {}
    doubtful = []
    for row in _all_sums(centred, len(columns)):
        found[row["i"], row["j"]], trusted = _from_sums(row)
        if not trusted:
            doubtful.append((row["i"], row["j"]))
    if doubtful:
        again = [
            _over_pairs(plain, pairs, lambda x, y: [pearson(x, y).alias("correlation")])
            for pairs in chunked(sorted(doubtful), 9)
        ]
        for row in reduce(DataFrame.unionByName, again).collect():
            found[row["i"], row["j"]] = row["correlation"]
    rows = [(i, j, columns[i], columns[j], r) for (i, j), r in sorted(found.items())]
    return local_frame(df.sparkSession, rows, MATRIX_SCHEMA)


def mirrored(triangle: DataFrame, digits: int = 4) -> DataFrame:
    """The full matrix in long form, rounded."""
    forward = F.struct("i", "j", "col1", "col2", "correlation")
    backward = F.struct(
        F.col("j").alias("i"), F.col("i").alias("j"),
        F.col("col2").alias("col1"), F.col("col1").alias("col2"), F.col("correlation"),
    )
    cells = F.when(F.col("i") == F.col("j"), F.array(forward)).otherwise(
        F.array(forward, backward)
    )
    return (
        triangle.select(F.inline(cells))
        .select("i", "j", "col1", "col2", F.round("correlation", digits).alias("correlation"))
    )


def correlation_matrix(df: DataFrame, columns: list[str], min_columns: int = 2) -> DataFrame:
    """(col1, col2, correlation) for all ordered pairs; no row for too few columns."""
    if len(columns) < min_columns:
        return empty_frame(df.sparkSession, "col1 string, col2 string, correlation double")
    return (
        mirrored(upper_triangle(df, columns))
        .orderBy("i", "j")
        .select("col1", "col2", "correlation")
    )


def strong_of(triangle: DataFrame, limit: float = 0.7, digits: int = 4) -> DataFrame:
    """Pairs at or beyond ``limit`` on either side, in matrix order."""
    r = F.col("correlation")
    return (
        triangle.where((F.col("i") < F.col("j")) & (F.abs(r) >= limit))
        .orderBy("i", "j")
        .select(
            "col1",
            "col2",
            F.round(r, digits).alias("correlation"),
            F.when(r >= limit, "strong positive").otherwise("strong negative").alias("strength"),
        )
    )


def strong_correlations(df: DataFrame, columns: list[str], limit: float = 0.7) -> DataFrame:
    return strong_of(upper_triangle(df, columns), limit)


def heatmap(matrix: DataFrame, columns: list[str]) -> DataFrame:
    """The matrix in wide form: one row and one column per measure."""
    return matrix.groupBy("col1").pivot("col2", columns).agg(F.first("correlation"))
