"""Whitening of vectors by their largest principal components, without a covariance matrix.

The components are eigenvectors of the covariance, found by Jacobi-Davidson: a small subspace
grows by solutions of projected correction equations, which MINRES solves one product at a time;
Rayleigh-Ritz in the subspace gives the approximations, and one whose residual has reached double
precision is locked.  The only thing done with the covariance is to multiply it by a few vectors
at once: every task multiplies its centred rows and adds up, so a product is one pass over the
rows and what comes back is a few numbers per dimension.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from autoprofile.llm.common import column, settle

#: entries become floor(SCALE * entry) + OFFSET (fixed values), and stay within MOST
SCALE, OFFSET, MOST = 1024, 100_000, 1 << 60
#: vectors of a stored block
BLOCK_ROWS = 1024
#: partial sums that come to the driver as they are; of more, some are added up before
DIRECT_PARTS = 512
EPS = float(np.finfo(float).eps)


@dataclass(frozen=True)
class WhitenRules:
    components: int = 8
    #: approximations that are improved together with the wanted ones
    guard: int = 4
    #: steps of MINRES for a correction
    inner_steps: int = 3
    #: corrections at most; not to have converged by then is an error
    outer_steps: int = 200
    #: vectors of the subspace at most, beyond which it is cut back to its best ones
    basis: int = 64
    #: a residual is at double precision below so many rounding units of the largest eigenvalue
    rounding_units: float = 64.0
    seed: int = 7


@dataclass(frozen=True)
class Centre:
    """The number of vectors and the exact sums of their entries."""

    rows: int
    sums: tuple[int, ...]

    @property
    def whole(self) -> np.ndarray:
        return np.array([s // self.rows for s in self.sums], dtype=np.int64)

    @property
    def rest(self) -> np.ndarray:
        return np.array([s % self.rows for s in self.sums], dtype=np.int64)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - sums / rows; the difference is taken before anything is rounded."""
        return (x - self.whole).astype(float) - self.rest / self.rows

    def deviations(self, x: np.ndarray) -> list[int]:
        """Exact sums of (rows * x - sums)**2 over the entries of each row."""
        near = x - self.whole
        largest = int(np.abs(near).max(initial=0)) + 1
        if len(self.sums) * (self.rows * largest) ** 2 >= 1 << 63:
            near = near.astype(object)
        far = self.rows * near - self.rest
        return [int(d) for d in (far * far).sum(axis=1)]


def _entries(df: DataFrame, key: str, vector: str) -> DataFrame:
    """Keys and integer entries of the vectors that have all entries, and finite ones."""
    own = column(df, vector).cast("array<double>")
    entries = df.select(column(df, key).alias("id"), own.alias("v")).filter(
        F.col("v").isNotNull()
        & F.forall(
            "v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
        )
    )
    bound = F.lit(float(MOST))

    def whole(c):
        return F.floor(F.greatest(F.least(c * SCALE, bound), -bound)).cast("long") + F.lit(OFFSET)

    return entries.select("id", F.transform("v", whole).alias("x"))


def _centre(entries: DataFrame) -> Centre | None:
    """Sums per dimension, one row for each; None where there is nothing to centre."""
    sums = (
        entries.select(F.posexplode("x").alias("place", "x"))
        .groupBy("place")
        .agg(F.count("*").alias("n"), F.sum(F.col("x").cast("decimal(28,0)")).alias("sum"))
        .sort("place")
        .collect()  # a row for each dimension
    )
    return Centre(sums[0]["n"], tuple(int(r["sum"]) for r in sums)) if sums else None


def _blocks(entries: DataFrame, dimensions: int) -> DataFrame:
    """Vectors in blocks: their keys and their entries as one matrix of 64-bit numbers."""
    schema = T.StructType([
        T.StructField("ids", T.ArrayType(entries.schema["id"].dataType, True)),
        T.StructField("matrix", T.BinaryType()),
    ])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(start, BLOCK_ROWS)
                matrix = part.column("x").flatten().to_numpy().astype("<i8")
                ids = pa.ListArray.from_arrays([0, part.num_rows], part.column("id"))
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array([matrix.tobytes()], pa.binary())], names=["ids", "matrix"]
                )

    return settle(entries.mapInArrow(build, schema))


def _matrices(batches: Iterator[pa.RecordBatch], dimensions: int) -> Iterator[np.ndarray]:
    for batch in batches:
        for data in batch.column("matrix"):
            yield np.frombuffer(data.as_buffer(), "<i8").reshape(-1, dimensions)


def _sum_over(blocks: DataFrame, shape: tuple[int, int], own: Callable) -> np.ndarray:
    """The sum over all blocks of the matrix that ``own`` makes of each, one pass.

    A task sends one matrix of this shape; where tasks are many they are added up in groups
    first.
    """
    dimensions = own.dimensions

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, any_rows = np.zeros(shape, np.longdouble), False
        for x in _matrices(batches, dimensions):
            total += own(x)
            any_rows = True
        if any_rows:
            yield pa.RecordBatch.from_arrays(
                [pa.array([total.astype(float).tobytes()], pa.binary())], names=["part"]
            )

    def together(parts: pa.Table) -> pa.Table:
        whole = _added(parts.column("part").to_pylist(), shape).astype(float)
        return pa.table({"part": pa.array([whole.tobytes()], pa.binary())})

    parts = blocks.select("matrix").mapInArrow(add, "part binary")
    if blocks.rdd.getNumPartitions() > DIRECT_PARTS:
        group = F.pmod(F.spark_partition_id(), F.lit(DIRECT_PARTS))
        parts = parts.withColumn("group", group).groupBy("group").applyInArrow(
            together, "part binary"
        )
    return _added([r["part"] for r in parts.collect()], shape).astype(float)


def _added(parts: list[bytes], shape: tuple[int, int]) -> np.ndarray:
    total = np.zeros(shape, np.longdouble)
    for part in sorted(map(bytes, parts)):  # an order that does not depend on who came first
        total += np.frombuffer(part).reshape(shape)
    return total


@dataclass(frozen=True)
class _Product:
    """Of a block: its centred rows times the vectors, times the centred rows again."""

    centre: Centre
    vectors: np.ndarray

    @property
    def dimensions(self) -> int:
        return len(self.centre.sums)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        c = self.centre.centred(x)
        return c.T @ (c @ self.vectors)


@dataclass(frozen=True)
class _Trace:
    """Sum of the squares of all centred entries."""

    centre: Centre

    @property
    def dimensions(self) -> int:
        return len(self.centre.sums)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return (self.centre.centred(x) ** 2).sum(keepdims=True).reshape(1, 1)


@dataclass(frozen=True)
class Whitening:
    """Centred rows projected on components, over the roots of their eigenvalues."""

    centre: Centre
    values: np.ndarray
    vectors: np.ndarray

    @property
    def dimensions(self) -> int:
        return len(self.centre.sums)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return self.centre.centred(x) @ self.vectors / np.sqrt(self.values)


@dataclass(frozen=True)
class _Moments:
    """Sums of whitened rows or, once their mean is known, their centred products."""

    whitening: Whitening
    mean: np.ndarray | None = None

    @property
    def dimensions(self) -> int:
        return self.whitening.dimensions

    def __call__(self, x: np.ndarray) -> np.ndarray:
        white = self.whitening(x)
        if self.mean is None:
            return white.sum(axis=0, keepdims=True)
        return (white - self.mean).T @ (white - self.mean)


def minres(
    times: Callable[[np.ndarray], np.ndarray], right: np.ndarray, steps: int
) -> np.ndarray:
    """Approximate solutions x of ``times(x) = right`` after so many products.

    ``times`` is symmetric and may be indefinite; it may differ from column to column.  All
    columns take a step with each product, a column that is solved stands still.
    """
    x = np.zeros_like(right)
    before, w_before, w = (np.zeros_like(right) for _ in range(3))
    gamma = np.linalg.norm(right, axis=0)
    first = np.maximum(gamma, np.finfo(float).tiny)
    v, eta = right / first, gamma.copy()
    live = gamma > 0
    c_before = c = np.ones(right.shape[1])
    s_before = s = np.zeros(right.shape[1])
    gamma = np.zeros(right.shape[1])
    for _ in range(steps):
        if not live.any():
            break
        product = times(v)
        delta = (v * product).sum(axis=0)
        following = product - delta * v - gamma * before
        gamma_next = np.linalg.norm(following, axis=0)
        a0 = c * delta - c_before * s * gamma
        a1 = np.hypot(a0, gamma_next)
        a2 = s * delta + c_before * c * gamma
        a3 = s_before * gamma
        live &= a1 > EPS * np.abs(delta)
        safe = np.where(live, a1, 1.0)
        c_before, c = c, np.where(live, a0 / safe, c)
        s_before, s = s, np.where(live, gamma_next / safe, s)
        w_before, w = w, np.where(live, (v - a3 * w_before - a2 * w) / safe, w)
        x += np.where(live, c * eta * w, 0)
        eta = np.where(live, -s * eta, eta)
        live &= gamma_next > EPS * np.abs(delta)
        before, v, gamma = v, following / np.where(live, gamma_next, 1.0), gamma_next
    return x


def _orthonormal(new: np.ndarray, *against: np.ndarray) -> np.ndarray:
    """Orthonormal vectors for what ``new`` adds to the spaces of the others."""
    kept = []
    for column_ in new.T:
        size = np.linalg.norm(column_)
        if not np.isfinite(size) or size == 0:
            continue
        column_ = column_ / size
        others = [*against, *([np.array(kept).T] if kept else [])]
        for _ in range(3):  # once does not suffice in floating point
            for space in others:
                column_ = column_ - space @ (space.T @ column_)
        size = np.linalg.norm(column_)
        if size > 1e-8:
            column_ = column_ / size
            for space in others:
                column_ = column_ - space @ (space.T @ column_)
            kept.append(column_ / np.linalg.norm(column_))
    return np.array(kept).T if kept else np.zeros((len(new), 0))


def largest_eigenpairs(
    times: Callable[[np.ndarray], np.ndarray], dimensions: int, rules: WhitenRules
) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues of a symmetric operator, falling, and unit eigenvectors.

    ``times`` multiplies it by the columns of a matrix.  A residual is the true one: locked
    vectors are multiplied once more at the end, and what fails goes on.
    """
    wanted = min(rules.components, dimensions)
    width = min(wanted + rules.guard, dimensions)
    random = np.random.default_rng(rules.seed)
    locked = np.zeros((dimensions, 0))
    space = _orthonormal(random.standard_normal((dimensions, width)))
    image = times(space)
    scale = 0.0
    for _ in range(rules.outer_steps):
        # Rayleigh-Ritz
        small = space.T @ image
        values, turns = np.linalg.eigh((small + small.T) / 2)
        values, turns = values[::-1], turns[:, ::-1]
        space, image = space @ turns, image @ turns
        scale = max(scale, abs(values[0]) if len(values) else 0.0)
        residuals = image - space * values
        if locked.shape[1]:
            residuals -= locked @ (locked.T @ residuals)
        sizes = np.linalg.norm(residuals, axis=0)
        close = sizes <= rules.rounding_units * EPS * scale
        ready = 0  # locked in falling order, so that none is passed over
        while ready < len(close) and close[ready] and locked.shape[1] + ready < wanted:
            ready += 1
        locked = np.hstack([locked, space[:, :ready]])
        space, image, values, residuals = (
            a[..., ready:] for a in (space, image, values, residuals)
        )
        if locked.shape[1] == wanted:
            again = times(locked)
            small = locked.T @ again
            values, turns = np.linalg.eigh((small + small.T) / 2)
            values, turns = values[::-1], turns[:, ::-1]
            vectors = locked @ turns
            sizes = np.linalg.norm(again @ turns - vectors * values, axis=0)
            if (sizes <= 2 * rules.rounding_units * EPS * scale).all():
                signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), range(wanted)])
                return values, vectors * signs
            space, image = np.hstack([locked, space]), np.hstack([again, image])
            locked = np.zeros((dimensions, 0))
            continue

        more = min(width - locked.shape[1], space.shape[1])
        if space.shape[1] + more > rules.basis:
            keep = max(rules.basis // 2, more)
            space, image = space[:, :keep], image[:, :keep]
        near = np.hstack([locked, space[:, :more]])
        shifts = values[:more]

        def projected(v: np.ndarray, near=near, shifts=shifts) -> np.ndarray:
            v = v - near @ (near.T @ v)
            out = times(v) - v * shifts
            return out - near @ (near.T @ out)

        steps = rules.inner_steps if near.shape[1] < dimensions else 0
        right = -residuals[:, :more]
        right = right - near @ (near.T @ right)
        found = minres(projected, right, steps)
        new = _orthonormal(found, locked, space)
        if not new.shape[1]:
            free = random.standard_normal((dimensions, max(more, 1)))
            new = _orthonormal(free, locked, space)
        if new.shape[1]:
            space, image = np.hstack([space, new]), np.hstack([image, times(new)])
        else:  # the subspace is all there is: what is left is rounding in its products
            image = times(space)
    raise ArithmeticError("the components did not converge")


def whiten(
    df: DataFrame, rules: WhitenRules = WhitenRules(), key: str = "vec_id",
    vector: str = "embedding",
) -> DataFrame:
    """A row per vector and component: the vector's whitened coordinate.

    Vectors that are null or hold a null or non-finite entry are left out, and so are those
    shorter than the longest, which lack entries.  Each other entry c becomes floor(1024 c) +
    100000, at most 2**60 in size.  Columns: the key, component (from 1 by falling eigenvalue), n
    (vectors), deviation (exact sum of (n x - sum)**2 over the dimensions; null beyond a long),
    whitened, explained (share of the trace), identity_error (largest entry of the covariance
    of the whitened vectors minus the identity).  A component without variance has none to be
    whitened by and is left out, so equal vectors give an empty result, as does an empty table.
    Null and repeated keys are rows of their own; other columns are not read.
    """
    entries = _entries(df, key, vector)
    own_type = entries.schema["id"].dataType
    schema = T.StructType([
        T.StructField(key, own_type),
        T.StructField("component", T.IntegerType()),
        T.StructField("n", T.LongType()),
        T.StructField("deviation", T.LongType()),
        T.StructField("whitened", T.DoubleType()),
        T.StructField("explained", T.DoubleType()),
        T.StructField("identity_error", T.DoubleType()),
    ])
    nothing = df.sparkSession.createDataFrame([], schema)
    dimensions = entries.agg(F.max(F.size("x"))).first()[0]
    if not dimensions:
        return nothing
    entries = entries.filter(F.size("x") == dimensions)
    centre = _centre(entries)
    blocks = _blocks(entries, dimensions)

    def times(vectors: np.ndarray) -> np.ndarray:
        return _sum_over(blocks, vectors.shape, _Product(centre, vectors)) / centre.rows

    trace = _sum_over(blocks, (1, 1), _Trace(centre))[0, 0] / centre.rows
    if not trace > 0:
        return nothing
    values, vectors = largest_eigenpairs(times, dimensions, rules)
    there = values > rules.rounding_units * EPS * max(values[0], 0)
    whitening = Whitening(centre, values[there], vectors[:, there])
    width = int(there.sum())
    mean = _sum_over(blocks, (1, width), _Moments(whitening)) / centre.rows
    spread = _sum_over(blocks, (width, width), _Moments(whitening, mean)) / centre.rows
    error = float(np.abs(spread - np.eye(width)).max())
    explained = whitening.values / trace

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                block = batch.slice(i, 1)
                (x,) = _matrices(iter([block]), dimensions)
                deviations = [d if d < 1 << 63 else None for d in centre.deviations(x)]
                place = pa.array(np.repeat(np.arange(len(x)), width))
                size = len(x) * width
                yield pa.RecordBatch.from_arrays(
                    [
                        block.column("ids").flatten().take(place),
                        pa.array(np.tile(np.arange(1, width + 1), len(x)), pa.int32()),
                        pa.array(np.full(size, centre.rows), pa.int64()),
                        pa.array(deviations, pa.int64()).take(place),
                        pa.array(whitening(x).ravel()),
                        pa.array(np.tile(explained, len(x))),
                        pa.array(np.full(size, error)),
                    ],
                    names=schema.names,
                )

    return blocks.mapInArrow(rows, schema)

