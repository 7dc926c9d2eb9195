"""Sums of doubles that are the same whatever the order of the rows and their partitions.

Adding doubles rounds, so a total depends on who is added to whom.  Here each value is cut into
whole numbers of 20 bits (limbs) on a fixed grid of powers of two, and the limbs are summed as
longs, which is exact and has no order.  A window of 60 exponents needs six limbs; the window
around one holds 1e-9 to 1e9, so ordinary rows are in one window and the others cost a row more.
The sums of all windows are put together at the end, carries first: a result is off the exact
sum by at most one unit in the last place, also where 1e300 and -1e300 cancel.

A limb sum has room for 2**43 values of a group; beyond that the sum is an error, never wrong.

Whole numbers and decimals need none of this: summed as decimals (:func:`summable_columns`) they
are exact as they are, in one exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from autoprofile.functions.coerce import as_number, quoted
from autoprofile.operators.wide import empty_frame

LIMB_BITS = 20
LIMBS = 6
TOTALS_SCHEMA = "column string, total double, count long"

# ends of the usual window, the largest double, and what a limb is worth in units of the next
LOW, HIGH, LARGEST = f"{2.0**-30!r}D", f"{2.0**30!r}D", "1.7976931348623157E308D"
UNIT = 2**LIMB_BITS


#: decimals up to this many digits leave room for 10**14 of them in a sum
SUMMABLE_DIGITS = 24
WHOLE_DIGITS = {T.ByteType: 3, T.ShortType: 5, T.IntegerType: 10, T.LongType: 20}


def summable_columns(df: DataFrame, names: list[str]) -> dict[str, Column]:
    """Columns as numbers to be summed: decimals where the type is exact, doubles elsewhere."""

    def summable(name: str) -> Column:
        dtype = df.schema[name].dataType
        if type(dtype) in WHOLE_DIGITS:
            return quoted(name).cast(T.DecimalType(WHOLE_DIGITS[type(dtype)], 0))
        return quoted(name) if _is_exact(dtype) else as_number(name, dtype)

    return {n: summable(n) for n in names}


def _is_exact(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.DecimalType) and dtype.precision <= SUMMABLE_DIGITS


def window_of(name: str) -> Column:
    """The window of a column's magnitude; 0 for zero, null and what is not finite.

    Window w holds magnitudes from 2**(60w - 30) to 2**(60w + 30).
    """
    return F.expr(
        f"CASE WHEN abs({name}) >= {LOW} AND abs({name}) < {HIGH} OR {name} = 0 "
        f"OR {name} IS NULL OR abs({name}) > {LARGEST} THEN 0 "
        f"ELSE cast(floor((log2(abs({name})) + 30) / 60) AS int) END"
    )


def usual_share(name: str) -> Column:
    """A value of the usual window as a share of the window's upper end, 0 for all others."""
    return F.expr(
        f"CASE WHEN abs({name}) >= {LOW} AND abs({name}) < {HIGH} THEN {name} * {LOW} ELSE 0D END"
    )


def _share(name: str, own: str) -> Column:
    """The same for the window of the row; ``own`` is the window of the value.

    The power of two is applied in two steps, as one may leave the range of doubles.
    """
    step = "pow(2D, window * -30 - 15)"
    return (
        F.when(F.expr(f"{own} <> window"), 0.0)
        .when(F.expr("window <> 0"), F.expr(f"{name} * {step} * {step}"))
        .otherwise(usual_share(name))
    )


def limb_sums(share: str) -> Column:
    """Aggregate: the sums of the limbs of a column of shares.

    The share has to be a column of its own, not an expression: it is used for every limb.
    """
    up_to = ["0D"] + [f"rint({share} * {float(UNIT ** (i + 1))!r}D)" for i in range(LIMBS)]
    limbs = [
        f"coalesce(sum(cast({here} - {before} * {UNIT} AS long)), 0L)"
        for before, here in zip(up_to, up_to[1:])
    ]
    return F.expr(f"array({', '.join(limbs)})")


def unbounded_kind(name: str) -> Column:
    """1 for infinity, 2 for minus infinity, 3 for NaN, else NULL; joined by ``bit_or``."""
    return F.expr(
        f"CASE WHEN abs({name}) > {LARGEST} THEN "
        f"CASE WHEN isnan({name}) THEN 3 WHEN {name} > 0 THEN 1 ELSE 2 END END"
    )


def totals_of(parts: str, kinds: str, top: str, bottom: str) -> Column:
    """The doubles behind an array of (window, limbs of each measure), one for each measure.

    ``kinds`` is an array of the ``bit_or`` of the unbounded kinds, ``top`` and ``bottom`` are
    the highest and lowest window.  Limbs of all windows lie on one grid.  From the lowest up,
    each keeps what is nearest to a multiple of 2**20 and carries the rest, so no two of them
    cancel when they are added.
    """
    limb = (
        f"aggregate({parts}, 0L, (total, part) -> total + "
        f"coalesce(get(get(part.limbs, i), place - ({top} - part.window) * 3), 0L))"
    )
    places = f"reverse(sequence(0, ({top} - {bottom}) * 3 + {LIMBS - 1}))"
    carry = f"shiftright(limb + state.carry + {UNIT // 2}, {LIMB_BITS})"
    step = "pow(2D, state.place * 10 + 5)"
    add = (
        f"struct({carry} AS carry, state.value + cast(limb + state.carry - {carry} * {UNIT} "
        f"AS double) * {step} * {step} AS value, state.place + 1 AS place)"
    )
    start = f"struct(0L AS carry, 0D AS value, {bottom} * 3 - {LIMBS - 1} AS place)"
    finite = (
        f"aggregate(transform({places}, place -> {limb}), {start}, (state, limb) -> {add}, "
        f"state -> state.value + cast(state.carry AS double) * {step} * {step})"
    )
    return F.expr(
        f"transform({kinds}, (kind, i) -> CASE kind WHEN 1 THEN double('Infinity') "
        f"WHEN 2 THEN double('-Infinity') WHEN 3 THEN double('NaN') ELSE {finite} END)"
    )


def exact_sums(df: DataFrame, keys: list[str], measures: list[str]) -> DataFrame:
    """One row per group: ``keys``, ``rows``, and ``{measure}_total``, ``{measure}_count`` each.

    ``measures`` are columns of ``df``, of doubles or of decimals of up to ``SUMMABLE_DIGITS``
    digits.  The total, a double, of a group without values is NULL.  What is shuffled is one
    row per task and group.  With doubles among the measures a row counts in every window that
    one of them lies in, and it is one row per task, group and window, then one per group and
    window.
    """
    exact = [i for i, m in enumerate(measures) if _is_exact(df.schema[m].dataType)]
    numbers = [i for i in range(len(measures)) if i not in exact]
    groups = [quoted(k) for k in keys]
    values = df.select(*groups, *[quoted(m).alias(f"m{i}") for i, m in enumerate(measures)])
    if numbers:
        merged = _by_windows(values, groups, numbers, exact)
        summed = merged.withColumn("totals", totals_of("parts", "kinds", "top", "bottom"))
    else:
        summed = values.groupBy(*groups).agg(
            F.count(F.lit(1)).alias("rows"),
            *[F.expr(f"cast(sum(m{i}) AS double) AS total{i}") for i in exact],
            *[F.expr(f"count(m{i}) AS count{i}") for i in exact],
        )

    def total(i: int) -> str:
        return f"total{i}" if i in exact else f"get(totals, {numbers.index(i)})"

    return summed.select(
        *groups,
        "rows",
        *[
            F.expr(f"CASE WHEN count{i} > 0 THEN {total(i)} END").alias(f"{m}_total")
            for i, m in enumerate(measures)
        ],
        *[F.col(f"count{i}").alias(f"{m}_count") for i, m in enumerate(measures)],
    )


def _by_windows(
    values: DataFrame, groups: list[Column], numbers: list[int], exact: list[int]
) -> DataFrame:
    """Limbs of the doubles ``numbers``, and plain sums of the decimals ``exact``, by group."""
    windows = ", ".join(f"w{i}" for i in numbers)
    cut = (
        values.withColumns({f"w{i}": window_of(f"m{i}") for i in numbers})
        .select("*", F.expr(f"posexplode(array_distinct(array({windows}))) AS (copy, window)"))
        .select(
            *groups, "copy", "window",
            *[_share(f"m{i}", f"w{i}").alias(f"share{i}") for i in numbers],
            *[F.expr(f"m{i} IS NOT NULL AND w{i} = window AS has{i}") for i in numbers],
            *[unbounded_kind(f"m{i}").alias(f"kind{i}") for i in numbers],
            *[F.expr(f"CASE WHEN copy = 0 THEN m{i} END AS m{i}") for i in exact],
        )
    )
    by_window = cut.groupBy(*groups, "window").agg(
        F.expr("count_if(copy = 0) AS rows"),
        *[limb_sums(f"share{i}").alias(f"limbs{i}") for i in numbers],
        *[F.expr(f"count_if(has{i}) AS count{i}") for i in numbers],
        *[F.expr(f"bit_or(kind{i}) AS kind{i}") for i in numbers],
        *[F.expr(f"sum(m{i}) AS total{i}") for i in exact],
        *[F.expr(f"count(m{i}) AS count{i}") for i in exact],
    )
    limbs = ", ".join(f"limbs{i}" for i in numbers)
    kinds = ", ".join(f"bit_or(kind{i})" for i in numbers)
    return by_window.groupBy(*groups).agg(
        F.expr("coalesce(sum(rows), 0L) AS rows"),
        F.expr(f"collect_list(struct(window, array({limbs}) AS limbs)) AS parts"),
        F.expr(f"array({kinds}) AS kinds"),
        F.expr("max(window) AS top"),
        F.expr("min(window) AS bottom"),
        *[F.expr(f"cast(sum(total{i}) AS double) AS total{i}") for i in exact],
        *[F.expr(f"coalesce(sum(count{i}), 0L) AS count{i}") for i in numbers + exact],
    )


def exact_totals(df: DataFrame, values: dict[str, Column]) -> DataFrame:
    """(column, total, count) of double columns, a row for each, whatever their number.

    A column without values has the total NULL and the count 0, unless the table is empty: then
    no column has a row.
    """
    if not values:
        return empty_frame(df.sparkSession, TOTALS_SCHEMA)
    slots = [str(i) for i in range(len(values))]
    long = df.select(*[v.alias(s) for s, v in zip(slots, values.values())]).unpivot(
        [], [quoted(s) for s in slots], "slot", "value"
    )
    names = F.array(*[F.lit(n) for n in values])
    return exact_sums(long, ["slot"], ["value"]).select(
        F.get(names, F.col("slot").cast("int")).alias("column"),
        F.col("value_total").alias("total"),
        F.col("value_count").alias("count"),
    )
