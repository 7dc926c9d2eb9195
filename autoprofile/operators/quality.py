"""Data-quality rules, one row per finding, and the quality score."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from autoprofile import messages
from autoprofile.config import Config
from autoprofile.functions.coerce import (
    INTEGER_PATTERN,
    family,
    moment,
    nan_to_null,
    quoted,
    strip,
    text_number,
    text_timestamp,
)
from autoprofile.functions.numeric import percent
from autoprofile.operators.dates import date_columns
from autoprofile.operators.frequencies import value_counts, variants_of
from autoprofile.operators.numbers import Distribution, distributions, outlier_counts
from autoprofile.operators.tables import null_profile
from autoprofile.operators.wide import local_frame, per_column, pin

OLDEST_PLAUSIBLE = dt.datetime(1900, 1, 1)

# Points taken off the score.
NULL_PENALTY = 40.0
PENALTIES = {"error": 5.0, "warning": 2.0, "info": 0.5}

SHAPES = ("bool", "date", "float", "int")


# ------------------------------------------------------------------ single checks


def text_shape(text: Column) -> Column:
    """What a text looks like: int, float, bool, date or plain text."""
    stripped = strip(text)
    return (
        F.when((F.octet_length(stripped) <= 5) & F.lower(stripped).isin("true", "false"), "bool")
        .when(stripped.rlike(INTEGER_PATTERN), "int")
        .when(text_number(text, strip_commas=False).isNotNull(), "float")
        .when(text_timestamp(text).isNotNull(), "date")
        .otherwise("text")
    )


def shape_counts_of(counts: DataFrame) -> DataFrame:
    """The same from value frequencies: every distinct label is looked at once."""
    shaped = counts.withColumn("shape", text_shape(F.col("value")))
    return shaped.groupBy("column").agg(
        *[
            F.sum(F.when(F.col("shape") == s, F.col("count")).otherwise(0))
            .cast("long")
            .alias(f"{s}_count")
            for s in (*SHAPES, "text")
        ]
    )


def shape_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """How many non-null texts of each column have each shape, in one scan."""
    facts = []
    shaped = df.select(*[text_shape(quoted(c)).alias(c) for c in columns],
                       *[quoted(c).isNotNull().alias(f"has {c}") for c in columns])
    for name in columns:
        present = quoted(f"has {name}")
        facts.append(
            [F.lit(name).alias("column")]
            + [
                F.count_if(present & (quoted(name) == shape)).alias(f"{shape}_count")
                for shape in (*SHAPES, "text")
            ]
        )
    schema = ", ".join(["column string", *[f"{s}_count long" for s in (*SHAPES, "text")]])
    return per_column(shaped, facts, fields_per_column=5, schema=schema)


def mixed_shapes(df: DataFrame, columns: list[str]) -> DataFrame:
    """Text columns that mix shapes.

    Two or more shapes besides plain text are a mix of value types; numbers of one shape are
    worth a note when plain texts stand next to them.
    """
    return shape_verdicts(shape_counts(df, columns))


def shape_verdicts(counts: DataFrame) -> DataFrame:
    found = F.array_compact(
        F.array(*[F.when(F.col(f"{s}_count") > 0, F.lit(s)) for s in SHAPES])
    )
    return counts.withColumn("shapes", found).withColumn(
        "verdict",
        F.when(F.size("shapes") > 1, "mixed")
        .when(
            F.exists("shapes", lambda s: s.isin("int", "float")) & (F.col("text_count") > 0),
            "non_string",
        )
        .otherwise("uniform"),
    )


def whitespace_values(df: DataFrame, columns: list[str]) -> DataFrame:
    """Texts with white space at either end, per column."""
    facts = [
        [
            F.lit(c).alias("column"),
            F.count_if(quoted(c) != strip(quoted(c))).alias("padded_count"),
        ]
        for c in columns
    ]
    return per_column(df, facts, fields_per_column=1, schema="column string, padded_count long")


def whitespace_of(counts: DataFrame) -> DataFrame:
    """The same from value frequencies."""
    padded = F.col("value") != strip(F.col("value"))
    return counts.groupBy("column").agg(
        F.sum(F.when(padded, F.col("count")).otherwise(0)).cast("long").alias("padded_count")
    )


def date_bounds(df: DataFrame, columns: list[str], as_of: dt.datetime | None = None) -> DataFrame:
    """Dates after ``as_of`` (default: now) and before 1900, per time column."""
    now = F.current_timestamp() if as_of is None else moment(as_of)
    facts = []
    for name, date in date_columns(df, columns).items():
        facts.append([
            F.lit(name).alias("column"),
            F.count_if(date > now).alias("future_count"),
            F.count_if(date < moment(OLDEST_PLAUSIBLE)).alias("old_count"),
        ])
    schema = "column string, future_count long, old_count long"
    return per_column(df, facts, fields_per_column=2, schema=schema)


# ------------------------------------------------------------------ all rules


def column_measurements(
    df: DataFrame,
    typed: list[tuple[str, str]],
    config: Config,
    as_of: dt.datetime | None,
    found: list[Distribution] | None,
    outliers: DataFrame | None,
    catalog: DataFrame | None,
    counts: DataFrame | None = None,
) -> DataFrame:
    """One row per analysed column with everything the rules look at.

    Each check scans only the columns of the type it applies to.  Labels repeat, so all text
    checks on them run over one shared table of distinct labels and their ``counts``.
    """
    rules = config.quality
    strings = [c for c, _ in typed if family(df.schema[c].dataType) == "string"]
    labels = [c for c, t in typed if t == "categorical" and c in strings]
    others = [c for c in strings if c not in labels]
    texts = [c for c, t in typed if t == "text" and c in strings]
    numbers = [c for c, t in typed if t == "numeric"]
    times = [c for c, t in typed if t == "datetime"]
    if found is None:
        found = distributions(df, numbers)
    if outliers is None:
        outliers = outlier_counts(df, found, rules.iqr_factor, rules.zscore_limit)

    spark = df.sparkSession
    names = local_frame(
        spark,
        [(i, c, t) for i, (c, t) in enumerate(typed)],
        "position int, column string, type string",
    )
    if counts is None:
        counts = value_counts(df, labels)
    else:
        counts = counts.where(F.col("column").isin(*labels))
    spaces, shapes = [], []
    if labels:
        spaces.append(whitespace_of(counts))
        shapes.append(shape_counts_of(counts))
    if others:
        spaces.append(whitespace_values(df, others))
    if texts:
        shapes.append(shape_counts(df, texts))
    verdicts = [shape_verdicts(s).select("column", "shapes", "verdict") for s in shapes]
    parts = [
        null_profile(df, [c for c, _ in typed]) if catalog is None else catalog_counts(catalog),
        reduce(DataFrame.unionByName, spaces) if spaces else None,
        reduce(DataFrame.unionByName, verdicts) if verdicts else None,
        date_bounds(df, times, as_of) if times else None,
        variants_of(counts).select("column", "variants") if labels else None,
        outliers.drop("whisker_low", "whisker_high"),
    ]
    defaults = {
        "padded_count": "long", "shapes": "array<string>", "verdict": "string",
        "future_count": "long", "old_count": "long", "variants": "long", "unique_count": "long",
    }
    result = names
    for part in parts:
        if part is not None:
            result = result.join(F.broadcast(part), "column", "left")
    for name, kind in defaults.items():
        if name not in result.columns:
            result = result.withColumn(name, F.lit(None).cast(kind))
    figures = local_frame(
        spark,
        [
            (d.column, d.mean, d.median, d.std, d.min, d.max, d.q1, d.q3, d.skewness, d.kurtosis)
            for d in found
            if d.count
        ],
        "column string, mean double, median double, std double, min double, max double, "
        "q1 double, q3 double, skewness double, kurtosis double",
    )
    stats = figures.select(
        "column",
        F.struct(*[F.round(n, 4).alias(n) for n in figures.columns[1:]]).alias("numeric_stats"),
    )
    return result.join(F.broadcast(stats), "column", "left")


def catalog_counts(catalog: DataFrame) -> DataFrame:
    return catalog.select(
        F.col("column_name").alias("column"),
        "total_rows", "null_count", "non_null_count", "null_pct", "unique_count",
    )


def _candidate(
    applies: Column, severity: str, rule: str, value: Column, message: Column
) -> Column:
    return F.when(
        applies,
        F.struct(
            F.lit(severity).alias("severity"),
            F.lit(rule).alias("rule"),
            value.cast("double").alias("value"),
            message.alias("message"),
        ),
    )


def _candidates(config: Config) -> Column:
    rules = config.quality
    c = F.col
    shape_list = F.array_join("shapes", ", ")
    skewness = c("numeric_stats.skewness")
    return F.array(
        _candidate(
            c("null_pct") / 100 >= rules.high_null_share, "warning", "high_nulls", c("null_pct"),
            F.format_string(messages.HIGH_NULLS, c("null_pct")),
        ),
        _candidate(
            c("verdict") == "mixed", "warning", "mixed_types", F.size("shapes"),
            F.format_string(messages.MIXED_TYPES, shape_list),
        ),
        _candidate(
            c("verdict") == "non_string", "warning", "mixed_types", F.size("shapes"),
            F.format_string(messages.NON_STRINGS, shape_list),
        ),
        _candidate(
            c("padded_count") > 0, "info", "edge_whitespace", c("padded_count"),
            F.format_string(messages.EDGE_SPACE, c("padded_count")),
        ),
        _candidate(
            c("iqr_outlier_count") > 0, "warning", "outliers", c("iqr_outlier_count"),
            F.format_string(
                messages.OUTLIERS, c("iqr_outlier_count"), c("iqr_lower"), c("iqr_upper")
            ),
        ),
        _candidate(
            F.abs(skewness) > rules.skewness_limit, "info", "skewness", skewness,
            F.format_string(messages.SKEWED, skewness),
        ),
        _candidate(
            c("future_count") > 0, "warning", "future_dates", c("future_count"),
            F.format_string(messages.FUTURE_DATES, c("future_count")),
        ),
        _candidate(
            c("old_count") > 0, "warning", "old_dates", c("old_count"),
            F.format_string(messages.OLD_DATES, c("old_count")),
        ),
        _candidate(
            c("variants") > 0, "info", "label_variants", c("variants"),
            F.format_string(messages.LABEL_VARIANTS, c("variants")),
        ),
    )


def with_issues(measurements: DataFrame, config: Config | None = None) -> DataFrame:
    """Adds ``found``, the array of issues of each column, in rule order."""
    return measurements.withColumn("found", F.array_compact(_candidates(config or Config())))


def issues_of(judged: DataFrame) -> DataFrame:
    return (
        judged.select("position", "column", F.posexplode("found").alias("rule_no", "issue"))
        .orderBy("position", "rule_no")
        .select("column", "issue.severity", "issue.rule", "issue.value", "issue.message")
    )


def column_quality_of(judged: DataFrame) -> DataFrame:
    return judged.orderBy("position").select(
        "column",
        "type",
        "total_rows",
        "null_count",
        "non_null_count",
        "null_pct",
        F.round(100 - F.col("null_pct"), 2).alias("non_null_pct"),
        "unique_count",
        F.transform("found", lambda i: i["message"]).alias("issues"),
        "numeric_stats",
        F.when(
            F.col("iqr_outlier_count").isNotNull(),
            F.struct(
                "iqr_outlier_count",
                "zscore_outlier_count",
                F.round("iqr_lower", 4).alias("iqr_lower"),
                F.round("iqr_upper", 4).alias("iqr_upper"),
            ),
        ).alias("outliers"),
    )


def judge_columns(
    df: DataFrame,
    typed: list[tuple[str, str]],
    config: Config | None = None,
    as_of: dt.datetime | None = None,
    found: list[Distribution] | None = None,
    outliers: DataFrame | None = None,
    catalog: DataFrame | None = None,
    counts: DataFrame | None = None,
) -> DataFrame:
    """Measurements and issues of every analysed column, materialised (one row each).

    ``found``, ``outliers``, ``catalog`` and ``counts`` (of the labels) save the scans behind
    them where they are known; without a catalog the distinct counts stay NULL.
    """
    cfg = config or Config()
    measured = column_measurements(df, typed, cfg, as_of, found, outliers, catalog, counts)
    return pin(with_issues(measured, cfg))


def quality_issues(
    df: DataFrame,
    typed: list[tuple[str, str]],
    config: Config | None = None,
    as_of: dt.datetime | None = None,
) -> DataFrame:
    """All findings: column, severity, rule, value, message.

    ``typed`` lists (column, business type) of the columns to check, usually from
    :func:`autoprofile.operators.catalog.analysis_columns`.
    """
    return issues_of(judge_columns(df, typed, config, as_of))


def quality_overview(nulls: DataFrame, issues: DataFrame) -> DataFrame:
    """Cells, nulls, issue counts by severity and the 0-100 score of a whole table.

    ``nulls`` has one row per column of the table, ignored columns included.
    """
    cells = nulls.select("total_rows", "null_count")
    joined = cells.unionByName(issues.select("severity"), allowMissingColumns=True).agg(
        F.max("total_rows").alias("total_rows"),
        F.count("total_rows").cast("int").alias("total_columns"),
        F.sum("total_rows").alias("total_cells"),
        F.sum("null_count").alias("total_nulls"),
        F.count("severity").alias("total_issues"),
        *[F.count_if(F.col("severity") == s).alias(f"{s}s") for s in PENALTIES],
    )
    null_share = F.coalesce(
        F.try_divide(F.col("total_nulls").cast("double"), F.col("total_cells").cast("double")),
        F.lit(0.0),
    )
    score = F.lit(100.0) - null_share * NULL_PENALTY
    for severity, points in PENALTIES.items():
        score = score - F.col(f"{severity}s") * points
    return joined.select(
        "total_rows",
        "total_columns",
        "total_cells",
        "total_nulls",
        percent(F.col("total_nulls"), F.col("total_cells")).alias("overall_null_pct"),
        "total_issues",
        "warnings",
        "infos",
        "errors",
        F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), score)), 1).alias("quality_score"),
    )


def quality_score(
    df: DataFrame,
    typed: list[tuple[str, str]],
    config: Config | None = None,
    as_of: dt.datetime | None = None,
) -> DataFrame:
    return quality_overview(null_profile(nan_to_null(df)), quality_issues(df, typed, config, as_of))
