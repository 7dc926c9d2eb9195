"""Business type of every column and the data dictionary (one row per column)."""

from __future__ import annotations

from collections.abc import Collection
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from autoprofile import messages
from autoprofile.config import Config, SchemaRules
from autoprofile.functions.coerce import (
    family,
    maybe_date,
    nan_to_null,
    quoted,
    strip,
    text_number,
    value_kind,
)
from autoprofile.functions.keys import head, is_digest, text_key
from autoprofile.functions.numeric import percent
from autoprofile.operators.dates import layout_counts
from autoprofile.operators.digests import texts_behind
from autoprofile.operators.wide import empty_frame, local_frame, per_column

IGNORED_TYPES = ("empty", "constant", "identifier", "nested")
SAMPLE_SIZE = 5
SKETCH_LOG_SIZE = 14
#: a sketch this close to a threshold (as a share of it) does not decide a type; it is four
#: times the sketch's standard error
SKETCH_DOUBT = 0.033
#: texts that begin alike at the edge of the samples: more are found by smallest_values
SAMPLE_TIES = 64

#: categorical needs at most, identifier needs more than this many distinct numbers
MAX_CATEGORY_NUMBERS = 30
MIN_IDENTIFIER_NUMBERS = 50
#: a text identifier needs more rows than this
MIN_IDENTIFIER_ROWS = 100

FACTS_SCHEMA = (
    "ordinal int, column_name string, family string, fractional boolean, total_rows long, "
    "non_null_count long, beyond_01 long, not_truth_word long, date_count long, "
    "number_count long, estimated_count long"
)
DISTINCT_SCHEMA = "ordinal int, unique_count long, sample_values array<string>"
CATALOG_FIELDS = [
    "column_name", "ordinal", "inferred_type", "total_rows", "null_count", "non_null_count",
    "null_pct", "non_null_pct", "unique_count", "unique_is_estimate", "unique_ratio",
    "sample_values", "anomalies",
    "ignore", "ignore_reason",
]


def truth_word(text: Column, words: tuple[str, ...]) -> Column:
    """Is the stripped, lower-cased text one of ``words``?  Long texts are never lowered."""
    stripped = strip(text)
    longest = max(len(w.encode()) for w in words)
    return (F.octet_length(stripped) <= longest) & F.lower(stripped).isin(*words)


# ------------------------------------------------------------------ column facts


def _truth_words(rules: SchemaRules) -> tuple[str, ...]:
    return tuple(w.strip().lower() for w in (*rules.true_words, *rules.false_words))


def _sketched(column: Column) -> Column:
    """Aggregate: the number of distinct values, estimated within one percent."""
    sketch = F.hll_sketch_agg(F.xxhash64(column), F.lit(SKETCH_LOG_SIZE))
    # the hash of NULL is a value like any other, so it is taken off again
    nulls = F.least(F.count(F.lit(1)) - F.count(column), F.lit(1))
    return F.greatest(F.hll_sketch_estimate(sketch) - nulls, F.lit(0))


def column_facts(df: DataFrame, rules: SchemaRules, sketch: bool = False) -> DataFrame:
    """Everything the type decision needs but exact distinct counts, in one scan.

    With ``sketch`` also estimated distinct counts.
    """
    words = _truth_words(rules)
    nothing = F.lit(None).cast("long")
    facts = []
    # what several tests look at is computed once per value, below the aggregation
    prepared = df.select(
        *[quoted(f.name).alias(f"v{i}") for i, f in enumerate(df.schema)],
        *[
            maybe_date(quoted(f.name)).alias(f"d{i}")
            for i, f in enumerate(df.schema)
            if family(f.dataType) == "string"
        ],
    )
    for ordinal, field in enumerate(df.schema):
        column, kind = F.col(f"v{ordinal}"), family(field.dataType)
        beyond_01 = not_word = dates = numbers = estimate = nothing
        if kind == "number":
            beyond_01 = F.count_if(~column.isin(0, 1))
        elif kind == "string":
            not_word = F.count_if(~truth_word(column, words))
            dates = F.array_max(layout_counts(F.col(f"d{ordinal}")))
            numbers = F.count(text_number(column))
        if sketch and value_kind(field.dataType) is not None:
            estimate = _sketched(column)
        facts.append([
            F.lit(ordinal).alias("ordinal"),
            F.lit(field.name).alias("column_name"),
            F.lit(kind).alias("family"),
            F.lit(isinstance(field.dataType, (T.FractionalType,))).alias("fractional"),
            F.count(F.lit(1)).alias("total_rows"),
            F.count(column).alias("non_null_count"),
            beyond_01.alias("beyond_01"),
            not_word.alias("not_truth_word"),
            dates.alias("date_count"),
            numbers.alias("number_count"),
            estimate.alias("estimated_count"),
        ])
    return per_column(prepared, facts, fields_per_column=8, schema=FACTS_SCHEMA)


# ------------------------------------------------------------------ distinct values


def distinct_values(df: DataFrame, names: Collection[str] | None = None) -> list[DataFrame]:
    """(ordinal, value, count) of every distinct non-null value, one frame per kind of value.

    Each kind is one unpivot and one shuffle for all its columns together.  The map side
    already drops repeated values, so a value that fills a third of the table sends one row
    per task.  Numbers stay eight bytes wide and long texts travel as digests.
    """
    groups: dict[str, list[tuple[int, Column]]] = {}
    for ordinal, field in enumerate(df.schema):
        kind = value_kind(field.dataType)
        if kind is None or (names is not None and field.name not in names):
            continue
        column = quoted(field.name)
        is_text = family(field.dataType) == "string"
        value = text_key(column) if is_text else column.cast(kind)
        groups.setdefault(kind, []).append((ordinal, value))
    frames = []
    for members in groups.values():
        narrow = df.select(*[value.alias(str(ordinal)) for ordinal, value in members])
        frames.append(
            narrow.unpivot([], [quoted(str(o)) for o, _ in members], "ordinal", "value")
            .where(F.col("value").isNotNull())
            .groupBy(F.col("ordinal").cast("int").alias("ordinal"), "value")
            .agg(F.count(F.lit(1)).alias("count"))
        )
    return frames


def _count_and_sample(frame: DataFrame) -> DataFrame:
    """Distinct count and the smallest values per column; both read the same shuffle.

    Texts are ordered by how they begin, and all that tie at the fifth are taken.
    """
    counts = frame.groupBy("ordinal").agg(F.count(F.lit(1)).alias("unique_count"))
    text = dict(frame.dtypes)["value"] == "string"
    order = Window.partitionBy("ordinal").orderBy(head(F.col("value")) if text else "value")
    smallest = (
        frame.withColumn("place", F.rank().over(order))
        .where(F.col("place") <= SAMPLE_SIZE)
        .withColumn("number", F.row_number().over(order))
        .where(F.col("number") <= SAMPLE_TIES)
        .groupBy("ordinal")
        .agg(F.array_sort(F.collect_list(F.struct("place", "value"))).alias("smallest"))
    )
    return counts.join(smallest, "ordinal").select(
        *counts.columns,
        F.transform("smallest", lambda s: s["value"].cast("string")).alias("sample_values"),
    )


def distinct_profile(df: DataFrame, names: Collection[str] | None = None) -> DataFrame:
    """Exact distinct count and the five smallest distinct values of every column.

    Texts are sampled by key, with those that begin like the fifth; which of these are smallest
    the texts behind them decide when the dictionary is built.
    """
    frames = distinct_values(df, names)
    if not frames:
        return empty_frame(df.sparkSession, DISTINCT_SCHEMA)
    return reduce(DataFrame.unionByName, [_count_and_sample(f) for f in frames])


def estimated_distinct(df: DataFrame) -> DataFrame:
    """Distinct counts from sketches, within about one percent; no shuffle of values."""
    facts = [
        [F.lit(ordinal).alias("ordinal"), _sketched(quoted(field.name)).alias("estimated_count")]
        for ordinal, field in enumerate(df.schema)
        if value_kind(field.dataType) is not None
    ]
    schema = "ordinal int, estimated_count long"
    return per_column(df, facts, fields_per_column=4, schema=schema)


def smallest_values(df: DataFrame, names: list[str], size: int = SAMPLE_SIZE) -> dict[str, list]:
    """The ``size`` smallest distinct values of columns, as text, without any shuffle of values.

    Every round is one scan for the smallest value above the last one, for all columns at once.
    """
    found: dict[str, list[str]] = {n: [] for n in names}
    last: dict[str, object] = {}
    left = list(names)
    for _ in range(size):
        if not left:
            break
        least = []
        for i, name in enumerate(left):
            column = quoted(name)
            if name in last:
                column = F.when(column > F.lit(last[name]), column)
            least.append(F.min(column).alias(f"v{i}"))
        row = df.agg(*least).select(
            *[F.col(f"v{i}") for i in range(len(left))],
            *[F.col(f"v{i}").cast("string").alias(f"s{i}") for i in range(len(left))],
        ).first()
        for i, name in enumerate(list(left)):
            if row[f"v{i}"] is None:
                left.remove(name)
            else:
                last[name] = row[f"v{i}"]
                found[name].append(row[f"s{i}"])
    return found


def _sampled_texts(df: DataFrame, name: str, keys: list[str]) -> list[str]:
    """The smallest texts of a column from the keys of the candidates."""
    if len(keys) >= SAMPLE_TIES:
        return smallest_values(df, [name])[name]
    digests = [k for k in keys if is_digest(k)]
    texts = texts_behind(df, name, digests) if digests else {}
    return sorted((texts.get(k, k) for k in keys), key=str.encode)[:SAMPLE_SIZE]


def _columns_in_doubt(rows: list[dict], rules: SchemaRules) -> list[str]:
    """Columns whose sketch is too close to a threshold to decide the type."""
    doubtful = []
    for row in rows:
        estimate, present = row["estimated_count"], row["non_null_count"]
        if not estimate or not present:
            continue
        ratio = estimate / present
        near_ratio = any(
            abs(ratio - limit) <= SKETCH_DOUBT * limit
            for limit in (rules.categorical_max_ratio, rules.identifier_min_ratio)
        )
        if near_ratio or estimate <= 2 * MIN_IDENTIFIER_NUMBERS:
            doubtful.append(row["column_name"])
    return doubtful


# ------------------------------------------------------------------ dictionary


def _measured(df: DataFrame, rules: SchemaRules, exact: bool, samples: bool) -> DataFrame:
    """Facts and distinct counts, one local row per column.

    One scan for the facts; distinct values are shuffled for all columns if ``exact``, else only
    for those a sketch cannot decide.  Columns that are not counted are sampled by scans.
    """
    rows = [r.asDict() for r in column_facts(df, rules, sketch=not exact).collect()]
    counted = None if exact else set(_columns_in_doubt(rows, rules))
    profile = {}
    if counted is None or counted:
        profile = {r["ordinal"]: r.asDict() for r in distinct_profile(df, counted).collect()}
    kinds = {f.name: value_kind(f.dataType) for f in df.schema}
    scanned = {}
    if samples and not exact:
        scanned = smallest_values(df, [
            r["column_name"] for r in rows
            if r["ordinal"] not in profile and kinds[r["column_name"]]
        ])
    for row in rows:
        name, found = row["column_name"], profile.get(row["ordinal"])
        row["unique_is_estimate"] = found is None and not exact and kinds[name] is not None
        row["unique_count"] = found["unique_count"] if found else row["estimated_count"]
        row["sample_values"] = found["sample_values"] if found else scanned.get(name)
        if samples and found and row["family"] == "string":
            row["sample_values"] = _sampled_texts(df, name, found["sample_values"])
    schema = (
        FACTS_SCHEMA + ", unique_count long, unique_is_estimate boolean, "
        "sample_values array<string>"
    )
    names = T.StructType.fromDDL(schema).names
    rows.sort(key=lambda r: r["ordinal"])
    return local_frame(df.sparkSession, [tuple(r[n] for n in names) for r in rows], schema)


def _inferred_type(rules: SchemaRules) -> Column:
    """The decision tree; the first branch that holds names the type."""
    kind, unique, present = F.col("family"), F.col("unique_count"), F.col("non_null_count")
    ratio = F.try_divide(unique.cast("double"), present.cast("double"))
    mostly_unique = ratio >= rules.identifier_min_ratio
    few_repeated = ratio <= rules.categorical_max_ratio
    number_type = (
        F.when(
            mostly_unique
            & (unique > MIN_IDENTIFIER_NUMBERS)
            & (~F.col("fractional") | F.lit(rules.float_identifiers)),
            "identifier",
        )
        .when((unique <= 2) & (F.col("beyond_01") == 0), "boolean")
        .when(few_repeated & (unique <= MAX_CATEGORY_NUMBERS), "categorical")
        .otherwise("numeric")
    )
    date_share = F.try_divide(F.col("date_count").cast("double"), present.cast("double"))
    number_share = F.try_divide(F.col("number_count").cast("double"), present.cast("double"))
    return (
        F.when(present == 0, "empty")
        .when(kind == "nested", "nested")
        .when(unique <= 1, "constant")
        .when(kind == "boolean", "boolean")
        .when(kind == "number", number_type)
        .when(kind == "datetime", "datetime")
        .when(F.col("not_truth_word") == 0, "boolean")
        .when(date_share >= rules.datetime_share, "datetime")
        .when(number_share >= rules.numeric_share, number_type)
        .when(mostly_unique & (present > MIN_IDENTIFIER_ROWS), "identifier")
        .when(few_repeated, "categorical")
        .otherwise("text")
    )


def _anomalies(rules: SchemaRules) -> Column:
    """Notes on texts that are nearly dates, or are numbers."""
    present = F.col("non_null_count").cast("double")
    date_share = F.try_divide(F.col("date_count").cast("double"), present)
    number_share = F.try_divide(F.col("number_count").cast("double"), present)
    reached = (
        (F.col("family") == "string") & (F.col("unique_count") > 1) & (F.col("not_truth_word") > 0)
    )
    noisy_dates = F.when(
        reached & (date_share > 0) & (date_share < rules.datetime_share),
        F.format_string(
            messages.NOISY_DATES, F.round(date_share * 100).cast("int").cast("string")
        ),
    )
    text_numbers = F.when(
        reached & (date_share < rules.datetime_share) & (number_share >= rules.numeric_share),
        F.lit(messages.TEXT_NUMBERS),
    )
    return F.array_compact(F.array(noisy_dates, text_numbers))


def column_catalog(df: DataFrame, config: Config | None = None) -> DataFrame:
    """Data dictionary: one row per column with its business type, counts and samples.

    Runs when called: a scan for the facts and a shuffle for the distinct values.  What comes
    back to the driver is one row per column, in table order.  With ``distinct="approx"``
    distinct counts far from any threshold are estimates (``unique_is_estimate``).
    """
    rules = (config or Config()).schema
    return _catalog(df, rules, exact=rules.distinct == "exact", samples=True)


def _catalog(df: DataFrame, rules: SchemaRules, exact: bool, samples: bool) -> DataFrame:
    clean = nan_to_null(df)
    total, present = F.col("total_rows"), F.col("non_null_count")
    inferred = _inferred_type(rules)
    for name, label in rules.type_overrides.items():
        inferred = F.when(F.col("column_name") == name, F.lit(label)).otherwise(inferred)
    unique = F.coalesce(F.col("unique_count"), F.lit(0))
    ratio = F.coalesce(
        F.try_divide(unique.cast("double"), present.cast("double")), F.lit(0.0)
    )
    null_pct = percent(total - present, total)
    catalog = _measured(clean, rules, exact, samples).select(
        "column_name",
        "ordinal",
        inferred.alias("inferred_type"),
        "total_rows",
        (total - present).alias("null_count"),
        "non_null_count",
        null_pct.alias("null_pct"),
        F.round(100 - null_pct, 2).alias("non_null_pct"),
        unique.alias("unique_count"),
        F.coalesce("unique_is_estimate", F.lit(False)).alias("unique_is_estimate"),
        F.round(ratio, 4).alias("unique_ratio"),
        F.coalesce("sample_values", F.array().cast("array<string>")).alias("sample_values"),
        _anomalies(rules).alias("anomalies"),
        F.col("family"),
        ratio.alias("full_ratio"),
    )
    label = F.col("inferred_type")
    only_value = F.coalesce(F.get("sample_values", F.lit(0)), F.lit("N/A"))
    reason = (
        F.when(label == "empty", messages.EMPTY_COLUMN)
        .when(label == "constant", F.format_string(messages.CONSTANT_COLUMN, only_value))
        .when(
            label == "identifier",
            F.format_string(messages.IDENTIFIER_COLUMN, F.col("full_ratio") * 100),
        )
        .when(label == "nested", messages.NESTED_COLUMN)
        .otherwise("")
    )
    return (
        catalog.withColumn("ignore", label.isin(*IGNORED_TYPES))
        .withColumn("ignore_reason", reason)
        .select(*CATALOG_FIELDS)
    )


def infer_types(df: DataFrame, config: Config | None = None) -> DataFrame:
    """column_name -> inferred_type.

    Sketches decide all columns that are far from a threshold, whatever ``distinct`` says; the
    types are those of the exact counts.
    """
    rules = (config or Config()).schema
    return _catalog(df, rules, exact=False, samples=False).select("column_name", "inferred_type")


def type_distribution(catalog: DataFrame) -> DataFrame:
    """How many columns carry each business type."""
    return (
        catalog.groupBy("inferred_type")
        .agg(F.count(F.lit(1)).alias("columns"))
        .orderBy(F.desc("columns"), "inferred_type")
    )


def analysis_columns(catalog: DataFrame) -> list[tuple[str, str]]:
    """(column, type) of the columns that are not ignored, in table order."""
    rows = sorted(catalog.where(~F.col("ignore")).collect(), key=lambda r: r["ordinal"])
    return [(r["column_name"], r["inferred_type"]) for r in rows]


def select_analysis_columns(df: DataFrame, catalog: DataFrame) -> DataFrame:
    """The table without its ignored columns."""
    return df.select(*[quoted(name) for name, _ in analysis_columns(catalog)])
