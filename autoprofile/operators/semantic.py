"""Semantic layer: what each column means, the KPIs it allows, and their values.

All of it is derived from the column catalog (one row per column) with column expressions;
only the KPI values and the dimension values read the table.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from autoprofile import messages
from autoprofile.config import Config, SemanticRules
from autoprofile.functions.coerce import WHITESPACE, nan_to_null, number_columns, quoted
from autoprofile.operators.frequencies import dimension_values
from autoprofile.operators.sums import exact_totals
from autoprofile.operators.wide import empty_frame, local_frame, pin

# Name parts that decide how a measure is aggregated.
AVERAGE_WORDS = ("rate", "ratio", "average", "avg", "score", "percent", "pct", "satisfaction",
                 "rating", "age")
COUNT_WORDS = ("count", "cnt", "num", "number", "id")

# Name parts that decide how a measure is shown.
CURRENCY_WORDS = ("price", "revenue", "cost", "amount", "sales", "profit", "income")
PERCENTAGE_WORDS = ("pct", "percent", "rate", "ratio")

# Name parts of the two measures of the ratio KPI.
REVENUE_WORDS = ("revenue", "sales", "amount")
UNIT_WORDS = ("quantity", "qty", "units")

# Description prefix per business type, and granularities of a time field.
DESCRIPTION_PREFIXES = {
    "numeric": "Numeric measure",
    "categorical": "Categorical dimension",
    "datetime": "Time field",
    "boolean": "Boolean flag",
    "identifier": "Unique identifier",
    "text": "Free-text field",
}
GRANULARITIES = ("day", "month", "quarter", "year")

#: how many names of each role the summary shows (None: all)
SUMMARY_NAMES = {"dimension": 8, "measure": 8, "time": None, "entity": 5, "kpi": 0}

FIELD_COLUMNS = [
    "ordinal", "raw_column", "semantic_name", "description", "nullable", "semantic_type",
    "aggregation", "format", "granularities", "values",
]
KPI_SCHEMA = (
    "seq int, name string, semantic_type string, formula string, description string, "
    "format string, source_measures array<string>, operation string, columns array<string>"
)


def _has_any(name: Column, words: tuple[str, ...]) -> Column:
    return name.rlike("|".join(words))


def _lowered(name: Column) -> Column:
    return F.btrim(F.lower(name), F.lit(WHITESPACE))


def canonical_name(name: Column, rules: SemanticRules) -> Column:
    """Business name of a raw column name.

    A whole-name synonym wins; else the first synonym found in the name is replaced, as a
    whole ``_``-separated token or as any substring; else the name is tidied.
    """
    lowered = _lowered(name)
    pairs: dict[str, str] = {
        synonym.lower(): canonical
        for canonical, synonyms in rules.synonyms.items()
        for synonym in synonyms
    }
    whole, partial = [], []
    for synonym, canonical in pairs.items():
        whole.append(F.when(lowered == synonym, F.lit(canonical)))
        if rules.match == "token":
            # neighbouring tokens share a "_", so every separator is doubled first
            padded = F.concat(F.lit("_"), F.replace(lowered, F.lit("_"), F.lit("__")), F.lit("_"))
            part = "_" + synonym.replace("_", "__") + "_"
            swapped = F.replace(padded, F.lit(part), F.lit(f"_{canonical}_"))
            inner = F.substring(swapped, F.lit(2), F.length(swapped) - 2)
            renamed = F.replace(inner, F.lit("__"), F.lit("_"))
            partial.append(F.when(F.contains(padded, F.lit(part)), renamed))
        else:
            renamed = F.replace(lowered, F.lit(synonym), F.lit(canonical))
            partial.append(F.when(F.contains(lowered, F.lit(synonym)), renamed))
    tidy = lowered
    if rules.standardize_names:
        tidy = F.btrim(F.regexp_replace(lowered, r"(?U)[^\w]", "_"), F.lit("_"))
    return F.coalesce(*whole, *partial, tidy)


def aggregation_of(name: Column) -> Column:
    lowered = F.lower(name)
    return (
        F.when(_has_any(lowered, AVERAGE_WORDS), "avg")
        .when(_has_any(lowered, COUNT_WORDS), "count")
        .otherwise("sum")
    )


def format_of(name: Column) -> Column:
    lowered = F.lower(name)
    return (
        F.when(_has_any(lowered, CURRENCY_WORDS), "currency")
        .when(_has_any(lowered, PERCENTAGE_WORDS), "percentage")
        .otherwise("number")
    )


def description_of(name: Column, inferred: Column) -> Column:
    prefix = F.lit("Field")
    for label, text in DESCRIPTION_PREFIXES.items():
        prefix = F.when(inferred == label, F.lit(text)).otherwise(prefix)
    return F.concat(prefix, F.lit(": "), F.initcap(F.replace(name, F.lit("_"), F.lit(" "))))


#: roles of the business types that are not dimensions
ROLE_OF_TYPE = {"datetime": "time", "identifier": "entity", "numeric": "measure"}


def role_name(inferred: str) -> str:
    return ROLE_OF_TYPE.get(inferred, "dimension")


def role_of(inferred: Column) -> Column:
    role = F.lit("dimension")
    for label, name in ROLE_OF_TYPE.items():
        role = F.when(inferred == label, name).otherwise(role)
    return role


def described_columns(catalog: DataFrame, rules: SemanticRules) -> DataFrame:
    """The catalog rows that take part in the semantic layer."""
    wanted = ~F.col("ignore")
    if rules.include_identifiers:
        wanted = wanted | (F.col("inferred_type") == "identifier")
    return catalog.where(wanted)


def semantic_fields(
    catalog: DataFrame, config: Config | None = None, values: DataFrame | None = None
) -> DataFrame:
    """One row per described column: name, role, aggregation, format, known values.

    ``values`` is (column, values) of the dimensions, see
    :func:`autoprofile.operators.frequencies.dimension_values`.
    """
    rules = (config or Config()).semantic
    name, inferred = F.col("column_name"), F.col("inferred_type")
    role = role_of(inferred)
    fields = described_columns(catalog, rules).select(
        "ordinal",
        name.alias("raw_column"),
        canonical_name(name, rules).alias("semantic_name"),
        description_of(name, inferred).alias("description"),
        (F.col("null_count") > 0).alias("nullable"),
        role.alias("semantic_type"),
        F.when(role == "measure", aggregation_of(name)).alias("aggregation"),
        F.when(role == "measure", format_of(name)).alias("format"),
        F.when(role == "time", F.array(*[F.lit(g) for g in GRANULARITIES])).alias(
            "granularities"
        ),
        inferred.isin("categorical", "boolean").alias("has_values"),
    )
    if values is None:
        empty = F.lit(None).cast("array<string>")
        return fields.withColumn("values", empty).select(*FIELD_COLUMNS).orderBy("ordinal")
    known = values.select(F.col("column").alias("raw_column"), F.col("values").alias("known"))
    listed = F.coalesce("known", F.array().cast("array<string>"))
    return (
        fields.join(F.broadcast(known), "raw_column", "left")
        .withColumn("values", F.when(F.col("has_values"), listed))
        .select(*FIELD_COLUMNS)
        .orderBy("ordinal")
    )


def value_columns(catalog: DataFrame) -> list[str]:
    """Columns whose distinct values belong into the semantic layer."""
    rows = catalog.where(
        ~F.col("ignore") & F.col("inferred_type").isin("categorical", "boolean")
    ).collect()
    return [r["column_name"] for r in sorted(rows, key=lambda r: r["ordinal"])]


def build_semantic_layer(
    df: DataFrame, catalog: DataFrame, config: Config | None = None
) -> DataFrame:
    """Semantic fields with the dimension values read from the table (one row per column)."""
    return pin(
        semantic_fields(catalog, config, dimension_values(df, value_columns(catalog)))
    )


def lineage(fields: DataFrame) -> DataFrame:
    """Raw column -> semantic name."""
    return fields.orderBy("ordinal").select("raw_column", "semantic_name")


# ------------------------------------------------------------------ KPIs


def _plain(name: Column) -> Column:
    return F.replace(name, F.lit("_"), F.lit(" "))


def _kpi(
    group: int,
    wording: tuple[str, str, str],
    named: list[Column],
    columns: list[Column],
    described: list[Column],
    fmt: Column,
    sources: Column,
    operation: str,
) -> list[Column]:
    """Columns of a KPI row; ``wording`` is the format of its name, formula, description."""

    def worded(text: str, parts: list[Column]) -> Column:
        return F.format_string(text, *parts) if parts else F.lit(text)

    return [
        F.lit(group).alias("kpi_group"),
        F.col("ordinal"),
        worded(wording[0], named).alias("name"),
        F.lit("kpi").alias("semantic_type"),
        worded(wording[1], columns).alias("formula"),
        worded(wording[2], described).alias("description"),
        fmt.alias("format"),
        sources.cast("array<string>").alias("source_measures"),
        F.lit(operation).alias("operation"),
        F.array(*columns).alias("columns"),
    ]


def _first_measure(words: tuple[str, ...]) -> Column:
    """The first measure whose semantic name holds one of ``words`` (NULL if none)."""
    place = F.when(_has_any(F.col("semantic_name"), words), F.col("ordinal"))
    return F.min_by(F.struct("raw_column", "semantic_name"), place)


def kpi_catalog(fields: DataFrame, config: Config | None = None) -> DataFrame:
    """Totals, averages, revenue per unit and record counts the fields allow."""
    rules = (config or Config()).semantic
    if not rules.auto_kpis:
        return empty_frame(fields.sparkSession, KPI_SCHEMA)
    raw, semantic = F.col("raw_column"), F.col("semantic_name")
    plain = _plain(raw)
    measures = fields.where(F.col("semantic_type") == "measure")
    dimensions = fields.where(F.col("semantic_type") == "dimension")

    def of_measure(group: int, wording: tuple[str, str, str], operation: str) -> list[Column]:
        shown = F.col("format")
        return _kpi(
            group, wording, [semantic], [raw], [plain], shown, F.array(semantic), operation
        )

    totals = measures.where(F.col("aggregation") == "sum").select(
        *of_measure(1, messages.TOTAL_KPI, "sum")
    )
    averages = measures.where(
        (F.col("aggregation") == "avg") & (F.col("format") != "currency")
    ).select(*of_measure(2, messages.AVERAGE_KPI, "avg"))
    ratio = (
        measures.agg(
            _first_measure(REVENUE_WORDS).alias("revenue"),
            _first_measure(UNIT_WORDS).alias("units"),
        )
        .where(F.col("revenue").isNotNull() & F.col("units").isNotNull())
        .withColumn("ordinal", F.lit(0))
        .select(
            *_kpi(
                3, messages.RATIO_KPI, [],
                [F.col("revenue.raw_column"), F.col("units.raw_column")], [],
                F.lit("currency"),
                F.array("revenue.semantic_name", "units.semantic_name"), "ratio",
            )
        )
    )
    counts = dimensions.orderBy("ordinal").limit(rules.count_kpis).select(
        *_kpi(
            4, messages.COUNT_KPI, [semantic], [raw], [plain], F.lit("number"), F.array(),
            "count_by",
        )
    )
    everything = reduce(DataFrame.unionByName, [totals, averages, ratio, counts])
    order = Window.orderBy("kpi_group", "ordinal")  # one row per KPI, not per table row
    return (
        everything.withColumn("seq", F.row_number().over(order))
        .orderBy("seq")
        .select(*[part.split()[0] for part in KPI_SCHEMA.split(", ")])
    )


def _from_sums(row, sums: Mapping[str, tuple[float | None, int]]) -> float | None:
    """A scalar KPI from the sums and counts of its columns."""
    total, count = sums[row["columns"][0]]
    if total is None or row["operation"] == "sum":
        return total
    below = count if row["operation"] == "avg" else sums[row["columns"][1]][0]
    return total / below if below else None


def evaluate_kpis(
    df: DataFrame,
    kpis: DataFrame,
    digits: int = 4,
    sums: Mapping[str, tuple[float | None, int]] | None = None,
) -> DataFrame:
    """(name, segment, value) of every KPI; scalar KPIs have a NULL segment.

    All scalar KPIs are one aggregation over the table, or none where ``sums`` already has the
    sum and count of every measure; each record count is one grouped count, formed per task
    before its shuffle.
    """
    rows = sorted(kpis.collect(), key=lambda r: r["seq"])
    scalars = [r for r in rows if r["operation"] != "count_by"]
    sums = dict(sums or {})
    missing = sorted({c for r in scalars for c in r["columns"]} - set(sums))
    if missing:
        sums |= dict.fromkeys(missing, (None, 0))
        for t in exact_totals(df, number_columns(df, missing)).collect():
            sums[t["column"]] = (t["total"], t["count"])
    parts = []
    if scalars:
        found = [(r["name"], None, _from_sums(r, sums)) for r in scalars]
        frame = local_frame(df.sparkSession, found, "name string, segment string, value double")
        parts.append(frame.withColumn("value", F.round("value", digits)))
    for r in rows:
        if r["operation"] == "count_by":
            parts.append(count_by(df, r["columns"][0], r["name"]))
    if not parts:
        return empty_frame(df.sparkSession, "name string, segment string, value double")
    return reduce(DataFrame.unionByName, parts)


def count_by(df: DataFrame, column: str, name: str, null_label: str = "nan") -> DataFrame:
    """Record count per value of a dimension."""
    segment = F.coalesce(quoted(column).cast("string"), F.lit(null_label))
    return (
        nan_to_null(df)
        .groupBy(segment.alias("segment"))
        .agg(F.count(F.lit(1)).cast("double").alias("value"))
        .select(F.lit(name).alias("name"), "segment", "value")
    )


# ------------------------------------------------------------------ summary and document


def semantic_summary(fields: DataFrame, kpis: DataFrame) -> DataFrame:
    """Fields per role with the first few names."""
    spark = fields.sparkSession
    roles = local_frame(
        spark,
        [(i, role, limit) for i, (role, limit) in enumerate(SUMMARY_NAMES.items())],
        "position int, semantic_type string, shown int",
    )
    members = fields.select("semantic_type", "ordinal", F.col("semantic_name").alias("name"))
    members = members.unionByName(
        kpis.select("semantic_type", F.col("seq").alias("ordinal"), "name")
    )
    listed = members.groupBy("semantic_type").agg(
        F.count(F.lit(1)).alias("fields"),
        F.array_sort(F.collect_list(F.struct("ordinal", "name"))).alias("members"),
    )
    names = F.transform("members", lambda m: m["name"])
    count = F.coalesce("fields", F.lit(0))
    return (
        roles.join(F.broadcast(listed), "semantic_type", "left")
        .orderBy("position")
        .select(
            "semantic_type",
            count.alias("fields"),
            F.coalesce(
                F.slice(names, F.lit(1), F.coalesce("shown", count).cast("int")),
                F.array().cast("array<string>"),
            ).alias("first_names"),
        )
    )


def semantic_document(fields: DataFrame, kpis: DataFrame) -> DataFrame:
    """The whole layer as one JSON document (one row per column goes into it)."""
    sections: Mapping[str, tuple[str, list[str]]] = {
        "dimensions": ("dimension", ["raw_column", "semantic_name", "description", "nullable",
                                     "semantic_type", "values"]),
        "measures": ("measure", ["raw_column", "semantic_name", "description", "nullable",
                                 "semantic_type", "aggregation", "format"]),
        "time_fields": ("time", ["raw_column", "semantic_name", "description", "nullable",
                                 "semantic_type", "granularities"]),
        "entities": ("entity", ["raw_column", "semantic_name", "description", "nullable",
                                "semantic_type"]),
    }

    kpi_names = ["name", "semantic_type", "formula", "description", "format", "source_measures"]
    both = fields.unionByName(
        kpis.withColumn("ordinal", F.col("seq")).drop("operation", "columns", "seq"),
        allowMissingColumns=True,
    )

    def listed(role: str, names: list[str], alias: str) -> Column:
        entry = F.struct(F.col("ordinal").alias("position"), F.struct(*names).alias("entry"))
        members = F.collect_list(F.when(F.col("semantic_type") == role, entry))
        return F.transform(F.array_sort(members), lambda e: e["entry"]).alias(alias)

    joined = both.agg(
        *[listed(role, names, alias) for alias, (role, names) in sections.items()],
        listed("kpi", kpi_names, "kpis"),
    )
    body = F.struct(F.lit("1.0").alias("version"), *[F.col(a) for a in (*sections, "kpis")])
    document = F.to_json(F.struct(body.alias("semantic_layer")))
    return joined.select(document.alias("document"))
