"""Null shares, distributions, outliers, frequencies, duplicates, time spans."""

from pyspark.sql import functions as F

from autoprofile.config import Config, QualityRules
from autoprofile.operators.catalog import column_catalog
from autoprofile.operators.frequencies import (
    category_share,
    dimension_values,
    frequent_values,
    label_variants,
    top_texts,
    top_value,
    top_values,
)
from autoprofile.operators.numbers import (
    detect_outliers,
    distribution_moments,
    numeric_summary,
)
from autoprofile.operators.tables import (
    complete_rows,
    dataset_summary,
    datetime_summary,
    duplicate_rows,
    null_profile,
)
from driver_queries.inputs import (
    COPIED_EVENTS_SQL,
    GAPPY_LINES_SQL,
    TEXT_ORDERS_SQL,
    copied_events,
    gappy_lines,
    text_orders,
)
from driver_queries.registry import COLUMNS, pct, query, r, sql_number, stripped, table, types_sql


def quartile(column, share):
    return f"quantile_cont({column}, {share})"


def population_skewness(column):
    n = f"count({column})"
    return f"skewness({column}) * ({n} - 2) / sqrt({n} * ({n} - 1.0))"


def summary_sql(source, columns, digits=4):
    parts = [
        f"""SELECT '{name}' AS "column", count({c}) AS count, {r(f'avg({c})', digits)} AS mean,
        {r(f'median({c})', digits)} AS median, {r(f'stddev_samp({c})', digits)} AS std,
        {r(f'min({c})', digits)} AS min, {r(f'max({c})', digits)} AS max,
        {r(quartile(c, 0.25), digits)} AS q1, {r(quartile(c, 0.75), digits)} AS q3,
        {r(f'sum({c})', digits)} AS sum, {r(population_skewness(c), digits)} AS skewness
        FROM {source}"""
        for name, c in columns
    ]
    return "\nUNION ALL ".join(parts)


def as_double(*names):
    return [(n, f"cast({n} AS DOUBLE)") for n in names]


@query("numeric_summary", summary_sql("events", as_double("user_id", "value")))
def summary_of_events(spark, sf_dir):
    return numeric_summary(table(spark, sf_dir, "events"), ["user_id", "value"])


@query("numeric_summary_parts", summary_sql("part", as_double("p_retailprice", "p_size")))
def summary_of_parts(spark, sf_dir):
    return numeric_summary(table(spark, sf_dir, "part"), ["p_retailprice", "p_size"])


@query(
    "numeric_summary_lines",
    summary_sql("lineitem", as_double("l_quantity", "l_extendedprice", "l_discount"), 2),
)
def summary_of_lines(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    return numeric_summary(lines, ["l_quantity", "l_extendedprice", "l_discount"], digits=2)


@query(
    "numeric_summary_gaps",
    summary_sql(GAPPY_LINES_SQL + " AS t", as_double("quantity", "tax", "weight"), 2),
)
def summary_with_gaps(spark, sf_dir):
    return numeric_summary(gappy_lines(spark, sf_dir), ["quantity", "tax", "weight"], digits=2)


@query(
    "numeric_summary_text",
    summary_sql(TEXT_ORDERS_SQL + " AS t", [("price", f"({sql_number('price')})")], 3),
)
def summary_of_texts(spark, sf_dir):
    return numeric_summary(text_orders(spark, sf_dir), ["price"], digits=3)


def moments_sql(source, columns):
    parts = [
        f"""SELECT '{name}' AS "column", {r(f'avg({c})')} AS mean, {r(f'median({c})')} AS median,
        {r(f'stddev_samp({c})')} AS std, {r(f'min({c})')} AS min, {r(f'max({c})')} AS max,
        {r(quartile(c, 0.25))} AS q1, {r(quartile(c, 0.75))} AS q3,
        {r(population_skewness(c))} AS skewness, {r(f'kurtosis_pop({c})')} AS kurtosis
        FROM {source}"""
        for name, c in columns
    ]
    return "\nUNION ALL ".join(parts)


@query("distribution_moments", moments_sql("events", as_double("value", "user_id")))
def moments_of_events(spark, sf_dir):
    return distribution_moments(table(spark, sf_dir, "events"), ["value", "user_id"])


@query("distribution_moments_documents", moments_sql("documents", as_double("n_chars")))
def moments_of_documents(spark, sf_dir):
    return distribution_moments(table(spark, sf_dir, "documents"), ["n_chars"])


def outliers_sql(source, columns, factor=1.5, limit=3.0):
    parts = []
    for name, c in columns:
        parts.append(f"""
SELECT '{name}' AS "column", count(*) FILTER (v < lo OR v > hi) AS iqr_outlier_count,
  count(*) FILTER (abs((v - m) / nullif(s, 0)) > {limit}) AS zscore_outlier_count,
  {r('min(lo)')} AS iqr_lower, {r('min(hi)')} AS iqr_upper
FROM (SELECT {c} AS v FROM {source}) AS x, (
  SELECT q1 - {factor} * (q3 - q1) AS lo, q3 + {factor} * (q3 - q1) AS hi, m, s FROM (
    SELECT {quartile(c, 0.25)} AS q1, {quartile(c, 0.75)} AS q3, avg({c}) AS m,
      stddev_pop({c}) AS s FROM {source}) AS q) AS f""")
    return "\nUNION ALL ".join(parts)


@query("outliers", outliers_sql("events", as_double("value", "user_id")))
def outliers_of_events(spark, sf_dir):
    return detect_outliers(table(spark, sf_dir, "events"), ["value", "user_id"])


@query("outliers_documents", outliers_sql("documents", as_double("n_chars")))
def outliers_of_documents(spark, sf_dir):
    return detect_outliers(table(spark, sf_dir, "documents"), ["n_chars"])


@query("outliers_strict", outliers_sql("events", as_double("value"), 0.5, 1.5))
def outliers_strict(spark, sf_dir):
    rules = QualityRules(iqr_factor=0.5, zscore_limit=1.5)
    return detect_outliers(table(spark, sf_dir, "events"), ["value"], Config(quality=rules))


def nulls_sql(source, names):
    parts = [
        f"""SELECT '{n}' AS "column", count(*) AS total_rows, count(*) - count({n}) AS null_count,
        count({n}) AS non_null_count, {pct(f'count(*) - count({n})', 'count(*)')} AS null_pct
        FROM {source}"""
        for n in names
    ]
    return "\nUNION ALL ".join(parts)


@query("column_null_profile", nulls_sql("orders", [c for c, _ in COLUMNS["orders"]]))
def nulls_of_orders(spark, sf_dir):
    return null_profile(table(spark, sf_dir, "orders"))


@query(
    "column_null_profile_gaps",
    nulls_sql(GAPPY_LINES_SQL + " AS t", ["quantity", "tax", "returnflag", "linestatus"]),
)
def nulls_with_gaps(spark, sf_dir):
    # the gaps of numbers arrive as NaN here, which counts as missing
    lines = gappy_lines(spark, sf_dir).withColumn(
        "quantity", F.coalesce("quantity", F.lit(float("nan")))
    )
    return null_profile(lines, ["quantity", "tax", "returnflag", "linestatus"])


def summary_row_sql(source, columns):
    names = ", ".join(c for c, _ in columns)
    whole = " AND ".join(f"{c} IS NOT NULL" for c, _ in columns)
    return f"""
SELECT count(*) AS rows, {len(columns)} AS columns,
  (SELECT cast(count(*) AS INTEGER) FROM ({types_sql(source, columns)}) AS c WHERE NOT ignore)
    AS analysis_columns,
  count(*) FILTER ({whole}) AS complete_rows,
  {pct(f'count(*) FILTER ({whole})', 'count(*)')} AS complete_row_pct,
  count(*) - (SELECT count(*) FROM (SELECT DISTINCT {names} FROM {source}) AS d)
    AS duplicate_rows
FROM {source}"""


@query("dataset_summary", summary_row_sql("events", COLUMNS["events"]))
def dataset_of_events(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return dataset_summary(events, column_catalog(events))


GAPPY_PART = [
    ("l_linenumber", "number"), ("quantity", "double"), ("tax", "double"),
    ("returnflag", "string"), ("linestatus", "string"),
]


@query("dataset_summary_gaps", summary_row_sql(GAPPY_LINES_SQL + " AS t", GAPPY_PART))
def dataset_with_gaps(spark, sf_dir):
    lines = gappy_lines(spark, sf_dir).select(*[c for c, _ in GAPPY_PART])
    return dataset_summary(lines, column_catalog(lines))


@query(
    "complete_rows",
    f"""SELECT count(*) AS rows, count(*) FILTER (quantity IS NOT NULL AND tax IS NOT NULL)
        AS complete_rows FROM {GAPPY_LINES_SQL} AS t""",
)
def complete(spark, sf_dir):
    return complete_rows(gappy_lines(spark, sf_dir), ["quantity", "tax"])


def duplicates_sql(source, names):
    return f"""SELECT count(*) AS rows,
      (SELECT count(*) FROM (SELECT DISTINCT {names} FROM {source}) AS d) AS distinct_rows,
      count(*) - (SELECT count(*) FROM (SELECT DISTINCT {names} FROM {source}) AS d)
        AS duplicate_rows FROM {source}"""


@query("duplicate_rows", duplicates_sql(COPIED_EVENTS_SQL + " AS t", "event_type, value, props"))
def duplicates(spark, sf_dir):
    return duplicate_rows(copied_events(spark, sf_dir))


@query(
    "duplicate_rows_nulls",
    duplicates_sql(GAPPY_LINES_SQL + " AS t", "quantity, tax, returnflag, linestatus"),
)
def duplicates_with_nulls(spark, sf_dir):
    lines = gappy_lines(spark, sf_dir)
    return duplicate_rows(lines.select("quantity", "tax", "returnflag", "linestatus"))


@query("duplicate_texts", duplicates_sql("documents", "text, lang"))
def duplicate_texts(spark, sf_dir):
    return duplicate_rows(table(spark, sf_dir, "documents").select("text", "lang"))


@query("duplicate_vectors", duplicates_sql("embeddings", "embedding"))
def duplicate_vectors(spark, sf_dir):
    return duplicate_rows(table(spark, sf_dir, "embeddings").select("embedding"))


# ------------------------------------------------------------------ frequencies


def counts_sql(source, names):
    parts = [
        f"""SELECT '{n}' AS "column", cast({n} AS VARCHAR) AS value, count(*) AS count
        FROM {source} WHERE {n} IS NOT NULL GROUP BY {n}"""
        for n in names
    ]
    return "\nUNION ALL ".join(parts)


def top_sql(source, names, top_n=15):
    return f"""
SELECT "column", cast(rank AS INTEGER) AS rank, value, count, {pct('count', 'total')} AS pct
FROM (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY count DESC, value) AS rank,
        sum(count) OVER (PARTITION BY "column") AS total
      FROM ({counts_sql(source, names)}) AS counted) AS ranked
WHERE rank <= {top_n}"""


@query("top_values", top_sql("part", ["p_name", "p_brand", "p_type"]))
def top_of_parts(spark, sf_dir):
    return top_values(table(spark, sf_dir, "part"), ["p_name", "p_brand", "p_type"])


FLAGS_SQL = """(SELECT quality = 1 AS good, CASE WHEN toxic = 1 THEN doc_id % 2 = 0 END AS even
  FROM labels) AS t"""


@query("top_values_booleans", top_sql(FLAGS_SQL, ["good", "even"]))
def top_of_flags(spark, sf_dir):
    flags = table(spark, sf_dir, "labels").select(
        (F.col("quality") == 1).alias("good"),
        F.when(F.col("toxic") == 1, F.col("doc_id") % 2 == 0).alias("even"),
    )
    return top_values(flags, ["good", "even"])


@query("top_values_gaps", top_sql(GAPPY_LINES_SQL + " AS t", ["returnflag", "tax"], 4))
def top_with_gaps(spark, sf_dir):
    return top_values(gappy_lines(spark, sf_dir), ["returnflag", "tax"], 4)


@query(
    "top_value",
    f"""SELECT "column", value AS top_value, pct AS top_value_pct
        FROM ({top_sql('documents', ['lang', 'source'])}) AS t WHERE rank = 1""",
)
def first_values(spark, sf_dir):
    names = ["lang", "source"]
    return top_value(top_values(table(spark, sf_dir, "documents"), names), names)


@query(
    "category_share",
    f"""SELECT "column", rank, value, count,
        {pct('count', 'sum(count) OVER (PARTITION BY "column")')} AS shown_pct
        FROM ({top_sql('part', ['p_name', 'p_brand'])}) AS t""",
)
def shares_shown(spark, sf_dir):
    return category_share(top_values(table(spark, sf_dir, "part"), ["p_name", "p_brand"]))


def variants_sql(source, names):
    parts = [
        f"""SELECT '{n}' AS "column", count(DISTINCT {n}) AS raw_labels,
        count(DISTINCT lower({stripped(n)})) AS distinct_labels,
        count(DISTINCT {n}) - count(DISTINCT lower({stripped(n)})) AS variants FROM {source}"""
        for n in names
    ]
    return "\nUNION ALL ".join(parts)


@query("label_variants", variants_sql(TEXT_ORDERS_SQL + " AS t", ["priority", "finished", "note"]))
def variants(spark, sf_dir):
    return label_variants(text_orders(spark, sf_dir), ["priority", "finished", "note"])


@query(
    "dimension_values",
    "\nUNION ALL ".join(
        f"""SELECT '{n}' AS "column", string_agg(v, '|' ORDER BY v) AS listed FROM (
        SELECT DISTINCT cast({n} AS VARCHAR) AS v FROM part ORDER BY v LIMIT 50) AS d"""
        for n in ("p_name", "p_brand", "p_type")
    ),
)
def values_of_dimensions(spark, sf_dir):
    found = dimension_values(table(spark, sf_dir, "part"), ["p_name", "p_brand", "p_type"])
    return found.select("column", F.array_join("values", "|").alias("listed"))


@query(
    "datetime_summary",
    "\nUNION ALL ".join(
        f"""SELECT '{c}' AS "column", cast(min({c}) AS DATE) AS date_min,
        cast(max({c}) AS DATE) AS date_max,
        cast(floor((epoch_us(max({c})) - epoch_us(min({c}))) / 86400000000) AS BIGINT)
          AS date_range_days FROM {t}"""
        for t, c in (("orders", "o_orderdate"), ("events", "ts"))
    ),
)
def time_spans(spark, sf_dir):
    orders = datetime_summary(table(spark, sf_dir, "orders"), ["o_orderdate"])
    return orders.unionByName(datetime_summary(table(spark, sf_dir, "events"), ["ts"]))


@query(
    "top_texts",
    f"""SELECT 'text' AS "column", cast(rank AS INTEGER) AS rank, text AS value, n AS count,
        {pct('n', 'total')} AS pct
        FROM (SELECT text, n, sum(n) OVER () AS total,
                row_number() OVER (ORDER BY n DESC, text) AS rank
              FROM (SELECT text, count(*) AS n FROM
                      (SELECT text FROM documents UNION ALL SELECT text FROM conversations) AS t
                    GROUP BY text) AS counted) AS ranked
        WHERE rank <= 10""",
)
def top_of_texts(spark, sf_dir):
    texts = table(spark, sf_dir, "documents").select("text")
    texts = texts.unionByName(table(spark, sf_dir, "conversations").select("text"))
    return top_texts(texts, ["text"], 10)


@query("frequent_values", top_sql("lineitem", ["l_partkey", "l_suppkey", "l_orderkey"], 20))
def frequent_of_lines(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    return frequent_values(lines, ["l_partkey", "l_suppkey", "l_orderkey"], 20)


WORDS_SQL = """(SELECT unnest(string_split_regex(text, '[^a-z]+')) AS word
  FROM (SELECT lower(text) AS text FROM documents UNION ALL SELECT lower(html) FROM pages) AS t
  ) AS words"""


@query("frequent_words", top_sql(WORDS_SQL, ["word"], 25))
def frequent_of_words(spark, sf_dir):
    texts = table(spark, sf_dir, "documents").select("text")
    texts = texts.unionByName(table(spark, sf_dir, "pages").select(F.col("html").alias("text")))
    words = texts.select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("word"))
    return frequent_values(words, ["word"], 25)
