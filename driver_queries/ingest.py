"""Reading, header cleaning, empty rows and columns, writing."""

from pyspark.sql import functions as F

from autoprofile.operators.catalog import column_catalog
from autoprofile.operators.frequencies import top_values
from autoprofile.operators.semantic import build_semantic_layer, kpi_catalog
from autoprofile.operators.tables import null_profile
from autoprofile.sources.cleaning import drop_empty
from autoprofile.sources.delimited import csv_line, detect_headers, read_messy
from autoprofile.sources.names import clean_headers
from autoprofile.sources.readers import load, pick_table, read_table
from autoprofile.sources.records import cells
from autoprofile.sources.sinks import write_sections, write_semantic_layer
from driver_queries.registry import COLUMNS, query, scratch, table, types_sql


@query(
    "csv_scan",
    """SELECT c_custkey, c_name, cast(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal,
       c_mktsegment FROM customer""",
)
def csv_scan(spark, sf_dir):
    folder = scratch(spark)
    table(spark, sf_dir, "customer").write.csv(folder, header=True)
    return read_table(spark, folder, "csv")


@query("csv_header_orders", "SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def csv_header_orders(spark, sf_dir):
    """Two kinds of files in one folder: the columns in either order."""
    folder = scratch(spark)
    names = ["s_suppkey", "s_name", "s_acctbal"]
    suppliers = table(spark, sf_dir, "supplier").select(*names)
    even = F.col("s_suppkey") % 2 == 0
    suppliers.where(even).write.csv(folder, header=True)
    suppliers.where(~even).select(*reversed(names)).write.mode("append").csv(folder, header=True)
    return read_table(spark, folder, "csv")


@query(
    "csv_quoted_breaks",
    """SELECT s_suppkey, concat(s_name, chr(10), 'of "', s_nationkey, '", abroad') AS address,
         s_acctbal FROM supplier""",
)
def csv_quoted_breaks(spark, sf_dir):
    folder = scratch(spark)
    address = F.concat(
        F.col("s_name"), F.lit('\nof "'), F.col("s_nationkey"), F.lit('", abroad')
    )
    table(spark, sf_dir, "supplier").select(
        "s_suppkey", address.alias("address"), "s_acctbal"
    ).write.csv(folder, header=True, escape='"')
    return read_table(spark, folder, "csv", escape='"')


@query(
    "format_scan",
    """SELECT f AS format, count(*) AS n_rows, cast(sum(s_suppkey) AS BIGINT) AS keys,
       count(DISTINCT s_name) AS names
       FROM supplier, (VALUES ('json'), ('orc'), ('parquet')) AS formats(f) GROUP BY f""",
)
def format_scan(spark, sf_dir):
    supplier = table(spark, sf_dir, "supplier")
    result = None
    for kind in ("json", "orc", "parquet"):
        folder = scratch(spark)
        supplier.write.format(kind).save(folder)
        part = read_table(spark, folder, kind).agg(
            F.lit(kind).alias("format"),
            F.count(F.lit(1)).alias("n_rows"),
            F.sum("s_suppkey").alias("keys"),
            F.countDistinct("s_name").alias("names"),
        )
        result = part if result is None else result.unionByName(part)
    return result


@query(
    "pick_table",
    """SELECT name, score FROM (
       SELECT 0 AS ordinal, 'region' AS name, count(*) * 3 + 2 AS score FROM region
       UNION ALL SELECT 1, 'nation', count(*) * 4 + 3 FROM nation
       UNION ALL SELECT 2, 'customer', count(*) * 6 + 5 FROM customer
       UNION ALL SELECT 3, 'supplier', count(*) * 5 + 4 FROM supplier
       ) AS scored ORDER BY score DESC, ordinal LIMIT 1""",
)
def pick(spark, sf_dir):
    names = ("region", "nation", "customer", "supplier")
    return pick_table({n: table(spark, sf_dir, n) for n in names}).select("name", "score")


FILES_PER_SEGMENT = 4


def _untidy_files(spark, sf_dir):
    """Customers as a few delimited files per market segment, each below two title lines."""
    customers = table(spark, sf_dir, "customer")
    names = ["c_custkey", "c_name", "c_nationkey", "c_acctbal"]
    part = (F.col("c_custkey") % FILES_PER_SEGMENT).alias("part")
    body = customers.select(
        F.col("c_mktsegment").alias("segment"),
        part,
        F.lit(9).alias("place"),
        csv_line(customers.select(*names)).alias("line"),
    )
    title = F.array(
        F.struct(F.lit(0).alias("place"), F.concat(F.lit("Report "), "c_mktsegment").alias("line")),
        F.struct(F.lit(1).alias("place"), F.lit("").alias("line")),
        F.struct(F.lit(2).alias("place"), F.lit("Cust Key,Name,Nation Key,Name").alias("line")),
    )
    head = customers.select("c_mktsegment", part).distinct().select(
        F.col("c_mktsegment").alias("segment"), "part", F.inline(title)
    )
    folder = scratch(spark)
    (
        body.unionByName(head)
        .repartition("segment", "part")
        .sortWithinPartitions("segment", "part", "place")
        .select("segment", "part", "line")
        .write.partitionBy("segment", "part")
        .text(folder)
    )
    return folder


@query(
    "header_rows",
    f"""SELECT 2 AS header_row, 'Cust Key,Name,Nation Key,Name' AS header, count(*) AS files
       FROM (SELECT DISTINCT c_mktsegment, c_custkey % {FILES_PER_SEGMENT} FROM customer) AS f""",
)
def header_rows(spark, sf_dir):
    found = detect_headers(spark, _untidy_files(spark, sf_dir))
    return found.groupBy("header_row", "header").agg(F.count(F.lit(1)).alias("files"))


@query(
    "messy_csv_load",
    """SELECT c_custkey AS cust_key, c_name AS name, cast(c_nationkey AS BIGINT) AS nation_key,
       c_acctbal AS name_1 FROM customer""",
)
def messy_csv_load(spark, sf_dir):
    return read_messy(spark, _untidy_files(spark, sf_dir))


@query(
    "header_rows_quoted",
    """SELECT n_regionkey, 1 AS header_row, count(*) * 300 AS cells,
       count(*) * 300 AS quoted_cells FROM nation GROUP BY n_regionkey""",
)
def header_rows_quoted(spark, sf_dir):
    """A file per region whose header has three hundred quoted cells for each nation."""
    numbered = table(spark, sf_dir, "nation").select(
        "n_regionkey", "n_name", F.explode(F.sequence(F.lit(1), F.lit(300))).alias("i")
    )
    cell = F.concat(F.lit('"'), "n_name", F.lit(", "), "i", F.lit('"'))
    header = numbered.groupBy("n_regionkey").agg(
        F.array_join(F.collect_list(cell), ",").alias("header")
    )
    folder = scratch(spark)
    title = F.concat(F.lit("Nations\n"), "header").alias("value")
    header.select("n_regionkey", title).write.partitionBy("n_regionkey").text(folder)
    found = detect_headers(spark, folder)
    split = cells(F.col("header"))
    return found.select(
        F.regexp_extract("file", r"n_regionkey=(\d+)", 1).cast("int").alias("n_regionkey"),
        "header_row",
        F.size(split).cast("long").alias("cells"),
        F.size(F.filter(split, lambda c: c.contains(", "))).cast("long").alias("quoted_cells"),
    )


@query(
    "messy_quoted_breaks",
    """SELECT c_custkey AS cust_key, concat(c_name, chr(10), 'of "', c_nationkey, '", abroad')
       AS address, c_acctbal AS name FROM customer""",
)
def messy_quoted_breaks(spark, sf_dir):
    """Below a title of two lines, cells with line breaks, in one file of many blocks."""
    customers = table(spark, sf_dir, "customer")
    address = F.concat(
        F.col("c_name"), F.lit('\nof "'), F.col("c_nationkey"), F.lit('", abroad')
    )
    body = customers.select("c_custkey", address.alias("address"), "c_acctbal")
    line = F.to_csv(F.struct(*body.columns), {"escape": '"', "quoteAll": "true"})
    title = spark.createDataFrame([('"Report\nof customers",,\nCust Key,Address,Name',)], ["value"])
    folder = scratch(spark)
    lines = body.select(line.alias("value"), F.lit(1).alias("place"))
    whole = title.withColumn("place", F.lit(0)).unionByName(lines)
    whole.coalesce(1).sortWithinPartitions("place").select("value").write.text(folder)
    return read_messy(spark, folder)


@query(
    "clean_headers",
    """SELECT n_nationkey AS id, n_name AS nation_name, n_regionkey AS nation_name_1,
       n_nationkey AS col_2024_total, n_regionkey AS unnamed, n_name AS id_1 FROM nation""",
)
def headers(spark, sf_dir):
    nation = table(spark, sf_dir, "nation").select(
        "n_nationkey", "n_name", "n_regionkey", "n_nationkey", "n_regionkey", "n_name"
    )
    untidy = nation.toDF(" ID ", "Nation  Name!", "nation-name", "2024 Total ($)", "##", "id")
    return clean_headers(untidy)


@query(
    "drop_empty",
    """SELECT CASE WHEN c_custkey % 5 <> 0 THEN c_custkey END AS c_custkey,
       CASE WHEN c_custkey % 3 <> 0 THEN c_name END AS c_name FROM customer
       WHERE c_custkey % 5 <> 0 OR c_custkey % 3 <> 0""",
)
def empty_parts(spark, sf_dir):
    key = F.col("c_custkey")
    customers = table(spark, sf_dir, "customer").select(
        F.when(key % 5 != 0, key).alias("c_custkey"),
        F.lit(None).cast("double").alias("nothing"),
        F.when(key % 3 != 0, F.col("c_name")).alias("c_name"),
        F.lit(float("nan")).alias("not_a_number"),
    )
    return drop_empty(customers)


@query("row_cap", "SELECT least(count(*), 1000) AS n_rows FROM orders")
def row_cap(spark, sf_dir):
    capped = read_table(spark, f"{sf_dir}/orders.parquet", max_rows=1000)
    return capped.agg(F.count(F.lit(1)).alias("n_rows"))


@query(
    "load_warnings",
    """SELECT 'Dropped 1 fully-empty column(s).' AS warning, count(*) AS rows_raw,
       count(*) FILTER (c_custkey % 5 <> 0) AS rows_kept FROM customer
       UNION ALL
       SELECT concat('Dropped ', count(*) FILTER (c_custkey % 5 = 0), ' fully-empty row(s).'),
       count(*), count(*) FILTER (c_custkey % 5 <> 0) FROM customer""",
)
def load_warnings(spark, sf_dir):
    key = F.col("c_custkey")
    folder = scratch(spark)
    table(spark, sf_dir, "customer").select(
        F.when(key % 5 != 0, key).alias("Key"),
        F.when(key % 5 != 0, F.col("c_name")).alias("Name"),
        F.lit(None).cast("string").alias("Notes"),
    ).write.parquet(folder)
    loaded = load(spark, folder, "parquet")
    return loaded.df.agg(F.count(F.lit(1)).alias("rows_kept")).select(
        F.explode(F.array(*[F.lit(w) for w in loaded.warnings])).alias("warning"),
        F.lit(loaded.rows_raw).cast("long").alias("rows_raw"),
        "rows_kept",
    )


@query(
    "semantic_document",
    f"""SELECT '1.0' AS version,
       count(*) FILTER (inferred_type IN ('categorical', 'boolean', 'text')) AS dimensions,
       count(*) FILTER (inferred_type = 'numeric') AS measures,
       count(*) FILTER (inferred_type = 'datetime') AS time_fields, 0 AS entities
       FROM ({types_sql('events', COLUMNS['events'])}) AS c""",
)
def semantic_document(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    catalog = column_catalog(events)
    fields = build_semantic_layer(events, catalog)
    folder = scratch(spark)
    write_semantic_layer(fields, kpi_catalog(fields), folder)
    named = "array<struct<raw_column: string>>"
    layout = (
        f"semantic_layer struct<version: string, dimensions: {named}, measures: {named}, "
        f"time_fields: {named}, entities: {named}>"
    )
    layer = F.from_json("value", layout).getField("semantic_layer")
    return spark.read.text(folder).select(layer.alias("layer")).select(
        "layer.version",
        *[
            F.size(f"layer.{part}").cast("long").alias(part)
            for part in ("dimensions", "measures", "time_fields")
        ],
        F.size("layer.entities").alias("entities"),
    )


@query(
    "export_sections",
    """SELECT 'null_profile' AS section, 6::BIGINT AS n_rows FROM events HAVING count(*) > 0
       UNION ALL
       SELECT 'top_values', least(count(DISTINCT event_type), 15) FROM events""",
)
def export_sections(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    sections = {
        "null_profile": null_profile(events),
        "top_values": top_values(events, ["event_type"]),
    }
    result = None
    for name, folder in zip(sections, write_sections(sections, scratch(spark))):
        part = read_table(spark, folder, "parquet").agg(
            F.lit(name).alias("section"), F.count(F.lit(1)).alias("n_rows")
        )
        result = part if result is None else result.unionByName(part)
    return result
