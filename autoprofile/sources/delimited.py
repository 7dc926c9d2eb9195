"""Delimited text files, tidy or with title rows above the header."""

from __future__ import annotations

import csv
import io
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from autoprofile.functions.coerce import NUMBER_PATTERN, quoted, strip
from autoprofile.operators.wide import empty_frame, local_frame, pin
from autoprofile.sources.names import clean_names
from autoprofile.sources.records import cells, first_records, lines, records
from autoprofile.sources.texttypes import blank_markers, narrow_types, unless_missing


def read_tidy(spark: SparkSession, path: str, delimiter: str = ",", **options) -> DataFrame:
    """Files whose first line is the header, with clean names and inferred types.

    One look at the text finds the header of every file and whether quoted cells hold line
    breaks.  Files are read by their own header and matched by cleaned name; a file without a
    column has NULL there.  All files are read in blocks.  Inside quotes a doubled quote is one;
    with another ``quote`` or ``escape`` among the options, files that leave a quote open on
    some line are read as wholes.
    """
    layouts = _layouts(spark, path, delimiter)
    if not layouts:
        return empty_frame(spark, "unnamed string").drop("unnamed")
    options = {"escape": '"', **options}
    doubled = options["escape"] == '"' and options.get("quote", '"') == '"'
    parts, broken_files = [], []
    for (header, broken), files in sorted(layouts.items()):
        if broken and doubled:
            broken_files += files
            continue
        settings = {"sep": delimiter, **({"multiLine": "true"} if broken else {}), **options}
        reader = spark.read.options(**settings)
        source = path if len(layouts) == 1 else files
        first = reader.csv(files[:1], header=False).take(1)
        if not first:
            continue
        names = [v if v is not None else f"Unnamed: {i}" for i, v in enumerate(first[0])]
        parts.append(reader.csv(source, header=True).toDF(*clean_names(names)))
    if broken_files:
        found = lines(spark, broken_files, delimiter)
        filled = _first_records(found.where(strip(F.col("value")) != ""), 1)
        headers = pin(filled.select(*HEADER_PLACE, F.col("value").alias("header")))
        parts.append(_table(spark, records(found), headers, delimiter))
    if not parts:
        return empty_frame(spark, "unnamed string").drop("unnamed")
    table = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return narrow_types(blank_markers(table))


def _layouts(
    spark: SparkSession, path: str, delimiter: str
) -> dict[tuple[str, bool], list[str]]:
    """The files by their first line that is not blank and by whether a line leaves a quote open.

    One row per file comes back; the driver lists the files in any case.
    """
    filled = lines(spark, path, delimiter).where(strip(F.col("value")) != "")
    found = filled.groupBy("file").agg(
        F.min_by("value", F.struct("block_start", "line_id")).alias("header"),
        F.bool_or(F.col("kind") % 2 == 1).alias("broken"),
    )
    layouts: dict[tuple[str, bool], list[str]] = {}
    for row in sorted(found.collect()):
        layouts.setdefault((row["header"], row["broken"]), []).append(row["file"])
    return layouts


#: a header is looked for in so many lines for each record that it may be
LINES_PER_RECORD = 20
HEADER_PLACE = ["key", "file", "header_block", "header_id"]


def _first_records(found: DataFrame, count: int) -> DataFrame:
    """The first records of each file that are not blank; blank ones count in the numbers."""
    first = first_records(found, count, count * LINES_PER_RECORD)
    return first.where(strip(F.col("value")) != "").withColumnsRenamed(
        {"block_start": "header_block", "line_id": "header_id"}
    )


# ------------------------------------------------------------------ title rows


def _header_of_each_file(found: DataFrame, scan_rows: int, delimiter: str) -> DataFrame:
    """The record of each file most likely to be the header, judged by its first ones.

    A header is dense with words: the score is the share of non-blank word cells, cut to 0.3
    of it when numbers outweigh words.  The first of the best records wins.
    """
    head = _first_records(found, scan_rows).withColumn(
        "cells", cells(F.col("value"), delimiter)
    )
    words = F.filter("cells", lambda c: (strip(c) != "") & ~strip(c).rlike(NUMBER_PATTERN))
    numbers = F.filter("cells", lambda c: strip(c).rlike(NUMBER_PATTERN))
    whole_head = Window.partitionBy("key")  # at most scan_rows records
    width = F.max(F.size("cells")).over(whole_head)
    share = F.size(words) / width
    score = F.when(F.size(numbers) > F.size(words), share * 0.3).otherwise(share)
    best = F.struct("record_no", "header_block", "header_id", "value")
    return (
        head.withColumn("score", score)
        .where(F.size(words) + F.size(numbers) > 0)
        .groupBy("key", "file")
        .agg(F.max_by(best, F.struct("score", -F.col("record_no"))).alias("best"))
        .select(
            "key",
            "file",
            F.col("best.record_no").cast("int").alias("header_row"),
            F.col("best.header_block").alias("header_block"),
            F.col("best.header_id").alias("header_id"),
            F.col("best.value").alias("header"),
        )
    )


def detect_headers(
    spark: SparkSession, path: str, scan_rows: int = 20, delimiter: str = ","
) -> DataFrame:
    """(file, header_row, header): 0-based record of the header in every file under ``path``.

    It is one of the first ``scan_rows`` records, as far as they lie in the first
    ``scan_rows * LINES_PER_RECORD`` lines.
    """
    found = _header_of_each_file(lines(spark, path, delimiter), scan_rows, delimiter)
    return found.select("file", "header_row", "header")


def read_with_titles(
    spark: SparkSession, path: str, scan_rows: int = 20, delimiter: str = ","
) -> DataFrame:
    """Files with title rows above the header, each file with its own header.

    Columns are matched by cleaned name over all files; a file without a column has NULL
    there.  All columns are text: pass the result on to
    :func:`autoprofile.sources.texttypes.narrow_types`.  Cells may hold line breaks inside
    quotes.  Write the result once if several analyses follow, each use parses the text again.
    """
    return titled_table(spark, path, scan_rows, delimiter)[0]


def titled_table(
    spark: SparkSession, path: str, scan_rows: int = 20, delimiter: str = ","
) -> tuple[DataFrame, DataFrame]:
    """:func:`read_with_titles` and the headers it found, looked for once."""
    found = lines(spark, path, delimiter)
    # one row per file, which the driver lists in any case; the same listing serves the rows
    headers = pin(_header_of_each_file(found, scan_rows, delimiter))
    return _table(spark, records(found), headers, delimiter), headers


def _table(
    spark: SparkSession, rows: DataFrame, headers: DataFrame, delimiter: str
) -> DataFrame:
    """The records below each file's header as text columns, matched by cleaned name."""
    layouts = headers.groupBy("header").agg(F.count(F.lit(1)).alias("files")).collect()
    if not layouts:
        return empty_frame(spark, "unnamed string").drop("unnamed")
    names_of = {
        r["header"]: clean_names(
            [
                cell if cell.strip() else f"Unnamed: {i}"
                for i, cell in enumerate(
                    next(csv.reader(io.StringIO(r["header"], newline=""), delimiter=delimiter))
                )
            ]
        )
        for r in sorted(layouts, key=lambda r: r["header"])
    }
    all_names = list(dict.fromkeys(n for names in names_of.values() for n in names))
    positions = local_frame(
        spark,
        [
            (header, [names.index(n) if n in names else -1 for n in all_names])
            for header, names in names_of.items()
        ],
        "header string, positions array<int>",
    )
    by_file = headers.join(F.broadcast(positions), "header").select(
        "key", "header_block", "header_id", "positions"
    )
    below = F.struct("block_start", "line_id") > F.struct("header_block", "header_id")
    table = (
        rows.join(F.broadcast(by_file), "key")  # one row per file
        .where(below & (strip(F.col("value")) != ""))
        .select(cells(F.col("value"), delimiter).alias("cells"), "positions")
        .withColumn("cells", F.transform("cells", unless_missing))
    )
    # expressions as text: a table may have thousands of columns
    return table.selectExpr(
        *[f"get(cells, positions[{k}]) AS `{name}`" for k, name in enumerate(all_names)]
    )


def read_messy(
    spark: SparkSession, path: str, scan_rows: int = 20, delimiter: str = ","
) -> DataFrame:
    return narrow_types(read_with_titles(spark, path, scan_rows, delimiter))


def csv_line(df: DataFrame) -> Column:
    """A row of ``df`` as one delimited line."""
    return F.to_csv(F.struct(*[quoted(c) for c in df.columns]))
