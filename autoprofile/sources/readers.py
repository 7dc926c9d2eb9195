"""Tables from files or the catalog, and the choice of the main table among several."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, replace
from functools import reduce
from pathlib import PurePosixPath

from pyspark.errors import AnalysisException, SparkRuntimeException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from autoprofile.config import Config
from autoprofile.functions.coerce import nan_to_null, quoted
from autoprofile.functions.numeric import any_of
from autoprofile.operators.tables import null_profile
from autoprofile.operators.wide import empty_frame
from autoprofile.sources.delimited import read_messy, read_tidy, titled_table
from autoprofile.sources.names import clean_headers, renamed
from autoprofile.sources.texttypes import narrow_types

FORMATS = ("csv", "parquet", "json", "orc", "table")


@dataclass(frozen=True)
class LoadedTable:
    df: DataFrame
    name: str
    rows_raw: int
    skipped_rows: int = 0
    warnings: list[str] = field(default_factory=list)


def _format_of(path: str, given: str | None) -> str:
    name = given or PurePosixPath(path.rstrip("/")).suffix.lstrip(".").lower()
    if name not in FORMATS:
        raise ValueError(f"unsupported format {name!r}; use one of {', '.join(FORMATS)}")
    return name


def is_row_format(path: str, given: str | None = None) -> bool:
    """Must files of this format be parsed whole to read one column?"""
    return _format_of(path, given) in ("csv", "json")


def read_table(
    spark: SparkSession,
    path: str,
    format: str | None = None,
    header_detection: bool = False,
    max_rows: int | None = None,
    config: Config | None = None,
    **options,
) -> DataFrame:
    """A table from csv, parquet, json or orc files, or a catalog table (``format="table"``).

    The format comes from the path's suffix unless given.  ``header_detection`` looks for the
    header of delimited files below title rows.  ``max_rows`` is off by default.
    """
    rules = (config or Config()).ingest
    kind = _format_of(path, format)
    try:
        if kind == "table":
            df = spark.table(path)
        elif kind == "csv" and header_detection:
            df = read_messy(spark, path, rules.header_scan_rows, options.get("delimiter", ","))
        elif kind == "csv":
            df = read_tidy(spark, path, **options)
        else:
            df = spark.read.options(**options).format(kind).load(path)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "TABLE_OR_VIEW_NOT_FOUND"):
            raise FileNotFoundError(f"no such table or path: {path}") from error
        raise
    limit = max_rows if max_rows is not None else rules.max_rows
    return df.limit(limit) if limit is not None else df


def load(
    spark: SparkSession, path: str, format: str | None = None, **options
) -> LoadedTable:
    """Read, clean the headers, drop empty columns and rows."""
    if not options.get("header_detection") or _format_of(path, format) != "csv":
        return tidy(read_table(spark, path, format, **options), path)
    rules = (options.get("config") or Config()).ingest
    limit = options.get("max_rows") or rules.max_rows
    raw, headers = titled_table(
        spark, path, rules.header_scan_rows, options.get("delimiter", ",")
    )
    table = narrow_types(raw)
    loaded = tidy(table if limit is None else table.limit(limit), path)
    found = headers.agg(
        F.max("header_row").alias("skipped"), F.count_if(F.col("header_row") > 0).alias("files")
    )
    skipped, files = found.first()
    if not skipped:
        return loaded
    note = f"Skipped up to {skipped} title row(s) above the header in {files} file(s)."
    return replace(loaded, skipped_rows=skipped, warnings=[note, *loaded.warnings])


def tidy(df: DataFrame, name: str) -> LoadedTable:
    """Clean headers and drop empty columns and rows, with a warning for each change."""
    warnings = renamed(df.columns)
    clean = nan_to_null(clean_headers(df))
    if not clean.columns:
        return LoadedTable(clean, name, 0, warnings=[f"'{name}' appears to be empty."])
    profile = null_profile(clean).collect()
    raw_rows = profile[0]["total_rows"]
    empty = {r["column"] for r in profile if r["non_null_count"] == 0}
    kept = clean.select(*[quoted(c) for c in clean.columns if c not in empty])
    if empty:
        warnings.append(f"Dropped {len(empty)} fully-empty column(s).")
    if raw_rows and kept.columns and all(r["null_count"] for r in profile):
        # only a table with a gap in every column can hold an empty row
        filled = any_of([quoted(c).isNotNull() for c in kept.columns])
        dropped = kept.where(~filled).count()
        if dropped:
            warnings.append(f"Dropped {dropped} fully-empty row(s).")
            kept = kept.where(filled)
    return LoadedTable(kept, name, raw_rows, warnings=warnings)


def open_candidates(spark: SparkSession, paths: Mapping[str, str]) -> dict[str, DataFrame]:
    """Candidate tables by name; one that cannot be opened takes part as an empty table."""
    opened = {}
    for name, path in paths.items():
        try:
            opened[name] = read_table(spark, path)
        except (AnalysisException, OSError, SparkRuntimeException, ValueError):
            opened[name] = empty_frame(spark, "nothing int").drop("nothing")
    return opened


def score_tables(
    candidates: Mapping[str, DataFrame], first_rows: int | None = None
) -> DataFrame:
    """Non-empty cells + rows + columns of every candidate table.

    ``first_rows`` looks at no more rows than that; which ones, is the source's choice.
    """
    parts = []
    for ordinal, (name, df) in enumerate(candidates.items()):
        head = nan_to_null(df)
        if first_rows is not None:
            head = head.limit(first_rows)
        cells = reduce(
            lambda a, b: a + b, [F.count(quoted(c)) for c in df.columns], F.lit(0).cast("long")
        )
        parts.append(
            head.agg((cells + F.count(F.lit(1)) + len(df.columns)).alias("score")).select(
                F.lit(ordinal).alias("ordinal"), F.lit(name).alias("name"), "score"
            )
        )
    return reduce(DataFrame.unionByName, parts)


def pick_table(
    candidates: Mapping[str, DataFrame],
    prefer_largest: bool = True,
    first_rows: int | None = None,
) -> DataFrame:
    """The candidate most likely to be the main table, as one row (ordinal, name, score).

    The highest score wins, or with ``prefer_largest=False`` the first that is not empty; the
    first candidate wins ties.
    """
    scored = score_tables(candidates, first_rows)
    if prefer_largest:
        order = [F.desc("score"), F.asc("ordinal")]
    else:
        order = [F.desc(F.col("score") > 0), F.asc("ordinal")]
    return scored.orderBy(*order).limit(1)
