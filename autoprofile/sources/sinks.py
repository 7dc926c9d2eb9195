"""Writing results: one folder per section, and the semantic layer as one document."""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from autoprofile.operators.semantic import semantic_document


def write_sections(
    sections: Mapping[str, DataFrame], folder: str, format: str = "parquet"
) -> list[str]:
    """Write every section below ``folder``; returns the folders written.

    ``folder`` must be on storage that all executors reach.
    """
    written = []
    for name, frame in sections.items():
        target = f"{folder.rstrip('/')}/{name}"
        frame.write.mode("overwrite").format(format).save(target)
        written.append(target)
    return written


def shared_folder(spark: SparkSession) -> str | None:
    """The folder on shared storage the cluster names for checkpoints, if it names one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    return folder.rstrip("/") if folder else None


def stage(df: DataFrame) -> DataFrame:
    """The table written once as Parquet and read back, where the cluster has a shared folder.

    An analysis scans a table many times, each time only a few columns.  Text and JSON files
    would be parsed in full every time; the Parquet copy is pruned, and a lost executor costs
    no parsing again.  The copy goes below ``spark.checkpoint.dir`` and is the caller's to
    remove; without that setting the table is used as it is.
    """
    shared = shared_folder(df.sparkSession)
    if not shared or not df.columns:
        return df
    folder = f"{shared}/autoprofile/{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def write_semantic_layer(fields: DataFrame, kpis: DataFrame, path: str) -> None:
    """The semantic layer as one JSON document."""
    semantic_document(fields, kpis).coalesce(1).write.mode("overwrite").text(path)
