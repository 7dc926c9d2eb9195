"""Every operator as a query over the shared tables, next to the same thing in SQL."""

from driver_queries import (  # noqa: F401  (importing registers the queries)
    charts,
    findings,
    ingest,
    numbers,
    quality,
    relations,
    schema,
    semantic,
)
from driver_queries.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
