"""Small numeric expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def percent(part: Column, whole: Column, digits: int = 2) -> Column:
    """``part`` of ``whole`` in percent; 0 for an empty whole."""
    share = F.try_divide(part.cast("double") * 100, whole.cast("double"))
    return F.coalesce(F.round(share, digits), F.lit(0.0))


def all_of(conditions: list[Column]) -> Column:
    result = F.lit(True)
    for condition in conditions:
        result = result & condition
    return result


def any_of(conditions: list[Column]) -> Column:
    result = F.lit(False)
    for condition in conditions:
        result = result | condition
    return result
