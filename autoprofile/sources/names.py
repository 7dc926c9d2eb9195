"""Column names: repeated names, edge white space, characters, clashes."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame


def unique_names(names: list[str], case_sensitive: bool = False) -> list[str]:
    """Later repeats of a name get ``_1``, ``_2``, ... until every name is unique.

    Names that differ only in case clash as well, because Spark resolves names that way.
    """
    fold = (lambda n: n) if case_sensitive else str.lower
    taken: set[str] = set()
    repeats: dict[str, int] = {}
    result = []
    for name in names:
        candidate = name
        while fold(candidate) in taken:
            repeats[fold(name)] = repeats.get(fold(name), 0) + 1
            candidate = f"{name}_{repeats[fold(name)]}"
        taken.add(fold(candidate))
        result.append(candidate)
    return result


def stripped_names(names: list[str]) -> list[str]:
    return [n.strip() for n in names]


def sanitized_name(name: str) -> str:
    """Lower-case word characters joined by single underscores, never starting with a digit."""
    words = re.sub(r"_+", "_", re.sub(r"[^\w]", "_", name)).strip("_").lower()
    if words[:1].isdigit():
        words = f"col_{words}"
    return words or "unnamed"


def clean_names(names: list[str]) -> list[str]:
    distinct = unique_names([str(n) for n in names], case_sensitive=True)
    return unique_names([sanitized_name(n) for n in stripped_names(distinct)])


def renamed(names: list[str]) -> list[str]:
    """Warnings for the names that repeat an earlier one."""
    return [
        f"Duplicate column '{old}' renamed to '{new}'."
        for old, new in zip(names, unique_names(names, case_sensitive=True))
        if old != new
    ]


def clean_headers(df: DataFrame) -> DataFrame:
    """The table with unique, trimmed, sanitized column names."""
    return df.toDF(*clean_names(df.columns))
