"""Narrow keys for counting distinct values and rows.

What crosses the network when distinct things are counted is the key, so its width must
not grow with the value.  Short texts are their own key, a long text is replaced by its
first characters and its SHA-256 (a length no short text has), and a whole row by a 128-bit
fingerprint.  Keys say whether texts are equal; what order texts have only their first
characters tell, and where these are equal only the texts themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from autoprofile.functions.coerce import family, quoted

#: texts from this many bytes on are replaced; they have HEAD_CHARS characters at least
LONG_TEXT = 64
HEAD_CHARS = LONG_TEXT // 4


def text_key(text: Column) -> Column:
    digest = F.concat(F.substring(text, 1, HEAD_CHARS), F.sha2(text, 256))
    return F.when(F.octet_length(text) < LONG_TEXT, text).otherwise(digest)


def is_digest(key: str) -> bool:
    return len(key.encode()) >= LONG_TEXT


def head(key: Column) -> Column:
    """Orders keys as their texts are ordered, except that texts that begin alike tie."""
    return F.substring(key, 1, HEAD_CHARS)


def row_fingerprint(df: DataFrame) -> list[Column]:
    """Two seeded 64-bit hashes over all columns; equal rows have equal fingerprints.

    The hash function skips NULLs, so every column also contributes whether it is NULL;
    otherwise (1, NULL) and (NULL, 1) would look alike.  Nested columns are hashed through
    their JSON text for the same reason.  Two different rows share a fingerprint with a
    chance of about rows^2 / 2^129, under 1e-14 for a trillion rows.
    """
    parts: list[Column] = []
    for field in df.schema:
        column = quoted(field.name)
        if family(field.dataType) == "nested" and field.dataType.typeName() != "binary":
            parts.append(F.to_json(F.struct(column), {"ignoreNullFields": "false"}))
        else:
            parts += [column, column.isNull()]
    return [
        F.xxhash64(*parts).alias("fingerprint_a"),
        F.xxhash64(F.lit("second seed"), *parts).alias("fingerprint_b"),
    ]
