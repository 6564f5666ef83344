"""Column expressions over names and texts. All JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Dtype substrings per type class, in the order they are tried.
TYPE_CLASSES = [
    ("INT", ["INT", "BIGINT", "SMALLINT", "TINYINT"]),
    ("STRING", ["VARCHAR", "TEXT", "CHAR", "STRING"]),
    ("NUMERIC", ["FLOAT", "DOUBLE", "DECIMAL", "NUMERIC", "REAL"]),
    ("TEMPORAL", ["DATE", "TIMESTAMP", "TIME"]),
    ("BOOL", ["BOOL"]),
]


def type_class(dtype: Column) -> Column:
    """Fold a dtype name into a join class; other types are their own class.

    Nested types (``array<int>``) keep their full name so that they never
    match a scalar key.
    """
    upper = F.upper(dtype)
    result = F.when(upper.contains("<"), upper)
    for name, parts in TYPE_CLASSES:
        result = result.when(upper.rlike("|".join(parts)), F.lit(name))
    return result.otherwise(upper)


def strip_id_suffix(name: Column) -> Column:
    return F.lower(F.regexp_replace(name, r"(?i)[_-]?(id|key|code)$", ""))


def singular(table: Column) -> Column:
    """Drop one final lower-case s, then lower."""
    return F.lower(F.regexp_replace(table, r"s$", ""))


def sanitize_name(name: Column) -> Column:
    return F.regexp_replace(name, r"[^a-zA-Z0-9_一-鿿]", "_")


def name_tokens(name: Column) -> Column:
    """Lower-case words of a name: camelCase, ``-``, blanks and ``_`` separate."""
    split_camel = F.regexp_replace(name, r"([a-z])([A-Z])", "$1_$2")
    unified = F.lower(F.regexp_replace(split_camel, r"[-\s]+", "_"))
    return F.filter(F.split(unified, "_"), lambda t: F.length(t) > 1)


def query_tokens(query: str) -> list[str]:
    """Search words: anything but word characters and blanks becomes a blank."""
    import re

    return re.sub(r"[^\w\s]", " ", query).lower().split()


def sha16(text: Column) -> Column:
    return F.left(F.sha2(text, 256), F.lit(16))
