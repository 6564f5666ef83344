"""Register frames as named tables of one namespace."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession


def sanitize(name: str) -> str:
    return re.sub(r"[^a-zA-Z0-9_一-鿿]", "_", name)


_OWNERS: dict[str, dict[str, str]] = {}  # session to view to source


def register(sources: Mapping[str, Mapping[str, DataFrame]]) -> dict[str, str]:
    """Create a view per table; returns view name to source.

    A name that another source holds, in this call or from an earlier one in the session,
    or that is a view of someone else's, is an error instead of a silent replacement. A
    source may register its own tables again.
    """
    owner: dict[str, str] = {}
    frames: dict[str, DataFrame] = {}
    for source, tables in sources.items():
        for name, df in tables.items():
            view = sanitize(name)
            if view in owner:
                raise ValueError(f'table "{view}" of {source} is already registered by {owner[view]}')
            held = _held(df.sparkSession).get(view)
            if df.sparkSession.catalog.tableExists(view) and held != source:
                raise ValueError(f'table "{view}" of {source} is already registered by {held or "the session"}')
            owner[view], frames[view] = source, df
    for view, df in frames.items():
        df.createOrReplaceTempView(view)
        _held(df.sparkSession)[view] = owner[view]
    return owner


def _held(spark: SparkSession) -> dict[str, str]:
    return _OWNERS.setdefault(spark._jsparkSession.sessionUUID(), {})


def unregister(spark: SparkSession, source: str) -> None:
    """Drop the views of a source."""
    for view in [v for v, s in _held(spark).items() if s == source]:
        spark.catalog.dropTempView(view)
        del _held(spark)[view]
