"""Registered queries by area."""

from lakescope.plans import catalogs, clusters, ingest, joins, logs, profiling, searching, sqlsurface  # noqa: F401
from lakescope.plans.registry import REGISTRY, query, table  # noqa: F401
