"""Registered queries: each runs an operator over the given tables, most with a SQL twin."""

from catalog import (  # noqa: F401
    changes, detection, evidence, filters, functions, health, ingest, matching, reports, streams, tables,
)
from catalog.base import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
