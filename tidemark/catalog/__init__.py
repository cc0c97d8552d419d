"""The registered queries of the engine and the SQL that gives the same rows."""

from __future__ import annotations

from tidemark.catalog import documents, episodes, facts, graph, ingest, knowledge, people, records, streams  # noqa: F401
from tidemark.catalog.base import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
