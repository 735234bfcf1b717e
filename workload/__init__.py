"""Queries over the test tables, each with reference SQL where SQL can express it."""

from workload import changes, feeds, lookups, operations, state, texts, vectors
from workload.common import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "changes", "feeds", "lookups", "operations", "state", "texts", "vectors"]
