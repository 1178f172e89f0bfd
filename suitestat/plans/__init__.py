"""Registered queries: importing this package fills QUERIES and SQL."""

from suitestat.plans import queries_calls, queries_code, queries_coverage, queries_detection, queries_documents, queries_facts, queries_resources, queries_sequences, queries_tests, queries_urls  # noqa: F401
from suitestat.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
