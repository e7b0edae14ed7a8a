"""Operators for preparing training data, and their registered queries."""

from millrace.llm.queries import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
