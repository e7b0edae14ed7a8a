"""Named queries over the test tables, each with its equivalent SQL where SQL can express it."""

from __future__ import annotations

from millrace.catalog import classification, pages, profiling, searching, tables, wording
from millrace.catalog.registry import SQL, QUERIES

__all__ = ["QUERIES", "SQL", "classification", "pages", "profiling", "searching", "tables", "wording"]
