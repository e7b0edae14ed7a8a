"""Row identifiers for tables without a key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.plans.ordered import row_positions


def assign_doc_id(df: DataFrame, *order_by: str, name: str = "doc_id") -> DataFrame:
    """Add the 0-based position of each row in the order of ``order_by`` (unique together)."""
    return row_positions(df, [F.col(c) for c in order_by], name)
