"""Word and n-gram counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import gram_structs
from millrace.plans.spread import rows_of


def ngram_counts(df: DataFrame, tokens_col: str, n: int = 1) -> DataFrame:
    """``(gram, count)`` over all documents; grams never cross a document's end.

    Counted per task before the shuffle, so a frequent gram sends one row per task. Grams are counted
    word by word and labelled afterwards: tokens may hold blanks, and different grams may look alike.
    """
    if n == 1:
        return df.select(rows_of(tokens_col).alias("gram")).groupBy("gram").agg(F.count("*").alias("count"))
    words = [f"w{i}" for i in range(n)]
    grams = df.select(rows_of(gram_structs(F.col(tokens_col), n)).alias("words")).select("words.*")
    counts = grams.groupBy(*words).agg(F.count("*").alias("count"))
    return counts.select(F.array_join(F.array(*words), " ").alias("gram"), "count")


def most_common(counts: DataFrame, n: int, key: str = "gram", count: str = "count") -> DataFrame:
    """The ``n`` largest counts, equal counts in alphabetical order."""
    return counts.orderBy(F.col(count).desc(), F.col(key)).limit(n)
