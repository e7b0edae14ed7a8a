"""Where rows are processed: parallelism, and shuffles placed before data grows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_ALL = 2**31 - 1


def spread(df: DataFrame) -> DataFrame:
    """Redistribute texts that Spark would read in fewer tasks than there are cores.

    The tasks of a scan are splits of ``spark.sql.files.maxPartitionBytes``, so only a table of less
    than that for each core is moved, whatever its number of files; a large table never is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def by_key(df: DataFrame, key: str, least: int = 1) -> DataFrame:
    """Hash-distribute compact rows before they are exploded, to ``least`` partitions at least.

    Groupings by ``key`` and more need no further exchange. The number of partitions is fixed:
    adaptive coalescing judges by the compact size and would leave the exploded rows to few tasks.
    """
    return df.repartition(max(least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), key)


def rows_of(values: Column | str) -> Column:
    """``explode`` whose input is computed once.

    For a bare column the optimizer infers a filter on the list's size and pushes it, with the whole
    expression behind the column, below earlier shuffles: every text would be tokenised twice.
    """
    return F.explode(F.slice(values, 1, _ALL))


def numbered_rows_of(values: Column | str) -> Column:
    """``posexplode`` whose input is computed once; see :func:`rows_of`."""
    return F.posexplode(F.slice(values, 1, _ALL))
