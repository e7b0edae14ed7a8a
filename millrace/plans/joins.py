"""Joins that stay balanced when a few keys hold most rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Keys that carry more than 1/HEAVY_KEYS of all rows; there can be fewer than HEAVY_KEYS of them.
HEAVY_KEYS = 1000
# A side is broadcast only when the files it was staged in hold no more bytes than this.
BROADCAST_BYTES = 16 << 20


def fits_broadcast(df: DataFrame, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether a staged side is small enough to be broadcast, by the size of the files it is read from.

    A side that was not staged has no known size and does not fit.
    """
    return staged_bytes(df) <= max_bytes


def staged_bytes(df: DataFrame) -> int:
    """Bytes of the files a staged table is read from; of what was not staged, a very large number."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def attach_by_key(
    rows: DataFrame, lookup: DataFrame, key: str, weight: str, payload: str, spread_by: Column, max_bytes: int = 0
) -> DataFrame:
    """Inner join of ``rows`` with ``lookup`` (unique ``key``), adding column ``payload``.

    A lookup staged in up to ``max_bytes`` is broadcast, and ``rows`` stay where they are. Else
    ``lookup.weight`` tells how many rows carry the key. Keys above 1/HEAVY_KEYS of the sum number
    fewer than HEAVY_KEYS by counting, so broadcasting them is safe whatever the data size. Rows of
    those keys are salted by ``spread_by`` and so never meet in one task; all other keys are light
    and take the ordinary shuffle join.
    """
    if max_bytes and fits_broadcast(lookup, max_bytes):
        return rows.join(F.broadcast(lookup.select(key, payload)), key).select(*rows.columns, payload)
    total = lookup.agg(F.sum(weight).alias("t")).scalar()
    is_heavy = F.col(weight) * HEAVY_KEYS > total
    heavy = lookup.filter(is_heavy).select(key, F.col(payload).alias("_heavy"))
    light = lookup.filter(~is_heavy).select(key, F.col(payload).alias("_light"), F.lit(0).alias("_salt"))

    salt = F.when(F.col("_heavy").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(spread_by), F.lit(4096)).cast("int") + 1)
    marked = rows.join(F.broadcast(heavy), key, "left").withColumn("_salt", salt)
    joined = marked.join(light, [key, "_salt"], "left")
    return joined.select(*rows.columns, F.coalesce("_heavy", "_light").alias(payload)).filter(F.col(payload).isNotNull())


def match_by_key(
    rows: DataFrame,
    wanted: DataFrame,
    key: str,
    spread_by: Column,
    salts: int = 64,
    max_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Inner join of a large table with a usually small many-to-many side.

    ``wanted`` is broadcast when it is staged in few bytes, so ``rows`` is not moved at all. Beyond that, ``rows`` is salted by ``spread_by`` and ``wanted`` repeated once per salt: a key holding a
    third of all rows is still spread over ``salts`` tasks. Both ways give the same rows.
    """
    if fits_broadcast(wanted, max_bytes):
        return rows.join(F.broadcast(wanted), key)
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(spread_by), F.lit(salts)).cast("int"))
    repeated = wanted.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(repeated, [key, "_salt"]).drop("_salt")
