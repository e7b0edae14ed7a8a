"""What the vector searches share: usable vectors, Arrow lists as matrices, and the best k per query."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.chunks import plain


def usable(df: DataFrame, id_col: str, vector_col: str, zero: bool) -> DataFrame:
    """``vec_id, v`` (doubles) of vectors that are not null or empty and hold only finite numbers;
    all-zero vectors only if ``zero``."""
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = df.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.filter(F.col("vec_id").isNotNull() & (F.size("v") > 0) & finite)
    return rows if zero else rows.filter(F.exists("v", lambda x: x != 0))


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Lists of one length as the rows of a matrix."""
    lists = plain(column)
    flat = plain(pc.list_flatten(lists)).to_numpy(zero_copy_only=False)
    return flat.reshape(len(lists), -1) if len(lists) else np.zeros((0, 0))


def best_of(found: DataFrame, k: int, *order: Column) -> DataFrame:
    """The first ``k`` rows of each ``query_id`` with their ``rank``; tasks keep no more than that before they exchange."""
    ranks = Window.partitionBy("query_id").orderBy(*order)
    return found.withColumn("rank", F.row_number().over(ranks)).filter(F.col("rank") <= k)


DOUBLE_MOST = np.finfo(np.float64).max
# Sums of squares of so many bits are exact in 64-bit integers for vectors of up to 128 components.
PLAIN_BITS = 27
LIMB = 32


def scaled(vectors: np.ndarray, scale: int) -> np.ndarray:
    """``floor(scale * x)`` as doubles, which hold it exactly; beyond a double's range it is cut to that."""
    with np.errstate(over="ignore"):
        return np.clip(np.floor(scale * vectors), -DOUBLE_MOST, DOUBLE_MOST)


def integers(whole: np.ndarray) -> np.ndarray:
    """Doubles without fraction as 64-bit integers, or as Python's if one of them is too large to be squared."""
    if np.abs(whole).max(initial=0) <= 2**PLAIN_BITS:
        return whole.astype(np.int64)
    return np.array([int(x) for x in whole.ravel().tolist()], object).reshape(whole.shape)


def limbs(values: dict[int, int]) -> tuple[list[int], list[int], list[int]]:
    """``(slot, limb, value)`` columns of integers of any size, in parts of 32 bits that add up as 64-bit numbers."""
    out: tuple[list[int], list[int], list[int]] = ([], [], [])
    for slot, value in values.items():
        left, limb = abs(value), 0
        while left:
            for column, x in zip(out, (slot, limb, (left & ((1 << LIMB) - 1)) * (1 if value > 0 else -1))):
                column.append(x)
            left, limb = left >> LIMB, limb + 1
    return out


def from_limbs(rows: list) -> dict[int, int]:
    """The sums by slot, from rows ``slot, limb, value``."""
    out: dict[int, int] = {}
    for slot, limb, value in rows:
        out[slot] = out.get(slot, 0) + (value << (LIMB * limb))
    return out
