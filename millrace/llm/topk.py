"""Exact top-k search by inner product, with bounds from segment statistics, coarse to fine.

A vector is cut into segments; from the means and deviations of two vectors' segments follow a
lower and an upper bound of their inner product (equivalently, bounds of their distance). Candidates
whose upper bound is below the k-th best lower bound are dropped, finer segments are tried on the
rest, and the survivors are computed exactly.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.vectors import best_of, matrix, scaled, usable

SCALE = 256
LEVELS = (2, 8, 16)
BLOCK_ROWS = 8192
QUERY_ROWS = 4096
TOGETHER = 128
LONG = (1 << 63) - 1


def statistics(vectors: np.ndarray, segments: int) -> np.ndarray:
    """For each vector the means of its segments and then their deviations, both times the root of
    the segment's length."""
    edges = np.linspace(0, vectors.shape[1], min(segments, vectors.shape[1]) + 1).astype(int)
    length = np.diff(edges)
    mean = np.add.reduceat(vectors, edges[:-1], axis=1) / length
    square = np.add.reduceat(vectors**2, edges[:-1], axis=1) / length
    deviation = np.sqrt(np.maximum(square - mean**2, 0.0))
    return np.concatenate([mean * np.sqrt(length), deviation * np.sqrt(length)], axis=1)


def _exact(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Integer inner products; beyond what a double holds exactly, by integers of any size."""
    with np.errstate(over="ignore"):
        most = np.abs(vectors).max(initial=0) * np.abs(query).max(initial=0) * len(query)
    if most < 2**53:
        return (vectors @ query).astype(np.int64)
    whole = [int(x) for x in query]
    sums = [sum(int(a) * b for a, b in zip(row, whole)) for row in vectors.tolist()]
    return np.array([min(max(s, -LONG - 1), LONG) for s in sums], np.int64)


def best_in_block(vectors: np.ndarray, ids: np.ndarray, queries: np.ndarray, names: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """``(query, id, score)`` of the ``k`` best other rows of a block for each query; ties to the smaller id."""
    # Squares of larger numbers leave the range of doubles; there every candidate is computed exactly.
    bounded = max(np.abs(vectors).max(initial=0), np.abs(queries).max(initial=0)) < 1e140
    levels = [(statistics(vectors, n), statistics(queries, n)) for n in LEVELS] if bounded else []
    # Sums of squares and products are rounded; the bounds are widened by more than that.
    with np.errstate(over="ignore"):
        slack = 1e-9 * np.sqrt((vectors**2).sum(1).max(initial=0)) * np.sqrt((queries**2).sum(1)) + 0.5
    out = []
    for start in range(0, len(queries), TOGETHER):
        rows = slice(start, start + TOGETHER)
        if bounded:
            half = levels[0][0].shape[1] // 2
            mean = levels[0][1][rows, :half] @ levels[0][0][:, :half].T
            spread = levels[0][1][rows, half:] @ levels[0][0][:, half:].T
        for i in range(len(queries[rows])):
            q = start + i
            left = np.flatnonzero(ids != names[q])
            if bounded:
                middle, wide = mean[i, left], spread[i, left]
            for level in range(len(levels)):
                if level:
                    stats, of_query = levels[level][0][left], levels[level][1][q]
                    half_now = stats.shape[1] // 2
                    middle, wide = stats[:, :half_now] @ of_query[:half_now], stats[:, half_now:] @ of_query[half_now:]
                if len(left) > k:
                    lower = middle - wide
                    least = np.partition(lower, len(left) - k)[len(left) - k]
                    left = left[middle + wide + 2 * slack[q] >= least]
            scores = _exact(vectors[left], queries[q])
            order = np.lexsort((ids[left], -scores.astype(object) if len(scores) and scores.min() == -LONG - 1 else -scores))[:k]
            out += [(int(names[q]), int(ids[left][j]), int(scores[j])) for j in order]
    return out


def search(df: DataFrame, id_col: str, vector_col: str, queries: str, k: int = 5, scale: int = SCALE, block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` highest integer inner products of each row that
    meets the SQL condition ``queries`` on ``vec_id`` with the other rows; ties to the smaller id.

    Components become ``floor(scale * x)``. Queries and candidates meet in blocks of bounded size,
    each block pair in one task, and only ``k`` rows of a query leave it. Null and empty vectors,
    vectors with null or non-finite components and rows without id take no part; zero vectors do;
    vectors of different sizes are never compared. Equal vectors are ranked by id; rows that repeat
    an id are candidates of their own, except for a query of that id. With fewer than ``k`` other rows
    all are returned. A query that repeats with the same vector is asked once. Scores beyond 64 bits
    are cut to their range, and ``scale * x`` to that of doubles.
    """
    points = usable(df, id_col, vector_col, zero=True).withColumn("size", F.size("v"))
    blocks = max(1, -(-points.count() // block_rows))
    asked = points.filter(queries).distinct()
    parts = max(1, -(-asked.count() // query_rows))
    number = lambda n: F.sequence(F.lit(0), F.lit(n - 1))
    dealt = F.xxhash64("vec_id", "v")
    candidates = points.select("vec_id", "v", "size", F.pmod(dealt, F.lit(blocks)).cast("int").alias("block"), F.explode(number(parts)).alias("part"))
    wanted = asked.select(
        F.col("vec_id").alias("query_id"), F.col("v").alias("query"), F.col("size").alias("q_size"),
        F.explode(number(blocks)).alias("q_block"), F.pmod(dealt, F.lit(parts)).cast("int").alias("q_part"),
    )

    def both(candidates: pa.Table, wanted: pa.Table) -> pa.Table:
        found: list[tuple[int, int, int]] = []
        if candidates.num_rows and wanted.num_rows:
            found = best_in_block(
                scaled(matrix(candidates["v"]), scale), candidates["vec_id"].to_numpy(), scaled(matrix(wanted["query"]), scale), wanted["query_id"].to_numpy(), k
            )
        return pa.table({n: pa.array([f[i] for f in found], pa.int64()) for i, n in enumerate(("query_id", "vec_id", "score"))})

    found = candidates.groupBy("size", "block", "part").cogroup(wanted.groupBy("q_size", "q_block", "q_part")).applyInArrow(both, "query_id long, vec_id long, score long")
    return best_of(found, k, F.col("score").desc(), F.col("vec_id")).select("query_id", "rank", "vec_id", "score")
