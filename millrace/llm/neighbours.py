"""Approximate nearest neighbours by stable projections, a kd-tree and a chi-square stopping test.

Vectors are projected to a few dimensions by a Gaussian matrix, whose squared projected distance,
over the true squared distance, follows a chi-square distribution. A kd-tree over the projections
gives the neighbours in the projection nearest first; each is verified on the original vectors, and
a query stops when an unseen point that is nearer than its k-th best would have shown up already
with the wanted probability. The upper part of the tree deals the points to cells, one for each
group of tasks' rows; the lower part is built within a cell.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.chunks import plain
from millrace.llm.vectors import best_of, matrix, usable
from millrace.plans.staging import stage

DIMENSIONS = 8
CERTAINTY = 0.99
CELL_ROWS = 4096
MOST_CELLS = 65536
# Expected number of projected points that the upper tree is fitted on.
SAMPLE_ROWS = 50_000
LEAF_ROWS = 32
QUERY_ROWS = 4096
SEED = 11


def chi_square(x: float, degrees: int) -> float:
    """Cumulative chi-square probability for an even number of degrees."""
    half = x / 2
    return 1 - math.exp(-half) * sum(half**i / math.factorial(i) for i in range(degrees // 2))


def stop_ratio(certainty: float, degrees: int) -> float:
    """The squared projected over squared true distance that is reached with probability ``certainty``."""
    low, high = 0.0, 1000.0
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (low, middle) if chi_square(middle, degrees) >= certainty else (middle, high)
    return high


def projection(size: int, dimensions: int, seed: int) -> np.ndarray:
    """The same Gaussian matrix for vectors of one size, wherever it is made."""
    return np.random.default_rng([seed, size]).standard_normal((size, dimensions))


@dataclass
class Cells:
    """The upper tree: nodes with a split plane, or the number of a cell."""

    axis: np.ndarray
    value: np.ndarray
    child: np.ndarray
    cell: np.ndarray
    count: int

    @classmethod
    def fit(cls, points: np.ndarray, cells: int) -> Cells:
        axis, value, child, cell = [], [], [], []

        def grow(rows: np.ndarray, wanted: int) -> int:
            at = len(axis)
            axis.append(-1), value.append(0.0), child.append((-1, -1)), cell.append(-1)
            part = points[rows]
            widest = int(np.argmax(np.ptp(part, axis=0))) if len(rows) else 0
            if wanted > 1 and len(rows) > 1 and np.ptp(part[:, widest]) > 0:
                left = wanted // 2
                order = np.argsort(part[:, widest], kind="stable")
                middle = min(max(1, len(rows) * left // wanted), len(rows) - 1)
                cut = part[order[middle], widest]
                below = part[:, widest] < cut
                if below.any():
                    axis[at], value[at] = widest, float(cut)
                    child[at] = (grow(rows[below], left), grow(rows[~below], wanted - left))
                    return at
            cell[at] = sum(c >= 0 for c in cell)
            return at

        grow(np.arange(len(points)), cells)
        numbered = np.array(cell)
        return cls(np.array(axis), np.array(value), np.array(child), numbered, int((numbered >= 0).sum()))

    def of(self, points: np.ndarray) -> np.ndarray:
        """The cell of each point."""
        node = np.zeros(len(points), np.int64)
        while len(node) and (inner := self.axis[node] >= 0).any():
            rows = np.flatnonzero(inner)
            n = node[rows]
            node[rows] = self.child[n, (points[rows, self.axis[n]] >= self.value[n]).astype(int)]
        return self.cell[node]


class Tree:
    """A kd-tree over the projected points of one cell, searched nearest box first."""

    def __init__(self, points: np.ndarray) -> None:
        self.rows: list[np.ndarray | None] = []
        self.low: list[np.ndarray] = []
        self.high: list[np.ndarray] = []
        self.children: list[tuple[int, int] | None] = []
        self._grow(points, np.arange(len(points)))
        self.bounds = np.array(self.low), np.array(self.high)

    def _grow(self, points: np.ndarray, rows: np.ndarray) -> int:
        at = len(self.rows)
        part = points[rows]
        self.low.append(part.min(0)), self.high.append(part.max(0))
        self.rows.append(rows), self.children.append(None)
        if len(rows) > LEAF_ROWS:
            order = rows[np.argpartition(part[:, np.argmax(self.high[at] - self.low[at])], len(rows) // 2)]
            self.children[at] = self._grow(points, order[: len(rows) // 2]), self._grow(points, order[len(rows) // 2 :])
            self.rows[at] = None
        return at

    def nearest_first(self, query: np.ndarray) -> Iterator[tuple[float, np.ndarray]]:
        """Leaves by rising squared distance of their box, with that distance."""
        low, high = self.bounds
        gaps = (np.maximum(np.maximum(low - query, query - high), 0.0) ** 2).sum(1)
        waiting = [(gaps[0], 0)]
        while waiting:
            gap, at = heapq.heappop(waiting)
            if self.rows[at] is not None:
                yield float(gap), self.rows[at]
            else:
                for c in self.children[at]:
                    heapq.heappush(waiting, (gaps[c], c))


def search(tree: Tree, vectors: np.ndarray, ids: list[list[int]], query: np.ndarray, shadow: np.ndarray, own: int, k: int, bound: float, ratio: float) -> list[tuple[float, int]]:
    """The ``k`` best ``(distance, id)`` of one cell, those beyond ``bound`` left out."""
    best: list[tuple[float, int]] = []
    for gap, rows in tree.nearest_first(shadow):
        if gap >= ratio * bound * bound and gap > 0:
            break
        distances = np.sqrt(((vectors[rows] - query) ** 2).sum(1))
        for i in np.flatnonzero(distances <= bound):
            best += [(float(distances[i]), x) for x in ids[rows[i]] if x != own]
        best = sorted(best)[:k]
        if len(best) == k:
            bound = min(bound, best[-1][0])
    return best


FOUND = "query_id {0}, vec_id {0}, score double"


def nearest(df: DataFrame, id_col: str, vector_col: str, queries: str, k: int = 10, certainty: float = CERTAINTY, dimensions: int = DIMENSIONS, cell_rows: int = CELL_ROWS, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest other rows found for each row that meets
    the SQL condition ``queries`` on ``vec_id``; smallest Euclidean distance first, ties to the smaller id.

    Equal vectors are one point with its ``k + 1`` smallest ids, so copies need no room and ties
    among them are exact. A query that repeats with the same vector is asked once. The upper tree is fitted on about ``sample_rows`` points; every row is
    indexed. A query first searches its own cell, and then, with the k-th distance found there, only
    the cells whose box the stopping test does not rule out. Neither cells nor the queries that meet
    one are ever all in one task. Vectors that are null, empty, zero or hold null or non-finite
    numbers and rows without id take no part; vectors of different sizes are never compared. With
    fewer than ``k`` other rows all are returned; without usable rows there are none.
    """
    points = usable(df, id_col, vector_col, zero=False)
    rank = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    merged = stage(
        points.withColumn("n", rank).filter(F.col("n") <= k + 1).groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")),
        "neighbours-points",
    )
    total = merged.count()
    wanted = max(1, min(MOST_CELLS, -(-total // cell_rows)))
    kind = dict(points.dtypes)["vec_id"]

    share = min(1.0, sample_rows / max(total, 1))
    picked = merged.filter(F.pmod(F.xxhash64("v"), F.lit(1 << 30)) < int(share * (1 << 30)))
    sample = _projected(picked, dimensions).toArrow()
    shadows = matrix(sample["shadow"])
    cells = Cells.fit(shadows if len(shadows) else np.zeros((1, dimensions)), wanted)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shadow = matrix(batch.column(1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells.of(shadow) if len(shadow) else np.zeros(0, np.int64))], names=["v", "shadow", "ids", "cell"])

    placed = stage(
        _projected(merged, dimensions).mapInArrow(dealt, f"v array<double>, shadow array<double>, ids array<{kind}>, cell long").withColumn("size", F.size("v")),
        "neighbours-cells",
    )
    asked = stage(
        _projected(points.filter(queries).select("v", F.array("vec_id").alias("ids")).distinct(), dimensions)
        .mapInArrow(dealt, f"v array<double>, shadow array<double>, ids array<{kind}>, cell long")
        .select(F.col("ids")[0].alias("query_id"), "v", "shadow", "cell", F.size("v").alias("size")),
        "neighbours-queries",
    )
    parts = max(1, -(-asked.count() // QUERY_ROWS))
    ratio = stop_ratio(certainty, dimensions)

    # One row of 2 * dimensions numbers for each cell, of which there are MOST_CELLS at most.
    edges = [f(F.col("shadow")[i]).alias(f"{name}{i}") for name, f in (("low", F.min), ("high", F.max)) for i in range(dimensions)]
    boxes = placed.groupBy("size", "cell").agg(*edges).toArrow()
    box_size, box_cell = boxes["size"].to_numpy(), boxes["cell"].to_numpy()
    low, high = (np.stack([boxes[f"{name}{i}"].to_numpy() for i in range(dimensions)], 1) for name in ("low", "high"))

    # Beyond MOST_CELLS cells, a cell is searched in slices of about the same size.
    slices = max(1, -(-total // (wanted * cell_rows)))
    first = stage(_searched(placed, asked.withColumn("bound", F.lit(float("inf"))), parts, slices, k, ratio, kind), "neighbours-first")
    kth = best_of(first, k, F.col("score"), F.col("vec_id")).filter(F.col("rank") == k).select("query_id", F.col("score").alias("bound"))
    bounded = asked.join(kth, "query_id", "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf"))))

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = {n: batch.column(n) for n in batch.schema.names}
            shadow, bound = matrix(columns["shadow"]), columns["bound"].to_numpy()
            size, own = columns["size"].to_numpy(), columns["cell"].to_numpy()
            row, cell = [], []
            for i in range(batch.num_rows):
                gap = (np.maximum(np.maximum(low - shadow[i], shadow[i] - high), 0.0) ** 2).sum(1)
                near = (box_size == size[i]) & (box_cell != own[i]) & ((gap < ratio * bound[i] ** 2) | (gap == 0))
                cell.append(box_cell[near])
                row.append(np.full(int(near.sum()), i))
            taken = batch.take(pa.array(np.concatenate(row or [np.zeros(0, int)])))
            at = batch.schema.get_field_index("cell")
            yield taken.set_column(at, "cell", pa.array(np.concatenate(cell or [np.zeros(0, np.int64)]), pa.int64()))

    others = _searched(placed, bounded.mapInArrow(routed, bounded.schema), parts, slices, k, ratio, kind)
    found = best_of(first.union(others), k, F.col("score"), F.col("vec_id"))
    return found.select("query_id", "rank", "vec_id", "score")


def _projected(rows: DataFrame, dimensions: int) -> DataFrame:
    """``v, shadow, ids`` with the projection of each vector."""

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = plain(batch.column(0))
            sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
            shadow = np.zeros((len(lists), dimensions))
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                shadow[at] = matrix(lists.take(pa.array(at))) @ projection(int(size), dimensions, SEED)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(lists) + 1, dtype=np.int32) * dimensions), pa.array(shadow.reshape(-1)))
            yield pa.RecordBatch.from_arrays([lists, flat, batch.column(1)], names=["v", "shadow", "ids"])

    return rows.select("v", "ids").mapInArrow(project, f"v array<double>, shadow array<double>, ids {dict(rows.dtypes)['ids']}")


def _searched(placed: DataFrame, asked: DataFrame, parts: int, slices: int, k: int, ratio: float, kind: str) -> DataFrame:
    """Search each query in the cell it names, many queries of a cell in parts, many points in slices."""
    asked = asked.withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(parts)) * slices)
    if slices > 1:
        asked = asked.withColumn("part", F.explode(F.sequence(F.col("part"), F.col("part") + slices - 1)))
    # A cell's points go once to each part of the queries that need them.
    needed = asked.select("size", "cell", F.col("part").alias("piece")).distinct()
    points = placed.join(needed, ["size", "cell"]).filter(F.pmod(F.xxhash64("v"), F.lit(slices)) == F.col("piece") % slices)

    def both(points: pa.Table, asked: pa.Table) -> pa.Table:
        out: list[tuple[int, float, int]] = []
        if points.num_rows and asked.num_rows:
            vectors, shadows, ids = matrix(points["v"]), matrix(points["shadow"]), points["ids"].to_pylist()
            tree = Tree(shadows)
            names, bounds = asked["query_id"].to_pylist(), asked["bound"].to_pylist()
            for i, (query, shadow) in enumerate(zip(matrix(asked["v"]), matrix(asked["shadow"]))):
                out += [(names[i], score, x) for score, x in search(tree, vectors, ids, query, shadow, names[i], k, bounds[i], ratio)]
        id_type = points.schema.field("ids").type.value_type
        return pa.table({"query_id": pa.array([o[0] for o in out], id_type), "vec_id": pa.array([o[2] for o in out], id_type), "score": pa.array([o[1] for o in out], pa.float64())})

    return points.groupBy("size", "cell", "piece").cogroup(asked.groupBy("size", "cell", "part")).applyInArrow(both, FOUND.format(kind))
