"""Exact k-means by Shallot search.

Every vector keeps an upper bound of the distance to its centroid, a lower bound of the distance to
any other, and which centroid was second. Where the bounds no longer tell, the scan starts from the
closer of those two; it goes through the other centroids in the order of their distance from that
one, and the ball that can still hold a better one shrinks with every second-nearest that is found.
Whatever the ball lets through is compared by exact integer distances.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.chunks import plain
from millrace.llm.vectors import PLAIN_BITS, from_limbs, integers, limbs, matrix, scaled, usable
from millrace.plans.staging import stage

SCALE, CLUSTERS, ROUNDS, DIMENSIONS, SEED = 1024, 8, 10, 64, 3
LONG = (1 << 63) - 1
# Bounds are doubles; they decide only where they differ by more than this share.
SLACK = 1e-9


def _roots(squares: np.ndarray) -> np.ndarray:
    """Square roots of integers as doubles; those of numbers beyond doubles are taken in integers."""
    if squares.dtype == object:
        return np.array([float(math.isqrt(x)) if x >= 1 << 100 else math.sqrt(x) for x in squares.ravel()]).reshape(squares.shape)
    return np.sqrt(squares.astype(np.float64))


def _squares(differences: np.ndarray) -> np.ndarray:
    return (differences * differences).sum(-1)


@dataclass
class Centroids:
    """Centroids of one round, and what the search needs of them: for each one the others by distance,
    half the distance to the nearest, and how far it and any other moved since the last round.

    The driver holds the square of their number; the vectors never come there.
    """

    points: np.ndarray
    order: np.ndarray
    apart: np.ndarray
    half: np.ndarray
    moved: np.ndarray
    others_moved: np.ndarray

    @classmethod
    def of(cls, points: np.ndarray, before: np.ndarray | None = None) -> Centroids:
        k = len(points)
        between = np.stack([_roots(_squares(points - p)) for p in points])
        order = np.stack([[j, *(i for i in np.argsort(row, kind="stable") if i != j)] for j, row in enumerate(between)]).astype(np.int64)
        apart = np.take_along_axis(between, order, 1)
        moved = _roots(_squares(points - before)) if before is not None else np.zeros(k)
        others = np.array([np.delete(moved, j).max(initial=0.0) for j in range(k)])
        return cls(points, order, apart, apart[:, 1] / 2 if k > 1 else np.full(k, np.inf), moved, others)


@dataclass
class Bounds:
    """For each vector its nearest and second-nearest centroid and the bounds of their distances."""

    first: np.ndarray
    second: np.ndarray
    upper: np.ndarray
    lower: np.ndarray

    @classmethod
    def unknown(cls, rows: int) -> Bounds:
        return cls(np.zeros(rows, np.int64), np.ones(rows, np.int64), np.full(rows, np.inf), np.zeros(rows))


def _distances(vectors: np.ndarray, centroids: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """The exact squared distance of each vector to the centroid chosen for it."""
    return _squares(vectors - centroids[chosen])


def assign(vectors: np.ndarray, known: Bounds, c: Centroids) -> tuple[Bounds, int]:
    """The bounds after the centroids moved, and how many distances were computed.

    ``first`` is the nearest centroid, the smaller number among equally near ones.
    """
    k = len(c.points)
    first, second = known.first.copy(), known.second.copy()
    upper, lower = known.upper + c.moved[first], known.lower - c.others_moved[first]
    if k == 1:
        return Bounds(first, second, upper, np.full(len(first), np.inf)), 0
    unsure = lambda at: upper[at] * (1 + SLACK) >= np.maximum(lower[at], c.half[first[at]]) * (1 - SLACK)
    rows = np.flatnonzero(unsure(np.arange(len(first))))
    near = _distances(vectors[rows], c.points, first[rows])
    upper[rows] = _roots(near)
    still = unsure(rows)
    counted = len(rows)
    rows, near = rows[still], near[still]

    far = _distances(vectors[rows], c.points, second[rows])
    counted += len(rows)
    i1, i2 = first[rows], second[rows]
    swap = (far < near) | ((far == near) & (i2 < i1))
    i1, i2 = np.where(swap, i2, i1), np.where(swap, i1, i2)
    d1, d2 = np.where(swap, far, near), np.where(swap, near, far)
    start, asked, radius = i1.copy(), i2.copy(), _roots(d1)
    ball = radius + _roots(d2)
    open_rows = np.arange(len(rows))
    for place in range(1, k):
        open_rows = open_rows[c.apart[start[open_rows], place] * (1 - SLACK) <= ball[open_rows] * (1 + SLACK)]
        if not len(open_rows):
            break
        j = c.order[start[open_rows], place]
        new = open_rows[j != asked[open_rows]]
        j = j[j != asked[open_rows]]
        d = _distances(vectors[rows[new]], c.points, j)
        counted += len(new)
        best = (d < d1[new]) | ((d == d1[new]) & (j < i1[new]))
        runner = ~best & (d < d2[new])
        at, r = new[best], new[runner]
        i2[at], d2[at] = i1[at], d1[at]
        i1[at], d1[at] = j[best], d[best]
        i2[r], d2[r] = j[runner], d[runner]
        changed = new[best | runner]
        ball[changed] = radius[changed] + _roots(d2[changed])
    first[rows], second[rows] = i1, i2
    upper[rows], lower[rows] = _roots(d1), _roots(d2)
    return Bounds(first, second, upper, lower), counted


class _Sums:
    """Exact sums and numbers of the vectors of each cluster, as integers of any size."""

    def __init__(self, k: int, dimensions: int) -> None:
        self.totals = np.zeros((k, dimensions + 1), object)

    def add(self, vectors: np.ndarray, cluster: np.ndarray, sign: int) -> None:
        for j in np.unique(cluster):
            members = vectors[cluster == j]
            self.totals[j, :-1] += sign * members.sum(0).astype(object)
            self.totals[j, -1] += sign * len(members)

    def slots(self) -> dict[int, int]:
        return {i: int(x) for i, x in enumerate(self.totals.ravel()) if x}


STATE = "v array<double>, first int, second int, upper double, lower double, slot int, limb int, value long"
RESULT = "cluster int, distance long, slot int, limb int, value long"


def _kind(df: DataFrame) -> str:
    return dict(df.dtypes)["vec_id"]


def _filled(schema: pa.Schema, rows: int, **columns) -> pa.RecordBatch:
    """A batch with the given columns; the others are null."""
    arrays = [columns.get(f.name) for f in schema]
    return pa.RecordBatch.from_arrays([pa.nulls(rows, f.type) if a is None else pa.array(a, f.type) if not isinstance(a, pa.Array) else a for a, f in zip(arrays, schema)], schema=schema)


def _of_sums(schema: pa.Schema, sums: dict[int, int]) -> pa.RecordBatch:
    slot, limb, value = limbs(sums)
    return _filled(schema, len(slot), slot=slot, limb=limb, value=value)


def _added(rows: DataFrame) -> dict[int, int]:
    """The tasks' sums added up; the driver gets a few numbers for each centroid and dimension."""
    sums = rows.filter("slot is not null").groupBy("slot", "limb").agg(F.sum("value").alias("value"))
    return from_limbs([tuple(r) for r in sums.collect()])


def _round(state: DataFrame, c: Centroids, fresh: bool) -> DataFrame:
    """The vectors with new bounds, and in rows of their own how each task changes the clusters' sums."""
    shared = state.sparkSession.sparkContext.broadcast(c)
    id_type = _kind(state)

    def moved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, schema, sums = shared.value, None, _Sums(*shared.value.points.shape)
        for batch in batches:
            if not batch.num_rows:
                continue
            schema = schema or pa.schema([("vec_id", batch.schema.field("vec_id").type), ("v", pa.list_(pa.float64())), ("first", pa.int32()), ("second", pa.int32()), ("upper", pa.float64()), ("lower", pa.float64()), ("slot", pa.int32()), ("limb", pa.int32()), ("value", pa.int64())])
            whole = matrix(batch.column("v"))
            if fresh:
                whole = scaled(whole, SCALE)
                known = Bounds.unknown(len(whole))
            else:
                known = Bounds(*[plain(batch.column(n)).to_numpy().astype(t) for n, t in (("first", np.int64), ("second", np.int64), ("upper", np.float64), ("lower", np.float64))])
            vectors = integers(whole)
            now, _ = assign(vectors, known, c)
            changed = np.ones(len(whole), bool) if fresh else now.first != known.first
            sums.add(vectors[changed], now.first[changed], 1)
            if not fresh:
                sums.add(vectors[changed], known.first[changed], -1)
            offsets = pa.array(np.arange(len(whole) + 1, dtype=np.int32) * whole.shape[1])
            yield _filled(
                schema, len(whole), vec_id=plain(batch.column("vec_id")), v=pa.ListArray.from_arrays(offsets, pa.array(whole.ravel())),
                first=now.first.astype(np.int32), second=now.second.astype(np.int32), upper=now.upper, lower=now.lower,
            )
        if schema:
            yield _of_sums(schema, sums.slots())

    rows = state if fresh else state.filter("slot is null")
    columns = ["vec_id", "v"] if fresh else ["vec_id", "v", "first", "second", "upper", "lower"]
    return rows.select(*columns).mapInArrow(moved, f"vec_id {id_type}, {STATE}")


def _final(state: DataFrame, c: Centroids) -> DataFrame:
    """Each vector's cluster and exact squared distance, and the tasks' sums of these by cluster."""
    shared = state.sparkSession.sparkContext.broadcast(c)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, schema, totals = shared.value, None, {}
        for batch in batches:
            if not batch.num_rows:
                continue
            schema = schema or pa.schema([("vec_id", batch.schema.field("vec_id").type), ("cluster", pa.int32()), ("distance", pa.int64()), ("slot", pa.int32()), ("limb", pa.int32()), ("value", pa.int64())])
            vectors = integers(matrix(batch.column("v")))
            known = Bounds(*[plain(batch.column(n)).to_numpy().astype(t) for n, t in (("first", np.int64), ("second", np.int64), ("upper", np.float64), ("lower", np.float64))])
            now, _ = assign(vectors, known, c)
            distance = _distances(vectors, c.points, now.first).tolist()
            for j, d in zip(now.first.tolist(), distance):
                totals[j] = totals.get(j, 0) + d
            yield _filled(schema, len(vectors), vec_id=plain(batch.column("vec_id")), cluster=now.first.astype(np.int32), distance=[min(d, LONG) for d in distance])
        if schema:
            yield _of_sums(schema, totals)

    return state.filter("slot is null").select("vec_id", "v", "first", "second", "upper", "lower").mapInArrow(placed, f"vec_id {_kind(state)}, {RESULT}")


def first_centroids(kept: DataFrame, clusters: int, seed: int) -> np.ndarray:
    """The scaled vectors whose id hashes lowest with the seed; equal hashes by their components."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = kept.filter("vec_id is not null").select("v", key.alias("key")).orderBy("key", "v").limit(clusters).collect()
    return scaled(np.array([r["v"] for r in rows], np.float64), SCALE) if rows else np.zeros((0, 0))


def moved_centroids(points: np.ndarray, sums: dict[int, int]) -> np.ndarray:
    """The componentwise floor of every cluster's mean; an empty cluster's centroid stays."""
    k, d = points.shape
    out = points.astype(object)
    for j in range(k):
        if n := sums.get(j * (d + 1) + d, 0):
            out[j] = [sums.get(j * (d + 1) + i, 0) // n for i in range(d)]
    return _narrowed(out)


def _narrowed(points: np.ndarray) -> np.ndarray:
    """Python integers as 64-bit ones if all are small enough to be squared."""
    return points.astype(np.int64) if max((abs(x) for x in points.ravel()), default=0) <= 2**PLAIN_BITS else points


def cluster(
    df: DataFrame, id_col: str, vector_col: str, clusters: int = CLUSTERS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, seed: int = SEED
) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` of each vector of
    ``dimensions`` components; those with null or non-finite components are left out.

    Components become ``floor(1024 * x)``; all results are exact integers and the same in every run.
    A round is one pass without a shuffle of vectors: it reads the last round's table and writes
    vectors, bounds and each task's change of the clusters' sums, so a lost executor costs a part of
    one round. Only those sums, ``clusters`` x ``dimensions`` numbers, are exchanged and reach the
    driver. Rounds end early when no centroid moves, as the rest would change nothing.

    Rows without id are vectors like others, but never first centroids. Rows that repeat an id are
    vectors of their own, also as first centroids. With fewer vectors than ``clusters`` there are
    fewer centroids, and without any no rows. Distances and sums beyond 64 bits are compared exactly
    and returned as the largest long; products beyond a double's range are cut to it.
    """
    rows = usable(df.select(F.struct(F.col(id_col).alias("id")).alias("row"), F.col(vector_col).alias("v")), "row", "v", zero=True)
    kept = rows.filter(F.size("v") == dimensions).select(F.col("vec_id.id").alias("vec_id"), "v")
    points = integers(first_centroids(kept, clusters, seed))
    spark, kind = df.sparkSession, _kind(kept)
    if not len(points):
        return spark.createDataFrame([], f"vec_id {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    now, state, sums = Centroids.of(points), kept, {}
    for number in range(max(rounds, 1)):
        state = stage(_round(state, now, fresh=number == 0), f"clustering-{number}")
        for slot, change in _added(state).items():
            sums[slot] = sums.get(slot, 0) + change
        before, points = points, moved_centroids(points, sums) if rounds else points
        now = Centroids.of(points, before)
        if (points == before).all():
            break
    found = stage(_final(state, now), "clustering-final")
    inertia = _added(found)
    total = min(sum(inertia.values()), LONG)
    facts = [(j, min(inertia.get(j, 0), LONG), hashlib.sha256(",".join(str(int(x)) for x in p).encode()).hexdigest()) for j, p in enumerate(points)]
    per_cluster = spark.createDataFrame(facts, "cluster int, cluster_inertia long, centroid_sha256 string")
    placed = found.filter("slot is null").select("vec_id", "cluster", "distance")
    return placed.join(F.broadcast(per_cluster), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", F.lit(total).cast("long").alias("inertia"), "centroid_sha256")
