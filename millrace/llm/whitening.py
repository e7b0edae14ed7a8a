"""Whitening by Golub-Kahan-Lanczos bidiagonalisation of the centred rows.

With A the centred rows, left vectors u (one entry a row) and right vectors v (one entry a dimension)
are built in turn from A v and Aᵀ u, each made orthogonal to all earlier ones. As every u is A w for
some w, the driver keeps w, and a sweep over the rows recomputes their entries of u: nothing as long
as the table is stored, joined or sent. The singular vectors and values of the small bidiagonal
matrix give the components and their deviations.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.chunks import plain
from millrace.llm.vectors import from_limbs, limbs, matrix, scaled, usable
from millrace.plans.staging import stage

SCALE, OFFSET, COMPONENTS = 1024, 100_000, 8
LONG = (1 << 63) - 1
# Components beyond this are cut to it, so that sums and differences of two stay 64-bit.
MOST = 1 << 61
# A new direction shorter than this share of the longest is rounding, not data.
NOTHING = 1e-11
# A component is found when its residual is below this share of the largest deviation.
RESIDUAL = 1e-13


def whole(vectors: np.ndarray) -> np.ndarray:
    """``floor(1024 * c) + 100000`` as 64-bit integers."""
    return np.clip(scaled(vectors, SCALE), -float(MOST), float(MOST)).astype(np.int64) + OFFSET


@dataclass
class Centre:
    """Number of rows and exact sums by dimension, as quotient and rest of the means."""

    n: int
    sums: list[int]

    def __post_init__(self) -> None:
        self.quotient = np.array([s // self.n for s in self.sums], np.int64)
        self.rest = np.array([s % self.n for s in self.sums], object)
        self.fraction = np.array([r / self.n for r in self.rest])

    def centred(self, x: np.ndarray) -> np.ndarray:
        """``x - S / n``: the difference of integers is exact, and only the mean's fraction is rounded."""
        return (x - self.quotient).astype(np.float64) - self.fraction

    def deviations(self, x: np.ndarray) -> list[int]:
        """The sum of ``(n * x - S)²`` of each row, exact, and the largest long beyond 64 bits."""
        about = (self.n * self.centred(x)) ** 2
        total = about.sum(1)
        plain_rows = total < 2.0**62
        out = np.full(len(x), LONG, object)
        rest = self.rest.astype(np.int64) if self.n < 1 << 62 else self.rest
        exact = self.n * (x[plain_rows] - self.quotient) - rest
        out[plain_rows] = (exact * exact).sum(1).astype(object)
        for i in np.flatnonzero(~plain_rows & (total < 2.0**64)):
            out[i] = min(LONG, sum((self.n * int(a - q) - int(r)) ** 2 for a, q, r in zip(x[i].tolist(), self.quotient.tolist(), self.rest)))
        return out.tolist()


def _sums(rows: DataFrame) -> Centre | None:
    """Exact sums of all rows; a task hands on a few numbers for each dimension."""

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, int] = {}
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column("x"))
                # Halves of the numbers: sums of a batch stay 64-bit.
                high, low = (x >> 31).sum(0).tolist(), (x & ((1 << 31) - 1)).sum(0).tolist()
                for i, (a, b) in enumerate(zip([0, *high], [len(x), *low])):
                    total[i] = total.get(i, 0) + (a << 31) + b
        slot, limb, value = limbs(total)
        yield pa.RecordBatch.from_pydict({"slot": pa.array(slot, pa.int32()), "limb": pa.array(limb, pa.int32()), "value": pa.array(value, pa.int64())})

    found = rows.select("x").mapInArrow(added, "slot int, limb int, value long").groupBy("slot", "limb").agg(F.sum("value").alias("value"))
    sums = from_limbs([tuple(r) for r in found.collect()])
    dimensions = rows.select(F.size("x").alias("d")).first()
    return Centre(sums[0], [sums.get(i + 1, 0) for i in range(dimensions["d"])]) if sums else None


def _swept(rows: DataFrame, centre: Centre, made: callable) -> np.ndarray:
    """The sum over all rows of the numbers that ``made`` gives for a block of centred rows.

    A task adds up its own blocks first, so the exchange and the driver get one row per number.
    """
    shared = rows.sparkSession.sparkContext.broadcast(centre)

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                part = made(shared.value.centred(matrix(batch.column("x"))))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_pydict({"slot": pa.array(np.arange(len(total))), "value": pa.array(total)})

    found = rows.select("x").mapInArrow(added, "slot long, value double").groupBy("slot").agg(F.sum("value").alias("value")).toArrow().sort_by("slot")
    return found["value"].to_numpy()


@dataclass
class Bidiagonal:
    """``A V = U B`` so far: rows of ``v`` and of ``w`` (``u = A w``), ``Aᵀ u`` in ``back``, and B's
    ``alpha`` on and ``beta`` above the diagonal."""

    v: list[np.ndarray]
    w: list[np.ndarray]
    back: list[np.ndarray]
    alpha: list[float]
    beta: list[float]

    def svd(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Singular values, right singular vectors as rows, and residuals."""
        k = len(self.alpha)
        b = np.diag(self.alpha) + np.diag(self.beta[: k - 1], 1)
        left, values, right = np.linalg.svd(b)
        next_beta = self.beta[k - 1] if len(self.beta) >= k else 0.0
        return values, right @ np.array(self.v[:k]), np.abs(next_beta * left[-1])


def _orthogonal(x: np.ndarray, to: list[np.ndarray]) -> np.ndarray:
    if to:
        basis = np.array(to)
        for _ in range(2):
            x = x - basis.T @ (basis @ x)
    return x


def bidiagonalise(rows: DataFrame, centre: Centre, spread: float, components: int) -> Bidiagonal:
    """Steps until the components are found, with proof that none was missed, or the rows' space ends.

    ``spread`` is the sum of squares of all centred entries. What it holds beyond the squared values
    found bounds any value not seen yet; only when that is below the last component's is the
    search over, as repeated values may show late. A step is one sweep: it computes A v, its products
    with all earlier u, and Aᵀ A v; as ``Aᵀ u`` of the earlier ones is known, making u orthogonal
    corrects Aᵀ u without another sweep.
    """
    d = len(centre.quotient)
    random = np.random.default_rng(12)
    fresh = lambda done: _unit(_orthogonal(random.standard_normal(d), done))
    b = Bidiagonal([fresh([])], [], [], [], [])
    largest = np.sqrt(spread)
    if not largest:
        return b
    while True:
        q = b.v[-1].copy()
        if b.w:
            q = q - b.beta[-1] * b.w[-1]
        # Rows' entries of the earlier left vectors are those of A w; sums are scaled so as not to overflow.
        earlier = np.array(b.w).reshape(-1, d)

        def step(a: np.ndarray) -> np.ndarray:
            p = a @ q
            return np.concatenate([[p @ p], (a @ earlier.T).T @ p, a.T @ p])

        found = _swept(rows, centre, step)
        along, back = found[1 : 1 + len(earlier)], found[1 + len(earlier) :]
        # The part along earlier left vectors goes: from p, from its w, from its length and from Aᵀ p.
        w, length = q, found[0]
        if len(earlier):
            w = w - earlier.T @ along
            back = back - np.array(b.back).T @ along
            length = length - along @ along
        alpha = float(np.sqrt(max(length, 0.0)))
        if alpha <= NOTHING * largest:
            # v lies in the null space: it takes no part in B, and another direction is tried.
            b.alpha.append(0.0)
            b.w.append(np.zeros(d))
            b.back.append(np.zeros(d))
        else:
            b.alpha.append(alpha)
            b.w.append(w / alpha)
            b.back.append(back / alpha)
        if len(b.v) == d:
            return b
        right = _orthogonal(b.back[-1] - b.alpha[-1] * b.v[-1], b.v)
        beta = float(np.sqrt(right @ right))
        if beta <= NOTHING * largest:
            b.beta.append(0.0)
            b.v.append(fresh(b.v))
        else:
            b.beta.append(beta)
            b.v.append(right / beta)
        values, _, residuals = b.svd()
        if len(values) >= components:
            unseen = spread - float((values**2).sum())
            if (residuals[:components] <= RESIDUAL * values[0]).all() and unseen < values[components - 1] ** 2:
                return b


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt(x @ x)


@dataclass
class Whitening:
    """Unit eigenvectors (rows) of the covariance by falling ``variance``, and the share each explains."""

    centre: Centre
    vectors: np.ndarray
    variance: np.ndarray
    explained: np.ndarray

    def __call__(self, centred: np.ndarray) -> np.ndarray:
        return centred @ self.vectors.T / np.sqrt(self.variance)


def fit(rows: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """Components of all ``rows`` (columns ``x``); None without rows. Those of no deviation are left out."""
    centre = _sums(rows)
    if centre is None:
        return None
    d = len(centre.quotient)
    spread = float(_swept(rows, centre, lambda a: np.array([(a * a).sum()]))[0])
    b = bidiagonalise(rows, centre, spread, min(components, d))
    if not b.alpha:
        return Whitening(centre, np.zeros((0, d)), np.zeros(0), np.zeros(0))
    values, vectors, _ = b.svd()
    kept = np.flatnonzero(values > NOTHING * np.sqrt(spread))[:components]
    vectors = np.array([_unit(v) for v in vectors[kept]]).reshape(-1, d)
    # Either sign is right; the largest entry is positive, so that reruns agree.
    vectors = vectors * np.sign(vectors[np.arange(len(vectors)), np.abs(vectors).argmax(1)])[:, None]
    variance = values[kept] ** 2 / centre.n
    return Whitening(centre, vectors, variance, variance / (spread / centre.n))


def identity_error(rows: DataFrame, found: Whitening) -> float:
    """The largest absolute entry of the whitened rows' covariance minus the identity."""
    k, n = len(found.vectors), found.centre.n
    if not k:
        return 0.0

    def step(a: np.ndarray) -> np.ndarray:
        y = found(a)
        return np.concatenate([y.sum(0), (y.T @ y).ravel()])

    sums = _swept(rows, found.centre, step)
    mean = sums[:k] / n
    return float(np.abs(sums[k:].reshape(k, k) / n - np.outer(mean, mean) - np.eye(k)).max())


def integer_rows(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``vec_id, x`` of usable vectors, all of the length that most of them have (of the longest such)."""
    named = df.select(F.struct(F.col(id_col).alias("id")).alias("row"), F.col(vector_col).alias("v"))
    kept = usable(named, "row", "v", zero=True).select(F.col("vec_id.id").alias("vec_id"), "v")

    def turned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                lists = plain(batch.column("v"))
                x = whole(lists.flatten().to_numpy(zero_copy_only=False))
                yield pa.RecordBatch.from_arrays([plain(batch.column("vec_id")), pa.ListArray.from_arrays(lists.offsets, pa.array(x))], names=["vec_id", "x"])

    rows = stage(kept.mapInArrow(turned, f"vec_id {dict(kept.dtypes)['vec_id']}, x array<long>"), "whitening-rows")
    lengths = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows.filter(F.size("x") == lengths["d"]) if lengths else rows


def whiten(df: DataFrame, id_col: str, vector_col: str, components: int = COMPONENTS) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` for each vector and
    component; the components are fitted on all of them.

    Entries become ``floor(1024 * c) + 100000``, cut to 61 bits. Vectors that are null or empty or
    hold null or non-finite entries are left out; of vectors of several lengths, those of the most
    frequent length (the longer one if two are) take part. Rows without id are kept; repeated rows
    count as often as they occur. Components without deviation have no whitened value and are left
    out, so equal vectors, a single one and an empty table give no rows. ``deviation`` is exact, and
    the largest long beyond 64 bits. Sums of doubles are added in no fixed order, so the last digits
    of ``whitened`` may differ between runs.

    The integers are written once; each sweep reads them in the tasks of a plain scan, exchanges
    some numbers per dimension, and can be repeated after a lost executor. The driver holds matrices
    of the size of the dimensions, whatever the number of rows.
    """
    rows = integer_rows(df, id_col, vector_col)
    found = fit(rows, components)
    kind = f"vec_id {dict(rows.dtypes)['vec_id']}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if found is None:
        return df.sparkSession.createDataFrame([], kind)
    shared = df.sparkSession.sparkContext.broadcast((found, identity_error(rows, found)))

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, error = shared.value
        k = len(found.vectors)
        for batch in batches:
            if batch.num_rows and k:
                x = matrix(batch.column("x"))
                row, n = np.repeat(np.arange(len(x)), k), len(x) * k
                columns = {
                    "vec_id": plain(batch.column("vec_id")).take(pa.array(row)),
                    "component": pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                    "n": pa.array(np.full(n, found.centre.n)),
                    "deviation": pa.array(found.centre.deviations(x), pa.int64()).take(pa.array(row)),
                    "whitened": pa.array(found(found.centre.centred(x)).ravel()),
                    "explained": pa.array(np.tile(found.explained, len(x))),
                    "identity_error": pa.array(np.full(n, error)),
                }
                yield pa.RecordBatch.from_pydict(columns)

    return rows.mapInArrow(projected, kind)
