"""Distributions, statistics and grouped rates."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.quality import nan_to_null
from millrace.plans.ordered import exact_percentiles, join_on_groups

QUARTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}


def _long(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """``(*keep, column, value double)``, one row per value."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns])
    return df.select(*keep, F.explode(cells).alias("_cell")).select(*keep, "_cell.column", "_cell.value")


def _statistics_rows(aggregated: DataFrame, columns: Sequence[str], names: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Turn one wide row per group (``<statistic>__<column>``) into one row per column."""
    cells = F.array(*[
        F.struct(F.lit(c).alias("column"), *[F.col(f"{s}__{c}").alias(s) for s in names]) for c in columns
    ])
    return aggregated.select(*keep, F.explode(cells).alias("_cell")).select(*keep, "_cell.*")


def summary(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``(column, count, mean, stddev, min, max)`` of numeric and text columns in one pass.

    Minimum and maximum are given as text; mean and standard deviation of text columns are null.
    NaN counts as missing.
    """
    types = dict(df.dtypes)
    columns = [c for c in (columns or df.columns) if types[c] != "boolean"]
    numeric = {c for c in columns if types[c] in ("tinyint", "smallint", "int", "bigint", "float", "double") or types[c].startswith("decimal")}
    clean = nan_to_null(df, columns)
    wide = []
    for c in columns:
        mean, spread = (F.avg(c), F.stddev_samp(c)) if c in numeric else (F.lit(None), F.lit(None))
        wide += [
            F.count(c).alias(f"count__{c}"),
            mean.cast("double").alias(f"mean__{c}"),
            spread.cast("double").alias(f"stddev__{c}"),
            F.min(c).cast("string").alias(f"min__{c}"),
            F.max(c).cast("string").alias(f"max__{c}"),
        ]
    return _statistics_rows(clean.agg(*wide), columns, ["count", "mean", "stddev", "min", "max"])


def mean_and_stddev(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(column, mean, stddev)``; missing values (null or NaN) are left out."""
    wide = []
    for c in columns:
        wide += [F.avg(c).alias(f"mean__{c}"), F.stddev_samp(c).alias(f"stddev__{c}")]
    return _statistics_rows(nan_to_null(df, columns).agg(*wide), columns, ["mean", "stddev"])


def describe_by(df: DataFrame, group: str, columns: Sequence[str]) -> DataFrame:
    """``(group, column, count, mean, stddev, min, q1, median, q3, max)`` with exact quartiles.

    A group without any value of a column is listed with count 0 and nulls.
    """
    clean = nan_to_null(df, columns)
    wide = []
    for c in columns:
        value = F.col(c).cast("double")
        wide += [
            F.count(value).alias(f"count__{c}"), F.avg(value).alias(f"mean__{c}"),
            F.stddev_samp(value).alias(f"stddev__{c}"), F.min(value).alias(f"min__{c}"), F.max(value).alias(f"max__{c}"),
        ]
    basic = _statistics_rows(clean.groupBy(group).agg(*wide), columns, ["count", "mean", "stddev", "min", "max"], [group])
    quartiles = exact_percentiles(_long(clean, columns, [group]), "value", QUARTILES, [group, "column"])
    return join_on_groups(basic, quartiles, [group, "column"], "left")


def bucketize(column: Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Label of the right-closed interval a value falls in; null outside all of them.

    ``edges`` has one more entry than ``labels``; the last edge may be infinity.
    """
    if len(edges) != len(labels) + 1:
        raise ValueError("one more edge than labels is needed")
    label = F.lit(None).cast("string")
    for low, high, name in reversed(list(zip(edges, edges[1:], labels))):
        label = F.when((column > low) & (column <= high) & ~F.isnan(column), F.lit(name)).otherwise(label)
    return label


def bucket_counts(df: DataFrame, column: str, edges: Sequence[float], labels: Sequence[str]) -> DataFrame:
    """``(bucket, count)`` for every label, also for empty ones, highest count first."""
    wide = df.agg(*[F.count_if(bucketize(F.col(column), edges, labels) == name).alias(name) for name in labels])
    rows = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(n).alias("bucket"), F.col(f"`{n}`").alias("count")) for i, n in enumerate(labels)])
    return wide.select(F.explode(rows).alias("r")).orderBy(F.col("r.count").desc(), "r.i").select("r.bucket", "r.count")


def box_statistics(df: DataFrame, column: str, edges: Sequence[float], labels: Sequence[str]) -> DataFrame:
    """``(bucket, count, min, q1, median, q3, max, lower_whisker, upper_whisker)``.

    Whiskers are the outermost values within 1.5 interquartile ranges of the box.
    """
    bucketed = df.select(bucketize(F.col(column), edges, labels).alias("bucket"), F.col(column).alias("value")).filter("bucket is not null")
    boxes = exact_percentiles(bucketed, "value", QUARTILES, ["bucket"])
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    # There are only as many boxes as labels.
    rows = bucketed.join(F.broadcast(boxes), "bucket")
    inside = (F.col("value") >= F.col("q1") - reach) & (F.col("value") <= F.col("q3") + reach)
    return rows.groupBy("bucket", "q1", "median", "q3").agg(
        F.count("*").alias("count"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        F.min(F.when(inside, F.col("value"))).alias("lower_whisker"),
        F.max(F.when(inside, F.col("value"))).alias("upper_whisker"),
    )


def top_rows(df: DataFrame, column: str, n: int, tie_break: str) -> DataFrame:
    """The ``n`` rows with the largest values; missing values are never among them."""
    present = df.filter(F.col(column).isNotNull() & ~F.isnan(F.col(column).cast("double")))
    return present.orderBy(F.col(column).desc(), F.col(tie_break)).limit(n)


def points(df: DataFrame, x: str, y: str, *others: str) -> DataFrame:
    """The point set of a scatter chart."""
    return df.select(x, y, *others)


def point_bins(df: DataFrame, x: str, y: str, x_width: float, y_width: float) -> DataFrame:
    """``(x_bin, y_bin, count)``: a scatter chart of a large table as counts on a grid."""
    bins = df.select(F.floor(F.col(x) / x_width).alias("x_bin"), F.floor(F.col(y) / y_width).alias("y_bin"))
    return bins.groupBy("x_bin", "y_bin").agg(F.count("*").alias("count"))


def _extent(df: DataFrame, column: str) -> Column:
    """Count, range and spread of a column as a scalar subquery (one row by construction)."""
    value = F.col(column).cast("double")
    return df.agg(F.struct(
        F.count(value).alias("n"), F.min(value).alias("lo"), F.max(value).alias("hi"), F.stddev_samp(value).alias("sd")
    ).alias("extent")).scalar()


def _present(df: DataFrame, column: str) -> DataFrame:
    value = F.col(column).cast("double")
    return df.select(value.alias("value")).filter(value.isNotNull() & ~F.isnan(value))


def histogram(df: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """``(bin, lower, upper, count)``: equal widths, last bin closed, empty bins listed."""
    values = _present(df, column)
    extent = _extent(values, "value")
    low, width = extent["lo"], (extent["hi"] - extent["lo"]) / bins
    bin_of = F.when(width == 0, F.lit(0)).otherwise(
        F.least(F.floor((F.col("value") - low) / F.nullif(width, F.lit(0.0))), F.lit(bins - 1))
    )
    counts = values.groupBy(bin_of.cast("int").alias("bin")).agg(F.count("*").alias("count"))
    frame = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    # Both sides have at most `bins` rows.
    return frame.join(F.broadcast(counts), "bin", "left").select(
        "bin",
        (low + F.col("bin") * width).alias("lower"),
        (low + (F.col("bin") + 1) * width).alias("upper"),
        F.coalesce("count", F.lit(0).cast("long")).alias("count"),
    )


# Density: width of a bin and reach of a kernel in bandwidths, and moments kept for each bin. A kernel
# is the series of its bin's moments; what the series and the reach leave out is below 1e-12 of a peak.
_BIN, _REACH, _MOMENTS = 1 / 16, 9.0, 7


def _hermite(t: Column, moments: Sequence[Column]) -> Column:
    """``sum of moments[j] * He_j(t) / j!``, the kernels of a bin without their common factor."""
    below, here, total, factorial = F.lit(0.0), F.lit(1.0), moments[0], 1.0
    for j, moment in enumerate(moments[1:], 1):
        below, here = here, t * here - (j - 1) * below
        factorial *= j
        total = total + moment * here / factorial
    return total


def density(df: DataFrame, column: str, grid: int = 200) -> DataFrame:
    """``(point, x, density)``: Gaussian kernel estimate on an even grid, Scott's bandwidth.

    Values within reach of a grid point are counted in bins of a sixteenth of a bandwidth, with the
    moments of their places in the bin: tasks hand on some 300 bins for each grid point at most,
    whatever the table's size, and only those meet the grid points in their reach. The error is below
    1e-12 of one value's kernel at its peak.
    """
    values = _present(df, column)
    extent = values.agg(F.count("value"), F.min("value"), F.max("value"), F.stddev_samp("value")).first()
    n, low, high, spread = extent
    frame = df.sparkSession.range(grid if n else 0).select(F.col("id").alias("point"))
    step = (high - low) / max(grid - 1, 1) if n else 0.0
    x = (F.lit(low or 0.0) + F.col("point") * step).alias("x")
    # A constant column has no bandwidth, and so no density.
    if not spread:
        return frame.select(F.col("point").cast("int").alias("point"), x, F.lit(None).cast("double").alias("density"))
    h = spread * n**-0.2
    value = F.col("value")
    near = values.filter(F.abs(value - (low + F.round((value - low) / step) * step)) <= (_REACH + _BIN) * h)
    placed = near.withColumn("bin", F.floor((value - low) / (h * _BIN)))
    placed = placed.withColumn("u", (value - low) / h - (F.col("bin") + 0.5) * _BIN)
    power, powers = F.lit(1.0), []
    for j in range(_MOMENTS):
        powers.append(F.sum(power).alias(f"m{j}"))
        power = power * F.col("u")
    sums = placed.groupBy("bin").agg(*powers)
    middle = low + (F.col("bin") + 0.5) * _BIN * h
    first = F.greatest(F.ceil((middle - _REACH * h - low) / step), F.lit(0))
    last = F.least(F.floor((middle + _REACH * h - low) / step), F.lit(grid - 1))
    reached = sums.select("*", middle.alias("middle"), first.alias("first"), last.alias("last")).filter("first <= last")
    pairs = reached.withColumn("point", F.explode(F.sequence("first", "last")))
    t = (low + F.col("point") * step - F.col("middle")) / h
    kernel = F.exp(-F.col("t") * F.col("t") / 2) * _hermite(F.col("t"), [F.col(f"m{j}") for j in range(_MOMENTS)])
    curve = pairs.withColumn("t", t).groupBy("point").agg(F.sum(kernel).alias("k"))
    # Both sides have at most `grid` rows.
    points = frame.join(F.broadcast(curve), "point", "left")
    scale = n * h * math.sqrt(2 * math.pi)
    return points.select(F.col("point").cast("int").alias("point"), x, (F.coalesce("k", F.lit(0.0)) / scale).alias("density"))


def mean_by(df: DataFrame, group: Column | str, means: dict[str, str]) -> DataFrame:
    """Group means; ``means`` maps output names to columns."""
    key = F.col(group) if isinstance(group, str) else group
    return nan_to_null(df, list(means.values())).groupBy(key).agg(*[F.avg(c).alias(n) for n, c in means.items()])


def group_rates(df: DataFrame, group: str, means: dict[str, str], flag: str) -> DataFrame:
    """Per group: means, ``total``, ``flagged`` (``flag == 1``) and ``rate``."""
    rates = nan_to_null(df, list(means.values())).groupBy(group).agg(
        *[F.avg(c).alias(n) for n, c in means.items()],
        F.count("*").alias("total"),
        F.count_if(F.col(flag) == 1).alias("flagged"),
    )
    return rates.withColumn("rate", F.col("flagged") / F.col("total"))


def ranked_means(df: DataFrame, group: str, value: str, name: str) -> DataFrame:
    """Group means, highest first."""
    return mean_by(df, group, {name: value}).orderBy(F.col(name).desc_nulls_last(), F.col(group))


def hour_of_day(clock: Column, fold_midnight: bool = False) -> Column:
    """Hour of an HHMM integer; 2400 is hour 24 unless folded to 0."""
    hour = F.floor(clock / 100).cast("int")
    return hour % 24 if fold_midnight else hour


def weekday(date: Column) -> Column:
    """Day of the week, Monday = 0."""
    return F.weekday(date)


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(a, b, r)`` for all ordered pairs: Pearson correlation over rows that have both values.

    A row becomes one vector: whether each value is there, the value, and its square, 0 where it is
    missing. The Gramian of these vectors holds every pair's count, sums, squares and products over
    its common rows. Rows are read once and added up per task; what is exchanged, and what the driver
    gets, is the square of three times the columns. Values are shifted by those of one row, which
    keeps sums small where columns lie far from 0.
    """
    clean = nan_to_null(df.select(*columns)).select(*[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(columns)])
    d, some = len(columns), clean.first()
    names = [(a, b) for a in range(d) for b in range(d)]
    if some is None:
        return df.sparkSession.createDataFrame([(columns[a], columns[b], None) for a, b in names], "a string, b string, r double")
    shift = [x or 0.0 for x in some]
    here = [F.col(f"x{i}").isNotNull().cast("double") for i in range(d)]
    value = [F.coalesce(F.col(f"x{i}") - F.lit(shift[i]), F.lit(0.0)) for i in range(d)]
    vectors = clean.select(array_to_vector(F.array(*here, *value, *[v * v for v in value])).alias("row"))
    gram = RowMatrix(MLUtils.convertVectorColumnsFromML(vectors, "row")).computeGramianMatrix().toArray()

    def r(a: int, b: int) -> float | None:
        n, x, y = gram[a, b], gram[d + a, b], gram[a, d + b]
        if n < 2:
            return None
        spread = (gram[2 * d + a, b] - x * x / n) * (gram[a, 2 * d + b] - y * y / n)
        return max(-1.0, min(1.0, float((gram[d + a, d + b] - x * y / n) / math.sqrt(spread)))) if spread > 0 else None

    return df.sparkSession.createDataFrame([(columns[a], columns[b], r(a, b)) for a, b in names], "a string, b string, r double")


def correlation_with(df: DataFrame, columns: Sequence[str], target: str) -> DataFrame:
    """One row ``corr_<column>`` with the correlation of each column with ``target``."""
    clean = nan_to_null(df.select(*columns, target))
    return clean.agg(*[F.corr(c, target).alias(f"corr_{c}") for c in columns])
