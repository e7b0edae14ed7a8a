"""Order-dependent results (positions, running totals, exact quantiles) without a one-task sort.

A window without partition keys, or with one huge partition, runs in a single task. Here rows are
range-partitioned by the order, totalled per slice, and shifted by the totals of earlier slices.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.plans.staging import stage


def join_on_groups(rows: DataFrame, per_group: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on ``keys`` that also matches null keys and keeps one copy of them."""
    renamed = per_group.withColumnsRenamed({k: f"_at_{k}" for k in keys})
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_at_{k}")) for k in keys])
    return rows.join(renamed, same, how).drop(*[f"_at_{k}" for k in keys])


def running_totals(
    df: DataFrame,
    order_by: Sequence[Column],
    sums: Sequence[str],
    group_by: Sequence[str] = (),
    slices: int | None = None,
) -> DataFrame:
    """Add per group ``<c>_upto``, the inclusive running sum of each column in ``sums``, and
    ``<c>_all``, its sum over the whole group.

    ``order_by`` must be unique within a group. Slices are ranges of ``(group, order)``, so one
    group or key holding most rows is cut into many slices. The slice number is written with the
    rows because a second evaluation could cut the ranges elsewhere.
    """
    spark = df.sparkSession
    slices = slices or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(slices, *[F.col(g) for g in group_by], *order_by)
    rows = stage(ranged.withColumn("_slice", F.spark_partition_id()), "ranged")

    keys = ["_slice", *group_by]
    upto = Window.partitionBy(*keys).orderBy(*order_by).rowsBetween(Window.unboundedPreceding, 0)
    within = rows.select("*", *[F.sum(c).over(upto).alias(f"_{c}_within") for c in sums])

    # At most (slices + groups) rows; the window below sees at most `slices` rows per group.
    totals = rows.groupBy(*keys).agg(*[F.sum(c).alias(f"_{c}_total") for c in sums])
    group = Window.partitionBy(*group_by)
    earlier = group.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    shifts = totals.select(
        *keys,
        *[F.coalesce(F.sum(f"_{c}_total").over(earlier), F.lit(0)).alias(f"_{c}_shift") for c in sums],
        *[F.sum(f"_{c}_total").over(group).alias(f"{c}_all") for c in sums],
    )
    return join_on_groups(within, shifts, keys).select(
        *df.columns,
        *[(F.col(f"_{c}_within") + F.col(f"_{c}_shift")).alias(f"{c}_upto") for c in sums],
        *[f"{c}_all" for c in sums],
    )


def row_positions(df: DataFrame, order_by: Sequence[Column], name: str, slices: int | None = None) -> DataFrame:
    """Add the 0-based position of each row in a unique total order.

    The rows are exchanged once: sorted ranges number their own rows, and the sizes of the ranges
    before give the shift. Sizes come from the same exchange, so both sides see the same ranges; all
    columns are hashed into them only to keep the two exchanges alike. One row per range is broadcast.
    A session that does not reuse exchanges gets positions from :func:`running_totals`.
    """
    if df.sparkSession.conf.get("spark.sql.exchange.reuse", "true").lower() != "true":
        totals = running_totals(df.withColumn("_one", F.lit(1).cast("long")), order_by, ["_one"], slices=slices)
        return totals.select((F.col("_one_upto") - 1).alias(name), *df.columns)
    slices = slices or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(slices, *order_by).sortWithinPartitions(*order_by)
    # A partition's number stands above the lowest 33 bits, the place of a row in it below.
    placed = ranged.withColumn("_id", F.monotonically_increasing_id())
    sizes = placed.groupBy(F.shiftright("_id", 33).alias("_part")).agg(F.count("*").alias("_n"), F.max(F.xxhash64(*df.columns)).alias("_all"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_shift"), "_all")
    joined = placed.withColumn("_part", F.shiftright("_id", 33)).join(F.broadcast(shifts), "_part")
    position = F.col("_shift") + F.col("_id").bitwiseAND((1 << 33) - 1)
    return joined.filter(F.col("_all").isNotNull()).select(position.alias(name), *df.columns)


def _with_brackets(rows: DataFrame, brackets: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Each row with each of its group's brackets; without groups there are as many as probabilities, and they become literals."""
    if groups:
        return join_on_groups(rows, brackets, groups)
    cells = [F.struct(*[F.lit(x).cast(f.dataType).alias(f.name) for x, f in zip(row, brackets.schema)]) for row in brackets.collect()]
    kind = f"array<{brackets.schema.simpleString()}>"
    return rows.select("*", F.explode(F.array(*cells) if cells else F.array().cast(kind)).alias("_q")).select(*rows.columns, "_q.*")


def _picked(present: DataFrame, here: Sequence[str], group_by: Sequence[str], probabilities: dict[str, float]) -> DataFrame:
    """Quantiles of groups that are small enough to be sorted by value in a task."""
    counted = present.groupBy(*here, "_v").agg(F.count("*").alias("_n"))
    group = Window.partitionBy(*here)
    upto = group.orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    placed = counted.select("*", F.sum("_n").over(upto).alias("_end"), F.sum("_n").over(group).alias("_all"))
    start, end, sides = F.col("_end") - F.col("_n"), F.col("_end"), []
    for name, p in probabilities.items():
        rank = (F.col("_all") - 1) * F.lit(float(p))
        at = lambda index: F.max(F.when((start <= index) & (index < end), F.col("_v")))
        sides += [at(F.floor(rank)).alias(f"{name}_a"), at(F.ceil(rank)).alias(f"{name}_b"), F.max(rank - F.floor(rank)).alias(f"{name}_part")]
    edges = placed.groupBy(*here).agg(*sides)
    between = lambda n: F.col(f"{n}_a") + (F.col(f"{n}_b") - F.col(f"{n}_a")) * F.col(f"{n}_part")
    return edges.select(*[F.col(h).alias(g) for h, g in zip(here, group_by)], *[between(n).alias(n) for n in probabilities])


# Values of a group among which a quantile is picked by sorting; more are bracketed first.
SELECT_ROWS = 1 << 20
# Steps of a bracket's sketch, and the accuracy that makes a step's rank certain.
_STEPS, _ACCURACY = 64, 10_000


def exact_percentiles(
    df: DataFrame,
    value: str,
    probabilities: dict[str, float],
    group_by: Sequence[str] = (),
    select_rows: int = SELECT_ROWS,
) -> DataFrame:
    """Linearly interpolated quantiles per group; one output column per entry of ``probabilities``.

    A quantile is enclosed by two values. While more than ``select_rows`` of a group's rows lie
    between them, a sketch of those narrows the bracket to about a twentieth. Then the rows
    inside are counted by value and those below as a number, and the rank is picked among them: no
    task sorts more than ``select_rows`` distinct values, and no table of values is written. Null and
    NaN are left out.
    """
    # A step has to be some rows wide.
    select_rows = max(select_rows, 8 * _STEPS)
    here = [f"_g{i}" for i in range(len(group_by))]
    present = df.filter(F.col(value).isNotNull() & ~F.isnan(value)).select(
        *[F.col(g).alias(h) for g, h in zip(group_by, here)], F.col(value).alias("_v")
    )
    sizes = present.groupBy(*here).agg(F.count("*").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    most = sizes.agg(F.max("_n")).first()[0] or 0
    if most <= select_rows:
        return _picked(present, here, group_by, probabilities)
    ranks = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), F.lit(float(p)).alias("p")) for name, p in probabilities.items()]))
    wanted = sizes.select(*here, "_n", "_lo", "_hi", ranks.alias("_q")).select(*here, "_n", "_lo", "_hi", "_q.*")
    # Below: rows under the bracket; inside: rows within it.
    wanted = wanted.select(*here, "name", ((F.col("_n") - 1) * F.col("p")).alias("_rank"), "_lo", "_hi", F.lit(0).cast("long").alias("_below"), F.col("_n").alias("_inside"), F.lit(True).alias("_open"))
    brackets = stage(wanted, "brackets")
    keys = [*here, "name"]
    while brackets.filter(F.col("_open") & (F.col("_inside") > select_rows) & (F.col("_lo") < F.col("_hi"))).limit(1).count():
        within = _with_brackets(present, brackets, here)
        inside = (F.col("_v") >= F.col("_lo")) & (F.col("_v") <= F.col("_hi"))
        steps = F.percentile_approx("_v", [i / _STEPS for i in range(_STEPS + 1)], _ACCURACY)
        sketched = within.filter(inside).groupBy(*keys).agg(steps.alias("_steps"))
        # The place of the rank among the steps, and a step more on either side for the sketch's error.
        place = F.floor((F.col("_rank") - F.col("_below")) / F.col("_inside") * _STEPS).cast("int")
        narrow = join_on_groups(brackets, sketched, keys).select(
            *keys, "_rank", F.col("_inside").alias("_last"),
            F.greatest("_lo", F.get("_steps", F.greatest(place - 1, F.lit(0)))).alias("_lo"),
            F.least("_hi", F.get("_steps", F.least(place + 3, F.lit(_STEPS)))).alias("_hi"),
        )
        narrow = stage(narrow, "brackets")
        within = _with_brackets(present, narrow, here)
        counted = within.groupBy(*keys).agg(
            F.count_if(F.col("_v") < F.col("_lo")).alias("_below"), F.count_if((F.col("_v") >= F.col("_lo")) & (F.col("_v") <= F.col("_hi"))).alias("_inside")
        )
        # A bracket that hardly narrowed holds a few values many times; they are counted, not sorted.
        closed = join_on_groups(narrow, counted, keys).withColumn("_open", F.col("_inside") < 0.9 * F.col("_last"))
        brackets = stage(closed.drop("_last"), "brackets")

    within = _with_brackets(present, brackets, here)
    chosen = within.filter((F.col("_v") >= F.col("_lo")) & (F.col("_v") <= F.col("_hi")))
    counted = chosen.groupBy(*keys, "_rank", "_below", "_v").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_v")
    placed = counted.withColumn("_end", F.col("_below") + F.sum("_n").over(before))
    start, end = F.col("_end") - F.col("_n"), F.col("_end")
    low, high = F.floor("_rank"), F.ceil("_rank")
    holds = lambda index: F.max(F.when((start <= index) & (index < end), F.col("_v")))
    picked = placed.groupBy(*keys, "_rank").agg(holds(low).alias("_a"), holds(high).alias("_b"))
    found = picked.withColumn("_x", F.col("_a") + (F.col("_b") - F.col("_a")) * (F.col("_rank") - F.floor("_rank")))
    wide = found.groupBy(*here).agg(*[F.max(F.when(F.col("name") == n, F.col("_x"))).alias(n) for n in probabilities])
    return wide.select(*[F.col(h).alias(g) for g, h in zip(group_by, here)], *probabilities)
