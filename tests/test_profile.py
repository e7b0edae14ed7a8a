import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import profile

EDGES = [0.0, 100.0, 200.0, 300.0, 400.0, 500.0, float("inf")]
LABELS = ["<100", "100-200", "200-300", "300-400", "400-500", "500+"]
NAN = float("nan")


def values(spark, *numbers):
    return spark.createDataFrame([(None if n is None else float(n),) for n in numbers], "v double")


def test_buckets_are_right_closed_and_empty_ones_are_listed(spark):
    df = values(spark, 0, -3, None, NAN, 0.01, 100, 100.01, 500, 500.5, 1e9)
    counts = [tuple(r) for r in profile.bucket_counts(df, "v", EDGES, LABELS).collect()]
    assert counts == [("<100", 2), ("500+", 2), ("100-200", 1), ("400-500", 1), ("200-300", 0), ("300-400", 0)]
    with pytest.raises(ValueError):
        profile.bucketize(F.col("v"), [0, 1], LABELS)


def test_box_statistics(spark):
    numbers = [*range(10, 20), 99]
    row = profile.box_statistics(values(spark, *numbers), "v", EDGES, LABELS).first()
    q1, q3 = np.percentile(numbers, [25, 75])
    assert (row.bucket, row["count"], row.q1, row.median, row.q3) == ("<100", 11, q1, np.median(numbers), q3)
    assert (row.min, row.max, row.lower_whisker, row.upper_whisker) == (10, 99, 10, 19)


def test_describe_by_both_segments(spark):
    rows = [(True, 1.0, 5), (True, 2.0, None), (True, 4.0, 7), (False, 3.0, 1), (False, NAN, 2)]
    out = {(r.flag, r.column): r for r in profile.describe_by(spark.createDataFrame(rows, "flag boolean, a double, b long"), "flag", ["a", "b"]).collect()}
    t = out[True, "a"]
    assert (t["count"], t.min, t.max) == (3, 1, 4)
    assert (t.mean, t.stddev, t.q1, t.median, t.q3) == pytest.approx((7 / 3, np.std([1, 2, 4], ddof=1), 1.5, 2, 3))
    assert (out[True, "b"]["count"], out[True, "b"].median) == (2, 6)
    assert (out[False, "a"]["count"], out[False, "a"].median, out[False, "a"].stddev) == (1, 3, None)


def test_top_rows_break_ties_by_key(spark):
    df = spark.createDataFrame([(3, 1.0), (1, 2.0), (2, 2.0), (4, None), (5, NAN)], "id long, v double")
    assert [r.id for r in profile.top_rows(df, "v", 2, "id").collect()] == [1, 2]
    assert [r.id for r in profile.top_rows(df, "v", 9, "id").collect()] == [1, 2, 3]


def test_points_and_grid(spark):
    df = spark.createDataFrame([(1.0, 2.0, "a"), (1.9, 2.1, "b"), (7.0, 0.0, "c")], "x double, y double, s string")
    assert profile.points(df, "x", "y", "s").columns == ["x", "y", "s"]
    assert {tuple(r) for r in profile.point_bins(df, "x", "y", 2.0, 1.0).collect()} == {(0, 2, 2), (3, 0, 1)}


def test_summary(spark):
    df = spark.createDataFrame([(1, "b", True), (3, "a", None), (None, None, None)], "n long, s string, flag boolean")
    out = {r.column: tuple(r)[1:] for r in profile.summary(df).collect()}
    assert out["n"] == (2, 2.0, pytest.approx(math.sqrt(2)), "1", "3") and out["s"] == (2, None, None, "a", "b")
    assert set(out) == {"n", "s"}


def test_mean_and_stddev_leave_missing_values_out(spark):
    row = profile.mean_and_stddev(values(spark, 1, None, NAN, 3), ["v"]).first()
    assert (row.mean, row.stddev) == (2.0, pytest.approx(math.sqrt(2)))


def test_histogram_equals_numpy(spark):
    rng = np.random.default_rng(0)
    numbers = np.concatenate([rng.normal(size=200), [4.0, -4.0]])
    out = profile.histogram(values(spark, *numbers, None, NAN), "v", 30).orderBy("bin").collect()
    counts, edges = np.histogram(numbers, 30)
    assert [r["count"] for r in out] == counts.tolist()
    assert [r.lower for r in out] == pytest.approx(edges[:-1].tolist()) and out[-1].upper == pytest.approx(4.0)


def test_histogram_of_one_value_and_of_nothing(spark):
    assert [r["count"] for r in profile.histogram(values(spark, 5, 5), "v", 3).orderBy("bin").collect()] == [2, 0, 0]
    assert [r["count"] for r in profile.histogram(values(spark, None), "v", 3).orderBy("bin").collect()] == [0, 0, 0]


def test_density_equals_direct_formula_and_integrates_to_one(spark):
    numbers = np.array([1.0, 2.0, 2.0, 7.0, 9.5])
    out = profile.density(values(spark, *numbers, None), "v", 50).orderBy("point").collect()
    grid = np.linspace(1, 9.5, 50)
    h = numbers.std(ddof=1) * len(numbers) ** -0.2
    direct = np.exp(-(((grid[:, None] - numbers) / h) ** 2) / 2).sum(1) / (len(numbers) * h * math.sqrt(2 * math.pi))
    assert [r.x for r in out] == pytest.approx(grid.tolist()) and [r.density for r in out] == pytest.approx(direct.tolist())


def test_rates_and_means(spark):
    rows = [("a", 10.0, 1.0), ("a", None, 0.0), ("a", NAN, 1.0), ("b", 4.0, None)]
    df = spark.createDataFrame(rows, "g string, d double, c double")
    out = {r.g: tuple(r)[1:] for r in profile.group_rates(df, "g", {"mean": "d"}, "c").collect()}
    assert out == {"a": (10.0, 3, 2, pytest.approx(2 / 3)), "b": (4.0, 1, 0, 0.0)}
    assert [(r.g, r.m) for r in profile.ranked_means(df, "g", "d", "m").collect()] == [("a", 10.0), ("b", 4.0)]


def test_clock_and_calendar(spark):
    clock = spark.createDataFrame([(0,), (59,), (100,), (2359,), (2400,)], "t int")
    assert [r[0] for r in clock.select(profile.hour_of_day(F.col("t"))).collect()] == [0, 0, 1, 23, 24]
    assert clock.select(profile.hour_of_day(F.col("t"), True)).collect()[-1][0] == 0
    week = spark.createDataFrame([(dt.date(2019, 1, 7 + i),) for i in range(7)], "d date")
    assert [r[0] for r in week.select(profile.weekday(F.col("d"))).collect()] == list(range(7))


def test_correlation_is_pairwise_complete(spark):
    rows = [(1.0, 2.0, 5), (2.0, NAN, 6), (3.0, 1.0, None), (4.0, 9.0, 1), (5.0, 3.0, 2)]
    df = spark.createDataFrame(rows, "a double, b double, c long")
    out = {(r.a, r.b): r.r for r in profile.correlation_matrix(df, ["a", "b", "c"]).collect()}
    assert len(out) == 9 and out["a", "a"] == pytest.approx(1)
    assert out["a", "b"] == out["b", "a"] == pytest.approx(np.corrcoef([1, 3, 4, 5], [2, 1, 9, 3])[0, 1])
    assert out["b", "c"] == pytest.approx(np.corrcoef([2, 9, 3], [5, 1, 2])[0, 1])
    row = profile.correlation_with(df, ["a", "c"], "b").first()
    assert (row.corr_a, row.corr_c) == pytest.approx((out["a", "b"], out["b", "c"]))


def test_a_group_without_values_is_described(spark):
    rows = spark.createDataFrame([("a", 1.0), ("b", None)], "g string, v double")
    got = {r.g: (r["count"], r["median"]) for r in profile.describe_by(rows, "g", ["v"]).collect()}
    assert got == {"a": (1, 1.0), "b": (0, None)}


def test_density_of_a_constant_and_of_one_point(spark):
    rows = spark.createDataFrame([(2.0,), (2.0,)], "v double")
    assert {r.density for r in profile.density(rows, "v", 5).collect()} == {None}
    assert profile.density(spark.createDataFrame([(1.0,), (3.0,)], "v double"), "v", 1).count() == 1


def test_summary_of_decimals_and_nan(spark):
    rows = spark.sql("SELECT CAST(v AS DECIMAL(5,1)) AS d, CAST(w AS DOUBLE) AS n FROM VALUES (1.0, 'NaN'), (2.0, '3.0') t(v, w)")
    got = {r.column: (r["count"], r["mean"], r["max"]) for r in profile.summary(rows).collect()}
    assert got == {"d": (2, 1.5, "2.0"), "n": (1, 3.0, "3.0")}


def test_density_of_far_and_skewed_values(spark):
    """Values far from every grid point, and a bandwidth much smaller and much larger than a step."""
    draw = np.random.default_rng(3)
    for numbers, grid in ((np.append(draw.normal(1e6, 2.0, 3000), 1e6 + 5000), 40), (draw.normal(size=2000), 500), (draw.integers(0, 9, 400).astype(float), 1)):
        out = profile.density(values(spark, *numbers), "v", grid).orderBy("point").collect()
        points = np.linspace(numbers.min(), numbers.max(), grid)
        h = numbers.std(ddof=1) * len(numbers) ** -0.2
        direct = np.exp(-(((points[:, None] - numbers) / h) ** 2) / 2).sum(1) / (len(numbers) * h * math.sqrt(2 * math.pi))
        assert np.abs(np.array([r.density for r in out]) - direct).max() < 2e-12 / h


def test_density_explodes_bins_and_not_rows(spark):
    rows = spark.range(200_000).select(F.sqrt(F.col("id")).alias("v"))
    text = profile.density(rows, "v", 200)._jdf.queryExecution().executedPlan().toString()
    # Plans are printed from the end: rows are counted in bins before anything is multiplied.
    assert text.index("Generate") < text.rindex("partial_sum") and "Python" not in text


def test_correlation_far_from_zero(spark):
    draw = np.random.default_rng(1)
    data = draw.normal(size=(500, 3)) @ draw.normal(size=(3, 3)) + [1e9, -3e8, 0.0]
    df = spark.createDataFrame(data.tolist(), "a double, b double, c double")
    out = {(r.a, r.b): r.r for r in profile.correlation_matrix(df, ["a", "b", "c"]).collect()}
    wanted = np.corrcoef(data.T)
    assert all(out[a, b] == pytest.approx(wanted[i, j], abs=1e-6) for i, a in enumerate("abc") for j, b in enumerate("abc"))
    empty = profile.correlation_matrix(df.limit(0), ["a", "b"]).collect()
    assert len(empty) == 4 and {r.r for r in empty} == {None}
    constant = {(r.a, r.b): r.r for r in profile.correlation_matrix(df.withColumn("b", F.lit(2.0)), ["a", "b"]).collect()}
    assert constant["a", "b"] is None and constant["b", "b"] is None and constant["a", "a"] == pytest.approx(1)
