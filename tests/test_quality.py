import math

import pytest
from pyspark.sql import functions as F

from millrace.operators import quality

NAN = float("nan")


@pytest.fixture
def gaps(spark):
    rows = [(1, 1.0, "a", None), (2, None, None, None), (3, NAN, "a", None), (4, -2.0, "b", None)]
    return spark.createDataFrame(rows, "id long, x double, s string, nothing double")


def test_missing_and_null_profiles(gaps, spark):
    assert tuple(quality.missing_profile(gaps).first()) == (0, 2, 1, 4)
    assert tuple(quality.null_profile(gaps).first()) == (0, 1, 1, 4)
    assert tuple(quality.missing_profile(gaps.limit(0)).first()) == (0, 0, 0, 0)


def test_missing_profile_is_one_wide_row(spark):
    from millrace.sources.delimited import FLIGHT_SCHEMA

    profile = quality.missing_profile(spark.createDataFrame([], FLIGHT_SCHEMA))
    assert profile.columns == FLIGHT_SCHEMA.fieldNames() and len(profile.columns) == 32 and profile.count() == 1


def test_imputation_fills_null_and_nan(gaps):
    assert [r.x for r in quality.impute_constant(gaps, ["x"]).orderBy("id").collect()] == [1.0, 0.0, 0.0, -2.0]
    assert quality.impute_constant(gaps, ["x"]).columns == gaps.columns


def test_incomplete_rows_are_dropped(gaps):
    assert [r.id for r in quality.drop_incomplete(gaps, ["x"]).orderBy("id").collect()] == [1, 4]
    assert quality.drop_incomplete(gaps).count() == 0
    kept = quality.handle_missing(gaps, ["x", "nothing"], ["x", "s", "nothing"])
    assert [(r.id, r.x, r.nothing) for r in kept.orderBy("id").collect()] == [(1, 1.0, 0.0), (3, 0.0, 0.0), (4, -2.0, 0.0)]


def test_first_per_key_keeps_the_whole_first_row(spark):
    rows = [(i, "hot" if i % 3 else None, f"v{i}") for i in range(100)]
    df = spark.createDataFrame(rows, "id long, key string, v string").repartition(7)
    out = {(r.key, r.id, r.v) for r in quality.first_per_key(df, ["key"], "id").collect()}
    assert out == {("hot", 1, "v1"), (None, 0, "v0")}


def test_segments_leave_null_out(spark):
    df = spark.createDataFrame([(True,), (False,), (None,), (True,)], "flag boolean")
    assert [part.count() for part in quality.segment(df, "flag")] == [2, 1]


def test_thresholds(gaps):
    assert [r.id for r in quality.exceeding(gaps, "x", 0).collect()] == [1]
    assert tuple(quality.share_exceeding(gaps, "x").first()) == (4, 1, 0.25)
    assert tuple(quality.share_exceeding(gaps.limit(0), "x").first()) == (0, 0, None)


def test_schema_overview(gaps):
    rows = [(r.position, r.column, r.type, r.rows) for r in quality.schema_overview(gaps).orderBy("position").collect()]
    assert rows == [(0, "id", "bigint", 4), (1, "x", "double", 4), (2, "s", "string", 4), (3, "nothing", "double", 4)]


def test_category_counts(gaps):
    assert [tuple(r) for r in quality.category_counts(gaps, "s").collect()] == [("a", 2), ("b", 1), (None, 1)]
    assert [tuple(r) for r in quality.category_counts(gaps, "s", keep_null=False).collect()] == [("a", 2), ("b", 1)]


def test_nan_to_null(gaps):
    assert quality.nan_to_null(gaps).filter(F.isnan("x")).count() == 0
    assert math.isnan(quality.nan_to_null(gaps, ["nothing"]).filter("id = 3").first().x)


def test_first_per_key_keeps_the_key_when_the_order_is_null(spark):
    rows = spark.createDataFrame([("a", None, 1), ("b", 2, 2), ("b", None, 3)], "k string, o int, v int")
    assert sorted(tuple(r) for r in quality.first_per_key(rows, ["k"], "o").collect()) == [("a", None, 1), ("b", 2, 2)]
