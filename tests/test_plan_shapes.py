"""Physical plans: no Python, no all-pairs joins, filters and columns pushed into scans."""

import os

import pytest
from pyspark.sql import functions as F

from millrace.catalog import QUERIES, classification, views
from millrace.operators import profile, quality
from tests.conftest import DATA

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [
    "rich_preset", "simple_preset", "trigram_counts", "top_bigrams", "inverted_index", "postings", "proximity_matches",
    "search_hits", "page_links", "product_listings", "missing_profile", "first_per_description", "price_box_statistics",
    "segments_described", "delay_density", "airline_rates", "correlation_matrix", "roc_points", "document_ids",
    "cosine_scores", "tfidf_weights", "stored_search_hits", "hashed_search_hits", "hashed_tfidf_weights", "stored_index_lookup",
    "bag_of_words", "tsv_scan_line_breaks",
])
def test_no_python_and_no_all_pairs_join(spark, name):
    text = plan(QUERIES[name](spark, DATA))
    assert not any(word in text for word in ("EvalPython", "InPandas", "InArrow", "CartesianProduct", "NestedLoopJoin"))


def test_texts_are_tokenised_once(spark):
    """No filter on the size of the token list is pushed to the scan."""
    for name in ("trigram_counts", "postings"):
        scans = [line for line in plan(QUERIES[name](spark, DATA)).splitlines() if "FileScan" in line and "documents" in line]
        assert scans and not any("size(" in line for line in scans)
    # A search reads the tokens that its index wrote.
    assert "documents.parquet" not in plan(QUERIES["search_hits"](spark, DATA))


def test_trips_are_not_moved_before_their_joins(spark):
    assert "RoundRobin" not in plan(QUERIES["airline_rates"](spark, DATA))


def test_one_profile_is_one_scan_with_partial_aggregation(spark):
    text = plan(quality.missing_profile(spark.read.parquet(f"{DATA}/orders.parquet")))
    assert text.count("FileScan") == 1 and "partial_count" in text


def test_filters_and_columns_reach_the_scan(spark):
    events = spark.read.parquet(f"{DATA}/events.parquet")
    text = plan(profile.mean_by(quality.exceeding(events, "value", 100.0), F.col("event_type"), {"m": "value"}))
    assert "GreaterThan(value,100.0)" in text and "ReadSchema: struct<event_type:string,value:double>" in text


def test_top_rows_use_a_bounded_sort(spark):
    events = spark.read.parquet(f"{DATA}/events.parquet")
    assert "TakeOrderedAndProject" in plan(profile.top_rows(events, "value", 10, "event_id"))


def test_trips_are_joined_once_before_training(spark):
    """Fits and scores read the written trips; no pass joins them again."""
    text = plan(classification._encoded(spark, DATA))
    assert "lineitem.parquet" not in text and "Join" not in text


def test_lines_of_trips_are_exchanged_once(spark):
    """Orders meet customers before lines; where both are too large to be broadcast, the lines move once."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = views.trips(spark, DATA, "trip_id", "dep_delay", "dest")
        text = rows._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    lines = text.splitlines()
    depth = {c: next(len(l) - len(l.lstrip(" :+-")) for l in lines if c in l and "Relation" in l) for c in ("l_orderkey", "c_custkey")}
    assert depth["c_custkey"] > depth["l_orderkey"]
