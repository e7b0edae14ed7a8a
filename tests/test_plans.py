import math
import os
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.plans import joins, ordered, staging
from millrace.sources.identifiers import assign_doc_id


def test_running_totals_with_one_huge_group_and_null_group(spark):
    random.seed(1)
    rows = [("big" if i % 10 else None, i, random.randint(-5, 5)) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, k long, v long").repartition(5)
    out = ordered.running_totals(df, [F.col("k").desc()], ["v"], ["g"], slices=7).collect()
    assert len(out) == 500
    for group in ("big", None):
        total, sums = 0, {}
        for _, k, v in sorted((r for r in rows if r[0] == group), key=lambda r: -r[1]):
            total += v
            sums[k] = total
        assert {r.k: r.v_upto for r in out if r.g == group} == sums
        assert {r.v_all for r in out if r.g == group} == {total}


def test_document_ids_are_positions(spark):
    df = spark.createDataFrame([(i * 7919 % 1000,) for i in range(1000)], "k long").repartition(6)
    assert [(r.doc_id, r.k) for r in assign_doc_id(df, "k").orderBy("doc_id").collect()] == [(i, i) for i in range(1000)]


@pytest.mark.parametrize("partitions", [1, 5])
def test_percentiles_equal_numpy(spark, partitions):
    random.seed(2)
    values = [("a", random.choice([1.0, 2.0, random.random()])) for _ in range(301)] + [("b", 5.0), ("c", None), ("a", math.nan)]
    df = spark.createDataFrame(values, "g string, v double").repartition(partitions)
    out = {r.g: r for r in ordered.exact_percentiles(df, "v", {"q1": 0.25, "mid": 0.5, "q9": 0.9}, ["g"]).collect()}
    a = [v for g, v in values if g == "a" and not math.isnan(v)]
    assert (out["a"].q1, out["a"].mid, out["a"].q9) == pytest.approx(tuple(np.percentile(a, [25, 50, 90])))
    assert tuple(out["b"])[1:] == (5.0, 5.0, 5.0) and set(out) == {"a", "b"}
    assert ordered.exact_percentiles(df, "v", {"mid": 0.5}).first().mid == pytest.approx(np.median([*a, 5.0]))


@pytest.mark.parametrize("select_rows", [1, 20, 10**6])
def test_bracketed_percentiles_equal_numpy(spark, select_rows):
    """One group holds most rows, one value a third of them; brackets close in several rounds."""
    draw = np.random.default_rng(4)
    groups = {"a": np.append(draw.normal(size=4000), np.full(2000, 0.25)), "b": draw.integers(0, 5, 300).astype(float), None: np.array([7.0])}
    df = spark.createDataFrame([(g, float(v)) for g, vs in groups.items() for v in vs], "g string, v double").repartition(5)
    wanted = {"lo": 0.0, "q1": 0.25, "mid": 0.5, "q9": 0.9, "hi": 1.0}
    out = {r.g: tuple(r)[1:] for r in ordered.exact_percentiles(df, "v", wanted, ["g"], select_rows).collect()}
    assert out == {g: pytest.approx(tuple(np.percentile(vs, [100 * p for p in wanted.values()]))) for g, vs in groups.items()}
    whole = ordered.exact_percentiles(df, "v", wanted, select_rows=select_rows).first()
    assert tuple(whole) == pytest.approx(tuple(np.percentile(np.concatenate(list(groups.values())), [100 * p for p in wanted.values()])))


def test_positions_take_one_exchange_of_the_rows(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("k"), F.concat(F.lit("x"), "id").alias("s")).repartition(3)
    placed = assign_doc_id(df, "k")
    assert [(r.doc_id, r.k) for r in placed.orderBy("doc_id").collect()] == [(i, i) for i in range(5000)]
    placed.collect()
    text = placed._jdf.queryExecution().executedPlan().toString()
    assert text.count("ReusedExchange") >= 1 and "Window" in text and "InMemory" not in text
    assert assign_doc_id(df.limit(0), "k").count() == 0
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        assert [(r.doc_id, r.k) for r in assign_doc_id(df, "k").orderBy("doc_id").collect()] == [(i, i) for i in range(5000)]
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")


def test_attach_by_key_with_heavy_and_light_keys(spark, monkeypatch):
    monkeypatch.setattr(joins, "HEAVY_KEYS", 3)
    rows = spark.createDataFrame([(i, "hot" if i % 2 else f"k{i % 20}") for i in range(200)] + [(999, "unknown")], "id long, key string")
    counts = rows.filter("key <> 'unknown'").groupBy("key").agg(F.count("*").alias("n")).withColumn("value", F.length("key"))
    out = joins.attach_by_key(rows, counts, "key", "n", "value", F.col("id")).collect()
    assert sorted((r.id, r.key, r.value) for r in out) == sorted((i, k, len(k)) for i in range(200) for k in ["hot" if i % 2 else f"k{i % 20}"])


def test_match_by_key_gives_the_same_rows_with_and_without_broadcast(spark):
    rows = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i % 5}") for i in range(300)], "id long, key string")
    wanted = spark.createDataFrame([("hot", 1), ("hot", 2), ("k0", 3), ("none", 4)], "key string, q long")
    small = joins.match_by_key(rows, wanted, "key", F.col("id"))
    large = joins.match_by_key(rows, wanted, "key", F.col("id"), salts=8, max_bytes=1)
    def bag(df):
        return sorted((r.id, r.key, r.q) for r in df.collect())
    assert bag(small) == bag(large) and len(bag(small)) > 400


def test_staged_tables_live_in_the_configured_folder(spark):
    staged = staging.stage(spark.range(5), "numbers")
    root = spark.conf.get("spark.checkpoint.dir")
    assert all(root in f for f in staged.inputFiles()) and staged.count() == 5


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}


def test_staged_tables_leave_no_shuffles_behind(spark):
    before, setting = shuffle_files(spark), spark.conf.get(staging._DROP_SHUFFLES)
    rows = spark.range(1000).repartition(3, "id").groupBy((F.col("id") % 7).alias("k")).count()
    staged = staging.stage(rows, "shuffled")
    for _ in range(50):  # They are removed in the background.
        if not shuffle_files(spark) - before:
            break
        time.sleep(0.2)
    assert not shuffle_files(spark) - before and spark.conf.get(staging._DROP_SHUFFLES) == setting
    assert staged.count() == rows.count() == 7
    staging.discard(staged)
    assert not os.path.exists(os.path.dirname(spark._jvm.java.net.URI(staged.inputFiles()[0]).getPath()))


def test_a_failed_write_restores_the_setting(spark):
    setting = spark.conf.get(staging._DROP_SHUFFLES)
    with pytest.raises(Exception, match="no such row"):
        staging.stage(spark.range(1).select(F.raise_error(F.lit("no such row")).alias("x").cast("string")), "failing")
    assert spark.conf.get(staging._DROP_SHUFFLES) == setting


def test_scratch_folder_is_required_on_a_cluster():
    class Context:
        master, applicationId = "spark://host:7077", "app"

    class Session:
        sparkContext = Context()
        conf = type("Conf", (), {"get": staticmethod(lambda key, default: default)})

    with pytest.raises(RuntimeError):
        staging.scratch_root(Session())
