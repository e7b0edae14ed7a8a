import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from millrace.catalog import classification
from millrace.operators import evaluate, features, models
from millrace.sources import models as stored


@pytest.fixture(scope="module")
def vectors(spark):
    rows = [(i, [float(i % 7), float(i % 3), i / 10.0], int(i % 7 + i % 3 > 4)) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, cells array<double>, label int")
    return df.select("id", array_to_vector("cells").alias("features"), "label")


def test_labels_are_strict(spark):
    df = spark.createDataFrame([(15.0,), (15.01,), (None,), (float("nan"),), (-3.0,)], "d double")
    assert [r.label for r in features.binary_label(df, "d").collect()] == [0, 1, 0, 0, 0]


def test_index_table_orders_by_count_then_value(spark):
    df = spark.createDataFrame([("b", "x"), ("a", "x"), ("c", None), ("c", "y"), ("b", "x")], "p string, q string")
    out = {(r.column, r.value): r["index"] for r in features.string_index_table(df, ["p", "q"]).collect()}
    assert out == {("p", "b"): 0, ("p", "c"): 1, ("p", "a"): 2, ("q", "x"): 0, ("q", "y"): 1}


def test_encoder_fitted_on_training_rows_accepts_new_values(spark):
    train = spark.createDataFrame([(1.0, "a"), (2.0, "a"), (3.0, "b")], "n double, c string")
    encoder = features.fit_encoder(train, ["n"], ["c"])
    out = features.encode(encoder, spark.createDataFrame([(5.0, "b"), (6.0, "new")], "n double, c string"), "n")
    assert [r.features.toArray().tolist() for r in out.orderBy("n").collect()] == [[5, 0, 1], [6, 0, 0]]
    strict = features.fit_encoder(train, ["n"], ["c"], handle_invalid="error")
    assert [r.features.toArray().tolist() for r in features.encode(strict, train, "n").orderBy("n").collect()] == [[1, 1], [2, 1], [3, 0]]


def test_hash_split_is_disjoint_complete_and_stable(spark):
    df = spark.range(2000)
    train, test = features.train_test_split(df, F.col("id"))
    again, _ = features.train_test_split(df.repartition(9), F.col("id"))
    ids = {r.id for r in train.collect()}
    assert ids == {r.id for r in again.collect()} and len(ids) + test.count() == 2000
    assert not ids & {r.id for r in test.collect()} and 0.76 < len(ids) / 2000 < 0.84
    sample = {r.id for r in features.hash_sample(train, F.col("id"), 50).collect()}
    assert sample < ids and 0.4 < len(sample) / len(ids) < 0.6


def test_random_split_and_sample(spark):
    train, test = features.train_test_split(spark.range(1000))
    assert train.count() + test.count() == 1000 and 700 < train.count() < 900
    assert 380 < features.bernoulli_sample(spark.range(1000), 0.5).count() < 620


@pytest.mark.parametrize("family, params", [
    ("logistic_regression", {}), ("random_forest", {"numTrees": 5}), ("boosted_trees", {"maxIter": 3}), ("network", {"maxIter": 30}),
])
def test_every_family_learns_saves_and_loads(spark, tmp_path, vectors, family, params):
    model = models.train(family, vectors, **params)
    scores = models.predict(model, vectors)
    assert {"rawPrediction", "probability", "prediction"} <= set(scores.columns)
    assert evaluate.roc_area(scores, evaluate.positive_score()).first().area > 0.8
    stored.save_model(model, str(tmp_path / family))
    again = models.predict(stored.load_model(family, str(tmp_path / family)), vectors)
    assert sorted((r.id, r.prediction) for r in scores.collect()) == sorted((r.id, r.prediction) for r in again.collect())


def test_network_layers(vectors):
    assert models.train("network", vectors, maxIter=1).getLayers() == [3, 128, 64, 2]


def test_grids():
    sizes = {"logistic_regression": 9, "random_forest": 9, "boosted_trees": 4}
    for family, size in sizes.items():
        assert len(models.param_grid(models.estimator(family), models.GRIDS[family])) == size
    assert models.estimator("boosted_trees").getMaxIter() == 10


def test_cross_validation_picks_the_best_point(vectors):
    tuned = models.cross_validate("logistic_regression", vectors, {"regParam": [0.0, 50.0]}, folds=2)
    scores = {r.settings: r.area for r in tuned.scores.collect()}
    assert set(scores) == {"regParam=0.0", "regParam=50.0"} and all(0 <= a <= 1 for a in scores.values())
    assert tuned.model.getRegParam() == float(max(scores, key=scores.get).split("=")[1])


def test_tuned_forests_are_grown_in_parts(vectors, monkeypatch):
    """The driver holds a bounded number of trees, and the parts' votes add up to those of all trees."""
    grown, fit = [], models.RandomForestClassifier._fit
    monkeypatch.setattr(models.RandomForestClassifier, "_fit", lambda self, df: grown.append(self.getNumTrees()) or fit(self, df))
    monkeypatch.setattr(models, "FOREST_NODES", 64)
    tuned = models.cross_validate("random_forest", vectors, {"numTrees": [5], "maxDepth": [4]}, folds=2)
    assert sorted(grown) == [1, 1, 2, 2, 2, 2]
    rows = tuned.predictions.collect()
    # A tree's votes of both classes are 1 in all.
    assert len(rows) == vectors.count() and all(0 <= r.score <= 5 for r in rows) and max(r.score for r in rows) > 2
    assert tuned.scores.first().area > 0.8 and tuned.model.getNumTrees == 5


def test_few_rows_need_no_parts():
    forest = models.estimator("random_forest")
    deep = {forest.numTrees: 100, forest.maxDepth: 15}
    assert len(models._parts(forest, deep, 1000)) == 1
    parts = models._parts(forest, deep, 1 << 24)
    assert sum(p[forest.numTrees] for p in parts) == 100 and max(p[forest.numTrees] for p in parts) == 4
    assert len({p[forest.seed] for p in parts}) == len(parts)


def test_parameters_survive_a_round_trip(spark, tmp_path):
    rows = [(0, 0.0, 1.1, 1.0), (1, 2.0, 1.0, 0.0), (2, 2.0, 1.3, 1.0), (3, 0.0, 1.2, 0.0), (4, 0.0, -0.5, 1.0)]
    data = spark.createDataFrame([(i, Vectors.dense(a, b), y) for i, a, b, y in rows], ["id", "features", "label"])
    model = models.train("logistic_regression", data)
    stored.save_parameters(stored.model_parameters(spark, model, ["feature1", "feature2"]), str(tmp_path / "p"))
    back = {r.term: r.value for r in stored.load_parameters(spark, str(tmp_path / "p")).collect()}
    assert back == {"intercept": model.intercept, "feature1": model.coefficients[0], "feature2": model.coefficients[1]}


def test_importances_name_every_slot(spark):
    rows = [(float(i), "a" if i % 2 else "b", i % 2) for i in range(40)]
    df = spark.createDataFrame(rows, "n double, c string, label int")
    encoded = features.encode(features.fit_encoder(df, ["n"], ["c"]), df, "label")
    table = evaluate.feature_importances(models.train("random_forest", encoded, numTrees=5), encoded).collect()
    assert {r.feature for r in table} == {"n", "c_Vec_a", "c_Vec_b"} and table[0].source == "c"
    assert sum(r.importance for r in table) == pytest.approx(1)


@pytest.fixture(scope="module")
def trip_tables(spark, tmp_path_factory):
    """Lines of 80 orders with the tables that trips are joined from."""
    folder = str(tmp_path_factory.mktemp("trips"))
    lines = spark.range(240).selectExpr(
        "id % 80 AS l_orderkey", "CAST(id / 80 AS INT) + 1 AS l_linenumber", "id AS l_partkey", "id % 4 AS l_suppkey", "CAST(id AS DOUBLE) AS l_extendedprice",
        "0.1D AS l_discount", "0.2D AS l_tax", "CAST(id % 50 AS DOUBLE) AS l_quantity", "date_add(DATE'2020-01-01', CAST(id % 31 AS INT)) AS l_shipdate",
    )
    orders = spark.range(80).selectExpr("id AS o_orderkey", "id % 5 AS o_custkey", "DATE'2020-01-01' AS o_orderdate", "CAST(id % 3 AS STRING) AS o_orderpriority")
    tables = {"lineitem": lines, "orders": orders, "supplier": spark.range(4).selectExpr("id AS s_suppkey", "id AS s_nationkey"), "customer": spark.range(5).selectExpr("id AS c_custkey", "id AS c_nationkey")}
    for name, rows in tables.items():
        rows.write.parquet(f"{folder}/{name}.parquet")
    return folder


def test_trip_tuning_is_given_every_row_of_the_training_side(spark, trip_tables, monkeypatch):
    given = []
    monkeypatch.setattr(models, "cross_validate", lambda family, rows, **_: given.append(rows) or (_ for _ in ()).throw(InterruptedError))
    with pytest.raises(InterruptedError):
        classification.trip_tuning(spark, trip_tables)
    lines = spark.read.parquet(f"{trip_tables}/lineitem.parquet")
    wanted = features.with_side(lines, F.col("l_orderkey")).filter("side = 'train'").selectExpr("l_orderkey * 10 + l_linenumber AS trip_id")
    assert 100 < wanted.count() < 240
    assert sorted(r.trip_id for r in given[0].select("trip_id").collect()) == sorted(r.trip_id for r in wanted.collect())


def test_scores_of_left_out_rows_are_written_without_features(vectors, monkeypatch):
    """Features are written again only for a part that follows, and a part's table goes when the next has read it."""
    written, write = [], models.stage
    monkeypatch.setattr(models, "stage", lambda df, name: written.append((name, df.columns)) or write(df, name))
    models.cross_validate("logistic_regression", vectors, {"regParam": [0.1]}, folds=2, parallelism=1)
    monkeypatch.setattr(models, "FOREST_NODES", 64)
    models.cross_validate("random_forest", vectors, {"numTrees": [4], "maxDepth": [4]}, folds=2, parallelism=1)
    assert ["features" in columns for name, columns in written if name == "left-out"] == [False, False, True, False, True, False]
