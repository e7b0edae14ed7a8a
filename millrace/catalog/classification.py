"""Features, models, evaluation and topics."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.catalog import textsql as sql
from millrace.catalog.registry import query
from millrace.catalog.views import CAUSES, SCORED_SQL, TRIPS_SQL, round_doubles, scored, table, trips
from millrace.catalog.wording import documents
from millrace.operators import evaluate, features, models, presets, quality, topics
from millrace.plans.staging import new_scratch_path, stage
from millrace.sources import models as stored

_KEY = "CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING)"
_PERCENT = "CAST(CAST('0x' || substr(md5({salt} || {key}), 1, 8) AS BIGINT) % 100 AS BIGINT)"


# --- labels, splits, samples ----------------------------------------------------------------------


@query(
    "delay_labels",
    f"WITH {TRIPS_SQL} SELECT order_key, dep_delay, CASE WHEN dep_delay > 15 THEN 1 ELSE 0 END AS label FROM trips",
)
def delay_labels(spark: SparkSession, folder: str) -> DataFrame:
    return features.binary_label(trips(spark, folder, "order_key", "dep_delay"), "dep_delay", 15.0)


_SPLIT_SQL = f"""sided AS (SELECT l_orderkey, l_linenumber, l_returnflag,
    CASE WHEN {_PERCENT.format(salt="''", key='CAST(l_orderkey AS STRING)')} < 80 THEN 'train' ELSE 'test' END AS side FROM lineitem)"""


@query("hash_split", f"WITH {_SPLIT_SQL} SELECT l_orderkey, l_linenumber, side FROM sided")
def hash_split(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber")
    return features.with_side(rows, F.col("l_orderkey"))


@query(
    "hash_sample",
    f"SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem WHERE {_PERCENT.format(salt=chr(39) + 'sample' + chr(39), key=_KEY)} < 50",
)
def hash_sample(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return features.hash_sample(rows, F.expr(_KEY), 50)


@query(
    "label_distribution",
    f"WITH {_SPLIT_SQL} SELECT side, l_returnflag AS label, CAST(count(*) AS BIGINT) AS count FROM sided GROUP BY ALL",
)
def label_distribution(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "lineitem").select("l_orderkey", F.col("l_returnflag").alias("label"))
    return features.label_distribution(features.with_side(rows, F.col("l_orderkey")))


@query("random_split_sizes", "SELECT CAST(count(*) AS BIGINT) AS rows, true AS near_eighty_percent FROM lineitem")
def random_split_sizes(spark: SparkSession, folder: str) -> DataFrame:
    train, test = features.train_test_split(table(spark, folder, "lineitem").select("l_orderkey"))
    both = train.select(F.lit(1).alias("train")).unionByName(test.select(F.lit(0).alias("train")))
    return both.agg(F.count("*").alias("rows"), F.avg("train").between(0.75, 0.85).alias("near_eighty_percent"))


@query("bernoulli_sample", "SELECT CAST(count(*) AS BIGINT) AS rows, true AS near_half FROM lineitem")
def bernoulli_sample(spark: SparkSession, folder: str) -> DataFrame:
    """The number of rows, and whether about half of them are drawn."""
    rows = table(spark, folder, "lineitem").select("l_orderkey")
    drawn = features.bernoulli_sample(rows, 0.5)
    both = rows.select(F.lit(0).alias("drawn")).unionByName(drawn.select(F.lit(1).alias("drawn")))
    total = F.count_if(F.col("drawn") == 0)
    return both.agg(total.alias("rows"), (F.sum("drawn") / total).between(0.45, 0.55).alias("near_half"))


# --- evaluation -----------------------------------------------------------------------------------


@query("confusion_matrix", f"WITH {SCORED_SQL} SELECT label, prediction, CAST(count(*) AS BIGINT) AS count FROM scored GROUP BY ALL")
def confusion_matrix(spark: SparkSession, folder: str) -> DataFrame:
    return evaluate.confusion_matrix(scored(spark, folder))


@query(
    "weighted_metrics",
    f"""WITH {SCORED_SQL}, c AS (SELECT label, prediction, count(*) AS n FROM scored GROUP BY ALL),
        k AS (SELECT label AS class, sum(n) AS t, coalesce(sum(n) FILTER (WHERE prediction = label), 0) AS r,
              (SELECT coalesce(sum(n), 0) FROM c p WHERE p.prediction = c.label) AS p FROM c GROUP BY label),
        m AS (SELECT t, r, coalesce(r / nullif(p, 0), 0) AS pr, r / t AS re FROM k)
        SELECT round(sum(r) / sum(t), 6) AS accuracy, round(sum(pr * t) / sum(t), 6) AS weighted_precision,
               round(sum(re * t) / sum(t), 6) AS weighted_recall, round(sum(coalesce(2 * pr * re / nullif(pr + re, 0), 0) * t) / sum(t), 6) AS f1 FROM m""",
)
def weighted_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return round_doubles(evaluate.weighted_metrics(evaluate.confusion_matrix(scored(spark, folder))))


@query(
    "positive_class_metrics",
    f"""WITH {SCORED_SQL}, c AS (SELECT count(*) FILTER (WHERE score > 0.4 AND label = 1) AS tp, count(*) FILTER (WHERE score > 0.4 AND label = 0) AS fp,
        count(*) FILTER (WHERE score <= 0.4 AND label = 1) AS fn, count(*) FILTER (WHERE score <= 0.4 AND label = 0) AS tn FROM scored)
        SELECT round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision,
               round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1 FROM c""",
)
def positive_class_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return round_doubles(evaluate.positive_metrics(scored(spark, folder), F.col("score"), threshold=0.4))


_RANKED_SQL = SCORED_SQL + """, c AS (SELECT score, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label = 0) AS neg FROM scored GROUP BY score),
    r AS (SELECT *, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(neg) OVER (ORDER BY score DESC) AS fp, sum(pos) OVER () AS p, sum(neg) OVER () AS n FROM c)"""


@query("roc_area", f"WITH {_RANKED_SQL} SELECT round(sum(neg * (tp - pos / 2)) / (any_value(p) * any_value(n)), 6) AS area FROM r")
def roc_area(spark: SparkSession, folder: str) -> DataFrame:
    return round_doubles(evaluate.roc_area(scored(spark, folder), F.col("score")))


@query(
    "roc_points",
    f"""WITH {_RANKED_SQL} SELECT score AS threshold, round(fp / n, 6) AS fpr, round(tp / p, 6) AS tpr FROM r
        UNION ALL SELECT NULL, 0.0, 0.0""",
)
def roc_points(spark: SparkSession, folder: str) -> DataFrame:
    return round_doubles(evaluate.roc_points(scored(spark, folder), F.col("score")))


# --- models ---------------------------------------------------------------------------------------


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Feature vectors with a two-class label that they separate."""
    label = F.when(F.col("label") < 5, 1).otherwise(0).alias("label")
    return table(spark, folder, "embeddings").select("vec_id", array_to_vector("embedding").alias("features"), label)


def _fitted(spark: SparkSession, folder: str, family: str, **params) -> DataFrame:
    train, test = features.train_test_split(vectors(spark, folder), F.col("vec_id"))
    predictions = models.predict(models.train(family, train.repartition("vec_id"), **params), test)
    return predictions.select("vec_id", "label", "prediction", evaluate.positive_score().alias("score"))


@query("logistic_regression_scores")
def logistic_regression_scores(spark: SparkSession, folder: str) -> DataFrame:
    return _fitted(spark, folder, "logistic_regression")


@query("random_forest_scores")
def random_forest_scores(spark: SparkSession, folder: str) -> DataFrame:
    return _fitted(spark, folder, "random_forest")


@query("boosted_trees_scores")
def boosted_trees_scores(spark: SparkSession, folder: str) -> DataFrame:
    return _fitted(spark, folder, "boosted_trees")


@query("network_scores")
def network_scores(spark: SparkSession, folder: str) -> DataFrame:
    return _fitted(spark, folder, "network", maxIter=10)


def _left_out(tuned: models.Tuned) -> DataFrame:
    """What the scores of left-out rows hold for each grid point and fold, and whether their area is that
    of a share: between 0 and 1, and the rest of 1 for the reverse order."""
    groups = ["settings", "fold"]
    areas = evaluate.roc_areas(tuned.predictions, groups, F.col("score"))
    reverse = evaluate.roc_areas(tuned.predictions, groups, -F.col("score")).select(*groups, F.col("area").alias("reverse"))
    is_area = F.col("area").between(0.0, 1.0) & (F.abs(F.col("area") + F.col("reverse") - 1) < 1e-9)
    return areas.join(reverse, groups).select(*groups, "rows", "positives", is_area.alias("is_area"))


def _tuned(spark: SparkSession, folder: str, family: str) -> DataFrame:
    """The family's own grid over five folds."""
    fold = features.hash_percent(F.col("vec_id"), "fold") % 5
    return _left_out(models.cross_validate(family, vectors(spark, folder), parallelism=4, fold=fold))


def _grid(family: str) -> str:
    points = [""]
    for name, choices in sorted(models.GRIDS[family].items()):
        points = [f"{p}{', ' if p else ''}{name}={c}" for p in points for c in choices]
    return "(VALUES " + ", ".join(f"('{p}')" for p in points) + ") grid(settings)"


def _folds_sql(family: str, rows: str, key: str) -> str:
    fold = _PERCENT.format(salt="'fold'", key=f"CAST({key} AS STRING)")
    return f"""folded AS (SELECT CAST({fold} % 5 AS INT) AS fold, label FROM {rows})
        SELECT settings, fold, CAST(count(*) AS BIGINT) AS rows, CAST(sum(label) AS BIGINT) AS positives, true AS is_area
        FROM {_grid(family)}, folded GROUP BY settings, fold"""


def _grid_sql(family: str) -> str:
    return "WITH vectors AS (SELECT vec_id, CASE WHEN label < 5 THEN 1 ELSE 0 END AS label FROM embeddings), " + _folds_sql(family, "vectors", "vec_id")


@query("tuned_logistic_regression", _grid_sql("logistic_regression"))
def tuned_logistic_regression(spark: SparkSession, folder: str) -> DataFrame:
    return _tuned(spark, folder, "logistic_regression")


@query("tuned_random_forest", _grid_sql("random_forest"))
def tuned_random_forest(spark: SparkSession, folder: str) -> DataFrame:
    return _tuned(spark, folder, "random_forest")


@query("tuned_boosted_trees", _grid_sql("boosted_trees"))
def tuned_boosted_trees(spark: SparkSession, folder: str) -> DataFrame:
    return _tuned(spark, folder, "boosted_trees")


_NUMERIC = ["crs_dep_time", "distance", *CAUSES]
_CATEGORICAL = ["airline", "origin", "dest"]


# The encoder is fitted on the training side; a category's slot is its rank there, after the numbers.
_CODED_SQL = f"""prepared AS (SELECT trip_id, CASE WHEN coalesce(dep_delay, 0) > 15 THEN 1 ELSE 0 END AS label, crs_dep_time, distance,
        {', '.join(f'coalesce({c}, 0) AS {c}' for c in CAUSES)}, CAST(airline AS STRING) AS airline, CAST(origin AS STRING) AS origin, CAST(dest AS STRING) AS dest,
        {_PERCENT.format(salt="''", key='CAST(order_key AS STRING)')} < 80 AS training FROM trips),
    ranked AS ({' UNION ALL '.join(f"SELECT '{c}' AS name, {c} AS value, row_number() OVER (ORDER BY count(*) DESC, {c}) - 1 AS place FROM prepared WHERE training GROUP BY {c}" for c in _CATEGORICAL)}),
    sizes AS (SELECT name, count(*) AS n FROM ranked GROUP BY name),
    cells AS ({' UNION ALL '.join(f'SELECT trip_id, label, {i} AS slot, CAST({c} AS DOUBLE) AS value FROM prepared' for i, c in enumerate(_NUMERIC))}
        {' '.join(f"UNION ALL SELECT trip_id, label, {len(_NUMERIC)} + coalesce((SELECT sum(n) FROM sizes WHERE name IN ({', '.join(repr(o) for o in _CATEGORICAL[:i]) or 'NULL'})), 0) + place, 1.0E0 FROM prepared JOIN ranked ON name = '{c}' AND value = {c}" for i, c in enumerate(_CATEGORICAL))})"""


def _encoded(spark: SparkSession, folder: str) -> DataFrame:
    """Every trip encoded, with its order's side of the split.

    The joined trips are written once: the encoder and every pass of a training read them back instead
    of joining again.
    """
    rows = trips(spark, folder, *_NUMERIC, *_CATEGORICAL, "dep_delay", "trip_id", "order_key")
    # Delays and causes that are missing are 0; no row is lost.
    rows = quality.handle_missing(rows, ["dep_delay", *CAUSES], ["order_key"])
    labelled = features.binary_label(rows, "dep_delay", 15.0)
    sided = stage(features.with_side(labelled, F.col("order_key")).drop("dep_delay", "order_key"), "trips")
    train = sided.filter(F.col("side") == "train")
    return features.encode(features.fit_encoder(train, _NUMERIC, _CATEGORICAL), sided, "trip_id", "label", "side")


@query(
    "encoded_features",
    f"""WITH {TRIPS_SQL}, {_CODED_SQL}
        SELECT trip_id, label, CAST(slot AS INT) AS slot, round(value, 6) AS value FROM cells WHERE value <> 0""",
)
def encoded_features(spark: SparkSession, folder: str) -> DataFrame:
    """Every slot of every encoded row that is not 0: seven numbers, then the categories of three columns."""
    rows = _encoded(spark, folder).select("trip_id", "label", vector_to_array("features").alias("slots"))
    cells = rows.select("trip_id", "label", F.posexplode("slots").alias("slot", "value"))
    return round_doubles(cells.filter("value <> 0"))


_TEST_SQL = f"""WITH {TRIPS_SQL}, {_CODED_SQL}
    SELECT trip_id, label, true AS in_range, true AS agrees FROM prepared WHERE NOT training"""


def _scored_trips(spark: SparkSession, folder: str, family: str) -> DataFrame:
    """The test side of the trips: whether each score is a probability and agrees with the prediction."""
    rows = _encoded(spark, folder)
    model = models.train(family, rows.filter(F.col("side") == "train"))
    scores = models.predict(model, rows.filter(F.col("side") == "test")).withColumn("score", evaluate.positive_score())
    agrees = (F.col("prediction") == 1) == (F.col("score") > 0.5)
    return scores.select("trip_id", "label", F.col("score").between(0.0, 1.0).alias("in_range"), agrees.alias("agrees"))


@query("trip_logistic_regression", _TEST_SQL)
def trip_logistic_regression(spark: SparkSession, folder: str) -> DataFrame:
    return _scored_trips(spark, folder, "logistic_regression")


@query("trip_random_forest", _TEST_SQL)
def trip_random_forest(spark: SparkSession, folder: str) -> DataFrame:
    return _scored_trips(spark, folder, "random_forest")


@query(
    "trip_label_distribution",
    f"""WITH {TRIPS_SQL}, {_CODED_SQL}
        SELECT CASE WHEN training THEN 'train' ELSE 'test' END AS side, label, CAST(count(*) AS BIGINT) AS count FROM prepared GROUP BY ALL""",
)
def trip_label_distribution(spark: SparkSession, folder: str) -> DataFrame:
    return features.label_distribution(_encoded(spark, folder).select("side", "label"))


_HALF = _PERCENT.format(salt="'sample'", key="CAST(trip_id AS STRING)") + " < 50"
FAMILIES = {"logistic_regression": {}, "random_forest": {}, "boosted_trees": {}, "network": {"maxIter": 10}}


def _half_of(encoded: DataFrame, side: str) -> DataFrame:
    """A half of the encoded trips on one side of the split, by trip, written once for all models."""
    rows = features.hash_sample(encoded.filter(F.col("side") == side), F.col("trip_id"), 50)
    return stage(rows, f"trips-{side}")


@query(
    "trip_sample_distribution",
    f"""WITH {TRIPS_SQL}, {_CODED_SQL}
        SELECT CASE WHEN training THEN 'train' ELSE 'test' END AS side, label, CAST(count(*) AS BIGINT) AS count FROM prepared WHERE {_HALF} GROUP BY ALL""",
)
def trip_sample_distribution(spark: SparkSession, folder: str) -> DataFrame:
    """Labels of both sides after the sample."""
    rows = features.hash_sample(_encoded(spark, folder), F.col("trip_id"), 50)
    return features.label_distribution(rows.select("side", "label"))


@query(
    "trip_evaluation",
    f"""WITH {TRIPS_SQL}, {_CODED_SQL}, sampled AS (SELECT * FROM prepared WHERE NOT training AND {_HALF})
        SELECT family, CAST(count(*) AS BIGINT) AS rows, CAST(sum(label) AS BIGINT) AS positives, true AS recall_is_accuracy, true AS metrics_are_shares,
            true AS area_under_points, CAST(1 AS BIGINT) AS curve_starts
        FROM (VALUES {', '.join(f"('{f}')" for f in FAMILIES)}) t(family), sampled GROUP BY family""",
)
def trip_evaluation(spark: SparkSession, folder: str) -> DataFrame:
    """Four families fitted on half of the training side and measured on half of the test side.

    A confusion matrix holds every row; recall weighted by class is the accuracy; the trapezoids under
    the points of the curve are the area.
    """
    encoded = _encoded(spark, folder)
    train, test = _half_of(encoded, "train"), _half_of(encoded, "test")
    rows = []
    for family, params in FAMILIES.items():
        scores = stage(models.predict(models.train(family, train, **params), test).select("label", "prediction", evaluate.positive_score().alias("score")), "trip-scores")
        confusion = stage(evaluate.confusion_matrix(scores), "trip-confusion")
        by_label = {r["label"]: r["n"] for r in confusion.groupBy("label").agg(F.sum("count").alias("n")).collect()}
        weighted = evaluate.weighted_metrics(confusion).first()
        positive = evaluate.positive_metrics(scores, F.col("score")).first()
        # Sorted by both rates a curve never turns back, so a point's trapezoid needs only the one before.
        points = evaluate.roc_points(scores, F.col("score"), bins=1000)
        before = Window.orderBy("fpr", "tpr")
        trapezoid = (F.col("fpr") - F.lag("fpr").over(before)) * (F.col("tpr") + F.lag("tpr").over(before)) / 2
        curve = points.select("threshold", trapezoid.alias("part")).agg(F.sum("part").alias("under"), F.count_if(F.col("threshold").isNull()).alias("starts")).first()
        area = evaluate.roc_area(scores, F.floor(F.col("score") * 1000) / 1000).first()["area"]
        rows.append((
            family, sum(by_label.values()), by_label.get(1, 0), abs(weighted["accuracy"] - weighted["weighted_recall"]) < 1e-9,
            all(0 <= x <= 1 for x in [*weighted, *positive, area]), abs(curve["under"] - area) < 1e-9, curve["starts"],
        ))
    return spark.createDataFrame(rows, "family string, rows long, positives long, recall_is_accuracy boolean, metrics_are_shares boolean, area_under_points boolean, curve_starts long")


@query(
    "trip_tuning",
    f"WITH {TRIPS_SQL}, {_CODED_SQL}, training_side AS (SELECT * FROM prepared WHERE training), " + _folds_sql("logistic_regression", "training_side", "trip_id"),
)
def trip_tuning(spark: SparkSession, folder: str) -> DataFrame:
    """The whole grid of logistic regression on the whole training side: every row is scored once for each point by a model that has not seen it."""
    fold = features.hash_percent(F.col("trip_id"), "fold") % 5
    train = _encoded(spark, folder).filter(F.col("side") == "train")
    return _left_out(models.cross_validate("logistic_regression", train, parallelism=4, fold=fold))


@query("feature_importances")
def feature_importances(spark: SparkSession, folder: str) -> DataFrame:
    rows = _encoded(spark, folder)
    return evaluate.feature_importances(models.train("random_forest", rows), rows)


@query("model_parameters")
def model_parameters(spark: SparkSession, folder: str) -> DataFrame:
    path = new_scratch_path(spark, "parameters")
    model = models.train("logistic_regression", vectors(spark, folder))
    stored.save_parameters(stored.model_parameters(spark, model), path)
    return stored.load_parameters(spark, path)


@query("parameters_rescore", "SELECT CAST(count(*) AS BIGINT) AS rows, CAST(count(*) AS BIGINT) AS agreeing FROM embeddings")
def parameters_rescore(spark: SparkSession, folder: str) -> DataFrame:
    """Rows whose probability follows from the parameters on storage alone: a join, a sum and the logistic function."""
    path = new_scratch_path(spark, "parameters")
    rows = vectors(spark, folder)
    model = models.train("logistic_regression", rows)
    stored.save_parameters(stored.model_parameters(spark, model), path)
    terms = stored.load_parameters(spark, path)
    cells = rows.select("vec_id", F.posexplode(vector_to_array("features")).alias("slot", "x")).withColumn("term", F.col("slot").cast("string"))
    intercept = F.lit(terms.filter("term = 'intercept'").first()["value"])
    odds = cells.join(terms, "term").groupBy("vec_id").agg((F.sum(F.col("x") * F.col("value")) + intercept).alias("odds"))
    scored_rows = models.predict(model, rows).select("vec_id", evaluate.positive_score().alias("score"))
    same = F.abs(F.col("score") - 1 / (1 + F.exp(-F.col("odds")))) < 1e-9
    return scored_rows.join(odds, "vec_id").agg(F.count("*").alias("rows"), F.count_if(same).alias("agreeing"))


@query(
    "importance_sources",
    f"""WITH {TRIPS_SQL}, {_CODED_SQL}
        SELECT name AS source, CAST(n AS BIGINT) AS slots, true AS in_range, 1.0E0 AS total FROM sizes
        UNION ALL SELECT unnest([{', '.join(repr(c) for c in _NUMERIC)}]), 1, true, 1.0E0""",
)
def importance_sources(spark: SparkSession, folder: str) -> DataFrame:
    """Importances rolled up to the encoded columns: a slot for each number and for each category of the training side, shares that add up to one."""
    rows = _encoded(spark, folder)
    listed = evaluate.feature_importances(models.train("random_forest", rows, numTrees=5), rows)
    total = listed.agg(F.round(F.sum("importance"), 9)).first()[0]
    per_source = listed.groupBy("source").agg(F.count("*").alias("slots"), F.min(F.col("importance").between(0.0, 1.0)).alias("in_range"))
    return per_source.withColumn("total", F.lit(total))


@query("reloaded_model_agrees", "SELECT CAST(count(*) AS BIGINT) AS rows, CAST(count(*) AS BIGINT) AS agreeing FROM embeddings")
def reloaded_model_agrees(spark: SparkSession, folder: str) -> DataFrame:
    """Rows that a saved and reloaded model scores exactly like the model in memory."""
    path = new_scratch_path(spark, "model")
    rows = vectors(spark, folder)
    model = models.train("random_forest", rows)
    stored.save_model(model, path)
    before = models.predict(model, rows).select("vec_id", F.col("prediction").alias("before"))
    after = models.predict(stored.load_model("random_forest", path), rows).select("vec_id", F.col("prediction").alias("after"))
    return before.join(after, "vec_id").agg(F.count("*").alias("rows"), F.count_if(F.col("before") == F.col("after")).alias("agreeing"))


# --- topics ---------------------------------------------------------------------------------------

_SIMPLE = sql.simple_preset("text")
_VOCABULARY_SQL = f"""{sql.document_tokens(_SIMPLE)},
    seen AS (SELECT DISTINCT doc_id, unnest(tokens) AS term FROM tokenised),
    vocabulary AS (SELECT term, count(*) AS df FROM seen GROUP BY term HAVING count(*) >= 2
        AND count(*) <= 0.5 * (SELECT count(*) FROM documents))"""


def _simple_tokens(spark: SparkSession, folder: str) -> DataFrame:
    return presets.with_tokens(documents(spark, folder), "text", "simple")


@query("topic_vocabulary", f"WITH {_VOCABULARY_SQL} SELECT term, CAST(df AS BIGINT) AS df FROM vocabulary")
def topic_vocabulary(spark: SparkSession, folder: str) -> DataFrame:
    return topics.topic_vocabulary(_simple_tokens(spark, folder), "tokens")


@query(
    "bag_of_words",
    f"""WITH {_VOCABULARY_SQL}, words AS (SELECT doc_id, unnest(tokens) AS term FROM tokenised)
        SELECT doc_id, term, CAST(count(*) AS BIGINT) AS count FROM words WHERE term IN (SELECT term FROM vocabulary) GROUP BY doc_id, term""",
)
def bag_of_words(spark: SparkSession, folder: str) -> DataFrame:
    rows = stage(_simple_tokens(spark, folder).select("doc_id", "tokens"), "simple-tokens")
    return topics.bag_of_words(rows, "doc_id", "tokens", topics.topic_vocabulary(rows, "tokens"))


@query("topic_words")
def topic_words(spark: SparkSession, folder: str) -> DataFrame:
    return topics.topic_words(topics.fit_topics(_simple_tokens(spark, folder), "tokens", passes=15))


@query("topic_table")
def topic_table(spark: SparkSession, folder: str) -> DataFrame:
    rows = _simple_tokens(spark, folder)
    words = topics.topic_words(topics.fit_topics(rows, "tokens"))
    return topics.topic_table(words, rows, "tokens")


_TOPICS, _WORDS = 5, 10
_LISTED = f"(SELECT unnest(range({_TOPICS})) AS topic_id) CROSS JOIN (SELECT unnest(range(1, {_WORDS + 1})) AS rank)"


@query(
    "topic_facts",
    f"""WITH {_VOCABULARY_SQL}, known AS (SELECT CAST(count(*) AS BIGINT) AS terms FROM vocabulary),
        words AS (SELECT unnest(tokens) AS term FROM tokenised), used AS (SELECT CAST(count(*) AS BIGINT) AS n FROM words WHERE term IN (SELECT term FROM vocabulary))
        SELECT CAST(topic_id AS INT) AS topic_id, CAST(rank AS INT) AS rank, terms, n AS words, true AS in_vocabulary, true AS falls FROM {_LISTED}, known, used""",
)
def topic_facts(spark: SparkSession, folder: str) -> DataFrame:
    """What holds for the words of any topics: each rank once, weights that fall, words of the vocabulary,
    and counts of all topics that add up to the words of the corpus."""
    rows = stage(_simple_tokens(spark, folder).select("tokens"), "simple-tokens")
    model = topics.fit_topics(rows, "tokens", _TOPICS, passes=5)
    listed = topics.topic_words(model, _WORDS)
    before = F.lag("importance").over(Window.partitionBy("topic_id").orderBy("rank"))
    known = topics.topic_vocabulary(rows, "tokens").select(F.col("term").alias("word"), F.lit(True).alias("known"))
    facts = listed.withColumn("falls", F.coalesce(before >= F.col("importance"), F.lit(True)) & F.col("importance").between(0.0, 1.0)).join(known, "word", "left")
    return facts.select(
        "topic_id", "rank", F.lit(model.size).cast("long").alias("terms"), F.lit(round(sum(model.totals))).cast("long").alias("words"),
        F.coalesce("known", F.lit(False)).alias("in_vocabulary"), "falls",
    )
