import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import evaluate

# Published confusion counts (true 0 as 0, 0 as 1, 1 as 0, 1 as 1) with their accuracy, weighted
# precision, weighted recall and F1.
PUBLISHED = [
    ((248525, 534, 24714, 26676), (0.9159657712290605, 0.92166558647969, 0.9159657712290605, 0.9049850951155272), 1e-12),
    ((248201, 858, 27829, 23561), (0.904519569044996, 0.9104157910733708, 0.904519569044996, 0.8899869187952589), 1e-12),
    ((247966, 1093, 11922, 39468), (0.9567, 0.9574, 0.9567, 0.9546), 5e-5),
]


@pytest.mark.parametrize("counts, expected, tolerance", PUBLISHED)
def test_metrics_from_published_confusion_counts(spark, counts, expected, tolerance):
    rows = [(l, float(p), c) for (l, p), c in zip([(0, 0), (0, 1), (1, 0), (1, 1)], counts)]
    got = evaluate.weighted_metrics(spark.createDataFrame(rows, "label int, prediction double, count long")).first()
    assert tuple(got) == pytest.approx(expected, abs=tolerance)


def scored(spark, rows):
    return spark.createDataFrame([(l, float(s)) for l, s in rows], "label int, score double").repartition(3)


def test_metrics_equal_the_library_evaluator(spark):
    from pyspark.ml.evaluation import BinaryClassificationEvaluator, MulticlassClassificationEvaluator

    random.seed(3)
    rows = [(l := random.randint(0, 1), round(min(1, max(0, random.gauss(0.4 + 0.2 * l, 0.2))), 2)) for _ in range(400)]
    df = scored(spark, rows).withColumn("prediction", (F.col("score") > 0.5).cast("double"))
    got = evaluate.weighted_metrics(evaluate.confusion_matrix(df)).first()
    judge = MulticlassClassificationEvaluator()
    for name, value in zip(("accuracy", "weightedPrecision", "weightedRecall", "f1"), got):
        assert value == pytest.approx(judge.setMetricName(name).evaluate(df))
    area = evaluate.roc_area(df, F.col("score")).first().area
    assert area == pytest.approx(BinaryClassificationEvaluator(rawPredictionCol="score", numBins=0).evaluate(df))
    points = sorted((r.fpr, r.tpr) for r in evaluate.roc_points(df, F.col("score")).collect())
    assert area == pytest.approx(sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(points, points[1:])))
    coarse = evaluate.roc_points(df, F.col("score"), bins=10).count()
    assert coarse <= 12


@pytest.mark.parametrize("rows, area", [
    ([(1, 0.9), (1, 0.8), (0, 0.1)], 1.0),
    ([(1, 0.1), (0, 0.9)], 0.0),
    ([(1, 0.5), (0, 0.5), (0, 0.5)], 0.5),
    ([(1, 0.5), (1, 0.7)], None),
])
def test_roc_area_cases(spark, rows, area):
    assert evaluate.roc_area(scored(spark, rows), F.col("score")).first().area == area


def test_confusion_matrix_is_sorted(spark):
    df = spark.createDataFrame([(1, 1.0), (0, 1.0), (1, 0.0), (1, 1.0)], "label int, prediction double")
    assert [tuple(r) for r in evaluate.confusion_matrix(df).collect()] == [(0, 1.0, 1), (1, 0.0, 1), (1, 1.0, 2)]


def test_positive_metrics_are_zero_where_undefined(spark):
    assert tuple(evaluate.positive_metrics(scored(spark, [(0, 0.5), (0, 0.1)]), F.col("score")).first()) == (1.0, 0.0, 0.0, 0.0)
    got = evaluate.positive_metrics(scored(spark, [(1, 0.9), (1, 0.2), (0, 0.6), (0, 0.5)]), F.col("score")).first()
    assert tuple(got) == pytest.approx((0.5, 0.5, 0.5, 0.5))
