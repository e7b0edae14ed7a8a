"""Quality of scored rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Model
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.plans.ordered import running_totals


def positive_score(probability: str = "probability") -> Column:
    """Probability of class 1 from a probability vector."""
    return vector_to_array(F.col(probability))[1]


def confusion_matrix(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """``(label, prediction, count)``, sorted."""
    counts = df.groupBy(label, prediction).agg(F.count("*").alias("count"))
    return counts.orderBy(label, prediction)


def weighted_metrics(confusion: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """One row: accuracy and, weighted by true-label share, precision, recall and F1.

    Works on the counts of a confusion matrix, so the scored rows are read once for all metrics.
    """
    actual, predicted = F.col(label).cast("double"), F.col(prediction).cast("double")
    right = F.when(actual == predicted, F.col("count")).otherwise(0)
    none = F.lit(0).cast("long")
    sides = F.array(
        F.struct(actual.alias("class"), F.col("count").alias("true_rows"), none.alias("predicted_rows"), right.alias("right")),
        F.struct(predicted.alias("class"), none.alias("true_rows"), F.col("count").alias("predicted_rows"), none.alias("right")),
    )
    per_class = confusion.select(F.explode(sides).alias("s")).groupBy("s.class").agg(
        F.sum("s.true_rows").alias("t"), F.sum("s.predicted_rows").alias("p"), F.sum("s.right").alias("r")
    )
    precision = F.coalesce(F.col("r") / F.nullif(F.col("p"), F.lit(0)), F.lit(0.0))
    recall = F.coalesce(F.col("r") / F.nullif(F.col("t"), F.lit(0)), F.lit(0.0))
    f1 = F.coalesce(2 * precision * recall / F.nullif(precision + recall, F.lit(0.0)), F.lit(0.0))
    total = F.sum("t")
    return per_class.agg(
        (F.sum("r") / total).alias("accuracy"),
        (F.sum(precision * F.col("t")) / total).alias("weighted_precision"),
        (F.sum(recall * F.col("t")) / total).alias("weighted_recall"),
        (F.sum(f1 * F.col("t")) / total).alias("f1"),
    )


def positive_metrics(df: DataFrame, score: Column, label: str = "label", threshold: float = 0.5) -> DataFrame:
    """One row: accuracy, and precision, recall and F1 of class 1; undefined ratios are 0."""
    hit, true = score > threshold, F.col(label) == 1
    counts = df.agg(
        F.count_if(hit & true).alias("tp"), F.count_if(hit & ~true).alias("fp"),
        F.count_if(~hit & true).alias("fn"), F.count_if(~hit & ~true).alias("tn"),
    )

    def ratio(top: Column, bottom: Column) -> Column:
        return F.coalesce(top / F.nullif(bottom, F.lit(0)), F.lit(0.0))

    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return counts.select(
        ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"),
        ratio(tp, tp + fp).alias("precision"),
        ratio(tp, tp + fn).alias("recall"),
        ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
    )


def _ranked(df: DataFrame, score: Column, label: str) -> DataFrame:
    """Positives and negatives per distinct score and above it, highest score first."""
    counts = df.groupBy(score.alias("score")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg")
    )
    return running_totals(counts, [F.col("score").desc()], ["pos", "neg"])


def roc_area(df: DataFrame, score: Column, label: str = "label") -> DataFrame:
    """One row ``area``: exact area under the ROC curve, equal scores counted half; null with one class."""
    ranked = _ranked(df, score, label)
    concordant = F.sum(F.col("neg") * (F.col("pos_upto") - F.col("pos") / 2))
    pairs = F.sum("pos") * F.sum("neg").cast("double")
    return ranked.agg((concordant / F.nullif(pairs, F.lit(0.0))).alias("area"))


def roc_areas(df: DataFrame, groups: Sequence[str], score: Column, label: str = "label") -> DataFrame:
    """``(*groups, rows, positives, area)``: the exact area of every group, null where it has one class.

    Scores are counted first and ranked over many tasks, so neither many groups nor large ones matter.
    """
    counts = df.groupBy(*groups, score.alias("score")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg")
    )
    ranked = running_totals(counts, [F.col("score").desc()], ["pos", "neg"], groups)
    concordant = F.sum(F.col("neg") * (F.col("pos_upto") - F.col("pos") / 2))
    pairs = F.sum("pos") * F.sum("neg").cast("double")
    return ranked.groupBy(*groups).agg(
        F.sum(F.col("pos") + F.col("neg")).alias("rows"), F.sum("pos").alias("positives"), (concordant / F.nullif(pairs, F.lit(0.0))).alias("area")
    )


def roc_points(df: DataFrame, score: Column, label: str = "label", bins: int | None = None) -> DataFrame:
    """``(threshold, fpr, tpr)`` per distinct score, and (0, 0) without threshold.

    ``bins`` rounds scores in [0, 1] down to that many steps when fewer points are enough.
    """
    stepped = score if bins is None else F.floor(score * bins) / bins
    ranked = _ranked(df, stepped, label)
    points = ranked.select(
        F.col("score").alias("threshold"),
        (F.col("neg_upto") / F.nullif("neg_all", F.lit(0))).alias("fpr"),
        (F.col("pos_upto") / F.nullif("pos_all", F.lit(0))).alias("tpr"),
    )
    origin = df.sparkSession.range(1).select(
        F.lit(None).cast("double").alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")
    )
    return origin.unionByName(points)


def feature_importances(model: Model, df: DataFrame, features: str = "features") -> DataFrame:
    """``(feature, source, importance)``, highest first, one row per vector slot.

    Slot names come from the metadata of the feature column; ``source`` is the encoded column a
    one-hot slot belongs to, for a roll-up with ``groupBy("source")``.
    """
    spark = df.sparkSession
    groups = df.schema[features].metadata.get("ml_attr", {}).get("attrs", {})
    named = {a["idx"]: a["name"] for entries in groups.values() for a in entries if "name" in a}
    rows = []
    for slot, importance in enumerate(model.featureImportances.toArray().tolist()):
        name = named.get(slot, f"slot_{slot}")
        rows.append((name, name.split("_Vec_")[0], importance))
    table = spark.createDataFrame(rows, "feature string, source string, importance double")
    return table.orderBy(F.col("importance").desc(), "feature")
