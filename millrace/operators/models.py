"""Classifiers: training, tuning by cross-validation, scoring."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import cached_property, reduce
from multiprocessing.pool import ThreadPool

from pyspark.ml import Estimator, Model
from pyspark.ml.classification import (
    GBTClassifier,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    RandomForestClassifier,
)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.evaluate import roc_areas
from millrace.plans.staging import discard, stage

SEED = 42
# Settings and search grids of each model family.
DEFAULTS: dict[str, dict] = {
    "logistic_regression": {},
    "random_forest": {"seed": SEED},
    "boosted_trees": {"maxIter": 10, "seed": SEED},
    "network": {"seed": SEED},
}
GRIDS: dict[str, dict[str, list]] = {
    "logistic_regression": {"regParam": [0.01, 0.1, 0.5], "elasticNetParam": [0.0, 0.5, 1.0]},
    "random_forest": {"numTrees": [20, 50, 100], "maxDepth": [5, 10, 15]},
    "boosted_trees": {"maxDepth": [5, 10], "maxIter": [10, 20]},
}
HIDDEN_LAYERS = [128, 64]
# Nodes of full trees that the driver holds at once while a forest is measured.
FOREST_NODES = 1 << 18

ESTIMATORS = {
    "logistic_regression": LogisticRegression,
    "random_forest": RandomForestClassifier,
    "boosted_trees": GBTClassifier,
    "network": MultilayerPerceptronClassifier,
}


def estimator(family: str, **params) -> Estimator:
    """An estimator over ``features`` and ``label``."""
    return ESTIMATORS[family](featuresCol="features", labelCol="label", **{**DEFAULTS[family], **params})


def feature_count(df: DataFrame, features: str = "features") -> int:
    """Length of the feature vectors, from the column's metadata or else from one row."""
    known = df.schema[features].metadata.get("ml_attr", {}).get("num_attrs")
    return known or len(df.select(features).filter(F.col(features).isNotNull()).first()[0])


def train(family: str, df: DataFrame, **params) -> Model:
    """Fit a model. The network has layers d-128-64-2 unless ``layers`` says otherwise."""
    if family == "network" and "layers" not in params:
        params["layers"] = [feature_count(df), *HIDDEN_LAYERS, 2]
    return estimator(family, **params).fit(df)


def param_grid(base: Estimator, values: Mapping[str, Sequence]) -> list[dict]:
    builder = ParamGridBuilder()
    for name, choices in values.items():
        builder = builder.addGrid(base.getParam(name), list(choices))
    return builder.build()


@dataclass
class Tuned:
    """``scores`` ``(settings, area)``, the mean area over the folds of every grid point;
    ``predictions`` ``(settings, fold, label, score)``, every row scored once for each grid point by a
    model that has not seen its fold; and ``model``, refitted on all rows with the best settings when
    first asked for."""

    refit: Callable[[], Model]
    scores: DataFrame
    predictions: DataFrame

    @cached_property
    def model(self) -> Model:
        return self.refit()


def _settings(point: Mapping) -> str:
    return ", ".join(f"{p.name}={v}" for p, v in sorted(point.items(), key=lambda e: e[0].name))


def _parts(base: Estimator, point: dict, rows: int) -> list[dict]:
    """Settings whose models' raw predictions add up to those of ``point``.

    A forest's are sums over its trees, so it can be grown a few trees at a time, each time from
    another seed. A tree has at most two nodes for each row. Other models are one part.
    """
    settings = {**base.extractParamMap(), **point}
    if not isinstance(base, RandomForestClassifier):
        return [point]
    trees, depth, seed = (settings[base.getParam(name)] for name in ("numTrees", "maxDepth", "seed"))
    most = max(1, FOREST_NODES // max(1, min(2 << depth, 2 * rows)))
    sizes = [min(most, trees - done) for done in range(0, trees, most)]
    return [{**point, base.numTrees: size, base.seed: seed + i} for i, size in enumerate(sizes)]


def cross_validate(
    family: str,
    df: DataFrame,
    grid: Mapping[str, Sequence] | None = None,
    folds: int = 5,
    parallelism: int = 2,
    seed: int = SEED,
    fold: Column | None = None,
) -> Tuned:
    """Choose the grid point with the largest mean ROC area (the first of equals) and refit it on all rows.

    ``fold`` gives a row's fold, 0 to ``folds - 1``; without it folds are random. The encoded rows are
    written once with their folds: every fit reads them back instead of encoding again. The scores of
    all rows left out are one table, and the areas of all folds and grid points come exactly from it in
    one job. Models of a grid are fitted ``parallelism`` at a time; each scores its rows at once and is
    dropped, and a forest of many deep trees is fitted in parts, so the driver holds few trees at a time.
    """
    number = F.floor(F.rand(seed) * folds).cast("int") if fold is None else fold.cast("int")
    rows = stage(df.select("features", "label", number.alias("fold")), "folds")
    total = rows.count()
    base = estimator(family)
    points = param_grid(base, grid or GRIDS[family])

    def left_out(point: dict, held: int) -> DataFrame:
        seen, unseen = rows.filter(F.col("fold") != held), rows.filter(F.col("fold") == held)
        scored = unseen.select(F.lit(_settings(point)).alias("settings"), "fold", "label", "features", F.lit(0.0).alias("score"))
        parts = _parts(base, point, total)
        for number, part in enumerate(parts, 1):
            fitted = base.fit(seen, part)
            raw = F.col("score") + vector_to_array("rawPrediction")[1]
            # Only another part asks for the features again.
            again = ["features"] if number < len(parts) else []
            before, scored = scored, stage(predict(fitted, scored).select("settings", "fold", "label", *again, raw.alias("score")), "left-out")
            if number > 1:
                discard(before)
        return scored

    with ThreadPool(parallelism) as pool:
        parts = pool.starmap(left_out, [(point, held) for point in points for held in range(folds)])
    predictions = stage(reduce(DataFrame.unionAll, parts), "out-of-fold")
    areas = roc_areas(predictions, ["settings", "fold"], F.col("score"))
    # One row per grid point.
    scores = stage(areas.groupBy("settings").agg(F.avg("area").alias("area")), "grid-scores")
    area = {r["settings"]: r["area"] for r in scores.collect()}
    best = max(points, key=lambda p: (area[_settings(p)] is not None, area[_settings(p)] or 0.0))
    return Tuned(lambda: base.fit(rows, best), scores, predictions)


def predict(model: Model, df: DataFrame) -> DataFrame:
    """Rows with ``rawPrediction``, ``probability`` and ``prediction`` added."""
    return model.transform(df)
