"""Fitted models on storage."""

from __future__ import annotations

from pyspark.ml import Model, PipelineModel
from pyspark.ml.classification import (
    GBTClassificationModel,
    LogisticRegressionModel,
    MultilayerPerceptronClassificationModel,
    RandomForestClassificationModel,
)
from pyspark.sql import DataFrame, SparkSession

MODEL_CLASSES = {
    "logistic_regression": LogisticRegressionModel,
    "random_forest": RandomForestClassificationModel,
    "boosted_trees": GBTClassificationModel,
    "network": MultilayerPerceptronClassificationModel,
    "stages": PipelineModel,
}


def save_model(model: Model, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(family: str, path: str) -> Model:
    return MODEL_CLASSES[family].load(path)


def model_parameters(spark: SparkSession, model: LogisticRegressionModel, names: list[str] | None = None) -> DataFrame:
    """``(term, value)``: one row per coefficient and one for the intercept."""
    coefficients = model.coefficients.toArray().tolist()
    names = names or [str(i) for i in range(len(coefficients))]
    rows = [("intercept", float(model.intercept)), *zip(names, coefficients)]
    return spark.createDataFrame(rows, "term string, value double")


def save_parameters(parameters: DataFrame, path: str) -> None:
    parameters.write.mode("overwrite").parquet(path)


def load_parameters(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("term string, value double").parquet(path)
