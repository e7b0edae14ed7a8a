"""Feature encoding, labels, splits and samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.plans.ordered import running_totals


def string_index_table(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(column, value, count, index)``: most frequent value 0, ties alphabetical, nulls left out.

    All columns are counted in one pass; the numbering works on the counts, over many tasks.
    """
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])
    counts = (
        df.select(F.explode(cells).alias("cell")).select("cell.*").filter("value is not null")
        .groupBy("column", "value").agg(F.count("*").alias("count"))
    )
    ones = counts.withColumn("_one", F.lit(1).cast("long"))
    numbered = running_totals(ones, [F.col("count").desc(), F.col("value")], ["_one"], ["column"])
    return numbered.select("column", "value", "count", (F.col("_one_upto") - 1).cast("int").alias("index"))


def fit_encoder(
    df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], handle_invalid: str = "keep"
) -> PipelineModel:
    """Stages that index and one-hot encode ``categorical`` and assemble all into ``features``.

    Fit it on the training rows. ``handle_invalid="keep"`` gives values unseen there an all-zero
    code; with ``"error"`` they fail, and the rarest value is the all-zero one.
    """
    indexed = [f"{c}_Index" for c in categorical]
    encoded = [f"{c}_Vec" for c in categorical]
    stages = []
    if categorical:
        stages += [
            StringIndexer(inputCols=list(categorical), outputCols=indexed, handleInvalid=handle_invalid),
            OneHotEncoder(inputCols=indexed, outputCols=encoded),
        ]
    stages.append(VectorAssembler(inputCols=[*numeric, *encoded], outputCol="features"))
    return Pipeline(stages=stages).fit(df.select(*numeric, *categorical))


def encode(encoder: PipelineModel, df: DataFrame, *keep: str) -> DataFrame:
    """``(features, *keep)``."""
    return encoder.transform(df).select("features", *keep)


def binary_label(df: DataFrame, column: str, threshold: float = 15.0, name: str = "label") -> DataFrame:
    """Add 1 where the value is strictly above the threshold, else 0 (also for null and NaN)."""
    above = (F.col(column) > threshold) & ~F.isnan(column)
    return df.withColumn(name, F.when(above, 1).otherwise(0))


def hash_percent(key: Column, salt: str = "") -> Column:
    """A number from 0 to 99 fixed by the key, so it survives repartitioning and re-runs."""
    digest = F.substring(F.md5(F.concat(F.lit(salt), key.cast("string"))), 1, 8)
    return F.conv(digest, 16, 10).cast("long") % 100


def with_side(df: DataFrame, key: Column, train_percent: int = 80) -> DataFrame:
    """Add ``side``: ``train`` or ``test``, decided by a hash of the key."""
    return df.withColumn("side", F.when(hash_percent(key) < train_percent, "train").otherwise("test"))


def train_test_split(df: DataFrame, key: Column | None = None, train: float = 0.8, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Training and test rows: by hash of ``key``, or at random without one."""
    if key is None:
        first, second = df.randomSplit([train, 1 - train], seed=seed)
        return first, second
    sided = with_side(df, key, round(train * 100))
    return tuple(sided.filter(F.col("side") == s).drop("side") for s in ("train", "test"))


def hash_sample(df: DataFrame, key: Column, percent: int, salt: str = "sample") -> DataFrame:
    """Keep about ``percent`` of the rows, decided by a salted hash of the key."""
    return df.filter(hash_percent(key, salt) < percent)


def bernoulli_sample(df: DataFrame, fraction: float, seed: int = 42) -> DataFrame:
    return df.sample(fraction=fraction, seed=seed)


def label_distribution(df: DataFrame, side: str = "side", label: str = "label") -> DataFrame:
    """Row counts per side and label."""
    return df.groupBy(side, label).agg(F.count("*").alias("count"))
