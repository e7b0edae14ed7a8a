"""Missing-value profiles, cleaning, duplicate removal."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType


def _floating(df: DataFrame) -> set[str]:
    return {f.name for f in df.schema.fields if isinstance(f.dataType, (DoubleType, FloatType))}


def nan_to_null(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Turn NaN into null in floating columns."""
    wanted = _floating(df) & set(df.columns if columns is None else columns)
    return df.select(*[F.nullif(F.col(c), F.lit(float("nan"))).alias(c) if c in wanted else c for c in df.columns])


def missing_profile(df: DataFrame) -> DataFrame:
    """One row with the number of null (and, for floating columns, NaN) values of every column."""
    floating = _floating(df)

    def missing(name: str) -> Column:
        null = F.col(name).isNull()
        return null | F.isnan(name) if name in floating else null

    return df.agg(*[F.count_if(missing(c)).alias(c) for c in df.columns])


def null_profile(df: DataFrame) -> DataFrame:
    """One row with the number of nulls of every column; NaN is a value here."""
    return df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])


def impute_constant(df: DataFrame, columns: Sequence[str], value: float = 0.0) -> DataFrame:
    """Fill missing values (null or NaN) of ``columns`` with a constant."""
    cleaned = nan_to_null(df, columns)
    return cleaned.select(*[F.coalesce(c, F.lit(value)).alias(c) if c in columns else c for c in df.columns])


def drop_incomplete(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Drop rows with a missing value (null or NaN) in any of ``columns``, by default in any column."""
    return df.dropna("any", subset=list(columns) if columns else None)


def handle_missing(df: DataFrame, impute: Sequence[str], essential: Sequence[str], value: float = 0.0) -> DataFrame:
    """Fill ``impute`` with a constant, then drop rows that lack an essential column."""
    return drop_incomplete(impute_constant(df, impute, value), essential)


def first_per_key(df: DataFrame, key: Sequence[str], order_by: str) -> DataFrame:
    """One row per key, the one with the smallest ``order_by`` (unique within a key; null comes last).

    Each task reduces its rows to one per key before the shuffle, so a key with very many copies
    does not pile up anywhere.
    """
    first = F.min_by(F.struct(*df.columns), F.struct(F.col(order_by).isNull(), F.col(order_by))).alias("_row")
    return df.groupBy(*key).agg(first).select("_row.*").select(*df.columns)


def segment(df: DataFrame, flag: str) -> tuple[DataFrame, DataFrame]:
    """Rows where a boolean column is true, and rows where it is false; null is in neither."""
    return df.filter(F.col(flag)), df.filter(~F.col(flag))


def exceeding(df: DataFrame, column: str, threshold: float) -> DataFrame:
    """Rows above a threshold; null and NaN never exceed one."""
    return df.filter((F.col(column) > threshold) & ~F.isnan(column))


def share_exceeding(df: DataFrame, column: str, threshold: float = 0.0) -> DataFrame:
    """``total``, ``exceeding`` and ``rate`` in one pass; the rate of an empty table is null."""
    above = F.coalesce((F.col(column) > threshold) & ~F.isnan(column), F.lit(False))
    counts = df.agg(F.count("*").alias("total"), F.count_if(above).alias("exceeding"))
    return counts.withColumn("rate", F.col("exceeding") / F.nullif(F.col("total"), F.lit(0)))


def schema_overview(df: DataFrame) -> DataFrame:
    """``(position, column, type, nullable, rows)``, one row per column."""
    fields = F.array(*[
        F.struct(
            F.lit(i).alias("position"),
            F.lit(f.name).alias("column"),
            F.lit(f.dataType.simpleString()).alias("type"),
            F.lit(f.nullable).alias("nullable"),
        )
        for i, f in enumerate(df.schema.fields)
    ])
    return df.agg(F.count("*").alias("rows")).select(F.explode(fields).alias("f"), "rows").select("f.*", "rows")


def category_counts(df: DataFrame, column: str, keep_null: bool = True) -> DataFrame:
    """``(column, count)``, most frequent first, ties by value, nulls last among equals."""
    rows = df if keep_null else df.filter(F.col(column).isNotNull())
    counts = rows.groupBy(column).agg(F.count("*").alias("count"))
    return counts.orderBy(F.col("count").desc(), F.col(column).asc_nulls_last())

