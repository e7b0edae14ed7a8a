"""Delimited files."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import (
    BooleanType, DataType, DateType, DoubleType, IntegerType, LongType, StringType, StructField, StructType,
)

from millrace.operators.quality import drop_incomplete, first_per_key
from millrace.plans.joins import fits_broadcast
from millrace.plans.staging import stage

_TYPES = {
    "string": StringType(), "double": DoubleType(), "long": LongType(), "int": IntegerType(),
    "boolean": BooleanType(), "date": DateType(),
}


def schema_of(**columns: str) -> StructType:
    """Schema from column names and type names; unlike DDL it needs no running session."""
    return StructType([StructField(name, _TYPES[kind]) for name, kind in columns.items()])


PRODUCT_SCHEMA = schema_of(**{
    "Description": "string", "Price": "double", "Prime Product": "boolean", "URL": "string",
    "Stars": "double", "Reviews": "long",
})
PRODUCT_COLUMNS = PRODUCT_SCHEMA.fieldNames()

FLIGHT_SCHEMA = schema_of(
    FL_DATE="date", AIRLINE="string", AIRLINE_DOT="string", AIRLINE_CODE="string", DOT_CODE="int",
    FL_NUMBER="int", ORIGIN="string", ORIGIN_CITY="string", DEST="string", DEST_CITY="string",
    CRS_DEP_TIME="int", DEP_TIME="double", DEP_DELAY="double", TAXI_OUT="double", WHEELS_OFF="double",
    WHEELS_ON="double", TAXI_IN="double", CRS_ARR_TIME="int", ARR_TIME="double", ARR_DELAY="double",
    CANCELLED="double", CANCELLATION_CODE="string", DIVERTED="double", CRS_ELAPSED_TIME="double",
    ELAPSED_TIME="double", AIR_TIME="double", DISTANCE="double", DELAY_DUE_CARRIER="double",
    DELAY_DUE_WEATHER="double", DELAY_DUE_NAS="double", DELAY_DUE_SECURITY="double",
    DELAY_DUE_LATE_AIRCRAFT="double",
)

# Field texts that stand for a missing value.
MISSING_TEXTS = [
    "", " ", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]


def read_csv(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """CSV with a header row. Without a schema the types are inferred, which reads the file twice.

    A path that does not exist is an error.
    """
    reader = spark.read.option("header", True)
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)


def read_tsv(spark: SparkSession, path: str, schema: StructType, multi_line: bool = True) -> DataFrame:
    """Tab-separated table with a header row, without the rows that lack any value.

    All columns are read as text first, so that every spelling of a missing value is known before
    the types are applied; a field that does not fit its type counts as missing. ``multi_line``
    allows line breaks inside quotes, in files that are read in splits all the same; see
    :func:`quoted_records`. Without it every line is a record.
    """
    options = {"sep": "\t", "quote": '"', "escape": '"', "nullValue": ""}
    if multi_line:
        names = ", ".join(f"`{f.name}` string" for f in schema.fields)
        fields = F.from_csv("record", names, options)
        raw = quoted_records(spark, path).select(fields.alias("fields")).select("fields.*")
    else:
        as_text = StructType([StructField(f.name, StringType()) for f in schema.fields])
        raw = spark.read.schema(as_text).options(header=True, **options).csv(path)
    typed = raw.select(*[
        _typed(F.when(~F.col(f"`{f.name}`").isin(MISSING_TEXTS), F.col(f"`{f.name}`")), f.dataType).alias(f.name)
        for f in schema.fields
    ])
    return drop_incomplete(typed)


# Lines whose quotes are counted together.
SLICE_LINES = 1 << 14


def quoted_records(spark: SparkSession, path: str) -> DataFrame:
    """``(record)``: the records of delimited files without their headers, line breaks inside quotes kept.

    Files are read in splits. A line with an odd number of quotes opens or closes a quoted field, as
    quotes stand around fields and twice inside them; how many such lines a slice of a split has tells
    the next ones whether they begin inside quotes. Slices without any, outside of quotes, are records
    as they are, and nothing is moved. In the others a line's number of odd lines before it says which
    record it belongs to, and the lines of a record are joined over slices. Slices have up to
    ``SLICE_LINES`` lines, so that no task orders a whole split, and lines are moved without the names
    of their files.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("line")
    ).withColumn("slice", F.floor(F.col("line") / SLICE_LINES))
    odd = ((F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))) % 2).cast("long")
    sizes = lines.groupBy("file", "split", "slice").agg(F.sum(odd).alias("odd_lines"), F.min("line").alias("first_line"))
    earlier = Window.partitionBy("file").orderBy("split", "slice")
    # One row per slice; they are numbered within their file, and the file is known by its first line.
    slices = stage(
        sizes.select(
            "file", "split", "slice", "odd_lines", F.coalesce(F.sum("odd_lines").over(earlier.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("odd_before"),
            F.first("first_line").over(earlier).alias("header"), F.row_number().over(earlier).alias("place"),
        ),
        "slices",
    )
    placed = lines.join(F.broadcast(slices) if fits_broadcast(slices) else slices, ["file", "split", "slice"]).drop("file", "split", "slice")
    quiet = (F.col("odd_lines") == 0) & (F.col("odd_before") % 2 == 0)
    is_header = F.col("line").eqNullSafe(F.col("header"))
    whole = placed.filter(quiet & ~is_header).select("value")

    within = Window.partitionBy("header", "place").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    busy = placed.filter(~quiet).select("value", "line", "header", "place", "odd_before", odd.alias("odd"))
    busy = busy.withColumn("before", F.col("odd_before") + F.coalesce(F.sum("odd").over(within), F.lit(0)))
    alone = (F.col("odd") == 0) & (F.col("before") % 2 == 0)
    single = busy.filter(alone & ~is_header).select("value")
    parts = F.sort_array(F.collect_list(F.struct("place", "line", "value")))
    joined = busy.filter(~alone).groupBy("header", F.floor(F.col("before") / 2).alias("record")).agg(parts.alias("parts"), F.max(is_header).alias("is_header"))
    several = joined.filter(~F.col("is_header")).select(F.array_join("parts.value", "\n").alias("value"))
    records = whole.unionAll(single).unionAll(several).select(F.regexp_replace("value", "\r$", "").alias("record"))
    return records.filter(F.trim("record") != "")


def _typed(text: Column, kind: DataType) -> Column:
    """The text as a value of its type; a whole number may be written with a zero fraction (``3.0``)."""
    if not isinstance(kind, (IntegerType, LongType)):
        return text.try_cast(kind)
    exact = text.try_cast("decimal(38,10)")
    return F.coalesce(text.try_cast(kind), F.when(exact == F.floor(exact), exact.cast("string")).try_cast("decimal(28,0)").try_cast(kind))


def write_products(df: DataFrame, path: str, order_by: str, keyword: str, run_date: date | None = None) -> None:
    """Products as TSV, the first row per description, under ``keyword`` and ``run_date`` folders.

    Only the partition of this keyword and date is replaced.
    """
    unique = first_per_key(df, ["Description"], order_by).select(*PRODUCT_COLUMNS)
    day = (run_date or date.today()).isoformat()
    (
        unique.withColumn("keyword", F.lit(keyword)).withColumn("run_date", F.lit(day))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("keyword", "run_date")
        .options(sep="\t", header=True, quote='"', escape='"')
        .csv(path)
    )
