"""Scans, sinks, identifiers and data quality."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from millrace.catalog.registry import query
from millrace.catalog.views import (
    CAUSES, PRODUCTS_SQL, TRIP_COLUMNS, TRIPS_SQL, products, rounded, table, trips,
)
from millrace.operators import features, quality
from millrace.plans.staging import new_scratch_path
from millrace.sources import delimited
from millrace.sources.identifiers import assign_doc_id

EVENT_SCHEMA = delimited.schema_of(event_id="long", user_id="long", event_type="string", value="double")


def _events_as_csv(spark: SparkSession, folder: str) -> str:
    path = new_scratch_path(spark, "events-csv")
    table(spark, folder, "events").select(*EVENT_SCHEMA.fieldNames()).write.option("header", True).csv(path)
    return path


@query("csv_scan", "SELECT event_id, user_id, event_type, value FROM events")
def csv_scan(spark: SparkSession, folder: str) -> DataFrame:
    return delimited.read_csv(spark, _events_as_csv(spark, folder), EVENT_SCHEMA)


@query(
    "csv_scan_inferred",
    "SELECT CAST(event_id AS BIGINT) AS event_id, CAST(user_id AS BIGINT) AS user_id, event_type, value FROM events",
)
def csv_scan_inferred(spark: SparkSession, folder: str) -> DataFrame:
    rows = delimited.read_csv(spark, _events_as_csv(spark, folder))
    return rows.select(F.col("event_id").cast("long"), F.col("user_id").cast("long"), "event_type", "value")


@query(
    "tsv_scan_line_breaks",
    """SELECT o_orderkey AS id, o_orderpriority || chr(10) || '"' || o_orderstatus || '"' || CASE WHEN o_orderkey % 3 = 0 THEN chr(10) || chr(9) ELSE ' end' END AS note,
        o_totalprice AS price FROM orders""",
)
def tsv_scan_line_breaks(spark: SparkSession, folder: str) -> DataFrame:
    """Every order from one file whose fields hold line breaks, tabs and quotes; the file is read in splits."""
    orders = table(spark, folder, "orders").select(
        F.col("o_orderkey").cast("string").alias("id"),
        F.concat("o_orderpriority", F.lit('\n"'), "o_orderstatus", F.lit('"'), F.when(F.col("o_orderkey") % 3 == 0, "\n\t").otherwise(" end")).alias("note"),
        F.col("o_totalprice").cast("string").alias("price"),
    )
    path = new_scratch_path(spark, "orders-tsv")
    orders.write.options(sep="\t", header=True, quote='"', escape='"', quoteAll=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    return delimited.read_tsv(spark, path, delimited.schema_of(id="long", note="string", price="double"))


@query(
    "tsv_scan_complete_rows",
    """SELECT p_partkey AS id, p_name || ' "' || p_type || '"' || chr(9) || p_brand AS name, p_retailprice AS price
       FROM part WHERE p_size BETWEEN 11 AND 45""",
)
def tsv_scan_complete_rows(spark: SparkSession, folder: str) -> DataFrame:
    parts = table(spark, folder, "part").selectExpr(
        "CAST(p_partkey AS STRING) AS id",
        # Small parts lack a name, written as n/a or nothing; large parts lack a price.
        "CASE WHEN p_size <= 5 THEN 'n/a' WHEN p_size > 10 "
        "THEN p_name || ' \"' || p_type || '\"' || chr(9) || p_brand END AS name",
        "CASE WHEN p_size > 45 THEN 'None' ELSE CAST(p_retailprice AS STRING) END AS price",
    )
    path = new_scratch_path(spark, "parts-tsv")
    parts.write.options(sep="\t", header=True, quote='"', escape='"').csv(path)
    return delimited.read_tsv(spark, path, delimited.schema_of(id="long", name="string", price="double"))


@query(
    "product_sink",
    f"""WITH {PRODUCTS_SQL}, ranked AS (SELECT *, row_number() OVER (PARTITION BY description ORDER BY product_id) AS n FROM products)
        SELECT description AS "Description", price AS "Price", prime AS "Prime Product", url AS "URL", stars AS "Stars",
               reviews AS "Reviews", 'laptop' AS keyword, '2024-11-01' AS run_date
        FROM ranked WHERE n = 1""",
)
def product_sink(spark: SparkSession, folder: str) -> DataFrame:
    path = new_scratch_path(spark, "products-tsv")
    named = {"description": "Description", "price": "Price", "prime": "Prime Product", "url": "URL", "stars": "Stars", "reviews": "Reviews"}
    delimited.write_products(
        products(spark, folder).withColumnsRenamed(named), path, "product_id", "laptop", date(2024, 11, 1)
    )
    schema = StructType([*delimited.PRODUCT_SCHEMA.fields, *delimited.schema_of(keyword="string", run_date="string").fields])
    return spark.read.schema(schema).options(sep="\t", header=True, quote='"', escape='"').csv(path)


@query(
    "document_ids",
    """SELECT row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1 AS position, o_orderkey, o_totalprice FROM orders""",
)
def document_ids(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").select("o_orderkey", "o_totalprice", (-F.col("o_totalprice")).alias("descending"))
    return assign_doc_id(orders, "descending", "o_orderkey", name="position").drop("descending")


def _missing_sql(columns: list[str], test: str) -> str:
    return ", ".join(f"CAST(count(*) FILTER (WHERE {test.format(c=c)}) AS BIGINT) AS {c}" for c in columns)


NAN_TRIPS_SQL = TRIPS_SQL + """, noisy AS (SELECT airline, arr_delay, cancellation_code,
    CASE WHEN order_key % 53 = 0 THEN 'NaN'::DOUBLE ELSE dep_delay END AS dep_delay FROM trips)"""


def _noisy(spark: SparkSession, folder: str) -> DataFrame:
    rows = trips(spark, folder, "airline", "dep_delay", "arr_delay", "cancellation_code", "order_key")
    nan = F.when(F.col("order_key") % 53 == 0, F.lit(float("nan"))).otherwise(F.col("dep_delay"))
    return rows.withColumn("dep_delay", nan).drop("order_key")


_NOISY = ["airline", "dep_delay", "arr_delay", "cancellation_code"]


@query("missing_profile", f"WITH {TRIPS_SQL} SELECT {_missing_sql(TRIP_COLUMNS, '{c} IS NULL')} FROM trips")
def missing_profile(spark: SparkSession, folder: str) -> DataFrame:
    return quality.missing_profile(trips(spark, folder, *TRIP_COLUMNS))


@query(
    "missing_profile_with_nan",
    f"WITH {NAN_TRIPS_SQL} SELECT {_missing_sql(['airline', 'cancellation_code'], '{c} IS NULL')}, "
    f"{_missing_sql(['dep_delay', 'arr_delay'], '{c} IS NULL OR isnan({c})')} FROM noisy",
)
def missing_profile_with_nan(spark: SparkSession, folder: str) -> DataFrame:
    return quality.missing_profile(_noisy(spark, folder))


@query("null_profile", f"WITH {NAN_TRIPS_SQL} SELECT {_missing_sql(_NOISY, '{c} IS NULL')} FROM noisy")
def null_profile(spark: SparkSession, folder: str) -> DataFrame:
    return quality.null_profile(_noisy(spark, folder))


_IMPUTED = ["dep_delay", "arr_delay", *CAUSES]
_IMPUTED_SQL = ", ".join(f"coalesce({c}, 0) AS {c}" for c in _IMPUTED)


@query(
    "imputed_delays",
    f"""WITH {TRIPS_SQL}, filled AS (SELECT airline, {_IMPUTED_SQL} FROM trips)
        SELECT airline, CAST(count(*) AS BIGINT) AS trips, {", ".join(f"round(sum({c}), 4) AS {c}" for c in _IMPUTED)}
        FROM filled GROUP BY airline""",
)
def imputed_delays(spark: SparkSession, folder: str) -> DataFrame:
    filled = quality.impute_constant(trips(spark, folder, "airline", *_IMPUTED), _IMPUTED)
    return filled.groupBy("airline").agg(
        F.count("*").alias("trips"), *[rounded(F.sum(c), 4).alias(c) for c in _IMPUTED]
    )


@query(
    "essential_columns_kept",
    f"""WITH {TRIPS_SQL} SELECT airline, CAST(count(*) AS BIGINT) AS trips FROM trips
        WHERE dep_delay IS NOT NULL AND arr_delay IS NOT NULL AND elapsed IS NOT NULL GROUP BY airline""",
)
def essential_columns_kept(spark: SparkSession, folder: str) -> DataFrame:
    rows = trips(spark, folder, "airline", "dep_delay", "arr_delay", "elapsed")
    kept = quality.drop_incomplete(rows, ["dep_delay", "arr_delay", "elapsed"])
    return kept.groupBy("airline").agg(F.count("*").alias("trips"))


@query(
    "missing_values_handled",
    f"""WITH {TRIPS_SQL}, filled AS (SELECT airline, air_time, {_IMPUTED_SQL} FROM trips WHERE air_time IS NOT NULL)
        SELECT airline, CAST(count(*) AS BIGINT) AS trips, round(avg(dep_delay), 6) AS dep_delay, round(avg(due_nas), 6) AS due_nas
        FROM filled GROUP BY airline""",
)
def missing_values_handled(spark: SparkSession, folder: str) -> DataFrame:
    rows = trips(spark, folder, "airline", "air_time", *_IMPUTED)
    clean = quality.handle_missing(rows, _IMPUTED, ["airline", "air_time", *CAUSES])
    return clean.groupBy("airline").agg(
        F.count("*").alias("trips"), rounded(F.avg("dep_delay")).alias("dep_delay"), rounded(F.avg("due_nas")).alias("due_nas")
    )


@query(
    "column_selection",
    f"WITH {TRIPS_SQL} SELECT crs_dep_time, distance, airline, due_weather, dep_delay FROM trips",
)
def column_selection(spark: SparkSession, folder: str) -> DataFrame:
    return trips(spark, folder, "crs_dep_time", "distance", "airline", "due_weather", "dep_delay")


@query(
    "first_per_description",
    f"""WITH {PRODUCTS_SQL}, ranked AS (SELECT *, row_number() OVER (PARTITION BY description ORDER BY product_id) AS n FROM products)
        SELECT product_id, description, price, prime, url, stars, reviews FROM ranked WHERE n = 1""",
)
def first_per_description(spark: SparkSession, folder: str) -> DataFrame:
    return quality.first_per_key(products(spark, folder), ["description"], "product_id")


@query(
    "complete_rows",
    f"WITH {PRODUCTS_SQL} SELECT product_id, description, price, prime, url, stars, reviews FROM products WHERE reviews IS NOT NULL",
)
def complete_rows(spark: SparkSession, folder: str) -> DataFrame:
    return quality.drop_incomplete(products(spark, folder))


@query(
    "boolean_segments",
    f"""WITH {PRODUCTS_SQL} SELECT prime, CAST(count(*) AS BIGINT) AS products, round(sum(price), 4) AS price
        FROM products WHERE prime IS NOT NULL GROUP BY prime""",
)
def boolean_segments(spark: SparkSession, folder: str) -> DataFrame:
    yes, no = quality.segment(products(spark, folder).select("prime", "price"), "prime")
    totals = [F.count("*").alias("products"), rounded(F.sum("price"), 4).alias("price")]
    return yes.groupBy("prime").agg(*totals).unionByName(no.groupBy("prime").agg(*totals))


@query("late_departures", f"WITH {TRIPS_SQL} SELECT airline, order_key, dep_delay FROM trips WHERE dep_delay > 60")
def late_departures(spark: SparkSession, folder: str) -> DataFrame:
    return quality.exceeding(trips(spark, folder, "airline", "order_key", "dep_delay"), "dep_delay", 60)


@query(
    "schema_overview",
    """SELECT CAST(position AS INT) AS position, "column", type, true AS nullable, (SELECT count(*) FROM supplier) AS rows
       FROM (VALUES (0, 's_suppkey', 'bigint'), (1, 's_name', 'string'), (2, 's_nationkey', 'int'), (3, 's_acctbal', 'double'))
       AS t(position, "column", type)""",
)
def schema_overview(spark: SparkSession, folder: str) -> DataFrame:
    return quality.schema_overview(table(spark, folder, "supplier"))


@query(
    "cancellation_codes",
    f"""WITH {TRIPS_SQL} SELECT cancellation_code, CAST(count(*) AS BIGINT) AS count FROM trips GROUP BY cancellation_code""",
)
def cancellation_codes(spark: SparkSession, folder: str) -> DataFrame:
    return quality.category_counts(trips(spark, folder, "cancellation_code"), "cancellation_code")


@query(
    "cancellation_codes_known",
    f"""WITH {TRIPS_SQL} SELECT cancellation_code, CAST(count(*) AS BIGINT) AS count FROM trips
        WHERE cancellation_code IS NOT NULL GROUP BY cancellation_code""",
)
def cancellation_codes_known(spark: SparkSession, folder: str) -> DataFrame:
    return quality.category_counts(trips(spark, folder, "cancellation_code"), "cancellation_code", keep_null=False)


@query(
    "category_index",
    f"""WITH {TRIPS_SQL}, cells AS (
            SELECT 'airline' AS "column", airline AS value FROM trips UNION ALL SELECT 'origin', CAST(origin AS STRING) FROM trips
            UNION ALL SELECT 'cancellation_code', cancellation_code FROM trips),
        counts AS (SELECT "column", value, CAST(count(*) AS BIGINT) AS count FROM cells WHERE value IS NOT NULL GROUP BY ALL)
        SELECT "column", value, count,
               CAST(row_number() OVER (PARTITION BY "column" ORDER BY count DESC, value) - 1 AS INT) AS index FROM counts""",
)
def category_index(spark: SparkSession, folder: str) -> DataFrame:
    columns = ["airline", "origin", "cancellation_code"]
    return features.string_index_table(trips(spark, folder, *columns), columns)


@query("rows_in_memory", "SELECT r_name AS region, CAST(count(*) AS BIGINT) AS nations FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def rows_in_memory(spark: SparkSession, folder: str) -> DataFrame:
    """A table of dictionaries that the caller holds, joined with one on storage."""
    held = [row.asDict() for row in table(spark, folder, "region").select("r_regionkey", "r_name").collect()]
    regions = spark.createDataFrame(held, "r_regionkey long, r_name string")
    nations = table(spark, folder, "nation").join(regions, F.col("n_regionkey") == F.col("r_regionkey"))
    return nations.groupBy(F.col("r_name").alias("region")).agg(F.count("*").alias("nations"))
