"""Trips, products and scored rows built from the test tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F



def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def rounded(column: Column | str, digits: int = 6) -> Column:
    return F.round(column, digits)


def round_doubles(df: DataFrame, digits: int = 6) -> DataFrame:
    """Sums differ in their last digits between engines; compare rounded values."""
    return df.select(*[F.round(c, digits).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


# Trip columns as SQL that both engines read alike, and the tables each one needs besides lineitem.
_TRIPS = {
    "trip_id": ("l_orderkey * 10 + l_linenumber", ()),
    "order_key": ("l_orderkey", ()),
    "fl_date": ("CAST(l_shipdate AS DATE)", ()),
    "airline": ("o_orderpriority", ("orders",)),
    "origin": ("s_nationkey", ("supplier",)),
    "dest": ("c_nationkey", ("orders", "customer")),
    "crs_dep_time": ("CAST((l_partkey % 25) * 100 + l_linenumber AS INT)", ()),
    "dep_delay": ("CASE WHEN l_orderkey % 37 <> 0 THEN {delay} END", ("orders",)),
    "arr_delay": ("CASE WHEN l_orderkey % 37 <> 0 AND l_orderkey % 41 <> 0 THEN {delay} + l_quantity - 25 END", ("orders",)),
    "cancelled": ("CASE WHEN o_orderstatus = 'F' THEN 1.0E0 ELSE 0.0E0 END", ("orders",)),
    "cancellation_code": ("CASE WHEN o_orderstatus = 'F' THEN substr(o_orderpriority, 1, 1) END", ("orders",)),
    "distance": ("l_extendedprice / 100", ()),
    "taxi_out": ("CAST(l_suppkey % 30 AS DOUBLE)", ()),
    "taxi_in": ("CAST(l_partkey % 15 AS DOUBLE)", ()),
    "crs_elapsed": ("l_quantity * 6", ()),
    "elapsed": ("CASE WHEN l_orderkey % 41 <> 0 THEN l_quantity * 6 + l_suppkey % 30 END", ()),
    "air_time": ("CASE WHEN l_orderkey % 43 <> 0 THEN l_quantity * 5 + l_partkey % 15 END", ()),
    "due_carrier": ("CASE WHEN l_linenumber <= 3 THEN l_discount * 100 END", ()),
    "due_weather": ("CASE WHEN l_linenumber <= 3 THEN l_tax * 100 END", ()),
    "due_nas": ("CASE WHEN l_linenumber <= 3 THEN CAST(l_partkey % 7 AS DOUBLE) END", ()),
    "due_security": ("CASE WHEN l_linenumber <= 3 THEN CAST(l_suppkey % 5 AS DOUBLE) END", ()),
    "due_late": ("CASE WHEN l_linenumber <= 3 THEN CAST(l_orderkey % 50 AS DOUBLE) END", ()),
}
CAUSES = ["due_carrier", "due_weather", "due_nas", "due_security", "due_late"]
NUMERIC = ["dep_delay", "arr_delay", "taxi_out", "taxi_in", "crs_elapsed", "elapsed", "air_time", "distance", *CAUSES]
TRIP_COLUMNS = list(_TRIPS)

_SPARK_DELAY = "CAST(datediff(l_shipdate, o_orderdate) AS DOUBLE)"
_SQL_DELAY = "CAST(date_diff('day', o_orderdate, l_shipdate) AS DOUBLE)"


def trips(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """The requested trip columns; only the tables they need are joined."""
    needed = {t for c in columns for t in _TRIPS[c][1]}
    rows = table(spark, folder, "lineitem")
    if "orders" in needed:
        # Orders meet their customers first, so that the many more lines are exchanged once.
        placed = table(spark, folder, "orders")
        if "customer" in needed:
            placed = placed.join(table(spark, folder, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        rows = rows.join(placed, F.col("l_orderkey") == F.col("o_orderkey"))
    if "supplier" in needed:
        rows = rows.join(table(spark, folder, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return rows.select(*[F.expr(_TRIPS[c][0].format(delay=_SPARK_DELAY)).alias(c) for c in columns])


TRIPS_SQL = (
    "trips AS (SELECT "
    + ", ".join(f"{e.format(delay=_SQL_DELAY)} AS {c}" for c, (e, _) in _TRIPS.items())
    + " FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey"
    + " JOIN customer ON o_custkey = c_custkey)"
)

_PRODUCTS = {
    "product_id": "event_id",
    "description": "concat(event_type, ' item ', CAST(user_id AS STRING))",
    "price": "CASE WHEN event_id % 50 = 0 THEN 0.0E0 ELSE floor(value * 130) / 100 END",
    "prime": "event_type = 'purchase'",
    "url": "concat('/item/', CAST(event_id AS STRING))",
    "stars": "CAST((event_id * 7) % 11 AS DOUBLE) / 2",
    "reviews": "CASE WHEN event_id % 29 <> 0 THEN user_id END",
}


def products(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select(*[F.expr(e).alias(c) for c, e in _PRODUCTS.items()])


PRODUCTS_SQL = "products AS (SELECT " + ", ".join(f"{e} AS {c}" for c, e in _PRODUCTS.items()) + " FROM events)"

_SCORED = {
    "label": "CASE WHEN l_quantity > 30 THEN 1 ELSE 0 END",
    "score": "floor(l_extendedprice / 11) / 10000",
    "prediction": "CASE WHEN floor(l_extendedprice / 11) / 10000 > 0.5 THEN 1.0E0 ELSE 0.0E0 END",
}


def scored(spark: SparkSession, folder: str) -> DataFrame:
    """Rows with a label, a score in [0, 1] and a prediction."""
    return table(spark, folder, "lineitem").select(*[F.expr(e).alias(c) for c, e in _SCORED.items()])


SCORED_SQL = "scored AS (SELECT " + ", ".join(f"{e} AS {c}" for c, e in _SCORED.items()) + " FROM lineitem)"
