"""Product and trip analysis."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.catalog.registry import query
from millrace.catalog.views import (
    CAUSES, NUMERIC, PRODUCTS_SQL, TRIPS_SQL, products, round_doubles, table, trips,
)
from millrace.operators import profile, quality

# Price range edges and labels.
PRICE_EDGES = [0.0, 100.0, 200.0, 300.0, 400.0, 500.0, float("inf")]
PRICE_LABELS = ["<100", "100-200", "200-300", "300-400", "400-500", "500+"]

_RANGE_SQL = "CASE " + " ".join(
    f"WHEN price > {low} AND price <= {'1e308' if high == float('inf') else high} THEN '{label}'"
    for low, high, label in zip(PRICE_EDGES, PRICE_EDGES[1:], PRICE_LABELS)
) + " END"
_LABELS_SQL = ", ".join(f"('{label}')" for label in PRICE_LABELS)
BUCKETED_SQL = PRODUCTS_SQL + f", bucketed AS (SELECT *, {_RANGE_SQL} AS bucket FROM products)"


@query(
    "price_ranges",
    f"""WITH {BUCKETED_SQL}, labels(bucket) AS (VALUES {_LABELS_SQL})
        SELECT l.bucket, CAST(count(b.bucket) AS BIGINT) AS count FROM labels l LEFT JOIN bucketed b ON b.bucket = l.bucket GROUP BY l.bucket""",
)
def price_ranges(spark: SparkSession, folder: str) -> DataFrame:
    return profile.bucket_counts(products(spark, folder), "price", PRICE_EDGES, PRICE_LABELS)


@query(
    "price_box_statistics",
    f"""WITH {BUCKETED_SQL}, boxes AS (
            SELECT bucket, quantile_cont(price, 0.25) AS q1, quantile_cont(price, 0.5) AS median, quantile_cont(price, 0.75) AS q3
            FROM bucketed WHERE bucket IS NOT NULL GROUP BY bucket)
        SELECT b.bucket, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3, CAST(count(*) AS BIGINT) AS count,
               min(price) AS min, max(price) AS max,
               min(price) FILTER (WHERE price BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS lower_whisker,
               max(price) FILTER (WHERE price BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS upper_whisker
        FROM bucketed b JOIN boxes USING (bucket) GROUP BY b.bucket, q1, median, q3""",
)
def price_box_statistics(spark: SparkSession, folder: str) -> DataFrame:
    return round_doubles(profile.box_statistics(products(spark, folder), "price", PRICE_EDGES, PRICE_LABELS))


@query(
    "top_rated_products",
    f"WITH {PRODUCTS_SQL} SELECT product_id, description, stars FROM products ORDER BY stars DESC, product_id LIMIT 10",
)
def top_rated_products(spark: SparkSession, folder: str) -> DataFrame:
    return profile.top_rows(products(spark, folder).select("product_id", "description", "stars"), "stars", 10, "product_id")


@query(
    "most_expensive_products",
    f"WITH {PRODUCTS_SQL} SELECT product_id, description, price FROM products ORDER BY price DESC, product_id LIMIT 10",
)
def most_expensive_products(spark: SparkSession, folder: str) -> DataFrame:
    return profile.top_rows(products(spark, folder).select("product_id", "description", "price"), "price", 10, "product_id")


def _describe_sql(column: str) -> str:
    return f"""SELECT prime, '{column}' AS "column", CAST(count({column}) AS BIGINT) AS count, round(avg({column}), 6) AS mean,
        round(stddev_samp({column}), 6) AS stddev, CAST(min({column}) AS DOUBLE) AS min, CAST(max({column}) AS DOUBLE) AS max,
        round(quantile_cont({column}, 0.25), 6) AS q1, round(quantile_cont({column}, 0.5), 6) AS median,
        round(quantile_cont({column}, 0.75), 6) AS q3 FROM products GROUP BY prime"""


@query("segments_described", f"WITH {PRODUCTS_SQL} " + " UNION ALL ".join(map(_describe_sql, ["price", "stars", "reviews"])))
def segments_described(spark: SparkSession, folder: str) -> DataFrame:
    return round_doubles(profile.describe_by(products(spark, folder), "prime", ["price", "stars", "reviews"]))


@query("price_star_points", f"WITH {PRODUCTS_SQL} SELECT price, stars, reviews, prime, description FROM products")
def price_star_points(spark: SparkSession, folder: str) -> DataFrame:
    return profile.points(products(spark, folder), "price", "stars", "reviews", "prime", "description")


@query("star_review_points", f"WITH {PRODUCTS_SQL} SELECT stars, reviews, prime, description FROM products")
def star_review_points(spark: SparkSession, folder: str) -> DataFrame:
    return profile.points(products(spark, folder), "stars", "reviews", "prime", "description")


@query(
    "price_star_grid",
    f"""WITH {PRODUCTS_SQL} SELECT CAST(floor(price / 50.0) AS BIGINT) AS x_bin, CAST(floor(stars / 0.5) AS BIGINT) AS y_bin,
        CAST(count(*) AS BIGINT) AS count FROM products GROUP BY ALL""",
)
def price_star_grid(spark: SparkSession, folder: str) -> DataFrame:
    return profile.point_bins(products(spark, folder), "price", "stars", 50.0, 0.5)


_SUMMARY = ["airline", "order_key", "dep_delay", "arr_delay", "cancellation_code", "origin"]


def _summary_sql(column: str) -> str:
    text = column in ("airline", "cancellation_code")
    mean, spread = ("NULL", "NULL") if text else (f"avg({column})", f"stddev_samp({column})")
    return f"""SELECT '{column}' AS "column", CAST(count({column}) AS BIGINT) AS count, round(CAST({mean} AS DOUBLE), 6) AS mean,
        round(CAST({spread} AS DOUBLE), 6) AS stddev, CAST(min({column}) AS STRING) AS min, CAST(max({column}) AS STRING) AS max FROM trips"""


@query("summary_statistics", f"WITH {TRIPS_SQL} " + " UNION ALL ".join(map(_summary_sql, _SUMMARY)))
def summary_statistics(spark: SparkSession, folder: str) -> DataFrame:
    return round_doubles(profile.summary(trips(spark, folder, *_SUMMARY)))


@query(
    "delay_mean_and_stddev",
    f"WITH {TRIPS_SQL} " + " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS stddev FROM trips"""
        for c in ("dep_delay", "arr_delay")
    ),
)
def delay_mean_and_stddev(spark: SparkSession, folder: str) -> DataFrame:
    delays = trips(spark, folder, "dep_delay", "arr_delay")
    return round_doubles(profile.mean_and_stddev(delays, ["dep_delay", "arr_delay"]))


@query(
    "delay_rate",
    f"""WITH {TRIPS_SQL} SELECT CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (WHERE arr_delay > 30) AS BIGINT) AS exceeding,
        round(count(*) FILTER (WHERE arr_delay > 30) / count(*), 6) AS rate FROM trips""",
)
def delay_rate(spark: SparkSession, folder: str) -> DataFrame:
    return round_doubles(quality.share_exceeding(trips(spark, folder, "arr_delay"), "arr_delay", 30))


def _histogram_sql(column: str, bins: int = 30) -> str:
    return f"""WITH {TRIPS_SQL}, e AS (SELECT min({column}) AS lo, (max({column}) - min({column})) / {bins} AS w FROM trips),
        counts AS (SELECT least(floor(({column} - lo) / w), {bins - 1}) AS bin, count(*) AS n FROM trips, e WHERE {column} IS NOT NULL GROUP BY 1)
        SELECT CAST(b AS INT) AS bin, round(lo + b * w, 6) AS lower, round(lo + (b + 1) * w, 6) AS upper, CAST(coalesce(n, 0) AS BIGINT) AS count
        FROM range({bins}) r(b) CROSS JOIN e LEFT JOIN counts ON counts.bin = b"""


@query("departure_delay_histogram", _histogram_sql("dep_delay"))
def departure_delay_histogram(spark: SparkSession, folder: str) -> DataFrame:
    return round_doubles(profile.histogram(trips(spark, folder, "dep_delay"), "dep_delay"))


@query("arrival_delay_histogram", _histogram_sql("arr_delay"))
def arrival_delay_histogram(spark: SparkSession, folder: str) -> DataFrame:
    return round_doubles(profile.histogram(trips(spark, folder, "arr_delay"), "arr_delay"))


def _density_sql(column: str) -> str:
    return f"""WITH {TRIPS_SQL}, e AS (
            SELECT count({column}) AS n, min({column}) AS lo, (max({column}) - min({column})) / 199 AS step,
                   stddev_samp({column}) * pow(count({column}), -0.2) AS h FROM trips),
        v AS (SELECT {column} AS value, count(*) AS c FROM trips WHERE {column} IS NOT NULL GROUP BY 1)
        SELECT CAST(p AS INT) AS point, round(any_value(lo + p * step), 6) AS x,
               round(sum(c * exp(-pow((lo + p * step - value) / h, 2) / 2)) / any_value(n * h * sqrt(2 * pi())), 9) AS density
        FROM range(200) r(p), e, v GROUP BY p"""


def _density(spark: SparkSession, folder: str, column: str) -> DataFrame:
    curve = profile.density(trips(spark, folder, column), column)
    return curve.select("point", F.round("x", 6).alias("x"), F.round("density", 9).alias("density"))


@query("delay_density", _density_sql("dep_delay"))
def delay_density(spark: SparkSession, folder: str) -> DataFrame:
    return _density(spark, folder, "dep_delay")


@query("arrival_delay_density", _density_sql("arr_delay"))
def arrival_delay_density(spark: SparkSession, folder: str) -> DataFrame:
    return _density(spark, folder, "arr_delay")


@query(
    "airline_rates",
    f"""WITH {TRIPS_SQL} SELECT airline, round(avg(dep_delay), 6) AS avg_dep_delay, round(avg(arr_delay), 6) AS avg_arr_delay,
        CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (WHERE cancelled = 1) AS BIGINT) AS flagged,
        round(count(*) FILTER (WHERE cancelled = 1) / count(*), 6) AS rate FROM trips GROUP BY airline""",
)
def airline_rates(spark: SparkSession, folder: str) -> DataFrame:
    rows = trips(spark, folder, "airline", "dep_delay", "arr_delay", "cancelled")
    return round_doubles(profile.group_rates(rows, "airline", {"avg_dep_delay": "dep_delay", "avg_arr_delay": "arr_delay"}, "cancelled"))


@query("origin_delays", f"WITH {TRIPS_SQL} SELECT origin, round(avg(dep_delay), 6) AS avg_dep_delay FROM trips GROUP BY origin")
def origin_delays(spark: SparkSession, folder: str) -> DataFrame:
    return round_doubles(profile.ranked_means(trips(spark, folder, "origin", "dep_delay"), "origin", "dep_delay", "avg_dep_delay"))


@query("destination_delays", f"WITH {TRIPS_SQL} SELECT dest, round(avg(arr_delay), 6) AS avg_arr_delay FROM trips GROUP BY dest")
def destination_delays(spark: SparkSession, folder: str) -> DataFrame:
    return round_doubles(profile.ranked_means(trips(spark, folder, "dest", "arr_delay"), "dest", "arr_delay", "avg_arr_delay"))


_MEANS = {"avg_dep_delay": "dep_delay", "avg_arr_delay": "arr_delay"}
_MEANS_SQL = "round(avg(dep_delay), 6) AS avg_dep_delay, round(avg(arr_delay), 6) AS avg_arr_delay"


@query(
    "hourly_delays",
    f"WITH {TRIPS_SQL} SELECT CAST(floor(crs_dep_time / 100) AS INT) AS hour_of_day, {_MEANS_SQL} FROM trips GROUP BY 1",
)
def hourly_delays(spark: SparkSession, folder: str) -> DataFrame:
    rows = trips(spark, folder, "crs_dep_time", "dep_delay", "arr_delay")
    hours = profile.hour_of_day(F.col("crs_dep_time")).alias("hour_of_day")
    return round_doubles(profile.mean_by(rows, hours, _MEANS)).orderBy("hour_of_day")


@query(
    "weekday_delays",
    f"WITH {TRIPS_SQL} SELECT CAST(isodow(fl_date) - 1 AS INT) AS day_of_week, {_MEANS_SQL} FROM trips GROUP BY 1",
)
def weekday_delays(spark: SparkSession, folder: str) -> DataFrame:
    rows = trips(spark, folder, "fl_date", "dep_delay", "arr_delay")
    days = profile.weekday(F.col("fl_date")).alias("day_of_week")
    return round_doubles(profile.mean_by(rows, days, _MEANS)).orderBy("day_of_week")


@query(
    "correlation_matrix",
    f"WITH {TRIPS_SQL}, wide AS (SELECT "
    + ", ".join(f"corr({a}, {b}) AS {a}__{b}" for i, a in enumerate(NUMERIC) for b in NUMERIC[i + 1:])
    + " FROM trips) "
    + " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, "
        + ("1.0E0" if a == b else f"round({a}__{b}, 6)" if NUMERIC.index(a) < NUMERIC.index(b) else f"round({b}__{a}, 6)")
        + " AS r FROM wide"
        for a in NUMERIC for b in NUMERIC
    ),
)
def correlation_matrix(spark: SparkSession, folder: str) -> DataFrame:
    return round_doubles(profile.correlation_matrix(trips(spark, folder, *NUMERIC), NUMERIC))


@query(
    "delay_cause_correlation",
    f"WITH {TRIPS_SQL} SELECT " + ", ".join(f"round(corr({c}, arr_delay), 6) AS corr_{c}" for c in CAUSES) + " FROM trips",
)
def delay_cause_correlation(spark: SparkSession, folder: str) -> DataFrame:
    return round_doubles(profile.correlation_with(trips(spark, folder, *CAUSES, "arr_delay"), CAUSES, "arr_delay"))
