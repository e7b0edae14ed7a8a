"""Run queries in Spark and their SQL in DuckDB on the same tables and compare all rows.

    python tools/compare.py /root/testdata/sf0.01 [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from millrace.catalog import QUERIES, SQL

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def plain(value):
    """A value in a form that compares alike from both engines."""
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6) + 0.0
    if isinstance(value, bool) or value is None:
        return value
    return float(value) if isinstance(value, int) else str(value)


def bag(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(row[i]) for i in order) for row in rows), key=repr)


def connect(folder):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def compare(spark, con, folder, name):
    """``(ok, message)`` for one query."""
    started = time.time()
    df = QUERIES[name](spark, folder)
    rows = [tuple(r) for r in df.collect()]
    took = time.time() - started
    if name not in SQL:
        return bool(rows), f"{len(rows)} rows, no SQL, {took:.1f}s"
    result = con.execute(SQL[name])
    columns = [d[0] for d in result.description]
    expected = result.fetchall()
    text = f"{len(rows)} rows, Spark {took:.1f}s, SQL {time.time() - started - took:.1f}s"
    if sorted(columns) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} against {sorted(columns)}"
    ours, theirs = bag(df.columns, rows), bag(columns, expected)
    if ours != theirs:
        odd = [(a, b) for a, b in zip(ours, theirs) if a != b][:2]
        return False, f"{text}; {len(ours)} against {len(theirs)} rows; first differences {str(odd)[:600]}"
    return bool(rows), text


def session():
    from pyspark.sql import SparkSession

    return (
        SparkSession.builder.master("local[8]").appName("compare")
        .config("spark.sql.shuffle.partitions", "8").config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


if __name__ == "__main__":
    folder, names = sys.argv[1], sys.argv[2:] or list(QUERIES)
    spark = session()
    spark.sparkContext.setLogLevel("ERROR")
    con, failed = connect(folder), []
    for name in names:
        try:
            ok, message = compare(spark, con, folder, name)
        except Exception as error:  # a broken query must not hide the others
            ok, message = False, f"{type(error).__name__}: {str(error)[:800]}"
        print(f"{'ok  ' if ok else 'FAIL'} {name}: {message}", flush=True)
        if not ok:
            failed.append(name)
    print(f"{len(names) - len(failed)} of {len(names)} agree; failed: {failed}")
    sys.exit(bool(failed))
