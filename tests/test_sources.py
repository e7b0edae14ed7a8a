import datetime as dt

import pytest

from millrace.sources import delimited


def test_csv_with_and_without_schema(spark, tmp_path):
    path = tmp_path / "flights.csv"
    path.write_text("FL_DATE,AIRLINE,DEP_DELAY\n2019-01-09,United,-4.0\n2019-01-10,Delta,\n")
    schema = delimited.schema_of(FL_DATE="date", AIRLINE="string", DEP_DELAY="double")
    for df in (delimited.read_csv(spark, str(path), schema), delimited.read_csv(spark, str(path))):
        assert [tuple(r) for r in df.collect()] == [(dt.date(2019, 1, 9), "United", -4.0), (dt.date(2019, 1, 10), "Delta", None)]


def test_missing_file_is_an_error(spark, tmp_path):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        delimited.read_csv(spark, str(tmp_path / "absent.csv"), delimited.FLIGHT_SCHEMA).collect()


def test_tsv_drops_rows_with_any_missing_value(spark, tmp_path):
    path = tmp_path / "products.tsv"
    path.write_text(
        "Description\tPrice\tPrime Product\tURL\tStars\tReviews\n"
        '"a ""quoted"" one"\t1.5\tTrue\tu\t4.5\t3\n'
        '"two\nlines"\t2.0\tFalse\tu\t0.0\t0\n'
        "NA\t1.0\tTrue\tu\t1.0\t1\nb\t\tTrue\tu\t1.0\t1\nc\t1.0\tTrue\tn/a\t1.0\t1\nd\tx\tTrue\tu\t1.0\t1\n"
    )
    rows = delimited.read_tsv(spark, str(path), delimited.PRODUCT_SCHEMA).collect()
    assert [tuple(r) for r in rows] == [('a "quoted" one', 1.5, True, "u", 4.5, 3), ("two\nlines", 2.0, False, "u", 0.0, 0)]


def test_product_sink_keeps_the_first_and_other_days(spark, tmp_path):
    columns = "n long, Description string, Price double, `Prime Product` boolean, URL string, Stars double, Reviews long"
    df = spark.createDataFrame([(2, "x", 9.0, True, "u2", 1.0, 1), (1, "x", 8.0, False, "u1", 1.0, 1)], columns)
    for day in (1, 2, 2):
        delimited.write_products(df, str(tmp_path / "out"), "n", "pc", dt.date(2024, 11, day))
    for day in (1, 2):
        back = delimited.read_tsv(spark, str(tmp_path / f"out/keyword=pc/run_date=2024-11-0{day}"), delimited.PRODUCT_SCHEMA)
        assert back.columns == delimited.PRODUCT_COLUMNS and [r.Price for r in back.collect()] == [8.0]


def test_smoke_frame(spark):
    assert spark.createDataFrame([(1, "Alice"), (2, "Bob"), (3, "Charlie")], "id long, name string").count() == 3


def test_whole_numbers_may_have_a_zero_fraction(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("a\tb\nx\t3.0\ny\t3.5\nz\t9007199254740993\nw\t1e3\n")
    rows = delimited.read_tsv(spark, str(tmp_path / "t.tsv"), delimited.schema_of(a="string", b="long")).collect()
    assert {r.a: r.b for r in rows} == {"x": 3, "z": 9007199254740993, "w": 1000}


def test_quoted_line_breaks_in_files_read_by_many_tasks(spark, tmp_path):
    import csv
    import random

    draw = random.Random(3)
    texts = ["plain", 'with "quotes" in', "two\nlines", "a\ttab", 'x\n\n"y"\nz\n', "é" * 50, '"', "", "many\n" * 400, "\n"]
    rows = [(str(i), draw.choice(texts), str(draw.random())) for i in range(1500)]
    for part in range(2):
        with open(tmp_path / f"{part}.tsv", "w", newline="") as out:
            writer = csv.writer(out, delimiter="\t", lineterminator="\r\n" if part else "\n")
            writer.writerows([("id", "na me", "v"), *rows[750 * part : 750 * (part + 1)]])
    (tmp_path / "header only.tsv").write_text("id\tna me\tv\n")
    (tmp_path / "empty.tsv").write_text("")
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        assert spark.read.text(str(tmp_path / "0.tsv")).rdd.getNumPartitions() > 10
        found = delimited.read_tsv(spark, str(tmp_path), delimited.schema_of(**{"id": "long", "na me": "string", "v": "double"}))
        assert sorted(tuple(r) for r in found.collect()) == sorted((int(i), t, float(v)) for i, t, v in rows if t)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_files_without_quoted_breaks_are_not_moved(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("a\tb\n" + 'x y\t"q ""z"""\n' * 500)
    rows = delimited.read_tsv(spark, str(tmp_path / "t.tsv"), delimited.schema_of(a="string", b="string"))
    assert [tuple(r) for r in rows.distinct().collect()] == [("x y", 'q "z"')] and rows.count() == 500


def test_quoted_lines_are_counted_in_slices(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(delimited, "SLICE_LINES", 4)
    notes = ["plain", 'a "b"', "two\nlines", "x\n\n\n\n\n\n\n\ny", 'q\n"\nr']
    for part in range(2):
        lines = "".join(f'"{i}"\t"{notes[i % 5].replace(chr(34), chr(34) * 2)}"\n' for i in range(100 * part, 100 * part + 100))
        (tmp_path / f"{part}.tsv").write_text('"id"\t"no\nte"\n' + lines)
    spark.read.text(str(tmp_path)).count()
    rows = delimited.read_tsv(spark, str(tmp_path), delimited.schema_of(id="long", note="string"))
    assert sorted(tuple(r) for r in rows.collect()) == [(i, notes[i % 5]) for i in range(200)]
    # Windows are of slices, and lines are not moved with the names of their files.
    text = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" in text and not any("file" in line for line in text.splitlines() if "Window" in line or "Aggregate" in line)
