"""Every registered query: with SQL against it, otherwise its columns and rows."""

import pytest

import __spark_entry__ as driver
from millrace.llm import QUERIES, SQL
from tests.conftest import DATA
from tools import compare


def test_all_operators_are_registered():
    numbers = sorted(int(n[2:].split("_")[0]) for n in QUERIES)
    assert numbers == list(range(1, 14)) and "pipeline" in driver.queries() and set(QUERIES) <= set(driver.queries())


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name, monkeypatch):
    monkeypatch.setitem(compare.QUERIES, name, QUERIES[name])
    monkeypatch.setitem(compare.SQL, name, SQL[name])
    ok, message = compare.compare(spark, compare.connect(DATA), DATA, name)
    assert ok, message


@pytest.mark.parametrize("name, columns", [
    ("op1_language", ["doc_id", "held_out", "lang_pred", "score"]),
    ("op2_simhash", ["doc_id", "fingerprint", "component_id"]),
    ("op4_mixing", ["doc_id", "size", "source_size", "target", "taken"]),
    ("op5_neighbours", ["query_id", "rank", "vec_id", "score"]),
    ("op7_quality", ["doc_id", "score", "keep"]),
    ("op8_main_text", ["page_id", "url", "text", "n_chars"]),
    ("op12_whitening", ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]),
    ("op10_retrieval_packing", ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]),
])
def test_query_columns(spark, name, columns):
    rows = QUERIES[name](spark, DATA)
    assert set(columns) <= set(rows.columns) and rows.count() > 0
