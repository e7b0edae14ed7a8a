from collections import Counter

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from millrace.operators import frequency


def frame(spark, lists):
    return spark.createDataFrame([(i, tokens) for i, tokens in enumerate(lists)], "doc_id long, tokens array<string>")


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from("abcd"), max_size=6), min_size=1, max_size=6), st.integers(1, 3))
def test_counts_equal_a_plain_count(spark, lists, n):
    expected = Counter(" ".join(t[i:i + n]) for t in lists for i in range(len(t) - n + 1))
    counts = {r.gram: r["count"] for r in frequency.ngram_counts(frame(spark, lists), "tokens", n).collect()}
    assert counts == expected


def test_most_common_breaks_ties_by_text(spark):
    counts = frequency.ngram_counts(frame(spark, [["b", "a", "c", "c"], []]), "tokens")
    assert [(r.gram, r["count"]) for r in frequency.most_common(counts, 2).collect()] == [("c", 2), ("a", 1)]


def test_grams_with_the_same_label_stay_apart(spark):
    rows = spark.createDataFrame([(["a b", "c"],), (["a", "b c"],), (["a", "b c"],)], "tokens array<string>")
    assert sorted(tuple(r) for r in frequency.ngram_counts(rows, "tokens", 2).collect()) == [("a b c", 1), ("a b c", 2)]
