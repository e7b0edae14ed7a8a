import hashlib
import math
import os
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import impact, search
from millrace.plans.staging import stage

DOCS = {
    0: "red laptop with dual-band wifi and red mouse",
    1: "blue laptop with mouse",
    2: "red laptop with dual-band wifi and red mouse",
    3: "a b c",
    4: "laptop stand with hub and blue laptop",
    5: "garden chair with red garden table",
    6: "",
}
QUERIES = {0: "red laptop mouse", 1: "unknown words only", 2: "blue laptop", 3: "garden chair"}


def frame(spark, texts):
    return spark.createDataFrame([(i, t.split()) for i, t in texts.items()], "id long, tokens array<string>").repartition(3)


def brute_force(docs, queries, min_df=2, max_df=0.9):
    def grams(text):
        words = [w for w in text.replace("-", " ").split() if len(w) > 1]
        return Counter(" ".join(words[i:i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1))

    unique = {}
    for i in sorted(docs):
        if docs[i] not in unique.values():
            unique[i] = docs[i]
    tf = {i: grams(t) for i, t in unique.items()}
    df = Counter(term for counts in tf.values() for term in counts)
    n = len(unique)
    idf = {t: math.log((1 + n) / (1 + d)) + 1 for t, d in df.items() if min_df <= d <= max_df * n}

    def unit(counts):
        weights = {t: c * idf[t] for t, c in counts.items() if t in idf}
        norm = math.sqrt(sum(w * w for w in weights.values()))
        return {t: w / norm for t, w in weights.items()}

    vectors = {i: unit(c) for i, c in tf.items() if any(t in idf for t in c)}
    scores = {}
    for q, text in queries.items():
        counts = grams(text)
        if not any(t in idf for t in counts):
            continue
        wanted = unit(counts)
        for i, vector in vectors.items():
            score = sum(w * vector[t] for t, w in wanted.items() if t in vector)
            if score > 0:
                scores[q, i] = score
    return scores, idf, vectors


def test_exact_scores_equal_brute_force(spark):
    index = search.tfidf_index(frame(spark, DOCS), "id", "tokens")
    scores, idf, vectors = brute_force(DOCS, QUERIES)
    assert {r.term: r.idf for r in index.terms.collect()} == pytest.approx(idf)
    got = {(r.query_id, r.doc_id): r.score for r in search.cosine_scores(index, frame(spark, QUERIES), "id", "tokens").collect()}
    assert got == pytest.approx(scores)
    weights = defaultdict(dict)
    for r in search.tfidf_weights(index).collect():
        weights[r.doc_id][r.term] = r.weight
    assert {i: pytest.approx(v) for i, v in vectors.items()} == dict(weights)


def test_scores_lie_between_0_and_1_and_a_document_matches_itself(spark):
    docs = frame(spark, DOCS)
    index = search.tfidf_index(docs, "id", "tokens")
    rows = search.cosine_scores(index, docs, "id", "tokens").collect()
    assert all(0 < r.score <= 1 + 1e-9 for r in rows)
    assert all(r.score == pytest.approx(1) for r in rows if r.query_id == r.doc_id)


def test_hits_are_thresholded_ranked_and_ties_go_by_id(spark):
    scores = spark.createDataFrame([(1, 7, 0.5), (1, 3, 0.5), (1, 9, 0.05), (1, 2, 0.0499), (2, 1, 0.9), (1, 4, 0.7)], "query_id long, doc_id long, score double")
    hits = search.top_hits(scores, k=4).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.doc_id, r["rank"]) for r in hits] == [(1, 4, 1), (1, 3, 2), (1, 7, 3), (1, 9, 4), (2, 1, 1)]


def test_saved_index_gives_the_same_hits(spark, tmp_path):
    index = search.tfidf_index(frame(spark, DOCS), "id", "tokens")
    index.save(str(tmp_path))
    again = search.TfIdfIndex.load(spark, str(tmp_path))
    def hits(i):
        return sorted((r.query_id, r.doc_id, round(r.score, 9)) for r in search.search(i, frame(spark, QUERIES), "id", "tokens").collect())
    assert hits(index) == hits(again) != []


def hits_of(rows):
    return sorted((r.query_id, r.doc_id, round(r.score, 9)) for r in rows.collect())


def test_stored_weights_give_the_same_hits_and_prune_folders(spark, tmp_path):
    index = search.tfidf_index(frame(spark, DOCS), "id", "tokens")
    search.save_weights(index, str(tmp_path / "w"), per_bucket=3)
    stored = search.Buckets.load(spark, str(tmp_path / "w"))
    assert stored.buckets > 4
    queries = frame(spark, QUERIES)
    assert hits_of(search.stored_search(stored, index, queries, "id", "tokens", 3, 1e-9)) == hits_of(search.search(index, queries, "id", "tokens", 3, 1e-9)) != []
    wanted = stage(index.terms.limit(1), "one")
    found = stored.of(wanted, "term")
    assert re.search(r"PartitionFilters: \[[^\]]*bucket#", full_plan(spark, found))
    assert found.select("term").distinct().collect() == wanted.select("term").collect()
    # Fewer words asked for, fewer files read.
    bucket = wanted.select(search._bucket("term", stored.buckets).alias("b")).first().b
    read = stored.rows.filter(F.col("bucket") == bucket).select(F.input_file_name()).distinct().count()
    assert read < stored.rows.select(F.input_file_name()).distinct().count()


def full_plan(spark, df):
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    try:
        return df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")


def zipf_weights(spark, documents, queries, seed):
    """Unit TF-IDF vectors over words of very uneven frequency, as ``(term, doc_id, weight)`` and wanted weights."""
    draw = np.random.default_rng(seed)
    counts = [Counter(np.minimum(draw.pareto(0.4, 25).astype(int), 2999).tolist()) for _ in range(documents + queries)]
    df = Counter(t for c in counts[:documents] for t in c)
    def rows(some):
        out = []
        for i, c in enumerate(some):
            w = {t: n * math.log((documents + 1) / (df[t] + 1)) for t, n in c.items()}
            norm = math.sqrt(sum(x * x for x in w.values()))
            out += [(f"t{t}", i, x / norm) for t, x in w.items() if x > 0]
        return out
    docs, asked = rows(counts[:documents]), rows(counts[documents:])
    return docs, asked, spark.createDataFrame(docs, "term string, doc_id long, weight double"), spark.createDataFrame([(q, t, w) for t, q, w in asked], "query_id long, term string, wanted double")


@pytest.mark.parametrize("k, min_score", [(3, 0.05), (5, 0.5), (2, 1e-6)])
def test_block_bounds_give_the_exact_best_and_spare_most_pairs(spark, k, min_score):
    documents, queries = 2000, 20
    docs, asked, weights, wanted = zipf_weights(spark, documents, queries, k)
    blocks, wanted = stage(impact.with_blocks(weights), "blocks"), stage(wanted, "wanted")
    by_term = defaultdict(list)
    for t, d, w in docs:
        by_term[t].append((d, w))
    scores = defaultdict(float)
    for t, q, w in asked:
        for d, x in by_term[t]:
            scores[q, d] += w * x
    best = {q: [d for _, d in sorted((-round(s, 6), d) for (p, d), s in scores.items() if p == q and round(s, 6) >= min_score)[:k]] for q in range(queries)}
    found = defaultdict(list)
    for r in impact.top_k(blocks, wanted, k, min_score, 6).orderBy("query_id", "rank").collect():
        assert r.score == pytest.approx(scores[r.query_id, r.doc_id], abs=1e-6)
        found[r.query_id].append(r.doc_id)
    assert {q: d for q, d in best.items() if d} == dict(found)
    # Both ways to the end give the same.
    partial, essential, left = impact.candidates(blocks, wanted, k, min_score)
    again = impact.ranked(impact._finished(blocks, left, stage(partial, "candidates")), k, min_score, 6)
    assert sorted((r.query_id, r["rank"], r.doc_id) for r in again.collect()) == [(q, i + 1, d) for q, ds in sorted(found.items()) for i, d in enumerate(ds)]
    if min_score > 0.1:
        assert impact._sums(blocks, essential).count() < 0.2 * documents * queries


def test_top_hits_of_odd_weights(spark):
    weights = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 0.0), ("b", 1, -1.0), ("a", 4, 1e-300), ("c", 5, 0.5), ("c", 6, 0.5)], "term string, doc_id long, weight double")
    wanted = spark.createDataFrame([(1, "a", 1.0), (2, "c", 1.0), (3, "zzz", 1.0)], "query_id long, term string, wanted double")
    found = impact.top_k(stage(impact.with_blocks(weights), "b"), stage(wanted, "w"), 2, 0.05).collect()
    assert sorted((r.query_id, r["rank"], r.doc_id) for r in found) == [(1, 1, 1), (2, 1, 5), (2, 2, 6)]
    nothing = stage(impact.with_blocks(weights.limit(0)), "b")
    assert impact.top_k(nothing, stage(wanted, "w"), 2, 0.05).count() == 0


def test_hashed_search_equals_brute_force(spark):
    def slot(t):
        return int(hashlib.md5(t.encode()).hexdigest()[:8], 16) % 50
    counts = {i: Counter(slot(w) for w in t.split()) for i, t in DOCS.items()}
    df = Counter(s for c in counts.values() for s in c)
    def unit(c):
        w = {s: n * math.log((len(DOCS) + 1) / (df[s] + 1)) for s, n in c.items() if s in df}
        norm = math.sqrt(sum(x * x for x in w.values()))
        return {s: x / norm for s, x in w.items() if x > 0}
    docs = {i: unit(c) for i, c in counts.items()}
    index = search.hashed_index(frame(spark, DOCS), "id", "tokens", 50)
    assert {(r.doc_id, r.term): pytest.approx(r.weight) for r in index.weights.collect()} == {(i, s): w for i, d in docs.items() for s, w in d.items()}
    found = {(r.query_id, r.doc_id): r.score for r in search.hashed_search(index, frame(spark, QUERIES), "id", "tokens", 100, 1e-9).collect()}
    wanted = {}
    for q, text in QUERIES.items():
        u = unit(Counter(slot(w) for w in text.split()))
        wanted |= {(q, i): x for i, d in docs.items() if (x := sum(u[s] * d.get(s, 0) for s in u)) > 0}
    assert found == pytest.approx(wanted)


def test_duplicates_keep_the_smallest_id(spark):
    kept = {r.doc_id for r in search.distinct_documents(frame(spark, DOCS), "id", "tokens").collect()}
    assert kept == {0, 1, 3, 4, 5, 6}


def test_inverted_index_has_all_positions_in_bounded_blocks(spark):
    docs = spark.createDataFrame([(0, ["a"]), (1, ["b", "a", "a"]), (2, []), (5, ["a"])], "id long, tokens array<string>")
    index = {(r.token, r.block): [tuple(p) for p in r.posting_list] for r in search.inverted_index(docs, "id", "tokens", block_size=2).collect()}
    assert index == {("a", 0): [(0, 0), (1, 1), (1, 2)], ("b", 0): [(1, 0)], ("a", 2): [(5, 0)]}


def test_postings_and_distances(spark):
    docs = spark.createDataFrame([(0, "x a b a c b".split()), (1, "b a".split()), (2, "a q q b".split())], "id long, tokens array<string>")
    index = search.postings(docs, "id", "tokens")
    assert {(r.doc_id, r.token): (r.tf, r.positions) for r in index.collect()}[0, "a"] == (2, [1, 3])
    pairs = spark.createDataFrame([(1, "a", "b"), (2, "b", "b"), (3, "a", "zzz")], "pair_id long, first string, second string")
    def near(k):
        return sorted(tuple(r) for r in search.within_distance(index, pairs, k).collect())
    assert near(1) == [(1, 0, 1)]
    assert near(3) == [(1, 0, 2), (1, 2, 1), (2, 0, 1)]


def test_stored_postings_come_back_from_few_folders(spark, tmp_path):
    index = search.postings(frame(spark, DOCS), "id", "tokens")
    path = str(tmp_path / "p")
    search.save_postings(index, path, block_size=2, per_bucket=4)
    everything = search.stored_postings(spark, path, index.select("token").distinct())
    plain = lambda df: sorted((r.doc_id, r.token, r.tf, tuple(r.positions)) for r in df.select("doc_id", "token", "tf", "positions").collect())
    assert plain(everything) == plain(index)
    one = stage(index.select("token").limit(1), "one")
    token = one.first().token
    found = search.stored_postings(spark, path, one)
    assert plain(found) == plain(index.filter(F.col("token") == token))
    assert re.search(r"PartitionFilters: \[[^\]]*bucket#", full_plan(spark, found))
    assert search.Buckets.load(spark, path).buckets > 2


def test_empty_queries_fail(spark):
    ok = spark.createDataFrame([(1, "a")], "id long, text string")
    assert search.require_queries(ok, "text").first().text == "a"
    for bad in ("", "  ", None):
        with pytest.raises(Exception, match="must not be empty"):
            search.require_queries(spark.createDataFrame([(1, bad)], "id long, text string"), "text").collect()


def test_hashed_scores(spark):
    docs = frame(spark, DOCS)
    model = search.hashed_tfidf_model(docs, "tokens")
    idf = model.stages[1]
    assert idf.docFreq and idf.numDocs == len(DOCS)
    rows = search.hashed_cosine_scores(model, docs, "id", docs, "id").collect()
    score = {(r.query_id, r.doc_id): r.score for r in rows}
    assert score[0, 0] == pytest.approx(1) and score[0, 2] == pytest.approx(1)
    assert not any(6 in pair for pair in score)

    n = len(DOCS)
    df = Counter(w for t in DOCS.values() for w in set(t.split()))
    def unit(text):
        w = {t: c * math.log((n + 1) / (df[t] + 1)) for t, c in Counter(text.split()).items()}
        norm = math.sqrt(sum(v * v for v in w.values()))
        return {t: v / norm for t, v in w.items()}
    a, b = unit(DOCS[1]), unit(DOCS[4])
    assert score[1, 4] == pytest.approx(sum(a[t] * b.get(t, 0) for t in a), abs=1e-6)


def test_hits_get_their_text(spark):
    hits = spark.createDataFrame([(1, 5, 0.4)], "query_id long, doc_id long, score double")
    docs = spark.createDataFrame(list(DOCS.items()), "id long, text string")
    assert search.attach_text(hits, docs, "id", "text").first().description == DOCS[5]


def test_search_does_not_move_documents_or_run_python(spark):
    index = search.tfidf_index(frame(spark, DOCS), "id", "tokens")
    scores = search.cosine_scores(index, frame(spark, QUERIES), "id", "tokens")
    plan = search.top_hits(scores)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "WindowGroupLimit" in plan
    assert "Python" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
    plan = search.search(index, frame(spark, QUERIES), "id", "tokens")._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    assert not any(word in plan for word in ("Python", "Arrow", "CartesianProduct", "NestedLoop"))


def test_weights_are_the_same_with_broadcast_and_joined_terms(spark, monkeypatch):
    def weights():
        index = search.tfidf_index(frame(spark, DOCS), "id", "tokens")
        some = stage(index.terms.limit(5), "some")
        early = sorted((r.term, r.doc_id, round(r.weight, 12)) for r in index.weights_of(some).collect())
        late = sorted((r.term, r.doc_id, round(r.weight, 12)) for r in index.weights_of(some).collect())
        assert early == late
        return sorted((r.term, r.doc_id, round(r.weight, 12)) for r in search.tfidf_weights(index).collect())
    broadcast = weights()
    monkeypatch.setattr(search, "fits_broadcast", lambda df: False)
    assert weights() == broadcast != []


def test_phrases_of_any_length(spark):
    texts = [(1, "a b c d a b c"), (2, "a b x c"), (3, "c b a"), (4, "b c a b c d")]
    index = search.postings(spark.createDataFrame([(i, t.split()) for i, t in texts], "id long, tokens array<string>"), "id", "tokens")
    phrases = spark.createDataFrame([(1, ["a", "b", "c"]), (2, ["b"]), (3, ["a", "b", "c", "d"]), (4, ["c", "b", "c"]), (5, ["b", "c", "a", "b", "c"])], "pair_id long, tokens array<string>")
    got = {(r.pair_id, r.doc_id): r.matches for r in search.phrase_matches(index, phrases).collect()}
    assert got == {(1, 1): 2, (1, 4): 1, (2, 1): 2, (2, 2): 1, (2, 3): 1, (2, 4): 2, (3, 1): 1, (3, 4): 1, (5, 4): 1}


def test_weights_attach_terms_once(spark, monkeypatch):
    """Weights and norms come from one pass over the documents' terms."""
    docs = spark.createDataFrame([(1, ["red", "fox"]), (2, ["red", "hen"]), (3, ["fox", "hen", "hen"]), (None, ["red", "hen", "fox"])], "doc_id long, tokens array<string>")
    index = search.tfidf_index(docs, "doc_id", "tokens")
    passes, weighted = [], search.TfIdfIndex._weighted
    monkeypatch.setattr(search.TfIdfIndex, "_weighted", lambda self, *a: passes.append(a) or weighted(self, *a))
    squares = {}
    for r in search.tfidf_weights(index).collect():
        squares[r.doc_id] = squares.get(r.doc_id, 0) + r.weight**2
    assert len(passes) == 1 and squares == {1: pytest.approx(1), 2: pytest.approx(1), 3: pytest.approx(1)}


def test_distances_repeat_no_list_of_positions(spark):
    """Rows of one id count as one document; a word of many pairs meets only the words before it."""
    docs = spark.createDataFrame([(0, "a x b".split()), (0, "a x b".split()), (0, "q b".split()), (None, "a b".split())], "id long, tokens array<string>")
    pairs = spark.createDataFrame([(1, "a", "b"), (1, "a", "b"), (2, "q", "x"), (3, "x", "b"), (4, None, "b")], "pair_id long, first string, second string")
    found = search.within_distance(search.postings(docs, "id", "tokens"), pairs, 2)
    assert sorted((r.pair_id, str(r.doc_id), r.matches) for r in found.collect()) == [(1, "0", 2), (1, "None", 1), (2, "0", 1), (3, "0", 1)]
    assert "SortAggregate" not in full_plan(spark, found)


def test_a_phrase_is_looked_up_by_its_rarest_token(spark, monkeypatch):
    texts = [(i, "the old fox" if i == 3 else "the old the old hen") for i in range(9)] + [(None, "the old fox")]
    index = search.postings(spark.createDataFrame([(i, t.split()) for i, t in texts], "id long, tokens array<string>"), "id", "tokens")
    phrases = spark.createDataFrame([(1, ["the", "old", "fox"]), (None, ["old", "fox"]), (2, ["the", "cat"])], "pair_id long, tokens array<string>")
    asked, match = [], search.match_by_key
    monkeypatch.setattr(search, "match_by_key", lambda rows, wanted, *a: asked.extend(r.token for r in wanted.collect()) or match(rows, wanted, *a))
    found = search.phrase_matches(index, phrases).collect()
    assert sorted(((r.pair_id, r.doc_id, r.matches) for r in found), key=str) == sorted([(1, 3, 1), (1, None, 1), (None, 3, 1), (None, None, 1)], key=str)
    assert sorted(asked) == ["cat", "fox", "fox"]


def test_hashed_cells_are_exchanged_once(spark):
    index = search.hashed_index(frame(spark, DOCS), "id", "tokens", 50)
    counts = stage(search._hashed_counts(frame(spark, DOCS), "id", "tokens", 50), "counts")
    weights = search._hashed_unit(counts, index.slots)
    assert full_plan(spark, weights).count("Exchange hashpartitioning") == 1
    squares = {}
    for r in weights.collect():
        squares[r.doc_id] = squares.get(r.doc_id, 0) + r.weight**2
    assert squares and all(v == pytest.approx(1) for v in squares.values())


def test_searches_exchange_sums_not_postings(spark):
    """What is added to partial scores is summed by document and query before it is exchanged."""
    weights = spark.createDataFrame([(t, d, w) for t, w in (("a", 0.75), ("b", 0.5), ("c", 0.25)) for d in range(20)], "term string, doc_id long, weight double")
    blocks = stage(impact.with_blocks(weights), "blocks")
    plan = stage(blocks.select("block").distinct().select(F.lit(7).alias("query_id"), "block", F.lit(0.5).alias("wanted")), "plan")
    partial = stage(spark.createDataFrame([(7, 3, 1.0), (7, 4, 2.0), (8, 5, 3.0)], "query_id int, doc_id long, score double"), "partial")
    found = impact._finished(blocks, plan, partial)
    assert sorted(tuple(r) for r in found.collect()) == [(7, 3, 1.75), (7, 4, 2.75), (8, 5, 3.0)]
    assert "partial_sum" in full_plan(spark, found)


def test_terms_are_exchanged_before_they_are_counted(spark, monkeypatch):
    """No task sums terms that others hold, too; the partitions follow the size of the written tokens."""
    counted, write = [], search.stage
    monkeypatch.setattr(search, "stage", lambda df, name: counted.append((name, full_plan(spark, df))) or write(df, name))
    monkeypatch.setattr(search, "TOKEN_BYTES", 500)
    index = search.tfidf_index(frame(spark, DOCS), "id", "tokens")
    plan = dict(counted)["terms"]
    assert plan.rindex("partial_count") < plan.index("Exchange hashpartitioning(term")
    assert "REPARTITION_BY_NUM" in plan and index.documents.rdd.getNumPartitions() > 4
    assert {r.term: r.idf for r in index.terms.collect()} == pytest.approx(brute_force(DOCS, {})[1])


def test_rounds_give_the_same_index_and_hits(spark, tmp_path, monkeypatch):
    """Terms and documents taken some at a time, as a large corpus is, are those of one go."""
    def results(path):
        index = search.tfidf_index(frame(spark, DOCS), "id", "tokens")
        queries = frame(spark, QUERIES)
        hits = search.search(index, queries, "id", "tokens", 3, 1e-9)
        index.__dict__.pop("norms")
        search.save_weights(index, path, 4)
        stored = search.stored_search(search.Buckets.load(spark, path), index, queries, "id", "tokens", 3, 1e-9)
        index.__dict__.pop("norms")
        tables = index.terms, search.tfidf_weights(index), search.cosine_scores(index, queries, "id", "tokens"), index.norms, hits, stored
        return [sorted(map(tuple, t.collect())) for t in tables]

    once = results(str(tmp_path / "once"))
    names, write = [], search.stage
    monkeypatch.setattr(search, "stage", lambda df, name: names.append(name) or write(df, name))
    monkeypatch.setattr(search, "fits_broadcast", lambda df: False)
    monkeypatch.setattr(search, "ROUND_BYTES", 1)
    rounds = results(str(tmp_path / "rounds"))
    assert names.count("terms") == search.MAX_ROUNDS // 2 and names.count("weighted-documents") == 3 * search.MAX_ROUNDS
    assert all(len(a) and len(a) == len(b) for a, b in zip(once, rounds))
    for a, b in zip(once, rounds):
        assert all(v == (pytest.approx(w) if isinstance(w, float) else w) for x, y in zip(a, b) for v, w in zip(x, y))


def test_saved_weights_leave_no_copy_of_the_documents(spark, tmp_path, monkeypatch):
    written, write = {}, search.stage
    monkeypatch.setattr(search, "stage", lambda df, name: written.setdefault(name, write(df, name)))
    index = search.tfidf_index(frame(spark, DOCS), "id", "tokens")
    search.save_weights(index, str(tmp_path / "w"))
    folder = os.path.dirname(spark._jvm.java.net.URI(written["weighted-documents"].inputFiles()[0]).getPath())
    assert not os.path.exists(folder) and index.norms.count() == len(brute_force(DOCS, {})[2])
