"""Indexes over whole documents and searches with whole query tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.catalog import textsql as sql
from millrace.catalog.registry import query
from millrace.catalog.views import round_doubles, table
from millrace.catalog.wording import SIMPLE, documents
from millrace.operators import presets, search
from millrace.plans.staging import new_scratch_path


def _tokens(spark: SparkSession, folder: str, preset: str = "plain") -> DataFrame:
    return presets.with_tokens(documents(spark, folder), "text", preset)


def _queries(spark: SparkSession, folder: str, preset: str = "plain") -> DataFrame:
    checked = search.require_queries(table(spark, folder, "benchmark"), "text")
    return presets.with_tokens(checked, "text", preset)


_PLACES = f"""tokenised AS (SELECT doc_id, {SIMPLE} AS tokens FROM documents),
    places AS (SELECT doc_id, unnest(tokens) AS token, unnest(range(len(tokens))) AS pos FROM tokenised)"""


@query(
    "inverted_index",
    f"""WITH {_PLACES} SELECT token, doc_id // 1024 AS block, CAST(count(*) AS BIGINT) AS places, CAST(count(DISTINCT doc_id) AS BIGINT) AS documents,
        string_agg(doc_id || ':' || pos, ' ' ORDER BY doc_id, pos) AS posting_list FROM places GROUP BY ALL""",
)
def inverted_index(spark: SparkSession, folder: str) -> DataFrame:
    index = search.inverted_index(_tokens(spark, folder), "doc_id", "tokens")
    entries = F.transform("posting_list", lambda e: F.concat_ws(":", e["doc_id"].cast("string"), e["pos"].cast("string")))
    return index.select(
        "token",
        "block",
        F.size("posting_list").cast("long").alias("places"),
        F.size(F.array_distinct("posting_list.doc_id")).cast("long").alias("documents"),
        F.array_join(entries, " ").alias("posting_list"),
    )


@query(
    "postings",
    f"""WITH {_PLACES} SELECT doc_id, token, CAST(count(*) AS BIGINT) AS tf, string_agg(CAST(pos AS STRING), ' ' ORDER BY pos) AS positions
        FROM places GROUP BY doc_id, token""",
)
def postings(spark: SparkSession, folder: str) -> DataFrame:
    index = search.postings(_tokens(spark, folder), "doc_id", "tokens")
    return index.withColumn("positions", F.array_join(F.col("positions").cast("array<string>"), " "))


@query(
    "stored_index_lookup",
    f"""WITH {_PLACES}, wanted AS (SELECT DISTINCT unnest({SIMPLE}) AS token FROM benchmark)
        SELECT doc_id, token, CAST(count(*) AS BIGINT) AS tf FROM places WHERE token IN (SELECT token FROM wanted) GROUP BY doc_id, token""",
)
def stored_index_lookup(spark: SparkSession, folder: str) -> DataFrame:
    path = new_scratch_path(spark, "index")
    search.save_postings(search.postings(_tokens(spark, folder), "doc_id", "tokens"), path)
    wanted = _queries(spark, folder).select(F.explode("tokens").alias("token")).distinct()
    return search.stored_postings(spark, path, wanted).select("doc_id", "token", "tf")


@query(
    "phrase_matches",
    f"""WITH {_PLACES}, q AS (SELECT item_id AS pair_id, {SIMPLE} AS t FROM benchmark)
        SELECT pair_id, a.doc_id, CAST(count(*) AS BIGINT) AS matches
        FROM q JOIN places a ON a.token = t[1] JOIN tokenised d ON d.doc_id = a.doc_id
        WHERE list_slice(d.tokens, a.pos + 1, a.pos + len(t)) = t GROUP BY pair_id, a.doc_id""",
)
def phrase_matches(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that quote a whole benchmark text."""
    phrases = _queries(spark, folder).select(F.col("item_id").alias("pair_id"), "tokens")
    return search.phrase_matches(search.postings(_tokens(spark, folder), "doc_id", "tokens"), phrases)


@query(
    "proximity_matches",
    f"""WITH {_PLACES}, q AS (SELECT item_id, {SIMPLE} AS t FROM benchmark),
        neighbours AS (SELECT item_id, unnest(range(1, len(t))) AS place, t FROM q),
        pairs AS (SELECT item_id, place, t[place] AS first, t[place + 1] AS second FROM neighbours),
        wanted AS (SELECT DISTINCT first, second FROM pairs),
        near AS (SELECT DISTINCT first, second, b.doc_id, b.pos FROM wanted JOIN places a ON a.token = first, range(1, 6) r(d)
            JOIN places b ON b.token = second AND b.doc_id = a.doc_id AND b.pos = a.pos + r.d),
        counted AS (SELECT first, second, doc_id, count(*) AS n FROM near GROUP BY ALL)
        SELECT item_id, CAST(place AS INT) AS place, doc_id, CAST(n AS BIGINT) AS matches FROM pairs JOIN counted USING (first, second)""",
)
def proximity_matches(spark: SparkSession, folder: str) -> DataFrame:
    """Documents in which a word of a benchmark text is followed by its next word within five places, for every word."""
    words = _queries(spark, folder).select("item_id", "tokens", F.posexplode("tokens").alias("at", "first"))
    pairs = words.select("item_id", (F.col("at") + 1).alias("place"), "first", F.get("tokens", F.col("at") + 1).alias("second")).filter("second is not null")
    distinct = pairs.select(F.struct("first", "second").alias("pair_id"), "first", "second").distinct()
    near = search.within_distance(search.postings(_tokens(spark, folder), "doc_id", "tokens"), distinct, 5)
    counted = near.select("pair_id.first", "pair_id.second", "doc_id", "matches")
    return pairs.join(counted, ["first", "second"]).select("item_id", "place", "doc_id", "matches")


def _prepared_sql(preset: str) -> str:
    return f"prepared AS (SELECT doc_id, {preset} AS tokens FROM documents), asked AS (SELECT item_id, {preset} AS tokens FROM benchmark)"


# The rich preset is a chain of steps; documents and queries go through it together.
_RICH = f"""both_texts AS (SELECT 'd' || doc_id AS key, text FROM documents UNION ALL SELECT 'q' || item_id, text FROM benchmark), {sql.rich_steps("text", "both_texts", "key")},
    prepared AS MATERIALIZED (SELECT CAST(substr(key, 2) AS BIGINT) AS doc_id, tokens FROM rich WHERE starts_with(key, 'd')),
    asked AS MATERIALIZED (SELECT CAST(substr(key, 2) AS BIGINT) AS item_id, tokens FROM rich WHERE starts_with(key, 'q'))"""


def _unique_sql(prepared: str) -> str:
    return f"""{prepared},
    unique_documents AS MATERIALIZED (SELECT min(doc_id) AS doc_id, array_to_string(tokens, ' ') AS text FROM prepared GROUP BY array_to_string(tokens, ' '))"""


@query("distinct_documents", f"WITH {_unique_sql(_prepared_sql(sql.simple_preset('text')))} SELECT doc_id, text FROM unique_documents")
def distinct_documents(spark: SparkSession, folder: str) -> DataFrame:
    return search.distinct_documents(_tokens(spark, folder, "simple"), "doc_id", "tokens")


def _grams_sql(source: str, key: str, words: str) -> str:
    parts = " UNION ALL ".join(f"SELECT {key}, unnest({sql.ngrams('words', n)}) AS term FROM {source}_words" for n in (1, 2, 3))
    return f"""{source}_words AS (SELECT {key}, {sql.keep(words, 'length(t) >= 2')} AS words FROM {source}),
    {source}_tf AS MATERIALIZED (SELECT {key}, term, count(*) AS tf FROM ({parts}) GROUP BY {key}, term)"""


def _index_sql(prepared: str) -> str:
    return f"""{_unique_sql(prepared)}, {_grams_sql('unique_documents', 'doc_id', SIMPLE)},
    total AS (SELECT count(*) AS n FROM unique_documents),
    terms AS MATERIALIZED (SELECT term, count(*) AS df, ln((1 + any_value(n)) / (1 + count(*))) + 1 AS idf FROM unique_documents_tf, total
              GROUP BY term HAVING count(*) >= 2 AND count(*) <= 0.9 * any_value(n)),
    norms AS MATERIALIZED (SELECT doc_id, sqrt(sum(pow(tf * idf, 2))) AS norm FROM unique_documents_tf JOIN terms USING (term) GROUP BY doc_id)"""


@query("tfidf_terms", f"WITH {_index_sql(_prepared_sql(SIMPLE))} SELECT term, CAST(df AS BIGINT) AS df, round(idf, 6) AS idf FROM terms")
def tfidf_terms(spark: SparkSession, folder: str) -> DataFrame:
    return round_doubles(search.tfidf_index(_tokens(spark, folder), "doc_id", "tokens").terms)


@query(
    "tfidf_weights",
    f"""WITH {_index_sql(_prepared_sql(SIMPLE))} SELECT doc_id, term, round(tf * idf / norm, 6) AS weight
        FROM unique_documents_tf JOIN terms USING (term) JOIN norms USING (doc_id)""",
)
def tfidf_weights(spark: SparkSession, folder: str) -> DataFrame:
    return round_doubles(search.tfidf_weights(search.tfidf_index(_tokens(spark, folder), "doc_id", "tokens")))


def _scores_sql(prepared: str) -> str:
    return f"""WITH {_index_sql(prepared)},
    queries AS (SELECT item_id AS query_id, array_to_string(tokens, ' ') AS text FROM asked), {_grams_sql('queries', 'query_id', SIMPLE)},
    query_norms AS (SELECT query_id, sqrt(sum(pow(tf * idf, 2))) AS norm FROM queries_tf JOIN terms USING (term) GROUP BY query_id),
    scores AS (SELECT q.query_id, d.doc_id, sum(q.tf * idf / query_norms.norm * d.tf * idf / norms.norm) AS score
        FROM queries_tf q JOIN terms USING (term) JOIN query_norms USING (query_id) JOIN unique_documents_tf d USING (term)
        JOIN norms ON norms.doc_id = d.doc_id GROUP BY q.query_id, d.doc_id)"""


@query("cosine_scores", _scores_sql(_prepared_sql(SIMPLE)) + " SELECT query_id, doc_id, round(score, 6) AS score FROM scores")
def cosine_scores(spark: SparkSession, folder: str) -> DataFrame:
    index = search.tfidf_index(_tokens(spark, folder), "doc_id", "tokens")
    return round_doubles(search.cosine_scores(index, _queries(spark, folder), "item_id", "tokens"))


def _top_sql(prepared: str) -> str:
    return _scores_sql(prepared) + """, ranked AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) AS rank
        FROM scores WHERE score >= 0.05)"""


def _top(spark: SparkSession, folder: str, preset: str) -> DataFrame:
    index = search.tfidf_index(_tokens(spark, folder, preset), "doc_id", "tokens")
    # Ranked by rounded scores, so that last-digit differences between engines cannot swap hits.
    return search.search(index, _queries(spark, folder, preset), "item_id", "tokens", digits=6)


@query("search_hits", _top_sql(_prepared_sql(SIMPLE)) + " SELECT query_id, doc_id, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM ranked WHERE rank <= 5")
def search_hits(spark: SparkSession, folder: str) -> DataFrame:
    return _top(spark, folder, "plain")


@query("rich_search_hits", _top_sql(_RICH) + " SELECT query_id, doc_id, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM ranked WHERE rank <= 5")
def rich_search_hits(spark: SparkSession, folder: str) -> DataFrame:
    """Search with documents and queries richly preprocessed."""
    return _top(spark, folder, "rich")


@query("stored_search_hits", _top_sql(_prepared_sql(SIMPLE)) + " SELECT query_id, doc_id, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM ranked WHERE rank <= 5")
def stored_search_hits(spark: SparkSession, folder: str) -> DataFrame:
    """The same hits from weights on storage, read only where a query term can be."""
    path = new_scratch_path(spark, "weights")
    index = search.tfidf_index(_tokens(spark, folder), "doc_id", "tokens")
    search.save_weights(index, path)
    return search.stored_search(search.Buckets.load(spark, path), index, _queries(spark, folder), "item_id", "tokens", digits=6)


@query(
    "search_hits_with_text",
    _top_sql(_prepared_sql(sql.simple_preset("text")))
    + " SELECT query_id, r.doc_id, round(score, 6) AS score, CAST(rank AS INT) AS rank, d.text AS description FROM ranked r JOIN documents d USING (doc_id) WHERE rank <= 5",
)
def search_hits_with_text(spark: SparkSession, folder: str) -> DataFrame:
    return search.attach_text(_top(spark, folder, "simple"), table(spark, folder, "documents"), "doc_id", "text")


SLOTS = 10_000
_HASHED_SQL = f"""slot_tokens AS (SELECT doc_id, unnest({SIMPLE}) AS token FROM documents),
    query_tokens AS (SELECT item_id AS doc_id, unnest({SIMPLE}) AS token FROM benchmark),
    counts AS MATERIALIZED (SELECT doc_id, CAST('0x' || substr(md5(token), 1, 8) AS BIGINT) % {SLOTS} AS slot, count(*) AS tf FROM slot_tokens GROUP BY ALL),
    query_counts AS (SELECT doc_id, CAST('0x' || substr(md5(token), 1, 8) AS BIGINT) % {SLOTS} AS slot, count(*) AS tf FROM query_tokens GROUP BY ALL),
    idf AS MATERIALIZED (SELECT slot, ln(((SELECT count(*) FROM documents) + 1) / (count(*) + 1)) AS idf FROM counts GROUP BY slot),
    weights AS MATERIALIZED (SELECT doc_id, slot, tf * idf / sqrt(sum(pow(tf * idf, 2)) OVER (PARTITION BY doc_id)) AS weight FROM counts JOIN idf USING (slot) WHERE idf > 0),
    query_weights AS (SELECT doc_id AS query_id, slot, tf * idf / sqrt(sum(pow(tf * idf, 2)) OVER (PARTITION BY doc_id)) AS wanted
        FROM query_counts JOIN idf USING (slot) WHERE idf > 0)"""


@query("hashed_tfidf_weights", f"WITH {_HASHED_SQL} SELECT doc_id, CAST(slot AS INT) AS slot, round(weight, 6) AS weight FROM weights")
def hashed_tfidf_weights(spark: SparkSession, folder: str) -> DataFrame:
    weights = search.hashed_index(_tokens(spark, folder), "doc_id", "tokens", SLOTS).weights
    return round_doubles(weights.select("doc_id", F.col("term").alias("slot"), "weight"))


@query(
    "hashed_search_hits",
    f"""WITH {_HASHED_SQL}, scores AS (SELECT query_id, doc_id, round(sum(weight * wanted), 6) AS score FROM query_weights JOIN weights USING (slot) GROUP BY ALL)
        SELECT query_id, doc_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INT) AS rank FROM scores
        WHERE score >= 0.05 QUALIFY rank <= 5""",
)
def hashed_search_hits(spark: SparkSession, folder: str) -> DataFrame:
    index = search.hashed_index(_tokens(spark, folder), "doc_id", "tokens", SLOTS)
    return search.hashed_search(index, _queries(spark, folder), "item_id", "tokens", digits=6)


@query("hashed_vector_hits")
def hashed_vector_hits(spark: SparkSession, folder: str) -> DataFrame:
    """The same search with vectors of a fitted pipeline, whose slots come from another hash."""
    docs = _tokens(spark, folder)
    model = search.hashed_tfidf_model(docs, "tokens")
    return search.top_hits(search.hashed_cosine_scores(model, docs, "doc_id", _queries(spark, folder), "item_id"))


@query("hashed_tfidf_norms", "SELECT doc_id, 1.0E0 AS norm FROM documents WHERE regexp_matches(text, '[\\p{L}\\p{N}_]')")
def hashed_tfidf_norms(spark: SparkSession, folder: str) -> DataFrame:
    docs = _tokens(spark, folder)
    cells = search.hashed_weights(search.hashed_tfidf_model(docs, "tokens"), docs, "doc_id")
    return round_doubles(cells.groupBy("doc_id").agg(F.sqrt(F.sum(F.pow("weight", 2))).alias("norm")))
