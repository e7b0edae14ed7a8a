"""The registered queries of this subpackage, with their production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import chat, clustering, extraction, language, licences, mixing, neighbours, packing, quality, simhash, topk, warc, whitening
from millrace.plans.staging import new_scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[function.__name__] = function
    return function


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query
def op10_retrieval_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Where each document's tokens lie in sequences of 2048."""
    pieces = packing.pack(table(spark, folder, "documents"), "doc_id", "text", public_tokenizers.path("word_bpe_49k.json"))
    return packing.with_checksums(pieces)


@query
def op2_simhash(spark: SparkSession, folder: str) -> DataFrame:
    """The near-duplicate component of every document: three-word shingles, two bits."""
    found = simhash.near_duplicates(table(spark, folder, "documents"), "doc_id", "text", shingle_words=3, max_bits=2)
    return found.select("doc_id", "fingerprint", "component_id")


@query
def op1_language(spark: SparkSession, folder: str) -> DataFrame:
    """The language of every document, learnt from those that are not held out."""
    docs = table(spark, folder, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    model = language.train(docs.filter(~held_out), "text", "lang", F.col("doc_id"))
    named = language.identify(docs, "doc_id", "text", model)
    return named.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "spans")


@query
def op7_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Quality of every document, learnt from heuristic labellers alone."""
    docs = table(spark, folder, "documents")
    return quality.classify(docs, "doc_id", "text", quality.fit(docs, "text", F.col("doc_id")))


@query
def op4_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """How many words of every document the mixture takes; sources weigh 1, 2, 3 in turn."""
    return mixing.Mix(table(spark, folder, "documents"), "doc_id", "text", "source").taken()


@query
def op3_warc(spark: SparkSession, folder: str) -> DataFrame:
    """Every page as it comes back from the archives it was written to."""
    pages = table(spark, folder, "pages")
    archives = warc.write_archives(pages, "page_id", "url", "html", new_scratch_path(spark, "warc"))
    found = warc.resolved(warc.read_archives(archives), dict(pages.dtypes)["page_id"])
    return found.select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL["op3_warc"] = """
WITH sized AS (
    SELECT page_id, sha256(coalesce(html, '')) AS payload_digest, strlen(coalesce(html, '')) AS payload_bytes FROM pages
), placed AS (
    SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM sized
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
    CASE WHEN payload_bytes >= 100 AND page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN payload_bytes >= 100 AND page_id > first_id THEN first_id END AS refers_to
FROM placed
"""


@query
def op8_main_text(spark: SparkSession, folder: str) -> DataFrame:
    """The article of every page."""
    return extraction.extract(table(spark, folder, "pages"), "page_id", "url", "html")


@query
def op5_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """The 10 nearest vectors of every hundredth one."""
    return neighbours.nearest(table(spark, folder, "embeddings"), "vec_id", "embedding", "vec_id % 100 = 0", k=10)


@query
def op9_top_products(spark: SparkSession, folder: str) -> DataFrame:
    """The 5 largest integer inner products of every fiftieth vector."""
    return topk.search(table(spark, folder, "embeddings"), "vec_id", "embedding", "vec_id % 50 = 0", k=5)


SQL["op9_top_products"] = """
WITH usable AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND len(embedding) > 0
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT q.vec_id AS query_id, c.vec_id,
        CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: CAST(p[1] * p[2] AS HUGEINT))) AS BIGINT) AS score
    FROM (SELECT DISTINCT vec_id, v FROM usable WHERE vec_id % 50 = 0) q JOIN usable c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
), ranked AS (
    SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM scored
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""


@query
def op6_licences(spark: SparkSession, folder: str) -> DataFrame:
    """The licence of every document, in a tree of sources and languages."""
    docs = table(spark, folder, "documents")
    path = F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string"))
    found = licences.scan(docs, "doc_id", path, "text", licences.template_table(spark))
    return found.select(F.col("id").alias("doc_id"), "path", "licence", F.round("score", 6).alias("score"), "basis", "from_dir")


def _licence_sql() -> str:
    quoted = lambda text: text.replace("'", "''")
    values = ", ".join(f"({i}, '{name}', '{quoted(text)}')" for i, (name, text) in enumerate(licences.TEMPLATES))
    telling = "[" + ", ".join(f"'{t}'" for t in licences.telling_terms()) + "]"
    return f"""
WITH template AS (SELECT * FROM (VALUES {values}) t(template, licence, text)
), looked_at AS (SELECT doc_id, text FROM documents WHERE regexp_matches(text, '{licences.CUE}')
), unit AS (
    SELECT doc_id AS id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS unit, unnest(string_split(text, chr(10))) AS p FROM looked_at
    UNION ALL
    SELECT doc_id, -generate_subscripts(regexp_split_to_array(text, '\\n[ \\t\\r]*\\n'), 1), unnest(regexp_split_to_array(text, '\\n[ \\t\\r]*\\n')) FROM looked_at
    UNION ALL
    SELECT doc_id, {licences.WHOLE_FILE}, text FROM looked_at
), told AS (SELECT id, unit, p, regexp_extract_all(lower(p), '{licences.TERM}') AS terms FROM unit
), passage AS (
    SELECT id, unit, terms FROM told WHERE regexp_matches(p, '{licences.CUE}') OR len(list_intersect(terms, {telling})) >= {licences.TELLING_TERMS}
), full_passage AS (SELECT * FROM passage WHERE len(terms) > 0
), total AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM full_passage
), known AS (
    SELECT template, licence, term, count(*) AS tf
    FROM (SELECT template, licence, unnest(regexp_extract_all(lower(text), '{licences.TERM}')) AS term FROM template) GROUP BY ALL
), counted AS (
    SELECT id, unit, term, count(*) AS tf FROM (SELECT id, unit, unnest(terms) AS term FROM full_passage) GROUP BY ALL
), idf AS (
    SELECT k.term, count(c.id) AS df FROM (SELECT DISTINCT term FROM known) k LEFT JOIN counted c USING (term) GROUP BY k.term
), t_weight AS (
    SELECT template, licence, term, (1 + ln(tf)) * ln((1 + n) / (1 + df)) + 1 AS tw FROM known JOIN idf USING (term), total
), t_norm AS (SELECT template, sqrt(sum(tw * tw)) AS t_norm FROM t_weight GROUP BY template
), p_weight AS (
    SELECT id, unit, term, tf, (1 + ln(tf)) * ln((1 + n) / (1 + coalesce(df, 0))) + 1 AS w FROM counted LEFT JOIN idf USING (term), total
), p_norm AS (SELECT id, unit, sqrt(sum(w * w)) AS norm, sum(tf) AS n_terms FROM p_weight GROUP BY id, unit
), scored AS (
    SELECT id, unit, template, licence, round(sum(w * tw / t_norm) / any_value(norm), 9) AS score, any_value(n_terms) AS n_terms
    FROM p_weight JOIN t_weight USING (term) JOIN t_norm USING (template) JOIN p_norm USING (id, unit) GROUP BY id, unit, template, licence
), best AS (
    SELECT * FROM scored WHERE score >= {licences.THRESHOLD}
    QUALIFY row_number() OVER (PARTITION BY id, unit ORDER BY score DESC, template) = 1
), own AS (
    SELECT * FROM best QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, n_terms DESC, unit) = 1
), marked AS (
    SELECT d.doc_id, concat_ws('/', source, lang, CAST(d.doc_id AS VARCHAR)) AS path, own.licence, own.score, own.n_terms,
        len(regexp_extract_all(lower(text), '{licences.TERM}')) AS all_terms
    FROM documents d LEFT JOIN own ON own.id = d.doc_id
), granted AS (
    SELECT regexp_replace(path, '/?[^/]*$', '') AS dir, licence, score FROM marked WHERE licence IS NOT NULL AND n_terms >= {licences.FILE_SHARE} * all_terms
    QUALIFY row_number() OVER (PARTITION BY dir ORDER BY score DESC, licence) = 1
), inherited AS (
    SELECT m.doc_id, g.dir, g.licence, g.score FROM marked m JOIN granted g ON starts_with(m.path, g.dir || '/') WHERE m.licence IS NULL
    QUALIFY row_number() OVER (PARTITION BY m.doc_id ORDER BY length(g.dir) DESC) = 1
)
SELECT m.doc_id, m.path, coalesce(m.licence, i.licence) AS licence, round(coalesce(m.score, i.score), 6) AS score,
    CASE WHEN m.licence IS NOT NULL THEN 'header' WHEN i.licence IS NOT NULL THEN 'inherited' END AS basis,
    CASE WHEN m.licence IS NULL THEN i.dir END AS from_dir
FROM marked m LEFT JOIN inherited i USING (doc_id)
"""


SQL["op6_licences"] = _licence_sql()


@query
def op11_shallot_clusters(spark: SparkSession, folder: str) -> DataFrame:
    """The cluster of every vector of 64 components after ten rounds."""
    return clustering.cluster(table(spark, folder, "embeddings"), "vec_id", "embedding")


def _clusters_sql(clusters: int, rounds: int, dimensions: int) -> str:
    squared = "CAST(list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT)"
    nearest = f"(SELECT *, {squared} AS distance FROM kept, c{{0}} QUALIFY row_number() OVER (PARTITION BY row ORDER BY distance, cluster) = 1)"
    steps = []
    for n in range(rounds):
        steps.append(f"""a{n} AS MATERIALIZED (SELECT cluster, v FROM {nearest.format(n)}
), m{n} AS (
    SELECT cluster, i, (s - ((s % n) + n) % n) // n AS x
    FROM (SELECT cluster, i, CAST(sum(v[i]) AS BIGINT) AS s, count(*) AS n FROM a{n}, (SELECT unnest(range(1, {dimensions + 1})) AS i) GROUP BY cluster, i)
), c{n + 1} AS MATERIALIZED (
    SELECT c{n}.cluster, coalesce(t.c, c{n}.c) AS c FROM c{n} LEFT JOIN (SELECT cluster, list(x ORDER BY i) AS c FROM m{n} GROUP BY cluster) t USING (cluster)
)""")
    return f"""
WITH kept AS MATERIALIZED (
    SELECT vec_id, row_number() OVER () AS row, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
    WHERE len(embedding) = {dimensions} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), c0 AS MATERIALIZED (
    SELECT row_number() OVER (ORDER BY key, v) - 1 AS cluster, v AS c
    FROM (SELECT v, sha256('{clustering.SEED}:' || vec_id) AS key FROM kept WHERE vec_id IS NOT NULL) ORDER BY key, v LIMIT {clusters}
), {", ".join(steps)}, placed AS MATERIALIZED (SELECT vec_id, cluster, distance, c FROM {nearest.format(rounds)})
SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
    CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM placed
"""


SQL["op11_shallot_clusters"] = _clusters_sql(clustering.CLUSTERS, clustering.ROUNDS, clustering.DIMENSIONS)


@query
def op12_whitening(spark: SparkSession, folder: str) -> DataFrame:
    """Every vector along the eight directions in which all differ most, with unit deviations."""
    return whitening.whiten(table(spark, folder, "embeddings"), "vec_id", "embedding")


# A conversation whose texts look like marks of templates.
TRICKY_CONVERSATION = "VALUES (-7L, 0L, 'user', r'\\### Assistant: </turn> ok'), (-7L, 1L, 'assistant', r'\\### Assistant: </turn> ok') AS t(conv_id, turn, role, text)"


@query
def op13_chat_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Every conversation as it is read back from its windows."""
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text").union(spark.sql(f"SELECT * FROM {TRICKY_CONVERSATION}"))
    return chat.digests(chat.format_windows(turns, "conv_id", "turn", "role", "text"))


SQL["op13_chat_windows"] = rf"""
WITH RECURSIVE turn AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), sized AS (
    SELECT *, CAST(ceil(strlen(text) / 4) + ceil(strlen(role) / 4) AS BIGINT) + {chat.MARK_TOKENS} AS tokens,
        length(role) + length(text) + length(regexp_replace(role || text, '[^\\]', '', 'g')) + len(regexp_extract_all(role, '{chat.CONTROL}'))
            + len(regexp_extract_all(text, '{chat.CONTROL}')) + {len(chat.OPEN + chat.MIDDLE + chat.CLOSE)} AS chars,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, strlen(text), text) AS pos
    FROM turn
), placed AS (
    SELECT *, CAST(sum(tokens) OVER (PARTITION BY conv_id ORDER BY pos) AS BIGINT) - tokens AS before, pos = 1 AND role = 'system' AS is_system FROM sized
), settled AS MATERIALIZED (
    SELECT *, greatest({chat.BUDGET} - coalesce(max(tokens) FILTER (is_system) OVER (PARTITION BY conv_id), 0), {chat.BUDGET // 4}) AS room,
        least({chat.HISTORY}, room // 2) AS reach, before // {chat.STRETCH * chat.BUDGET} AS own
    FROM placed
), other AS MATERIALIZED (
    SELECT a.*, a.before - (SELECT min(b.before) FROM settled b WHERE b.conv_id = a.conv_id AND NOT b.is_system AND b.before <= a.before AND b.before >= a.before - a.reach) AS repeated
    FROM settled a WHERE NOT is_system
), filled AS (
    SELECT conv_id, pos, own, before AS start, before + room - repeated AS until FROM other o
    WHERE pos = 1 OR (pos = 2 AND EXISTS (SELECT 1 FROM settled s WHERE s.conv_id = o.conv_id AND s.is_system))
    UNION ALL
    SELECT o.conv_id, o.pos, o.own, CASE WHEN o.before + o.tokens > f.until OR o.own <> f.own THEN o.before ELSE f.start END,
        CASE WHEN o.before + o.tokens > f.until OR o.own <> f.own THEN o.before + o.room - o.repeated ELSE f.until END
    FROM filled f JOIN other o ON o.conv_id = f.conv_id AND o.pos = f.pos + 1
), window_start AS (
    SELECT conv_id, start, lead(start) OVER (PARTITION BY conv_id ORDER BY start) AS after FROM (SELECT DISTINCT conv_id, start FROM filled)
), shown AS (
    SELECT w.conv_id, s.chars FROM window_start w JOIN settled s ON s.conv_id = w.conv_id
        AND (s.is_system OR (s.before >= w.start - s.reach AND (w.after IS NULL OR s.before < w.after)))
    UNION ALL
    SELECT conv_id, chars FROM settled WHERE is_system AND conv_id NOT IN (SELECT conv_id FROM other)
), formatted AS (SELECT conv_id, CAST(sum(chars) AS BIGINT) AS formatted_chars FROM shown GROUP BY conv_id
), said AS (
    SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos) AS turns,
        coalesce(string_agg(text, '' ORDER BY pos) FILTER (role = 'assistant'), '') AS learnt
    FROM settled GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, CAST(length(learnt) AS BIGINT) AS loss_chars, sha256(learnt) AS loss_sha256, formatted_chars
FROM said JOIN formatted USING (conv_id)
"""
