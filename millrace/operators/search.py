"""Positional and TF-IDF indexes and ranked search over them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import IDF, HashingTF, Normalizer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions.text import as_text, ngram_range, simple_tokens
from millrace.operators import impact
from millrace.plans.joins import attach_by_key, fits_broadcast, match_by_key, staged_bytes
from millrace.plans.spread import by_key, numbered_rows_of, rows_of
from millrace.plans.staging import discard, shuffles_dropped, stage

MIN_SCORE = 0.05
TOP_K = 5
# Bytes of written tokens whose terms, some two million, are counted in one task, whatever the table's size.
TOKEN_BYTES = 4 << 20
# Bytes of written tokens whose terms are exchanged at a time, and rounds at most, as each round of
# documents exchanges the terms of the index once more. A round's shuffles are dropped before the next.
ROUND_BYTES = 64 << 20
MAX_ROUNDS = 8


# --- positional index -----------------------------------------------------------------------------


def postings(df: DataFrame, id_col: str, tokens_col: str) -> DataFrame:
    """``(doc_id, token, tf, positions)``: one row per document and distinct token.

    The compact token lists are shuffled by document; exploding and grouping then need no further
    exchange, and a group never holds more than one document.
    """
    located = (
        by_key(df, id_col)
        .select(F.col(id_col).alias("doc_id"), numbered_rows_of(tokens_col).alias("pos", "token"))
        .groupBy("doc_id", "token")
        .agg(F.sort_array(F.collect_list("pos")).alias("positions"))
    )
    return located.select("doc_id", "token", F.size("positions").cast("long").alias("tf"), "positions")


def inverted_index(df: DataFrame, id_col: str, tokens_col: str, block_size: int = 1024) -> DataFrame:
    """``(token, block, posting_list array<struct<doc_id, pos>>)``.

    A list is cut into blocks of ``block_size`` consecutive integer document ids, which bounds its
    length for a token found in every document. A corpus that fits one block has one row per token.
    """
    located = df.select(F.col(id_col).alias("doc_id"), numbered_rows_of(tokens_col).alias("pos", "token"))
    return (
        located.groupBy("token", F.floor(F.col("doc_id") / block_size).alias("block"))
        .agg(F.sort_array(F.collect_list(F.struct("doc_id", "pos"))).alias("posting_list"))
    )


# Postings or weights of a storage bucket, and rows of a file; a bucket is what a look-up reads at least.
PER_BUCKET = 1 << 22


def _bucket(key: Column | str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _write_buckets(df: DataFrame, key: str, order: list[str], path: str, buckets: int, files: int) -> None:
    """One folder per hash bucket of ``key``, files of about equal size, sorted by ``order``.

    Ranges cut a key with very many rows into several files. The number of buckets is written beside them.
    Some buckets are written at a time, as many as give every core a file, and what they were exchanged with is
    dropped before the next.
    """
    order = ["bucket", *order]
    numbered = df.withColumn("bucket", _bucket(key, buckets))
    rounds = max(1, min(MAX_ROUNDS, buckets, files // df.sparkSession.sparkContext.defaultParallelism))
    for number in range(rounds):
        some = _of_round(numbered, F.col("bucket"), rounds, number)
        ranged = some.repartitionByRange(_parts(files, rounds), *order).sortWithinPartitions(*order)
        with shuffles_dropped(df.sparkSession):
            ranged.write.mode("append" if number else "overwrite").partitionBy("bucket").parquet(f"{path}/rows")
    df.sparkSession.createDataFrame([(buckets,)], "buckets int").write.mode("overwrite").parquet(f"{path}/settings")


def _parts(rows: int, per_part: int) -> int:
    return max(1, -(-rows // per_part))


def _of_round(df: DataFrame, number: Column, rounds: int, wanted: int) -> DataFrame:
    """The rows whose ``number`` falls to a round; one round takes them as they are."""
    return df.filter(F.pmod(number, F.lit(rounds)) == wanted) if rounds > 1 else df


@dataclass
class Buckets:
    """Rows on storage by hash bucket of a key."""

    rows: DataFrame
    buckets: int

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Buckets:
        return cls(spark.read.parquet(f"{path}/rows"), spark.read.parquet(f"{path}/settings").first()["buckets"])

    def of(self, wanted: DataFrame, key: str) -> DataFrame:
        """The rows whose key is among ``wanted``; only the folders that can hold one are read."""
        # At most as many numbers as buckets.
        needed = [row.bucket for row in wanted.select(_bucket(key, self.buckets).alias("bucket")).distinct().collect()]
        return self.rows.filter(F.col("bucket").isin(needed)).drop("bucket").join(wanted.select(key).distinct(), key, "left_semi")


def posting_blocks(index: DataFrame, block_size: int = 1024) -> DataFrame:
    """``(token, block, offsets, positions)``: the output of :func:`postings` in blocks of ``block_size``
    consecutive integer document ids. A document is its offset in the block, and a position the
    distance from the one before: small numbers, which take few bits on storage."""
    gaps = F.transform("positions", lambda p, i: p - F.when(i > 0, F.get("positions", i - 1)).otherwise(F.lit(0)))
    rows = index.select("token", F.floor(F.col("doc_id") / block_size).alias("block"), F.pmod("doc_id", F.lit(block_size)).cast("int").alias("offset"), gaps.alias("gaps"))
    grouped = rows.groupBy("token", "block").agg(F.sort_array(F.collect_list(F.struct("offset", "gaps"))).alias("e"))
    return grouped.select("token", "block", F.col("e.offset").alias("offsets"), F.col("e.gaps").alias("gaps"))


def save_postings(index: DataFrame, path: str, block_size: int = 1024, per_bucket: int = PER_BUCKET) -> None:
    """Write postings in blocks, one folder per bucket of tokens; see :func:`stored_postings`.

    ``per_bucket`` postings are aimed at for a bucket, so their number follows the size of the index.
    """
    blocks = stage(posting_blocks(index, block_size), "posting-blocks")
    total = blocks.agg(F.sum(F.size("offsets").cast("long")).alias("n")).first()["n"] or 0
    parts = _parts(total, per_bucket)
    _write_buckets(blocks.withColumn("size", F.lit(block_size)), "token", ["token", "block"], path, parts, parts)


def stored_postings(spark: SparkSession, path: str, tokens: DataFrame) -> DataFrame:
    """``(doc_id, token, tf, positions)`` of the given ``(token)`` from what :func:`save_postings` wrote.

    Only the folders of buckets that hold a token asked for are read.
    """
    found = Buckets.load(spark, path).of(tokens, "token")
    entries = found.select("token", "block", "size", rows_of(F.arrays_zip("offsets", "gaps")).alias("e"))
    positions = F.aggregate(
        "e.gaps", F.array().cast("array<int>"),
        lambda sums, gap: F.concat(sums, F.array(F.coalesce(F.try_element_at(sums, F.lit(-1)), F.lit(0)) + gap)),
    )
    return entries.select((F.col("block") * F.col("size") + F.col("e.offsets")).alias("doc_id"), "token", F.size("e.gaps").cast("long").alias("tf"), positions.alias("positions"))


def _asked_only(index: DataFrame, tokens: DataFrame) -> DataFrame:
    """Postings of the staged ``(token)``, where they lie; all of them if the tokens are too many to be broadcast."""
    spots = index.select("doc_id", "token", "positions")
    return spots.join(F.broadcast(tokens), "token", "left_semi") if fits_broadcast(tokens) else spots


def within_distance(index: DataFrame, pairs: DataFrame, distance: int = 1) -> DataFrame:
    """Documents in which ``second`` follows ``first`` by 1 to ``distance`` tokens.

    ``index`` is the output of :func:`postings`; ``pairs`` is ``(pair_id, first, second)``. Returns
    ``(pair_id, doc_id, matches)`` with the number of places of ``second`` that match. A place meets
    only the tokens before it in its document, so no list of positions is repeated for each pair that asks for it.
    """
    wanted = stage(pairs.select("pair_id", F.struct("first", "second").alias("words")).filter("words.first is not null and words.second is not null").distinct(), "pairs")
    tokens = stage(wanted.select(F.explode(F.array("words.first", "words.second")).alias("token")).distinct(), "pair-tokens")
    places = _asked_only(index, tokens).select("doc_id", "token", rows_of(F.array_distinct("positions")).alias("pos"))
    before = Window.partitionBy("doc_id").orderBy("pos").rangeBetween(-distance, -1)
    near = places.select("doc_id", "token", F.collect_set("token").over(before).alias("firsts"))
    words = near.select("doc_id", "token", rows_of("firsts").alias("first")).select("doc_id", F.struct("first", F.col("token").alias("second")).alias("words"))
    found = match_by_key(words, wanted, "words", F.col("doc_id"))
    return found.groupBy("pair_id", "doc_id").agg(F.count("*").alias("matches"))


def phrase_matches(index: DataFrame, phrases: DataFrame) -> DataFrame:
    """Documents that hold all tokens of a phrase, in order and next to each other.

    ``index`` is the output of :func:`postings`; ``phrases`` is ``(pair_id, tokens)``, of any length.
    Returns ``(pair_id, doc_id, matches)`` with the number of places. Each distinct token gives the
    starts its positions allow; a document counts if all tokens are there and some start is allowed
    by each. Positions are intersected inside a row, never paired one with another. The token of a
    phrase that stands in fewest documents says which documents its other tokens are looked up in.
    """
    listed = phrases.select("pair_id", F.size(F.array_distinct("tokens")).alias("needed"), numbered_rows_of("tokens").alias("offset", "token"))
    wanted = stage(listed.groupBy("pair_id", "needed", "token").agg(F.collect_list("offset").alias("offsets")), "phrases")
    spots = stage(_asked_only(index, stage(wanted.select("token").distinct(), "phrase-tokens")), "phrase-postings")
    # A token that is nowhere has no number, and its phrases no documents.
    numbers = stage(spots.groupBy("token").agg(F.count("*").alias("n")), "phrase-documents")
    ranks = Window.partitionBy("pair_id", "needed").orderBy(F.col("n").asc_nulls_first(), "token")
    ranked = stage(wanted.join(numbers, "token", "left").withColumn("rank", F.row_number().over(ranks)), "phrase-ranks")

    common = lambda lists: F.aggregate(lists, F.get(lists, F.lit(0)), F.array_intersect)
    starts = common(F.transform("offsets", lambda o: F.transform("positions", lambda p: p - o)))
    keys = ["pair_id", "doc_id", "needed"]

    def allowed(some: DataFrame) -> DataFrame:
        return match_by_key(spots, some, "token", F.col("doc_id")).select(*keys, starts.alias("starts")).filter(F.size("starts") > 0)

    rarest = stage(ranked.filter("rank = 1"), "phrase-rarest")
    candidates = stage(allowed(rarest), "phrase-candidates")
    # One row per candidate and other token; a token and a document meet in few of them. Ids may be null.
    rest = ranked.filter("rank > 1").select(F.col("pair_id").alias("other_id"), F.col("needed").alias("n_tokens"), "token", "offsets")
    same = F.col("pair_id").eqNullSafe(F.col("other_id")) & (F.col("needed") == F.col("n_tokens"))
    others = stage(candidates.select("pair_id", F.col("doc_id").alias("in_doc"), "needed").distinct().join(rest, same).select("pair_id", "in_doc", "needed", "token", "offsets"), "phrase-others")
    met = spots.withColumnRenamed("token", "word").join(others, (F.col("word") == F.col("token")) & F.col("doc_id").eqNullSafe(F.col("in_doc")))
    more = met.select(*keys, starts.alias("starts")).filter(F.size("starts") > 0)
    both = candidates.unionByName(more).groupBy(*keys).agg(F.collect_list("starts").alias("starts"))
    hits = both.filter(F.size("starts") == F.col("needed")).select("pair_id", "doc_id", F.size(common(F.col("starts"))).cast("long").alias("matches"))
    return hits.filter("matches > 0")


# --- exact TF-IDF ---------------------------------------------------------------------------------


def distinct_documents(df: DataFrame, id_col: str, tokens_col: str) -> DataFrame:
    """``(doc_id, text)`` with one row per distinct preprocessed text, keeping the smallest id."""
    texts = df.select(F.col(id_col).alias("doc_id"), as_text(F.col(tokens_col)).alias("text"))
    return texts.groupBy("text").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "text")


@dataclass
class TfIdfIndex:
    """Exact TF-IDF over word n-grams.

    ``documents`` is ``(doc_id, tokens)``, distributed by ``doc_id``; ``terms`` is
    ``(term, df, idf)`` for the kept vocabulary. Weights are raw counts times idf, divided by the
    document's norm only for documents that are hit.
    """

    documents: DataFrame
    terms: DataFrame
    ngram_low: int = 1
    ngram_high: int = 3
    # Partitions of the documents, and rounds in which their terms are exchanged.
    parts: int = 1
    rounds: int = 1

    @cached_property
    def norms(self) -> DataFrame:
        """``(doc_id, norm)``, computed and written when first asked for."""
        return self._in_rounds("norms", lambda docs: self._weighted(docs, self.terms).groupBy("doc_id").agg(_norm()))

    def _in_rounds(self, name: str, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """``work`` on some of the documents at a time, by hash of ``doc_id``, each result written before the next."""
        if self.rounds == 1:
            return stage(work(self.documents), name)
        some = (_of_round(self.documents, F.xxhash64("doc_id"), self.rounds, number) for number in range(self.rounds))
        return reduce(DataFrame.unionAll, [stage(work(by_key(docs, "doc_id", _parts(self.parts, self.rounds))), name) for docs in some])

    def _weighted(self, documents: DataFrame, terms: DataFrame, *more: str) -> DataFrame:
        """``(doc_id, term, w, *more)``: counts times idf. Few terms are broadcast, and all others are
        dropped before anything is counted; many are joined with the documents' counts."""
        grams, payload = self.terms_of(documents), F.struct("idf", *more).alias("payload")
        lookup = terms.select("term", "df", payload)
        if fits_broadcast(terms):
            known = grams.join(F.broadcast(lookup.drop("df")), "term")
            counts = known.groupBy("doc_id", "term", "payload").agg(F.count("*").alias("tf"))
        else:
            counts = attach_by_key(grams.groupBy("doc_id", "term").agg(F.count("*").alias("tf")), lookup, "term", "df", "payload", F.col("doc_id"))
        return counts.select("doc_id", "term", (F.col("tf") * F.col("payload.idf")).alias("w"), *[F.col(f"payload.{m}") for m in more])

    def weighted_documents(self) -> DataFrame:
        """``(doc_id, norm, kept array<struct<term, w>>)`` of every document, written; counts meet the terms once for both.

        The norms are written beside them, so that the caller may delete the documents.
        """
        listed = F.collect_list(F.struct("term", "w")).alias("kept")
        documents = self._in_rounds(
            "weighted-documents", lambda docs: self._weighted(docs, self.terms).filter("doc_id is not null").groupBy("doc_id").agg(_norm(), listed)
        )
        self.norms = stage(documents.select("doc_id", "norm"), "norms")
        return documents

    def weights_of(self, wanted: DataFrame) -> DataFrame:
        """``(term, doc_id, weight)``: the documents' weights of the terms of the staged table ``(term)``.

        The first call finds all norms in the same pass.
        """
        asked = wanted.select("term").distinct().withColumn("asked", F.lit(True))
        if "norms" in self.__dict__:
            weighted = self._weighted(self.documents, stage(self.terms.join(wanted.select("term").distinct(), "term", "left_semi"), "asked-terms"))
            return weighted.join(self.norms, "doc_id").select("term", "doc_id", (F.col("w") / F.col("norm")).alias("weight"))
        marked = self.terms.join(asked, "term", "left") if not fits_broadcast(self.terms) else stage(self.terms.join(asked, "term", "left"), "marked-terms")
        kept = F.collect_list(F.when(F.col("asked"), F.struct("term", "w"))).alias("kept")
        documents = self._in_rounds("weighted-documents", lambda docs: self._weighted(docs, marked, "asked").groupBy("doc_id").agg(_norm(), kept))
        self.norms = documents.select("doc_id", "norm")
        rows = documents.select("doc_id", "norm", rows_of("kept").alias("e"))
        return rows.select("e.term", "doc_id", (F.col("e.w") / F.col("norm")).alias("weight"))

    def terms_of(self, df: DataFrame) -> DataFrame:
        return _terms(df, self.ngram_low, self.ngram_high)

    def save(self, path: str) -> None:
        self.documents.write.mode("overwrite").parquet(f"{path}/documents")
        self.terms.write.mode("overwrite").parquet(f"{path}/terms")
        self.norms.write.mode("overwrite").parquet(f"{path}/norms")
        settings = self.norms.sparkSession.createDataFrame([(self.ngram_low, self.ngram_high)], "ngram_low int, ngram_high int")
        settings.write.mode("overwrite").parquet(f"{path}/settings")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> TfIdfIndex:
        """An index with the settings it was saved with."""
        ngram_low, ngram_high = spark.read.parquet(f"{path}/settings").first()
        listed = spark.read.parquet(f"{path}/documents")
        size = staged_bytes(listed)
        parts = _parts(size, TOKEN_BYTES)
        documents = by_key(listed, "doc_id", parts)
        terms, norms = (spark.read.parquet(f"{path}/{part}") for part in ("terms", "norms"))
        index = cls(documents, terms, ngram_low, ngram_high, parts, _rounds(size))
        index.norms = norms
        return index


def _rounds(size: int) -> int:
    return min(MAX_ROUNDS, _parts(size, ROUND_BYTES))


def _norm() -> Column:
    return F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm")


def _index_words(text: Column) -> Column:
    """Words of two or more characters; joined terms such as ``dual-band`` count as their words."""
    return F.filter(simple_tokens(text), lambda t: F.length(t) >= 2)


def _terms(df: DataFrame, low: int, high: int) -> DataFrame:
    """One row per term occurrence, in place of the token list."""
    others = [c for c in df.columns if c != "tokens"]
    return df.select(*others, rows_of(ngram_range(F.col("tokens"), low, high)).alias("term"))


def tfidf_index(
    df: DataFrame,
    id_col: str,
    tokens_col: str,
    ngram_low: int = 1,
    ngram_high: int = 3,
    min_df: int = 2,
    max_df: float = 0.9,
    unique: bool = True,
) -> TfIdfIndex:
    """Index token lists: terms in at least ``min_df`` documents and at most ``max_df`` of them.

    ``idf = ln((1 + N) / (1 + df)) + 1``. Tokens of one character are not indexed. With ``unique``
    only the first of equal documents is kept.
    """
    texts = df.select(F.col(id_col).alias("doc_id"), as_text(F.col(tokens_col)).alias("text"))
    # Written once: the terms, the norms and every search read tokens instead of making them again.
    tokens = _index_words(F.col("text")).alias("tokens")
    listed = stage(texts.select("doc_id", tokens, F.md5("text").alias("digest"), F.monotonically_increasing_id().alias("row")), "index-documents")
    size = staged_bytes(listed)
    parts, rounds = _parts(size, TOKEN_BYTES), _rounds(size)
    if unique:
        # Digests are exchanged, not texts.
        first = listed.groupBy("digest").agg(F.min(F.struct("doc_id", "row")).alias("first")).select("first.row")
        listed = listed.join(stage(first, "index-unique"), "row", "left_semi")
    documents = by_key(listed.select("doc_id", "tokens"), "doc_id", parts)
    total = listed.agg(F.count("*").alias("n")).scalar()

    # One row per document and distinct term leaves the row itself; repeats are cut before the
    # explode. Most terms stand in one document only: sums per task before the exchange would hold
    # nearly all of them and save little, so terms are exchanged first and counted once. A term's
    # rows are no more than the documents. A round takes the terms that begin with words of some hashes;
    # there are half as many as for documents, whose rounds exchange more.
    term_rounds = _parts(rounds, 2)

    def counted(number: int) -> DataFrame:
        source, heads = listed, None
        if term_rounds > 1:
            chosen = F.transform("tokens", lambda t: F.when(F.pmod(F.xxhash64(t), F.lit(term_rounds)) == number, t))
            source, heads = listed.select("tokens", chosen.alias("heads")), F.col("heads")
        distinct = F.array_distinct(ngram_range(F.col("tokens"), ngram_low, ngram_high, heads))
        occurrences = source.select(rows_of(distinct).alias("term"))
        per_document = by_key(occurrences if heads is None else occurrences.filter("term is not null"), "term", _parts(parts, term_rounds))
        counts = per_document.groupBy("term").agg(F.count("*").alias("df"))
        kept_terms = counts.filter((F.col("df") >= min_df) & (F.col("df") <= F.lit(max_df) * total))
        return stage(kept_terms.withColumn("idf", F.log((total + 1) / (F.col("df") + 1)) + 1), "terms")

    terms = reduce(DataFrame.unionAll, map(counted, range(term_rounds)))
    return TfIdfIndex(documents, terms, ngram_low, ngram_high, parts, rounds)


def _weights_of(documents: DataFrame) -> DataFrame:
    """``(doc_id, term, weight)`` of documents with their kept terms."""
    rows = documents.select("doc_id", "norm", rows_of("kept").alias("e"))
    return rows.select("doc_id", "e.term", (F.col("e.w") / F.col("norm")).alias("weight"))


def tfidf_weights(index: TfIdfIndex) -> DataFrame:
    """L2-normalised weights ``(doc_id, term, weight)`` of every document."""
    return _weights_of(index.weighted_documents())


def query_weights(index: TfIdfIndex, queries: DataFrame, id_col: str, tokens_col: str) -> DataFrame:
    """``(query_id, term, idf, weight)``: idf-weighted, L2-normalised; unknown terms drop out."""
    words = _index_words(as_text(F.col(tokens_col)))
    listed = queries.select(F.col(id_col).alias("query_id"), words.alias("tokens"))
    counts = index.terms_of(by_key(listed, "query_id")).groupBy("query_id", "term").agg(F.count("*").alias("tf"))
    raw = counts.join(index.terms.select("term", "idf"), "term").withColumn("w", F.col("tf") * F.col("idf"))
    norms = raw.groupBy("query_id").agg(F.sqrt(F.sum(F.pow("w", 2))).alias("norm"))
    return raw.join(norms, "query_id").select("query_id", "term", "idf", (F.col("w") / F.col("norm")).alias("weight"))


def cosine_scores(index: TfIdfIndex, queries: DataFrame, id_col: str, tokens_col: str) -> DataFrame:
    """``(query_id, doc_id, score)`` for every document that shares a term with the query.

    Documents are not moved when the query terms can be broadcast: each task drops all other terms
    right after the explode and sums its own documents' scores.
    """
    weights = query_weights(index, queries, id_col, tokens_col)
    # A document's factor idf is the same for all its occurrences of a term, so it goes in here.
    wanted = stage(weights.select("query_id", "term", (F.col("weight") * F.col("idf")).alias("weight")), "queries")
    matched = match_by_key(index.terms_of(index.documents), wanted, "term", F.col("doc_id"))
    dots = matched.groupBy("query_id", "doc_id").agg(F.sum("weight").alias("dot"))
    return dots.join(index.norms, "doc_id").select("query_id", "doc_id", (F.col("dot") / F.col("norm")).alias("score"))


def _wanted(weights: DataFrame) -> DataFrame:
    return weights.select("query_id", "term", F.col("weight").alias("wanted"))


def save_weights(index: TfIdfIndex, path: str, per_bucket: int = PER_BUCKET) -> None:
    """Write the documents' weights, one folder per bucket of terms, sorted by term and falling impact."""
    # Read from the written documents for the count and for the ranges; no second copy is written.
    documents = index.weighted_documents()
    weights = _weights_of(documents).withColumn("level", impact.level(F.col("weight")))
    parts = _parts(weights.count(), per_bucket)
    _write_buckets(weights, "term", ["term", "level", "doc_id"], path, parts, parts)
    discard(documents)


def _stored_blocks(stored: Buckets, wanted: DataFrame) -> DataFrame:
    return stage(impact.with_blocks(stored.of(wanted, "term").select("term", "doc_id", "weight")), "impact-blocks")


def stored_search(
    stored: Buckets, index: TfIdfIndex, queries: DataFrame, id_col: str, tokens_col: str,
    k: int = TOP_K, min_score: float = MIN_SCORE, digits: int | None = None,
) -> DataFrame:
    """Like :func:`search`, from weights written by :func:`save_weights`; only folders that can hold a
    query term are read."""
    wanted = stage(query_weights(index, queries, id_col, tokens_col), "queries")
    return impact.top_k(_stored_blocks(stored, wanted), _wanted(wanted), k, min_score, digits)


def top_hits(scores: DataFrame, k: int = TOP_K, min_score: float = MIN_SCORE) -> DataFrame:
    """The best ``k`` documents per query at or above ``min_score``, ties by document id."""
    return impact.ranked(scores, k, min_score)


def search(
    index: TfIdfIndex,
    queries: DataFrame,
    id_col: str,
    tokens_col: str,
    k: int = TOP_K,
    min_score: float = MIN_SCORE,
    digits: int | None = None,
) -> DataFrame:
    """Ranked hits ``(query_id, doc_id, score, rank)`` for a table of preprocessed queries.

    The weights of the queries' terms are written once as impact blocks, and only documents that can
    be among the hits are scored to the end; see :mod:`millrace.operators.impact`. With ``digits``,
    scores are rounded before they are ranked.
    """
    wanted = stage(query_weights(index, queries, id_col, tokens_col), "queries")
    blocks = stage(impact.with_blocks(index.weights_of(wanted)), "impact-blocks")
    return impact.top_k(blocks, _wanted(wanted), k, min_score, digits)


def require_queries(queries: DataFrame, text_col: str) -> DataFrame:
    """The queries, checked: running them fails if any text is empty or missing."""
    blank = F.coalesce(F.trim(text_col), F.lit("")) == ""
    failing = F.raise_error(F.lit("a search query must not be empty")).cast("string")
    return queries.withColumn(text_col, F.when(blank, failing).otherwise(F.col(text_col)))


def attach_text(hits: DataFrame, documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Hits with the text of the document they point at.

    The few hits are written first: knowing their size, the planner leaves the texts in place.
    """
    texts = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("description"))
    return stage(hits, "hits").join(texts, "doc_id")


# --- hashed TF-IDF --------------------------------------------------------------------------------


def hashed_tfidf_model(df: DataFrame, tokens_col: str, num_features: int = 10_000) -> PipelineModel:
    """Fitted stages tokens → hashed counts → ``idf = ln((N + 1) / (df + 1))`` → unit length."""
    stages = [
        HashingTF(inputCol=tokens_col, outputCol="raw_features", numFeatures=num_features),
        IDF(inputCol="raw_features", outputCol="features"),
        Normalizer(inputCol="features", outputCol="unit_features"),
    ]
    return Pipeline(stages=stages).fit(df)


def hashed_weights(model: PipelineModel, df: DataFrame, id_col: str) -> DataFrame:
    """``(id, slot, weight)``: the non-zero cells of the unit-length vectors."""
    vector = F.unwrap_udt("unit_features")
    pairs = rows_of(F.arrays_zip(vector["indices"].alias("slot"), vector["values"].alias("weight")))
    rows = model.transform(df).select(F.col(id_col), pairs.alias("cell"))
    return rows.select(id_col, "cell.slot", "cell.weight").filter("weight <> 0")


def hashed_slot(token: Column, num_features: int) -> Column:
    """The slot of a token: the first 32 bits of its MD5 digest, which any engine can compute."""
    return (F.conv(F.substring(F.md5(token), 1, 8), 16, 10).cast("long") % num_features).cast("int")


@dataclass
class HashedIndex:
    """Unit-length hashed TF-IDF weights ``(term, doc_id, weight)`` and ``slots (term, idf)``, where a term is a slot."""

    weights: DataFrame
    slots: DataFrame
    num_features: int


def _hashed_counts(df: DataFrame, id_col: str, tokens_col: str, num_features: int) -> DataFrame:
    """``(doc_id, cells array<struct<term, tf>>)``: one row per document with a token."""
    tokens = by_key(df.select(F.col(id_col).alias("doc_id"), F.col(tokens_col).alias("tokens")), "doc_id").select("doc_id", rows_of("tokens").alias("token"))
    counted = tokens.groupBy("doc_id", "token").agg(F.count("*").alias("n"))
    cells = counted.groupBy("doc_id", hashed_slot(F.col("token"), num_features).alias("term")).agg(F.sum("n").alias("tf"))
    return cells.groupBy("doc_id").agg(F.collect_list(F.struct("term", "tf")).alias("cells"))


def hashed_index(df: DataFrame, id_col: str, tokens_col: str, num_features: int = 10_000) -> HashedIndex:
    """Hashed counts times ``idf = ln((N + 1) / (df + 1))``, scaled to unit length.

    Slots in every document weigh nothing and are left out, as are documents without another slot.
    There are at most ``num_features`` slots.
    """
    counts = stage(_hashed_counts(df, id_col, tokens_col, num_features), "hashed-counts")
    total = df.agg(F.count("*").alias("n")).scalar()
    frequency = counts.select(rows_of("cells.term").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    slots = stage(frequency.select("term", F.log((total + 1) / (F.col("df") + 1)).alias("idf")), "hashed-slots")
    return HashedIndex(stage(_hashed_unit(counts, slots), "hashed-weights"), slots, num_features)


def _hashed_unit(counts: DataFrame, slots: DataFrame) -> DataFrame:
    """``(term, doc_id, weight)``. Documents are exchanged as one row each; their cells are weighted and scaled where they lie."""
    cells = by_key(counts.filter("doc_id is not null"), "doc_id").select("doc_id", rows_of("cells").alias("cell"))
    # The slots are bounded by their number.
    raw = cells.select("doc_id", "cell.term", "cell.tf").join(F.broadcast(slots), "term").select("doc_id", "term", (F.col("tf") * F.col("idf")).alias("w")).filter("w > 0")
    documents = raw.groupBy("doc_id").agg(_norm(), F.collect_list(F.struct("term", "w")).alias("kept"))
    return documents.select("doc_id", "norm", rows_of("kept").alias("e")).select("e.term", "doc_id", (F.col("e.w") / F.col("norm")).alias("weight"))


def hashed_search(
    index: HashedIndex, queries: DataFrame, id_col: str, tokens_col: str, k: int = TOP_K, min_score: float = MIN_SCORE, digits: int | None = None
) -> DataFrame:
    """Ranked hits by cosine of hashed vectors; a query without a weighted slot has none.

    Scored like :func:`search`: the largest weights of unread blocks and the length of a query's
    unread slots bound what is left, so that most documents are never scored.
    """
    unit = _hashed_unit(_hashed_counts(queries, id_col, tokens_col, index.num_features), index.slots)
    wanted = stage(unit.select(F.col("doc_id").alias("query_id"), "term", F.col("weight").alias("wanted")), "queries")
    asked = index.weights.join(wanted.select("term").distinct(), "term", "left_semi")
    return impact.top_k(stage(impact.with_blocks(asked), "impact-blocks"), wanted, k, min_score, digits)


def hashed_cosine_scores(
    model: PipelineModel, documents: DataFrame, doc_id: str, queries: DataFrame, query_id: str
) -> DataFrame:
    """Cosine of hashed vectors as ``(query_id, doc_id, score float)``; a zero vector never scores.

    Vectors have unit length, so the score is a sum over shared slots: a join, not a Python UDF.
    """
    docs = hashed_weights(model, by_key(documents, doc_id), doc_id).withColumnRenamed(doc_id, "doc_id")
    wanted = hashed_weights(model, queries, query_id).select(F.col(query_id).alias("query_id"), "slot", F.col("weight").alias("wanted"))
    matched = match_by_key(docs, stage(wanted, "queries"), "slot", F.col("doc_id"))
    sums = matched.groupBy("query_id", "doc_id").agg(F.sum(F.col("weight") * F.col("wanted")).alias("score"))
    return sums.withColumn("score", F.col("score").cast("float"))
