"""Text preprocessing and n-gram counts over whole documents."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.catalog import textsql as sql
from millrace.catalog.registry import query
from millrace.catalog.views import table
from millrace.functions import lexicon
from millrace.functions import text as tx
from millrace.operators import frequency, presets
from millrace.plans.spread import spread

# Overlapping on purpose: the longer phrase wins where both fit.
PHRASES = ["of the", "in the", "and the", "of the in", "to and", "de la", "el la de", "que la", "the and", "und der"]
PAIRS = {("the", "of"): "the-of", ("of", "the"): "of.the", ("and", "the"): "and the", ("la", "de"): "la-de"}


def documents(spark: SparkSession, folder: str, name: str = "documents") -> DataFrame:
    return spread(table(spark, folder, name).select("doc_id", "text"))


def _shown(df: DataFrame, tokens: Column, key: str = "doc_id") -> DataFrame:
    return df.select(key, tokens.alias("tokens")).select(
        key, F.size("tokens").cast("long").alias("n_tokens"), tx.as_text(F.col("tokens")).alias("tokens")
    )


def _shown_sql(tokens: str, source: str = "documents", key: str = "doc_id", steps: str = "") -> str:
    return f"""WITH {steps}shown AS (SELECT {key}, {tokens} AS tokens FROM {source})
        SELECT {key}, CAST(len(tokens) AS BIGINT) AS n_tokens, array_to_string(tokens, ' ') AS tokens FROM shown"""


SIMPLE = sql.simple_tokens("text")
WORDS = sql.word_tokens("text")


@query("phrases_kept", _shown_sql(sql.protect_phrases(SIMPLE, sorted(PHRASES, key=lambda p: (-len(p), p)))))
def phrases_kept(spark: SparkSession, folder: str) -> DataFrame:
    tokens = tx.protect_phrases(tx.simple_tokens(F.col("text")), PHRASES)
    return _shown(documents(spark, folder), tokens)


@query("phrases_kept_as_listed", _shown_sql(sql.protect_phrases(SIMPLE, PHRASES)))
def phrases_kept_as_listed(spark: SparkSession, folder: str) -> DataFrame:
    tokens = tx.protect_phrases(tx.simple_tokens(F.col("text")), PHRASES, "listed", keep_case=False)
    return _shown(documents(spark, folder), tokens)


@query("word_tokens", _shown_sql(WORDS))
def word_tokens(spark: SparkSession, folder: str) -> DataFrame:
    return _shown(documents(spark, folder), tx.word_tokens(F.col("text")))


@query("simple_tokens", _shown_sql(SIMPLE))
def simple_tokens(spark: SparkSession, folder: str) -> DataFrame:
    return _shown(documents(spark, folder), tx.simple_tokens(F.col("text")))


@query("punctuation_stripped", _shown_sql(sql.strip_punctuation(WORDS)))
def punctuation_stripped(spark: SparkSession, folder: str) -> DataFrame:
    return _shown(documents(spark, folder), tx.strip_punctuation(tx.word_tokens(F.col("text"))))


@query("non_word_stripped", _shown_sql(sql.strip_non_word(WORDS)))
def non_word_stripped(spark: SparkSession, folder: str) -> DataFrame:
    return _shown(documents(spark, folder), tx.strip_non_word(tx.word_tokens(F.col("text"))))


@query("numbers_and_units_dropped", _shown_sql(sql.drop_numbers_and_units(SIMPLE)))
def numbers_and_units_dropped(spark: SparkSession, folder: str) -> DataFrame:
    return _shown(documents(spark, folder), tx.drop_numbers_and_units(tx.simple_tokens(F.col("text"))))


@query("terms_joined", _shown_sql(sql.join_pairs(SIMPLE, PAIRS)))
def terms_joined(spark: SparkSession, folder: str) -> DataFrame:
    return _shown(documents(spark, folder), tx.join_terms(tx.simple_tokens(F.col("text")), PAIRS))


@query("stop_words_dropped", _shown_sql(sql.drop_stop_words(WORDS, lexicon.ENGLISH_STOP_WORDS + lexicon.ITALIAN_STOP_WORDS)))
def stop_words_dropped(spark: SparkSession, folder: str) -> DataFrame:
    words = lexicon.ENGLISH_STOP_WORDS + lexicon.ITALIAN_STOP_WORDS
    return _shown(documents(spark, folder), tx.drop_stop_words(tx.word_tokens(F.col("text")), words))


@query("stop_words_dropped_exact_case", _shown_sql(sql.drop_stop_words(WORDS, lexicon.ENGLISH_STOP_WORDS, False)))
def stop_words_dropped_exact_case(spark: SparkSession, folder: str) -> DataFrame:
    return _shown(documents(spark, folder), tx.drop_stop_words(tx.word_tokens(F.col("text")), lexicon.ENGLISH_STOP_WORDS, False))


@query("word_forms", _shown_sql(sql.normalise(SIMPLE, True)))
def word_forms(spark: SparkSession, folder: str) -> DataFrame:
    return _shown(documents(spark, folder), tx.normalise(tx.simple_tokens(F.col("text"))))


def _without_final_e(words: pd.Series) -> pd.Series:
    return words.str.replace("e$", "", regex=True)


@query("word_forms_by_function", _shown_sql(sql.each(SIMPLE, "regexp_replace(t, 'e$', '')")))
def word_forms_by_function(spark: SparkSession, folder: str) -> DataFrame:
    tokens = presets.with_tokens(documents(spark, folder), "text", "plain")
    return _shown(presets.with_word_forms(tokens, "tokens", _without_final_e), F.col("tokens"))


@query("phrases_restored", _shown_sql(sql.each(sql.protect_phrases(SIMPLE, sorted(PHRASES, key=lambda p: (-len(p), p))), "replace(t, '_', ' ')")))
def phrases_restored(spark: SparkSession, folder: str) -> DataFrame:
    kept = tx.protect_phrases(tx.simple_tokens(F.col("text")), PHRASES, keep_case=False)
    return _shown(documents(spark, folder), tx.restore_phrases(kept))


@query("rich_preset", _shown_sql("tokens", "rich", steps=sql.rich_steps("text", "documents", "doc_id") + ", "))
def rich_preset(spark: SparkSession, folder: str) -> DataFrame:
    stage = presets.TextPreset(inputCol="text", outputCol="tokens")
    return _shown(stage.transform(documents(spark, folder)), F.col("tokens"))


@query("rich_preset_partly_off", _shown_sql(sql.normalise(sql.drop_numbers_and_units(sql.strip_punctuation(WORDS)), True)))
def rich_preset_partly_off(spark: SparkSession, folder: str) -> DataFrame:
    stage = presets.TextPreset(enableMultiWordTerms=False, enableJoinedTerms=False, enableStopwords=False, enableRestoration=False)
    return _shown(stage.transform(documents(spark, folder)), F.col("tokens"))


@query("simple_preset", _shown_sql(sql.simple_preset("text")))
def simple_preset(spark: SparkSession, folder: str) -> DataFrame:
    return _shown(presets.with_tokens(documents(spark, folder), "text", "simple"), F.col("tokens"))


@query("conversation_tokens", _shown_sql(sql.simple_preset("text"), "conversations", "conv_id, turn"))
def conversation_tokens(spark: SparkSession, folder: str) -> DataFrame:
    rows = presets.with_tokens(table(spark, folder, "conversations"), "text", "simple")
    return rows.select("conv_id", "turn", F.size("tokens").cast("long").alias("n_tokens"), tx.as_text(F.col("tokens")).alias("tokens"))


def _counts_sql(n: int, preset: str) -> str:
    return f"""WITH {sql.document_tokens(preset)}, grams AS (SELECT unnest({sql.gram_lists('tokens', n)}) AS words FROM tokenised)
        SELECT array_to_string(words, ' ') AS gram, CAST(count(*) AS BIGINT) AS count FROM grams GROUP BY words"""


def _counts(spark: SparkSession, folder: str, n: int, preset: str) -> DataFrame:
    return frequency.ngram_counts(presets.with_tokens(documents(spark, folder), "text", preset), "tokens", n)


@query("word_counts", _counts_sql(1, SIMPLE))
def word_counts(spark: SparkSession, folder: str) -> DataFrame:
    return _counts(spark, folder, 1, "plain")


@query("bigram_counts", _counts_sql(2, SIMPLE))
def bigram_counts(spark: SparkSession, folder: str) -> DataFrame:
    return _counts(spark, folder, 2, "plain")


@query("trigram_counts", _counts_sql(3, SIMPLE))
def trigram_counts(spark: SparkSession, folder: str) -> DataFrame:
    return _counts(spark, folder, 3, "plain")


def _top_sql(n: int, top: int) -> str:
    return _counts_sql(n, sql.simple_preset("text")) + f" ORDER BY count DESC, gram LIMIT {top}"


@query("top_words", _top_sql(1, 20))
def top_words(spark: SparkSession, folder: str) -> DataFrame:
    return frequency.most_common(_counts(spark, folder, 1, "simple"), 20)


@query("top_bigrams", _top_sql(2, 20))
def top_bigrams(spark: SparkSession, folder: str) -> DataFrame:
    return frequency.most_common(_counts(spark, folder, 2, "simple"), 20)


@query("top_trigrams", _top_sql(3, 20))
def top_trigrams(spark: SparkSession, folder: str) -> DataFrame:
    return frequency.most_common(_counts(spark, folder, 3, "simple"), 20)
