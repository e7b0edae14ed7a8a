"""Text presets: the rich and the simple preprocessing chain, and a hook for caller-made word forms."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

import pandas as pd
from pyspark.ml import Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import lexicon
from millrace.functions import text as tx


@dataclass(frozen=True)
class RichPreset:
    """Phrases, words, cleaning, joined terms, stop words, word forms; each step can be turned off."""

    multi_word_terms: bool = True
    punctuation_removal: bool = True
    joined_terms: bool = True
    stop_words: bool = True
    processing: bool = True
    second_pass: bool = True
    restore: bool = False
    phrases: tuple[str, ...] = lexicon.PHRASES
    phrase_order: str = "longest"
    pairs: Mapping[tuple[str, str], str] = field(default_factory=lambda: dict(lexicon.JOINED_PAIRS))

    def __call__(self, text: Column) -> Column:
        tokens = tx.word_tokens(text)
        if self.multi_word_terms:
            tokens = tx.protect_phrases(
                tokens, self.phrases, self.phrase_order, keep_case=not self.punctuation_removal, strip=self.punctuation_removal
            )
        elif self.punctuation_removal:
            tokens = tx.strip_punctuation(tokens)
        if self.punctuation_removal:
            tokens = tx.drop_numbers_and_units(tokens)
        if self.joined_terms:
            tokens = tx.join_terms(tokens, self.pairs)
        if self.stop_words:
            tokens = tx.drop_stop_words(tokens, lexicon.ENGLISH_STOP_WORDS + lexicon.ITALIAN_STOP_WORDS)
        if self.processing:
            tokens = tx.normalise(tokens)
            if self.second_pass:
                tokens = tx.normalise(tokens)
        return tx.restore_phrases(tokens) if self.restore else tokens


def simple_preset(text: Column) -> Column:
    """Lower-case words without punctuation and English stop words, in dictionary form."""
    tokens = tx.bare_words(F.lower(text))
    tokens = tx.drop_stop_words(tokens, lexicon.ENGLISH_STOP_WORDS, ignore_case=False)
    return tx.normalise(tokens, preserved=())


PRESETS: dict[str, Callable[[Column], Column]] = {
    "rich": RichPreset(),
    "simple": simple_preset,
    "plain": tx.simple_tokens,
}


def with_tokens(
    df: DataFrame, text_col: str, preset: str | Callable[[Column], Column] = "rich", out_col: str = "tokens"
) -> DataFrame:
    """Add the token list of a text column."""
    make = PRESETS[preset] if isinstance(preset, str) else preset
    return df.withColumn(out_col, make(F.col(text_col)))


def with_word_forms(df: DataFrame, tokens_col: str, forms: Callable[[pd.Series], pd.Series]) -> DataFrame:
    """Replace tokens by ``forms(distinct tokens)``, a caller's stemmer or lemmatiser.

    ``forms`` sees each distinct token of an Arrow batch once. Rows stay where they are: there is
    no join on the token, so no frequent word can overload a task.
    """

    @F.pandas_udf("array<string>")
    def apply(lists: pd.Series) -> pd.Series:
        distinct = pd.Series(sorted({t for tokens in lists.dropna() for t in tokens}), dtype="object")
        known = dict(zip(distinct, forms(distinct))) if len(distinct) else {}
        return lists.map(lambda tokens: None if tokens is None else [known[t] for t in tokens])

    return df.withColumn(tokens_col, apply(tokens_col))


class TextPreset(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """The rich preset as an ML stage whose six switches are parameters."""

    enableMultiWordTerms = Param(Params._dummy(), "enableMultiWordTerms", "keep phrases", TypeConverters.toBoolean)
    enableStopwords = Param(Params._dummy(), "enableStopwords", "drop stop words", TypeConverters.toBoolean)
    enablePunctuationRemoval = Param(Params._dummy(), "enablePunctuationRemoval", "clean tokens", TypeConverters.toBoolean)
    enableJoinedTerms = Param(Params._dummy(), "enableJoinedTerms", "join pairs", TypeConverters.toBoolean)
    enableProcessing = Param(Params._dummy(), "enableProcessing", "word forms", TypeConverters.toBoolean)
    enableRestoration = Param(Params._dummy(), "enableRestoration", "second word-form pass", TypeConverters.toBoolean)

    _switches = {
        "enableMultiWordTerms": "multi_word_terms",
        "enableStopwords": "stop_words",
        "enablePunctuationRemoval": "punctuation_removal",
        "enableJoinedTerms": "joined_terms",
        "enableProcessing": "processing",
        "enableRestoration": "second_pass",
    }

    def __init__(self, inputCol: str = "text", outputCol: str = "tokens", **switches: bool):
        super().__init__()
        self._setDefault(inputCol="text", outputCol="tokens", **{name: True for name in self._switches})
        self._set(inputCol=inputCol, outputCol=outputCol, **switches)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        options = {option: self.getOrDefault(name) for name, option in self._switches.items()}
        return with_tokens(dataset, self.getInputCol(), RichPreset(**options), self.getOutputCol())
