"""Language identification of mixed-language texts.

The script of a word narrows its candidate languages; hashed letter n-grams give each candidate a
score; a Viterbi pass over the words of a text, with a penalty for each switch, labels its spans.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.chunks import kept_rows, plain, slices, word_codes

UNKNOWN = "und"
BUCKETS = 1 << 17
ORDERS = (1, 2, 3, 4)
SMOOTHING = 0.5
SWITCH_PENALTY = 8.0
# A language writes a script that holds this share of its training letters.
SCRIPT_SHARE = 0.01
# Expected number of training rows of each language.
ROWS_PER_LANGUAGE = 4000
IMPOSSIBLE = -60.0
# Distinct words whose n-grams are held in memory together.
WORDS_AT_ONCE = 10_000

# First code point, last code point and script of Unicode letter blocks.
SCRIPT_RANGES = [
    (0x0041, 0x024F, "Latin"), (0x0250, 0x02AF, "Latin"), (0x0370, 0x03FF, "Greek"), (0x0400, 0x052F, "Cyrillic"),
    (0x0530, 0x058F, "Armenian"), (0x0590, 0x05FF, "Hebrew"), (0x0600, 0x06FF, "Arabic"), (0x0700, 0x074F, "Syriac"),
    (0x0750, 0x077F, "Arabic"), (0x0900, 0x097F, "Devanagari"), (0x0980, 0x09FF, "Bengali"), (0x0A00, 0x0A7F, "Gurmukhi"),
    (0x0A80, 0x0AFF, "Gujarati"), (0x0B80, 0x0BFF, "Tamil"), (0x0C00, 0x0C7F, "Telugu"), (0x0C80, 0x0CFF, "Kannada"),
    (0x0D00, 0x0D7F, "Malayalam"), (0x0D80, 0x0DFF, "Sinhala"), (0x0E00, 0x0E7F, "Thai"), (0x0E80, 0x0EFF, "Lao"),
    (0x0F00, 0x0FFF, "Tibetan"), (0x1000, 0x109F, "Myanmar"), (0x10A0, 0x10FF, "Georgian"), (0x1100, 0x11FF, "Hangul"),
    (0x1200, 0x139F, "Ethiopic"), (0x1780, 0x17FF, "Khmer"), (0x1E00, 0x1EFF, "Latin"), (0x1F00, 0x1FFF, "Greek"),
    (0x3040, 0x309F, "Hiragana"), (0x30A0, 0x30FF, "Katakana"), (0x3130, 0x318F, "Hangul"), (0x3400, 0x9FFF, "Han"),
    (0xAC00, 0xD7AF, "Hangul"), (0xF900, 0xFAFF, "Han"), (0x20000, 0x323AF, "Han"),
]
SCRIPTS = ["other", *dict.fromkeys(name for _, _, name in SCRIPT_RANGES)]

_tables: list[np.ndarray] = []


def script_table() -> np.ndarray:
    """For each code point the number of its script plus one if it is a letter, else 0."""
    if not _tables:
        scripts = np.zeros(0x110000, np.uint8)
        for first, last, name in SCRIPT_RANGES:
            scripts[first : last + 1] = SCRIPTS.index(name)
        letters = np.fromiter((unicodedata.category(chr(i))[0] == "L" for i in range(0x110000)), bool, 0x110000)
        _tables.append(np.where(letters, scripts + 1, 0).astype(np.uint8))
    return _tables[0]


@dataclass
class Features:
    """Hashed n-grams of distinct words: n-gram ``i`` has bucket ``bucket[i]`` and belongs to word
    ``word[i]``; ``scripts[w]`` is the most frequent script of word ``w`` (0: no letters)."""

    bucket: np.ndarray
    word: np.ndarray
    letters: np.ndarray
    scripts: np.ndarray


def features(words: list[str]) -> Features:
    """All n-grams within the letter runs of each word, run ends included, and each whole run."""
    joined = "\n" + "\n".join(words).lower() + "\n"
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
    kinds = script_table()[points]
    letter = kinds > 0
    word = np.cumsum(points == 10) - 1
    values = np.where(letter, points, 32).astype(np.uint64) + np.uint64(1)
    n = len(points)
    buckets, owners = [], []

    def add(hashes: np.ndarray, at: np.ndarray, order: int) -> None:
        mixed = (hashes * np.uint64(0x9E3779B97F4A7C15)) ^ np.uint64(order * 0x51ED270B)
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        buckets.append((mixed >> np.uint64(40)) % np.uint64(BUCKETS))
        owners.append(word[at])

    rolling = np.zeros(n, np.uint64)
    inner = np.ones(n, bool)  # letters at all places of the window but its two ends
    for order in range(1, max(ORDERS) + 1):
        m = n - order + 1
        rolling = rolling[:m] * np.uint64(1_000_003) + values[order - 1 :]
        if order > 2:
            inner = inner[:m] & letter[order - 2 : order - 2 + m]
        first, last = letter[:m], letter[order - 1 :]
        valid = first if order == 1 else (inner[:m] & (first | last) if order == 2 else inner[:m])
        if order in ORDERS:
            starts = np.flatnonzero(valid)
            # A window that starts with the mark before a word belongs to the letter after it.
            add(rolling[starts], np.where(letter[starts], starts, np.minimum(starts + 1, n - 1)), order)
    begins = np.flatnonzero(letter & ~np.concatenate([[False], letter[:-1]]))
    if len(begins):
        # A whole run: the sum of its letters, each weighted by its place.
        ends = np.flatnonzero(letter & ~np.concatenate([letter[1:], [False]]))
        place = np.arange(n) - np.repeat(np.concatenate([[0], begins]), np.diff(np.concatenate([[0], begins, [n]])))
        power = np.uint64(6364136223846793005) ** np.minimum(place, 64).astype(np.uint64)
        sums = np.concatenate([[np.uint64(0)], np.cumsum(values * power, dtype=np.uint64)])
        add(sums[ends + 1] - sums[begins], begins, 9)

    counts = np.zeros((len(words), len(SCRIPTS)), np.int32)
    np.add.at(counts, (word[letter], kinds[letter] - 1), 1)
    letters = counts.sum(1)
    scripts = np.where(letters > 0, counts.argmax(1) + 1, 0)
    return Features(np.concatenate(buckets).astype(np.int64), np.concatenate(owners).astype(np.int64), letters, scripts)


@dataclass
class Model:
    """``weights[bucket, language]`` (log-likelihoods), ``writes[script, language]``; bounded by the
    number of buckets whatever the training rows are."""

    languages: list[str]
    weights: np.ndarray
    writes: np.ndarray
    common: int

    def word_scores(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """``(scores, letters)``: for each word and language the mean evidence of its n-grams, scaled
        by the square root of their number; 0 for a word without letters or in an unknown script."""
        parts = [self._scores(words[i : i + WORDS_AT_ONCE]) for i in range(0, len(words), WORDS_AT_ONCE)] or [self._scores([])]
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

    def _scores(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = features(words)
        order = np.argsort(found.word, kind="stable")
        bounds = np.searchsorted(found.word[order], np.arange(len(words) + 1))
        totals = np.concatenate([np.zeros((1, len(self.languages))), np.cumsum(self.weights[found.bucket[order]], axis=0, dtype=np.float64)])
        count = np.diff(bounds)
        scores = (totals[bounds[1:]] - totals[bounds[:-1]]) / np.sqrt(np.maximum(count, 1))[:, None]
        scores -= scores.max(1, keepdims=True) if len(words) else 0
        candidates = self.writes[found.scripts]
        narrowed = np.where(candidates, scores, IMPOSSIBLE)
        return np.where(candidates.any(1, keepdims=True), narrowed, 0.0), found.letters


def _sampled(docs: DataFrame, lang: str, key: Column, rows_per_language: int) -> DataFrame:
    """About ``rows_per_language`` rows of each language, or all of them, chosen by a hash of ``key``.

    The driver holds one count per language, as the model holds a column per language; no text moves.
    """
    counts = docs.groupBy(lang).count().collect()
    if not counts:
        return docs
    share = F.create_map(*[F.lit(x) for c in counts for x in (c[0], min(1.0, rows_per_language / c[1]))])
    chance = F.pmod(F.xxhash64(key, F.lit(7)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return docs.filter(chance < F.element_at(share, F.col(lang)))


def train(docs: DataFrame, text_col: str, lang_col: str, key: Column, rows_per_language: int = ROWS_PER_LANGUAGE) -> Model:
    """Learn a model from the rows that have a language and a text.

    Of each language about ``rows_per_language`` rows are read, in whole; counting is spread over
    the tasks, and each hands on at most one row per bucket and language. Without any usable row the
    model has no languages and every text is ``und``.
    """
    usable = docs.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), key.alias("key")).filter("text is not null and lang is not null")
    sample = _sampled(usable, "lang", F.col("key"), rows_per_language).select("text", "lang")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for table in slices(batches):
            langs = np.array(table["lang"].to_pylist(), object)
            offsets, codes, words = word_codes(plain(table["text"]))
            owner = np.repeat(langs, np.diff(offsets))
            times = {lang: np.bincount(codes[owner == lang], minlength=len(words)).astype(np.float64) for lang in set(langs.tolist())}
            for start in range(0, len(words), WORDS_AT_ONCE):
                found = features(words.slice(start, WORDS_AT_ONCE).to_pylist())
                for lang, all_times in times.items():
                    n = all_times[start : start + WORDS_AT_ONCE]
                    grams = np.bincount(found.bucket, n[found.word], BUCKETS)
                    letters = np.bincount(found.scripts, n * found.letters, len(SCRIPTS) + 1)
                    sums[lang] = sums.get(lang, 0) + np.concatenate([grams, letters])
        for lang, total in sums.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(at), pa.string()), "slot": pa.array(at), "n": pa.array(total[at])})

    totals = sample.mapInArrow(counted, "lang string, slot long, n double").groupBy("lang", "slot").agg(F.sum("n").alias("n"))
    # One row per language, and at most BUCKETS slots in each.
    rows = totals.groupBy("lang").agg(F.collect_list(F.struct("slot", "n")).alias("slots")).orderBy("lang").toArrow().to_pydict()
    languages = rows["lang"]
    if not languages:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros((len(SCRIPTS) + 1, 0), bool), 0)
    full = np.zeros((BUCKETS + len(SCRIPTS) + 1, len(languages)))
    for i, slots in enumerate(rows["slots"]):
        full[[s["slot"] for s in slots], i] = [s["n"] for s in slots]
    grams, letters = full[:BUCKETS] + SMOOTHING, full[BUCKETS:]
    weights = np.log(grams / grams.sum(0)).astype(np.float32)
    weights -= weights.mean(1, keepdims=True)
    writes = letters >= SCRIPT_SHARE * np.maximum(letters.sum(0), 1)
    writes[0] = False
    return Model(languages, weights, writes, int(letters.sum(0).argmax()))


def viterbi(scores: np.ndarray, offsets: np.ndarray, penalty: float) -> np.ndarray:
    """The best language of every word, text by text: ``scores`` of all words of text ``i`` lie
    between ``offsets[i]`` and ``offsets[i + 1]``. All texts advance together, word by word."""
    lengths = np.diff(offsets)
    order = np.argsort(-lengths, kind="stable")
    starts, sizes = offsets[:-1][order], lengths[order]
    steps = int(sizes[0]) if len(sizes) else 0
    alive = np.searchsorted(-sizes, -np.arange(steps), side="left")  # texts longer than each step
    stay = np.ones(scores.shape, bool)
    origin = np.zeros(len(scores), np.int16)
    labels = np.zeros(len(scores), np.int16)
    best = np.zeros((len(sizes), scores.shape[1]))
    for step in range(steps):
        k = alive[step]
        at = starts[:k] + step
        now = best[:k]
        if step:
            top = now.argmax(1)
            switched = now[np.arange(k), top][:, None] - penalty
            stay[at] = now >= switched
            origin[at] = top
            now = np.maximum(now, switched)
        best[:k] = now + scores[at]
    state = best.argmax(1).astype(np.int16)
    for step in range(steps - 1, -1, -1):
        k = alive[step]
        at = starts[:k] + step
        labels[at] = state[:k]
        state[:k] = np.where(stay[at, state[:k]], state[:k], origin[at])
    return labels


@dataclass
class Labels:
    """What :func:`label` finds: for each text the language and score, the share of its letters in words
    that some language may write, and the spans of all texts."""

    lang: list[str]
    score: np.ndarray
    known: np.ndarray
    spans_per_text: np.ndarray
    first_word: np.ndarray
    words: np.ndarray
    span_lang: np.ndarray


def label(texts: pa.Array, model: Model, penalty: float) -> Labels:
    """Languages and spans of some texts."""
    offsets, codes, words = word_codes(texts)
    rows, names = len(texts), model.languages
    none = np.zeros(0, np.int64)
    if not names or not len(codes):
        return Labels([UNKNOWN] * rows, np.zeros(rows), np.zeros(rows), np.zeros(rows, np.int64), none, none, none)
    scores, letters = model.word_scores(words.to_pylist())
    letters = letters.astype(np.float64)
    known = letters * (scores.min(1, initial=0.0) < 0)
    owner = np.repeat(np.arange(rows), np.diff(offsets))
    all_letters = np.bincount(owner, letters[codes], rows)
    lettered = all_letters > 0
    if not lettered.any():
        return Labels([UNKNOWN] * rows, np.zeros(rows), np.zeros(rows), np.zeros(rows, np.int64), none, none, none)
    labels = viterbi(scores[codes], offsets, penalty)
    held = np.bincount(owner * len(names) + labels, known[codes], rows * len(names)).reshape(rows, -1)
    top = np.where(held.any(1), held.argmax(1), model.common)
    share = held[np.arange(rows), top] / np.maximum(all_letters, 1)
    # A span starts where a text or its label does.
    edge = np.ones(len(codes), bool)
    edge[1:] = (owner[1:] != owner[:-1]) | (labels[1:] != labels[:-1])
    first = np.flatnonzero(edge)
    size = np.diff(np.append(first, len(codes)))
    usable = lettered[owner[first]]
    first, size = first[usable], size[usable]
    lang = [names[t] if ok else UNKNOWN for t, ok in zip(top.tolist(), lettered.tolist())]
    return Labels(lang, np.where(lettered, share, 0.0), held.sum(1) / np.maximum(all_letters, 1), np.bincount(owner[first], minlength=rows), first - offsets[owner[first]], size, labels[first])


SPAN = pa.list_(pa.struct([("first_word", pa.int32()), ("words", pa.int32()), ("lang", pa.string())]))


def identify(docs: DataFrame, id_col: str, text_col: str, model: Model, penalty: float = SWITCH_PENALTY) -> DataFrame:
    """``doc_id, lang_pred, score, spans`` for each row; nothing but the text is used.

    ``spans`` are ``(first_word, words, lang)``, words being what lies between ASCII white space.
    ``lang_pred`` is the language whose spans hold most letters (ties: the first by name) and
    ``score`` is their share of all letters, counting only words in a script that some language
    writes. Texts that are null or have no letters are ``und`` with score 0 and no spans; a text
    in a script of no known language gets the most trained language with score 0. Equal rows, null
    ids and an empty table are no special cases; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = dict(docs.dtypes)[id_col]

    def labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in slices(batches):
            found = label(plain(table["text"]), shared.value, penalty)
            langs = pa.array([*shared.value.languages, None], pa.string()).take(pa.array(found.span_lang.astype(np.int32)))
            spans = pa.StructArray.from_arrays([pa.array(found.first_word.astype(np.int32)), pa.array(found.words.astype(np.int32)), langs], fields=list(SPAN.value_type))
            bounds = np.concatenate([[0], np.cumsum(found.spans_per_text)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [plain(table["doc_id"]), pa.array(found.lang, pa.string()), pa.array(found.score), pa.ListArray.from_arrays(pa.array(bounds), spans).cast(SPAN)],
                names=["doc_id", "lang_pred", "score", "spans"],
            )

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(labelled, f"doc_id {kind}, lang_pred string, score double, spans array<struct<first_word:int,words:int,lang:string>>")


def kept(docs: DataFrame, text_col: str, model: Model, least_known: float, penalty: float = SWITCH_PENALTY) -> DataFrame:
    """The rows, with all their columns, of which at least the share ``least_known`` of the letters
    lies in words that some known language may write, in however many languages.

    Texts without letters go. A model without languages rejects no other text.
    """
    if not model.languages:
        return docs.filter(F.coalesce(F.col(text_col), F.lit("")).rlike(r"\p{L}"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def decide(texts: pa.Array) -> np.ndarray:
        found = label(texts, shared.value, penalty)
        return (found.known >= least_known) & (np.array(found.lang, object) != UNKNOWN)

    return kept_rows(docs, text_col, decide)
