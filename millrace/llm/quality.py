"""Quality classifier without hand labels.

Heuristic labellers vote on each document or abstain. Expectation-maximisation over the counts of
vote patterns estimates how accurate each labeller is, the posteriors label a bounded sample, and a
linear model over hashed features learns from them and scores every document.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.chunks import kept_rows, plain, slices, word_codes

BUCKETS = 1 << 14
# Expected number of rows the linear model is fitted on.
TRAINING_ROWS = 6000
EM_ROUNDS = 100
FEW_WORDS = 20

_kinds: list[np.ndarray] = []
UPPER, LETTER, DIGIT, COMMON, SYMBOL = 1, 2, 3, 4, 5
# Marks of ordinary prose.
COMMON_MARKS = ".,;:!?'\"()-«»„“”‘’…–—¿¡"


def _kind_table() -> np.ndarray:
    """For each code point the kind of its character, 0 for white space and control characters."""
    if not _kinds:
        kinds = np.full(0x110000, SYMBOL, np.uint8)
        by_category = {"Lu": UPPER, "Lt": UPPER, "Ll": LETTER, "Lo": LETTER, "Lm": LETTER, "Mn": LETTER, "Mc": LETTER, "Nd": DIGIT, "Cc": 0, "Zs": 0, "Zl": 0, "Zp": 0}
        for i in range(0x110000):
            kind = by_category.get(unicodedata.category(chr(i)))
            if kind is not None:
                kinds[i] = kind
        for mark in COMMON_MARKS:
            kinds[ord(mark)] = COMMON
        _kinds.append(kinds)
    return _kinds[0]


@dataclass
class Words:
    """Texts as word codes, with the kinds of characters of each distinct word counted."""

    offsets: np.ndarray
    codes: np.ndarray
    owner: np.ndarray
    kinds: np.ndarray
    shapes: list[str]
    last: np.ndarray

    @classmethod
    def of(cls, texts: pa.Array) -> Words:
        offsets, codes, words = word_codes(texts)
        listed = words.to_pylist()
        points = np.frombuffer(("".join(w + "\n" for w in listed)).encode("utf-32-le", "surrogatepass"), "<u4")
        kind = _kind_table()[points]
        ends = np.flatnonzero(points == 10)
        word = np.repeat(np.arange(len(listed)), np.diff(np.concatenate([[-1], ends])))
        kinds = np.stack([np.bincount(word[kind == k], minlength=len(listed)) for k in range(SYMBOL + 1)], 1)
        # The shape of a word: its characters by kind, marks and symbols as they are, runs as one.
        drawn = np.where(kind == UPPER, ord("A"), np.where(kind == LETTER, ord("a"), np.where(kind == DIGIT, ord("9"), points))).astype("<u4")
        kept = np.concatenate([[True], (drawn[1:] != drawn[:-1]) | (points[1:] == 10)]) if len(drawn) else np.zeros(0, bool)
        shapes = drawn[kept].tobytes().decode("utf-32-le", "surrogatepass").split("\n")[:-1]
        last = points[ends - 1] if len(ends) else np.zeros(0, "<u4")
        return cls(offsets, codes, np.repeat(np.arange(len(offsets) - 1), np.diff(offsets)), kinds, shapes, last)

    @property
    def rows(self) -> int:
        return len(self.offsets) - 1

    def total(self, per_word: np.ndarray) -> np.ndarray:
        return np.bincount(self.owner, per_word[self.codes], self.rows)

    def distinct_share(self, keys: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each text the share of distinct keys, and that of the most frequent one."""
        order = np.lexsort((keys, owner))
        k, o = keys[order], owner[order]
        first = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (o[1:] != o[:-1])])) if len(k) else np.zeros(0, int)
        runs = np.diff(np.append(first, len(k)))
        all_keys = np.maximum(np.bincount(owner, minlength=self.rows), 1)
        most = np.zeros(self.rows)
        np.maximum.at(most, o[first], runs)
        return np.bincount(o[first], minlength=self.rows) / all_keys, most / all_keys

    def statistics(self) -> dict[str, np.ndarray]:
        n = np.diff(self.offsets).astype(np.float64)
        words = np.maximum(n, 1)
        sums = np.stack([self.total(self.kinds[:, k].astype(np.float64)) for k in range(SYMBOL + 1)], 1)
        letters = np.maximum(sums[:, UPPER] + sums[:, LETTER], 1)
        shown = np.maximum(sums[:, UPPER:].sum(1), 1)
        wordlike = (self.kinds[:, UPPER] + self.kinds[:, LETTER] > 0).astype(np.float64)
        inner = np.flatnonzero(self.owner[1:] == self.owner[:-1])
        pairs = self.codes[:-1][inner] * (len(self.shapes) + 1) + self.codes[1:][inner]
        same = (self.codes[1:][inner] == self.codes[:-1][inner]).astype(np.float64)
        distinct_pairs, _ = self.distinct_share(pairs, self.owner[:-1][inner])
        _, top = self.distinct_share(self.codes, self.owner)
        capital = (self.kinds[:, UPPER] > 1) & (self.kinds[:, LETTER] == 0)
        ends = lambda marks: self.total(np.isin(self.last, [ord(m) for m in marks]).astype(np.float64)) / words
        symbolic = (self.kinds[:, SYMBOL] > 0).astype(np.float64)
        return {
            "words": n,
            "symbols": sums[:, SYMBOL] / shown,
            "symbol_words": self.total(symbolic) / words,
            "digits": sums[:, DIGIT] / shown,
            "capitals": sums[:, UPPER] / letters,
            "capital_words": self.total(capital.astype(np.float64)) / words,
            "shouts": ends("!"),
            "stops": ends(".?!…。！？।"),
            "wordlike": self.total(wordlike) / words,
            "word_length": sums[:, UPPER:].sum(1) / words,
            "repeats": np.bincount(self.owner[:-1][inner], same, self.rows) / words,
            "distinct_pairs": distinct_pairs,
            "top_word": top,
        }


@dataclass
class Labeller:
    """Votes -1 where ``bad`` holds, 1 where ``good`` holds, else 0 (abstains); texts of fewer than
    ``least_words`` words get no vote."""

    name: str
    bad: Callable[[dict], np.ndarray]
    good: Callable[[dict], np.ndarray]
    least_words: int = 1

    def votes(self, s: dict[str, np.ndarray]) -> np.ndarray:
        vote = np.where(self.bad(s), -1, np.where(self.good(s), 1, 0))
        return np.where(s["words"] >= self.least_words, vote, 0)


def between(name: str, bad_from: float, good_to: float, least_words: int = 1) -> Labeller:
    """Bad from one bound up and good up to a smaller one; the other way round if the first is smaller."""
    if bad_from > good_to:
        return Labeller(name, lambda s: s[name] >= bad_from, lambda s: s[name] <= good_to, least_words)
    return Labeller(name, lambda s: s[name] <= bad_from, lambda s: s[name] >= good_to, least_words)


LABELLERS = [
    between("symbols", 0.15, 0.03),
    between("symbol_words", 0.30, 0.10),
    between("digits", 0.30, 0.05, FEW_WORDS),
    between("capitals", 0.50, 0.20, 5),
    between("capital_words", 0.40, 0.10, 5),
    between("shouts", 0.25, 0.05, 5),
    between("wordlike", 0.70, 0.90, FEW_WORDS),
    between("repeats", 0.30, 0.05, FEW_WORDS),
    between("distinct_pairs", 0.30, 0.60, FEW_WORDS),
    between("top_word", 0.35, 0.20, FEW_WORDS),
    Labeller("stops", lambda s: (s["stops"] < 0.002) | (s["stops"] > 0.7), lambda s: (s["stops"] > 0.01) & (s["stops"] < 0.5), 3 * FEW_WORDS),
    Labeller("word_length", lambda s: (s["word_length"] < 2) | (s["word_length"] > 25), lambda s: (s["word_length"] > 3) & (s["word_length"] < 12), 5),
]


def pattern_numbers(votes: np.ndarray) -> np.ndarray:
    """Rows of votes as one number each."""
    return ((votes + 1) * 3 ** np.arange(votes.shape[1], dtype=np.int64)).sum(1)


def pattern_votes(numbers: np.ndarray, labellers: int) -> np.ndarray:
    return numbers[:, None] // 3 ** np.arange(labellers, dtype=np.int64) % 3 - 1


@dataclass
class LabelModel:
    """``bad_rate[c, j]``: how often labeller ``j``, if it votes, votes bad on class ``c`` (0 bad, 1 good)."""

    prior: float
    bad_rate: np.ndarray

    @property
    def accuracy(self) -> np.ndarray:
        """Of each labeller's votes on documents of either class, the share that is right, by class."""
        return np.stack([self.bad_rate[0], 1 - self.bad_rate[1]])

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """Probability of the good class for each row of votes."""
        bad, good = votes < 0, votes > 0
        evidence = np.log(self.bad_rate[1] / self.bad_rate[0]) * bad + np.log((1 - self.bad_rate[1]) / (1 - self.bad_rate[0])) * good
        odds = np.log(self.prior / (1 - self.prior)) + evidence.sum(1)
        return 1 / (1 + np.exp(-np.clip(odds, -50, 50)))


def fit_labels(votes: np.ndarray, counts: np.ndarray, rounds: int = EM_ROUNDS) -> LabelModel:
    """Expectation-maximisation from distinct vote patterns and their counts.

    Starts from the belief that any bad vote is a bad sign: a fault shows to the few labellers that
    look for it, while the others see nothing wrong. Rates are smoothed by one vote either way.
    """
    counts = counts.astype(np.float64)
    q = np.where((votes < 0).any(1), 0.1, 0.95)
    model = LabelModel(0.9, np.full((2, votes.shape[1]), 0.5))
    for _ in range(rounds):
        weight = np.stack([counts * (1 - q), counts * q])
        bad, cast = weight @ (votes < 0), weight @ (votes != 0)
        previous, model = model, LabelModel(float((weight[1].sum() + 1) / (counts.sum() + 2)), (bad + 1) / (cast + 2))
        # A labeller must not count a bad vote in a document's favour.
        model.bad_rate[0] = np.maximum(model.bad_rate[0], model.bad_rate[1])
        if np.abs(model.bad_rate - previous.bad_rate).max() < 1e-6:
            break
        q = model.posterior(votes)
    return model


def _slot(*parts: str) -> int:
    return xxhash.xxh32_intdigest("\t".join(parts), 17) % BUCKETS


def hashed_features(words: Words, statistics: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(row, bucket, value)``: shares of word shapes and of their pairs, and one slot for the range
    each statistic lies in."""
    # As dictionary codes: an array of equally wide strings would be as wide as the longest word.
    encoded = plain(pc.dictionary_encode(pa.array(words.shapes, pa.large_string())))
    shapes, of_word = encoded.dictionary.to_pylist(), encoded.indices.to_numpy(zero_copy_only=False)
    slots = np.array([_slot("shape", s) for s in shapes], np.int64)
    shape = of_word[words.codes].astype(np.int64)
    n = np.maximum(np.diff(words.offsets), 1).astype(np.float64)
    rows, buckets, values = [words.owner], [slots[shape] if len(shape) else np.zeros(0, int)], [1 / n[words.owner]]
    inner = np.flatnonzero(words.owner[1:] == words.owner[:-1])
    if len(inner):
        pair, at = np.unique(shape[:-1][inner] * len(shapes) + shape[1:][inner], return_inverse=True)
        pair_slots = np.array([_slot("pair", shapes[p // len(shapes)], shapes[p % len(shapes)]) for p in pair.tolist()], np.int64)
        rows.append(words.owner[:-1][inner])
        buckets.append(pair_slots[at])
        values.append(1 / n[words.owner[:-1][inner]])
    for name, value in statistics.items():
        level = np.clip(np.floor(2 * np.log2(1 + value)) if name in ("words", "word_length") else np.floor(20 * value), 0, 40).astype(int)
        table = np.array([_slot("range", name, str(i)) for i in range(41)], np.int64)
        rows.append(np.arange(words.rows))
        buckets.append(table[level])
        values.append(np.full(words.rows, 0.5))
    keys, at = np.unique(np.concatenate(rows) * BUCKETS + np.concatenate(buckets), return_inverse=True)
    return keys // BUCKETS, keys % BUCKETS, np.bincount(at, np.concatenate(values), len(keys))


def fit_linear(row: np.ndarray, bucket: np.ndarray, value: np.ndarray, target: np.ndarray, rounds: int = 300, penalty: float = 1e-4) -> np.ndarray:
    """Weights (the last one is the constant) of a logistic model for soft targets, by adaptive gradient steps."""
    weights, seen = np.zeros(BUCKETS + 1), np.full(BUCKETS + 1, 1e-8)
    for _ in range(rounds):
        odds = np.bincount(row, weights[bucket] * value, len(target)) + weights[-1]
        error = (1 / (1 + np.exp(-np.clip(odds, -50, 50))) - target) / len(target)
        slope = np.append(np.bincount(bucket, error[row] * value, BUCKETS), error.sum())
        slope[:-1] += penalty * weights[:-1] / len(target)
        seen += slope**2
        weights -= 0.5 * slope / np.sqrt(seen)
    return weights


@dataclass
class Scorer:
    labels: LabelModel
    weights: np.ndarray

    def __call__(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """``(posterior, score)`` of each text."""
        statistics = words.statistics()
        votes = np.stack([x.votes(statistics) for x in LABELLERS], 1)
        row, bucket, value = hashed_features(words, statistics)
        odds = np.bincount(row, self.weights[bucket] * value, words.rows) + self.weights[-1]
        return self.labels.posterior(votes), 1 / (1 + np.exp(-np.clip(odds, -50, 50)))


def _texts(docs: DataFrame, text_col: str) -> DataFrame:
    return docs.select(F.col(text_col).alias("text"))


def vote_counts(docs: DataFrame, text_col: str) -> DataFrame:
    """``pattern, n``: how many documents have each pattern of votes; every task adds up its own first."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, int] = {}
        for table in slices(batches):
            statistics = Words.of(plain(table["text"])).statistics()
            numbers = pattern_numbers(np.stack([x.votes(statistics) for x in LABELLERS], 1))
            for number, n in zip(*np.unique(numbers, return_counts=True)):
                sums[int(number)] = sums.get(int(number), 0) + int(n)
        yield pa.RecordBatch.from_pydict({"pattern": pa.array(list(sums), pa.int64()), "n": pa.array(list(sums.values()), pa.int64())})

    return _texts(docs, text_col).mapInArrow(counted, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, text_col: str, key: Column | None = None, training_rows: int = TRAINING_ROWS) -> Scorer:
    """Estimate the labellers from all documents and fit the linear model on about ``training_rows``.

    The driver gets one row per vote pattern (at most 3 to the number of labellers) and the hashed
    features of the sample, which is drawn by hash of the text and of ``key``, whatever the layout of
    the files. Rows of the same text and key are drawn together, with the small chance of one row.
    Without documents every text scores 0.5 and is kept.
    """
    patterns = vote_counts(docs, text_col).toArrow()
    n = patterns["n"].to_numpy()
    if not len(n):
        return Scorer(LabelModel(0.5, np.full((2, len(LABELLERS)), 0.5)), np.zeros(BUCKETS + 1))
    labels = fit_labels(pattern_votes(patterns["pattern"].to_numpy(), len(LABELLERS)), n)
    chance = F.pmod(F.xxhash64(F.coalesce(F.col(text_col), F.lit("")), F.lit(0) if key is None else key), F.lit(1 << 30))
    sample = _texts(docs.filter(chance < int(min(1.0, training_rows / int(n.sum())) * (1 << 30))), text_col)

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in slices(batches):
            words = Words.of(plain(table["text"]))
            statistics = words.statistics()
            posterior = labels.posterior(np.stack([x.votes(statistics) for x in LABELLERS], 1))
            row, bucket, value = hashed_features(words, statistics)
            bounds = np.searchsorted(row, np.arange(words.rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(posterior), pa.ListArray.from_arrays(pa.array(bounds), pa.array(bucket)), pa.ListArray.from_arrays(pa.array(bounds), pa.array(value))],
                names=["posterior", "buckets", "shares"],
            )

    rows = sample.mapInArrow(described, "posterior double, buckets array<long>, shares array<double>").toArrow()
    # A fixed order: the same rows give the same weights to the last bit.
    rows = rows.sort_by("posterior") if rows.num_rows else rows
    target = rows["posterior"].to_numpy()
    sizes = pc.list_value_length(rows["buckets"]).to_numpy()
    flat = lambda name: pc.list_flatten(rows[name]).to_numpy()
    return Scorer(labels, fit_linear(np.repeat(np.arange(len(target)), sizes), flat("buckets"), flat("shares"), target))


def classify(docs: DataFrame, id_col: str, text_col: str, scorer: Scorer, threshold: float = 0.5) -> DataFrame:
    """``doc_id, posterior, score, keep`` for each row.

    ``posterior`` follows from the votes alone, ``score`` is the linear model's; a document is kept
    if its score is at least ``threshold``. Null and wordless texts get no votes but those for
    what they lack, so they score low rather than fail. Equal texts score alike; null ids are kept;
    an empty table gives no rows; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(scorer)
    kind = dict(docs.dtypes)[id_col]

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in slices(batches):
            posterior, score = shared.value(Words.of(plain(table["text"])))
            yield pa.RecordBatch.from_arrays([plain(table["doc_id"]), pa.array(posterior), pa.array(score), pa.array(score >= threshold)], names=["doc_id", "posterior", "score", "keep"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(scored, f"doc_id {kind}, posterior double, score double, keep boolean")


def kept(docs: DataFrame, text_col: str, scorer: Scorer, threshold: float = 0.5) -> DataFrame:
    """The rows that :func:`classify` keeps, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(scorer)
    return kept_rows(docs, text_col, lambda texts: shared.value(Words.of(texts))[1] >= threshold)
