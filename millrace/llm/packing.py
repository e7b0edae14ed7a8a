"""Lexical retrieval packing: documents that share rare tokens go into the same training sequence.

Documents are tokenised where they are read. Whole windows are cut off first; they are sequences
already, with no room for a neighbour. What is left of each document is weighted by the frequency of
its tokens in the whole corpus, projected, and routed through a tree of two-means splits, so that
pieces with the same telling tokens stand side by side. Runs of pieces in this order are shards. A
shard is an inverted index of bounded size: its first unused piece is a seed, BM25 with corpus-wide
weights over the postings of all tokens of the seed ranks the unused others, and these fill the
seed's window greedily.

The neighbours of a seed are the best ones of its shard, not of the corpus: exact ones would compare
every seed with every piece, as each id of a tokenizer's bounded vocabulary stands in a fixed share of them.
"""

from __future__ import annotations

import json
import os
import re
import string
import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.chunks import give_back, plain, ranges, slices, word_codes
from millrace.plans.staging import stage

WINDOW = 2048
# Ids of a shard of the index, and windows of a partition.
SHARD_TOKENS = 1 << 19
PART_WINDOWS = 2048
K1, B = 1.2, 0.75
# Length of the vectors by which pieces are routed, rows of the tree's sample, and its rows in a leaf.
DIMENSIONS = 32
SAMPLE_ROWS = 20_000
LEAF_ROWS = 8
# Pieces whose tokens are projected together: their rows of the projection fit a core's cache.
ROWS_AT_ONCE = 64
# Text that is tokenised at once, and text whose distinct words are: they grow more slowly than texts.
TEXT_BYTES = 2 << 20
SHARED_BYTES = 32 << 20
PIECES_AT_ONCE = 1 << 15
LETTERS_AT_ONCE = 256
# Distinct pieces that a worker remembers from task to task, some 50 bytes each.
KNOWN_PIECES = 500_000
# A shard's postings are cut down when so much of its lists has been used since.
DROPPED_SHARE = 0.2
# ASCII marks that a tokenizer's pattern keeps together as one piece; the apostrophe opens suffixes.
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
# Letters that neither composing nor lower-casing changes, and steps that leave words of them whole.
LATIN = "a-zß-öø-ÿ"
NORMALIZERS = [{"type": "NFC"}, {"type": "Lowercase"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}]
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PRE_TOKENIZERS = [
    {"type": "Split", "pattern": {"Regex": SPLIT}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]

_encoders: dict[str, WordEncoder] = {}


@lru_cache(maxsize=None)  # bounded by the letters of Unicode
def ends_in_letter(last: str) -> bool:
    """Whether a piece that ends in this letter still does so after normalising and lower-casing."""
    return not last or unicodedata.category(unicodedata.normalize("NFC", last).lower()[-1])[0] == "L"


class WordEncoder:
    """Token ids of texts, computed once per distinct word.

    Right for tokenizers that drop white space and whose pieces never reach over it. A word of
    letters followed by marks is two pieces; every other word is encoded whole, also one whose last
    letter turns into a letter and a combining mark, which belongs to the marks after it. Where a
    tokenizer lowers letters, ASCII words are lowered before they are told apart. Up to ``most_known``
    pieces are kept for the next texts.
    """

    def __init__(self, path: str, most_known: int = 0) -> None:
        # A task is one thread; threads of the library's own would take other tasks' cores and memory.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.closing = np.zeros(max(vocabulary.values()) + 1, bool)
        if suffix:
            self.closing[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
        self.lowers = all(self.ids_of(c) == self.ids_of(c.lower()) for c in string.ascii_uppercase)
        self.spaced = self._spaced()
        self.most_known, self.known = most_known, pa.array([], pa.string())
        self.known_ids, self.known_starts, self.known_lengths = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _spaced(self) -> tuple | None:
        """The same model behind a split at spaces alone, for words of a-z and for those of ``LATIN``: both get
        the same ids if all other steps are known to leave such words as they are. None where they are not known."""
        from tokenizers import Tokenizer, pre_tokenizers

        def steps(part: object, name: str) -> list[dict]:
            told = json.loads(part.__getstate__()) if part is not None else {name: []}
            return told.get(name, [told])

        whole = self.tokenizer
        added = [t.content for t in whole.get_added_tokens_decoder().values()]
        if (
            not all(x in NORMALIZERS for x in steps(whole.normalizer, "normalizers"))
            or steps(whole.pre_tokenizer, "pretokenizers") != PRE_TOKENIZERS
            or any(re.fullmatch(r"[\w\s]*", t) for t in added)
            or whole.truncation
            or whole.padding
        ):
            return None
        ascii_only, latin = Tokenizer(whole.model), Tokenizer(whole.model)
        ascii_only.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        bytes_of = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        latin.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), bytes_of])
        return ascii_only, latin

    def ids_of(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _whole(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        lists = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        lengths = np.fromiter(map(len, lists), np.int64, len(lists))
        return np.fromiter((i for ids in lists for i in ids), np.int32, int(lengths.sum())), lengths

    def _letters(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Words of letters, encoded as texts of many: each is a piece that one closing token ends. Where
        a letter turns into more than a letter, the tokens don't add up, and the words are encoded one by one."""
        ids, lengths = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        for i in range(0, len(words), LETTERS_AT_ONCE):
            some = words[i : i + LETTERS_AT_ONCE]
            text, tokenizer = " ".join(some), self.tokenizer
            if self.spaced and re.fullmatch(f"[{LATIN} ]+", text):
                tokenizer = self.spaced[not text.isascii()]
            found = np.array(tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int32)
            ends = np.flatnonzero(self.closing[found])
            if len(ends) == len(some) and ends[-1] == len(found) - 1:
                ids.append(found)
                lengths.append(np.diff(ends, prepend=-1))
            else:
                for out, part in zip((ids, lengths), self._whole(some)):
                    out.append(part)
        return np.concatenate(ids), np.concatenate(lengths)

    def pieces(self, listed: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(ids, starts, lengths)`` of distinct pieces; known ones are looked up."""
        if not self.most_known:
            return self.encoded(listed)
        at = pc.index_in(listed, value_set=self.known)
        new, at = at.is_null().to_numpy(zero_copy_only=False), pc.fill_null(at, 0).to_numpy()
        others = plain(listed.filter(pa.array(new)))
        ids, starts, lengths = self.encoded(others)
        all_starts, all_lengths = np.zeros(len(listed), np.int64), np.zeros(len(listed), np.int64)
        all_starts[new], all_lengths[new] = len(self.known_ids) + starts, lengths
        all_starts[~new], all_lengths[~new] = self.known_starts[at[~new]], self.known_lengths[at[~new]]
        all_ids = np.concatenate([self.known_ids, ids])
        room = self.most_known - len(self.known)
        if room > 0 and len(others):
            self.known = pa.concat_arrays([self.known, others.slice(0, room)])
            starts, lengths = starts[:room], lengths[:room]
            self.known_starts = np.concatenate([self.known_starts, len(self.known_ids) + np.cumsum(lengths) - lengths])
            self.known_lengths = np.concatenate([self.known_lengths, lengths])
            self.known_ids = np.concatenate([self.known_ids, ids[ranges(starts, lengths)]])
        return all_ids, all_starts, all_lengths

    def encoded(self, listed: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(ids, starts, lengths)`` of distinct pieces, words of letters alike in their letters together."""
        simple = pc.utf8_is_alpha(listed).to_numpy(zero_copy_only=False)
        latin = pc.match_substring_regex(listed, f"^[{LATIN}]+$").to_numpy(zero_copy_only=False)
        narrow = latin & pc.string_is_ascii(listed).to_numpy(zero_copy_only=False)
        starts, lengths = np.zeros(len(listed), np.int64), np.zeros(len(listed), np.int64)
        found, total = [np.zeros(0, np.int32)], 0
        kinds = ((narrow, self._letters), (latin & ~narrow, self._letters), (simple & ~latin, self._letters), (~simple & ~latin, self._whole))
        for chosen, encode in kinds:
            at = np.flatnonzero(chosen)
            for i in range(0, len(at), PIECES_AT_ONCE):
                some = at[i : i + PIECES_AT_ONCE]
                ids, sizes = encode(listed.take(pa.array(some)).to_pylist())
                starts[some], lengths[some] = total + np.cumsum(sizes) - sizes, sizes
                total += len(ids)
                found.append(ids)
        return np.concatenate(found), starts, lengths

    def words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(ids, starts, lengths)`` of words without white space."""
        stems = pc.ascii_rtrim(words, MARKS)
        cut = pc.binary_length(stems).to_numpy(zero_copy_only=False)
        full = pc.binary_length(words).to_numpy(zero_copy_only=False)
        simple = pc.or_(pc.utf8_is_alpha(stems), pc.equal(pc.binary_length(stems), 0)).to_numpy(zero_copy_only=False)
        ends = plain(pc.dictionary_encode(pc.utf8_slice_codeunits(stems, -1)))
        safe = np.array([ends_in_letter(c) for c in ends.dictionary.to_pylist()], bool)
        simple &= safe[ends.indices.to_numpy()]
        has_stem, has_marks = simple & (cut > 0), simple & (full > cut)
        # The first piece of each word and, where marks follow, the second.
        tails = pc.replace_substring_regex(words.filter(pa.array(has_marks)), r"^\pL+", "")
        parts = pa.concat_arrays([plain(x) for x in (stems.filter(pa.array(has_stem)), tails, words.filter(pa.array(~simple)))])
        encoded = plain(pc.dictionary_encode(parts))
        number = encoded.indices.to_numpy()
        first, second = np.full(len(words), -1), np.full(len(words), -1)
        stop = int(has_stem.sum())
        first[has_stem], second[has_marks] = number[:stop], number[stop : stop + len(tails)]
        first[~simple] = number[stop + len(tails) :]
        listed = encoded.dictionary
        del stems, cut, full, ends, tails, parts, encoded, number  # encoding takes the most memory

        ids, starts, lengths = self.pieces(listed)
        lengths, starts = np.append(lengths, 0), np.append(starts, 0)  # number -1: no ids
        places = np.stack([first, second], 1).reshape(-1)
        counts = lengths[first] + lengths[second]
        word_ids = ids[ranges(starts[places], lengths[places])] if len(places) else np.zeros(0, np.int32)
        return word_ids, np.cumsum(counts) - counts, counts

    def slices(self, texts: Iterable[pa.Array], end_id: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """``(offsets, ids)`` of each array of texts, every text closed by ``end_id``; a word that
        stands in several arrays is encoded once."""
        coded, lists = [], []
        for some in texts:
            offsets, codes, words = word_codes(some)
            words = plain(words.cast(pa.string()))
            if self.lowers:
                words = pc.if_else(pc.string_is_ascii(words), pc.ascii_lower(words), words)
            coded.append((offsets, codes.astype(np.int32), len(words)))
            lists.append(plain(words))
        joined = pa.concat_arrays(lists)
        del words, lists
        shared = plain(pc.dictionary_encode(joined))
        del joined
        number, distinct = shared.indices.to_numpy(), plain(shared.dictionary)
        del shared
        ids, begins, counts = self.words(distinct)
        del distinct
        # One more word closes a text.
        ids, begins, counts = np.append(ids, end_id).astype(np.int32), np.append(begins, len(ids)), np.append(counts, 1)
        before = 0
        for offsets, codes, size in coded:
            closed = np.insert(number[before : before + size][codes], offsets[1:], len(counts) - 1)
            before += size
            sizes = counts[closed]
            upto = np.concatenate([[0], np.cumsum(sizes)])[offsets + np.arange(len(offsets))]
            yield upto, ids[ranges(begins[closed], sizes)] if len(closed) else np.zeros(0, np.int32)

    def __call__(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """``(offsets, ids)`` of all texts, each closed by ``end_id``."""
        return next(self.slices([texts], end_id))


def _encoder(path: str, most_known: int = 0) -> WordEncoder:
    if path not in _encoders or _encoders[path].most_known != most_known:
        _encoders[path] = WordEncoder(path, most_known)
    return _encoders[path]


def _forget() -> None:
    """Workers outlive their tasks; the vocabulary is read again in a fraction of a second. Tasks call
    this by name, as their own globals are copies."""
    if _encoders:
        _encoders.clear()
        give_back()


def token_pieces(
    docs: DataFrame,
    id_col: str,
    text_col: str,
    tokenizer_path: str,
    window: int = WINDOW,
    end_id: int = 1,
    shared_bytes: int = SHARED_BYTES,
    known_pieces: int = 0,
) -> DataFrame:
    """Each document's ids, cut into whole windows and one shorter rest.

    The distinct words of ``shared_bytes`` of text are encoded together: fewer take less memory and more time.
    So do fewer ``known_pieces``, pieces of words that a worker keeps for its next task.

    Columns ``doc_id, start, length, doc_tokens, ids`` (little-endian unsigned 32-bit), ``place``,
    a number that spreads pieces evenly whatever their ids and texts are, and ``counts``, see ``_counted``.
    """
    numbered = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("place"))

    def shared(batches: Iterator[pa.RecordBatch], encoder: WordEncoder) -> Iterator[tuple[pa.Table, tuple[np.ndarray, np.ndarray]]]:
        for large in slices(batches, most=shared_bytes):
            tables = [*slices(iter(large.to_batches()), most=TEXT_BYTES)]
            yield from zip(tables, encoder.slices((plain(t["text"]) for t in tables), end_id))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer_path, known_pieces)
        yield from _counted(pieces_of(batches, encoder), max(len(encoder.closing), end_id + 1), window)
        del encoder
        if known_pieces:
            give_back()
        else:
            _forget()

    def pieces_of(batches: Iterator[pa.RecordBatch], encoder: WordEncoder) -> Iterator[pa.RecordBatch]:
        for table, (offsets, ids) in shared(batches, encoder):
            lengths = np.diff(offsets)
            pieces = -(-lengths // window)
            row = np.repeat(np.arange(len(lengths)), pieces)
            start = window * ranges(np.zeros(len(pieces), np.int64), pieces)
            length = np.minimum(window, lengths[row] - start)
            data = pa.py_buffer(ids.astype("<u4").tobytes())
            bounds = np.append(4 * (offsets[row] + start), 4 * len(ids)).astype(np.int64)
            binary = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(row), [None, pa.py_buffer(bounds.tobytes()), data])
            place = plain(table["place"]).to_numpy()[row]
            yield pa.RecordBatch.from_arrays(
                [plain(table["doc_id"]).take(pa.array(row)), pa.array(start), pa.array(length), pa.array(lengths[row]), binary.cast(pa.binary()), pa.array(place)],
                names=["doc_id", "start", "length", "doc_tokens", "ids", "place"],
            )

    kind = dict(numbered.dtypes)["doc_id"]
    return numbered.mapInArrow(cut, f"doc_id {kind}, start long, length long, doc_tokens long, ids binary, place long, counts binary")


def _token_counts(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``(row, token, tf)`` of the pieces of a batch, some hundred rows at a time; every row has one at least."""
    data = plain(batch.column(batch.schema.get_field_index("ids")).cast(pa.large_binary()))
    offsets = np.frombuffer(data.buffers()[1], np.int64, len(data) + 1) // 4
    ids = np.frombuffer(data.buffers()[2], "<u4", offsets[-1])
    for start in range(0, len(data), ROWS_AT_ONCE):
        bounds = offsets[start : start + ROWS_AT_ONCE + 1]
        row = np.repeat(np.arange(len(bounds) - 1, dtype=np.uint64), np.diff(bounds))
        keys = np.sort((row << np.uint64(32)) | ids[bounds[0] : bounds[-1]])
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        tf = np.diff(np.append(first, len(keys)))
        yield (keys[first] >> np.uint64(32)).astype(np.int64), (keys[first] & np.uint64(0xFFFFFFFF)).astype(np.int64), tf


def _counted(batches: Iterator[pa.RecordBatch], size: int, window: int) -> Iterator[pa.RecordBatch]:
    """The batches of a task with a column ``counts``, null but in one row: pairs of a slot and its number, as
    64-bit integers. Slots below ``size`` are ids and count the pieces shorter than ``window`` that hold them; the
    next two are the number of these pieces and of their ids."""
    totals, held = np.zeros(size + 2, np.int64), None

    def with_counts(batch: pa.RecordBatch, counts: list[bytes]) -> pa.RecordBatch:
        column = pa.array(counts + [None] * (batch.num_rows - len(counts)), pa.binary())
        return pa.RecordBatch.from_arrays([*batch.columns, column], names=[*batch.schema.names, "counts"])

    for batch in batches:
        rests = batch.filter(pc.less(batch.column("length"), window))
        for row, token, tf in _token_counts(rests) if rests.num_rows else ():
            totals[:size] += np.bincount(token, minlength=size)
            totals[size:] += row[-1] + 1, tf.sum()
        if held is not None:
            yield with_counts(held, [])
        held = batch
    if held is not None:
        at = np.flatnonzero(totals)
        yield with_counts(held, [np.stack([at, totals[at]], 1).tobytes()])


@dataclass
class Statistics:
    """Corpus-wide BM25 statistics: ``idf`` of every id, mean length and number of pieces."""

    idf: np.ndarray
    mean: float
    pieces: int


def statistics(pieces: DataFrame, size: int) -> Statistics:
    """Add up the ``counts`` of tasks; a task hands on one row per id below ``size`` at most."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _forget()
        totals = np.zeros(size + 2, np.int64)
        for batch in batches:
            for counts in batch.column(0).to_pylist():
                at, n = np.frombuffer(counts, np.int64).reshape(-1, 2).T
                totals[at] += n
        at = np.flatnonzero(totals)
        yield pa.RecordBatch.from_pydict({"slot": pa.array(at), "n": pa.array(totals[at])})

    rows = pieces.select("counts").filter("counts is not null").mapInArrow(summed, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    totals = np.zeros(size + 2, np.int64)
    totals[rows["slot"].to_numpy()] = rows["n"].to_numpy()
    df, pieces, tokens = totals[:size], int(totals[size]), int(totals[size + 1])
    return Statistics(np.log1p((pieces - df + 0.5) / (df + 0.5)), tokens / max(pieces, 1), pieces)


def _direction(points: np.ndarray) -> np.ndarray:
    """About the direction in which points differ most."""
    centred = points - points.mean(0)
    along = centred[np.argmax((centred**2).sum(1))]
    for _ in range(8):
        along = centred.T @ (centred @ along)
        along = along / max(np.sqrt((along**2).sum()), 1e-30)
    return along


@dataclass
class Tree:
    """Splits ``normal, threshold`` with two ``children`` each (``~leaf`` for a leaf); leaves are
    numbered from left to right, and within one ``along`` gives the order."""

    normal: np.ndarray
    threshold: np.ndarray
    children: np.ndarray
    along: np.ndarray

    def keys(self, points: np.ndarray, tie: np.ndarray) -> np.ndarray:
        """Places in the tree's order: leaf, place in the leaf, and 32 bits of ``tie``."""
        at = np.zeros(len(points), np.int64)
        while (inner := np.flatnonzero(at >= 0)).size:
            node = at[inner]
            high = (points[inner] * self.normal[node]).sum(1) > self.threshold[node]
            at[inner] = self.children[node, high.astype(np.int64)]
        fine = np.clip(((points * self.along[~at]).sum(1) + 1) * 32768, 0, 65535).astype(np.int64)
        return (~at << 48) | (fine << 32) | (tie & 0xFFFFFFFF)


def tree(points: np.ndarray, leaf_rows: int = LEAF_ROWS) -> Tree:
    """Two-means splits of a sample down to leaves of ``leaf_rows`` points, or of equal ones."""
    normal, threshold, children, along = [np.zeros(DIMENSIONS)], [0.0], [[0, 0]], []
    waiting = [(np.arange(len(points)), 0, 0), (np.arange(0), 0, 1)][::-1]
    while waiting:
        rows, parent, side = waiting.pop()
        here, split = points[rows], None
        if len(rows) > leaf_rows:
            across = _direction(here)
            cut = float((here @ across).mean())
            for _ in range(4):
                high = here @ across > cut
                if not 0 < high.sum() < len(rows):
                    break
                a, b = here[~high].mean(0), here[high].mean(0)
                across, cut = b - a, float((b - a) @ (a + b) / 2)
            high = (here * across).sum(1) > cut
            if not 0.05 < high.mean() < 0.95:
                values = (here * across).sum(1)
                cut = float(np.median(values))
                high = values > cut
            split = high if 0 < high.sum() < len(rows) else None
        if split is None:
            children[parent][side] = ~len(along)
            along.append(_direction(here) if len(here) > 1 else np.zeros(DIMENSIONS))
            continue
        children[parent][side] = len(normal)
        waiting += [(rows[split], len(normal), 1), (rows[~split], len(normal), 0)]
        normal.append(across)
        threshold.append(cut)
        children.append([0, 0])
    return Tree(np.array(normal), np.array(threshold), np.array(children), np.array(along))


def _vectors(batch: pa.RecordBatch, idf: np.ndarray, projection: np.ndarray) -> np.ndarray:
    """A unit vector for each piece: its tokens' BM25 weights, projected."""
    out = [np.zeros((0, projection.shape[1]))]
    for row, token, tf in _token_counts(batch):
        weight = (idf[token] * tf / (tf + K1)).astype(np.float32)
        sums = np.add.reduceat(projection[token] * weight[:, None], np.flatnonzero(np.diff(row, prepend=-1)), 0).astype(np.float64)
        out.append(sums / np.maximum(np.sqrt((sums**2).sum(1, keepdims=True)), 1e-30))
    return np.concatenate(out)


def _tie(place: np.ndarray, start: np.ndarray) -> np.ndarray:
    mixed = place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + start.astype(np.uint64)
    mixed = (mixed ^ (mixed >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return (mixed >> np.uint64(32)).astype(np.int64)


def routed(rests: DataFrame, found: Statistics, parts: int) -> DataFrame:
    """The pieces in ``parts`` partitions, similar ones side by side in each.

    Partitions hold about equal numbers of pieces: equal ones are told apart by their places. The
    driver holds vectors of about ``SAMPLE_ROWS`` pieces.
    """
    projection = np.random.default_rng(7).standard_normal((len(found.idf), DIMENSIONS)).astype(np.float32)
    context = rests.sparkSession.sparkContext
    known = context.broadcast((found.idf, projection))

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _forget()
        for batch in batches:
            if batch.num_rows:
                vectors = _vectors(batch, *known.value)
                tie = _tie(batch.column("place").to_numpy(), batch.column("start").to_numpy())
                yield pa.RecordBatch.from_pydict({"tie": pa.array(tie), "vector": pa.array([v.tobytes() for v in vectors], pa.binary())})

    chance = F.pmod(F.xxhash64("place", "start", F.lit(11)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = rests.filter(chance < SAMPLE_ROWS / max(found.pieces, 1)).select("place", "start", "ids").mapInArrow(sampled, "tie long, vector binary").orderBy("tie").toArrow()
    points = np.frombuffer(b"".join(sample["vector"].to_pylist()), np.float64).reshape(-1, DIMENSIONS)
    order = tree(points)
    keys = np.sort(order.keys(points, sample["tie"].to_numpy()))
    bounds = keys[np.arange(1, parts) * len(keys) // parts] if len(keys) else np.zeros(0, np.int64)
    routes = context.broadcast((order, bounds))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _forget()
        for batch in batches:
            if batch.num_rows:
                order, bounds = routes.value
                at = order.keys(_vectors(batch, *known.value), _tie(batch.column("place").to_numpy(), batch.column("start").to_numpy()))
                part = np.searchsorted(bounds, at, side="right").astype(np.int32)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at), pa.array(part)], names=[*batch.schema.names, "dealt", "part"])

    kind = dict(rests.dtypes)["doc_id"]
    rows = rests.mapInArrow(dealt, f"doc_id {kind}, start long, length long, doc_tokens long, ids binary, place long, dealt long, part int")
    return rows.repartitionById(parts, "part").drop("part").sortWithinPartitions("dealt", "place", "start").drop("dealt", "place")


class Shard:
    """An inverted index of at most some thousand token lists, and which of their tokens are unused.
    Weights are those of the corpus, or of the lists themselves if none are given."""

    def __init__(self, lists: list[np.ndarray], known: Statistics | None = None) -> None:
        self.left = np.array([len(x) for x in lists], np.int64)
        self.used = np.zeros(len(lists), np.int64)
        token = np.concatenate(lists).astype(np.uint64)
        place = np.repeat(np.arange(len(lists), dtype=np.uint64), self.left)
        keys = np.sort((token << np.uint64(24)) | place)
        new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        tf, keys = np.diff(new, append=len(keys)), keys[new]
        self.place = (keys & np.uint64(0xFFFFFF)).astype(np.int64)
        token = keys >> np.uint64(24)
        first = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        self.tokens, self.first = token[first], np.append(first, len(keys))
        df = np.diff(self.first)
        self.alive = len(lists)
        idf = known.idf[self.tokens.astype(np.int64)] if known else np.log1p((len(lists) - df + 0.5) / (df + 0.5))
        norm = K1 * (1 - B + B * self.left / (known.mean if known else self.left.mean()))
        self.weight = np.repeat(idf, df) * tf * (K1 + 1) / (tf + norm[self.place])
        # The tokens of each list, the most telling first.
        slot = np.repeat(np.arange(len(self.tokens)), df)
        order = np.argsort(-self.weight, kind="stable")  # slots rise already
        # Small numbers are sorted digit by digit.
        small = self.place.astype(np.uint16) if len(lists) <= 1 << 16 else self.place
        order = order[np.argsort(small[order], kind="stable")]
        self.of_list, self.list_first = slot[order], np.searchsorted(self.place[order], np.arange(len(lists) + 1))

    def ranked(self, seed: int, query_tokens: int | None) -> np.ndarray:
        """The unused lists by falling BM25 score for the seed's tokens (None: all of them), ties in order."""
        unused = np.flatnonzero(self.left)
        if len(unused) < (1 - DROPPED_SHARE) * self.alive:
            self._drop_used(len(unused))
        slots = self.of_list[self.list_first[seed] : self.list_first[seed + 1]][:query_tokens]
        hits = ranges(self.first[slots], self.first[slots + 1] - self.first[slots])
        scores = np.bincount(self.place[hits], self.weight[hits], len(self.left))
        return unused[np.argsort(-scores[unused], kind="stable")]

    def _drop_used(self, alive: int) -> None:
        """Postings of used lists go; those of the others keep their order, so scores stay the same."""
        kept = self.left[self.place] > 0
        self.first = np.concatenate([[0], np.cumsum(kept)])[self.first]
        self.place, self.weight, self.alive = self.place[kept], self.weight[kept], alive


def fill_windows(
    lists: list[np.ndarray], window: int, query_tokens: int | None = None, known: Statistics | None = None, last: bool = True
) -> Iterator[list[tuple[int, int, int]]]:
    """Sequences of ``(list, start, length)``. The best unused neighbour that fits goes in whole; if
    none fits, the best one is cut and its rest stays unused. Only the last sequence can be short;
    unless this is the ``last`` shard, what would make up that one stays unused."""
    shard = Shard(lists, known)
    left, used = shard.left, shard.used
    total = int(left.sum())
    for seed in range(len(lists)):
        while left[seed]:
            if total < window and not last:
                return
            taken, lengths = [np.array([seed])], [np.array([min(window, left[seed])])]
            room = window - int(lengths[0][0])
            if room:
                order = shard.ranked(seed, query_tokens)
                order, skipped = order[order != seed], None
                while room:
                    ends = np.cumsum(left[order])
                    whole = int(np.searchsorted(ends, room, side="right"))
                    if whole:
                        taken.append(order[:whole])
                        lengths.append(left[order[:whole]])
                        room -= int(ends[whole - 1])
                        order = order[whole:]
                    elif len(order):
                        # What doesn't fit now never will; the best of it is cut if nothing else fits.
                        skipped = order[0] if skipped is None else skipped
                        order = order[left[order] <= room]
                    elif skipped is not None:
                        taken.append(np.array([skipped]))
                        lengths.append(np.array([room]))
                        room = 0
                    else:
                        break
            chosen, sizes = np.concatenate(taken), np.concatenate(lengths)
            sequence = list(zip(chosen.tolist(), used[chosen].tolist(), sizes.tolist()))
            used[chosen] += sizes
            left[chosen] -= sizes
            total -= window - room
            yield sequence


class _Pieces:
    """Pieces of a partition, as columns: where they come from and their ids one after the other."""

    def __init__(self, parts: list[pa.RecordBatch]) -> None:
        table = pa.Table.from_batches(parts)
        self.doc_id = plain(table["doc_id"])
        self.start, self.doc_tokens = (plain(table[c]).to_numpy() for c in ("start", "doc_tokens"))
        data = plain(plain(table["ids"]).cast(pa.large_binary()))
        self.offsets = np.frombuffer(data.buffers()[1], np.int64, len(data) + 1) // 4
        self.ids = np.frombuffer(data.buffers()[2] or b"", "<u4", self.offsets[-1])

    def lists(self) -> list[np.ndarray]:
        return [self.ids[a:b] for a, b in zip(self.offsets[:-1].tolist(), self.offsets[1:].tolist())]

    def cut(self, row: np.ndarray, at: np.ndarray, length: np.ndarray, **more: np.ndarray) -> pa.RecordBatch:
        """Parts ``at`` to ``at + length`` of the given pieces, with more columns."""
        bounds = np.concatenate([[0], 4 * np.cumsum(length)]).astype(np.int64)
        data = self.ids[ranges(self.offsets[:-1][row] + at, length)].astype("<u4")
        ids = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(row), [None, pa.py_buffer(bounds.tobytes()), pa.py_buffer(data.tobytes())])
        columns = {"doc_id": self.doc_id.take(pa.array(row)), "start": self.start[row] + at, "length": length, "doc_tokens": self.doc_tokens[row], **more}
        return pa.RecordBatch.from_arrays([*[pa.array(c) for c in columns.values()], ids.cast(pa.binary())], names=[*columns, "ids"])


def pack(
    docs: DataFrame,
    id_col: str,
    text_col: str,
    tokenizer_path: str,
    window: int = WINDOW,
    shard_tokens: int = SHARD_TOKENS,
    query_tokens: int | None = None,
    end_id: int = 1,
    shared_bytes: int = SHARED_BYTES,
    known_pieces: int = KNOWN_PIECES,
) -> DataFrame:
    """Pack all documents into sequences of ``window`` tokens.

    One row per piece: ``doc_id, start, length, doc_tokens, sequence_id, offset, ids``. Each id of a
    document, the end id included, lies in exactly one piece, and pieces fill a sequence gaplessly
    from offset 0. Only the last sequence of a partition can be shorter than the window, and there
    is a partition for each ``PART_WINDOWS`` windows of ids, however short the documents are.

    Pieces go to partitions of about equal size in the order of a tree over the whole corpus, so
    neither equal ids nor copies gather in a task; a partition is packed in shards of ``shard_tokens``
    ids, in bounded memory; what a shard leaves of a window goes into the next, and a lost task packs the same sequences again. Null texts count as empty (one piece, the
    end id); equal rows are documents of their own; null ids are kept; an empty table gives no rows;
    other columns are ignored. Equal scores take the earlier list. A seed is looked up by all its
    tokens, or the ``query_tokens`` of highest weight; lists without any of them come last and are not lost.
    """
    pieces = stage(token_pieces(docs, id_col, text_col, tokenizer_path, window, end_id, shared_bytes, known_pieces), "packing-pieces")
    found = statistics(pieces, max(end_id + 1, len(_encoder(tokenizer_path).closing)))
    rests = pieces.filter(F.col("length") < window).drop("counts")
    shared = docs.sparkSession.sparkContext.broadcast(found)
    rows = routed(rests, found, max(1, round(found.pieces * found.mean / (PART_WINDOWS * window))))
    most = min(shard_tokens, 1 << 30)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _forget()
        sequence_id = TaskContext.get().partitionId() << 32
        waiting: list[pa.RecordBatch] = []
        tokens = 0

        def shard(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal sequence_id, waiting, tokens
            pieces = _Pieces(waiting)
            used = np.zeros(len(pieces.start), np.int64)
            sequences = list(fill_windows(pieces.lists(), window, query_tokens, shared.value, last))
            sizes = np.array([len(x) for x in sequences], np.int64)
            if len(sizes):
                row, at, length = np.array([piece for x in sequences for piece in x], np.int64).T
                np.add.at(used, row, length)
                first = np.cumsum(sizes) - sizes
                before = np.cumsum(length) - length
                offset = before - np.repeat(before[first], sizes)
                yield pieces.cut(row, at, length, sequence_id=sequence_id + np.repeat(np.arange(len(sizes)), sizes), offset=offset)
            sequence_id += len(sizes)
            left = np.diff(pieces.offsets) - used
            rest = np.flatnonzero(left)
            waiting, tokens = ([pieces.cut(rest, used[rest], left[rest])] if len(rest) else []), int(left.sum())

        for batch in batches:
            ends = np.cumsum(batch.column(batch.schema.get_field_index("length")).to_numpy())
            start = 0
            while start < batch.num_rows:
                room = (ends[start - 1] if start else 0) + most - tokens
                stop = max(start + 1, int(np.searchsorted(ends, room, side="right")))
                waiting.append(batch.slice(start, stop - start).select(PIECES))
                tokens += int(ends[stop - 1] - (ends[start - 1] if start else 0))
                start = stop
                if tokens >= most or (start < batch.num_rows and tokens + ends[start] - ends[start - 1] > most):
                    yield from shard(False)
        if waiting:
            yield from shard(True)

    kind = dict(docs.dtypes)[id_col]
    filled = rows.mapInArrow(packed, f"doc_id {kind}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")
    # Whole windows are sequences where they are; their numbers lie above those of all partitions.
    number = (F.monotonically_increasing_id() + F.lit(1 << 62)).alias("sequence_id")
    whole = pieces.filter(F.col("length") == window)
    return filled.union(whole.select("doc_id", "start", "length", "doc_tokens", number, F.lit(0).cast("long").alias("offset"), "ids"))


PIECES = ["doc_id", "start", "length", "doc_tokens", "ids"]


def with_checksums(pieces: DataFrame, keep_ids: bool = False) -> DataFrame:
    """Add ``ids_crc32``, by default in place of ``ids``."""
    summed = pieces.withColumn("ids_crc32", F.crc32("ids"))
    return summed if keep_ids else summed.drop("ids")
