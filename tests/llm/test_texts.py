"""Packing, near-duplicates, language, quality, mixing and the pipeline on odd rows and against brute force."""

import itertools
import re
import unicodedata
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer, normalizers

import corpus_pipeline
from millrace.llm import chunks, components, language, mixing, packing, quality, simhash
from tests.conftest import DATA
from tests.llm import odd

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


# --- packing --------------------------------------------------------------------------------------


def test_word_encoder_equals_the_tokenizer():
    texts = [t or "" for _, t, _, _ in odd.TEXTS] + ["don't STOP... naïve—test 3.14 a,b;c 'quoted' x'll", "T̈ ẗ ½ 中文字 mixed中文"]
    encoder = packing.WordEncoder(TOKENIZER)
    tokenizer = Tokenizer.from_file(TOKENIZER)
    for _ in range(2):  # the second time from the memo
        offsets, ids = encoder(pa.array(texts), 1)
        for i, text in enumerate(texts):
            assert ids[offsets[i] : offsets[i + 1]].tolist() == tokenizer.encode(text, add_special_tokens=False).ids + [1]


def test_words_whose_last_letter_becomes_a_letter_and_a_mark():
    texts = ["BELEDİYESİ, İ! Aİ", "\u0924\u0930\u095e, \u0924\u0930\u095e \u0938\u093e\u095d.", "\ufb2a, \ufb2a\ufb2b; \ufb2ax.", "plain, BELEDİYE. İİ,", "naïve, ΑΣ. é"]
    encoder = packing.WordEncoder(TOKENIZER)
    tokenizer = Tokenizer.from_file(TOKENIZER)
    offsets, ids = encoder(pa.array(texts), 1)
    for i, text in enumerate(texts):
        assert ids[offsets[i] : offsets[i + 1]].tolist() == tokenizer.encode(text, add_special_tokens=False).ids + [1]
    letters = [chr(c) for c in range(0x80, 0x110000) if unicodedata.category(chr(c))[0] == "L"]
    words = [f"{c}," for c in letters]
    offsets, ids = encoder(pa.array(words), 1)
    wanted = [e.ids + [1] for e in tokenizer.encode_batch_fast(words, add_special_tokens=False)]
    assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == wanted


def test_a_word_of_several_slices_is_encoded_once(monkeypatch):
    encoder = packing.WordEncoder(TOKENIZER)
    tokenizer = Tokenizer.from_file(TOKENIZER)
    texts = [["one Two, two", "H\u0331 h\u0331"], ["TWO one! x1"], [], ["Σας one\n"]]
    asked, letters = [], packing.WordEncoder._letters
    monkeypatch.setattr(packing.WordEncoder, "_letters", lambda self, words: asked.extend(words) or letters(self, words))
    for some, (offsets, ids) in zip(texts, encoder.slices([pa.array(t, pa.string()) for t in texts], 1), strict=True):
        assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == [tokenizer.encode(t, add_special_tokens=False).ids + [1] for t in some]
    assert sorted(asked) == ["one", "two", "Σας"]


def test_known_words_are_not_encoded_again(monkeypatch):
    encoder = packing.WordEncoder(TOKENIZER, most_known=3)
    tokenizer = Tokenizer.from_file(TOKENIZER)
    asked, letters = [], packing.WordEncoder._letters
    monkeypatch.setattr(packing.WordEncoder, "_letters", lambda self, words: asked.append(words) or letters(self, words))
    for text, new in (("one Two", ["one", "two"]), ("two été three one", ["three", "été"]), ("three été one\u0301 two, été", ["three"]), ("", [])):
        asked.clear()
        _, ids = encoder(pa.array([text]), 1)
        assert ids.tolist() == tokenizer.encode(text, add_special_tokens=False).ids + [1]
        assert sorted(w for words in asked for w in words) == new


def test_plain_letters_need_no_pattern(tmp_path):
    encoder, tokenizer = packing.WordEncoder(TOKENIZER), Tokenizer.from_file(TOKENIZER)
    letters = [chr(c) for c in range(0x61, 0x100) if chr(c).isalpha() and chr(c).islower() and chr(c) not in "ªµº"]
    for words in (["".join(w) for w in itertools.product(letters[:26], repeat=2)], [a + b + "n" for a in letters[26:] for b in letters]):
        wanted = [e.ids for e in tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        encoder.tokenizer = None  # the whole one is not asked
        ids, lengths = encoder._letters(words)
        assert ids.tolist() == [i for x in wanted for i in x] and lengths.tolist() == [len(x) for x in wanted]
    for change in ("normalizer", "added"):
        other = Tokenizer.from_file(TOKENIZER)
        if change == "normalizer":
            other.normalizer = normalizers.Sequence([normalizers.NFD(), normalizers.StripAccents(), normalizers.Lowercase()])
        else:
            other.add_tokens(["nna"])
        other.save(str(tmp_path / "other.json"))
        encoder = packing.WordEncoder(str(tmp_path / "other.json"))
        texts = ["été anna nna", "Éa, nö"]
        offsets, ids = encoder(pa.array(texts), 1)
        if change == "normalizer":
            assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == [other.encode(t, add_special_tokens=False).ids + [1] for t in texts]
        assert encoder.spaced is None


def test_statistics_come_with_the_pieces(spark):
    docs = spark.createDataFrame([(i, "one, two three " * (i % 7) + f"w{i}") for i in range(50)] + [(50, None)], "id long, text string").repartition(3)
    pieces = packing.token_pieces(docs, "id", "text", TOKENIZER, window=20).cache()
    found = packing.statistics(pieces.drop("ids"), 49408)
    rests = [np.frombuffer(r.ids, "<u4") for r in pieces.collect() if r.length < 20]
    df = np.bincount(np.concatenate([np.unique(x) for x in rests]), minlength=49408)
    assert 0 < len(rests) < pieces.count() and found.pieces == len(rests) and found.mean == sum(map(len, rests)) / len(rests)
    assert np.array_equal(found.idf, np.log1p((len(rests) - df + 0.5) / (df + 0.5)))
    assert packing.statistics(packing.token_pieces(docs.limit(0), "id", "text", TOKENIZER), 49408).pieces == 0


def test_used_lists_leave_the_postings():
    draw = np.random.default_rng(4)
    lists = [draw.integers(0, 50, 30) for _ in range(40)]
    whole, shard = packing.Shard(lists), packing.Shard(lists)
    wanted = [i for i in whole.ranked(0, None).tolist() if i < 20]
    shard.left[20:] = 0
    assert shard.ranked(0, None).tolist() == wanted and shard.place.max() < 20 and len(shard.place) < 0.6 * len(whole.place)


def check_packed(docs, rows, window):
    tokenizer = Tokenizer.from_file(TOKENIZER)
    wanted = defaultdict(list)
    for doc_id, text in docs:
        wanted[doc_id].append(np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [1], "<u4"))
    got, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        assert r.ids_crc32 == zlib.crc32(bytes(r.ids))
        got[r.doc_id].append((r.start, r.length, bytes(r.ids), r.doc_tokens))
        sequences[r.sequence_id].append((r.offset, r.length))
    assert sorted(got, key=str) == sorted(wanted, key=str)
    for doc_id, lists in wanted.items():
        assert sum(p[1] for p in got[doc_id]) == sum(map(len, lists))
        if len(lists) == 1:
            pieces = sorted(got[doc_id])
            assert b"".join(p[2] for p in pieces) == lists[0].tobytes()
            assert [p[0] for p in pieces] == [sum(q[1] for q in pieces[:i]) for i in range(len(pieces))]
            assert {p[3] for p in pieces} == {len(lists[0])}
    for pieces in sequences.values():
        pieces.sort()
        assert [p[0] for p in pieces] == [sum(q[1] for q in pieces[:i]) for i in range(len(pieces))]
        assert sum(p[1] for p in pieces) <= window
    return len(sequences)


def test_packing_keeps_every_token(spark):
    rows = packing.with_checksums(packing.pack(odd.documents(spark), "id", "body", TOKENIZER, window=64, shard_tokens=300), keep_ids=True).collect()
    check_packed([(i, t) for i, t, _, _ in odd.TEXTS], rows, 64)
    assert packing.pack(odd.documents(spark, empty=True), "id", "body", TOKENIZER).count() == 0


def test_packing_pads_little_and_puts_related_documents_together(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = packing.with_checksums(packing.pack(docs, "doc_id", "text", TOKENIZER), keep_ids=True).collect()
    n = check_packed([(r.doc_id, r.text) for r in docs.collect()], rows, 2048)
    assert sum(r.length for r in rows) > 0.9 * 2048 * n
    topics = [np.arange(t * 100, t * 100 + 100) for t in range(2)]
    lists = [np.random.default_rng(i).choice(topics[i % 2], 60) for i in range(40)]
    for sequence in packing.fill_windows(lists, 300, 48):
        assert len({i % 2 for i, _, _ in sequence[:4]}) == 1 or len(sequence) < 5


def test_short_documents_leave_little_padding(spark):
    docs = spark.range(20_000).select(F.col("id"), F.lit("two words").alias("body"))
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        rows = packing.pack(docs, "id", "body", TOKENIZER, shard_tokens=10_000).groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sum(r.n for r in rows) == 60_000 and 60_000 > 0.97 * 2048 * len(rows)


def test_greedy_filling_equals_one_by_one():
    """The vectorised filling takes what a plain loop over the ranked lists takes."""
    draw = np.random.default_rng(2)
    lists = [draw.integers(0, 200, draw.integers(1, 90)).astype("<u4") for _ in range(300)]
    for last in (True, False):
        shard = packing.Shard(lists)
        wanted = []
        for seed in range(len(lists)):
            while shard.left[seed]:
                if shard.left.sum() < 128 and not last:
                    break
                room, sequence, take = 128, [], seed
                order = [i for i in shard.ranked(seed, None).tolist() if i != seed]
                while True:
                    n = min(room, int(shard.left[take]))
                    sequence.append((take, int(shard.used[take]), n))
                    shard.used[take] += n
                    shard.left[take] -= n
                    room -= n
                    order = [i for i in order if shard.left[i] and i != take]
                    if not room or not order:
                        break
                    take = next((i for i in order if shard.left[i] <= room), order[0])
                wanted.append(sequence)
        assert list(packing.fill_windows(lists, 128, last=last)) == wanted


def test_related_documents_meet_from_all_over_the_corpus(spark):
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 9)) for _ in range(60 * 12)]
    common = "the of and to in is that it was for on as with his they at be this have from".split()
    texts = []
    for i in range(1200):
        own = words[i % 60 * 12 : i % 60 * 12 + 12]
        texts.append((i, " ".join(rng.permutation([*rng.choice(own, 12), *rng.choice(common, 40)]).tolist())))
    docs = spark.createDataFrame(texts, "id long, body string").repartition(8)
    rows = packing.with_checksums(packing.pack(docs, "id", "body", TOKENIZER, window=512, shard_tokens=2000), keep_ids=True).collect()
    check_packed(texts, rows, 512)
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append(r.doc_id % 60)
    pairs = [(a, b) for topics in sequences.values() for n, a in enumerate(topics) for b in topics[:n]]
    # Dealt at random to 60 shards of 20, hardly any two of a topic meet; a topic fills three windows and a half.
    assert sum(a == b for a, b in pairs) > 0.5 * len(pairs)


# --- near-duplicates ------------------------------------------------------------------------------


def brute_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    parent = {i: i for i in prints}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(prints)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= 2 and root(a) != root(b):
                low, high = sorted((root(a), root(b)))
                parent[high] = low
    return {i: root(i) for i in ids}


@pytest.mark.parametrize("crowd", [1, 256])
def test_near_duplicates_equal_brute_force(spark, crowd):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    base = "one two three four five six seven eight nine ten eleven twelve"
    copies = {1000 + i: base + f" x{i}" for i in range(60)} | {2000: None, 2001: "", 2002: base.upper()}
    docs = docs.select("doc_id", "text").union(spark.createDataFrame(list(copies.items()), "doc_id long, text string"))
    texts |= copies
    prints = {i: brute_fingerprint(t) for i, t in texts.items()}
    wanted = brute_components(prints)
    rows = simhash.near_duplicates(docs, "doc_id", "text", crowd=crowd).collect()
    assert {r.doc_id: r.fingerprint for r in rows} == {i: f"{p:016x}" for i, p in prints.items()}
    assert {r.doc_id: r.component_id for r in rows} == wanted
    assert len(rows) == len(texts)


def test_links_find_all_pairs_within_two_bits(spark):
    rng = np.random.default_rng(3)
    base = [int(x) for x in rng.integers(0, 1 << 63, 30)]
    prints = {b ^ (1 << int(i)) ^ (1 << int(j)) for b in base for i, j in rng.integers(0, 64, (6, 2))} | set(base)
    signed = [simhash._signed(p) for p in prints]
    wanted = {tuple(sorted((a, b))) for a in signed for b in signed if a != b and ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 2}
    got = simhash.links(spark.createDataFrame([(s,) for s in signed], "fp long"), 2).collect()
    assert {tuple(sorted((r.a, r.b))) for r in got} == wanted


def test_near_duplicates_of_odd_rows(spark):
    rows = simhash.near_duplicates(odd.documents(spark), "id", "body").collect()
    assert len(rows) == len(odd.TEXTS)
    by_id = {r.doc_id: r for r in rows}
    assert {by_id[i].component_id for i in (1, 2)} == {1} and {by_id[i].component_id for i in (3, 4, 5)} == {3}
    assert by_id[None].component_id is None and by_id[3].fingerprint == "0" * 16
    assert simhash.near_duplicates(odd.documents(spark, empty=True), "id", "body").count() == 0
    kept = simhash.representatives(odd.documents(spark), "id", "body")
    assert kept.columns == odd.documents(spark).columns
    assert sorted(r.id for r in kept.collect() if r.id is not None) == [1, 3, 6, 7, 8, 9, 10]


def test_components_of_chains_stars_and_nothing(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (None, 3), (200, 201), (201, 200)]
    rows = components.components(spark.createDataFrame(chain, "a long, b long"), "a", "b").collect()
    got = {r.node: r.component for r in rows}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)} | {200: 200, 201: 200} and len(rows) == len(got)
    assert components.components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


# --- language -------------------------------------------------------------------------------------


def test_language_spans_and_odd_rows(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    model = language.train(docs, "text", "lang", F.col("doc_id"))
    picked = {lang: docs.filter(F.col("lang") == lang).orderBy("doc_id").first().text.split()[:60] for lang in ("en", "de")}
    mixed = spark.createDataFrame([(1, " ".join(picked["en"] + picked["de"]))], "id long, body string")
    row = language.identify(mixed, "id", "body", model).first()
    assert [s.lang for s in row.spans] == ["en", "de"] and abs(row.spans[1].first_word - 60) <= 2
    assert 0.3 < row.score < 0.7

    rows = language.identify(odd.documents(spark), "id", "body", model).collect()
    by_id = {r.doc_id: r for r in rows}
    assert len(rows) == len(odd.TEXTS) and all(0 <= r.score <= 1 for r in rows)
    assert {by_id[i].lang_pred for i in (3, 4, 5, 7)} == {"und"} and by_id[6].lang_pred == "es" and by_id[1].lang_pred == "en"
    assert by_id[9].score == 0 and by_id[9].lang_pred in model.languages
    assert language.identify(odd.documents(spark, empty=True), "id", "body", model).count() == 0
    nothing = language.train(odd.documents(spark, empty=True), "body", "lang", F.col("id"))
    assert {r.lang_pred for r in language.identify(odd.documents(spark), "id", "body", nothing).collect()} == {"und"}
    assert language.kept(odd.documents(spark), "body", model, 0.4).columns == odd.documents(spark).columns


def test_language_accuracy_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = language.train(docs.filter(~held_out), "text", "lang", F.col("doc_id"))
    found = language.identify(docs, "doc_id", "text", model).join(docs.filter(held_out), "doc_id")
    assert found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.95


def test_script_narrows_candidates(spark):
    rows = [(i, "привет мир как дела", "ru") for i in range(30)] + [(i, "hello world how are you", "en") for i in range(30, 60)]
    model = language.train(spark.createDataFrame(rows, "id long, t string, lang string"), "t", "lang", F.col("id"))
    scores, letters = model.word_scores(["ёжик", "zzzz", "42", "你"])
    at = model.languages.index
    assert scores[0, at("en")] == language.IMPOSSIBLE and scores[1, at("ru")] == language.IMPOSSIBLE
    assert not scores[2:].any() and letters.tolist() == [4, 4, 0, 1]


def test_viterbi_equals_exhaustive_search():
    rng = np.random.default_rng(1)
    lengths = [5, 0, 1, 6, 3]
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    scores = rng.normal(size=(sum(lengths), 3))
    labels = language.viterbi(scores, offsets, 0.8)
    for i, n in enumerate(lengths):
        part = scores[offsets[i] : offsets[i + 1]]
        value = lambda p, part=part: sum(part[j, s] for j, s in enumerate(p)) - 0.8 * sum(a != b for a, b in zip(p, p[1:]))
        best = max((value(p) for p in np.ndindex(*[3] * n)), default=0)
        assert value(labels[offsets[i] : offsets[i + 1]]) == pytest.approx(best)


# --- quality --------------------------------------------------------------------------------------


def test_em_finds_accuracies():
    rng = np.random.default_rng(5)
    good = rng.random(20_000) < 0.8
    accuracy = np.array([0.95, 0.8, 0.7, 0.9])
    right = rng.random((len(good), 4)) < accuracy
    votes = np.where(right == good[:, None], 1, -1) * (rng.random((len(good), 4)) < 0.8)
    numbers, counts = np.unique(quality.pattern_numbers(votes), return_counts=True)
    model = quality.fit_labels(quality.pattern_votes(numbers, 4), counts)
    assert np.abs(model.accuracy - accuracy).max() < 0.06 and abs(model.prior - 0.8) < 0.05
    assert ((model.posterior(votes) > 0.5) == good).mean() > 0.93


def test_quality_against_labels_and_odd_rows(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    scorer = quality.fit(docs, "text")
    found = quality.classify(docs, "doc_id", "text", scorer).join(spark.read.parquet(f"{DATA}/labels.parquet"), "doc_id").toPandas()
    assert (found.keep == (found.quality == 1)).mean() > 0.93
    assert found[found.quality == 1].keep.mean() > 0.97
    rows = quality.classify(odd.documents(spark), "id", "body", scorer).collect()
    assert len(rows) == len(odd.TEXTS) and all(0 <= r.score <= 1 for r in rows)
    assert {r.keep for r in rows if r.doc_id in (1, 2)} == {True}
    kept = quality.kept(odd.documents(spark), "body", scorer)
    assert kept.columns == odd.documents(spark).columns and kept.count() == sum(r.keep for r in rows)
    nothing = quality.fit(odd.documents(spark, empty=True), "body")
    assert {r.score for r in quality.classify(odd.documents(spark), "id", "body", nothing).collect()} == {0.5}
    assert quality.classify(odd.documents(spark, empty=True), "id", "body", scorer).count() == 0


# --- mixing ---------------------------------------------------------------------------------------


def brute_targets(sizes, weights=(1, 2, 3), most=3):
    names = sorted([s for s in sizes if s is not None]) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    open_, target, rest = set(names), {}, float(sum(sizes.values()))
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if rest * weight[s] / total > most * sizes[s] + 1e-9}
        if not over:
            return target | {s: rest * weight[s] / total for s in open_}
        for s in over:
            target[s] = most * sizes[s]
        rest -= sum(target[s] for s in over)
        open_ -= over
    return target


def test_targets_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    for sizes in ({"a": 5, "b": 100, None: 7, "é": 1, "Z": 0}, {f"s{i}": int(x) for i, x in enumerate(rng.pareto(0.7, 12) * 50)}, {None: 3}):
        rows = mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, size long"))
        wanted = brute_targets(sizes)
        assert {r.source: pytest.approx(wanted[r.source]) for r in rows.collect()} == {r.source: r.target for r in rows.collect()}


def test_mixture_hits_targets_and_repeats_itself(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    mix = mixing.Mix(docs, "doc_id", "text", "source", shard_slots=512)
    rows = mix.taken().toPandas().merge(docs.select("doc_id", "source", "text").toPandas(), on="doc_id")
    assert (rows["size"] == [len(re.findall(r"[^\x20\x09-\x0D]+", t)) for t in rows.text]).all()
    assert (rows.taken <= 3 * rows["size"]).all()
    by = rows.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"))
    assert (abs(by.taken - by.target) <= 0.1 * by.target).all()
    again = mixing.Mix(docs.repartition(7), "doc_id", "text", "source", shard_slots=512).taken().toPandas().set_index("doc_id")
    assert (again.taken.loc[rows.doc_id].values == rows.taken.values).all()
    texts = mix.texts().toPandas()
    assert sum(len(t.split()) for t in texts.text) == rows.taken.sum() and list(texts.columns) == docs.columns
    whole = rows[(rows.taken == rows["size"]) & (rows["size"] > 0)].set_index("doc_id").text
    once = texts.groupby("doc_id").filter(lambda g: len(g) == 1)
    once = once[once.doc_id.isin(whole.index)]
    assert len(once) and all(t.strip() == whole[i].strip() for i, t in zip(once.doc_id, once.text))


def test_mixture_of_odd_rows(spark):
    rows = mixing.Mix(odd.documents(spark), "id", "body", "source").taken().collect()
    assert len(rows) == len(odd.TEXTS)
    assert all(r.taken == 0 for r in rows if r.doc_id in (3, 4, 5)) and all(r.taken <= 3 * r.size for r in rows)
    assert mixing.Mix(odd.documents(spark), "id", "body", "source").texts().columns == odd.documents(spark).columns
    empty = mixing.Mix(odd.documents(spark, empty=True), "id", "body", "source")
    assert empty.taken().count() == 0 and empty.texts().count() == 0


def test_slots_of_more_words_than_an_int_holds(spark):
    schema = "source string, sid long, source_size long, target double"
    sources = spark.createDataFrame([("a", 0, 1_500_000_000, 9e8), ("b", 1, 500_000_000, 11e8)], schema)
    rows = mixing.shard_counts(sources, 32, 16384, 20).toPandas()
    total = 2_000_000_000 // 32
    shards = -(-total // 16384)
    sizes = [(t + 1) * total // shards - t * total // shards for t in range(shards)]
    assert (rows.groupby("shard").slots.sum().sort_index() == sizes).all() and len(rows) == 2 * shards
    assert rows.groupby("sid").slots.sum().tolist() == pytest.approx([9e8 / 32, 11e8 / 32], rel=1e-3)


def test_permutation_is_one(spark):
    rows = spark.range(1000).select(F.col("id").alias("i"), F.lit(1000).cast("long").alias("n"), F.lit(4).alias("salt"))
    places = [r.p for r in mixing.permuted(rows, "i", "n", ["salt"], "p", 9).orderBy("i").collect()]
    assert sorted(places) == list(range(1000)) and places != list(range(1000))
    assert np.corrcoef(places, range(1000))[0, 1] < 0.2


# --- pipeline -------------------------------------------------------------------------------------


def test_pipeline_stages_take_effect(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for number, (name, function) in enumerate(corpus_pipeline.STAGES[:4]):
        docs = function(spark, docs, DATA)
        docs = corpus_pipeline.stage(docs, "test")
        assert docs.columns == columns, name
        if number == 2:
            assert docs.count() < before and docs.select("doc_id").distinct().count() == docs.count()
    packed = corpus_pipeline.packed(spark, docs, DATA)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == {r.doc_id for r in docs.select("doc_id").collect()}


def test_pipeline_stages_on_odd_rows(spark):
    rows = odd.documents(spark).select(F.col("id").alias("doc_id"), F.col("body").alias("text"), "lang", "source", F.lit(1).cast("long").alias("n_chars"))
    for docs in (rows, rows.limit(0)):
        for name, function in corpus_pipeline.STAGES:
            result = function(spark, docs, DATA)
            assert result.count() >= 0, name
            assert name == "packing" or result.columns == docs.columns


def test_slices_cover_long_and_null_texts():
    batch = pa.RecordBatch.from_pydict({"id": [1, 2, 3], "text": ["a" * 100, None, "b"]})
    parts = list(chunks.slices(iter([batch]), most=10))
    assert [t["id"].to_pylist() for t in parts] == [[1], [2, 3]] and parts[1]["text"].to_pylist() == ["", "b"]


def test_slices_and_words_take_little_memory(monkeypatch):
    """Texts are not copied to be sliced, and a batch's lists of words are gone when pieces are encoded."""
    batch = pa.RecordBatch.from_pydict({"text": ["some words of a text"] * 100_000})
    before = pa.total_allocated_bytes()
    for table in chunks.slices(iter([batch]), most=1 << 16):
        assert table["text"][0].as_py() == "some words of a text"
        assert pa.total_allocated_bytes() - before < batch.nbytes // 2

    encoder, held = packing._encoder(public_tokenizers.path("word_bpe_49k.json")), []
    words = pa.array([f"word{i}, number" * 4 for i in range(50_000)])
    encode = encoder.pieces
    monkeypatch.setattr(encoder, "pieces", lambda listed: held.append(pa.total_allocated_bytes() - before - words.nbytes - listed.nbytes) or encode(listed))
    before = pa.total_allocated_bytes() - words.nbytes
    encoder(words, 1)
    assert held[0] < words.nbytes * 2


@pytest.mark.parametrize("shared_bytes", [1, 64, packing.SHARED_BYTES])
def test_pieces_do_not_depend_on_shared_words(spark, shared_bytes):
    docs = spark.createDataFrame([(i, "one, two three " * (i % 7) + f"w{i}") for i in range(50)] + [(50, None)], "id long, text string")
    path = public_tokenizers.path("word_bpe_49k.json")
    got = {(r.doc_id, r.start): bytes(r.ids) for r in packing.token_pieces(docs, "id", "text", path, shared_bytes=shared_bytes).collect()}
    tokenizer = Tokenizer.from_file(path)
    wanted = {(r.id, 0): np.array(tokenizer.encode(r.text or "", add_special_tokens=False).ids + [1], "<u4").tobytes() for r in docs.collect()}
    assert got == wanted
