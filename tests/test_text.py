import pandas as pd
import pytest
from pyspark.sql import functions as F

from millrace.functions import lexicon
from millrace.functions import text as tx
from millrace.operators import presets




def test_simple_tokens(one):
    assert one(lambda X: tx.simple_tokens(X), "string", "", "  ", "Éon's  A_b-3, über!", None) == [[], [], ["éon", "s", "a_b", "3", "über"], None]


def test_word_tokens(one):
    assert one(lambda X: tx.word_tokens(X), "string", "") == []
    assert one(lambda X: tx.word_tokens(X), "string", "I don't know, it's 5.1 (wi-fi)... 3,5 a:b c: d.") == [
        "I", "do", "n't", "know", ",", "it", "'s", "5.1", "(", "wi-fi", ")", "..", ".", "3,5", "a", ":", "b", "c", ":", "d", ".",
    ]
    assert one(lambda X: tx.word_tokens(X), "string", "we'll you've they're I'm he'd dogs'") == [
        "we", "'ll", "you", "'ve", "they", "'re", "I", "'m", "he", "'d", "dogs", "'",
    ]


def test_phrases_longest_first_and_adjacent(one):
    phrases = ["win 10", "win 10 pro", "usb c", "usb c charging"]
    keep = lambda X: tx.protect_phrases(X, phrases)
    assert one(keep, "array<string>", "a Win 10 PRO win 10 win 10 usb c charging".split()) == ["a", "win_10_pro", "win_10", "win_10", "usb_c_charging"]
    assert one(keep, "array<string>", ["swin", "10", "Pro"], []) == [["swin", "10", "Pro"], []]


def test_phrases_as_listed_hide_later_longer_ones(one):
    kept = lambda X: tx.protect_phrases(X, ["usb c", "usb c charging"], "listed")
    assert one(kept, "array<string>", "usb c charging".split()) == ["usb_c", "charging"]


@pytest.mark.parametrize("keep_case", [True, False])
def test_both_ways_of_replacing_agree(one, keep_case):
    tokens = "the Full HD tower pc portatile with M.2 SSD and Wi-Fi 6 pronto all'uso".split()
    kept = one(lambda X: tx.protect_phrases(X, keep_case=keep_case), "array<string>", tokens)
    assert [t.lower() for t in kept] == ["the", "full_hd", "tower", "pc_portatile", "with", "m.2_ssd", "and", "wi-fi", "6", "pronto_all'uso"]


def test_phrase_order_must_be_known():
    with pytest.raises(ValueError):
        tx.protect_phrases(None, ["a b"], "shortest")


def test_phrase_list_has_the_entries_lost_to_missing_commas():
    assert {"intel core i3", "wi-fi", "battery life", "pre installed software", "mini pc"} <= set(lexicon.PHRASES)
    assert len(set(lexicon.PHRASES)) == len(lexicon.PHRASES)


def test_stripping(one):
    tokens = ["A.b", "--", "m.2", "É!", "x_y"]
    assert one(lambda X: tx.strip_punctuation(X), "array<string>", tokens) == ["ab", "m2", "é", "x_y"]
    assert one(lambda X: tx.strip_non_word(X), "array<string>", tokens) == ["Ab", "m2", "É", "x_y"]


def test_numbers_and_units(one):
    assert one(lambda X: tx.drop_numbers_and_units(X), "array<string>", ["16", "GB", "16gb", "ssd", "a1", "٣", ""]) == ["16gb", "a1", ""]


def test_joined_terms(one):
    join = lambda X: tx.join_terms(X)
    assert one(join, "array<string>", []) == []
    assert one(join, "array<string>", ["dual"]) == ["dual"]
    assert one(join, "array<string>", "m2 ssd m2 ssd dual band m2".split()) == ["m.2 ssd", "m.2 ssd", "dual-band", "m2"]


def test_joined_terms_are_greedy_from_the_left(one):
    join = lambda X: tx.join_terms(X, {("b", "c"): "BC", ("a", "b"): "AB"})
    assert one(join, "array<string>", "a b c".split(), "b c b c a b b".split()) == [["AB", "c"], ["BC", "BC", "AB", "b"]]


def test_stop_words_keep_duplicates(one):
    words = ["the", "di"]
    assert one(lambda X: tx.drop_stop_words(X, words), "array<string>", ["x", "The", "x", "di"]) == ["x", "x"]
    assert one(lambda X: tx.drop_stop_words(X, words, ignore_case=False), "array<string>", ["The", "the"]) == ["The"]


def test_word_forms(one):
    forms = lambda X: tx.normalise(X)
    assert one(forms, "array<string>", ["classes", "batteries", "glass", "laptops", "Windows", "mouse", "is", "cats"]) == [
        "class", "batteri", "glass", "laptop", "window", "mouse", "is", "cat",
    ]


def test_restored_phrases(one):
    assert one(lambda X: tx.restore_phrases(X), "array<string>", ["win_10_pro", "a"]) == ["win 10 pro", "a"]


def test_rich_preset(one):
    text = "Mini PC Windows 11 Pro, 16GB RAM, M.2 SSD! The Dual band cards & 2 batteries"
    assert one(lambda X: presets.RichPreset()(X), "string", text) == ["mini_pc", "windows_11_pro", "16gb_ram", "m2_ssd", "dual-band", "card", "batteri"]
    assert one(lambda X: presets.RichPreset(restore=True)(X), "string", text)[:2] == ["mini pc", "windows 11 pro"]
    assert one(lambda X: presets.RichPreset()(X), "string", "", "16 GB") == [[], []]


def test_simple_preset_keeps_digits(one):
    assert one(lambda X: presets.simple_preset(X), "string", "The 16 GB cards, don't!") == ["16", "gb", "card", "nt"]


def test_preset_stage_switches_and_persistence(spark, tmp_path):
    df = spark.createDataFrame([("usb c, The cats 16",)], "text string")
    off = dict.fromkeys(presets.TextPreset._switches, False)
    assert presets.TextPreset(**off).transform(df).first().tokens == ["usb", "c", ",", "The", "cats", "16"]
    stage = presets.TextPreset(enableStopwords=False)
    stage.write().overwrite().save(str(tmp_path / "stage"))
    again = presets.TextPreset.load(str(tmp_path / "stage"))
    assert again.transform(df).first().tokens == stage.transform(df).first().tokens == ["usb_c", "the", "cat"]


def test_word_forms_by_function_sees_each_distinct_token_once_per_batch(spark):
    df = spark.createDataFrame([(["b", "a", "b"],), ([],), (None,)], "tokens array<string>").coalesce(1)
    out = presets.with_word_forms(df, "tokens", lambda words: pd.Series([w * 2 for w in words]))
    assert [r.tokens for r in out.collect()] == [["bb", "aa", "bb"], [], None]


def test_ngrams(one):
    lists = [[], ["a"], ["a", "b"], ["a", "b", "c"]]
    assert one(lambda X: tx.ngrams(X, 2), "array<string>", *lists) == [[], [], ["a b"], ["a b", "b c"]]
    assert one(lambda X: tx.ngrams(X, 3), "array<string>", *lists) == [[], [], [], ["a b c"]]
    assert one(lambda X: tx.ngram_range(X, 1, 3), "array<string>", ["a", "b", "c"]) == ["a", "b", "c", "a b", "b c", "a b c"]


def test_words_are_stripped_in_one_go(spark):
    texts = ["It's 5.1, wi-fi: o'clock's (USB--C)!", "\u00a0a\u2028b ½ ' '' \t_x_ ΟΔΟΣ.", "", None, "don't STOP... classes ponies ss"]
    x = F.col("t")
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(
        tx.bare_words(x).alias("bare"), tx.strip_non_word(tx.word_tokens(x)).alias("bare_steps"),
        tx.protect_phrases(tx.word_tokens(x), ["usb c", "wi-fi"], keep_case=False, strip=True).alias("kept"),
        tx.strip_punctuation(tx.protect_phrases(tx.word_tokens(x), ["usb c", "wi-fi"], keep_case=False)).alias("kept_steps"),
    ).collect()
    assert all(r.bare == r.bare_steps and r.kept == r.kept_steps for r in rows)


def test_common_beginnings_of_words_are_tried_once():
    assert tx._any_of(["win 10", "win 11", "x.", "x.y"]) in ("(?:w(?:i(?:n(?:\\ (?:1(?:0|1))))))|x(?:\\.))", "(?:w(?:i(?:n(?:\\ (?:1(?:0|1)))))|x(?:\\.))")
