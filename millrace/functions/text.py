"""Tokenising and token-list operators as column expressions (``array<string>`` in and out).

Patterns are limited to what Java and RE2 read alike: explicit Unicode classes, no look-around and
no word-boundary escapes.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions import lexicon

# Tokens are laid out with two blanks between them, so each owns the blank on either side and a
# replacement can never swallow the neighbour's blank.
_GAP = "  "

CONTRACTION = r"([\p{L}\p{N}])('s|'S|'m|'M|'d|'D|'ll|'LL|'re|'RE|'ve|'VE|n't|N'T) "
BRACKETS_AND_SYMBOLS = "([\\[\\](){}<>;@#$%&?!\"“”«»…`|]|--+)"
COMMA_OR_COLON = r"([:,])([^\p{N}])"
CLOSING_MARK = r"([.']) "
NON_WORD = r"[^\p{L}\p{N}_]+"
PUNCTUATION = r"[^\p{L}\p{N}_\s]"


def _not_empty(tokens: Column) -> Column:
    return F.filter(tokens, lambda t: t != "")


def word_tokens(text: Column) -> Column:
    """Words, numbers and punctuation marks; contractions split, ``5.1`` and ``wi-fi`` kept whole."""
    return _not_empty(F.split(_spaced(text), " +"))


def _spaced(text: Column) -> Column:
    """The text with blanks around its words and marks."""
    spaced = F.concat(F.lit(" "), F.regexp_replace(text, r"\s+", _GAP), F.lit(" "))
    for pattern, replacement in (
        (BRACKETS_AND_SYMBOLS, " $1 "),
        (COMMA_OR_COLON, " $1 $2"),
        (CLOSING_MARK, " $1 "),
    ):
        spaced = F.regexp_replace(spaced, pattern, replacement)
    # The pattern would be tried at every letter.
    return _once(spaced, lambda line: F.when(F.contains(line, F.lit("'")), F.regexp_replace(line, CONTRACTION, "$1 $2 ")).otherwise(line))


def bare_words(text: Column) -> Column:
    """The same as ``strip_non_word(word_tokens(text))``, stripped in one go."""
    return _not_empty(F.split(F.regexp_replace(_spaced(text), r"[^\p{L}\p{N}_ ]+", ""), " +"))


def simple_tokens(text: Column) -> Column:
    """Lower-cased runs of letters, digits and underscores."""
    return _not_empty(F.split(F.lower(text), NON_WORD))


def _laid_out(tokens: Column) -> Column:
    return F.concat(F.lit(" "), F.array_join(tokens, _GAP), F.lit(" "))


def _taken_apart(line: Column) -> Column:
    return _not_empty(F.split(F.trim(line), _GAP))


def phrase_parts(phrase: str) -> list[str]:
    """A phrase cut the way :func:`word_tokens` cuts it (phrases hold no other marks than these)."""
    return re.sub(r"(\w)('s|'m|'d|'ll|'re|'ve|n't)(?=\s|$)", r"\1 \2", phrase.lower()).split()


def protect_phrases(
    tokens: Column,
    phrases: Sequence[str] = lexicon.PHRASES,
    order: str = "longest",
    keep_case: bool = True,
    strip: bool = False,
) -> Column:
    """Join each phrase into one lower-case token with underscores, ignoring case.

    ``order="longest"`` applies longer phrases first, ties alphabetically, so every phrase can be
    found. ``order="listed"`` applies them as given: an early short phrase then hides a later,
    longer one that contains it. ``keep_case=False`` is for callers that lower all tokens anyway:
    words of the phrase list come out lower-case everywhere, and plain replacement is faster.
    ``strip`` applies :func:`strip_punctuation` as well, in one go; tokens must not hold white space.
    """
    if order not in ("longest", "listed"):
        raise ValueError(f"unknown order: {order}")
    lowered = list(dict.fromkeys(p.lower() for p in phrases))
    ranked = sorted(lowered, key=lambda p: (-len(p), p)) if order == "longest" else lowered
    cut = [phrase_parts(p) for p in ranked]
    if not keep_case:
        tokens = F.transform(tokens, _lower_if_in(word for parts in cut for word in parts))

    def replaced(line: Column) -> Column:
        for parts in cut:
            joined = f" {'_'.join(parts)} "
            if keep_case:
                line = F.regexp_replace(line, f"(?i) {_GAP.join(map(re.escape, parts))} ", joined)
            elif len(parts) > 1:
                line = F.replace(line, F.lit(f" {_GAP.join(parts)} "), F.lit(joined))
        return line

    # One look for any phrase spares most texts the search for each of them.
    found = f"(?i) {_any_of(_GAP.join(parts) + ' ' for parts in cut)}"
    line = _once(_laid_out(tokens), lambda line: F.when(line.rlike(found), replaced(line)).otherwise(line))
    return _taken_apart(F.lower(F.regexp_replace(line, PUNCTUATION, "")) if strip else line)


def _any_of(words: Iterable[str]) -> str:
    """A pattern of any of the words in which common beginnings are tried once."""
    by_first: dict[str, list[str]] = {}
    for word in dict.fromkeys(words):
        by_first.setdefault(word[:1], []).append(word[1:])
    if "" in by_first:
        return ""  # a word ends here, and what follows in others need not be looked at
    return "(?:" + "|".join(re.escape(first) + _any_of(rest) for first, rest in by_first.items()) + ")"


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` refers to it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _lower_if_in(words: Iterable[str]):
    known = sorted(set(words))
    return lambda t: F.when(F.lower(t).isin(known), F.lower(t)).otherwise(t)


def strip_punctuation(tokens: Column) -> Column:
    """Remove everything but word characters and blanks inside tokens, lower them, drop empty ones."""
    return _not_empty(F.transform(tokens, lambda t: F.lower(F.regexp_replace(t, PUNCTUATION, ""))))


def strip_non_word(tokens: Column) -> Column:
    """Remove every non-word character inside tokens and drop empty ones; digits and case stay."""
    return _not_empty(F.transform(tokens, lambda t: F.regexp_replace(t, NON_WORD, "")))


def drop_numbers_and_units(tokens: Column, units: Sequence[str] = lexicon.UNIT_WORDS) -> Column:
    """Drop tokens made of digits only and unit words."""
    return F.filter(tokens, lambda t: ~(t.rlike(r"^\p{N}+$") | F.lower(t).isin(list(units))))


def join_terms(tokens: Column, pairs: Mapping[tuple[str, str], str] = lexicon.JOINED_PAIRS) -> Column:
    """Write given pairs of neighbours as one term, greedily from the left."""
    alternatives = "|".join(f"{re.escape(a)}{_GAP}{re.escape(b)}" for a, b in pairs)
    # One pass marks the leftmost pairs, so a token can belong to one pair only.
    line = F.regexp_replace(_laid_out(tokens), f" ({alternatives}) ", " \x01$1\x02 ")
    for (a, b), joined in pairs.items():
        line = F.replace(line, F.lit(f"\x01{a}{_GAP}{b}\x02"), F.lit(joined))
    return _taken_apart(line)


def drop_stop_words(tokens: Column, words: Sequence[str], ignore_case: bool = True) -> Column:
    listed = list(dict.fromkeys(words))
    return F.filter(tokens, lambda t: ~(F.lower(t) if ignore_case else t).isin(listed))


def singular(token: Column) -> Column:
    """Plural endings: ``sses`` to ``ss``, ``ies`` to ``i``, other ``s`` dropped, ``ss`` kept.

    Words of one or two letters stay as they are.
    """
    return (
        F.when(F.length(token) <= 2, token)
        .when(token.endswith("sses") | token.endswith("ies"), F.left(token, F.length(token) - 2))
        .when(token.endswith("ss"), token)
        .when(token.endswith("s"), F.left(token, F.length(token) - 1))
        # ``$`` also stands before a last line break.
        .when(F.right(token, F.lit(1)).isin(list("\n\r\u0085\u2028\u2029")), F.regexp_replace(token, "s$", ""))
        .otherwise(token)
    )


def normalise(
    tokens: Column,
    preserved: Sequence[str] = lexicon.PRESERVED_WORDS,
    forms: Mapping[str, str] = lexicon.PRESERVED_FORMS,
) -> Column:
    """Preserved words take their dictionary form, all others lose plural endings."""

    def one(token: Column) -> Column:
        if not preserved:
            return singular(token)
        kept = token
        for word, form in forms.items():
            kept = F.when(F.lower(token) == word, F.lit(form)).otherwise(kept)
        return F.when(F.lower(token).isin(list(preserved)), kept).otherwise(singular(token))

    return F.transform(tokens, one)


def restore_phrases(tokens: Column) -> Column:
    """Turn the underscores of protected phrases back into blanks."""
    return F.transform(tokens, lambda t: F.replace(t, F.lit("_"), F.lit(" ")))


def as_text(tokens: Column) -> Column:
    return F.array_join(tokens, " ")


def ngrams(tokens: Column, n: int, heads: Column | None = None) -> Column:
    """Neighbouring ``n`` tokens joined by a blank; empty for lists shorter than ``n``.

    ``heads`` is the list of tokens with null in place of some: a gram that would begin with one of them is null.
    """
    grams = tokens if heads is None else heads
    for width in range(2, n + 1):
        count = F.greatest(F.size(tokens) - (width - 1), F.lit(0))
        grams = F.zip_with(
            F.slice(grams, F.lit(1), count),
            F.slice(tokens, F.lit(width), count),
            lambda head, tail: F.concat(head, F.lit(" "), tail),
        )
    return grams


def gram_lists(tokens: Column, n: int) -> Column:
    """Neighbouring ``n`` tokens as lists."""
    last = F.size(tokens) - (n - 1)
    starts = F.when(last > 0, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.slice(tokens, i, n))


def gram_structs(tokens: Column, n: int) -> Column:
    """Neighbouring ``n`` tokens as structs ``w0, w1, …``, made without a step per gram."""
    def zipped(listed: Column) -> Column:
        count = F.greatest(F.size(listed) - (n - 1), F.lit(0))
        return F.arrays_zip(*[F.slice(listed, F.lit(i + 1), count).alias(f"w{i}") for i in range(n)])

    return _once(tokens, zipped)


def ngram_range(tokens: Column, low: int, high: int, heads: Column | None = None) -> Column:
    """All n-grams with ``low <= n <= high`` in one list; for ``heads`` see :func:`ngrams`."""
    return F.flatten(F.array(*[ngrams(tokens, n, heads) for n in range(low, high + 1)]))
