"""The text operators written as SQL for the second engine."""

from __future__ import annotations

from collections.abc import Sequence

from millrace.functions import lexicon
from millrace.functions import text as tx


def quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def listed(values: Sequence[str]) -> str:
    return "(" + ", ".join(quoted(v) for v in dict.fromkeys(values)) + ")"


def keep(tokens: str, condition: str) -> str:
    return f"list_filter({tokens}, lambda t: {condition})"


def each(tokens: str, expression: str) -> str:
    return f"list_transform({tokens}, lambda t: {expression})"


def substitute(text: str, pattern: str, replacement: str) -> str:
    return f"regexp_replace({text}, {quoted(pattern)}, {quoted(replacement)}, 'g')"


def not_empty(tokens: str) -> str:
    return keep(tokens, "t <> ''")


def simple_tokens(text: str) -> str:
    return not_empty(f"regexp_split_to_array(lower({text}), {quoted(tx.NON_WORD)})")


def word_tokens(text: str) -> str:
    spaced = "' ' || " + substitute(text, r"\s+", "  ") + " || ' '"
    spaced = substitute(spaced, tx.BRACKETS_AND_SYMBOLS, r" \1 ")
    spaced = substitute(spaced, tx.COMMA_OR_COLON, r" \1 \2")
    spaced = substitute(spaced, tx.CLOSING_MARK, r" \1 ")
    spaced = substitute(spaced, tx.CONTRACTION, r"\1 \2 ")
    return not_empty(f"regexp_split_to_array({spaced}, ' +')")


def laid_out(tokens: str) -> str:
    return f"' ' || array_to_string({tokens}, '  ') || ' '"


def taken_apart(line: str) -> str:
    return not_empty(f"string_split(trim({line}), '  ')")


def protect_phrases(tokens: str, phrases: Sequence[str]) -> str:
    """Phrases without punctuation, lower-case tokens."""
    line = laid_out(tokens)
    for phrase in phrases:
        parts = tx.phrase_parts(phrase)
        if len(parts) > 1:
            line = f"replace({line}, {quoted(' ' + '  '.join(parts) + ' ')}, {quoted(' ' + '_'.join(parts) + ' ')})"
    return taken_apart(line)


def strip_punctuation(tokens: str) -> str:
    return not_empty(each(tokens, f"lower({substitute('t', tx.PUNCTUATION, '')})"))


def strip_non_word(tokens: str) -> str:
    return not_empty(each(tokens, substitute("t", tx.NON_WORD, "")))


def drop_numbers_and_units(tokens: str) -> str:
    return keep(tokens, rf"NOT regexp_matches(t, '^\p{{N}}+$') AND lower(t) NOT IN {listed(lexicon.UNIT_WORDS)}")


def drop_stop_words(tokens: str, words: Sequence[str], ignore_case: bool = True) -> str:
    return keep(tokens, f"{'lower(t)' if ignore_case else 't'} NOT IN {listed(words)}")


def singular(t: str = "t") -> str:
    return (
        f"CASE WHEN length({t}) <= 2 OR (suffix({t}, 'ss') AND NOT suffix({t}, 'sses')) THEN {t} "
        f"WHEN suffix({t}, 'sses') OR suffix({t}, 'ies') THEN left({t}, length({t}) - 2) "
        f"WHEN suffix({t}, 's') THEN left({t}, length({t}) - 1) ELSE {t} END"
    )


def normalise(tokens: str, preserved: bool) -> str:
    if not preserved:
        return each(tokens, singular())
    forms = " ".join(f"WHEN lower(t) = {quoted(w)} THEN {quoted(f)}" for w, f in lexicon.PRESERVED_FORMS.items())
    kept = f"WHEN lower(t) IN {listed(lexicon.PRESERVED_WORDS)} THEN t"
    return each(tokens, f"CASE {forms} {kept} ELSE {singular()} END")


def join_pairs(tokens: str, pairs: dict[tuple[str, str], str]) -> str:
    alternatives = "|".join(f"{a}  {b}" for a, b in pairs)
    line = f"regexp_replace({laid_out(tokens)}, ' ({alternatives}) ', ' ' || chr(1) || '\\1' || chr(2) || ' ', 'g')"
    for (a, b), joined in pairs.items():
        line = f"replace({line}, chr(1) || {quoted(a + '  ' + b)} || chr(2), {quoted(joined)})"
    return taken_apart(line)


def simple_preset(text: str) -> str:
    tokens = drop_stop_words(strip_non_word(word_tokens(f"lower({text})")), lexicon.ENGLISH_STOP_WORDS, False)
    return normalise(tokens, preserved=False)


def rich_steps(text: str, source: str, key: str) -> str:
    """The rich preset as a chain of common table expressions ending in ``rich(key, tokens)``."""
    ranked = sorted({p.lower() for p in lexicon.PHRASES}, key=lambda p: (-len(p), p))
    known = listed([w for p in ranked for w in tx.phrase_parts(p)])
    lowered = each(word_tokens(text), f"CASE WHEN lower(t) IN {known} THEN lower(t) ELSE t END")
    stop = lexicon.ENGLISH_STOP_WORDS + lexicon.ITALIAN_STOP_WORDS
    chain = [
        ("rich1", f"SELECT {key}, {lowered} AS tokens FROM {source}"),
        ("rich2", f"SELECT {key}, {protect_phrases('tokens', ranked)} AS tokens FROM rich1"),
        ("rich3", f"SELECT {key}, {drop_numbers_and_units(strip_punctuation('tokens'))} AS tokens FROM rich2"),
        ("rich4", f"SELECT {key}, {join_pairs('tokens', lexicon.JOINED_PAIRS)} AS tokens FROM rich3"),
        ("rich5", f"SELECT {key}, {drop_stop_words('tokens', stop)} AS tokens FROM rich4"),
        ("rich6", f"SELECT {key}, {normalise('tokens', True)} AS tokens FROM rich5"),
        ("rich", f"SELECT {key}, {normalise('tokens', True)} AS tokens FROM rich6"),
    ]
    return ", ".join(f"{name} AS ({body})" for name, body in chain)


def ngrams(tokens: str, n: int) -> str:
    """List of n-grams; ``tokens`` must be a plain column."""
    if n == 1:
        return tokens
    words = " || ' ' || ".join(f"{tokens}[i + {k}]" for k in range(n))
    return f"list_transform(range(1, len({tokens}) - {n - 2}), lambda i: {words})"


def gram_lists(tokens: str, n: int) -> str:
    """Like :func:`ngrams`, as lists of tokens."""
    return f"list_transform(range(1, len({tokens}) - {n - 2}), lambda i: list_slice({tokens}, i, i + {n - 1}))"


def document_tokens(preset_tokens: str, source: str = "documents", key: str = "doc_id") -> str:
    return f"tokenised AS (SELECT {key}, {preset_tokens} AS tokens FROM {source})"
