"""Fields of marked-up text and links as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Character entities decoded in extracted text; the ampersand comes last.
ENTITIES = {"&nbsp;": " ", "&quot;": '"', "&#34;": '"', "&#39;": "'", "&#x27;": "'", "&apos;": "'", "&lt;": "<", "&gt;": ">", "&amp;": "&"}


QUOTES = ('"', "'")


def quoted(value: str) -> str:
    """Pattern for an attribute value in either kind of quotes."""
    return "(?:" + "|".join(f"{q}{value}{q}" for q in QUOTES) + ")"


def element(tag: str, class_value: str, body: str = "(.*?)") -> str:
    """Pattern for the first element of ``tag`` whose class attribute is exactly ``class_value``."""
    return f"(?s)<{tag}(?:\\s[^>]*)?\\sclass={quoted(class_value)}[^>]*>{body}</{tag}>"


def opener(tag: str, class_name: str) -> str:
    """Pattern for the opening tag of an element whose class list contains ``class_name``."""
    either = "|".join(f"{q}(?:[^{q}]*\\s)?{class_name}(?:\\s[^{q}]*)?{q}" for q in QUOTES)
    return f"<{tag}(?:\\s[^>]*)?\\sclass=(?:{either})[^>]*>"


def inner_text(markup: Column) -> Column:
    """Text of a fragment: tags removed, entities decoded, outer white space trimmed."""
    text = F.regexp_replace(markup, "<[^>]*>", "")
    for entity, character in ENTITIES.items():
        text = F.replace(text, F.lit(entity), F.lit(character))
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def first_match(markup: Column, pattern: str, group: int = 1) -> Column:
    """Group of the first match, null (not empty) where the pattern does not occur."""
    return F.when(F.regexp_like(markup, F.lit(pattern)), F.regexp_extract(markup, pattern, group))


def drop_one_quote_kind(text: Column) -> Column:
    """Remove all single quotes; only where there are none, remove all double quotes."""
    return F.when(text.contains("'"), F.replace(text, F.lit("'"), F.lit(""))).otherwise(
        F.replace(text, F.lit('"'), F.lit(""))
    )


def decimal_comma(text: Column) -> Column:
    """Number written ``1.234,56``; null where the text is no number."""
    plain = F.replace(F.replace(text, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    return plain.try_cast("double")


def price(text: Column, sentinel: float = 11999.0) -> Column:
    """Price with decimal comma; missing, unreadable and ``sentinel`` prices are 0."""
    value = decimal_comma(text)
    return F.coalesce(F.when(value != sentinel, value), F.lit(0.0))


def rating(text: Column) -> Column:
    """First word of a rating text such as ``4,5 su 5 stelle``; 0 where there is none."""
    word = F.regexp_extract(text, r"^\s*(\S+)", 1)
    return F.coalesce(F.replace(word, F.lit(","), F.lit(".")).try_cast("double"), F.lit(0.0))


def grouped_integer(text: Column) -> Column:
    """Whole number with dots between groups; anything else is 0."""
    return F.coalesce(F.replace(text, F.lit("."), F.lit("")).try_cast("long"), F.lit(0).cast("long"))


def absolute_url(link: Column, base: str) -> Column:
    """Link resolved against ``base``, an origin such as ``https://shop.example/``."""
    origin = base.rstrip("/")
    scheme = base.split("//")[0]
    return (
        F.when(link.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), link)
        .when(link.startswith("//"), F.concat(F.lit(scheme), link))
        .when(link.startswith("/"), F.concat(F.lit(origin), link))
        .otherwise(F.concat(F.lit(origin + "/"), link))
    )


def unwrap_redirect(link: Column, base: str, suffix: str = "/ref=sr_1_2?") -> Column:
    """Link rebuilt with its decoded ``url`` parameter (plus ``suffix``) as the only query.

    Path and fragment are dropped and relative links get ``base``; null without such a parameter.
    """
    wrapped = first_match(link, r"^[^#?]*\?(?:[^#]*?&)?url=([^&#]+)")
    host = F.regexp_extract(link, "^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)", 1)
    start = F.when(host == "", F.lit(base)).otherwise(host)
    return F.concat(start, F.lit("?url="), F.try_url_decode(wrapped), F.lit(suffix))
