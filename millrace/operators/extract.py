"""Records out of stored web pages."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import html as h

# Mark-up of a product listing.
LISTING_BLOCK = h.opener("div", "s-result-item")
LISTING_DESCRIPTION = h.element("span", "a-size-base-plus a-color-base a-text-normal")
LISTING_LINK = f"(<a(?:\\s[^>]*)?\\sclass={h.quoted('a-link-normal s-no-outline')}[^>]*>)"
LISTING_PRICE = h.element("span", "a-price-whole")
LISTING_PRIME_CLASS = "a-icon a-icon-prime a-icon-medium"
LISTING_PRIME_LABEL = "Amazon Prime"
LISTING_REVIEWS = h.element("span", "a-size-base s-underline-text")
STAR_ICON = "a-star-small-[0-9-]+"


def extract_blocks(
    df: DataFrame, html_col: str, block: str, fields: Mapping[str, str], keep: Sequence[str] = ()
) -> DataFrame:
    """One row per match of ``block``: ``(*keep, block_no, *fields)``.

    Each field is the first group of its pattern inside the block, null where it does not match.
    """
    blocks = df.select(*keep, F.posexplode(F.regexp_extract_all(html_col, F.lit(block), F.lit(0))).alias("block_no", "_block"))
    return blocks.select(*keep, "block_no", *[h.first_match(F.col("_block"), p).alias(n) for n, p in fields.items()])


def split_at(df: DataFrame, html_col: str, block_opener: str, keep: Sequence[str] = ()) -> DataFrame:
    """``(*keep, block_no, block)``: page parts that follow an opening ``div``, up to the ``div``'s end
    or the next opening tag of the kind."""
    parts = F.split(html_col, block_opener)
    after_first = F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1)))
    return df.select(*keep, F.posexplode(after_first).alias("block_no", "_part")).select(*keep, "block_no", _until_closed(F.col("_part")).alias("block"))


def _until_closed(part: Column, tag: str = "div") -> Column:
    """The text before the end tag that closes an element opened just before it."""
    pieces = F.split(part, f"(?i)(?=<{tag}[\\s>]|</{tag}\\s*>)")
    change = lambda p: F.when(p.rlike(f"(?i)^<{tag}"), 1).when(p.rlike(f"(?i)^</{tag}"), -1).otherwise(0)
    start = F.struct(F.lit(1).alias("depth"), F.lit(0).alias("kept"))

    def step(state: Column, piece: Column) -> Column:
        depth = F.when(state["depth"] > 0, state["depth"] + change(piece)).otherwise(0)
        return F.struct(depth.alias("depth"), (state["kept"] + F.when(depth > 0, 1).otherwise(0)).alias("kept"))

    kept = F.aggregate(pieces, start, step)["kept"]
    return F.array_join(F.slice(pieces, F.lit(1), kept), "")


def _flag(block: Column, icon_class: str, label: str) -> Column:
    either = [
        f"<i(?:\\s[^>]*)?\\sclass={h.quoted(icon_class)}(?:\\s[^>]*)?\\saria-label={h.quoted(label)}",
        f"<i(?:\\s[^>]*)?\\saria-label={h.quoted(label)}(?:\\s[^>]*)?\\sclass={h.quoted(icon_class)}",
    ]
    return block.rlike(either[0]) | block.rlike(either[1])


def product_listings(
    df: DataFrame, html_col: str, base_url: str, keep: Sequence[str] = (), star_icon: str = STAR_ICON
) -> DataFrame:
    """Products of listing pages: ``Description, Price, Prime Product, URL, Stars, Reviews``.

    Blocks without a description or a link are left out.
    """
    blocks = split_at(df, html_col, LISTING_BLOCK, keep)
    block = F.col("block")
    stars = h.element("i", f"a-icon a-icon-star-small {star_icon} aok-align-bottom", f".*?<span[^>]*\\sclass={h.quoted('a-icon-alt')}[^>]*>(.*?)</span>.*?")
    found = blocks.select(
        *keep,
        "block_no",
        h.inner_text(h.first_match(block, LISTING_DESCRIPTION)).alias("_description"),
        h.first_match(h.first_match(block, LISTING_LINK), r"""\shref=["']([^"']*)["']""").alias("_link"),
        h.inner_text(h.first_match(block, LISTING_PRICE)).alias("_price"),
        _flag(block, LISTING_PRIME_CLASS, LISTING_PRIME_LABEL).alias("_prime"),
        h.first_match(block, stars).alias("_stars"),
        h.inner_text(h.first_match(block, LISTING_REVIEWS)).alias("_reviews"),
    ).filter("_description is not null and _link is not null")
    return found.select(
        *keep,
        "block_no",
        h.drop_one_quote_kind(F.col("_description")).alias("Description"),
        h.price(F.col("_price")).alias("Price"),
        F.col("_prime").alias("Prime Product"),
        h.absolute_url(h.inner_text(F.col("_link")), base_url).alias("URL"),
        h.rating(h.inner_text(F.col("_stars"))).alias("Stars"),
        h.grouped_integer(F.col("_reviews")).alias("Reviews"),
    )
