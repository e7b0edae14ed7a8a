"""Record extraction from web pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.catalog.registry import query
from millrace.catalog.views import table
from millrace.functions import html as h
from millrace.operators import extract
from millrace.plans.spread import by_key

BASE = "https://shop.example/"

LINK = '<a\\s[^>]*href="[^"]*"[^>]*>[\\s\\S]*?</a>'
PARAGRAPH = "<p>[^<]*</p>"


@query(
    "page_links",
    f"""WITH blocks AS (SELECT page_id, unnest(regexp_extract_all(html, '{LINK}')) AS b,
            unnest(range(len(regexp_extract_all(html, '{LINK}')))) AS block_no FROM pages)
        SELECT page_id, CAST(block_no AS INT) AS block_no, regexp_extract(b, 'href="([^"]*)"', 1) AS href,
               regexp_replace(regexp_replace(b, '<[^>]*>', '', 'g'), '^\\s+|\\s+$', '', 'g') AS text FROM blocks""",
)
def page_links(spark: SparkSession, folder: str) -> DataFrame:
    fields = {"href": 'href="([^"]*)"', "text": "([\\s\\S]*)"}
    links = extract.extract_blocks(table(spark, folder, "pages"), "html", LINK, fields, ["page_id"])
    return links.withColumn("text", F.regexp_replace(F.regexp_replace("text", "<[^>]*>", ""), r"^\s+|\s+$", ""))


@query(
    "page_paragraphs",
    f"""WITH blocks AS (SELECT page_id, unnest(regexp_extract_all(html, '{PARAGRAPH}')) AS b,
            unnest(range(len(regexp_extract_all(html, '{PARAGRAPH}')))) AS block_no FROM pages)
        SELECT page_id, CAST(block_no AS INT) AS block_no, regexp_extract(b, '<p>([^<]*)</p>', 1) AS body FROM blocks""",
)
def page_paragraphs(spark: SparkSession, folder: str) -> DataFrame:
    return extract.extract_blocks(table(spark, folder, "pages"), "html", PARAGRAPH, {"body": "<p>([^<]*)</p>"}, ["page_id"])


# A listing block per part, with every case of the field rules (a few sizes lack a field); twenty blocks make a page.
_BLOCK = """
CASE WHEN p_partkey % 31 = 0 THEN '<div class="s-result-item-header">x</div>' ELSE '' END
|| '<div data-n="1" class="sg-col s-result-item' || CASE WHEN p_partkey % 2 = 0 THEN ' s-card' ELSE '' END || '">'
|| CASE WHEN p_size = 29 THEN '' ELSE '<a class="a-link-normal s-no-outline" href="'
   || CASE p_partkey % 3 WHEN 0 THEN '/dp/' WHEN 1 THEN 'https://other.example/dp/' ELSE 'dp/' END
   || CAST(p_partkey AS STRING) || '?a=1&amp;b=2"><img src="x"></a>' END
|| CASE WHEN p_size = 13 THEN '<span class="a-text-normal">no</span>'
   ELSE '<span class="a-size-base-plus a-color-base a-text-normal"> <b>' || p_name || '</b> &amp; '
   || CASE p_partkey % 3 WHEN 0 THEN '15\\'\\' "x" ' WHEN 1 THEN '17" ' ELSE '' END || p_type || '\\n</span>' END
|| CASE WHEN p_size = 10 THEN '' WHEN p_size = 17 THEN '<span class="a-price-whole">11.999<i>,</i></span>'
   WHEN p_size = 19 THEN '<span class="a-price-whole">n.d.</span>'
   ELSE '<span class="a-price-whole">2.' || CAST(600 + p_size AS STRING) || ',' || CAST(10 + p_partkey % 90 AS STRING) || '</span>' END
|| CASE p_partkey % 4 WHEN 0 THEN '<i class="a-icon a-icon-prime a-icon-medium" role="img" aria-label="Amazon Prime"></i>'
   WHEN 1 THEN '<i aria-label="Amazon Prime" class="a-icon a-icon-prime a-icon-medium"></i>'
   WHEN 2 THEN '<i class="a-icon a-icon-prime" aria-label="Amazon Prime"></i>' ELSE '' END
|| CASE WHEN p_partkey % 7 = 0 THEN '' ELSE '<i class="a-icon a-icon-star-small a-star-small-' || CAST(p_partkey % 5 AS STRING)
   || '-5 aok-align-bottom"><span class="a-icon-alt">' || CAST(p_partkey % 5 AS STRING) || ',5 su 5 stelle</span></i>' END
|| CASE WHEN p_partkey % 11 = 0 THEN '<span class="a-size-base s-underline-text">n/a</span>'
   ELSE '<span class="a-size-base s-underline-text">1.' || CAST(100 + p_size AS STRING) || ' </span>' END
|| '</div>'
"""


def listing_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Pages of at most twenty listing blocks, written from the part table."""
    blocks = table(spark, folder, "part").select(
        "p_partkey", F.floor(F.col("p_partkey") / 20).alias("page_id"), F.expr(_BLOCK).alias("block")
    )
    joined = by_key(blocks, "page_id").groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct("p_partkey", "block"))).alias("blocks"))
    return joined.select("page_id", F.concat(F.lit("<html><body>"), F.array_join("blocks.block", "\n"), F.lit("</body></html>")).alias("html"))


@query(
    "product_listings",
    f"""SELECT p_partkey // 20 AS page_id,
            p_name || ' & ' || CASE p_partkey % 3 WHEN 0 THEN '15 "x" ' WHEN 1 THEN '17 ' ELSE '' END || p_type AS "Description",
            CASE WHEN p_size = 10 OR p_size = 17 OR p_size = 19 THEN 0.0E0
                 ELSE CAST('2' || CAST(600 + p_size AS STRING) || '.' || CAST(10 + p_partkey % 90 AS STRING) AS DOUBLE) END AS "Price",
            p_partkey % 4 IN (0, 1) AS "Prime Product",
            CASE p_partkey % 3 WHEN 1 THEN 'https://other.example/dp/' ELSE '{BASE}dp/' END || p_partkey || '?a=1&b=2' AS "URL",
            CASE WHEN p_partkey % 7 = 0 THEN 0.0E0 ELSE p_partkey % 5 + 0.5E0 END AS "Stars",
            CAST(CASE WHEN p_partkey % 11 = 0 THEN 0 ELSE 1100 + p_size END AS BIGINT) AS "Reviews"
        FROM part WHERE p_size <> 29 AND p_size <> 13""",
)
def product_listings(spark: SparkSession, folder: str) -> DataFrame:
    return extract.product_listings(listing_pages(spark, folder), "html", BASE, ["page_id"]).drop("block_no")


@query(
    "absolute_links",
    f"""WITH links AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages
            UNION ALL SELECT page_id, url FROM pages)
        SELECT page_id, CASE WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN href WHEN href LIKE '//%' THEN 'https:' || href
            WHEN href LIKE '/%' THEN '{BASE[:-1]}' || href ELSE '{BASE}' || href END AS link FROM links""",
)
def absolute_links(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages")
    hrefs = pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("href"))
    links = hrefs.unionByName(pages.select("page_id", F.col("url").alias("href")))
    return links.select("page_id", h.absolute_url(F.col("href"), BASE).alias("link"))


@query(
    "redirect_links",
    f"""SELECT page_id, CASE page_id % 3 WHEN 0 THEN '{BASE}?url=' || url || '/ref=sr_1_2?'
            WHEN 1 THEN 'https://ads.example?url=' || url || '/ref=sr_1_2?' END AS link FROM pages""",
)
def redirect_links(spark: SparkSession, folder: str) -> DataFrame:
    wrapped = F.expr(
        "CASE page_id % 3 WHEN 0 THEN '/gp/redirect?k=1&url=' || url_encode(url) || '&url=second#f' "
        "WHEN 1 THEN 'https://ads.example/gp?url=' || url_encode(url) ELSE url END"
    )
    return table(spark, folder, "pages").select("page_id", h.unwrap_redirect(wrapped, BASE).alias("link"))
