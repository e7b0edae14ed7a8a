from pyspark.sql import functions as F

from millrace.functions import html as h
from millrace.operators import extract

BASE = "https://shop.example/"
PAGE = """<div class="s-result-item-wide">not a block</div>
<div data-x="1" class="sg s-result-item big"><a class="a-link-normal s-no-outline" href="/dp/1?a=1&amp;b=2"></a>
<span class="a-size-base-plus a-color-base a-text-normal"> L'audio "x" <b>pro</b> &amp; co </span>
<span class="a-price-whole">1.234,56</span>
<i class="a-icon a-icon-prime a-icon-medium" role="img" aria-label="Amazon Prime"></i>
<i class="a-icon a-icon-star-small a-star-small-4 aok-align-bottom"><span class="a-icon-alt">4,0 su 5 stelle</span></i>
<span class="a-size-base s-underline-text"> 2.345 </span></div>
<div class="s-result-item"><a class="a-link-normal s-no-outline" href="x"></a> no description</div>
<div class="s-result-item"><span class="a-size-base-plus a-color-base a-text-normal">no link</span></div>
<div class="s-result-item"><a href="https://o.example/p" class="a-link-normal s-no-outline"></a>
<span class="a-size-base-plus a-color-base a-text-normal">15" screen</span><span class="a-price-whole">11.999</span>
<span class="a-size-base s-underline-text">abc</span></div>
<div class="s-result-item"><a class="a-link-normal s-no-outline" href="rel"></a>
<span class="a-size-base-plus a-color-base a-text-normal">plain</span><span class="a-price-whole">abc</span></div>"""


def test_product_listings(spark):
    df = spark.createDataFrame([(1, PAGE), (2, ""), (3, None)], "page_id long, html string")
    rows = [tuple(r) for r in extract.product_listings(df, "html", BASE, ["page_id"]).orderBy("block_no").collect()]
    assert rows == [
        (1, 0, 'Laudio "x" pro & co', 1234.56, True, BASE + "dp/1?a=1&b=2", 4.0, 2345),
        (1, 3, "15 screen", 0.0, False, "https://o.example/p", 0.0, 0),
        (1, 4, "plain", 0.0, False, BASE + "rel", 0.0, 0),
    ]


def test_star_icon_can_be_narrowed(spark):
    df = spark.createDataFrame([(PAGE,)], "html string")
    rows = extract.product_listings(df, "html", BASE, star_icon="a-star-small-4-5").collect()
    assert {r.Stars for r in rows} == {0.0}


def test_general_blocks(spark):
    df = spark.createDataFrame([(1, "<li>a=1</li><li>b</li>"), (2, "none")], "id long, html string")
    out = extract.extract_blocks(df, "html", "<li>.*?</li>", {"name": "<li>(\\w)", "value": "=(\\d)"}, ["id"])
    assert [tuple(r) for r in out.orderBy("block_no").collect()] == [(1, 0, "a", "1"), (1, 1, "b", None)]


def test_numbers(one):
    assert one(h.price, "string", "1.234,56", "11.999", "abc", "", None, "12") == [1234.56, 0.0, 0.0, 0.0, 0.0, 12.0]
    assert one(h.rating, "string", "4,5 su 5", "", None, "x y") == [4.5, 0.0, 0.0, 0.0]
    assert one(h.grouped_integer, "string", "1.234", "12", "1,5", None) == [1234, 12, 0, 0]


def test_quotes(one):
    assert one(h.drop_one_quote_kind, "string", "a'b\"c'", 'a"b', "ab", None) == ['ab"c', "ab", "ab", None]


def test_links(one):
    got = one(lambda x: h.absolute_url(x, BASE), "string", "/a", "a?b", "http://h/x", "//h/x", "mailto:z", None)
    assert got == [BASE + "a", BASE + "a?b", "http://h/x", "https://h/x", "mailto:z", None]


def test_redirects(one):
    unwrap = lambda x: h.unwrap_redirect(x, BASE)
    assert one(unwrap, "string", "/gp/r?k=1&url=%2Fdp%2F1+b&z=2#f", "https://h.example/p?url=https%3A%2F%2Fx%2Fy", "/a?curl=1", "/a", None) == [
        BASE + "?url=/dp/1 b/ref=sr_1_2?", "https://h.example?url=https://x/y/ref=sr_1_2?", None, None, None,
    ]


def test_extraction_is_free_of_python(spark):
    df = spark.createDataFrame([(PAGE,)], "html string").select(F.col("html"))
    plan = extract.product_listings(df, "html", BASE)._jdf.queryExecution().executedPlan().toString()
    assert "EvalPython" not in plan


def test_blocks_end_with_their_element_and_take_single_quotes(spark):
    one = """<div class='s-result-item'><div>x</div><a class='a-link-normal s-no-outline' href='/dp/1'></a>
        <span class='a-size-base-plus a-color-base a-text-normal'>Thing</span></div>"""
    page = f"<body>{one}<footer><span class='a-price-whole'>99,00</span></footer></body>"
    rows = extract.product_listings(spark.createDataFrame([(page,)], "html string"), "html", "https://x/").collect()
    assert [(r.Description, r.Price, r.URL) for r in rows] == [("Thing", 0.0, "https://x/dp/1")]
