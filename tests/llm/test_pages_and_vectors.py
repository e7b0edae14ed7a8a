"""WARC, extraction, licences and vector searches on odd rows and against brute force."""

import math
import re
import textwrap
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.llm import extraction, licences, neighbours, topk, warc
from tests.conftest import DATA
from tests.llm import odd

# --- WARC -----------------------------------------------------------------------------------------

BODIES = ["first " * 30, "second " * 40, "third\r\n\r\nWARC/1.1\r\nnot a record " * 20, "", "é" * 100]


def archive(compressed):
    records = [warc.record(i, f"http://x/{i}", b.encode(), None, False) for i, b in enumerate(BODIES)]
    return [warc.gzip_member(r) if compressed else r for r in records]


def read(data):
    return list(warc.entries(warc.Source(pa.BufferReader(data))))


def payloads(found):
    return [e[4].decode() for e in found if e[0] == "record"]


@pytest.mark.parametrize("compressed", [True, False])
def test_whole_archive_comes_back(compressed):
    found = read(b"".join(archive(compressed)))
    assert payloads(found) == BODIES and not [e for e in found if e[0] == "gap"]
    assert read(b"") == []


@pytest.mark.parametrize("compressed", [True, False])
@pytest.mark.parametrize("damage", ["flip", "cut", "noise", "length", "start", "end"])
def test_later_records_are_recovered_and_gaps_logged(compressed, damage):
    parts = archive(compressed)
    sizes = [len(p) for p in parts]
    at = sum(sizes[:1])
    lost, noise = {1}, b"\x1f\x8b\x08 WARC/1.1\r\n junk" * 3
    if damage == "flip":
        middle = len(parts[1]) - 30
        parts[1] = parts[1][:middle] + bytes([parts[1][middle] ^ 0x55]) + parts[1][middle + 1 :]
    elif damage == "cut":
        parts[1] = parts[1][: len(parts[1]) // 2]
    elif damage == "noise":
        parts.insert(1, noise)
        lost = set()
    elif damage == "length":
        parts[1] = b"WARC/1.1\r\nContent-Length: 99999999\r\n\r\n" + parts[1][20:] if not compressed else parts[1][:-8] + b"\0" * 8
    elif damage == "start":
        parts.insert(0, noise)
        at, lost = 0, set()
    else:
        parts[-1] = parts[-1][:-7]
        at, lost = sum(sizes[:-1]), {len(BODIES) - 1}
    data = b"".join(parts)
    found = read(data)
    assert payloads(found) == [b for i, b in enumerate(BODIES) if i not in lost]
    gaps = [(e[1], e[2], e[5]) for e in found if e[0] == "gap"]
    assert gaps[0][0] == at and all(g[2] for g in gaps)
    # Records and gaps cover every byte once.
    covered = sorted((e[1], e[1] + e[2]) for e in found)
    assert covered[0][0] == 0 and covered[-1][1] == len(data) and all(a[1] == b[0] for a, b in zip(covered, covered[1:]))


def digested(body, value):
    head = f"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Block-Digest: {value}\r\nContent-Length: {len(body)}\r\n\r\n".encode()
    return head + body + b"\r\n\r\n"


def test_digests_of_other_kinds():
    import base64
    import hashlib

    body = b"some payload " * 9
    written = [("md5", lambda d: d.hex()), ("sha1", lambda d: base64.b32encode(d).decode()), ("SHA-256", lambda d: d.hex().upper()), ("sha512", lambda d: base64.b64encode(d).decode())]
    for kind, write in written:
        value = f"{kind}:{write(hashlib.new(kind.lower().replace('-', ''), body).digest())}"
        good, bad = digested(body, value), digested(body[:-1] + b"X", value)
        found = read(good + bad + good)
        assert [(e[0], e[5]) for e in found] == [("record", None), ("gap", "block digest"), ("record", None)]
    (odd_one,) = read(digested(body, "whirl:abc"))
    assert odd_one[0] == "record" and odd_one[5] == "unchecked block digest"


def test_archives_of_odd_pages(spark, tmp_path):
    same = "x" * 200
    rows = [(1, "http://a", same), (2, None, same), (2, None, same), (3, "http://b\r\nX: y", "tiny"), (4, "é", "tiny"), (5, "u", None), (None, "u", same), (6, "u", "é" * 70_000)]
    pages = spark.createDataFrame([(i, u, h, "x", 1) for i, u, h in rows], "page_id long, url string, html string, digest string, id int")
    made = warc.write_archives(pages, "page_id", "url", "html", str(tmp_path / "a"), archive_bytes=300)
    found = warc.read_archives(made)
    assert found.filter("kind = 'gap'").count() == 0 and found.count() == len(rows)
    got = sorted(tuple(r) for r in warc.resolved(found, "bigint").select("id", "record_type", "payload_bytes", "refers_to").collect() if r.id is not None)
    assert got == [(1, "response", 200, None), (2, "revisit", 200, 1), (2, "revisit", 200, 1), (3, "response", 4, None), (4, "response", 4, None), (5, "response", 0, None), (6, "response", 140_000, None)]
    empty = warc.write_archives(pages.limit(0), "page_id", "url", "html", str(tmp_path / "b"))
    assert warc.resolved(warc.read_archives(empty), "bigint").count() == 0
    plain = warc.write_archives(pages, "page_id", "url", "html", str(tmp_path / "c"), compressed=False)
    assert warc.read_archives(plain).filter("kind = 'record'").count() == len(rows)


# --- extraction -----------------------------------------------------------------------------------

ARTICLE = "<h1>A title</h1><p>First paragraph of the article with enough words to be dense &amp; long.</p><p>Second one,<br>with a <a href='x'>link</a> in it and more\n  words.</p><ul><li>one<li>two</ul>"
TEXT = "A title First paragraph of the article with enough words to be dense & long. Second one, with a link in it and more words. one two"
AROUND = [
    "<nav><ul><li><a href=1>Home</a><li><a href=2>News</a></ul></nav>{}<footer>&copy; me, all rights reserved</footer>",
    "<header class='site-header'><h1>Site</h1></header><div class='layout has-sidebar'><div class='content'>{}</div><aside>More stories here</aside></div>",
    "<div class='cookie-notice'>We use cookies. Please accept them all now.</div><main>{}</main><form><label>Name</label><input></form>",
    "<script>var t='</p>';</script><style>p{{x}}</style><!-- <p>gone</p> --><article>{}</article><section id='comments'><p>Great post, thanks! I liked it very much indeed, it was long.</p></section>",
    "<div id=page><div class=menu><a href=1>one</a> <a href=2>two</a></div><div class=post>{}</div><div class='ad banner'>Buy this now</div></div>",
    "{}",
]


@pytest.mark.parametrize("around", AROUND)
def test_article_without_its_surroundings(around):
    page = "<!DOCTYPE html><html><head><title>T</title></head><body>" + around.format(ARTICLE) + "</body></html>"
    assert extraction.main_text(page) == TEXT


PARAGRAPHS = [f"{name} " + "words of the story go on and on here, " * 8 + "end." for name in "one two three four five six".split()]
NAV = "<div><a href=1>Home page</a> <a href=2>News of today</a> <a href=3>All the rest of it</a></div>"


ONE = "".join(f"<p>{p}</p>" for p in PARAGRAPHS)
NOTICE = "<div>We use cookies. Accept them.</div>"


@pytest.mark.parametrize("around", [
    "{}{}", "<div>{}</div><div>{}</div>", "<div><section>{}</section></div><h2>Next part</h2><div><div>{}</div></div>", "<article>{}</article><article>{}</article>",
    "<div>{}</div><p>Next part</p><div>{}</div>", "<div>{}</div><div>{}</div>" + NOTICE, NOTICE + "<article>{}</article><article>{}</article>" + NOTICE,
    "<div class=post>{}{}</div>", "<section><div>{}</div><div>Next part</div><div>{}</div></section>",
])
def test_article_in_several_sections(around):
    first, second = ["".join(f"<p>{p}</p>" for p in part) for part in (PARAGRAPHS[:3], PARAGRAPHS[3:])]
    text = extraction.main_text(f"<html><body>{NAV}{around.format(first, second)}{NAV}</body></html>")
    assert text == " ".join(PARAGRAPHS[:3] + ["Next part"] * ("Next" in around) + PARAGRAPHS[3:])


@pytest.mark.parametrize("page", [
    f'<div style="overflow: hidden ; color:red">{ONE}</div>', f'<div class="page menu-open">{ONE}</div>', f'<div class="image-share-card">{ONE}</div>', f"<p it's>{ONE}",
    f"<p a='x>y' b = \"it's\" c=d/e/>{ONE}", f"<form id=x>{ONE}</form>", f'<div class="content sidebar-page">{ONE}</div>', f'<div style="color:red; DISPLAY : none">gone away</div><div>{ONE}</div>',
    f"<div hidden>gone</div>{ONE}", f"<div aria-hidden='true'>gone</div><div>{ONE}</div>", f"<a title=\"the hidden valley\"></a>{ONE}", f"<div hidden>{ONE}</div>",
    f"<div class=post>{ONE}<section id=comments>{ONE}{ONE}</section></div>", f"<article>{ONE}<div class='share-buttons'>Share this with friends</div></article>",
    f"<article>{ONE}<div class='author-ad-note'>Short</div></article>", f"<main><article>{ONE}</article><div>Neutral words</div></main>",
])
def test_names_and_attributes_do_not_overrule_density(page):
    assert extraction.main_text(f"<html><body>{NAV}{page}<footer>foot</footer></body></html>") == " ".join(PARAGRAPHS)


@pytest.mark.parametrize("shell", ["<article>{}</article>", "<div class=post>{}</div>", "<main>{}</main>", "<div><div>{}</div></div>"])
def test_links_inside_an_article_are_kept(shell):
    references = "<ul>" + "".join(f"<li><a href=x>Reference number {i}</a></li>" for i in range(5)) + "</ul>"
    linked = "<p>See <a href=x>this very long link text here</a> ok.</p><p title='the hidden valley'>kept</p>"
    text = extraction.main_text(f"<html><body>{NAV}{shell.format(ONE + linked + references)}</body></html>")
    assert text == " ".join([*PARAGRAPHS, "See this very long link text here ok. kept", *(f"Reference number {i}" for i in range(5))])


def test_deep_nesting_takes_time_in_proportion():
    import time

    for page in ("<div>" * 20_000 + "x" + "</i>" * 20_000, "<i><div>" + "<b>" * 20_000 + "x" + "</i>" * 20_000, "<div>" + "<b>" * 9000 + "<tr>" * 9000 + "<td>" * 9000 + "</p>" * 9000 + "x"):
        started = time.process_time()
        assert extraction.main_text(page) == "x"
        assert time.process_time() - started < 5


def test_extraction_of_the_test_pages_and_odd_ones(spark):
    import html
    import re

    for r in spark.read.parquet(f"{DATA}/pages.parquet").collect():
        inside = re.search(r"<article>(.*?)(?:</article>|\Z)", r.html, re.S).group(1)
        inside = re.sub(r"</?(?:p|h1|br)[^>]*>", " ", inside)
        assert extraction.main_text(r.html) == " ".join(html.unescape(re.sub(r"</?(?:b|i|a|em)\b[^>]*>", "", inside)).split())
    rows = [(1, "u", ""), (2, None, None), (None, "u", "just text"), (3, "u", "<p>one<p>two"), (3, "u", "<p>one<p>two"), (4, "u", "<div " * 500 + "a > b"), (5, "u", "<p>x</p>" * 20_000), (6, "u", "<b>" * 5000 + "deep")]
    pages = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, text string")
    got = {r.page_id: r for r in extraction.extract(pages, "page_id", "url", "html").collect()}
    assert (got[1].text, got[2].text, got[None].text, got[3].text, got[6].text) == ("", "", "just text", "one two", "deep")
    assert got[5].n_chars == 2 * 20_000 - 1 and got[2].url is None
    assert extraction.extract(pages.limit(0), "page_id", "url", "html").count() == 0


# --- licences -------------------------------------------------------------------------------------


def test_headers_files_and_inheritance(spark):
    mit, gpl = "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3."
    rows = [
        (1, "a/LICENSE", mit), (2, "a/x.py", "code code code code code"), (3, "a/b/c/y.py", "more code"), (4, "a/b/COPYING", gpl),
        (5, "z.py", "no licence here"), (6, "a/b/w.py", f"text text text text text\n{mit}\nmore and more text text text"), (7, None, "x"), (8, "a/b/c/n.py", None), (9, "a/b/c/e.py", ""),
    ]
    files = spark.createDataFrame([(*r, "q") for r in rows], "i long, p string, t string, licence string")
    got = {r.id: (r.licence, r.basis, r.from_dir) for r in licences.scan(files, "i", F.col("p"), "t", licences.template_table(spark)).collect()}
    assert got == {
        1: ("MIT", "header", None), 2: ("MIT", "inherited", "a"), 3: ("GPL-3.0", "inherited", "a/b"), 4: ("GPL-3.0", "header", None), 5: (None, None, None),
        6: ("MIT", "header", None), 7: (None, None, None), 8: ("GPL-3.0", "inherited", "a/b"), 9: ("GPL-3.0", "inherited", "a/b"),
    }
    assert licences.scan(files.limit(0), "i", F.col("p"), "t", licences.template_table(spark)).count() == 0


def test_licence_files_of_many_paragraphs(spark):
    by_name = defaultdict(list)
    for name, text in licences.TEMPLATES:
        by_name[name].append(text)
    def wrapped(text, indent=""):
        return "\n".join(indent + line for line in textwrap.wrap(text, 70))
    bsd = max(by_name["BSD-3-Clause"], key=len)
    parts = re.split(r" (?=[123]\. |THIS SOFTWARE)", bsd)
    gpl = "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n" + wrapped(
        "Copyright (C) 2007 Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."
    ) + "\n\n                            Preamble\n\n" + wrapped("The GNU General Public License is a free, copyleft license for software and other kinds of works. " * 20)
    apache = "                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/\n\n" + wrapped("terms and conditions of use and reproduction " * 60)
    rows = [
        (1, "bsd/LICENSE", "Copyright (c) 2020, Some One\nAll rights reserved.\n\n" + "\n\n".join(map(wrapped, parts))),
        (2, "gpl/COPYING", gpl), (3, "apache/LICENSE.txt", apache), (4, "mpl/LICENSE", "Mozilla Public License Version 2.0\n==================================\n\n1. Definitions\n" + "word " * 300),
        (5, "un/UNLICENSE", "\n\n".join(wrapped(p) for p in re.split(r"(?<=\.) (?=[A-Z])", max(by_name["Unlicense"], key=len)))),
        (6, "isc/LICENSE.md", "ISC\n\n" + wrapped(max(by_name["ISC"], key=len))), (7, "mit/LICENSE", "The MIT License\n\nCopyright (c) 2021 Me\n\n" + wrapped(max(by_name["MIT"], key=len))),
        (8, "hdr/a.c", "/*\n" + wrapped(max(by_name["Apache-2.0"], key=len), " * ") + "\n */\nint main() { return 0; }\n" * 200), (9, "spdx/b.c", "// SPDX-License-Identifier: BSD-2-Clause\ncode"),
        (10, "gpl2/x.py", "# " + max((t for t in by_name["GPL-2.0"]), key=len) + "\nimport os\n" * 30),
        (11, "none/README", "How to get permission to enter the building, and who has the copyright of the drawings on its walls.\nNo more."),
    ]
    rows += [(100 + i, f"{path.split('/')[0]}/src/deep/file{i}.c", "int x;") for i, path, _ in rows]
    files = spark.createDataFrame(rows, "i long, p string, t string")
    got = {r.id: (r.licence, r.basis) for r in licences.scan(files, "i", F.col("p"), "t", licences.template_table(spark)).collect()}
    names = {1: "BSD-3-Clause", 2: "GPL-3.0", 3: "Apache-2.0", 4: "MPL-2.0", 5: "Unlicense", 6: "ISC", 7: "MIT", 8: "Apache-2.0", 9: "BSD-2-Clause", 10: "GPL-2.0"}
    assert {i: got[i] for i in range(1, 12)} == {i: (n, "header") for i, n in names.items()} | {11: (None, None)}
    assert {i: got[100 + i] for i in range(1, 8)} == {i: (names[i], "inherited") for i in range(1, 8)} and got[108][0] is None and got[111] == (None, None)


# --- vectors --------------------------------------------------------------------------------------


def brute(rows, take, score, k, zero):
    good = [(i, [float(x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and (zero or any(v))]
    out = []
    for q, a in sorted({(i, tuple(v)) for i, v in good if take(i)}):
        found = sorted((score(a, b), i) for i, b in good if i != q and len(a) == len(b))[:k]
        out += [(q, n + 1, i) for n, (_, i) in enumerate(found)]
    return out


def test_vector_searches_on_odd_rows(spark):
    table = odd.vectors(spark)
    rows = [(r.id, r.e) for r in table.collect()]
    near = neighbours.nearest(table, "id", "e", "vec_id % 100 = 0", k=3, cell_rows=2).orderBy("query_id", "rank").collect()
    distance = lambda a, b: math.sqrt(sum((x - y) ** 2 for x, y in zip(a, b)))
    wanted = brute(rows, lambda i: i % 100 == 0, distance, 3, False)
    # Copies of an id are one neighbour of the distance, as many times as they occur.
    assert [(r.query_id, r["rank"], r.vec_id) for r in near] == wanted
    best = topk.search(table, "id", "e", "vec_id % 50 = 0", k=3).orderBy("query_id", "rank").collect()
    product = lambda a, b: -sum(math.floor(256 * x) * math.floor(256 * y) for x, y in zip(a, b))
    assert [(r.query_id, r["rank"], r.vec_id) for r in best] == brute(rows, lambda i: i % 50 == 0, product, 3, True)
    for search in (neighbours.nearest, topk.search):
        assert search(odd.vectors(spark, empty=True), "id", "e", "vec_id % 50 = 0").count() == 0


def test_products_of_huge_components(spark):
    rows = [(0, [1e307, 1.0]), (1, [-1e307, 1.0]), (2, [2.0, 3.0]), (3, [1e307, 2.0]), (50, [1.0, 1.0])]
    found = topk.search(spark.createDataFrame(rows, "id long, e array<double>"), "id", "e", "vec_id % 50 = 0", k=2).collect()
    # Scores that are cut to the largest long tie.
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in found) == [(0, 1, 2), (0, 2, 3), (50, 1, 0), (50, 2, 3)]
    assert {r.score for r in found if r.query_id == 50} == {2**63 - 1}


def test_cells_searched_in_slices(spark, monkeypatch):
    draw = np.random.default_rng(2)
    data = draw.normal(size=(400, 4))
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "id long, e array<double>")
    monkeypatch.setattr(neighbours, "MOST_CELLS", 2)
    found = neighbours.nearest(table, "id", "e", "vec_id % 100 = 0", k=5, cell_rows=50).toPandas()
    for q, rows in found.groupby("query_id"):
        distances = np.sqrt(((data - data[q]) ** 2).sum(1))
        assert rows.sort_values("rank").vec_id.tolist() == [i for i in np.argsort(distances) if i != q][:5]


def test_neighbours_recall_and_scores(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(40, 24)) * 3
    data = (centres[rng.integers(0, 40, 3000)] + rng.normal(size=(3000, 24))).astype(np.float32)
    data[1500:1600] = data[0]
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "id long, e array<float>")
    found = neighbours.nearest(table, "id", "e", "vec_id % 100 = 0", k=10, cell_rows=200).toPandas()
    exact, hits = data.astype(float), 0
    for q, rows in found.groupby("query_id"):
        distances = np.sqrt(((exact - exact[q]) ** 2).sum(1))
        order = [i for i in np.lexsort((np.arange(3000), distances)) if i != q][:10]
        hits += len(set(order) & set(rows.vec_id))
        assert np.allclose(distances[rows.vec_id], rows.score, rtol=1e-12) and rows.sort_values("rank").score.is_monotonic_increasing
    assert hits / (30 * 10) >= 0.95 and len(found) == 300
    assert sorted(found[found.query_id == 0].vec_id) == list(range(1500, 1510))


def test_chi_square_and_bounds():
    assert neighbours.chi_square(neighbours.stop_ratio(0.95, 8), 8) == pytest.approx(0.95)
    assert neighbours.stop_ratio(0.95, 8) == pytest.approx(15.507, abs=1e-3)
    rng = np.random.default_rng(4)
    a, b = np.floor(256 * rng.normal(size=(50, 37))), np.floor(256 * rng.normal(size=(9, 37)))
    for n in topk.LEVELS:
        x, y = topk.statistics(a, n), topk.statistics(b, n)
        half = x.shape[1] // 2
        middle, wide = y[:, :half] @ x[:, :half].T, y[:, half:] @ x[:, half:].T
        assert (middle + wide + 1e-3 >= b @ a.T).all() and (middle - wide - 1e-3 <= b @ a.T).all()
    huge = np.array([[1e300, 1.0], [-1e300, 2.0], [5.0, 3.0], [1e300, 1.0]])
    assert [x[1] for x in topk.best_in_block(huge, np.arange(4), huge[:1], np.array([0]), 3)] == [2, 3, 1]
    large = np.array([[1e17, 3.0], [-1e17, 5.0]])
    assert topk._exact(large, np.array([10.0, 1.0])).tolist() == [10**18 + 3, -(10**18) + 5]
