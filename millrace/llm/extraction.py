"""Main text of web pages by composite text density.

Every node of a page's tree gets its characters and tags, with those in links set against it; the
node whose children's densities add up to most holds the article, or a part of it: where branches
beside it are as dense as the sparsest node on the way to the body, the node above them all holds it.
Marked articles with most of the text stand for themselves. Names of elements decide only over
branches that are small or sparse.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.chunks import slices

# HTML element names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes plaintext".split())
BLOCKS = frozenset(
    "address article aside blockquote body br center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
# Elements that hold no article text whatever their density is.
NEVER = frozenset(
    "script style noscript template title head nav header footer aside form button select option input textarea label fieldset "
    "menu dialog iframe object embed svg canvas audio video map".split()
)
# An open p ends where one of these begins; an open item of a list or table ends at the next one.
ENDS_P = BLOCKS - {"br"}
ENDS_OWN = {k: frozenset(v.split()) for k, v in {"li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option"}.items()}
SCOPE = frozenset("table ul ol dl div article section main aside nav header footer form body html td th blockquote".split())
# Generic containers: what stands around an article comes in these, and so do an article's own parts.
CONTAINERS = frozenset("div section center ul ol dl table details".split())
PARTS = frozenset("div section center".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# Names, or parts of names between hyphens, in class, id and role of what stands around an article.
AROUND_PARTS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr popup modal "
    "sidebar related recommended share sharing social newsletter subscribe comment comments replies disqus nav navbar navigation menu "
    "breadcrumb breadcrumbs pagination pager masthead".split()
)
AROUND_NAMES = frozenset(
    "header footer site-header site-footer page-header page-footer notice notification alert overlay side aside widget search login "
    "signup toc toolbar hidden copyright respond reply complementary contentinfo".split()
)
READERS = frozenset("comment comments replies reply disqus".split())
# Parts that say nothing of their own beside one of the above.
PLAIN_PARTS = frozenset(
    "list box bar block wrap wrapper container section area inner outer slot unit left right top bottom main primary secondary site page "
    "global links link buttons button icons items item posts post stories form thread notice".split()
)
UNLIKE = frozenset("has with no without".split())
ATTRIBUTES = r"""(?:[\s/]++|=|[^\s/>=]++(?:\s*+=\s*+(?:"[^"]*+"?+|'[^']*+'?+|[^\s>]*+))?+)*+"""
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)"
    rf"|<([a-zA-Z][^\s/>]*)({ATTRIBUTES})(?:>|\Z)",
    re.S,
)
# A quote opens a value only after an equals sign.
ATTRIBUTE = re.compile(r"""([^\s/>=]++)(?:\s*+=\s*+(?:"([^"]*+)"?+|'([^']*+)'?+|([^\s>]*+)))?+""")
NOT_SHOWN = re.compile(r"(?:^|;)\s*display\s*:\s*none\s*(?:!\s*important\s*)?(?:;|$)")
# How sure a name is: of nothing, of a branch that is not dense either, of a branch, of readers' comments.
NEUTRAL, WEAK, STRONG, COMMENTS = range(4)


@dataclass(eq=False)
class Node:
    tag: str
    parent: Node | None
    named: int = NEUTRAL
    children: list = field(default_factory=list)
    out: bool = False
    chars: int = 0
    tags: int = 0
    link_chars: int = 0
    link_tags: int = 0
    density: float = 0.0
    density_sum: float = 0.0

    @property
    def plain_chars(self) -> int:
        return self.chars - self.link_chars

    def nodes(self) -> list[Node]:
        return [c for c in self.children if isinstance(c, Node) and not c.out]


@lru_cache(maxsize=4096)
def around(tag: str, names: str) -> int:
    """How sure an element's names are that it is not part of the article."""
    found = NEUTRAL
    for name in names.lower().split():
        name = name.replace("_", "-")
        parts = [p for p in name.split("-") if p]
        if not parts or parts[0] in UNLIKE:
            continue
        if tag in ("html", "body", "main", "article"):
            found = max(found, COMMENTS if tag == "article" and READERS.intersection(parts) else NEUTRAL)
            continue
        telling = AROUND_PARTS.intersection(parts)
        whole = name in AROUND_NAMES or (telling and all(p in AROUND_PARTS or p in PLAIN_PARTS or p.isdigit() for p in parts))
        if whole:
            found = max(found, COMMENTS if READERS.intersection(parts) else STRONG)
        elif telling:
            found = max(found, WEAK)
    return found


def named(tag: str, attributes: str) -> int:
    """The same from an element's attributes; hidden ones are as sure as a whole name."""
    names, hidden, seen = "", False, set()
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), a or b or c
        if name in seen:
            continue
        seen.add(name)
        if name in ("class", "id", "role"):
            names += " " + value
        elif name == "hidden" or (name == "aria-hidden" and value.strip().lower() == "true") or (name == "style" and NOT_SHOWN.search(value.lower())):
            hidden = True
    return max(around(tag, names) if names else NEUTRAL, STRONG if hidden else NEUTRAL)


class _Open:
    """The open elements, and how many of each name there are in the innermost scope and in all, so
    that an end tag without its element costs no walk."""

    def __init__(self, root: Node) -> None:
        self.nodes, self.total = [root], Counter()
        self.holders, self.scopes = [root], [Counter()]

    def push(self, node: Node) -> None:
        self.nodes.append(node)
        self.total[node.tag] += 1
        if node.tag in SCOPE:
            self.holders.append(node)
            self.scopes.append(Counter())
        else:
            self.scopes[-1][node.tag] += 1

    def pop(self) -> Node:
        node = self.nodes.pop()
        self.total[node.tag] -= 1
        if node.tag in SCOPE:
            self.holders.pop()
            self.scopes.pop()
        else:
            self.scopes[-1][node.tag] -= 1
        return node

    def end(self, tag: str) -> None:
        """An end tag. That of an inline element doesn't reach out of the block it is in."""
        if (self.total if tag in BLOCKS else self.scopes[-1])[tag]:
            while self.pop().tag != tag:
                pass

    def imply(self, tags: frozenset[str]) -> None:
        """The end tags that the beginning of another element implies."""
        if any(self.scopes[-1][t] for t in tags) or (len(self.holders) > 1 and self.holders[-1].tag in tags):
            while self.pop().tag not in tags:
                pass


P = frozenset({"p"})


def tree(page: str) -> Node:
    """The elements of a page, with texts as strings among the children. Unclosed and misnested tags
    are closed as browsers do for paragraphs and items; markup that never ends is left out."""
    root = Node("html", None)
    opened, at, lower = _Open(root), 0, None
    while True:
        found = TOKEN.search(page, at)
        children = opened.nodes[-1].children
        if found is None:
            if at < len(page):
                children.append(page[at:])
            return root
        if found.start() > at:
            children.append(page[at : found.start()])
        at = found.end()
        closing, opening = found.group(1), found.group(2)
        if closing:
            tag = closing.lower()
            if tag == "br":
                children.append(Node("br", opened.nodes[-1]))
            else:
                opened.end(tag)
        elif opening:
            tag, attributes = opening.lower(), found.group(3)
            if tag == "html":
                continue
            if tag in ENDS_P:
                opened.imply(P)
            if tag in ENDS_OWN:
                opened.imply(ENDS_OWN[tag])
            child = Node(tag, opened.nodes[-1], named(tag, attributes) if attributes else NEUTRAL)
            opened.nodes[-1].children.append(child)
            if tag in RAW:
                lower = page.lower() if lower is None else lower
                end = lower.find(f"</{tag}", at)
                child.children.append(page[at : end if end >= 0 else len(page)])
                at = len(page) if end < 0 else (page.find(">", end) + 1 or len(page))
            elif tag not in VOID:
                opened.push(child)


def _post_order(root: Node) -> list[Node]:
    """The nodes that are not left out, in page order, children first."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack.extend(node.nodes())
    order.reverse()
    return order


def _own(node: Node) -> int:
    return sum(len("".join(c.split())) for c in node.children if isinstance(c, str))


def count(root: Node) -> list[Node]:
    """Set the numbers of characters and tags of all nodes that are not left out; children come first."""
    order = _post_order(root)
    for node in order:
        kids = node.nodes()
        node.chars = _own(node) + sum(c.chars for c in kids)
        node.tags = len(kids) + sum(c.tags for c in kids)
        in_link = node.tag == "a"
        node.link_chars = node.chars if in_link else sum(c.link_chars for c in kids)
        node.link_tags = node.tags if in_link else sum(c.link_tags + (c.tag == "a") for c in kids)
    return order


def leave_out(root: Node) -> None:
    """Mark what is left out whatever its density is.

    Elements such as menus and scripts go. Names and hidden elements decide only over the smaller part
    of a page: a branch with more than half of all unlinked text stays, unless a marked article beside
    it has text. Readers' comments may be longer than the article; they stay if hardly anything else
    is there. The same holds for a form around the whole page.
    """
    stack = [root]
    while stack:
        node = stack.pop()
        node.out = node.tag in NEVER and node.tag != "form"
        if not node.out:
            stack.extend(c for c in node.children if isinstance(c, Node))
    order = count(root)
    marked = Counter()
    for node in order:
        own = node.tag in ("article", "main") and node.plain_chars > 0 and node.named != COMMENTS
        marked[id(node)] = own + sum(marked[id(c)] for c in node.nodes())
    whole, all_marked = root.plain_chars, marked[id(root)]
    for node in order:
        doubtful = STRONG if node.tag == "form" else node.named
        if doubtful >= STRONG:
            beside = all_marked > marked[id(node)]
            enough = 10 * (whole - node.plain_chars) < whole if doubtful == COMMENTS else 2 * node.plain_chars > whole
            node.out = beside or not enough


def measure(root: Node) -> list[Node]:
    """Set the densities of all nodes; parts that are left out count for none. Children come first."""
    order = count(root)
    ratio = root.link_chars / max(root.chars, 1)
    for node in order:
        node.density = composite(node, ratio)
    for node in order:
        node.density_sum = sum(c.density for c in node.nodes()) + (own_density(node) if any(isinstance(c, str) and c.strip() for c in node.children) else 0.0)
    return order


def composite(node: Node, body_ratio: float) -> float:
    """Characters per tag, times a logarithm that falls with the share and number of links."""
    if not node.chars:
        return 0.0
    tags, links, link_tags = max(node.tags, 1), node.link_chars, max(node.link_tags, 1)
    plain = max(node.chars - links, 1)
    base = math.log(node.chars / plain * links + body_ratio * node.chars + math.e)
    inside = node.chars / max(links, 1) * tags / link_tags
    return node.chars / tags * max(math.log(max(inside, 1.0)) / max(math.log(base), 1.0), 0.0) if links else node.chars / tags * math.log(math.e + node.chars) / max(math.log(base), 1.0)


def own_density(node: Node) -> float:
    """The density of the text that stands in a node itself, as if it were a child without tags."""
    own = _own(node)
    return own * math.log(math.e + own) if node.tag != "a" else 0.0


def _linked(node: Node) -> bool:
    return 2 * node.link_chars > node.chars


def _outermost(nodes: list[Node]) -> list[Node]:
    """Those of the nodes, given children first, that lie in no other of them; in page order."""
    chosen, out = {id(n) for n in nodes}, []
    for node in nodes:
        up = node.parent
        while up is not None and id(up) not in chosen:
            up = up.parent
        if up is None:
            out.append(node)
    return out


def _threshold(best: Node) -> float:
    """The least density on the way from a node to the body."""
    threshold, up = best.density, best.parent
    while up is not None and up.parent is not None:
        threshold, up = min(threshold, up.density), up.parent
    return threshold


def article(root: Node) -> tuple[list[Node], float, set[int]]:
    """The nodes that make up the article, in page order; the least density on the way from it to the
    body; and the branches within that are not part of it.

    Marked articles that hold most of the unlinked text are the article, all those that are as dense
    as the way to the fullest. Otherwise it is the node with the largest density sum, or the one above
    it that holds all branches as dense as its path to the body.
    """
    leave_out(root)
    order = measure(root)
    for tag in ("article", "main"):
        marked = _outermost([n for n in order if n.tag == tag and n.chars])
        if marked and 2 * sum(n.plain_chars for n in marked) > root.plain_chars:
            fullest = max(marked, key=lambda n: n.plain_chars)
            threshold = _threshold(fullest)
            kept = [n for n in marked if n is fullest or (n.density >= threshold and not _linked(n))]
            return kept, threshold, set()
    best = max(order, key=lambda n: (n.density_sum, n.chars))
    threshold = _threshold(best)
    dense: set[int] = set()
    for node in order:
        reaches = node.tag in BLOCKS and node.density >= threshold and not _linked(node)
        if reaches or any(id(c) in dense for c in node.nodes()):
            dense.add(id(node))
    top, node, up = best, best, best.parent
    while up is not None:
        if own_density(up) >= threshold or any(c is not node and id(c) in dense for c in up.nodes()):
            top = up
        node, up = up, up.parent
    return [top], threshold, _edges(best, top, dense, threshold)


def _edges(best: Node, top: Node, dense: set[int], threshold: float) -> set[int]:
    """Branches at the edges of an unmarked article: containers made of links, and those before its
    first dense branch or after its last that are not dense themselves."""
    dropped: set[int] = set()
    on_path, node = [], best
    while node is not top:
        node = node.parent
        on_path.append(node)
    inside = dense | {id(n) for n in (best, *on_path)}
    whole_page = best.tag in ("body", "html")
    for level in [best, *on_path]:
        kids = level.nodes()
        outside = level is not best or whole_page
        full = [i for i, c in enumerate(kids) if id(c) in inside]
        leaf = {kids[i].tag for i in full if _own(kids[i])}
        for i, child in enumerate(kids):
            if child.tag not in CONTAINERS or id(child) in inside:
                continue
            edge = bool(full) and not full[0] < i < full[-1]
            if outside:
                gone = (_linked(child) and child.density < threshold) or (edge and child.tag in PARTS and not (child.tag in leaf and _own(child)))
            else:
                gone = child.tag in PARTS and edge and 10 * child.link_chars >= 9 * child.chars > 0
            if gone:
                dropped.add(id(child))
    return dropped


def blocks(node: Node, threshold: float, dropped: set[int]) -> Iterator[str]:
    """Texts of a node's blocks in page order, without what is left out or dropped and without blocks
    that some part of a name speaks against and that are less dense than the threshold."""
    line: list[str] = []

    def ended() -> Iterator[str]:
        text = " ".join(html.unescape("".join(line)).split())
        line.clear()
        if text:
            yield text

    stack: list = [node]
    while stack:
        item = stack.pop()
        if isinstance(item, str):
            line.append(item)
        elif item is None:
            yield from ended()
        else:
            block = item.tag in BLOCKS
            doubtful = item.named == WEAK and block and item.tag not in HEADINGS and item.density < threshold
            if item is not node and (item.out or id(item) in dropped or doubtful):
                if block:
                    yield from ended()
                continue
            if block:
                yield from ended()
                stack.append(None)
            stack.extend(reversed(item.children))
    yield from ended()


def main_text(page: str) -> str:
    """The article of one page; empty if there is none."""
    parts, threshold, dropped = article(tree(page))
    return " ".join(text for part in parts if part.chars for text in blocks(part, threshold, dropped))


def extract(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """``page_id, url, text, n_chars`` for each row; ``n_chars`` counts code points.

    Character references are decoded, white space inside a block becomes one space, and blocks are
    joined by one space in page order. Menus, page headers and footers, sidebars, notices, adverts,
    forms, scripts, styles and comments are left out. Null and empty pages give an empty text; equal
    rows give equal results; null ids and urls are kept; other columns are ignored.
    """

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in slices(batches, "html"):
            texts = [main_text(p) for p in table["html"].to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [table["page_id"].combine_chunks(), table["url"].combine_chunks(), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"))
    return rows.mapInArrow(extracted, f"page_id {dict(rows.dtypes)['page_id']}, url string, text string, n_chars long")
