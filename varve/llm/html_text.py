"""Main text of web pages by composite text density.

A page is read into a tree (unclosed paragraphs, list items, cells and raw-text elements
are closed as browsers do). For every node the characters and tags below it, and those
inside links, give its composite text density: characters per tag, times a logarithm of
characters per tag to a base that grows with the share of link text. A node's density sum
adds its children's densities. The node with the greatest sum is the core; the least
density on the path from it to the body is the threshold, and the highest node of that
path which is at least as dense as the threshold, and adds text as dense to the core, is
taken. Menus, headers and footers of the page, asides, forms, adverts, notices and reader
comments are cut out before by element (a form if it has fields, and is not wrapped
around the page's own paragraphs), by role, or by a class or id that says nothing
else; where the name may also be an article's own ("related", "share"), link density decides.

Reading is linear in the page's length (but for a logarithm), whatever its markup: open
elements are kept by name, so an end tag without a start costs nothing.

Output: character references decoded, white space inside a block turned to one space,
blocks trimmed and joined in page order by one line feed. Defined results: a null, empty
or wordless page gives the empty string; repeated rows are read alike; other columns are
ignored; a page without any body markup is read as text.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections.abc import Iterator
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varve.llm.common import small_batches, table

#: What may follow a "<"; where a tag ends, quoted values apart.
_TAG = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
_TAG_END = re.compile(r"""=\s*(["'])|>""")
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))|([^\s=/"'>]+)""")
_SPACE = re.compile(r"\s+")

#: HTML's element kinds.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template textarea title iframe svg".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td"
    " tfoot th thead tr ul".split()
)
#: A start tag closes these open elements, up to the given limits.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tr", "td", "th"}, {"table"}), "tfoot": ({"tbody", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select"}),
}
CUT_TAGS = frozenset("nav aside footer head button select input dialog menu audio video".split()) | RAW
#: A form that holds one of these is cut, unless it is wrapped around the page's paragraphs.
FIELDS, PARAGRAPHS = frozenset("input select textarea button".split()), frozenset("p article main".split())
CUT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar tablist".split())
#: A class or id made of these words (and of FILLERS) names what is no part of an article.
CUT_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising advertorial adsense adslot sponsor sponsored sponsors promo promos"
    " banner banners cookie cookies consent gdpr ccpa notice notices popup modal overlay newsletter subscribe signup paywall"
    " nav navbar navigation menu menus breadcrumb breadcrumbs crumbs sidebar sidebars aside widget widgets footer footnav"
    " masthead topbar comment comments disqus respond pagination pager login outbrain taboola".split()
)
#: These name links besides an article, or a part of it: cut if most of the text is in links.
LINK_WORDS = frozenset("related recommended recommendations trending popular share sharing social search side rail skip reply replies discussion notification subscription promotion".split())
FILLERS = frozenset("area bar block box container content inner items left links list main outer panel right section site slot text top bottom unit wrap wrapper".split())
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
_CLASS_WORD = re.compile(r"[a-z]+")


class Node:
    __slots__ = ("tag", "kids", "parent", "cut", "links", "chars", "tags", "link_chars", "link_tags", "density", "sum", "fields", "paragraphs")

    def __init__(self, tag: str, parent: Node | None, cut: bool, links: bool = False):
        self.tag, self.parent, self.cut, self.links = tag, parent, cut, links
        self.kids: list[Node | str] = []


def _named(value: str, words: frozenset[str]) -> bool:
    """One of the names is made of these words, fillers apart."""
    for name in value.split():
        found = set(_CLASS_WORD.findall(_CAMEL.sub(" ", name).lower()))
        if found - FILLERS and found <= words | FILLERS:
            return True
    return False


def _is_noise(tag: str, attributes: str, in_article: bool) -> tuple[bool, bool]:
    """No part of an article; and: none if it is mostly links."""
    if tag in CUT_TAGS or (tag == "header" and not in_article):
        return True, False
    links = False
    if not attributes or tag in ("html", "body", "article", "main"):
        return False, False
    for m in _ATTRIBUTE.finditer(attributes):
        name = (m.group(1) or m.group(5) or "").lower()
        value = m.group(2) or m.group(3) or m.group(4) or ""
        if name == "role" and value.lower() in CUT_ROLES:
            return True, False
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            return True, False
        if name == "style" and "display:none" in value.replace(" ", "").lower():
            return True, False
        if name in ("class", "id"):
            if _named(value, CUT_WORDS):
                return True, False
            links = links or _named(value, CUT_WORDS | LINK_WORDS)
    return False, links


class Reader:
    """Open elements as a stack, and by name the places in it (0 is the root)."""

    def __init__(self):
        self.root = Node("#root", None, False)
        self.stack: list[Node] = [self.root]
        self.open: dict[str, list[int]] = {}
        self.blocks: list[int] = []
        self.articles = 0

    def last(self, tag: str) -> int:
        at = self.open.get(tag)
        return at[-1] if at else 0

    def cut_to(self, at: int) -> None:
        """Closes the element at a place and all above it."""
        while len(self.stack) > at:
            tag = self.stack.pop().tag
            self.open[tag].pop()
            if tag in BLOCK:
                self.blocks.pop()
            self.articles -= tag in ("article", "main")

    def end(self, tag: str) -> None:
        at = self.last(tag)
        # An inline end tag does not close a block around it.
        if at and (tag in BLOCK or not self.blocks or at > self.blocks[-1]):
            self.cut_to(at)

    def start(self, tag: str, attributes: str) -> bool:
        """Adds the element; True if it stays open."""
        if tag in BLOCK and self.blocks and self.stack[self.blocks[-1]].tag == "p":
            self.cut_to(self.blocks[-1])  # a block closes an open paragraph
        if tag in CLOSES:
            what, limit = CLOSES[tag]
            floor, close = max(map(self.last, limit)), []
            for w in what:
                places = self.open.get(w, [])
                k = bisect_right(places, floor)
                close += places[k : k + 1]
            if close:
                self.cut_to(min(close))
        child = Node(tag, self.stack[-1], *_is_noise(tag, attributes, self.articles > 0))
        self.stack[-1].kids.append(child)
        if tag in VOID or tag in RAW or (attributes.endswith("/") and tag not in BLOCK):
            return False
        self.open.setdefault(tag, []).append(len(self.stack))
        if tag in BLOCK:
            self.blocks.append(len(self.stack))
        self.stack.append(child)
        self.articles += tag in ("article", "main")
        return True


class Finder:
    """str.find() that does not look again for what no later place has."""

    def __init__(self, text: str):
        self.text, self.gone = text, set()

    def __call__(self, what: str, at: int) -> int:
        if what in self.gone:
            return -1
        found = self.text.find(what, at)
        if found < 0:
            self.gone.add(what)
        return found


def _tag_end(html: str, at: int, find: Finder) -> int:
    """The place of the tag's ">": quoted values may hold others. Once no tag of the rest
    ends that way, the next one will do. -1 without any."""
    plain = find(">", at)
    while plain >= 0 and _TAG_END not in find.gone:
        m = _TAG_END.search(html, at)
        if m is None:
            find.gone.add(_TAG_END)
            break
        if m.group(1) is None:
            return m.start()
        close = find(m.group(1), m.end())
        # A quote that never ends is no quote.
        at = close + 1 if close >= 0 else m.end()
    return plain


def parse(html: str) -> Node:
    reader, at, n = Reader(), 0, len(html)
    find, ends = Finder(html), Finder(html.lower())
    if len(ends.text) != n:  # a letter that is two in lower case: places would differ
        ends = Finder(html)
    while at < n:
        start = find("<", at)
        if start < 0:
            reader.stack[-1].kids.append(html[at:])
            break
        m = None
        if html.startswith("<!--", start):
            stop = find("-->", start + 4)
            end = stop + 3 if stop >= 0 else n
        elif html.startswith(("<!", "<?"), start):
            stop = find(">", start)
            end = stop + 1 if stop >= 0 else n
        else:
            m = _TAG.match(html, start + 1) if find(">", start) >= 0 else None
            stop = _tag_end(html, m.end(), find) if m else -1
            if stop < 0:  # a bare "<", or a tag that does not end, is text
                reader.stack[-1].kids.append(html[at : start + 1])
                at = start + 1
                continue
            end = stop + 1
        if start > at:
            reader.stack[-1].kids.append(html[at:start])
        at = end
        if m is None:
            continue
        tag = m.group(2).lower()
        if m.group(1):
            reader.end(tag)
        elif not reader.start(tag, html[m.end() : stop]) and tag in RAW:
            close = ends(f"</{tag}", at)
            stop = find(">", close) if close >= 0 else -1
            at = stop + 1 if stop >= 0 else n
    return reader.root


def _add_up(order: list[Node]) -> None:
    """Characters, tags, links, fields and paragraphs below each node; what is mostly links is cut."""
    for node in reversed(order):
        chars = tags = link_chars = link_tags = fields = paragraphs = 0
        for k in node.kids:
            if isinstance(k, str):
                chars += len(_SPACE.sub(" ", k).strip()) if "&" not in k else len(_SPACE.sub(" ", unescape(k)).strip())
                continue
            fields += k.tag in FIELDS
            if not k.cut:
                chars, tags = chars + k.chars, tags + k.tags + (k.tag != "br")
                link_chars, link_tags = link_chars + k.link_chars, link_tags + k.link_tags
                fields, paragraphs = fields + k.fields, paragraphs + k.paragraphs + (k.tag in PARAGRAPHS)
        if node.tag == "a":
            link_chars, link_tags = chars, tags + 1
        node.chars, node.tags, node.link_chars, node.link_tags = chars, tags, link_chars, link_tags
        node.fields, node.paragraphs = fields, paragraphs
        node.cut = node.cut or node.links and link_chars * 2 > chars


def measure(root: Node) -> None:
    """Densities of all nodes, from the leaves up; no recursion, so depth has no limit."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack += [k for k in node.kids if isinstance(k, Node) and not k.cut]
    _add_up(order)
    body = next((n for n in order if n.tag == "body"), root)
    # Some pages stand in a form as a whole: that holds half of the text, and paragraphs.
    forms = [n for n in order if n.tag == "form" and n.fields and not (n.paragraphs and n.chars * 2 >= body.chars)]
    if forms:
        for form in forms:
            form.cut = True
        _add_up(order)
    share = body.link_chars / max(body.chars, 1)
    for node in reversed(order):
        # A node is in the order if it was not cut when it was read.
        c, t, lc, lt = node.chars, max(node.tags, 1), node.link_chars, max(node.link_tags, 1)
        if not c:
            node.density = node.sum = 0.0
            continue
        base = math.log(c / max(c - lc, 1) * lc + share * c + math.e)
        node.density = c / t * max(math.log(max(c * t / (max(lc, 1) * lt), 1.0) + 1e-9) / base, 0.0)
        node.sum = sum(k.density for k in node.kids if isinstance(k, Node) and not k.cut) or node.density


def core(root: Node) -> Node:
    """The subtree with the article."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack += [k for k in reversed(node.kids) if isinstance(k, Node) and not k.cut]
    best = max(order, key=lambda n: n.sum)
    path, up = [], best
    while up is not None and up.tag not in ("html", "#root"):
        path.append(up)
        up = up.parent
    if not path:
        return best
    threshold = min(n.density for n in path)
    # An article element around the core is all of it; else the path's dense part.
    for n in path:
        if n.tag in ("article", "main"):
            return n
    taken = best
    for n in path[1:]:
        added = n.chars - taken.chars
        if n.density < threshold or n.tag == "body" and added * 2 > n.chars:
            break
        if added and any(isinstance(k, Node) and not k.cut and k is not taken and k.chars and k.density < threshold and k.link_chars * 2 > k.chars for k in n.kids):
            break
        taken = n
    return taken


def render(node: Node) -> str:
    blocks: list[str] = []
    line: list[str] = []

    def close():
        text = _SPACE.sub(" ", "".join(line)).strip()
        if text:
            blocks.append(text)
        line.clear()

    stack: list = [node]
    while stack:
        x = stack.pop()
        if x is None:
            close()
        elif isinstance(x, str):
            line.append(unescape(x))
        elif not x.cut:
            if x.tag == "br":
                line.append(" ")
            elif x.tag in BLOCK:
                close()
                stack.append(None)
                stack += reversed(x.kids)
            else:
                stack += reversed(x.kids)
    close()
    return "\n".join(blocks)


def main_text(html: str | None) -> str:
    if not html or html.isspace():
        return ""
    root = parse(html)
    measure(root)
    return render(core(root))


def _extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        text = [main_text(h) for h in batch["html"]]
        yield pd.DataFrame({"page_id": batch["page_id"].astype("Int64"), "url": batch["url"], "text": text, "n_chars": [len(t) for t in text]})


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every row."""
    small_batches(pages.sparkSession)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"))
    return rows.mapInPandas(_extract, "page_id long, url string, text string, n_chars long")


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
