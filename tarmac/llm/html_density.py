"""Main text of web pages by composite text density.

A page is read into a tree of elements (tolerant of tags left open, cut off or misnested). Every node gets its
characters, its characters inside links, its tags and its link tags, all over its subtree, and from these the
composite density: characters per tag, times a logarithm that falls as link text gains on other text. A node's
density sum adds the densities of its children. The threshold is the least density on the path from the body to
the node with the largest density sum (descending, where a child's own sum is the largest); from the body down, a
node whose density reaches it is followed, and the node with the largest density sum there is the content. Parts
that are never text (scripts, styles, forms, menus, headers, footers, asides, hidden blocks) weigh nothing and give no
text. So do blocks that a whole class, an id or a role names so (adverts, menus, notices, comments of readers), unless
they hold an article or main element, or most of the page's text outside links with no such element beside them; what
only mentions such a word (has-sidebar, page-with-toc, related-work) is left to the densities.

Text: character references are decoded, white space inside a block becomes one space, blocks are trimmed and joined
by a line feed in page order; nothing else is dropped and nothing is capped.

Cases: null html counts as empty and gives an empty text; a page without tags is one block; repeated rows are rows;
an empty table gives an empty result; extra columns pass through unless an output column has their name.
"""

from __future__ import annotations

import html
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarmac.llm.common import add_arrays, extended, replace_columns

# A quote opens a value only right after the equals sign; elsewhere it is a sign like any other.
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"""
                    r"""|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*(?:"[^"]*"|'[^']*')|[^>])*)(?:>|\Z)""", re.S)
_ATTR = re.compile(r"""([^\s>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.S)
_PARTS = re.compile(r"[-_]+|(?<=[a-z0-9])(?=[A-Z])")
_SPACE = re.compile(r"\s+")
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "template", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
SKIP = RAW | {"head", "nav", "header", "footer", "aside", "form", "button", "select", "option", "svg", "canvas",
              "menu", "dialog", "object", "audio", "video", "fieldset", "input", "math", "datalist"}
BLOCK = {"address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir",
         "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6",
         "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "search",
         "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
# Words that name a part outside the text, as a whole class, id or role or in a compound of NOT_TEXT and BOX words.
NOT_TEXT = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "banner", "sponsor", "sponsored",
            "promo", "promotion", "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "sidebar",
            "side", "widget", "footer", "masthead", "cookie", "cookies", "consent", "gdpr", "notice", "alert",
            "popup", "modal", "overlay", "newsletter", "subscribe", "subscription", "signup", "comment", "comments",
            "disqus", "respond", "reply", "replies", "share", "sharing", "social", "related", "recommended",
            "pagination", "pager", "toolbar", "skip", "complementary", "contentinfo", "search", "login", "toc"}
BOX = {"box", "block", "bar", "list", "area", "section", "wrapper", "wrap", "container", "inner", "outer", "panel", "unit",
       "slot", "links", "link", "buttons", "button", "item", "items", "form", "left", "right", "top", "bottom", "main",
       "site", "page", "global", "primary", "secondary", "footer", "header", "content", "posts", "articles", "thread"}
CLOSES = {  # an opening tag ends these open elements
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
    "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"},
    "tfoot": {"tbody", "tr", "td", "th"}}
HOLDS = {"ul", "ol", "dl", "table", "article", "section", "div", "body", "html", "blockquote", "aside", "nav",
         "footer", "header", "form", "main", "select", "menu"}  # implied ends do not reach beyond these


class Node:
    __slots__ = ("tag", "parent", "kids", "skip", "named", "chars", "link_chars", "tags", "link_tags", "density", "total")

    def __init__(self, tag: str, parent, skip: bool = False, named: bool = False):
        self.tag, self.parent, self.kids, self.skip, self.named = tag, parent, [], skip, named
        self.chars = self.link_chars = self.tags = self.link_tags = 0
        self.density = self.total = 0.0


def _names_no_text(name: str) -> bool:
    """A class, id or role that as a whole names a part outside the text."""
    low = name.lower()
    if low in NOT_TEXT:
        return True
    parts = [x.lower() for x in _PARTS.split(name) if x and not x.isdigit()]
    return any(x in NOT_TEXT for x in parts) and all(x in NOT_TEXT or x in BOX for x in parts)


def _outside(tag: str, attrs: str) -> tuple[bool, bool]:
    """Is an element never text or hidden; does its class, id or role name a part outside the text."""
    if tag in SKIP:
        return True, False
    if not attrs or tag in ("html", "body", "article", "main"):
        return False, False
    named, seen = False, set()
    for m in _ATTR.finditer(attrs):
        name = (m[1] or "").lower()
        if not name or name in seen:  # the first of repeated attributes counts
            continue
        seen.add(name)
        value = m[2] or m[3] or m[4] or ""
        if name == "hidden" or name == "aria-hidden" and value.strip().lower() == "true":
            return True, False
        if name == "style":
            if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                return True, False
        elif name in ("class", "id", "role"):
            named = named or any(map(_names_no_text, value.split()))
    return False, named


def _drop_named(root: Node) -> None:
    """Skip the named blocks, but for those that hold an article or main element, or most of the text outside links
    while no article or main element lies beside them."""
    nodes = _ordered(root)
    if not any(x.named for x in nodes):
        return
    plain, whole = {}, set()  # by node: characters outside links; holds an article or main element
    for node in reversed(nodes):
        n = 0
        for k in node.kids:
            if type(k) is str:
                n += len("".join(k.split()))
            elif not k.skip:
                n += plain[id(k)]
                if id(k) in whole or k.tag in ("article", "main"):
                    whole.add(id(node))
        plain[id(node)] = 0 if node.tag == "a" else n
    articles = {id(x) for x in nodes if x.tag in ("article", "main") and plain[id(x)]}
    for node in nodes:
        if node.named and id(node) not in whole:
            around, up = set(), node.parent
            if 2 * plain[id(node)] > plain[id(root)]:
                while up is not None:
                    around.add(id(up))
                    up = up.parent
                node.skip = not articles <= around
            else:
                node.skip = True


def parse(page: str) -> Node:
    """The element tree under a root node; the children of a node are strings and nodes."""
    root = Node("#root", None)
    cur, at, n = root, 0, len(page)
    find = _TOKEN.search
    while at < n:
        m = find(page, at)
        if m is None:
            cur.kids.append(_rest(page[at:]))
            break
        if m.start() > at:
            cur.kids.append(page[at:m.start()])
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            node = cur
            while node is not root and node.tag != tag:
                if tag not in BLOCK and node.tag in BLOCK:  # a stray inline end tag ends no block
                    node = root
                    break
                node = node.parent
            if node is not root:
                cur = node.parent
            elif tag == "p":  # an end tag alone is an empty paragraph
                cur.kids.append(Node("p", cur))
            continue
        if tag in BLOCK:  # a block ends an open paragraph
            node = cur
            while node is not root and node.tag not in HOLDS:
                if node.tag == "p":
                    cur = node.parent
                    break
                node = node.parent
        ends = CLOSES.get(tag)
        if ends:
            node = cur
            while node is not root and (node.tag in ends or node.tag not in HOLDS):
                if node.tag in ends:
                    cur = node.parent
                node = node.parent
        child = Node(tag, cur, *_outside(tag, m[3]))
        cur.kids.append(child)
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else n
        elif tag not in VOID and not m[0].endswith("/>"):
            cur = child
    _drop_named(root)
    return root


def _rest(tail: str) -> str:
    """The page's last text; a tag that was cut off is no text."""
    cut = tail.rfind("<")
    return tail[:cut] if cut >= 0 and re.match(r"<[/!?]?(?:[a-zA-Z][^>]*)?\Z", tail[cut:], re.S) else tail


def _ordered(root: Node) -> list[Node]:
    """All nodes that count, parents before children."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        out.append(node)
        todo += [k for k in reversed(node.kids) if type(k) is Node and not k.skip]
    return out


def measure(root: Node) -> list[Node]:
    """Counts, densities and density sums of all nodes that count."""
    nodes = _ordered(root)
    for node in reversed(nodes):
        for k in node.kids:
            if type(k) is str:
                node.chars += len("".join(k.split()))
            elif not k.skip:
                node.chars += k.chars
                node.link_chars += k.link_chars
                node.tags += k.tags + 1
                node.link_tags += k.link_tags + (k.tag == "a")
        if node.tag == "a":
            node.link_chars = node.chars
    body = next((x for x in nodes if x.tag == "body"), root)
    ratio = body.link_chars / max(body.chars, 1)
    for node in reversed(nodes):
        c, lc, t, lt = node.chars, node.link_chars, max(node.tags, 1), max(node.link_tags, 1)
        if c:
            plain = max(c - lc, 1)
            base = math.log(c / plain * lc + ratio * c + math.e)
            node.density = max(0.0, c / t * math.log(max(c / max(lc, 1) * t / lt, 1.0) + 1) / math.log(base + 1))
        node.total = sum(k.density for k in node.kids if type(k) is Node and not k.skip)
        if any(type(k) is str and not k.isspace() for k in node.kids):
            node.total += node.density  # its own text is a child too
    return nodes


def content(root: Node) -> Node:
    """The node that holds the main text."""
    nodes = measure(root)
    body = next((x for x in nodes if x.tag == "body"), root)
    inside = [x for x in _ordered(body) if x.chars]
    if not inside:
        return body
    best = max(inside, key=lambda x: x.total)
    path = [best]
    while path[-1] is not body:
        path.append(path[-1].parent)
    threshold = min((x.density for x in path), default=0.0)
    # Follow the dense nodes from the body; the largest density sum among them holds the text.
    dense, todo = [], [body]
    while todo:
        node = todo.pop()
        if node.density >= threshold:
            dense.append(node)
            todo += [k for k in reversed(node.kids) if type(k) is Node and not k.skip and k.chars]
    top = max(dense, key=lambda x: x.total, default=best)
    # Inline elements and lone paragraphs stand for the block around them; an article or main element is whole.
    while top is not body and (top.tag not in BLOCK or top.tag in ("p", "h1", "h2", "h3", "h4", "h5", "h6", "li")):
        top = top.parent
    node = top
    while node is not None and node.tag not in ("article", "main"):
        node = node.parent
    return node if node is not None else top


def blocks(node: Node) -> list[str]:
    """The texts of the node's blocks, in page order."""
    out, held = [], []

    def close():
        text = _SPACE.sub(" ", "".join(held)).strip()
        held.clear()
        if text:
            out.append(text)

    todo: list = [node]
    while todo:
        x = todo.pop()
        if x is None:
            close()
        elif type(x) is str:
            held.append(html.unescape(x))
        elif x.skip:
            held.append(" ")
        elif x.tag == "br":
            held.append(" ")
        else:
            block = x.tag in BLOCK
            if block:
                close()
                todo.append(None)
            todo += reversed(x.kids)
    close()
    return out


def main_text(page: str) -> str:
    return "\n".join(blocks(content(parse(page)))) if page else ""


def extract(pages: DataFrame) -> DataFrame:
    """``pages`` plus text and n_chars; the html column goes."""
    base = replace_columns(pages, ["text", "n_chars", "html", "__html"])

    def run(batches):
        for b in batches:
            texts = [main_text(p) for p in b.column(b.num_columns - 1).to_pylist()]
            yield add_arrays(b.select(b.schema.names[:-1]), text=pa.array(texts, pa.string()),
                             n_chars=pa.array(map(len, texts), pa.int64()))

    names = {c.lower(): c for c in pages.columns}
    given = F.coalesce(F.col(f"`{names['html']}`").cast("string"), F.lit(""))
    kept = pages.select(*[f"`{c}`" for c in base.columns], given.alias("__html"))
    return kept.mapInArrow(run, extended(base.schema, text=T.StringType(), n_chars=T.LongType()))
