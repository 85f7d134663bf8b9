"""Article text and titles of HTML pages.

One Arrow-batched function parses each page into its ordered blocks (tag and
text); everything after that, from cleaning to the word count, is native.
The tree follows a lenient parser that never closes an element by itself: an
unclosed <p> holds what follows it, so nested blocks show up in their parents
and again on their own.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache
from html.parser import HTMLParser
from urllib.parse import urlparse

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skald.functions.text import clean_text, count_words, let, normalize_heading, strip

# fixed values: what marks, fills and clutters an article on each kind of site
STOP_HEADINGS = ["ссылки", "литература", "примечания", "источники", "библиография", "см. также", "внешние ссылки", "список литературы", "комментарии", "справочные материалы"]
CONTROLS = ["править", "обсуждение", "страница обсуждения", "загрузить", "распечатать"]
ROOTS = {
    "wikipedia": ["div.mw-parser-output", "div#mw-content-text", "div#bodyContent"],
    "bre": ["div#content", "div.content", "div#text", "div.text", "div.article", "main article", "article", "main"],
}
CLUTTER = ["script", "style", "noscript", "header", "footer", "nav", "aside", "form", "button"]
CLUTTER_OF = {
    "wikipedia": ["table", ".infobox", ".navbox", ".sidebar", ".reflist", ".references", ".catlinks", ".mw-editsection", ".hatnote", ".dablink", ".thumb", ".metadata", ".ambox", ".noprint", ".printfooter", ".toc"],
    "bre": ["table", "figure", "figcaption", ".breadcrumbs", ".breadcrumb", ".share", ".social", ".socials", ".tags", ".tag", ".terms", ".media", ".gallery", ".annotation", ".abstract", ".bibliography", ".sources", ".versions", ".version", ".related", ".recommend", ".recommendations", ".sidebar", ".aside"],
}
BLOCKS = {"h1", "h2", "h3", "h4", "h5", "h6", "p", "li"}
VOID = set("area base basefont bgsound br col command embed frame hr image img input isindex keygen link menuitem meta nextid param source spacer track wbr".split())
SILENT = {"script", "style", "template", "rt", "rp"}
MIN_BLOCK = 30
UNTITLED = "Без названия"


_BLOCK = T.StructType([T.StructField("tag", T.StringType()), T.StructField("text", T.StringType())])
PARTS = T.StructType([T.StructField("title", T.StringType()), T.StructField("blocks", T.ArrayType(_BLOCK))])


class Node:
    """An element: children are nodes and strings."""

    __slots__ = ("tag", "attrs", "parent", "children")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    def walk(self) -> Iterator[Node]:
        """Descendant elements in document order."""
        todo = [c for c in reversed(self.children) if isinstance(c, Node)]
        while todo:
            node = todo.pop()
            yield node
            todo += [c for c in reversed(node.children) if isinstance(c, Node)]

    def text(self) -> str:
        """The stripped strings below, joined by blanks."""
        parts, todo = [], [self]
        while todo:
            node = todo.pop()
            if isinstance(node, str):
                if node := node.strip():
                    parts.append(node)
            elif node is self or node.tag not in SILENT:
                todo += reversed(node.children)
        return " ".join(parts)

    def matches(self, selector: str) -> bool:
        """tag, .class, tag.class, tag#id, or two of them with a blank between (an ancestor and the element)."""
        *above, own = _parsed(selector)
        if not self._simple(own):
            return False
        node = self.parent
        while above and node:
            if node._simple(above[-1]):
                above.pop()
            node = node.parent
        return not above

    def _simple(self, part: tuple[str, str, str]) -> bool:
        tag, kind, name = part
        if tag and self.tag != tag:
            return False
        if kind == ".":
            return name in self.attrs.get("class", "").split()
        return kind != "#" or self.attrs.get("id") == name


@cache
def _parsed(selector: str) -> tuple[tuple[str, str, str], ...]:
    return tuple(re.fullmatch(r"([^.#]*)([.#]?)(.*)", part).groups() for part in selector.split(" "))


@cache
def _clutter(kind: str) -> tuple[frozenset[str], frozenset[str]]:
    """Tags and classes of what is cut from a kind of page."""
    chosen = [*CLUTTER, *CLUTTER_OF.get(kind, []), "sup"]
    return frozenset(x for x in chosen if x[0] != "."), frozenset(x[1:] for x in chosen if x[0] == ".")


def _prune(node: Node, tags: frozenset[str], classes: frozenset[str]) -> None:
    """Cut clutter below node, in one walk."""
    todo = [node]
    while todo:
        top = todo.pop()
        kept = []
        for c in top.children:
            if isinstance(c, Node):
                own = c.attrs.get("class", "").split() if "class" in c.attrs else ()
                if c.tag in tags or (own and not classes.isdisjoint(own)) or (c.tag == "span" and "mw-editsection" in own):
                    continue
                todo.append(c)
            kept.append(c)
        top.children = kept


class _Builder(HTMLParser):
    """The tree of a page, and its elements by tag in document order."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.top = Tree()

    def handle_starttag(self, tag: str, attrs: list) -> None:
        node = Node(tag, {k: v or "" for k, v in reversed(attrs)} if attrs else {}, self.top)
        self.top.children.append(node)
        self.root.by_tag.setdefault(tag, []).append(node)
        if tag not in VOID:
            self.top = node

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag not in self.root.by_tag:
            return
        node = self.top
        while node.parent and node.tag != tag:
            node = node.parent
        if node.parent:
            self.top = node.parent

    def handle_data(self, data: str) -> None:
        self.top.children.append(data)

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        """Sections of unknown kinds are passed over up to the next >."""
        try:
            return super().parse_marked_section(i, report)
        except AssertionError:
            return self.rawdata.find(">", i) + 1 or len(self.rawdata)


class Tree(Node):
    """The root of a page."""

    __slots__ = ("by_tag",)

    def __init__(self) -> None:
        super().__init__("", {}, None)
        self.by_tag: dict[str, list[Node]] = {}


def parse(html: str) -> Tree:
    """The page's tree; an unfinished or odd page gives what could be read of it."""
    builder = _Builder()
    try:
        builder.feed(html)
        builder.close()
    except AssertionError:  # the parser's word for a declaration it cannot read
        pass
    return builder.root


def _first(tree: Tree, selector: str) -> Node | None:
    """The first element of a selector, which names a tag."""
    return next((n for n in tree.by_tag.get(_parsed(selector)[-1][0], ()) if n.matches(selector)), None)


def site(root: Tree, url: str | None, hint: str | None) -> str:
    """Which kind of site a page is from."""
    if hint:
        return hint.lower()
    try:
        host = urlparse(url or "").netloc.lower()
    except ValueError:
        host = ""
    if "wikipedia.org" in host:
        return "wikipedia"
    if "bigenc.ru" in host:
        return "bre"
    return "wikipedia" if _first(root, "div.mw-parser-output") or _first(root, "div#mw-content-text") else "bre"


def content_root(root: Tree, kind: str) -> Node | None:
    """The first selector's element with text, else the nearest of six ancestors of the first h1 that has text, else the body."""
    for selector in ROOTS.get(kind, ROOTS["bre"]):
        node = _first(root, selector)
        if node and node.text():
            return node
    if h1 := _first(root, "h1"):
        node = h1.parent
        for _ in range(6):
            if node is None:
                break
            if node.text():
                return node
            node = node.parent
    return _first(root, "body")


def blocks(html: str | None, url: str | None = None, hint: str | None = None) -> list[tuple[str, str]]:
    """(tag, text) of the headings, paragraphs and list items of the article, in order."""
    return _blocks(parse(html), url, hint) if html else []


def _blocks(tree: Tree, url: str | None, hint: str | None) -> list[tuple[str, str]]:
    kind = site(tree, url, hint)
    root = content_root(tree, kind)
    if root is None:
        return []
    _prune(root, *_clutter(kind))
    found = []
    for node in root.walk():  # a link's own elements are no blocks, for it becomes its text before they are reached
        if node.tag == "a":
            node.children = [node.text()]
        elif node.tag in BLOCKS:
            found.append(node)
    return [(n.tag, n.text()) for n in found]


def title(html: str | None) -> str:
    """og:title, the first h1, the title element before its first dash or bar, a meta title, or a stand-in."""
    return _title(parse(html)) if html else UNTITLED


def _title(tree: Tree) -> str:
    metas = tree.by_tag.get("meta", [])
    for found in (
        next((n.attrs.get("content", "") for n in metas if n.attrs.get("property") == "og:title"), ""),
        (h1.text() if (h1 := _first(tree, "h1")) else ""),
        re.sub(r"\s*[-|—]\s*.*$", "", t.text()) if (t := _first(tree, "title")) else "",
        next((n.attrs.get("content", "") for n in metas if n.attrs.get("name") == "title"), ""),
    ):
        if found.strip():
            return found.strip()
    return UNTITLED


def _parts(html: str | None, url: str | None, hint: str | None) -> tuple[str, list[dict[str, str]]]:
    if not html:
        return UNTITLED, []
    tree = parse(html)
    return _title(tree), [{"tag": a, "text": b} for a, b in _blocks(tree, url, hint)]


@F.pandas_udf(PARTS)
def page_parts(html: pd.Series, url: pd.Series, hint: pd.Series) -> pd.DataFrame:
    """Title and blocks of each page."""
    rows = [_parts(h, u, s) for h, u, s in zip(html, url, hint)]
    return pd.DataFrame(rows, columns=["title", "blocks"])


def article(parts: Column) -> Column:
    """The article's text: blocks up to the first closing heading, without controls, short blocks and doubled neighbours."""
    cleaned = F.filter(F.transform(parts, lambda b: F.struct(b["tag"].alias("tag"), clean_text(b["text"]).alias("text"))), lambda b: b["text"] != "")
    return let(cleaned, _shown)


def _shown(cleaned: Column) -> Column:
    stops = F.transform(cleaned, lambda b: b["tag"].rlike("^h[2-6]$") & normalize_heading(b["text"]).isin(STOP_HEADINGS))
    before = let(F.array_position(stops, F.lit(True)), lambda first: F.when(first > 0, F.slice(cleaned, F.lit(1), (first - 1).cast("int"))).otherwise(cleaned))
    control = lambda b: F.exists(F.array(*[F.lit(c) for c in CONTROLS]), lambda c: F.contains(F.lower(b["text"]), c))
    shown = F.filter(before, lambda b: (F.length(b["text"]) >= MIN_BLOCK) & ~control(b))
    single = let(F.transform(shown, lambda b: b["text"]), lambda texts: F.filter(texts, lambda t, i: (i == 0) | (t != F.get(texts, i - 1))))
    return strip(F.array_join(single, "\n\n"))


def clean_pages(pages: DataFrame, *, html_col: str = "html", url_col: str = "url", hint_col: str | None = None) -> DataFrame:
    """pages with title, clean_text and word_count instead of the HTML."""
    hint = F.col(hint_col) if hint_col else F.lit(None).cast("string")
    parsed = pages.withColumn("_p", page_parts(html_col, url_col, hint))
    staged = parsed.withColumn("clean_text", article(F.col("_p.blocks"))).withColumn("title", F.col("_p.title"))
    return staged.withColumn("word_count", count_words(F.col("clean_text"))).drop("_p", html_col)
