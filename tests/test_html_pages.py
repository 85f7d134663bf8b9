"""Pages against a second reading of the rules, over the tables' pages and made-up ones, and pages that are no HTML at all."""

import random
import re
from html import unescape
from xml.etree import ElementTree as ET

import pandas as pd
import pytest
from paths import LARGE

from skald.functions import html as H

VOID = {"br", "img", "meta", "hr", "link", "input"}
BLOCKS = ["h1", "h2", "h3", "h4", "h5", "h6", "p", "li"]


def tree(page):
    """Tags by a pattern and a stack into an element tree."""
    root = ET.Element("page")
    stack = [root]
    for tag, text in re.findall(r"(?s)<!--.*?-->|(<script.*?</script>|<style.*?</style>|<[^<>]*>)|([^<]+)", re.sub("<!DOCTYPE[^>]*>", "", page)):
        if text:
            here = stack[-1]
            if len(here):
                here[-1].tail = (here[-1].tail or "") + unescape(text)
            else:
                here.text = (here.text or "") + unescape(text)
        elif tag.startswith("</"):
            names = [e.tag for e in stack]
            if tag[2:-1] in names[1:]:
                del stack[len(names) - 1 - names[::-1].index(tag[2:-1]) :]
        elif tag:
            name = re.match(r"<([a-z0-9]+)", tag)[1]
            made = ET.SubElement(stack[-1], name, dict(re.findall(r'([a-z:]+)="([^"]*)"', tag.split(">")[0])))
            if name not in VOID and name not in ("script", "style"):
                stack.append(made)
    return root


def said(element):
    return " ".join(x.strip() for x in element.itertext() if x.strip())


def has(element, name):
    return name in element.get("class", "").split()


def plain_blocks(page, kind):
    """Blocks of the article; kind is wikipedia or bre."""
    root = tree(page)
    chosen = []
    for selector in H.ROOTS[kind]:
        found = root.iter()
        for part in selector.split(" "):
            tag, sign, name = re.match(r"(\w+)([.#]?)(.*)", part).groups()
            found = [e for f in ([root] if found is None else list(found)) for e in f.iter(tag) if e is not f or part == selector if not sign or (has(e, name) if sign == "." else e.get("id") == name)]
        chosen += [e for e in root.iter() if e in found][:1] if found else []
        if chosen and said(chosen[-1]):
            break
        chosen = []
    if not chosen:
        above = {c: e for e in root.iter() for c in e}
        for e in list(root.iter("h1"))[:1]:
            for _ in range(6):
                e = above.get(e)
                if e is None:
                    break
                if said(e):
                    chosen = [e]
                    break
        chosen = chosen or list(root.iter("body"))[:1]
    if not chosen:
        return []
    marks = [*H.CLUTTER, *H.CLUTTER_OF[kind], "sup"]

    def cut(e):
        for c in list(e):
            if any(has(c, m[1:]) if m[0] == "." else c.tag == m for m in marks) or (c.tag == "span" and has(c, "mw-editsection")):
                i = list(e).index(c)
                if c.tail:
                    if i:
                        e[i - 1].tail = (e[i - 1].tail or "") + "\0" + c.tail
                    else:
                        e.text = (e.text or "") + "\0" + c.tail
                e.remove(c)
            else:
                cut(c)

    cut(chosen[0])
    speak = lambda e: " ".join(x.strip() for y in e.itertext() for x in y.split("\0") if x.strip())

    def walk(e):
        for c in e:
            if c.tag in BLOCKS:
                yield c.tag, speak(c)
            if c.tag != "a":
                yield from walk(c)

    return list(walk(chosen[0]))


@pytest.mark.parametrize("sf", ["0.01"])
def test_pages_of_the_tables(sf):
    pages = pd.read_parquet(f"{LARGE.replace('0.1', sf)}/pages.parquet")
    for page, url in zip(pages.html, pages.url):
        assert H.blocks(page, url) == plain_blocks(page, "bre")


def made_up(rng, depth=0):
    word = lambda: rng.choice(["слово", "text", "a &amp; b", "&lt;x", " ", "длинное предложение о клетке"])
    out = []
    for _ in range(rng.randint(1, 4)):
        tag = rng.choice(["p", "p", "div", "span", "b", "h2", "li", "ul", "a", "table", "sup", "aside", "br", "figure", "article", "main"])
        mark = rng.choice(["", "", "", ' class="toc"', ' class="x text"', ' class="mw-parser-output"', ' id="content"', ' class="share"'])
        out.append(word())
        if tag == "br":
            out.append("<br>")
        elif depth < 4:
            out.append(f"<{tag}{mark}>{made_up(rng, depth + 1)}" + (f"</{tag}>" if rng.random() < 0.8 else ""))
    return "".join(out)


def test_made_up_pages():
    rng, some = random.Random(3), 0
    for _ in range(600):
        page = f"<html><body><h1>t</h1>{made_up(rng)}</body></html>"
        for kind in ("wikipedia", "bre"):
            want = plain_blocks(page, kind)
            assert H.blocks(page, None, kind) == want, page
            some += bool(want)
    assert some > 400


def test_broken_pages_cost_no_job(spark):
    rng = random.Random(4)
    pages = ["<![foo[bar]]><p>x", "<!DOCTYPE [", "<![CDATA[", "<!-", "<", "</", "<a b='", "&#xFFFFFFFF;", "<!ELEMENT <x>>", "<?", "\0<p>\0", "<" * 500, "<p>" * 3000 + "deep", "<![if !IE]><p>text<![endif]>", "<!><p>x"]
    pages += ["".join(rng.choice(["<", ">", "!", "[", "]", "-", "p", "&", "#", '"', "'", "/", " ", "DOCTYPE", "CDATA", "?"]) for _ in range(rng.randint(1, 40))) for _ in range(400)]
    got = H.clean_pages(spark.createDataFrame([(i, p, "http://x") for i, p in enumerate(pages)], "page_id int, html string, url string")).collect()
    assert len(got) == len(pages)
    after = "<article><p>" + "слова и ещё слова после того, что никто не читает" + "</p></article>"
    assert H.blocks("<![foo[bar]]>" + after)[0][1].startswith("слова")
