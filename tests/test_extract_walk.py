"""The walk over a page's markup against a tree of the whole page, on made-up and odd pages."""

from __future__ import annotations

import random
import tracemalloc
from collections.abc import Iterator
from html.parser import HTMLParser

import pytest

from brightloom.operators import extract
from brightloom.operators.extract import _DROPPED, _ENDS, _ENDS_P, _VOID, DOCS_SITE, GRAMMAR, MANUAL, MIN_CODE, MIN_PROSE


class _Node:
    __slots__ = ("attrs", "children", "parent", "tag")

    def __init__(self, tag: str, attrs: dict[str, str], parent: _Node | None) -> None:
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    def walk(self) -> Iterator[_Node | str]:
        held: list[_Node | str] = list(reversed(self.children))
        while held:
            x = held.pop()
            yield x
            if isinstance(x, _Node):
                held += reversed(x.children)

    def nodes(self, *tags: str) -> Iterator[_Node]:
        return (x for x in self.walk() if isinstance(x, _Node) and x.tag in tags)

    def words(self) -> str:
        return " ".join(s for x in self.walk() if isinstance(x, str) and (s := x.strip()))

    def raw(self) -> str:
        return "".join(x for x in self.walk() if isinstance(x, str))

    def inside(self, tag: str) -> bool:
        p = self.parent
        while p is not None:
            if p.tag == tag:
                return True
            p = p.parent
        return False


class _Tree(HTMLParser):
    """Builds the tree; a paragraph ends where the next block begins, as browsers do."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.top = _Node("", {}, None)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in _ENDS_P and self.top.tag in ("p", "b", "i", "em", "strong", "a", "span"):
            p = self.top
            while p.parent is not None and p.tag in ("b", "i", "em", "strong", "a", "span"):
                p = p.parent
            if p.tag == "p":
                self.top = p.parent
        if tag in _ENDS:
            p = self.top
            while p.parent is not None and p.tag not in ("ul", "ol", "table"):
                if p.tag in _ENDS[tag]:
                    self.top = p.parent
                    if tag != "tr" or p.tag == "tr":
                        break
                p = p.parent
        node = _Node(tag, {k: v or "" for k, v in attrs}, self.top)
        self.top.children.append(node)
        if tag not in _VOID:
            self.top = node

    def handle_endtag(self, tag: str) -> None:
        p = self.top
        while p.parent is not None:
            if p.tag == tag:
                self.top = p.parent
                return
            p = p.parent

    def handle_data(self, data: str) -> None:
        self.top.children.append(data)


def code_language(node: _Node) -> str:
    """The x of the first class ``language-x`` on a ``pre`` or a ``code`` in it; else empty."""
    for n in (node, *node.nodes("code")):
        for c in n.attrs.get("class", "").split():
            if c.startswith("language-"):
                return c[len("language-") :]
    return ""


def tree_chunks(html: str | None, flavour: str = MANUAL) -> list[tuple[str, str, str, str]]:
    """The chunks of a page from a tree that is held whole."""
    tree = _Tree()
    tree.feed(html or "")
    tree.close()
    site = flavour == DOCS_SITE
    zone = tree.root
    if site:
        zone = next(zone.nodes("article"), None) or next(zone.nodes("main"), None) or next(zone.nodes("body"), None)
        if zone is None:
            return []
        for n in list(zone.nodes(*_DROPPED)):
            n.parent.children = [c for c in n.parent.children if c is not n]
    section, held, out = "", [], []
    if site and (h1 := next(zone.nodes("h1"), None)):
        section = h1.words()

    def flush() -> None:
        text = "\n".join(held).strip()
        if len(text) > MIN_PROSE:
            out.append((section, "text", "", text))
        held.clear()

    for n in zone.nodes("h2", "h3", "h4", "p", "pre", *(("li", "table") if site else ())):
        if n.tag in ("h2", "h3", "h4"):
            flush()
            section = n.words()
        elif n.tag == "pre":
            code = "\n".join(x.rstrip() for x in n.raw().splitlines() if x.strip())
            if len(code) > MIN_CODE and (site or not any(s in code for s in GRAMMAR)):
                out.append((section, "code", code_language(n) if site else "", code))
        elif n.tag == "li":
            if not next(n.nodes("pre", "li"), None) and (text := n.words()):
                held.append(f"- {text}")
        elif n.tag == "table":
            rows = [[c.words() for c in r.nodes("td", "th")] for r in n.nodes("tr")]
            if lines := [" | ".join(r) for r in rows if any(r)]:
                held.append("\n".join(lines))
        elif (not site or not n.inside("li")) and (text := n.words()):
            held.append(text)
    flush()
    return out




TAGS = "div p p ul li li pre code table tr td th h1 h2 h3 b span a nav aside article main body br img section header footer form".split()


def page(rng: random.Random) -> str:
    out = []
    for _ in range(rng.randrange(5, 60)):
        kind, tag = rng.random(), rng.choice(TAGS)
        if kind < 0.4:
            attrs = rng.choice(["", "", ' class="x language-py"', " class='language-sh'", " class", " id=a"])
            out.append(f"<{tag}{attrs}>")
        elif kind < 0.65:
            out.append(f"</{tag}>")
        elif kind < 0.7:
            out.append(rng.choice(["<!-- c -->", "<script>var p='</p><p>';</script>", "<style>p{}</style>", "<br/>", "<p/>", "&amp;", "&lt;b&gt;", "<?x y>", "<![CDATA[z]]>"]))
        else:
            out.append(rng.choice(["one two", " ", "\n  x  \n", "::=", "y" * 60, "fmod A is sort S . endfm", "a &middot; b", "é" * 40]))
    return "".join(out)


@pytest.mark.parametrize("flavour", [MANUAL, DOCS_SITE])
@pytest.mark.parametrize("piece", [1 << 16, 7])
def test_walk_against_tree(monkeypatch, flavour, piece):
    monkeypatch.setattr(extract, "SLICE", piece)
    monkeypatch.setattr(extract, "MIN_PROSE", 5)
    monkeypatch.setitem(globals(), "MIN_PROSE", 5)
    rng = random.Random(piece)
    found = 0
    for _ in range(1500):
        html = rng.choice(["", "<article>", "<body><article><h1>T</h1>", "<main>"]) + page(rng)
        want = tree_chunks(html, flavour)
        assert extract.page_chunks(html, flavour) == want, html
        found += len(want)
    assert found > 300


def test_memory_stays_flat():
    """Chunks come as elements end; what is held doesn't grow with the page."""
    section = f"<h2>Part</h2><p>{'word ' * 40}</p><pre>{'line of code' * 3}</pre><ul><li>item {'x' * 90}</li></ul>"

    def peak(n: int) -> tuple[int, int]:
        html = f"<article><h1>T</h1>{section * n}</article>"
        tracemalloc.start()
        number = sum(1 for _ in extract.iter_chunks(html, DOCS_SITE))
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return most, number

    small, large = peak(500), peak(10_000)
    assert (small[1], large[1]) == (1000, 20_000)
    assert large[0] < 1.5 * small[0] + 1_000_000


def test_deep_and_open_pages():
    assert extract.page_chunks("<li>" * 20_000 + "x" * 200, DOCS_SITE) == []
    text = "x" * 150
    assert extract.page_chunks("<div>" * 20_000 + f"<p>{text}" + "</q>" * 20_000) == [("", "text", "", text)]
    assert extract.page_chunks(f"<p>{text}</p><!-- never ends " + "<p>" * 200_000)[0][3].startswith(text)
