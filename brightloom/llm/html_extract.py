"""Main text of web pages by consensus paths of each host.

First pass: on every page, each container gets points for the running text right
inside it and half of them for its parent's parent's sake; the page's points are
shared out over the containers' generalised paths (tags with classes, digits
made alike). Spark sums these votes by host and path and keeps the leading
paths of each host. Second pass: a page's text is that of the elements on its host's
leading path, raised to the article that they are a part of; a page without them
falls back to its own best container, and one with most of its text elsewhere has both.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Leading paths kept for a host, and the least share of its votes that one needs.
PATHS, SHARE = 3, 0.05
#: A host path's text must be at least this part of the page's text outside links and dropped parts to stand alone.
COVER = 0.4
#: Characters of a block of running text at least.
RUNNING = 25
#: Text beside a container belongs to the same article if less than this part of it is in links.
LINKED = 0.33

_TAG = re.compile(
    r"""<(?:!--.*?(?:-->|\Z)|[!?][^>]*+>?|/([a-zA-Z][^\s/>]*+)[^>]*+>?|([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+)>?)""",
    re.DOTALL,
)
_CLASS = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.IGNORECASE)
#: Elements whose content is text, not markup, or no part of the text; none of it is shown.
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes svg annotation annotation-xml".split())
#: Those of them that hold markup: unclosed, they hide nothing.
DRAWN = frozenset("svg annotation annotation-xml template".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary "
    "table tbody td tfoot th thead tr ul button".split()
)
CONTAINER = frozenset("article body blockquote center dd details div fieldset main section table tbody td tr ul ol dl html figure".split())
DROPPED = frozenset("nav header footer aside form head button select option optgroup dialog menu search fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar form".split())
#: Words that mark a part of a page as no part of its article, in a name that is made of them and of words for a box.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense sponsor sponsored promo banner cookie cookies "
    "consent gdpr sidebar aside nav navbar navigation menu breadcrumb breadcrumbs pagination pager "
    "footer header masthead toolbar comment comments commentlist disqus newsletter subscribe widget widgets popup modal".split()
)
#: Further such words, which are about what a reader may do.
WEAK = frozenset(
    "promotion notice notices notification alert side respond replies reply share sharing social related recommended "
    "subscription signup login search overlay form skip".split()
)
BOX = frozenset(
    "bar box links link list block panel section area container wrapper button buttons icons items posts articles stories top bottom left right site page main "
    "slot unit space zone holder placeholder inner outer wrap primary secondary global mobile desktop header footer message messages form thread reader user users the by and".split()
)
#: Headings are no part by their own name: a widget's goes with the widget.
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: Dropped elements that may stand around a whole page: one that holds most of its running text is not dropped.
AROUND = frozenset("form fieldset".split())
KEPT = frozenset("html body main article".split())
#: Containers that stand within an article, never for a whole one.
PARTS = frozenset("section blockquote ul ol dl dd li table tbody tr center details figure".split())
#: Opening one of these ends an open element of the set, up to the nearest container.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}


def _marked(name: str) -> bool:
    """Whether a class or id names a part outside the article: all its words are marks or boxes, and one is a mark."""
    parts = re.split(r"[-_]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", name).lower())
    parts = [p.rstrip("0123456789") for p in parts if p]
    parts = [p for p in parts if p]
    if not parts or parts[0] in ("has", "with", "no", "is", "without", "not"):
        return False
    return any(p in MARKS or p in WEAK for p in parts) and all(p in MARKS or p in WEAK or p in BOX for p in parts)


#: Parameters of the method: open elements that are told apart and levels that a path names; what lies deeper belongs to the last of them,
#: but a dropped part is told apart at any depth.
DEPTH, PATH_DEPTH = 256, 40


class _Element:
    __slots__ = ("around", "deep", "dropped", "path", "tag")

    def __init__(self, tag: str, path: str, dropped: bool, around: int = 0) -> None:
        self.tag, self.path, self.dropped = tag, path, dropped
        self.around = around  # number of the form or the like that it is dropped with, and for no other reason
        self.deep: dict[str, int] | None = None  # elements not told apart around it


def blocks(html: str) -> list[tuple[tuple[_Element, ...], str, int]]:
    """(open elements, text, characters in links) of each block of shown text outside dropped parts, in page order.

    A form or the like that holds more than half of the running text outside links stands around the page, and counts as a division.
    """
    found = list(_blocks(html))
    inside: dict[int, int] = defaultdict(int)
    total = 0
    for stack, words, link in found:
        size = len(words) - link if len(words) >= RUNNING else 0
        total += size
        inside[stack[-1].around] += size
    own = {n for n, size in inside.items() if n and 2 * size > total}
    return [b for b in found if not b[0][-1].around or b[0][-1].around in own]


def _blocks(html: str) -> Iterator[tuple[tuple[_Element, ...], str, int]]:
    """As ``blocks``, with those that are dropped only because of a form or the like around them, which ``around`` numbers."""
    stack: list[_Element] = [_Element("", "", False)]
    text: list[str] = []
    deep: dict[str, int] = defaultdict(int)  # open elements below the last that is told apart
    link, in_link, at, n, forms = 0, False, 0, len(html), 0
    unended: set[str] = set()

    def flush() -> Iterator[tuple[tuple[_Element, ...], str, int]]:
        nonlocal link
        if text:
            words = " ".join("".join(text).split())
            text.clear()
            if words and not stack[-1].dropped:
                yield tuple(stack), words, min(link, len(words))
        link = 0

    while at < n:
        m = _TAG.search(html, at)
        end = m.start() if m else n
        if end > at and not stack[-1].dropped:
            piece = unescape(html[at:end])
            text.append(piece)
            if in_link:
                link += len(piece)
        if not m:
            break
        at = m.end()
        closing, tag = m[1], m[2]
        if tag:
            tag = tag.lower()
            if tag in RAW:
                hides = tag not in unended and (not m[3].endswith("/") or tag in ("script", "style", "title", "textarea"))
                close = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.IGNORECASE).search(html, at) if hides else None
                if hides and not close:
                    unended.add(tag)  # no end further on: not looked for again
                if close:
                    at = close.end()
                elif tag not in DRAWN:
                    at = n
            elif tag == "a":
                in_link = True
            elif tag == "br":
                text.append(" ")
            elif tag in BLOCK:
                yield from flush()
                if tag == "hr":
                    continue
                if tag not in ("td", "th") or stack[-1].tag == "p":
                    while stack[-1].tag == "p" or (stack[-1].tag[:1] == "h" and stack[-1].tag[1:].isdigit()):
                        stack.pop()
                if tag in CLOSES:
                    for k in range(len(stack) - 1, 0, -1):
                        if stack[k].tag in CLOSES[tag]:
                            del stack[k:]
                            break
                        if stack[k].tag in ("ul", "ol", "dl", "table", "select", "menu"):
                            break
                attrs, names, dropped = m[3], "", tag in DROPPED and not (tag == "header" and any(e.tag == "article" for e in stack))
                around, dropped = dropped and tag in AROUND, dropped and tag not in AROUND
                if attrs and len(attrs) > 3:
                    for a in _CLASS.finditer(attrs):
                        key, value = a[1].lower(), (a[2] or "").strip("\"'")
                        if key == "class":
                            names = "." + ".".join(sorted(re.sub(r"\d+", "#", value.lower()).split())) if value.split() else ""
                        if tag not in KEPT:
                            if key in ("class", "id"):
                                dropped = dropped or (tag not in HEADINGS and any(map(_marked, value.split())))
                            elif key == "role":
                                dropped = dropped or value.lower() in ROLES
                            elif key == "hidden" or (key == "aria-hidden" and value.lower() == "true") or (key == "style" and "display:none" in value.replace(" ", "").lower()):
                                dropped = True
                top = stack[-1]
                if len(stack) > DEPTH and (top.dropped or not dropped):
                    deep[tag] += tag != "p"
                    continue
                path = f"/{tag}" if tag in ("html", "body", "head") else f"{top.path}/{tag}{names}" if len(stack) <= PATH_DEPTH else top.path
                forms += around
                stack.append(_Element(tag, path, dropped or (top.dropped and tag != "body"), top.around or (forms if around else 0)))
                stack[-1].deep, deep = deep, defaultdict(int)
        elif closing:
            tag = closing.lower()
            if tag == "a":
                in_link = False
            elif tag in BLOCK:
                yield from flush()
                if deep[tag]:
                    deep[tag] -= 1
                    continue
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == tag:
                        deep = stack[k].deep or defaultdict(int)
                        del stack[k:]
                        break
                    if tag in ("p", "li") and stack[k].tag in ("article", "body", "main", "section", "td"):
                        break
    yield from flush()


def _containers(found: list[tuple[tuple[_Element, ...], str, int]]) -> dict[str, list[float]]:
    """Points, characters and characters in links of each container's path."""
    by: dict[str, list[float]] = defaultdict(lambda: [0.0, 0.0, 0.0])
    for stack, words, link in found:
        inside = [e for e in stack if e.tag in CONTAINER]
        for e in {e.path for e in inside}:
            by[e][1] += len(words)
            by[e][2] += link
        if len(words) >= RUNNING and inside:
            points = (1 + min(words.count(",") + words.count(". "), 8) * 0.5 + min(len(words) / 100, 5)) * (1 - link / len(words))
            for k, e in enumerate(reversed(inside[-3:])):
                by[e.path][0] += points * (1.0, 0.5, 0.25)[k]
    return by


def best_paths(html: str | None, most: int = 5) -> list[tuple[str, float]]:
    """The page's leading container paths and their shares of its vote."""
    return _leading(blocks(html or ""), most)


def _leading(found: list[tuple[tuple[_Element, ...], str, int]], most: int) -> list[tuple[str, float]]:
    by = _containers(found)
    scored = sorted(((p, x[0] * (1 - x[2] / x[1])) for p, x in by.items() if x[0] > 0), key=lambda s: (-s[1], s[0]))[:most]
    total = sum(s for _, s in scored)
    return [(p, s / total) for p, s in scored] if total else []


def _region(found: list[tuple[tuple[_Element, ...], str, int]], path: str) -> set[int]:
    """Numbers of the blocks of the article that the elements on a path belong to.

    That is the nearest article around them, or else the main element, or else
    the outermost container up to which what is added is no more than what is
    there and mostly outside links; a list, table, section or the like is always
    a part of what surrounds it. The body is never taken whole on their behalf,
    only the blocks right inside it beside such a part.
    """
    held = {i for i, (stack, _, _) in enumerate(found) if any(e.path == path for e in stack)}
    if not held:
        return held
    stack = found[min(held)][0]
    own = next(k for k, e in enumerate(stack) if e.path == path)
    if stack[own].tag in ("article", "main", "body", "html"):
        return held
    outer = [e for e in stack[:own] if e.tag == "article"][-1:] or [e for e in stack[:own] if e.tag == "main"][:1]
    if outer:
        return {i for i, (s, _, _) in enumerate(found) if any(e.path == outer[0].path for e in s)}
    part = stack[own].tag in PARTS
    for e in reversed(stack[:own]):
        if e.tag not in CONTAINER:
            continue
        if e.tag in ("body", "html"):
            right_inside = (i for i, (s, w, link) in enumerate(found) if link < LINKED * len(w) and next((x for x in reversed(s) if x.tag in CONTAINER), None) is e)
            return held | set(right_inside) if part else held
        more = {i for i, (s, _, _) in enumerate(found) if any(x.path == e.path for x in s)}
        size, linked = sum(len(found[i][1]) for i in more - held), sum(found[i][2] for i in more - held)
        if linked >= LINKED * size > 0 or (not part and size > sum(len(found[i][1]) for i in held)):
            return held
        held, part = more, e.tag in PARTS
    return held


def main_text(html: str | None, paths: list[str]) -> str:
    """Blocks of the article on the first of the host's paths that the page has.

    Where the page's own best container lies around the path, it is taken instead; where
    the path holds too little of the page, both are. Without any it is the own best container.
    """
    found = blocks(html or "")
    if not found:
        return ""
    best = _leading(found, 1)
    own = best[0][0] if best else ""
    need = COVER * sum(len(w) - link for _, w, link in found)
    around = own if own not in ("", "/body", "/html") else ""
    held = next(filter(None, (_region(found, p) for p in paths)), set())
    if around and any(p.startswith(around + "/") for p in paths):
        wide = _region(found, around)
        held = wide if held < wide else held
    if not held or sum(len(found[i][1]) - found[i][2] for i in held) < need:
        held |= _region(found, own) if own else {i for i, (_, w, link) in enumerate(found) if link < 0.5 * len(w)}
    return "\n".join(found[i][1] for i in sorted(held))


def host_of(url: Column) -> Column:
    """Host of a URL in lower case; empty if there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1), F.lit("")))


def host_paths(pages: DataFrame, paths: int = PATHS, share: float = SHARE) -> DataFrame:
    """``host, paths``: at most ``paths`` leading paths of each host, most votes first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hosts, found, votes = [], [], []
            for host, html in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                for p, v in best_paths(html.as_py()):
                    hosts.append(host)
                    found.append(p)
                    votes.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(found, pa.string()), pa.array(votes, pa.float64())], ["host", "path", "vote"])

    rows = pages.select(host_of(F.col("url")).alias("host"), F.col("html").cast("string").alias("html")).where("host <> ''")
    votes = rows.mapInArrow(run, "host string, path string, vote double").groupBy("host", "path").agg(F.round(F.sum("vote"), 6).alias("votes"))
    rank = F.row_number().over(Window.partitionBy("host").orderBy(F.desc("votes"), "path"))
    top = votes.withColumn("rank", rank).where(F.col("rank") <= paths)
    top = top.groupBy("host").agg(F.array_sort(F.collect_list(F.struct("rank", "path", "votes"))).alias("p"), F.sum("votes").alias("all"))
    kept = F.filter("p", lambda p: p["votes"] >= share * F.col("all"))
    return materialize(top.select("host", F.transform(kept, lambda p: p["path"]).alias("paths")), "host-paths")


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of each row of ``pages(page_id, url, html)``.

    Null or empty html gives an empty text; a null url or one without host has
    only its page's own vote. Rows that repeat come out as often; other columns
    are ignored; an empty table gives no rows. A page is read whole, however long; of paths with
    equal votes the first by name leads. A page votes for its five best containers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                c = b.slice(at, 256)
                texts = [main_text(h.as_py(), p or []) for h, p in zip(c.column(2), c.column(3).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([c.column(0), c.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), host_of(F.col("url")).alias("host"))
    rows = rows.join(host_paths(pages), "host", "left").select("page_id", "url", "html", "paths")
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
