"""Pages to section-aware chunks of prose and code, by one walk over each page's markup."""

from __future__ import annotations

from collections import Counter, deque
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MANUAL, DOCS_SITE = "manual", "docs_site"
MIN_PROSE, MIN_CODE = 100, 20
GRAMMAR = ("::=", "⟨", "⟩", "∣")
#: Characters of a page that are read at once, and of chunks that are handed on together.
SLICE, TOGETHER = 1 << 16, 1 << 20
_KINDS = frozenset("h2 h3 h4 p pre".split())
_IN_P = frozenset("p b i em strong a span".split())
_DROPPED = frozenset("nav aside header footer script style form".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_ENDS_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
_ENDS = {"li": {"li"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}


class _Block:
    """An open element that gives a chunk or a part of one, with what has been read of it."""

    __slots__ = ("done", "in_list", "kind", "lang", "pieces", "rows")

    def __init__(self, kind: str, in_list: bool) -> None:
        self.kind, self.in_list, self.done, self.lang = kind, in_list, False, ""
        self.pieces: list[str] | None = []  # None: of no use any more
        self.rows: list[list[list[str]]] = []

    def words(self) -> str:
        return _words(self.pieces)


def _words(pieces: list[str]) -> str:
    return " ".join(s for x in pieces if (s := x.strip()))


class _Walk(HTMLParser):
    """Reads a page in slices and hands on each block, in the order they begin, as soon as it and those before it have ended.

    Kept are the names of the open elements and what has been read of the open blocks. A paragraph
    ends where the next block begins, as browsers do. With ``zone`` only the first element of that name counts, without
    what lies in menus, headers and the like.
    """

    def __init__(self, kinds: frozenset[str], zone: str | None = None) -> None:
        super().__init__(convert_charrefs=True)
        self.kinds, self.zone, self.zones = kinds, zone, 0
        self.stack: list[tuple[str, _Block | None, list | None]] = []  # name, block, table row or cell
        self.open: Counter[str] = Counter()
        self.inside = self.dropped = 0  # places in the stack, counted from 1, of the zone and of a dropped element
        self.queue: deque[_Block] = deque()
        self.blocks: list[_Block] = []  # the open ones
        self.table_rows: list[list[list[str]]] = []  # the open ones
        self.cells: list[list[str]] = []
        self.text: list[str] = []

    def parts(self, html: str) -> Iterator[_Block]:
        at = 0
        while at < len(html):
            size = max(SLICE, len(self.rawdata))  # what waits for its end is looked at again: twice as much comes then
            self.feed(html[at : at + size])
            at += size
            yield from self._ended()
        self.close()
        self._flush()
        self._cut(0)
        yield from self._ended()

    def _ended(self) -> Iterator[_Block]:
        while self.queue and self.queue[0].done:
            yield self.queue.popleft()

    def _counts(self) -> bool:
        return not self.dropped and (self.zone is None or self.inside > 0)

    def _flush(self) -> None:
        """A run of text between two marks is one piece, however it came."""
        if self.text:
            piece = "".join(self.text)
            self.text.clear()
            if self._counts():
                for b in self.blocks:
                    if b.pieces is not None:
                        b.pieces.append(piece)
                for cell in self.cells:
                    cell.append(piece)

    def _cut(self, size: int) -> None:
        """Close all elements beyond the first ``size``."""
        while len(self.stack) > size:
            tag, block, part = self.stack.pop()
            self.open[tag] -= 1
            if block is not None:
                block.done = True
                if block.pieces is not None:
                    self.blocks.remove(block)
            if part is not None and tag == "tr":
                del self.table_rows[-len(part) or len(self.table_rows) :]
            elif part is not None:
                self.cells.pop()
        self.inside = self.inside if self.inside <= size else -1  # the first zone only
        self.dropped = self.dropped if self.dropped <= size else 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self._flush()
        stack = self.stack
        if tag in _ENDS_P and stack and stack[-1][0] in _IN_P:
            at = len(stack) - 1
            while at and stack[at][0] in _IN_P and stack[at][0] != "p":
                at -= 1
            if stack[at][0] == "p":
                self._cut(at)
        if tag in _ENDS:
            at, size = len(stack) - 1, len(stack)
            while at >= 0 and stack[at][0] not in ("ul", "ol", "table"):
                if stack[at][0] in _ENDS[tag]:
                    size = at
                    if tag != "tr" or stack[at][0] == "tr":
                        break
                at -= 1
            self._cut(size)
        block = part = None
        if self.zone is not None and tag == self.zone and not self.inside:
            self.inside = len(stack) + 1
        elif self._counts():
            if self.zone is not None and tag in _DROPPED:
                self.dropped = len(stack) + 1
            else:
                block, part = self._begun(tag, dict(attrs))
        stack.append((tag, block, part))
        self.open[tag] += 1
        if tag in _VOID:
            self._cut(len(stack) - 1)

    def _begun(self, tag: str, attrs: dict) -> tuple[_Block | None, list | None]:
        part = None
        if tag in ("pre", "li"):  # the items around it give nothing
            for b in self.blocks:
                if b.kind == "li":
                    b.pieces = None
            self.blocks = [b for b in self.blocks if b.pieces is not None]
        if tag == "code":
            for b in self.blocks:
                if b.kind == "pre" and not b.lang:
                    b.lang = _language(attrs)
        elif tag == "tr":
            part = []  # a new row of each table around it
            for b in self.blocks:
                if b.kind == "table":
                    b.rows.append([])
                    part.append(b.rows[-1])
            self.table_rows += part
        elif tag in ("td", "th"):
            part = []
            for row in self.table_rows:
                row.append(part)
            self.cells.append(part)
        if tag not in self.kinds:
            return None, part
        block = _Block(tag, self.open["li"] > 0)
        block.lang = _language(attrs) if tag == "pre" else ""
        self.blocks.append(block)
        self.queue.append(block)
        return block, part

    def handle_endtag(self, tag: str) -> None:
        self._flush()
        if self.open[tag]:
            at = len(self.stack) - 1
            while self.stack[at][0] != tag:
                at -= 1
            self._cut(at)

    def handle_data(self, data: str) -> None:
        self.text.append(data)

    def handle_comment(self, data: str) -> None:
        self._flush()

    handle_decl = handle_pi = unknown_decl = handle_comment


def _language(attrs: dict) -> str:
    """The x of the first class ``language-x``; else empty."""
    return next((c[len("language-") :] for c in (attrs.get("class") or "").split() if c.startswith("language-")), "")


def _zone_of(html: str) -> tuple[str | None, str]:
    """The first of article, main and body that a page has, and its first heading of the first order."""
    for zone in ("article", "main", "body"):
        if f"<{zone}" not in html and f"<{zone}" not in html.lower():
            continue
        walk = _Walk(frozenset(("h1",)), zone)
        first = next(walk.parts(html), None)
        if first is not None or walk.inside:
            return zone, first.words() if first else ""
    return None, ""


def iter_chunks(html: str | None, flavour: str = MANUAL) -> Iterator[tuple[str, str, str, str]]:
    """(section, type, lang, text) of a page in emission order, as its elements end.

    Prose is emitted at the next heading and code at once, so a section's code
    stands before its prose. A heading drops a prose buffer of up to 100 characters. Beside the html no more is held than the
    open blocks and the prose of one section.
    """
    html, site = html or "", flavour == DOCS_SITE
    zone, section = _zone_of(html) if site else (None, "")
    if site and zone is None:
        return
    held: list[str] = []

    def flush() -> Iterator[tuple[str, str, str, str]]:
        text = "\n".join(held).strip()
        held.clear()
        if len(text) > MIN_PROSE:
            yield section, "text", "", text

    for b in _Walk(_KINDS | {"li", "table"} if site else _KINDS, zone).parts(html):
        if b.kind in ("h2", "h3", "h4"):
            yield from flush()
            section = b.words()
        elif b.kind == "pre":
            code = "\n".join(x.rstrip() for x in "".join(b.pieces).splitlines() if x.strip())
            if len(code) > MIN_CODE and (site or not any(s in code for s in GRAMMAR)):
                yield section, "code", b.lang if site else "", code
        elif b.kind == "li":
            if b.pieces is not None and (text := b.words()):
                held.append(f"- {text}")
        elif b.kind == "table":
            rows = [[_words(cell) for cell in row] for row in b.rows]
            if lines := [" | ".join(r) for r in rows if any(r)]:
                held.append("\n".join(lines))
        elif (not site or not b.in_list) and (text := b.words()):
            held.append(text)
    yield from flush()


def page_chunks(html: str | None, flavour: str = MANUAL) -> list[tuple[str, str, str, str]]:
    """``iter_chunks`` as a list."""
    return list(iter_chunks(html, flavour))


def extract_chunks(pages: DataFrame, flavour: str = MANUAL) -> DataFrame:
    """``page_order, source, chunk_seq, section, type, lang, text`` of ``pages(page_order, url, html)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for b in batches:
            out, size = [], 0
            for order, url, html in zip(*b.columns, strict=True):
                for k, c in enumerate(iter_chunks(html.as_py(), flavour)):
                    out.append((order.as_py(), url.as_py(), k, *c))
                    size += len(c[3])
                    if size > TOGETHER:
                        yield batch(out)
                        out, size = [], 0
            if out:
                yield batch(out)

    names = ["page_order", "source", "chunk_seq", "section", "type", "lang", "text"]
    kinds = [pa.int64(), pa.string(), pa.int32(), *[pa.string()] * 4]
    rows = pages.select(F.col("page_order").cast("long").alias("page_order"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_order long, source string, chunk_seq int, section string, type string, lang string, text string")
