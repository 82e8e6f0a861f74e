"""Chunks of bounded token length, their embedding text, and the length gate."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brightloom.functions.text import has_typeset_symbols, is_readable, matches, strip, token_count

MAX_TOKENS, OVERLAP, HARD_LIMIT = 200, 30, 256
SPECIALS = 2
_TOKEN = re.compile(r"\w+|[^\w\s]")
Tokenizer = Callable[[str], list[tuple[int, int]]]


def word_spans(text: str) -> list[tuple[int, int]]:
    """Default tokenizer: (start, end) of each run of word characters and each mark."""
    return [m.span() for m in _TOKEN.finditer(text)]


def pack_lines(text: str, spans: Tokenizer = word_spans, most: int = MAX_TOKENS, overlap: int = OVERLAP) -> list[str]:
    """Blocks of whole lines of at most ``most`` tokens; a block that is one longer line is cut into windows.

    Counts run on, as a line break adds no token. Windows start every ``most -
    overlap`` tokens and are cut from the text itself, the last one even where it
    lies inside the one before it.
    """
    if len(spans(text)) + SPECIALS <= most:
        return [text]
    blocks: list[str] = []
    held: list[str] = []
    n = 0
    for line in text.split("\n"):
        own = len(spans(line))
        if held and n + own + SPECIALS > most:
            blocks.append("\n".join(held))
            held, n = [], 0
        held.append(line)
        n += own
    blocks.append("\n".join(held))
    out: list[str] = []
    for b in blocks:
        t = spans(b)
        if len(t) <= most:
            out.append(b)
        else:
            out += [b[t[s][0] : t[min(s + most, len(t)) - 1][1]] for s in range(0, len(t), most - overlap)]
    return out


def split_chunks(chunks: DataFrame, spans: Tokenizer = word_spans, most: int = MAX_TOKENS, overlap: int = OVERLAP) -> DataFrame:
    """A row per part of each chunk's ``text``, with ``sub_seq``; other columns are kept."""
    at = chunks.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in range(0, b.num_rows, 256):
                c = b.slice(start, 256)
                parts = [pack_lines(t.as_py() or "", spans, most, overlap) for t in c.column(at)]
                rows = pa.array([i for i, p in enumerate(parts) for _ in p], pa.int64())
                taken = [x.take(rows) for x in c.columns]
                taken[at] = pa.array([t for p in parts for t in p], pa.string())
                yield pa.RecordBatch.from_arrays([*taken, pa.array([k for p in parts for k in range(len(p))], pa.int32())], [*c.schema.names, "sub_seq"])

    from pyspark.sql.types import IntegerType, StructType

    return chunks.mapInArrow(run, StructType(chunks.schema.fields + StructType().add("sub_seq", IntegerType()).fields))


def embed_text(section: Column, kind: Column, text: Column, short: int = 120) -> Column:
    """Text to embed: under its section's title for code and short chunks; the bare text otherwise."""
    return F.when((F.coalesce(section, F.lit("")) != "") & ((kind == "code") | (token_count(text) < short)), F.concat(section, F.lit("\n"), text)).otherwise(text)


def length_report(chunks: DataFrame, text: str = "text", limit: int = HARD_LIMIT) -> DataFrame:
    """``n, max_tokens, n_over``: what the gate decides on."""
    n = token_count(F.col(text))
    return chunks.select(n.alias("n")).agg(F.count("*").alias("n"), F.max("n").cast("long").alias("max_tokens"), F.count_if(F.col("n") > limit).alias("n_over"))


def length_gate(chunks: DataFrame, text: str = "text", limit: int = HARD_LIMIT) -> DataFrame:
    """The chunks, if none is over the limit; fails otherwise."""
    row = length_report(chunks, text, limit).first()
    if row["n_over"]:
        raise ValueError(f"{row['n_over']} chunks exceed {limit} tokens, the longest has {row['max_tokens']}")
    return chunks


_END = "endfm|endm|endfth|endth"
_CODE = rf"(?isU)((?:fmod|mod|fth|th)\s+\w+.*?(?:{_END}))"


def pdf_chunks(pages: DataFrame) -> DataFrame:
    """``doc, page, seq, type, text`` of page texts: code blocks over 50 characters, then readable paragraphs over 80.

    The code pattern is matched without case, across lines, as short as can be. It is tried only up to the last
    word that ends a block: behind it, each start of a block would run through the whole rest in vain.
    """
    pages = pages.withColumn("_head", F.regexp_extract("text", rf"(?isU)^.*(?:{_END})", 0))
    code = F.transform(F.filter(matches(F.col("_head"), _CODE, 1), lambda c: F.length(c) > 50), strip)
    rest = F.concat(F.regexp_replace("_head", _CODE, ""), F.substr("text", F.length("_head") + 1))
    paragraphs = F.transform(F.split(rest, r"(?U)\n\s*\n"), strip)
    prose = F.filter(paragraphs, lambda p: (F.length(p) > 80) & is_readable(p))
    typed = lambda xs, kind: F.transform(xs, lambda x: F.struct(F.lit(kind).alias("type"), x.alias("text")))
    rows = pages.where("text <> ''").select("doc", "page", F.posexplode(F.concat(typed(code, "code"), typed(prose, "text"))).alias("seq", "c"))
    return rows.select("doc", "page", "seq", "c.type", "c.text")


def without_grammar(chunks: DataFrame) -> DataFrame:
    """Chunks without code blocks that hold grammar or typeset symbols."""
    return chunks.where(~((F.col("type") == "code") & has_typeset_symbols(F.col("text"))))
