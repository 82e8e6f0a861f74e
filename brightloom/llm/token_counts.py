"""Exact token count of every prefix of a text, by dynamic programming over prefixes.

The tokenizer lower-cases, turns white space to blanks and splits into words, so a
prefix costs what its whole words cost plus its last, partial word. Inside a word,
for each prefix the table holds the last token of its encoding: it is the only
token ending there that byte-pair merging leaves next to the last token of what
precedes it. So ``count[i] = count[i - len(token)] + 1``, and no prefix is encoded
again. The prefix as a text of its own ends its word there; tokens with the
end-of-word mark are tried for that.

Prefixes are those of the normalised text, which is what the tokenizer sees.
"""

from __future__ import annotations

import json
import os
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_bytes

LIMIT = 2048
#: Bytes of words and of runs without blanks with their counts, and pairs of tokens, that a worker holds at most: the first it meets, so the frequent ones.
CACHE_BYTES = 96 << 20
MAX_PAIRS = 600_000


def _byte_letters() -> list[str]:
    """The printable letter of each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, extra = {b: chr(b) for b in plain}, 0
    for b in range(256):
        if b not in letters:
            letters[b] = chr(256 + extra)
            extra += 1
    return [letters[b] for b in range(256)]


class PrefixCounter:
    """Counts of every prefix under one word-level byte-pair vocabulary with an end-of-word mark."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import ahocorasick
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.mark = spec["model"]["end_of_word_suffix"]
        self.letters = _byte_letters()
        vocab = spec["model"]["vocab"]
        merges = [m if not isinstance(m, str) else m.split(" ") for m in spec["model"]["merges"]]
        #: Rank of the merge of two tokens, and what a token was merged from: (left, right, rank).
        self.rank = {(vocab[a], vocab[b]): i for i, (a, b) in enumerate(merges)}
        self.parts = {vocab[a + b]: (vocab[a], vocab[b], i) for i, (a, b) in enumerate(merges)}
        # Finds all tokens that end at each place: (length, id inside a word, id at its end), -1 where there is none.
        found: dict[str, list[int]] = {}
        for t, i in vocab.items():
            final = t.endswith(self.mark)
            found.setdefault(t.removesuffix(self.mark), [-1, -1])[final] = i
        self.tokens = ahocorasick.Automaton()
        for t, (inner, final) in found.items():
            self.tokens.add_word(t, (len(t), inner, final))
        self.tokens.make_automaton()
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")["pattern"]["Regex"]
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, special)))
        self.split = regex.compile(f"(?:{split})")
        self.joined: dict[int, bool] = {}
        self.words: dict[str, tuple[int, ...]] = {}
        self.room = CACHE_BYTES
        #: Counts inside a run without blanks, 16 bits each.
        self.known: dict[str, bytes] = {}

    def _stands(self, a: int, b: int) -> bool:
        """Whether byte-pair merging leaves tokens a and b side by side."""
        found = self._seam(a, b)
        if len(self.joined) < MAX_PAIRS:
            self.joined[a << 20 | b] = found
        return found

    def _seam(self, a: int, b: int) -> bool:
        none = len(self.rank)
        bound = none
        base = (0, 0, -1)
        while self.rank.get((a, b), none) >= bound:
            left, right = self.parts.get(a, base), self.parts.get(b, base)
            if left[2] < 0 and right[2] < 0:
                return True
            # Undo the later merge of the two; a pair across the seam goes first if its rank is lower,
            # and also at equal rank against the right token's merge, which stands further right.
            if left[2] > right[2]:
                a, bound = left[1], left[2]
            else:
                b, bound = right[0], right[2] + 1
        return False

    def word(self, word: str) -> tuple[int, ...]:
        """Count of each prefix of a word, by code point, the word itself last."""
        raw = word.encode("utf-8", "surrogatepass")
        letters = self.letters
        n = len(raw)
        last, count, closed = [-1] * (n + 1), [0] * (n + 1), [0] * (n + 1)
        joined, compute = self.joined, self._stands

        def stands(key: int, x: int, y: int) -> bool:
            found = joined.get(key)
            return compute(x, y) if found is None else found

        for end, (length, inner, final) in self.tokens.iter("".join([letters[x] for x in raw])):
            i = end + 1
            j = i - length
            before = last[j]
            if before < 0 and j:
                continue
            if inner >= 0 and last[i] < 0 and (not j or stands(before << 20 | inner, before, inner)):
                last[i], count[i] = inner, count[j] + 1
            if final >= 0 and not closed[i] and (not j or stands(before << 20 | final, before, final)):
                closed[i] = count[j] + 1
        return tuple(closed[1:] if n == len(word) else [c for i, c in enumerate(closed) if i and (i == n or raw[i] & 0xC0 != 0x80)])

    def counts(self, text: str) -> np.ndarray:
        """Count of every prefix of the normalised text, by code point; entry 0 is the empty prefix."""
        parts = [np.zeros(1, np.int32)]
        at = base = 0
        for m in self.special.finditer(text) if "<|" in text else ():
            parts.append(base + self._plain(text[at : m.start()]))
            base = int(parts[-1][-1]) if len(parts[-1]) else base
            parts.append(np.array([base] * (len(m[0]) - 1) + [base + 1], np.int32))
            base, at = base + 1, m.end()
        parts.append(base + self._plain(text[at:] if at else text))
        return np.concatenate(parts)

    def _plain(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, np.int32)
        text = self.normalised(text)
        chunks = text.split(" ")
        # A token holds one byte at least, and a code point four at most: only then a count may pass 16 bits.
        if 4 * len(text) > 65_535 and any(4 * len(c) > 65_535 and len(c.encode("utf-8", "surrogatepass")) > 65_535 for c in chunks):
            parts, kind = [np.array(self._chunk(c), "<u4").tobytes() for c in chunks], "<u4"
        else:
            parts, kind = list(map(self.known.get, chunks)), "<u2"
            if None in parts:
                fresh = {c: np.array(self._chunk(c), "<u2").tobytes() for c in {c for c, x in zip(chunks, parts, strict=True) if x is None}}
                for c, x in fresh.items() if self.room > 0 else ():
                    self.room -= held_bytes(c, x)
                    if self.room < 0:
                        break
                    self.known[c] = x
                parts = [fresh[c] if x is None else x for c, x in zip(chunks, parts, strict=True)]
        inside = np.frombuffer(b"".join(parts), kind).astype(np.int32)
        ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts))) // np.dtype(kind).itemsize
        total = inside[ends - 1]
        before = np.cumsum(total, dtype=np.int32) - total
        return (inside + np.repeat(before, np.diff(ends, prepend=0)))[: len(text)]

    def normalised(self, text: str) -> str:
        """What the tokenizer's normaliser gives. Plain text in composed form takes a short way to the same."""
        line = text.replace("\n", " ")
        if line.isprintable() and "  " not in line and (line.isascii() or ("Σ" not in line and unicodedata.is_normalized("NFC", line))):
            return line.lower()
        return self.tokenizer.normalizer.normalize_str(text)

    def _chunk(self, chunk: str) -> list[int]:
        """Counts inside a run without blanks, and its total again for the blank after it."""
        out: list[int] = []
        base = 0
        words = self.words
        for w in (chunk,) if chunk.isalpha() else self.split.findall(chunk):
            found = words.get(w)
            if found is None:
                found = self.word(w)
                if self.room > 0:
                    self.room -= held_bytes(w, found)
                    words[w] = found
            out += [base + x for x in found] if base else found
            base = out[-1]
        out.append(base)
        return out


@lru_cache(2)
def counter(path: str) -> PrefixCounter:
    """The worker's counter for a file; kept from task to task."""
    return PrefixCounter(path)


def packed_table(counts: np.ndarray) -> bytes:
    """A table as stored: the width of a number in bytes, then the differences of neighbours as one zstandard frame."""
    import zstandard

    steps = np.diff(counts, prepend=0)
    most = int(np.abs(steps).max(initial=0))
    width = 1 if most < 1 << 7 else 2 if most < 1 << 15 else 4
    return bytes([width]) + zstandard.ZstdCompressor(level=1).compress(steps.astype(f"<i{width}").tobytes())


def table_of(prefix: bytes) -> np.ndarray:
    """The counts that a stored table holds."""
    import zstandard

    return np.cumsum(np.frombuffer(zstandard.ZstdDecompressor().decompress(prefix[1:]), f"<i{prefix[0]}"), dtype=np.int64)


def prefix_counts(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, n_bytes, n_chars, prefix`` of each row of ``docs(doc_id, text)``.

    ``prefix`` is the table: the count of the first i code points of the
    normalised text at place i, packed by ``packed_table``.
    ``answers``, ``tokens_at`` and ``longest_within`` read it. Null texts count as empty;
    rows that repeat come out as often; rows without an id have a table like others; other columns are ignored; an empty
    table gives no rows. A text is counted whole, however long. n_bytes and
    n_chars are those of the text as given.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                out: list[tuple] = []
                for text in b.column(1).slice(at, 256):
                    t = text.as_py() or ""
                    out.append((len(t.encode("utf-8", "surrogatepass")), len(t), packed_table(own.counts(t))))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, 256), *(pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True))], names)

    kinds = [pa.int64(), pa.int64(), pa.binary()]
    names = ["doc_id", "n_bytes", "n_chars", "prefix"]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_chars long, prefix binary")


def answers(tables: DataFrame, limit: int = LIMIT) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit, within_limit`` from stored tables; no text is encoded again.

    ``within_limit`` is where a text is to be cut for a budget of ``limit``
    tokens: the most code points of the normalised text that cost no more.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(int(t[-1]), int(np.flatnonzero(t <= limit)[-1])) for t in (table_of(x.as_py()) for x in b.column(2))]
            total, within = (np.array([f[k] for f in found], np.int64) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(total), pa.array(total > limit), pa.array(within)], ["doc_id", "n_bytes", "n_tokens", "over_limit", "within_limit"])

    return tables.select("doc_id", "n_bytes", "prefix").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, within_limit long")


def tokens_at(prefix: bytes, chars: int) -> int:
    """Tokens of the first ``chars`` code points of the normalised text."""
    table = table_of(prefix)
    return int(table[min(max(chars, 0), len(table) - 1)])


def longest_within(prefix: bytes, budget: int) -> int:
    """Most code points of the normalised text that cost at most ``budget`` tokens."""
    return int(np.flatnonzero(table_of(prefix) <= budget)[-1]) if budget >= 0 else 0
