"""Personal data by weak supervision, in DataFrame functions only.

Four base kinds are exact patterns and always reported. Around them, loose
candidates (assignments, identifiers, local telephone numbers, account
numbers) get votes of five labelers: two on shape, a gazetteer of key words and
country codes, the words before the candidate, and a list of harmless forms. Each vote is
for, against or absent. Expectation-maximisation over the histogram of vote
patterns (at most 3 ** 5 rows for any corpus) estimates each labeler's
reliability without labels, and its posteriors train the final span classifier,
a logistic one over votes and three shape bits. Its spans are added under
kinds of their own.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: The base kinds in their order. Each pattern finds the same matches as the plain one in the
#: contract, but can't start inside a run that it has tried, and never gives back what it took.
BASE = (
    ("email", "@", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    ("ip", ".", r"[0-9](?<![0-9][0-9])[0-9]*+\.[0-9]++\.[0-9]++\.[0-9]++"),
    ("card", "", r"[0-9](?:[\x20-]?[0-9])++"),
    ("phone", "+", r"\+[0-9][\x20().0-9-]+[0-9]"),
)
#: The name and sign of an assignment.
KEY = r"[A-Za-z_][A-Za-z0-9_]++\x20?[:=]\x20?"
#: Loose candidates: assignments, local telephone numbers, identity numbers, account numbers, long mixed strings.
#: A value or run goes on to its end, however long; a dot belongs to it if more follows, and so do the signs that fill up base64.
CANDIDATE = (
    r"\b" + KEY + r"\"?[A-Za-z0-9_+/-]{6,}+(?:\.[A-Za-z0-9_+/-]++)*+={0,2}+\"?"
    r"|\(?\b[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}\b"
    r"|\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b"
    r"|\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?\b"
    r"|\b(?=[a-z]*[0-9])(?=[0-9]*[a-z])[a-z0-9]{12,}+\b"
)
WORDS = "password|passwd|pwd|passphrase|token|secret|api_?key|access_?key|private_?key|ssn|iban|passport|login|username|account|tel|phone|mobile|fax"
COUNTRIES = "AT|BE|BG|CH|CY|CZ|DE|DK|EE|ES|FI|FR|GB|GR|HR|HU|IE|IT|LT|LU|LV|MT|NL|NO|PL|PT|RO|SE|SI|SK"
CONTEXT = WORDS + "|call|contact|kontakt|konto|telefon|handy|appel|compte|mot de passe|contrase|cuenta|llam|reach"
#: A span that is not yet checked.
SPAN = "struct<start: int, end: int, hit: string>"
#: Code points in front of a candidate that tell its context.
BEFORE = 24
#: Spans of a text that are dealt with as one block.
BLOCK = 64
LABELERS = 5
FEATURES = 3


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is named."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _running(values: Column, op: Callable[[Column, Column], Column]) -> Column:
    """For each of an array's integers ``op`` over all before it, from 0.

    Blocks are summed first, then the blocks before each, then inside each, so that an
    item costs a block at most. A growing array as the state of an aggregate would be copied at each step.
    """
    over = lambda part: F.aggregate(part, F.lit(0), op)

    def placed(blocks: Column, sums: Column) -> Column:
        inside = lambda block, base: F.transform(block, lambda _, j: op(base, over(F.slice(block, F.lit(1), j))))
        return F.flatten(F.transform(blocks, lambda block, i: _once(over(F.slice(sums, F.lit(1), i)), lambda base: inside(block, base))))

    numbers = lambda v: F.sequence(F.lit(0), F.floor((F.size(v) - 1) / BLOCK).cast("int"))
    blocks = lambda v: F.transform(numbers(v), lambda i: F.slice(v, i * BLOCK + 1, F.lit(BLOCK)))
    none = F.expr("cast(array() as array<int>)")
    return _once(values, lambda v: F.when(F.size(v) > 0, _once(blocks(v), lambda b: _once(F.transform(b, over), lambda sums: placed(b, sums)))).otherwise(none))


def _in_blocks(items: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of each BLOCK items in turn; its arrays are joined."""
    numbers = F.sequence(F.lit(0), F.floor((F.size(items) - 1) / BLOCK).cast("int"))
    return F.when(F.size(items) > 0, F.flatten(F.transform(numbers, lambda i: _once(F.slice(items, i * BLOCK + 1, F.lit(BLOCK)), use))))


def spans_of(text: Column, pattern: str, needs: str = "") -> Column:
    """Array of (start, end, hit) of the leftmost non-overlapping matches, in code points, end exclusive.

    Places are summed from the lengths of the matches and of the text that
    they leave when it is split at them.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    # The text after the last match has no match beside it.
    parts = F.zip_with(found, F.split(text, pattern, -1), lambda hit, gap: F.struct(hit.alias("hit"), F.length(gap).alias("gap")))
    parts = F.filter(parts, lambda part: part["hit"].isNotNull())

    def placed(own: Column) -> Column:
        before = _running(F.transform(own, lambda p: p["gap"] + F.length(p["hit"])), lambda a, x: a + x)
        start = lambda p, at: (at + p["gap"]).cast("int")
        return F.zip_with(own, before, lambda p, at: F.struct(start(p, at).alias("start"), (start(p, at) + F.length(p["hit"])).cast("int").alias("end"), p["hit"].alias("hit")))

    holds = F.rlike(text, F.lit(pattern))
    return F.when(F.contains(text, F.lit(needs)) & holds if needs else holds, _once(parts, placed)).otherwise(F.expr(f"cast(array() as array<{SPAN}>)"))


def _holds(kind: str, hit: Column) -> Column:
    digits = F.regexp_replace(hit, "[^0-9]", "")
    if kind == "ip":
        part = lambda x: F.length(F.ltrim(x, F.lit("0"))) <= 3
        return F.forall(F.split(hit, r"\."), lambda x: part(x) & (F.lpad(F.ltrim(x, F.lit("0")), 3, "0") <= "255"))
    if kind == "card":
        return F.length(digits).between(14, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    return F.lit(True)


def _checked(spans: Column, rank: int, kind: str) -> Column:
    return F.transform(
        F.filter(spans, lambda s: _holds(kind, s["hit"])),
        lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind")),
    )


def base_spans(text: Column) -> Column:
    """Sorted array of (start, rank, end, kind) of the base kinds that pass their check."""
    each = []
    for rank, (kind, needs, pattern) in enumerate(BASE):
        each.append(_checked(spans_of(text, pattern, needs), rank, kind))
    return F.array_sort(F.concat(*each))


def _votes(s: Column, before: Column) -> list[Column]:
    """1 for, 0 against, 2 absent, of each labeler on a candidate."""
    hit = s["hit"]
    value = F.regexp_replace(hit, "^" + KEY, "")
    value = F.regexp_replace(value, '"', "")
    pick = lambda yes, no: F.when(yes, 1).when(no, 0).otherwise(2)
    return [
        pick(F.rlike(value, F.lit(r"^(?:(?=[a-f]*[0-9])(?=[0-9]*[a-f])[0-9a-f]{12,}|[0-9]{3}-[0-9]{2}-[0-9]{4}|\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4})$")), F.rlike(value, F.lit("^[A-Za-z_-]+$"))),
        pick(F.rlike(hit, F.lit(rf"(?i)^(?:[A-Za-z0-9_]*_)?(?:{WORDS})|^(?-i:{COUNTRIES})[0-9]{{2}}")), F.lit(False)),
        pick(F.rlike(F.lower(before), F.lit(rf"(?:{CONTEXT})[^\n]*$")), F.lit(False)),
        pick(F.lit(False), F.rlike(value, F.lit(r"^(?:[0-9]{1,3}(?:[.,][0-9]{3})+|(?:19|20)[0-9]{2}.*|[0-9]{1,6}[a-z]{1,3}|0{6,}.*|v[0-9].*)$"))),
        pick(F.rlike(value, F.lit("[0-9]")) & F.rlike(value, F.lit("[A-Za-z]")) & (F.length(value) >= 12), F.rlike(value, F.lit(r"^[A-Za-z]+$|^[0-9]{1,8}$"))),
    ]


def candidates(text: Column, base: Column) -> Column:
    """Array of (start, end, votes, bits, kind) of the candidates that meet no base span, or of whose value one is only a part."""
    near = F.rlike(text, F.lit("[0-9:=]"))
    found = F.when(near, spans_of(text, CANDIDATE)).otherwise(F.expr(f"cast(array() as array<{SPAN}>)"))

    def settled(s: Column, b: Column) -> Column:
        """Whether a base span meets a candidate and either goes beyond it or covers its value."""
        end = s["end"] - F.when(F.endswith(s["hit"], F.lit('"')), 1).otherwise(0)
        inner = F.rlike(F.substring(s["hit"], b["start"] - s["start"], F.lit(1)), F.lit("[A-Za-z0-9_/-]"))
        inside = (s["start"] < b["start"]) & inner & (b["end"] <= end) | (s["start"] <= b["start"]) & (b["end"] < end)
        return (b["start"] < s["end"]) & (s["start"] < b["end"]) & ~inside

    def unsettled(own: Column) -> Column:
        """Of a block of candidates those that no base span settles; only base spans that meet the block are tried."""
        first, last = F.get(own, F.lit(0))["start"], F.element_at(own, -1)["end"]
        near = F.filter(base, lambda b: (b["start"] < last) & (first < b["end"]))
        return _once(near, lambda n: F.filter(own, lambda s: ~F.exists(n, lambda b: settled(s, b))))

    def mark(s: Column, before: Column) -> Column:
        votes = F.concat(*[v.cast("string") for v in _votes(s, before)])
        bits = F.concat(*[F.when(x, "1").otherwise("0") for x in (F.rlike(s["hit"], F.lit("[0-9]")), F.contains(s["hit"], F.lit('"')), s["end"] - s["start"] >= 18)])
        kind = F.when(F.rlike(s["hit"], F.lit("[:=]")), "secret").when(F.rlike(s["hit"], F.lit(r"^[0-9]{3}-[0-9]{2}-")), "identity").when(F.rlike(s["hit"], F.lit("^[A-Z]{2}[0-9]{2}")), "account")
        kind = kind.when(F.rlike(s["hit"], F.lit("^[(0-9]")) & ~F.rlike(s["hit"], F.lit("[a-z]")), "local_phone").otherwise("secret")
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), votes.alias("votes"), bits.alias("bits"), kind.alias("kind"))

    def marked(own: Column) -> Column:
        """A block of candidates with votes; the text around the block is cut out once."""
        first = F.greatest(F.get(own, F.lit(0))["start"] - BEFORE, F.lit(0))
        stretch = F.substring(text, first + 1, F.element_at(own, -1)["start"] - first)
        context = lambda t, s: F.substring(t, F.greatest(s["start"] - BEFORE - first, F.lit(0)) + 1, F.least(s["start"] - first, F.lit(BEFORE)))
        return _once(stretch, lambda t: F.transform(own, lambda s: _once(context(t, s), lambda before: mark(s, before))))

    found = _once(found, lambda all_: F.when((F.size(base) == 0) | (F.size(all_) == 0), all_).otherwise(_in_blocks(all_, unsettled)))
    none = F.expr("cast(array() as array<struct<start: int, end: int, votes: string, bits: string, kind: string>>)")
    return _once(found, lambda all_: F.coalesce(_in_blocks(all_, marked), none))


@dataclass(frozen=True)
class SpanModel:
    """Weights by feature: vote v of labeler j at 3 j + v, then the shape bits, then the constant."""

    weights: tuple[float, ...]
    reliability: tuple[float, ...]

    def accepts(self, c: Column) -> Column:
        z = F.lit(self.weights[-1])
        for j in range(LABELERS):
            w = self.weights[3 * j : 3 * j + 3]
            z = z + F.element_at(F.array(*[F.lit(x) for x in w]), F.substring(c["votes"], j + 1, 1).cast("int") + 1)
        for j in range(FEATURES):
            z = z + F.when(F.substring(c["bits"], j + 1, 1) == "1", self.weights[3 * LABELERS + j]).otherwise(0.0)
        return z > 0


def fit_model(histogram: list[tuple[str, str, int]], rounds: int = 60) -> SpanModel:
    """EM over (votes, bits, count), then the classifier on the posteriors. No pattern: accepts nothing."""
    k = 3 * LABELERS + FEATURES + 1
    if not histogram:
        return SpanModel((0.0,) * (k - 1) + (-1.0,), (0.5,) * LABELERS)
    rows = sorted((tuple(map(int, v)), tuple(map(int, b)), n) for v, b, n in histogram)
    # Start: labelers are right more often than not.
    q = [1 / (1 + math.exp(-(sum((v == 1) - (v == 0) for v in vs) * 1.5 - 0.5))) for vs, _, _ in rows]
    total = sum(n for *_, n in rows)
    given: list = []
    for _ in range(rounds):
        pi = min(max(sum(p * n for p, (*_, n) in zip(q, rows, strict=True)) / total, 0.02), 0.98)
        given = []
        for j in range(LABELERS):
            by = [[0.5, 0.2, 1.0], [0.2, 0.5, 1.0]]  # class 0 and 1: pseudo-counts of votes 0, 1, absent
            for p, (vs, _, n) in zip(q, rows, strict=True):
                by[1][vs[j]] += p * n
                by[0][vs[j]] += (1 - p) * n
            given.append([[x / sum(c) for x in c] for c in by])
        q = []
        for vs, _, _ in rows:
            z = math.log(pi / (1 - pi)) + sum(math.log(given[j][1][v] / given[j][0][v]) for j, v in enumerate(vs) if v < 2)
            q.append(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
    x = [[float(v == vs[j]) for j in range(LABELERS) for v in (0, 1, 2)] + [float(b) for b in bits] + [1.0] for vs, bits, _ in rows]
    w = [0.0] * k
    for step in range(400):
        g = [0.02 * a for a in w]
        for xi, p, (*_, n) in zip(x, q, rows, strict=True):
            d = (1 / (1 + math.exp(-max(-30.0, min(30.0, sum(a * b for a, b in zip(w, xi, strict=True)))))) - p) * n / total
            for i, b in enumerate(xi):
                g[i] += d * b
        rate = 3.0 / (1 + step / 100)
        w = [a - rate * b for a, b in zip(w, g, strict=True)]
    right = tuple(round(given[j][1][1] / (given[j][1][1] + given[j][0][1]), 4) for j in range(LABELERS))
    return SpanModel(tuple(round(a, 6) for a in w), right)


def _annotated(docs: DataFrame, *keep: str) -> DataFrame:
    rows = docs.select(*keep, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text_"))
    rows = rows.withColumn("base_", base_spans(F.col("text_")))
    return rows.withColumn("cand_", candidates(F.col("text_"), F.col("base_")))


def _model(rows: DataFrame) -> SpanModel:
    """The histogram of patterns has at most 3 ** 5 * 2 ** 3 rows."""
    per = rows.select(F.explode("cand_").alias("c")).groupBy("c.votes", "c.bits").count()
    return fit_model([tuple(r) for r in per.collect()])


def _all_spans(base: Column, cand: Column, model: SpanModel) -> Column:
    added = F.transform(F.filter(cand, model.accepts), lambda c: F.struct(c["start"].alias("start"), F.lit(len(BASE)).alias("rank"), c["end"].alias("end"), c["kind"].alias("kind")))
    return F.array_sort(F.concat(base, added))


def find(docs: DataFrame) -> DataFrame:
    """``doc_id, base, spans`` of each row of ``docs(doc_id, text)``; spans are (start, rank, end, kind) arrays.

    Null texts count as empty and have no span. A repeated row comes out as often
    as it stands in ``docs``; other columns are ignored; an empty table gives no
    rows. Time grows with a text's length and its number of hits, so long texts are taken whole.
    """
    rows = materialize(_annotated(docs, "doc_id").drop("text_"), "pii")
    return rows.select("doc_id", F.col("base_").alias("base"), _all_spans(F.col("base_"), F.col("cand_"), _model(rows)).alias("spans"))


def _replaced(text: Column, spans: Column) -> Column:
    """``text`` with each span replaced by its kind in brackets; of spans that overlap, the first to start names all.

    Spans go in blocks. A block's stretch of text is cut out once, and its pieces
    are cut from that, so places near the end of a long text cost no more than others.
    """

    def block(own: Column) -> Column:
        first, last = F.get(own, F.lit(0))["from"], F.element_at(own, -1)["to"]
        stretch = F.substring(text, first + 1, last - first)
        piece = lambda t: lambda p: F.concat(F.substring(t, p["from"] - first + 1, p["to"] - p["from"]), F.lit("["), F.upper(p["kind"]), F.lit("]"))
        return _once(stretch, lambda t: F.transform(own, piece(t)))

    def cut(own: Column) -> Column:
        ends = F.transform(own, lambda s: s["end"])
        pieces = F.zip_with(own, _running(ends, lambda a, x: F.greatest(a, x)), lambda s, at: F.struct(at.alias("from"), s["start"].alias("to"), s["kind"].alias("kind")))
        kept = F.filter(pieces, lambda p: p["to"] >= p["from"])
        parts = _once(kept, lambda k: F.array_join(_in_blocks(k, block), ""))
        return F.concat(parts, F.substring(text, F.array_max(ends) + 1, F.length(text)))

    return F.when(F.size(spans) > 0, _once(spans, cut)).otherwise(text)


def redacted(docs: DataFrame) -> DataFrame:
    """``docs(text, ...)`` with each span replaced by its kind in brackets; of spans that overlap, the first to start names all.

    All columns stay, whatever their names. Null and empty texts stay as they are; so do rows that
    repeat; an empty table gives no rows. Time grows with a text's length and number of spans.
    """
    own = [F.col(f"`{c}`") for c in docs.columns]
    model = _model(_annotated(docs))
    rows = docs.select(F.col("text"), F.struct(*[c.alias(f"c{i}") for i, c in enumerate(own)]).alias("row_"))
    rows = _annotated(rows, "row_").withColumn("spans_", _all_spans(F.col("base_"), F.col("cand_"), model))
    text = F.when(F.size("spans_") > 0, _replaced(F.col("text_"), F.col("spans_")))
    return rows.select(*[(F.coalesce(text, F.col(f"row_.c{i}")) if n == "text" else F.col(f"row_.c{i}")).alias(n) for i, n in enumerate(docs.columns)])


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat(s["kind"], F.lit(":"), s["start"], F.lit(":"), s["end"])), ",")
