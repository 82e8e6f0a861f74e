"""Ranked lexical search of many items at once, by what their queries have in common.

Items are dealt to blocks of bounded size. In a block, sets of terms that several items
share are mined by pairing neighbours in each item's terms (frequent ones first)
as long as a pair stands in two items; every pair becomes a node. What is left of an item is paired up
to one root. The nodes form a DAG that the items share: a document's accumulator of a node
is the sum of those of its two parts, computed once however many items stand on it.

Documents are counted once into rows of terms. The contributions of asked terms go to
the tasks by document, each task combines accumulators of some documents at a time along the DAG and
keeps the best of each item; so what moves on is ``k`` rows for each item and task.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, partitions, small

NEAREST = 10
#: Terms of the items of a block, over all its items; one longer item makes its block longer.
BLOCK_TERMS = 1 << 17
#: Accumulators that a task holds at once.
CELLS = 1 << 22
#: Bytes of a text that are split at once.
SLICE = 1 << 20

_KEPT = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_TABLE = bytes((ord(chr(c).lower()) if c in _KEPT else c if c > 127 else 32) for c in range(256))


def term_counts(text: bytes) -> Counter[bytes]:
    """Terms of a text in UTF-8 and how often each stands: runs of ASCII letters and digits and of all beyond ASCII; A-Z lower-cased."""
    text, found, at = text.translate(_TABLE), Counter(), 0
    while at < len(text):
        end = text.find(b" ", at + SLICE)
        end = len(text) if end < 0 else end
        found.update(text[at:end].split())
        at = end
    return found


def _counted(rows: DataFrame, kind: str) -> DataFrame:
    """The rows' first columns with ``n``, ``terms`` and ``tfs`` of ``text``; rows without a term go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                b = whole.slice(at, 64)
                counts = [term_counts(x.as_py()) for x in b.column("text")]
                own = np.flatnonzero([bool(c) for c in counts])
                counts = [counts[i] for i in own]
                ends = pa.array(np.cumsum([0, *map(len, counts)]).astype(np.int32))
                terms = pa.ListArray.from_arrays(ends, pa.array([t for c in counts for t in c], pa.binary()))
                tfs = pa.ListArray.from_arrays(ends, pa.array([x for c in counts for x in c.values()], pa.int32()))
                n = pa.array([c.total() for c in counts], pa.int64())
                head = b.drop_columns(["text"]).take(pa.array(own))
                yield pa.RecordBatch.from_arrays([*head.columns, n, terms, tfs], [*head.schema.names, "n", "terms", "tfs"])

    return rows.mapInArrow(run, f"{kind}, n long, terms array<binary>, tfs array<int>")


def _paired(item: np.ndarray, sym: np.ndarray, chosen: np.ndarray, nodes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Items and symbols after each chosen place has joined the next one; left and right of the new nodes."""
    codes, node = np.unique(sym[chosen].astype(np.int64) * (1 << 31) + sym[chosen + 1], return_inverse=True)
    sym = sym.copy()
    sym[chosen] = nodes + node
    keep = np.ones(len(sym), bool)
    keep[chosen + 1] = False
    return item[keep], sym[keep], codes >> 31, codes & ((1 << 31) - 1)


def shared_plan(item: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The DAG of (item, term) pairs, each once: left and right of its nodes, ends of its rounds, root of each item, order of the terms.

    Nodes below the number of terms are terms in that order; nodes of a round stand on earlier ones only.
    """
    often = np.bincount(term)
    order = np.argsort(-often, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    by = np.lexsort((place[term], item))
    item, sym, nodes = item[by], place[term][by], len(order)
    left, right, ends = [], [], []

    def add(chosen: np.ndarray) -> None:
        nonlocal item, sym, nodes
        item, sym, a, b = _paired(item, sym, chosen, nodes)
        left.append(a)
        right.append(b)
        nodes += len(a)
        ends.append(nodes)

    while True:
        at = np.flatnonzero(item[1:] == item[:-1])
        if not len(at):
            break
        _, which, times = np.unique(sym[at] * (1 << 31) + sym[at + 1], return_inverse=True, return_counts=True)
        score = np.zeros(len(item) + 1)
        many = times[which] > 1
        # Ties go to one pair of symbols everywhere, so that items that share a run pair it alike.
        score[at[many] + 1] = (times[which] + which / (len(times) + 1))[many]
        peak = (score[1:] > score[:-1]) & (score[1:] >= np.append(score[2:], 0)) & (score[1:] > 0)
        chosen = np.flatnonzero(peak)
        if len(chosen):
            _, which, times = np.unique(sym[chosen] * (1 << 31) + sym[chosen + 1], return_inverse=True, return_counts=True)
            chosen = chosen[times[which] > 1]
        if not len(chosen):  # nothing is shared any more: pair up what is left of each item
            first = np.maximum.accumulate(np.where(np.append(True, item[1:] != item[:-1]), np.arange(len(item)), 0))
            chosen = at[(at - first[at]) % 2 == 0]
        add(chosen)
    roots = np.empty(len(item), np.int64)
    roots[item] = sym
    join = lambda x: np.concatenate(x).astype(np.int32) if x else np.zeros(0, np.int32)
    return join(left), join(right), np.array(ends, np.int32), roots.astype(np.int32), order


def plans(refs: DataFrame, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """``block, terms, left, right, ends, items, roots``: a row for each block of the items in ``refs(item_id, term)``."""
    blocks = refs.count() // block_terms + 1

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        item, items = pd.factorize(pdf["item_id"], use_na_sentinel=False)
        term, terms = pd.factorize(pdf["term"])
        left, right, ends, roots, order = shared_plan(item.astype(np.int64), term.astype(np.int64))
        names = [None if pd.isna(x) else int(x) for x in items]
        row = (int(pdf["block"].iloc[0]), [terms[i] for i in order], left, right, ends, names, roots)
        return pd.DataFrame([row], columns=["block", "terms", "left", "right", "ends", "items", "roots"])

    ddl = "block int, terms array<binary>, left array<int>, right array<int>, ends array<int>, items array<long>, roots array<int>"
    dealt = refs.select(F.pmod(F.xxhash64("item_id"), F.lit(blocks)).cast("int").alias("block"), "item_id", "term")
    return dealt.groupBy("block").applyInPandas(run, ddl)


class _Best:
    """The ``k`` best documents of each item of a block, higher scores first, then smaller ids, those without an id last."""

    def __init__(self, plan: dict, k: int) -> None:
        self.left, self.right, self.ends, self.roots = (np.array(plan[c], np.int64) for c in ("left", "right", "ends", "roots"))
        self.terms, self.items, self.k = plan["terms"], plan["items"], k
        self.least = np.zeros(len(self.roots), np.int64)
        self.found: list[tuple[np.ndarray, ...]] = []
        self.size = 0
        self.at_once = max(16, CELLS // (self.terms + len(self.left)))

    def add(self, doc: np.ndarray, slot: np.ndarray, value: np.ndarray, ids: np.ndarray, none: np.ndarray) -> None:
        """Contributions of terms to documents 0, 1, ...; ``ids`` and ``none`` (has no id) by document."""
        acc = np.zeros((self.terms + len(self.left), len(ids)), np.int64)
        acc[slot, doc] = value
        start = self.terms
        for end in self.ends.tolist():
            own = slice(start - self.terms, end - self.terms)
            acc[start:end] = acc[self.left[own]] + acc[self.right[own]]
            start = end
        scores = acc[self.roots]
        item, doc = np.nonzero((scores > 0) & (scores >= self.least[:, None]))
        self.found.append((item, scores[item, doc], ids[doc], none[doc]))
        self.size += len(item)
        if self.size > 200_000:
            self.cut()

    def cut(self) -> None:
        item, score, ids, none = (np.concatenate(x) for x in zip(*self.found, strict=True))
        order = np.lexsort((ids, none, -score, item))
        item, score, ids, none = (x[order] for x in (item, score, ids, none))
        place = np.arange(len(item)) - np.searchsorted(item, item)
        last = place == self.k - 1
        self.least[item[last]] = score[last]
        self.found = [tuple(x[place < self.k] for x in (item, score, ids, none))]
        self.size = len(self.found[0][0])

    def rows(self) -> pa.RecordBatch:
        self.cut()
        item, score, ids, none = self.found[0]
        return pa.RecordBatch.from_arrays([pa.array([self.items[i] for i in item], pa.int64()), pa.array(ids, mask=none), pa.array(score)], ["item_id", "doc_id", "score"])


def _combined(both: DataFrame, k: int) -> DataFrame:
    """``item_id, doc_id, score`` of the best of each task; in a partition and block the plan comes first, then contributions by document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: _Best | None = None
        held: list[np.ndarray] | None = None

        def work(all_: bool) -> None:
            """Combine the held documents; the last one may go on unless ``all_``."""
            nonlocal held
            if held is None:
                return
            starts = np.flatnonzero(np.concatenate([[True], held[0][1:] != held[0][:-1]]))
            whole = len(starts) - (not all_)
            done = 0
            while done < whole and (all_ or whole - done >= best.at_once):
                end = min(whole, done + best.at_once)
                s, e = starts[done], starts[end] if end < len(starts) else len(held[0])
                doc = np.searchsorted(starts[done:end], np.arange(s, e), side="right") - 1
                best.add(doc, held[1][s:e], held[2][s:e], held[3][starts[done:end]], held[4][starts[done:end]])
                done = end
            s = starts[done] if done < len(starts) else len(held[0])
            held = [x[s:] for x in held] if s < len(held[0]) else None

        for b in batches:
            plan_at = np.flatnonzero(np.array(b.column("plan").is_valid()))
            for s, e in zip([0, *plan_at.tolist()], [*plan_at.tolist(), b.num_rows], strict=True):
                if e == s:
                    continue
                part = b.slice(s, e - s)
                if s in plan_at:
                    work(True)
                    if best is not None and best.found:
                        yield best.rows()
                    best = _Best(json.loads(part.column("plan")[0].as_py()), k)
                    part = part.slice(1)
                if part.num_rows:
                    ids = part.column("doc_id")
                    cols = [part.column(c).to_numpy(zero_copy_only=False) for c in ("key", "slot", "value")]
                    cols += [ids.fill_null(0).to_numpy(), np.array(ids.is_null())]
                    cols = [x.astype(t) for x, t in zip(cols, (np.int64, np.int64, np.int64, np.int64, bool), strict=True)]
                    held = cols if held is None else [np.concatenate(x) for x in zip(held, cols, strict=True)]
                    work(False)
        work(True)
        if best is not None and best.found:
            yield best.rows()

    return both.mapInArrow(run, "item_id long, doc_id long, score long")


def search(items: DataFrame, docs: DataFrame, k: int = NEAREST, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` highest-scoring rows of ``docs(doc_id, text)`` for each item of ``items(item_id, text)``.

    Rows of ``items`` with one item_id are one item with all their terms; those without an id are one
    item too. Every row of ``docs`` is a document of its own, so one that repeats is ranked as often; a row
    without an id ranks behind others of its score. Texts that are null, empty or without a term make no document and ask for
    nothing. Other columns are ignored; an empty table on either side gives no rows.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text")
    asks = _counted(items.select(F.col("item_id").cast("long").alias("item_id"), text), "item_id long")
    asks = materialize(asks.select("item_id", F.explode("terms").alias("term")).distinct(), "asked")
    rows = docs.select(F.monotonically_increasing_id().alias("key"), F.col("doc_id").cast("long").alias("doc_id"), text)
    counted = materialize(_counted(rows, "key long, doc_id long"), "counted")
    number, words = counted.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(1))).first()
    posts = counted.select("key", "doc_id", "n", F.explode(F.arrays_zip("terms", "tfs")).alias("t"))
    posts = posts.select("key", "doc_id", "n", F.col("t.terms").alias("term"), F.col("t.tfs").cast("long").alias("tf"))

    terms = small(materialize(asks.select("term").distinct(), "asked-terms"))
    held = posts.select("term").join(terms, "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"))
    rarity = F.lit(float(2 * number + 2)) / (2 * F.col("df") + 1).cast("double")
    weights = materialize(held.select("term", F.floor(1000 * F.log(rarity)).cast("long").alias("w")), "weights")
    plan = materialize(plans(asks.join(weights, "term", "left_semi"), block_terms), "plans")
    slots = plan.select("block", F.posexplode("terms").alias("slot", "term")).join(weights, "term")
    slots = small(materialize(slots.where("w > 0"), "slots"))
    length = F.expr(f"100 - 90 + (90 * n * {number}L) div {words}L")
    parts = partitions(docs)
    value = F.expr("w * ((1000000000L * tf) div (1000 * tf + 8 * m))")
    own = posts.withColumn("m", length).join(slots, "term")
    own = own.select(F.pmod(F.xxhash64("key"), F.lit(parts)).cast("int").alias("task"), "block", "key", "doc_id", "slot", value.alias("value"))
    # As text: a null list in each row of contributions costs Arrow time in the square of a batch.
    own_plan = F.to_json(F.struct(F.size("terms").alias("terms"), "left", "right", "ends", "items", "roots")).alias("plan")
    heads = plan.select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("task"), "block", own_plan)
    both = own.withColumn("plan", F.lit(None).cast("string")).unionByName(heads, allowMissingColumns=True)
    both = both.repartitionById(parts, F.col("task")).sortWithinPartitions("block", F.col("key").asc_nulls_first())
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    found = _combined(both, k).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return found.select("item_id", "rank", "doc_id", "score")
