"""Hard negatives by bounds along a spanning tree of anchors.

Anchors are dealt to blocks of neighbours, and each block gets a minimum spanning tree. For a
candidate x the score at an anchor differs from that at its parent by at most the length of
their edge times the norm of x. So a score known at the parent bounds the one at the child, and
only candidates whose bounds meet a window that the child still has open are scored again;
the others pass wider bounds on to the grandchildren.

Two passes go over all rows: the first finds each anchor's positives, whose scores make the windows, the
second the negatives in them. Rows are dealt to parts by hash and stay where they are held, blocks of
anchors stream past; a part gives on only its best few for each anchor and window.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, partitions
from .vectors import matrix

POSITIVES, NEGATIVES = 5, 10
#: Percent of the positive's score between which a negative's lies.
LOW, HIGH = 30, 90
SCALE = 256
#: Anchors of a block and its tree; rows that a task holds while blocks stream past; blocks that stream past together.
BLOCK, PART, STREAM = 512, 4096, 16
#: Anchors, by hash of the id, around which blocks are formed, at most.
PIVOTS = 1024
#: Candidates of the largest upper bounds that are scored first, for each anchor.
FIRST = 64


def usable(vector: Column) -> Column:
    """Neither null nor holding null or non-finite components, also when scaled."""
    v = F.transform(vector.cast("array<double>"), lambda x: x * SCALE)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(False))


def exact(rows: np.ndarray, one: np.ndarray) -> np.ndarray:
    """Integer inner products of whole-numbered rows with one vector; beyond 63 bits the limits of a long."""
    bound = float(np.abs(rows).max(initial=0)) * float(np.abs(one).max(initial=0)) * max(1, len(one))
    if bound < 2**53:
        return (rows @ one).astype(np.int64)
    if bound < 2**62 and max(np.abs(rows).max(), np.abs(one).max()) < 2**62:
        return rows.astype(np.int64) @ one.astype(np.int64)
    a = [int(x) for x in one]
    sums = (sum(int(x) * y for x, y in zip(r, a, strict=True)) for r in rows)
    return np.array([min(max(s, -(2**63)), 2**63 - 1) for s in sums], np.int64)


def spanning_tree(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order, parent (place in that order, the first has none) and edge length of a minimum spanning tree of the rows, parents first."""
    n = len(x)
    square = (x * x).sum(1)
    far = np.full(n, np.inf)
    near = np.full(n, -1)
    order, place = np.zeros(n, np.int64), np.full(n, -1)
    now = int(np.argmin(np.abs(x - x.mean(0)).sum(1)))
    for i in range(n):
        order[i], place[now] = now, i
        d = np.maximum(square + square[now] - 2 * (x @ x[now]), 0)
        closer = (d < far) & (place < 0)
        far[closer], near[closer] = d[closer], now
        now = int(np.argmin(np.where(place < 0, far, np.inf)))
    parent = np.where(near[order] < 0, -1, place[near[order]])
    own, up = x[order], x[order[np.maximum(parent, 0)]]
    edge = np.sqrt(((own - up) ** 2).sum(1)) * (1 + 1e-9)
    return order, parent, np.where(parent < 0, 0.0, edge)


class Held(NamedTuple):
    """Candidates of one part: identity, id, label, vectors and their norms."""

    key: np.ndarray
    ids: np.ndarray
    label: np.ndarray
    x: np.ndarray
    norm: np.ndarray


def scan(held: Held, anchors: dict[str, np.ndarray], k: int, positives: bool) -> tuple[list[tuple[np.ndarray, ...]], int]:
    """Best candidates of a block of anchors in tree order, and how many scores were computed.

    ``anchors`` has ``key, label, x, parent, edge`` and ``low, high`` (windows of scores, a row each).
    A hit is (anchor's place, window, candidate's place, score): the ``k`` best of each window, by score, then id.
    """
    n = len(anchors["key"])
    left = np.bincount(anchors["parent"][anchors["parent"] >= 0], minlength=n)
    bounds: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    hits, scored = [], 0
    for i in range(n):
        p, one = int(anchors["parent"][i]), anchors["x"][i]
        if p < 0:
            lower, upper = np.full(len(held.ids), -np.inf), np.full(len(held.ids), np.inf)
        else:
            reach = anchors["edge"][i] * held.norm
            reach += 1e-6 * (1 + reach)
            lower, upper = bounds[p][0] - reach, bounds[p][1] + reach
            left[p] -= 1
            if not left[p]:
                del bounds[p]
        other = (held.label == anchors["label"][i]) == positives
        if positives:
            other &= held.key != anchors["key"][i]
        low, high = anchors["low"][i], anchors["high"][i]
        open_ = np.zeros(len(other), bool)
        for a, b in zip(low, high, strict=True):
            if a <= b:
                open_ |= (upper >= a) & (lower <= b)
        todo = np.flatnonzero(other & open_)
        if p < 0 and left[i]:
            todo = np.arange(len(other))  # the children's bounds come from here
        score = np.zeros(len(other), np.int64)
        known = np.zeros(len(other), bool)

        def look(at: np.ndarray) -> None:
            nonlocal scored
            if len(at):
                score[at] = exact(held.x if len(at) == len(held.x) else held.x[at], one)
                known[at] = True
                scored += len(at)

        if p >= 0 and len(todo) > FIRST:  # the best bounds first: they close windows for the rest
            lead = todo[np.argpartition(-upper[todo], FIRST - 1)[:FIRST]]
            look(lead)
            wanted = np.zeros(len(todo), bool)
            for a, b in zip(low, high, strict=True):
                inside = np.sort(score[lead][(score[lead] >= a) & (score[lead] <= b) & other[lead]])
                least = max(a, inside[-k]) if len(inside) >= k else a
                if a <= b:
                    wanted |= (upper[todo] >= least) & (lower[todo] <= b)
            todo = todo[wanted & ~known[todo]]
        look(todo)
        if left[i]:
            # Scores beyond what a double tells apart keep a margin.
            s = score[known].astype(float)
            lower[known], upper[known] = s - np.abs(s) * 1e-15, s + np.abs(s) * 1e-15
            bounds[i] = lower, upper
        own = known & other
        for w, (a, b) in enumerate(zip(low, high, strict=True)):
            at = np.flatnonzero(own & (score >= a) & (score <= b))
            if len(at) > k:
                least = np.partition(score[at], len(at) - k)[len(at) - k]
                at = at[score[at] >= least]
            at = at[np.lexsort((held.ids[at], -score[at]))[:k]]
            if len(at):
                hits.append((np.full(len(at), i), np.full(len(at), w), at, score[at]))
    return hits, scored


def _blocks(anchors: DataFrame, block: int) -> DataFrame:
    """``anchors`` with ``block``: by nearest pivot, large ones dealt out by hash; pivots are at most ``PIVOTS`` rows a length."""
    rows = anchors.withColumn("size", F.size("vec"))
    sizes = rows.groupBy("size").count()  # a row for each vector length
    many = {r["size"]: min(PIVOTS, -(-r["count"] // block)) for r in sizes.collect()}
    turn = F.row_number().over(Window.partitionBy("size").orderBy(F.xxhash64("key"), "key"))
    pivots = rows.select("size", "key", "vec").withColumn("turn", turn).where(F.col("turn") <= PIVOTS)
    points: dict[int, np.ndarray] = {}
    for size in many:
        own = pivots.where((F.col("size") == size) & (F.col("turn") <= many[size])).orderBy("turn").select("vec").collect()
        points[size] = np.array([r["vec"] for r in own], float).reshape(len(own), size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, near = b.column("size").to_numpy(), np.zeros(b.num_rows, np.int32)
            for size in np.unique(sizes):
                at, p = np.flatnonzero(sizes == size), points[int(size)]
                x = matrix(b.column("vec").take(pa.array(at))).reshape(len(at), size)
                near[at] = ((p * p).sum(1)[None, :] - 2 * x @ p.T).argmin(1) if size else 0
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(near)], [*b.schema.names, "pivot"])

    placed = materialize(rows.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + ", pivot int"), "anchors-placed")
    pieces = placed.groupBy("size", "pivot").agg(F.ceil(F.count("*") / block).cast("int").alias("pieces"))
    pieces = pieces.withColumn("start", F.sum("pieces").over(Window.partitionBy("size").orderBy("pivot")) - F.col("pieces"))
    placed = placed.join(F.broadcast(pieces), ["size", "pivot"])  # at most PIVOTS rows for each vector length
    return placed.withColumn("block", (F.col("start") + F.pmod(F.xxhash64("key"), F.col("pieces"))).cast("int")).drop("start", "pieces", "pivot")


def forest(anchors: DataFrame, block: int = BLOCK) -> DataFrame:
    """``key, vec_id, label, vec, size, block, place, parent, edge``: anchors in blocks of neighbours of about ``block``, each a spanning tree."""
    rows = _blocks(anchors, block)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        order, parent, edge = spanning_tree(np.array(pdf["vec"].tolist(), float).reshape(len(pdf), -1))
        out = pdf.iloc[order].copy()
        return out.assign(place=np.arange(len(out), dtype=np.int32), parent=parent.astype(np.int32), edge=edge)

    ddl = "key long, vec_id long, label int, vec array<double>, size int, block int, place int, parent int, edge double"
    return materialize(rows.select("key", "vec_id", "label", "vec", "size", "block").groupBy("size", "block").applyInPandas(run, ddl), "forest")


def _grid(rows: DataFrame, anchors: DataFrame, k: int, positives: bool, part: int) -> DataFrame:
    """``key, window, id, candidate, score``: the ``k`` best of each part for each anchor (``key``) and window of ``anchors``."""
    tasks = partitions(rows)
    parts = -(-max(1, rows.count()) // (part * tasks)) * tasks
    streams = anchors.groupBy("size").agg(F.max(F.floor(F.col("block") / STREAM)).cast("int").alias("streams"))
    own = F.pmod(F.xxhash64("key"), F.lit(parts)).cast("int").alias("part")
    held = rows.join(F.broadcast(streams), "size")  # a row for each vector length
    held = held.select("size", F.explode(F.sequence(F.lit(0), "streams")).alias("stream"), own, "key", "vec_id", "label", "vec")
    past = anchors.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).withColumn("stream", F.floor(F.col("block") / STREAM).cast("int"))
    none = F.expr("cast(array() as array<bigint>)")  # not null: null lists cost Arrow time in the square of a batch
    held = held.withColumns({"low": none, "high": none})
    both = past.select(*held.columns, "block", "place", "parent", "edge").unionByName(held, allowMissingColumns=True)
    both = both.repartitionById(tasks, F.pmod(F.col("part") + F.col("stream"), F.lit(tasks)).cast("int"))
    both = both.sortWithinPartitions("size", "stream", "part", F.col("block").asc_nulls_first(), "place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, waiting, held = None, [], None

        def found(group: tuple, rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            nonlocal held
            t = pa.Table.from_batches(rows).combine_chunks()
            col = lambda c: t.column(c).to_numpy()
            x = matrix(t.column("vec").combine_chunks()).reshape(t.num_rows, group[0])
            if group[3] < 0:
                held = Held(col("key"), col("vec_id"), col("label"), x, np.sqrt((x * x).sum(1)) * (1 + 1e-9))
                return
            if held is None:
                return
            block = {c: col(c) for c in ("key", "label", "parent", "edge")} | {"x": x}
            block |= {c: np.array(t.column(c).to_pylist(), np.int64).reshape(t.num_rows, -1) for c in ("low", "high")}
            hits, _ = scan(held, block, k, positives)
            if hits:
                i, w, at, score = (np.concatenate(z) for z in zip(*hits, strict=True))
                cols = [block["key"][i], w.astype(np.int32), held.ids[at], held.key[at], score]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["key", "window", "id", "candidate", "score"])

        for b in batches:
            keys = np.stack([b.column(c).fill_null(-1).to_numpy().astype(np.int64) for c in ("size", "stream", "part", "block")], 1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
            for s, e in zip(cuts, cuts[1:], strict=False):
                if e == s:
                    continue
                if waiting and now != tuple(keys[s]):
                    yield from found(now, waiting)
                    waiting = []
                if now is None or now[:3] != tuple(keys[s, :3]):
                    held = None
                now = tuple(keys[s])
                waiting.append(b.slice(s, e - s))
        if waiting:
            yield from found(now, waiting)

    return both.mapInArrow(run, "key long, window int, id long, candidate long, score long")


def mine(vectors: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, block: int = BLOCK, part: int = PART) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` of ``vectors(vec_id, embedding, label)``.

    ``is_anchor`` tells the anchors by ``vec_id``. Components become floor(256 x), scores are integer inner products of
    vectors of one length, ties go to the smaller id. Where vec_id is divisible by 7 the label is first
    moved on by one, modulo 10. An anchor's positives are its best other rows of its label, and for each the best
    rows of other labels follow whose score is from 30 to 90 percent of the positive's.

    Rows take no part whose label, id or vector is null, or that hold a null or non-finite component (also
    after scaling). Zero and empty vectors score 0. Rows that repeat, or share an id, are rows of their own, as anchors
    too. Scores beyond 63 bits count as the limits of a long. Other columns are ignored; an empty table gives no rows.
    """
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("int").alias("label"), F.col("embedding").alias("vec"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable(F.col("vec")))
    # Whole numbers as doubles: floor to a double has no limit.
    whole = F.transform("vec", lambda x: _floor(x.cast("double") * SCALE))
    rows = rows.select(F.monotonically_increasing_id().alias("key"), "vec_id", moved.cast("int").alias("label"), whole.alias("vec"))
    rows = materialize(rows.withColumn("size", F.size("vec")), "hard-rows")
    tree = forest(rows.where(is_anchor).drop("size"), block)
    any_ = (F.array(F.lit(-(2**63)).cast("long")), F.array(F.lit(2**63 - 1).cast("long")))
    near = _grid(rows, tree.withColumns({"low": any_[0], "high": any_[1]}), positives, True, part)
    best = Window.partitionBy("key").orderBy(F.desc("score"), "id", "candidate")
    near = materialize(near.withColumn("n", F.row_number().over(best)).where(F.col("n") <= positives), "positives")

    # 30 p <= 100 s <= 90 p for whole s; p div 10 and p mod 10 keep within 63 bits.
    tens, ones = F.expr("(score - pmod(score, 10)) div 10"), F.pmod(F.col("score"), F.lit(10))
    low = tens * (LOW // 10) + F.ceil(ones * (LOW // 10) / 10).cast("long")
    high = tens * (HIGH // 10) + F.floor(ones * (HIGH // 10) / 10).cast("long")
    windows = near.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("n", low.alias("low"), high.alias("high")))).alias("w"))  # at most ``positives`` each
    none = F.array_repeat(F.lit(0).cast("long"), positives - F.size("w"))
    windows = windows.select("key", F.concat(F.transform("w", lambda x: x["low"]), F.transform(none, lambda x: x + 1)).alias("low"), F.concat(F.transform("w", lambda x: x["high"]), none).alias("high"))
    found = _grid(rows, _kept_trees(tree, windows, positives), negatives, False, part)
    rank = F.row_number().over(Window.partitionBy("key", "window").orderBy(F.desc("score"), "id", "candidate"))
    found = found.withColumn("rank", rank).where(F.col("rank") <= negatives)
    pairs = near.select("key", (F.col("n") - 1).alias("window"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    pairs = pairs.join(tree.select("key", F.col("vec_id").alias("anchor_id")), "key")
    found = found.select("key", "window", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    return found.join(pairs, ["key", "window"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def _kept_trees(tree: DataFrame, windows: DataFrame, positives: int) -> DataFrame:
    """The trees with their anchors' windows; an anchor without positives stays as a node and has none open."""
    shut = [F.array_repeat(F.lit(x).cast("long"), positives) for x in (1, 0)]
    return tree.join(windows, "key", "left").withColumns({"low": F.coalesce("low", shut[0]), "high": F.coalesce("high", shut[1])})


def _floor(x: Column) -> Column:
    """Floor as a double, of any size."""
    return F.when(F.abs(x) < 2.0**52, F.floor(x).cast("double")).otherwise(x)
