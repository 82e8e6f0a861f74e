"""Packing documents into sequences by cutting-stock column generation.

A document's ids are cut into full sequences and one remainder. The remainders'
length histogram (at most 1023 rows for any corpus) is a cutting-stock problem:
a linear program over patterns, ways to fill a sequence. Columns are priced by
knapsack dynamic programming with the program's dual values until no pattern
improves it by more than a tolerance. The pattern counts are rounded down,
what they leave over is packed by best fit, and documents ranked within their
length are dealt to the patterns' places.

Where lengths do not add up, whole remainders leave padding. Then the sequences
that are filled worst are taken apart, and their documents, one after another,
are cut to fill the gaps of the others. So padding stays small for any lengths, and
the program's part is that few documents are cut.
"""

from __future__ import annotations

import itertools
import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize
from .encoding import encoder

CAPACITY = 1024
END_ID = 0
#: Gap between the program's value and its lower bound at which columns stop.
GAP = 1e-4
#: Columns in a row that must lower the program's value by GAP together; else they stop.
PATIENCE = 64
#: Largest part of a document that is added to each length's demand, so that no two ratios tie.
NUDGE = 1e-3
#: Columns after which the inverse is computed anew, as its updates lose digits.
REFRESH = 64
#: Smallest gap that documents are cut for.
LEAST_CUT = 8
#: Runs of a length class that rank on their own.
RUNS = 256

Pattern = tuple[tuple[int, int], ...]


def knapsack(values: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[float, Pattern]:
    """Most valuable multiset of lengths within the capacity, by dynamic programming over capacities.

    ``best[c]`` is the most for capacity c. All lengths are tried at once for each c.
    """
    best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    order = np.argsort(lengths)
    ls, vs = lengths[order], values[order]
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        n = np.searchsorted(ls, c, side="right")
        if n:
            total = vs[:n] + best[c - ls[:n]]
            k = int(total.argmax())
            if total[k] > best[c] + 1e-12:
                best[c], choice[c] = total[k], order[k]
    counts: Counter[int] = Counter()
    c = capacity
    while c > 0:
        if choice[c] < 0:
            c -= 1
        else:
            counts[int(choice[c])] += 1
            c -= int(lengths[choice[c]])
    return float(best[capacity]), tuple(sorted(counts.items()))


def fill(counts: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Greedy patterns by length: the longest length left, then the longest that fits, as often as demand allows."""
    left = dict(sorted(counts.items(), reverse=True))
    out: list[tuple[Pattern, int]] = []
    while left:
        room, pattern = capacity, {}
        for n in left:
            k = min(room // n, left[n])
            if k:
                pattern[n] = k
                room -= k * n
            if not room:
                break
        times = min(left[n] // k for n, k in pattern.items())
        out.append((tuple(sorted(pattern.items())), times))
        for n, k in pattern.items():
            left[n] -= k * times
            if not left[n]:
                del left[n]
    return out


def _program(counts: dict[int, int], capacity: int, gap: float) -> list[tuple[Pattern, int]]:
    """Patterns of (length, copies) and how often each is used; together they hold exactly ``counts``.

    Revised simplex with the basis' inverse at hand: the greedy patterns
    start from one pattern per length, the knapsack names the column to enter,
    and the ratio test the one to leave. It ends when the bound value / price
    (Farley), or that of all ids over the capacity, is within ``gap``, no column is left to enter, or the last PATIENCE priced
    columns lowered the value by less than ``gap`` together. Many lengths of few documents make ratios tie, and steps
    of no length could go round for ever: each demand is nudged by its own small amount. The patterns' floors are taken, and
    what is left, less than a sequence for each basis column, is filled greedily. Patterns hold few lengths, so an
    entering column changes few rows and columns of the inverse.
    """
    lengths = np.array(sorted(counts), np.int64)
    demand = np.array([counts[int(n)] for n in lengths], float)
    if not len(lengths):
        return []
    least = math.ceil(float(lengths @ demand) / capacity - 1e-9)  # a whole number of sequences can't be less
    demand += NUDGE * (1 + np.random.default_rng(0).random(len(lengths))) / 2
    basis: list[Pattern] = [((i, int(capacity // n)),) for i, n in enumerate(lengths)]
    inverse = np.diag([1.0 / p[0][1] for p in basis])
    x = inverse @ demand
    seeds = [tuple((int(np.searchsorted(lengths, n)), k) for n, k in p) for p, _ in fill(counts, capacity)]
    bound = float(lengths @ demand) / capacity
    dual = inverse.sum(0)
    near = lambda: x.sum() <= max(bound * (1 + gap), least)
    values: list[float] = []
    for entered in itertools.count(1):
        if near():
            break
        if seeds:
            pattern = seeds.pop(0)
            value = sum(dual[i] * k for i, k in pattern)
            if value <= 1 + 1e-9:
                continue
        else:
            value, pattern = knapsack(np.maximum(dual, 0), lengths, capacity)
            bound = max(bound, x.sum() / max(value, 1.0))
            values.append(float(x.sum()))
            stalled = len(values) > PATIENCE and values[-PATIENCE - 1] - values[-1] < gap * values[-1]
            if value <= 1 + 1e-9 or stalled or near():
                break
        d = inverse[:, [i for i, _ in pattern]] @ np.array([k for _, k in pattern], float)
        able = d > 1e-7
        ratio = np.where(able, np.maximum(x, 0) / np.where(able, d, 1), np.inf)
        out = int(ratio.argmin())
        step = ratio[out]
        x -= step * d
        x[out] = step
        basis[out] = pattern
        if entered % REFRESH == 0:
            columns = np.zeros_like(inverse)
            for j, p in enumerate(basis):
                columns[[i for i, _ in p], j] = [k for _, k in p]
            inverse = np.linalg.inv(columns)
            x, dual = inverse @ demand, inverse.sum(0)
            continue
        old = inverse[out].copy()
        row = old / d[out]
        d[out] = 0
        rows, cols = np.flatnonzero(np.abs(d) > 1e-12), np.flatnonzero(np.abs(row) > 1e-15)
        inverse[np.ix_(rows, cols)] -= d[rows, None] * row[cols]
        inverse[out] = row
        dual += row * (1 - d.sum()) - old
    left = dict(counts)
    used: Counter[Pattern] = Counter()
    for j in np.argsort(-x):
        p = tuple((int(lengths[i]), k) for i, k in basis[j])
        times = min([int(x[j] + 1e-7), *(left[n] // k for n, k in p)])
        if times > 0:
            used[p] += times
            for n, k in p:
                left[n] -= k * times
    for p, times in fill({n: c for n, c in left.items() if c}, capacity):
        used[p] += times
    return sorted(used.items())


def sequences(used: list[tuple[Pattern, int]]) -> int:
    return sum(times for _, times in used)


def solve(counts: dict[int, int], capacity: int = CAPACITY, gap: float = GAP) -> list[tuple[Pattern, int]]:
    """Patterns of (length, copies) and how often each is used; together they hold exactly ``counts``.

    The program is over all lengths, at most ``capacity`` of them. Should its rounding leave more sequences
    than the greedy patterns that it starts from, those are taken.
    """
    return min(_program(counts, capacity, gap), sorted(fill(counts, capacity)), key=sequences)


@dataclass
class Plan:
    """Where each rank of each length goes.

    ``whole`` has, for each length, runs of ranks: first rank, copies in a sequence, first
    sequence, first offset. Ranks from ``kept[length]`` on are cut: their ids,
    in one row from ``begins[length]``, fill the gaps. ``gaps`` has runs of sequences with one gap: its
    start in that row, its size, the first sequence, its offset there.
    """

    whole: dict[int, list[tuple[int, int, int, int]]] = field(default_factory=dict)
    kept: dict[int, int] = field(default_factory=dict)
    begins: dict[int, int] = field(default_factory=dict)
    gaps: list[tuple[int, int, int, int]] = field(default_factory=list)
    sequences: int = 0


def plan(counts: dict[int, int], full: int, capacity: int = CAPACITY, least: int = LEAST_CUT) -> Plan:
    """Whole places for most documents, and gaps for those of the worst filled sequences."""
    size = lambda p: sum(n * k for n, k in p)
    used = sorted(solve(counts, capacity), key=lambda u: (size(u[0]), u[0]))
    room = sum(times * (capacity - size(p)) for p, times in used if capacity - size(p) >= least)
    cut: Counter[int] = Counter()
    kept: list[tuple[Pattern, int]] = []
    taken = 0
    for p, times in used:
        gap = capacity - size(p)
        gap = gap if gap >= least else 0
        # Each sequence taken apart brings its ids and takes its own gap away.
        some = max(0, min(times, (room - taken) // (size(p) + gap))) if gap else 0
        taken += some * size(p)
        room -= some * gap
        for n, k in p:
            cut[n] += k * some
        if times > some:
            kept.append((p, times - some))
    out = Plan({capacity: [(0, 1, 0, 0)]}, {n: c - cut[n] for n, c in counts.items()} | {capacity: full}, {}, [], full)
    at = 0
    for n in sorted(cut, reverse=True):
        out.begins[n] = at
        at += n * cut[n]
    dealt: Counter[int] = Counter()
    filled = 0
    for p, times in kept:  # the largest gaps first
        offset = 0
        for n, k in sorted(p, reverse=True):
            out.whole.setdefault(n, []).append((dealt[n], k, out.sequences, offset))
            dealt[n] += k * times
            offset += n * k
        if capacity - offset >= least:
            out.gaps.append((filled, capacity - offset, out.sequences, offset))
            filled += times * (capacity - offset)
        out.sequences += times
    return out


def token_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, with_ids: bool = True) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens, ids`` (little-endian 32-bit) of each full piece and remainder.

    A document's ids are those of its whole text (null: empty) and END_ID.
    Without ``with_ids`` only remainders, which may be cut, have them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            for first, ids, starts in enc.documents(b.column(1), END_ID):
                total = np.diff(starts)
                number = -(-total // capacity)
                doc = np.repeat(np.arange(len(total)), number)
                start = (np.arange(len(doc)) - (np.cumsum(number) - number)[doc]) * capacity
                length = np.minimum(capacity, total[doc] - start)
                raw, at = ids.astype("<u4").tobytes(), 4 * (starts[doc] + start)
                view = memoryview(raw)
                cuts = list(zip(at.tolist(), (at + 4 * length).tolist(), strict=True))
                crc = pa.array([zlib.crc32(view[s:e]) for s, e in cuts], pa.int64())
                held = pa.array([raw[s:e] if with_ids or e - s < 4 * capacity else None for s, e in cuts], pa.binary())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first).take(pa.array(doc)), pa.array(start), pa.array(length), crc, pa.array(total[doc]), held], names)

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary")


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, with_ids: bool = True) -> DataFrame:
    """Place each piece of ``docs(doc_id, text)``: its columns (``ids`` if asked for), ``sequence_id`` and ``offset``.

    A null text is a document of the end id alone; rows that repeat are packed
    each by itself; other columns are ignored; an empty table gives no rows. Only
    the histogram of lengths and the plan, at most ``capacity`` lengths and a few
    thousand runs of places, pass through the driver. Ranks within a length come from
    counts of (length, run by hash), so a length of a third of all rows is
    spread over all runs. Ids go along only with rows whose run has documents to cut.
    """
    pieces = materialize(token_pieces(docs, path, capacity, with_ids), "pieces")
    runs = max(RUNS, int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))
    order = ("doc_id", "start", "ids_crc32", "doc_tokens")
    keyed = pieces.withColumn("run", F.pmod(F.xxhash64(*order), F.lit(runs)))
    per = keyed.groupBy("length", "run").agg(F.count("*").alias("n"))
    per = materialize(per, "lengths")
    counts = {int(r[0]): int(r[1]) for r in per.groupBy("length").agg(F.sum("n")).collect()}
    full = counts.pop(capacity, 0)
    places = plan(counts, full, capacity)
    before = Window.partitionBy("length").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    starts = per.withColumn("run_start", F.coalesce(F.sum("n").over(before), F.lit(0)))
    inside = Window.partitionBy("length", "run").orderBy(*order)
    if not with_ids:
        bounds = pieces.sparkSession.createDataFrame([(n, k) for n, k in places.kept.items()], "length long, kept long")
        first = starts.join(F.broadcast(bounds), "length").where(F.col("run_start") + F.col("n") > F.col("kept"))  # at most ``capacity`` rows
        first = materialize(first.groupBy("length").agg(F.min("run").alias("from_run")), "first-cuts")
        keyed = keyed.join(F.broadcast(first), "length", "left")  # at most ``capacity`` rows
        keyed = keyed.withColumn("ids", F.when(F.col("run") >= F.col("from_run"), F.col("ids"))).drop("from_run")
    ranked = keyed.join(starts.select("length", "run", "run_start"), ["length", "run"])
    ranked = ranked.withColumn("rank", F.col("run_start") + F.row_number().over(inside) - 1)
    cols = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    names = [*cols, *["ids"] * with_ids, "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = {n: np.array(x, np.int64) for n, x in places.whole.items()}
        gaps = np.array(places.gaps, np.int64).reshape(-1, 4)
        for b in (whole.slice(at, 1024) for whole in batches for at in range(0, whole.num_rows, 1024)):
            length, rank = (b.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            sequence, offset, whole = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64), np.zeros(len(length), bool)
            for n in np.unique(length).tolist():
                mine = np.flatnonzero((length == n) & (rank < places.kept[n]))
                whole[mine] = True
                if len(mine):
                    row = table[n][np.searchsorted(table[n][:, 0], rank[mine], side="right") - 1]
                    r = rank[mine] - row[:, 0]
                    sequence[mine] = row[:, 2] + r // row[:, 1]
                    offset[mine] = row[:, 3] + r % row[:, 1] * n
            keep = np.flatnonzero(whole)
            held = b.take(pa.array(keep))
            yield pa.RecordBatch.from_arrays([*(held.column(c) for c in names[:-2]), pa.array(sequence[keep]), pa.array(offset[keep])], names)
            out = [row for i in np.flatnonzero(~whole).tolist() for row in _cut_up({c: b.column(c)[i].as_py() for c in [*cols, "ids"]}, places.begins[length[i]] + (rank[i] - places.kept[length[i]]) * length[i], gaps)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary() if c == "ids" else pa.int64()) for c, x in zip([*cols, "ids", *names[-2:]], zip(*out, strict=True), strict=True) if c in names], names)

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * with_ids + ", sequence_id long, offset long"
    return ranked.select(*cols, "ids", "rank").mapInArrow(run, schema)


def _cut_up(piece: dict, at: int, gaps: np.ndarray) -> Iterator[tuple]:
    """Parts of a piece whose ids begin at ``at`` in the row that fills the gaps."""
    done = 0
    while done < piece["length"]:
        start, size, first, offset = gaps[np.searchsorted(gaps[:, 0], at + done, side="right") - 1].tolist()
        number, used = divmod(at + done - start, size)
        n = int(min(size - used, piece["length"] - done))
        raw = piece["ids"][4 * done : 4 * (done + n)]
        yield piece["doc_id"], piece["start"] + done, n, zlib.crc32(raw), piece["doc_tokens"], raw, int(first + number), int(offset + used)
        done += n
