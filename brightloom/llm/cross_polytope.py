"""Nearest neighbours by cross-polytope hashing.

A table turns unit vectors by rounds of random signs and a fast Hadamard
transform and files each under the nearest signed axis; two or more such
polytopes in a row make its bucket, so buckets grow in number with the vectors. A query probes the
buckets whose axes it is nearest to, the best over all tables, and the vectors filed there are its
candidates, which an exact inner product ranks. The part of the table that a query is
compared with falls as the table grows.

How many buckets a query probes is measured, for each length of vectors: some queries are answered exactly, and
probes are doubled until they find enough of those answers. Where probes would have to reach
too many of the buckets, as they do for wide vectors without structure, every query meets every vector.

Vectors are filed by direction alone, so one large norm moves no other vector.
The few vectors with the largest norms, which may win at wide angles, and all
vectors of a length with few of them are met by every query. So is the whole
table by a query that the tables leave with fewer than it asks for.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, partitions
from .vectors import by_length, is_valid, matrix

TABLES = 16
#: Part of the nearest that probes must find on the measured queries, of which there are so many for each length.
RECALL, MEASURED = 0.91, 192
#: Probes of a query to begin with, and the part of all tables' buckets beyond which every vector is met instead.
PROBES, MOST = 64, 1 / 16
#: Vectors for each bucket beyond which buckets are split by a further polytope, whose axes double from 2.
PER_BUCKET = 64
#: Probes that are looked for at once, over the queries of a batch.
CELLS = 1 << 20
NEAREST = 20
#: Vectors of a run of buckets that one task compares at once; one of more than twice as many is dealt out in parts.
PART = 4096
#: Vectors of each length, those of the largest norms, that every query meets; up to so many are not filed at all.
HEAVY = 1024
#: Steps of the largest norms: ratio of neighbours, and the last one, which holds the rest.
STEP, STEPS = 1.02, 1000
SEED = 7


@lru_cache(16)
def _signs(d: int) -> np.ndarray:
    """Walsh-Hadamard matrix of a small order."""
    return np.ones((1, 1)) if d == 1 else np.kron(_signs(d // 2), np.array([[1.0, 1.0], [1.0, -1.0]]))


def hadamard(x: np.ndarray) -> np.ndarray:
    """Orthonormal Walsh-Hadamard transform of each row, of a power of two: the transform of a grid's columns after that of its rows."""
    n, d = x.shape
    b = 1 << (d.bit_length() // 2)
    grid = x.reshape(n * (d // b), b) @ _signs(b)
    return np.matmul(_signs(d // b), grid.reshape(n, d // b, b)).reshape(n, d) / np.sqrt(d)


def rotated(x: np.ndarray, table: int, rounds: int = 3) -> np.ndarray:
    """Pseudo-random rotation of each row in a table."""
    signs = np.random.default_rng((SEED, table, x.shape[1])).choice([-1.0, 1.0], (rounds, x.shape[1]))
    for s in signs:
        x = hadamard(x * s)
    return x


def prepared(x: np.ndarray) -> np.ndarray:
    """Rows on the unit sphere, padded to a power of two."""
    x = x / np.abs(x).max(1, keepdims=True)
    out = np.zeros((len(x), 1 << max(1, int(x.shape[1] - 1).bit_length())))
    out[:, : x.shape[1]] = x / np.linalg.norm(x, axis=1)[:, None]
    return out


def shape(n: int, width: int) -> tuple[int, ...]:
    """Signed axes of each polytope in a row, for ``n`` vectors of a padded width: the last has as few as will do, so buckets grow by 2 at most.

    Small tables have about a bucket for each vector, up to two whole polytopes; larger ones one for ``PER_BUCKET`` vectors.
    """
    axes = 2 * width
    need = max(n / PER_BUCKET, min(n, axes * axes), 2)
    found, buckets = [], 1
    while buckets < need:
        found.append(min(axes, 1 << max(1, math.ceil(math.log2(need / buckets)))))
        buckets *= found[-1]
    return tuple(found)


def _axes(p: np.ndarray, table: int, level: int, axes: int) -> np.ndarray:
    y = rotated(p, table * 64 + level)[:, : axes // 2]
    return np.concatenate([y, -y], 1)


def bucket_of(p: np.ndarray, table: int, polytopes: tuple[int, ...]) -> np.ndarray:
    """Bucket of each prepared row in a table."""
    code = np.zeros(len(p), np.int64)
    for level, axes in enumerate(polytopes):
        code = code * axes + _axes(p, table, level, axes).argmax(1)
    return code


def probes_of(p: np.ndarray, tables: int, polytopes: tuple[int, ...], probes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, table, bucket) of the probes of each prepared row: the buckets of the largest sums of coordinates, best first in a row.

    Of sorted parts and sorted axes only places (i, j) with (i + 1)(j + 1) <= probes can make one of the best sums, so
    no axis is left out. Memory goes with rows times probes.
    """
    all_score = np.zeros((len(p), 0))
    all_code = np.zeros((len(p), 0), np.int64)
    buckets = math.prod(polytopes)
    for t in range(tables):
        best, code = np.zeros((len(p), 1)), np.zeros((len(p), 1), np.int64)
        for level, axes in enumerate(polytopes):
            y = _axes(p, t, level, axes)
            order = np.argsort(-y, axis=1, kind="stable")
            y = np.take_along_axis(y, order, 1)
            number = np.minimum(probes // np.arange(1, axes + 1), best.shape[1])
            number = number[number > 0]
            j = np.repeat(np.arange(len(number)), number)
            i = np.arange(len(j)) - np.repeat(np.cumsum(number) - number, number)
            best, code = best[:, i] + y[:, j], code[:, i] * axes + order[:, j]
            top = np.argsort(-best, axis=1, kind="stable")[:, :probes]
            best, code = np.take_along_axis(best, top, 1), np.take_along_axis(code, top, 1)
        all_score, all_code = np.concatenate([all_score, best], 1), np.concatenate([all_code, code + t * buckets], 1)
        top = np.argsort(-all_score, axis=1, kind="stable")[:, :probes]
        all_score, all_code = np.take_along_axis(all_score, top, 1), np.take_along_axis(all_code, top, 1)
    return np.repeat(np.arange(len(p)), all_code.shape[1]), (all_code // buckets).ravel(), (all_code % buckets).ravel()


def at_once(probes: int) -> int:
    """Queries whose probes are looked for together."""
    return max(1, min(128, CELLS // (8 * probes)))


def measured(queries: np.ndarray, near: list[np.ndarray], n: int, tables: int, wanted: float = RECALL, most: float = MOST) -> int | None:
    """Probes with which queries find the wanted part of the vectors near them, by doubling and halving; None beyond ``most`` of the buckets."""
    p, other = prepared(queries), prepared(np.concatenate(near))
    polytopes = shape(n, p.shape[1])
    owner = np.repeat(np.arange(len(near)), [len(x) for x in near])
    codes = np.stack([bucket_of(other, t, polytopes) + t * math.prod(polytopes) for t in range(tables)], 1)
    buckets = math.prod(polytopes)

    def enough(probes: int) -> bool:
        hit, step = 0, at_once(probes)
        for at in range(0, len(p), step):
            row, table, code = probes_of(p[at : at + step], tables, polytopes, probes)
            key = code + table * buckets
            for i in range(len(p[at : at + step])):
                hit += np.isin(codes[owner == at + i], key[row == i]).any(1).sum()
        return hit >= wanted * len(other)

    low, high = 0, PROBES
    while not enough(high):
        low, high = high, 2 * high
        if high > most * tables * buckets:
            return None
    for _ in range(4):  # to within a sixteenth
        middle = (low + high) // 2
        low, high = (low, middle) if enough(middle) else (middle, high)
    return high


def _filed(vectors: DataFrame, counts: dict[int, int], probing: dict[int, int], query: bool, tables: int, part: int, with_vectors: bool = True) -> DataFrame:
    """``key, vec_id, vec, codes``: a row for each table, or for each run of buckets that a query probes with the buckets it probes there.

    A key is a run of a table's buckets with about ``part`` vectors. Without vectors ``key`` alone.
    """
    together = min(map(at_once, probing.values())) if query else 1024

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, together):
                b = whole.slice(at, together)
                for rows, x in by_length(b, "vec"):
                    p, n = prepared(x), counts[x.shape[1]]
                    polytopes = shape(n, p.shape[1])
                    buckets, blocks = math.prod(polytopes), max(1, -(-n // part))
                    if query:
                        row, table, code = probes_of(p, tables, polytopes, probing[x.shape[1]])
                    else:
                        row, table = np.tile(np.arange(len(p)), tables), np.repeat(np.arange(tables), len(p))
                        code = np.concatenate([bucket_of(p, t, polytopes) for t in range(tables)])
                    key = (x.shape[1] * tables + table) * blocks + code * blocks // buckets
                    order = np.lexsort((code, key, row))
                    row, key, code = row[order], key[order], code[order]
                    new = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (key[1:] != key[:-1])])) if query else np.arange(len(row))
                    lists = pa.ListArray.from_arrays(pa.array(np.append(new, len(code)).astype(np.int32)), pa.array(code))
                    c = [*b.take(pa.array(rows[row[new]])).columns, lists] if with_vectors else []
                    yield pa.RecordBatch.from_arrays([pa.array(key[new]), *c], ["key", "vec_id", "vec", "codes"][: 1 + len(c)])

    kind = vectors.schema["vec"].dataType.simpleString()
    return vectors.select("vec_id", "vec").mapInArrow(run, f"key long, vec_id long, vec {kind}, codes array<long>" if with_vectors else "key long")


def _probed(both: DataFrame, k: int, hold: int = 200_000) -> DataFrame:
    """``query_id, vec_id, score``: for each asking row the ``k`` best vectors in the buckets it probes.

    ``both`` has ``key, part, vec_id, vec, codes, asks``. A key's vectors are held, sorted by bucket, and
    its asking rows stream past them. What a task finds is cut to the best of each query when ``hold`` rows are there.
    """

    def best_of(found: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        q, v, s = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((v, -s, q))
        q, v, s = q[order], v[order], s[order]
        once = np.concatenate([[True], (q[1:] != q[:-1]) | (v[1:] != v[:-1])])  # a vector found in two tables has one score
        q, v, s = q[once], v[once], s[once]
        keep = np.arange(len(q)) - np.searchsorted(q, q) < k
        return q[keep], v[keep], s[keep]

    def pairs(x: np.ndarray, ids: np.ndarray, codes: np.ndarray, c: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        y, own, lists = matrix(c.column("vec")), c.column("vec_id").to_numpy(), c.column("codes")
        asked = lists.flatten().to_numpy()
        row = np.repeat(np.arange(len(y)), lists.value_lengths().to_numpy())
        low = np.searchsorted(codes, asked, side="left")
        number = np.searchsorted(codes, asked, side="right") - low
        ends = np.cumsum(number)
        at = 0
        while at < len(asked):
            end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + 100_000, side="right")))
            many = number[at:end]
            i = np.repeat(row[at:end], many)
            j = np.repeat(low[at:end] - (np.cumsum(many) - many), many) + np.arange(many.sum())
            differ = own[i] != ids[j]
            i, j = i[differ], j[differ]
            if len(i):
                yield best_of([(own[i], ids[j], (y[i] * x[j]).sum(1))])
            at = end

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, index = None, [], None
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0
        for b in batches:
            keys = np.stack([b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("key", "part", "asks")], 1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
            for s, e in zip(cuts, cuts[1:], strict=False):
                if e == s:
                    continue
                if now != tuple(keys[s, :2]):
                    now, held, index = tuple(keys[s, :2]), [], None
                if not keys[s, 2]:
                    held.append(b.slice(s, e - s))
                    continue
                if not held:
                    continue
                if index is None:
                    t = pa.Table.from_batches(held).combine_chunks()
                    codes = t.column("codes").combine_chunks().flatten().to_numpy()
                    order = np.argsort(codes, kind="stable")
                    index = matrix(t.column("vec").combine_chunks())[order], t.column("vec_id").to_numpy()[order], codes[order]
                for at in range(s, e, 256):
                    for part in pairs(*index, b.slice(at, min(256, e - at))):
                        found.append(part)
                        size += len(part[0])
                    if size > hold:
                        found = [best_of(found)]
                        size = len(found[0][0])
                        if size > hold // 2:
                            yield pa.RecordBatch.from_arrays([pa.array(x) for x in found[0]], ["query_id", "vec_id", "score"])
                            found, size = [], 0
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in best_of(found)], ["query_id", "vec_id", "score"])

    both = both.repartition(partitions(both), "key", "part").sortWithinPartitions("key", "part", "asks")
    return both.mapInArrow(run, "query_id long, vec_id long, score double")


def _scored(both: DataFrame, k: int) -> DataFrame:
    """``query_id, vec_id, score``: of each key of ``both(key, vec_id, vec, asks)`` the ``k`` best vectors of each asking row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def ranked(key: int, held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held).combine_chunks()
            asks = t.column("asks").to_numpy()
            ids = t.column("vec_id").to_numpy()
            if asks.all() or not asks.any():
                return
            x = t.column("vec").combine_chunks().flatten().to_numpy().reshape(len(ids), -1).astype(np.float64)
            own, cand = np.flatnonzero(asks), np.flatnonzero(~asks)
            for at in range(0, len(own), 512):
                q = own[at : at + 512]
                s = x[q] @ x[cand].T
                s[ids[q][:, None] == ids[cand][None, :]] = -np.inf
                least = np.partition(s, max(0, len(cand) - k), axis=1)[:, max(0, len(cand) - k)]
                a, b = np.nonzero((s >= least[:, None] - 1e-9 * (1 + np.abs(np.where(np.isfinite(least), least, 0)))[:, None]) & (s > -np.inf))
                exact = (x[q[a]] * x[cand[b]]).sum(1)
                order = np.lexsort((ids[cand[b]], -exact, a))
                a, b, exact = a[order], b[order], exact[order]
                place = np.arange(len(a)) - np.searchsorted(a, a)
                a, b, exact = (z[place < k] for z in (a, b, exact))
                yield pa.RecordBatch.from_arrays([pa.array(ids[q[a]]), pa.array(ids[cand[b]]), pa.array(exact)], ["query_id", "vec_id", "score"])

        held: list[pa.RecordBatch] = []
        now = None
        for b in batches:
            keys = b.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
            for s, e in zip(cuts, cuts[1:], strict=False):
                if e == s:
                    continue
                if now is not None and keys[s] != now:
                    yield from ranked(now, held)
                    held = []
                now = keys[s]
                held.append(b.slice(s, e - s))
        if held:
            yield from ranked(now, held)

    both = both.repartition(partitions(both), "key").sortWithinPartitions("key")
    return both.mapInArrow(run, "query_id long, vec_id long, score double")


def _best(found: DataFrame, k: int) -> DataFrame:
    found = found.repartition(partitions(found), "query_id").dropDuplicates(["query_id", "vec_id"])
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _every(vectors: DataFrame, asked: DataFrame, part: int) -> DataFrame:
    """``key, vec_id, vec, asks``: each asking row meets all vectors of its length; both sides are dealt to parts by hash."""
    size = F.size("vec").alias("size")
    many = vectors.groupBy(size).count().select("size", F.ceil(F.col("count") / part).cast("int").alias("own"))
    asks = asked.groupBy(size).count().select("size", F.ceil(F.col("count") / part).cast("int").alias("other"))
    parts = F.broadcast(materialize(many.join(asks, "size"), "parts"))  # a row for each vector length

    def dealt(df: DataFrame, own: str, other: str, query: bool) -> DataFrame:
        df = df.select("vec_id", "vec", size).join(parts, "size").withColumn("a", F.pmod(F.xxhash64("vec_id"), F.col(own)).cast("int"))
        df = df.withColumn("b", F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
        v, q = ("b", "a") if query else ("a", "b")
        key = F.col("size").cast("long") * (1 << 42) + F.col(v).cast("long") * (1 << 21) + F.col(q)
        return df.select(key.alias("key"), "vec_id", "vec", F.lit(query).alias("asks"))

    return dealt(vectors, "own", "other", False).unionByName(dealt(asked, "other", "own", True))


def _floors(rows: DataFrame, heavy: int) -> tuple[dict[int, float | None], dict[int, int]]:
    """For each vector length the norm from which every query meets a vector, None if there is no such vector; and the number of vectors.

    A row for each length and step passes through the driver.
    """
    most = rows.groupBy("size").agg(F.max("norm").alias("most"))
    step = F.least(F.floor(F.log(F.col("most") / F.col("norm")) / F.log(F.lit(STEP))), F.lit(STEPS)).alias("step")
    steps = rows.join(F.broadcast(most), "size").groupBy("size", step).agg(F.count("*").alias("n"), F.min("norm").alias("least"))
    floors: dict[int, float | None] = {}
    held: dict[int, int] = {}
    for r in sorted(steps.collect()):
        held[r["size"]] = held.get(r["size"], 0) + r["n"]
        floors.setdefault(r["size"], None)
        if held[r["size"]] <= heavy:
            floors[r["size"]] = r["least"]
    # All vectors of a length with few of them.
    return {size: 0.0 if held[size] <= heavy else floor for size, floor in floors.items()}, held


def _probing(filed: DataFrame, asked: DataFrame, hashed: list[int], sizes: dict[int, int], k: int, tables: int, part: int) -> dict[int, int | None]:
    """For each hashed vector length the probes of a query, measured on ``MEASURED`` queries; None: every query meets every vector.

    At most ``MEASURED`` queries of each length and their ``k`` nearest pass through the driver.
    """
    turn = F.row_number().over(Window.partitionBy("size").orderBy(F.xxhash64("vec_id")))
    some = asked.where(F.col("size").isin(hashed)).withColumn("turn", turn).where(F.col("turn") <= MEASURED)
    some = materialize(some.select("vec_id", "vec").dropDuplicates(["vec_id"]), "measured")
    best = _best(_scored(_every(filed.select("vec_id", "vec"), some, part), k), k).select("query_id", "vec_id")
    pairs = best.join(some.select(F.col("vec_id").alias("query_id"), F.col("vec").alias("q")), "query_id")
    pairs = pairs.join(filed.select("vec_id", "vec"), "vec_id").select("query_id", "q", "vec").collect()
    found: dict[int, int | None] = dict.fromkeys(hashed)
    for size in hashed:
        by: dict[int, tuple[list, list]] = {}
        for r in pairs:
            if len(r["q"]) == size:
                by.setdefault(r["query_id"], (r["q"], []))[1].append(r["vec"])
        if by:
            found[size] = measured(np.array([q for q, _ in by.values()], float), [np.array(x, float) for _, x in by.values()], sizes[size], tables)
    return found


def nearest(
    vectors: DataFrame, is_query: Column, k: int = NEAREST, tables: int = TABLES, probes: int | None = None, part: int = PART, heavy: int = HEAVY
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest found of each query row of ``vectors(vec_id, embedding)``.

    ``is_query`` tells the queries by ``vec_id``. Candidates are all rows with another id and as many
    components. Vectors that are null, empty, zero or hold null or non-finite
    components, and rows with a null vec_id, take no part. Scores are inner products in double
    precision, ties go to the smaller id; an id that repeats comes out once. Other columns are ignored.
    A query has ``k`` rows unless there are fewer candidates. ``probes`` sets their number; by default it is measured.

    A run of buckets with more than twice ``part`` vectors is split by hash into parts, each met by all
    queries that probe the run. Runs are counted before vectors are filed, so
    the filed copies only pass through one shuffle where few are split.
    """
    kind = "array<float>" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "array<double>"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("vec"))
    top = F.array_max(F.transform("vec", lambda x: F.abs(x.cast("double"))))
    scaled = lambda t: t * F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + (x.cast("double") / t) * (x.cast("double") / t)))
    norm = F.get(F.transform(F.array(top), scaled), F.lit(0))  # the largest component is found once
    rows = rows.where(is_valid(F.col("vec")) & F.col("vec_id").isNotNull()).withColumn("size", F.size("vec"))
    rows = materialize(rows.withColumn("norm", norm), "vectors")
    floors, sizes = _floors(rows, heavy)
    spark = rows.sparkSession
    bounds = F.broadcast(spark.createDataFrame(list(floors.items()), "size int, floor double"))  # a row for each vector length
    rows = rows.join(bounds, "size")
    hashed = [size for size, floor in floors.items() if floor != 0.0]
    if hashed:
        filed = rows.where("floor is null or norm < floor")
        probing = _probing(filed, rows.where(is_query), hashed, sizes, k, tables, part) if probes is None else dict.fromkeys(hashed, probes)
        floors |= {size: 0.0 for size, number in probing.items() if number is None}
        probing = {size: number for size, number in probing.items() if number is not None}
        hashed = list(probing)
        bounds = F.broadcast(spark.createDataFrame(list(floors.items()), "size int, floor double"))
        rows = rows.drop("floor").join(bounds, "size")
    every, filed = rows.where("norm >= floor"), rows.where("floor is null or norm < floor")
    met = [_scored(_every(every, rows.where(is_query), part), k)] if any(floor is not None for floor in floors.values()) or not hashed else []
    if not hashed:
        return _best(met[0], k)

    counts = _filed(filed, sizes, probing, False, tables, part, with_vectors=False).groupBy("key").count().where(F.col("count") > 2 * part)
    parts = materialize(counts.select("key", F.ceil(F.col("count") / part).cast("int").alias("parts")), "buckets")
    many = F.coalesce("parts", F.lit(1))
    index = _filed(filed, sizes, probing, False, tables, part).join(parts, "key", "left").withColumn("part", F.pmod(F.xxhash64("vec_id"), many).cast("int"))
    asked = _filed(rows.where(is_query).where(F.col("size").isin(hashed)), sizes, probing, True, tables, part).join(parts, "key", "left")
    asked = asked.withColumn("part", F.explode(F.sequence(F.lit(0), many - 1)))
    both = index.withColumn("asks", F.lit(False)).unionByName(asked.withColumn("asks", F.lit(True)))
    found = _probed(both.select("key", "part", "vec_id", "vec", "codes", "asks"), k)
    for more in met:
        found = found.unionByName(more)
    best = materialize(_best(found, k), "nearest")

    # Whoever has fewer than k meets all vectors of the length; that of few vectors is done.
    full = best.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"))
    short = rows.where(is_query).join(bounds.where("floor is null or floor > 0").select("size"), "size", "left_semi").join(full, "vec_id", "left_anti")
    short = materialize(short.select("vec_id", "vec"), "short")
    if short.isEmpty():
        return best
    return _best(best.drop("rank").unionByName(_scored(_every(rows, short, part), k)), k)
