"""Near-duplicate vectors by an epsilon grid order join.

Unit vectors of cosine ``min_cosine`` or more lie within eps = sqrt(2 - 2 cos) of
each other. Turned to their principal directions, they are sorted by the cells
of a grid of side eps on the leading ones; the sequence of each label is cut
into blocks, and a tree over the sequence holds each interval's bounding box.
Pairs of intervals are split level by level, and a pair whose boxes are more than
eps apart is skipped with all below it. In the pairs of blocks that are left, each
pair of vectors is first held apart by more of the leading directions; the few that are
not eps apart there are compared whole, in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import connected_components, joined, materialize, partitions
from .vectors import by_length, forest, is_valid, matrix

MIN_COSINE = 0.98
LEADING = 6
#: Directions that hold vectors apart inside a pair of blocks.
FINE = 16
BLOCK = 1024
FAN = 4
#: Vectors that the principal directions are taken from, the first by hash; they bear on pruning only.
SAMPLE = 4000


def principal_directions(vectors: DataFrame, sample: int = SAMPLE) -> dict[int, np.ndarray]:
    """Orthonormal directions, leading first, for each vector length in the sample."""
    rows = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("vec").collect()
    by: dict[int, list] = {}
    for r in rows:
        by.setdefault(len(r[0]), []).append(r[0])
    out = {}
    for n, found in by.items():
        x = np.array(found, float)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        out[n] = np.linalg.eigh(np.cov(x.T).reshape(n, n) if len(x) > 1 else np.eye(n))[1][:, ::-1][:, :FINE].copy()
    return out


def sequence_blocks(vectors: DataFrame, turned: dict[int, np.ndarray], eps: float, block: int = BLOCK) -> DataFrame:
    """Blocks of the grid order: ``label, dim, block, lo, hi, ids, weights, data``.

    ``vectors`` has ``label, vec_id, weight, vec``. ``block`` numbers a label's
    blocks in sequence, ``lo`` and ``hi`` bound the leading coordinates.
    """
    kind = vectors.schema["vec"].dataType.simpleString()

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            y = np.zeros((b.num_rows, LEADING))
            for rows, x in by_length(b, "vec"):
                u = x / np.linalg.norm(x, axis=1, keepdims=True)
                d = turned.get(x.shape[1], np.eye(x.shape[1], LEADING))[:, :LEADING]
                y[rows, : d.shape[1]] = u @ d
            cells = pa.FixedSizeListArray.from_arrays(np.floor(y / eps).astype(np.int32).ravel(), LEADING).cast(pa.list_(pa.int32()))
            leads = pa.FixedSizeListArray.from_arrays(y.ravel(), LEADING).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*b.columns, cells, leads], [*b.schema.names, "cells", "leads"])

    rows = vectors.select("label", F.size("vec").alias("dim"), "vec_id", "weight", "vec")
    rows = rows.mapInArrow(project, f"label long, dim int, vec_id long, weight long, vec {kind}, cells array<int>, leads array<double>")
    cells = [F.col("cells")[i].alias(f"c{i}") for i in range(LEADING)]
    order = ["label", "dim", *[f"c{i}" for i in range(LEADING)], "vec_id"]
    rows = materialize(rows.select("label", "dim", "vec_id", "weight", "vec", "leads", *cells), "grid")
    rows = rows.repartitionByRange(partitions(rows), *order).sortWithinPartitions(*order).select("label", "dim", "vec_id", "weight", "vec", "leads")

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number = TaskContext.get().partitionId(), 0
        for b in batches:
            keys = np.stack([b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)], 1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), b.num_rows]
            for s, e in zip(cuts, cuts[1:], strict=False):
                for at in range(s, e, block):
                    c = b.slice(at, min(block, e - at))
                    y, x = matrix(c.column("leads")), c.column("vec").flatten().to_numpy(zero_copy_only=False)
                    yield pa.RecordBatch.from_pylist(
                        [{"label": keys[at, 0], "dim": keys[at, 1], "seq": part << 32 | number, "lo": y.min(0).tolist(), "hi": y.max(0).tolist(),
                          "ids": c.column("vec_id").to_pylist(), "weights": c.column("weight").to_pylist(), "data": x.tobytes()}],
                        schema=schema,
                    )
                    number += 1

    f64 = pa.list_(pa.float64())
    schema = pa.schema([("label", pa.int64()), ("dim", pa.int32()), ("seq", pa.int64()), ("lo", f64), ("hi", f64), ("ids", pa.list_(pa.int64())), ("weights", pa.list_(pa.int64())), ("data", pa.binary())])
    ddl = "label long, dim int, seq long, lo array<double>, hi array<double>, ids array<long>, weights array<long>, data binary"
    found = materialize(rows.mapInArrow(gather, ddl), "blocks")
    number = found.select("label", "dim", "seq").withColumn("block", F.row_number().over(Window.partitionBy("label", "dim").orderBy("seq")) - 1)
    return found.join(number, ["label", "dim", "seq"]).drop("seq")


def block_pairs(blocks: DataFrame, eps: float) -> DataFrame:
    """``label, dim, a, b`` (a <= b) of the pairs of blocks that may hold a link, by descent of the interval tree."""
    boxes = materialize(blocks.select("label", "dim", "block", "lo", "hi"), "boxes")
    most = boxes.agg(F.max("block")).first()[0] or 0
    depth = 0
    while FAN**depth <= most:
        depth += 1

    def level(k: int) -> DataFrame:
        lo, hi = ([f(F.col(side)[i]).alias(f"{side}{i}") for i in range(LEADING)] for side, f in (("lo", F.min), ("hi", F.max)))
        node = F.floor(F.col("block") / FAN**k).cast("long")
        return boxes.groupBy("label", "dim", node.alias("node")).agg(*lo, *hi).withColumn("parent", F.floor(F.col("node") / FAN).cast("long"))

    pairs = level(depth).select("label", "dim", F.col("node").alias("a"), F.col("node").alias("b"))
    for k in range(depth - 1, -1, -1):
        nodes = level(k)
        left = nodes.select("label", "dim", F.col("parent").alias("a"), F.col("node").alias("x"), *[F.col(f"{s}{i}").alias(f"x{s}{i}") for s in ("lo", "hi") for i in range(LEADING)])
        right = nodes.select("label", "dim", F.col("parent").alias("b"), F.col("node").alias("y"), *[F.col(f"{s}{i}").alias(f"y{s}{i}") for s in ("lo", "hi") for i in range(LEADING)])
        gap = F.lit(0.0)
        for i in range(LEADING):
            g = F.greatest(F.col(f"xlo{i}") - F.col(f"yhi{i}"), F.col(f"ylo{i}") - F.col(f"xhi{i}"), F.lit(0.0))
            gap = gap + g * g
        pairs = pairs.join(left, ["label", "dim", "a"]).join(right, ["label", "dim", "b"])
        pairs = pairs.where((F.col("x") <= F.col("y")) & (gap <= eps * eps * (1 + 1e-9)))
        pairs = materialize(pairs.select("label", "dim", F.col("x").alias("a"), F.col("y").alias("b")), "pairs")
    return pairs


def links(vectors: DataFrame, min_cosine: float = MIN_COSINE, block: int = BLOCK) -> DataFrame:
    """``a, b, n``: rows with b null say that vector a has n links (weights counted) in one pair of blocks; others are edges.

    The edges span what the links join. A row with a null has the number of vector pairs of a pair of blocks that
    were compared whole. ``vectors`` has ``label, vec_id, weight, vec``, each vector once per label.
    """
    eps = float(np.sqrt(max(0.0, 2 - 2 * min_cosine))) * (1 + 1e-7) + 1e-9
    turned = principal_directions(vectors)
    width = np.float32 if vectors.schema["vec"].dataType.simpleString() == "array<float>" else np.float64
    blocks = materialize(sequence_blocks(vectors, turned, eps, block), "numbered")
    pairs = block_pairs(blocks, eps)
    side = lambda s: blocks.select("label", "dim", F.col("block").alias(s), *[F.col(c).alias(f"{s}_{c}") for c in ("ids", "weights", "data")])
    rows = pairs.repartition(partitions(pairs), "label", "dim", "a", "b").join(side("a"), ["label", "dim", "a"]).join(side("b"), ["label", "dim", "b"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                v = {c: batch.column(c)[r] for c in batch.schema.names}
                same = v["a"].as_py() == v["b"].as_py()
                ids, sides = [], []
                for s in "ab":
                    own = v[f"{s}_ids"].values.to_numpy()
                    x = np.frombuffer(v[f"{s}_data"].as_py(), width).reshape(len(own), -1).astype(float)
                    ids.append(own)
                    sides.append((x / np.linalg.norm(x, axis=1, keepdims=True), v[f"{s}_weights"].values.to_numpy()))
                (x, wx), (y, wy) = sides
                ids = ids[0] if same else np.concatenate(ids)
                d = turned.get(x.shape[1], np.eye(x.shape[1], FINE))
                p, q = x @ d, y @ d
                apart = (p * p).sum(1)[:, None] + (q * q).sum(1)[None, :] - 2 * p @ q.T
                close = apart <= eps * eps + 1e-12
                if same:
                    close = np.triu(close, 1)
                i, j = np.nonzero(close)
                near = np.zeros(close.shape, bool)
                for at in range(0, len(i), 65536):
                    c = slice(at, at + 65536)
                    near[i[c], j[c]] = (x[i[c]] * y[j[c]]).sum(1) >= min_cosine
                if same:
                    near |= near.T
                counts = near @ wy
                if not same:
                    counts = np.concatenate([counts, near.T @ wx])
                n = len(ids)
                edges = np.array(forest(near, np.arange(len(x)), np.arange(n)[-len(y) :], np.arange(n)), np.int64).reshape(-1, 2)
                own = np.flatnonzero(counts)
                a, b, k = np.concatenate([[-1], ids[own], ids[edges[:, 0]]]), np.concatenate([np.zeros(len(own) + 1, np.int64), ids[edges[:, 1]]]), np.concatenate([[len(i)], counts[own], np.zeros(len(edges), np.int64)])
                at = np.arange(len(a))
                yield pa.RecordBatch.from_arrays([pa.array(a, mask=at == 0), pa.array(b, mask=at <= len(own)), pa.array(k)], ["a", "b", "n"])

    return rows.select("a", "b", *[f"{s}_{c}" for s in "ab" for c in ("ids", "weights", "data")]).mapInArrow(compare, "a long, b long, n long")


def near_duplicates(vectors: DataFrame, min_cosine: float = MIN_COSINE, block: int = BLOCK) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of each row of ``vectors(vec_id, embedding, label)``.

    Vectors that are null, empty, zero or hold null or non-finite components link
    with nothing, nor do rows with a null label or a null vec_id; lengths link
    among themselves. Equal vectors of a label count as links of each other and are compared
    once, with their number as weight, so a hot vector costs no more than another. Rows that share
    a vec_id are linked each by its own vector. Other
    columns are ignored; an empty table gives no rows.
    """
    kind = "array<float>" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "array<double>"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast(kind).alias("vec"))
    able = is_valid(F.col("vec")) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    rows = materialize(rows.withColumn("vec", F.when(able, F.col("vec"))), "vectors")
    once = rows.where("vec is not null").groupBy("label", "vec").agg(F.min("vec_id").alias("first"), F.count("*").alias("weight"))
    # A class is a vector of a label; its number is fixed once it is written.
    once = materialize(once.withColumn("class", F.monotonically_increasing_id()), "distinct-vectors")
    found = materialize(links(once.select("label", F.col("class").alias("vec_id"), "weight", "vec"), min_cosine, block), "vector-links")
    counts = found.where("a is not null and b is null").groupBy(F.col("a").alias("class")).agg(F.sum("n").alias("n"))
    roots = connected_components(found.where("b is not null").select("a", "b")).select(F.col("node").alias("class"), "root")
    names = once.join(counts, "class", "left").join(roots, "class", "left")
    names = names.select("label", "vec", "first", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("root", "class").alias("root"))
    names = materialize(names, "vector-classes")
    least = materialize(names.groupBy("root").agg(F.min("first").alias("component"), F.count("*").alias("n")), "vector-roots")
    names = joined(names, least, "root").select("label", "vec", "n_links", "component")
    out = rows.join(names, ["label", "vec"], "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
