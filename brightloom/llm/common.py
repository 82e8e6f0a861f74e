"""Helpers that the training-data operators share.

Everything that is kept between jobs goes to the folder in
``spark.checkpoint.dir`` (shared by driver and executors), never to a local
one, so a lost executor costs a recomputed stage at most.
"""

from __future__ import annotations

import sys
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brightloom.sources.scratch import keep as materialize
from brightloom.sources.scratch import shared_dir

__all__ = ["BLANK", "WORD", "connected_components", "held_bytes", "joined", "materialize", "new_path", "partitions", "small"]

#: ASCII white space that separates words, as a Java and RE2 character class.
BLANK = r"\x20\x09-\x0D"
WORD = r"[^\x20\x09-\x0D]+"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def held_bytes(key: str, value: bytes | tuple) -> int:
    """Bytes that an entry of a worker's cache takes, about: its key, its value with large numbers in it, its place."""
    return sys.getsizeof(key) + sys.getsizeof(value) + (28 * len(value) if isinstance(value, tuple) else 0) + 104


def partitions(df: DataFrame, at_least: int = 1) -> int:
    """The session's number of shuffle partitions, which its owner sizes to the data."""
    return max(at_least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))


def small(stored: DataFrame, most: int = 200_000) -> DataFrame:
    """A stored table of short rows, marked for broadcast if it has at most ``most`` of them; a larger one joins by shuffle."""
    return F.broadcast(stored) if stored.limit(most + 1).count() <= most else stored


def joined(rows: DataFrame, per: DataFrame, key: str) -> DataFrame:
    """``rows`` with the columns of ``per``, which has one row a key and in ``n`` the number of ``rows`` with it.

    Keys with more than a quarter of a task's share of the rows go out by broadcast, so
    that they stay spread: by their number there are at most 4 for each task. The rest meet by shuffle.
    """
    total = per.agg(F.sum("n")).first()[0] or 0
    limit = total // (4 * partitions(rows)) + 1
    hubs = per.where(F.col("n") > limit).drop("n")  # at most 4 rows for each shuffle partition
    marked = rows.join(F.broadcast(hubs), key, "left_semi").join(F.broadcast(hubs), key)
    others = rows.join(F.broadcast(hubs), key, "left_anti").join(per.where(F.col("n") <= limit).drop("n"), key)
    return marked.unionByName(others)


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Components of an undirected graph by alternating large-star and small-star rounds.

    ``edges`` has two columns ``a`` and ``b`` of one orderable type; nulls and
    loops are ignored. Returns ``node, root`` with root the smallest node of the
    component, for each node that has an edge to another. Each round is two
    shuffles over the edges, whose number never grows; a round's result is
    written to the shared folder. A star's leaves are gathered by a join and a
    minimum, so no group is collected; the leaves of a large star stay in the tasks they are in.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = materialize(e, "cc")
    if e.isEmpty():
        return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    for _ in range(max_rounds):
        # Large star: every larger neighbour of u is linked to the smallest of u and its neighbours.
        both = e.union(e.select(F.col("v"), F.col("u"))).toDF("u", "v")
        least = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n")), "cc-least")
        large = joined(both, least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialize(large.where("u <> v").distinct(), "cc-large")
        # Small star: u and its smaller neighbours are linked to the smallest of them.
        least = materialize(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "cc-least")
        small = joined(large, least, "u")
        nxt = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        nxt = materialize(nxt.where("u <> v").distinct(), "cc")
        # Done when every node has one parent and no parent has a parent: then all are stars.
        deep = nxt.join(nxt.select(F.col("u").alias("v")), "v", "left_semi")
        if deep.isEmpty() and nxt.groupBy("u").count().where("count > 1").isEmpty():
            return nxt.select(F.col("u").alias("node"), F.col("v").alias("root"))
        e = nxt
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
