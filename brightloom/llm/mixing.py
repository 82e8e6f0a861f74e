"""Mixing sources to target weights by a time-varying curriculum (DataFrame functions only).

Each source has a weight schedule over training progress ``s`` in [0, 1] that
moves linearly from ``ramp`` times its mean to ``2 - ramp`` times it (sources of
odd rank start high, those of even rank start low). Its integral is the
cumulative token demand of the source, scaled so that the whole demand is the
source's target. The documents of a source stand in one fixed pseudo-random
order, pass after pass, and each copy gets the progress at which the cumulative
demand reaches it: the inverse of the integral, a square root. Sorting all
copies by that position gives the training order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brightloom.operators.ids import dense_ids

from .common import BLANK, WORD, materialize

#: Times its own size that a source may be repeated.
MAX_REPEAT = 3
#: Start of a schedule over its mean, for sources of odd rank; those of even rank have 2 - RAMP.
RAMP = 1.5
#: Leading hex digits of a document's order key that make its bucket: 16 ** 3 runs of each source.
BUCKET_DIGITS = 3


def word_count(text: Column) -> Column:
    """Number of words in the text; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, max_repeat: int = MAX_REPEAT, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """One row per source: ``source, source_size, w, rank, target``.

    ``sizes`` has ``source, size``. Sources rank by code point, null last, and
    take the weights in turn. Targets share the total size by weight; one above
    ``max_repeat`` times its source's size stops there and the rest is shared
    again. With sources sorted by cap over weight the capped ones are a prefix,
    so two running sums find the level at which it stops. The table has a row
    for each source, not each document.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("rank", F.row_number().over(by_name)).withColumn(
        "w", F.element_at(F.array(*[F.lit(x) for x in weights]), ((F.col("rank") - 1) % len(weights) + 1).cast("int")).cast("long")
    )
    per = per.withColumn("cap", max_repeat * F.col("source_size"))
    by_level = Window.orderBy(F.col("cap") / F.col("w"), "rank")
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    per = (
        per.withColumn("total", F.sum("source_size").over(whole))
        .withColumn("cap_before", F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("w_left", F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0)))
    )
    # A source is capped if the level that holds when all before it are capped passes its own.
    per = per.withColumn("level", (F.col("total") - F.col("cap_before")) / F.col("w_left"))
    per = per.withColumn("free", F.col("cap") / F.col("w") > F.col("level"))
    per = per.withColumn("level", F.min(F.when(F.col("free"), F.struct("cap_before", "level"))).over(whole)["level"])
    target = F.when(F.col("free"), F.least(F.col("cap").cast("double"), F.col("w") * F.col("level"))).otherwise(F.col("cap").cast("double"))
    return per.select("source", "source_size", "w", "rank", F.coalesce(target, F.lit(0.0)).alias("target"))


def position(reached: Column, target: Column, rank: Column, ramp: float = RAMP) -> Column:
    """Progress at which a source's cumulative demand is ``reached``.

    Demand is target * (a s + (1 - a) s^2) with a = ramp or 2 - ramp by rank.
    """
    a = F.when(rank % 2 == 1, F.lit(ramp)).otherwise(F.lit(2 - ramp))
    return (F.sqrt(a * a + 4.0 * (1.0 - a) * (reached / F.nullif(target, F.lit(0.0)))) - a) / (2.0 * (1.0 - a))


def curriculum(docs: DataFrame, max_repeat: int = MAX_REPEAT, ramp: float = RAMP) -> DataFrame:
    """Give each document its copies in the mix.

    ``docs`` has ``doc_id, text, source``; other columns are ignored. Returns a row per document: ``doc_id, source, size, source_size, target, taken, copies`` with
    copies an array of ``(pass, tokens, position)``. Null texts have size 0 and
    no copy; the null source is a source of its own; rows that are alike in id
    and size take turns; an empty table gives no rows. A copy is cut where the
    source's target is reached, rounded to words.

    The running sum within a source goes through buckets by hash: totals of
    (source, bucket), their running sum, then one inside each bucket. So a
    source that holds a third of all rows is still dealt to thousands of groups.
    """
    return _planned(docs, max_repeat, ramp).drop("row")


def _planned(docs: DataFrame, max_repeat: int, ramp: float) -> DataFrame:
    """``curriculum`` with ``row``, a number for each document."""
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    rows = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), key.alias("k"))
    rows = materialize(rows.withColumn("bucket", F.substring("k", 1, BUCKET_DIGITS)).withColumn("row", F.monotonically_increasing_id()), "mix")
    rows = _with_copies(rows, rows.groupBy("source", "bucket").agg(F.sum("size").alias("size")), ["k", "doc_id", "size"], max_repeat, ramp)
    taken = F.aggregate("copies", F.lit(0).cast("long"), lambda n, c: n + c["tokens"])
    return rows.select("row", "doc_id", "source", "size", "source_size", "target", taken.alias("taken"), "copies")


def _with_copies(rows: DataFrame, runs: DataFrame, order: list[str], max_repeat: int, ramp: float) -> DataFrame:
    """``rows`` with ``copies, source_size, target``; they have ``source, bucket, size``, and ``runs`` the totals of their sizes.

    Rows are shuffled once: the totals of (source, bucket) come to where the running sum is made.
    """
    targets = source_targets(runs, max_repeat)
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("run_start", F.coalesce(F.sum("size").over(before), F.lit(0)))
    targets = targets.withColumnRenamed("source", "s")
    plan = runs.join(targets, runs["source"].eqNullSafe(targets["s"]))
    # A key that is never null, so that window and join ask for the same partitions.
    name = F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n"))
    plan = plan.select(name.alias("name"), "bucket", "run_start", "source_size", "target", "rank")
    inside = Window.partitionBy("name", "bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("name", name).withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    rows = rows.join(plan, ["name", "bucket"])
    start = F.col("run_start") + F.col("inside")
    goal = F.floor(F.col("target") + 0.5)
    copies = F.transform(
        F.sequence(F.lit(0), F.lit(max_repeat - 1)),
        lambda p: F.struct(
            p.alias("pass"),
            F.greatest(F.least(goal - (p * F.col("source_size") + start), F.col("size")), F.lit(0)).cast("long").alias("tokens"),
            position((p * F.col("source_size") + start).cast("double"), F.col("target"), F.col("rank"), ramp).alias("position"),
        ),
    )
    return rows.withColumn("copies", F.filter(copies, lambda c: c["tokens"] > 0))


def _ordered(plan: DataFrame) -> DataFrame:
    rows = plan.select("row", "doc_id", "source", "size", F.explode("copies").alias("c"))
    return dense_ids(rows.select("row", "doc_id", "source", "size", "c.*"), "position", "doc_id", "pass", name="place")


def training_order(docs: DataFrame, max_repeat: int = MAX_REPEAT, ramp: float = RAMP) -> DataFrame:
    """Every copy of the mix as a row, range-sorted by position: ``doc_id, source, size, pass, tokens, position, place``.

    ``place`` numbers the copies from 0 in that order; ties go by
    id (none first), then pass. A document of size 0 has no copy; an empty table gives no rows.
    """
    return _ordered(_planned(docs, max_repeat, ramp)).drop("row")


def placed(docs: DataFrame, max_repeat: int = MAX_REPEAT, ramp: float = RAMP) -> DataFrame:
    """``doc_id, size, source_size, target, taken, position, place``: what the sorted copies take of each document, and where its first stands.

    A document without a copy has taken 0, no position and place -1.
    """
    plan = materialize(_planned(docs, max_repeat, ramp), "curriculum")
    per = _ordered(plan).groupBy("row").agg(F.sum("tokens").alias("took"), F.min("position").alias("position"), F.min("place").alias("place"))
    rows = plan.join(per, "row", "left")
    return rows.select("doc_id", "size", "source_size", "target", F.coalesce("took", F.lit(0)).cast("long").alias("taken"), "position", F.coalesce("place", F.lit(-1)).cast("long").alias("place"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """``docs`` as the mix takes them: a row per copy in training order, with the columns of ``docs``.

    A copy that its source's target cuts keeps its first words, joined by one
    blank. Texts move twice: to the running sum of their source's bucket, which gives them
    their copies, and to their place in the order. Rows without an id go by the hash of their
    text, and rows that share an id stand in the order of theirs, so a rerun cuts the same
    rows. Null and empty texts have no copy; all columns stay, whatever their
    names; an empty table gives no rows.
    """
    own = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)]
    at = {c: f"row.c{i}" for i, c in enumerate(docs.columns)}
    digest = F.xxhash64("text")
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text "), digest.cast("string"))).cast("binary"))
    rows = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), key.alias("k"), digest.alias("digest"), F.struct(*own).alias("row"))
    rows = rows.withColumn("bucket", F.substring("k", 1, BUCKET_DIGITS))
    runs = materialize(rows.groupBy("source", "bucket").agg(F.sum("size").alias("size")), "mix")
    rows = _with_copies(rows.where("size > 0"), runs, ["k", "doc_id", "digest"], MAX_REPEAT, RAMP)
    rows = rows.select("row", "size", "digest", F.explode("copies").alias("c"))
    order = ["c.position", at["doc_id"], "c.pass", "digest"]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    words = F.split(F.regexp_replace(at["text"], rf"^[{BLANK}]+", ""), rf"[{BLANK}]+")
    cut = F.array_join(F.slice(words, 1, F.col("c.tokens").cast("int")), " ")
    text = F.when(F.col("c.tokens") < F.col("size"), cut).otherwise(F.col(at["text"]))
    return rows.select(*[(text if c == "text" else F.col(at[c])).alias(c) for c in docs.columns])
