"""The stored index that many queries share: chunks with all their columns, and their postings, in common segments.

Chunks carry whatever columns they have, vectors too. An upsert reads and writes the chunks that it
touches and adds a segment; what it replaces is hidden by a tombstone, and counts of terms and sizes
are kept as differences. Merging folds all segments into one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brightloom.operators import indexing
from brightloom.sources import segments
from brightloom.sources.scratch import keep


def _clustered(chunks: DataFrame) -> DataFrame:
    return chunks.repartitionByRange("id").sortWithinPartitions("id")


def create(chunks: DataFrame, path: str, clustered: bool = False) -> None:
    """Write ``chunks(id, text, ...)`` and their postings as a segment that replaces what is there; ids are unique and not null.

    ``clustered``: each task's rows stand in order of ids already, as ``dense_ids`` leaves them.
    """
    spark = chunks.sparkSession
    segment, old = segments.new_number(spark, path), segments.live(spark, path)
    stored = segments.write(chunks if clustered else _clustered(chunks), path, "chunks", segment)
    indexing.write_posting_segment(stored, path, segment, replaces=old)
    segments.commit(spark, path, segment, old)


def chunks(spark: SparkSession, path: str) -> DataFrame:
    """The chunks that count now."""
    return segments.unhidden(segments.read(spark, path, "chunks"), segments.read(spark, path, "gone")).drop("segment")


def postings(spark: SparkSession, path: str) -> indexing.Index:
    return indexing.read_postings(spark, path)


def upsert(changes: DataFrame, path: str, deleted: DataFrame | None = None) -> None:
    """Add or replace ``changes`` (columns as stored, ids unique) and drop the ids in ``deleted(id)``; no other chunk is written or its text read.

    An id in both is replaced. Deleting an id that isn't there, and an upsert of no rows, change nothing.
    """
    spark = changes.sparkSession
    segment = segments.new_number(spark, path)
    new = segments.write(_clustered(changes), path, "chunks", segment)
    touched = new.select("id")
    if deleted is not None:
        touched = touched.unionByName(deleted.select(F.col("id").cast("long").alias("id"))).distinct()
    touched = keep(touched, "touched")  # its size, known now, tells how to join: few ids leave the stored texts where they are
    was = keep(chunks(spark, path).join(touched, "id", "left_semi").select("id", "text"), "superseded")
    indexing.write_posting_segment(new, path, segment, superseded=was, gone=was)
    segments.commit(spark, path, segment)


def merge(spark: SparkSession, path: str) -> None:
    """Fold all segments into one; queries that read the old ones may go on."""
    segment, old = segments.new_number(spark, path), segments.live(spark, path)
    if len(old) > 1:
        segments.write(_clustered(chunks(spark, path)), path, "chunks", segment)
        indexing.merge_posting_segments(spark, path, segment)
        segments.commit(spark, path, segment, old)
