"""Incremental re-indexing: only pages whose html changed since the stored index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brightloom.operators.extract import MANUAL, extract_chunks


def page_hashes(pages: DataFrame) -> DataFrame:
    return pages.select("url", F.sha2(F.coalesce("html", F.lit("")), 256).alias("hash"))


def changed_pages(pages: DataFrame, stored: DataFrame) -> DataFrame:
    """Pages that ``stored(url, hash)`` does not hold as they are now."""
    rows = pages.withColumn("hash", F.sha2(F.coalesce("html", F.lit("")), 256))
    return rows.join(stored, ["url", "hash"], "left_anti").drop("hash")


def latest(hashes: DataFrame) -> DataFrame:
    """``url, hash, batch``: the last batch that indexed each page of ``hashes(url, hash, batch)``, and what it was then."""
    return hashes.groupBy("url").agg(F.max_by("hash", "batch").alias("hash"), F.max("batch").alias("batch"))


def current_chunks(spark: SparkSession, hashes: str, chunks: str) -> DataFrame:
    """The chunks that a stream wrote, of each page those of its last change."""
    last = latest(spark.read.parquet(f"{hashes}/*").select("url", "hash", F.col("batch").cast("int").alias("batch"))).select(F.col("url").alias("source"), "batch")
    return spark.read.parquet(chunks).withColumn("batch", F.col("batch").cast("int")).join(last, ["source", "batch"], "left_semi").drop("batch")


def reindex_stream(pages: DataFrame, hashes: str, chunks: str, checkpoint: str, flavour: str = MANUAL):
    """Start a stream that extracts each micro-batch's changed pages.

    Each batch writes its own folder, so a batch that runs again replaces its
    own output and nothing is written twice. A page counts as changed against its last state, so one that goes back to
    an earlier state is indexed again; ``current_chunks`` reads what counts.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch = batch.dropDuplicates(["url"])
        try:
            stored = latest(spark.read.parquet(f"{hashes}/*").where(F.col("batch") < number)).select("url", "hash")
        except Exception as e:  # the first batch has nothing stored
            if "PATH_NOT_FOUND" not in str(e):
                raise
            stored = spark.createDataFrame([], "url string, hash string")
        new = changed_pages(batch, stored)
        extract_chunks(new, flavour).write.mode("overwrite").parquet(f"{chunks}/batch={number}")
        page_hashes(new).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{hashes}/{number}")

    return pages.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
