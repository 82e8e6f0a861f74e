"""The stored index: written whole, upserted by id, summed up; result tables as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def write_index(chunks: DataFrame, path: str) -> None:
    """Replace the index, clustered by ranges of ids so that neighbours lie in few files."""
    chunks.repartitionByRange("id").sortWithinPartitions("id").write.mode("overwrite").parquet(path)


def upserted(stored: DataFrame, changes: DataFrame) -> DataFrame:
    """Last write wins: ``changes(id, version, ...)`` over ``stored`` of the same columns."""
    order = Window.partitionBy("id").orderBy(F.desc("version"))
    return stored.unionByName(changes).withColumn("_n", F.row_number().over(order)).where("_n <= 1").drop("_n")


def summary(chunks: DataFrame) -> DataFrame:
    """``n, n_code, n_text``."""
    return chunks.agg(F.count("*").alias("n"), F.count_if(F.col("type") == "code").alias("n_code"), F.count_if(F.col("type") == "text").alias("n_text"))


def write_results(rows: DataFrame, path: str) -> None:
    """Flat rows, a JSON object each."""
    rows.write.mode("overwrite").json(path)


def nested_results(verdicts: DataFrame) -> DataFrame:
    """``name, results``: a JSON map from model to verdict for each program."""
    entry = F.struct(F.col("model").alias("key"), F.struct("ok", "status", "msg").alias("value"))
    return verdicts.groupBy("name").agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(entry)))).alias("results"))
