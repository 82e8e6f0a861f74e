"""Tables in segments: a write adds a segment, tombstones hide rows of earlier ones, a merge replaces them all.

A table set lies under one folder, each table as ``<name>/segment=<number>``. A segment counts once its
commit row is there, so a write that broke off leaves nothing visible, and the next one writes over
what it left. One writer at a time.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

COMMIT = "segment int, replaces array<int>"


def _commits(spark: SparkSession, path: str) -> list:
    try:
        return spark.read.schema(COMMIT).parquet(f"{path}/commits").collect()  # a row for each write since the last merge but one
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return []


def live(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the segments that count, oldest first."""
    rows = _commits(spark, path)
    gone = {s for r in rows for s in r["replaces"]}
    return sorted(r["segment"] for r in rows if r["segment"] not in gone)


def new_number(spark: SparkSession, path: str) -> int:
    return max((r["segment"] for r in _commits(spark, path)), default=-1) + 1


def write(df: DataFrame, path: str, name: str, segment: int) -> DataFrame:
    """Write a table of a segment that is not committed yet, and read it back."""
    df.write.mode("overwrite").parquet(f"{path}/{name}/segment={segment}")
    return df.sparkSession.read.schema(df.schema).parquet(f"{path}/{name}/segment={segment}")


def commit(spark: SparkSession, path: str, segment: int, replaces: list[int] = ()) -> None:
    spark.createDataFrame([(segment, list(replaces))], COMMIT).coalesce(1).write.mode("append").parquet(f"{path}/commits")


def read(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A table of all live segments, with its ``segment``."""
    numbers = live(spark, path)
    if not numbers:
        raise ValueError(f"nothing is committed in {path}")
    parts = [f"{path}/{name}/segment={s}" for s in numbers]
    found = spark.read.option("basePath", f"{path}/{name}").parquet(*parts)
    schema = StructType([f for f in found.schema if f.name != "segment"]).add("segment", IntegerType())
    return spark.read.schema(schema).option("basePath", f"{path}/{name}").parquet(*parts)


def unhidden(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """``rows(id, segment, ...)`` without those that ``gone(id, segment)`` of a later segment hides."""
    last = gone.groupBy(F.col("id").alias("_id")).agg(F.max("segment").alias("_since"))
    return rows.join(last, (F.col("id") == F.col("_id")) & (F.col("segment") < F.col("_since")), "left_anti")
