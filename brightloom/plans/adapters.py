"""The given tables as the operators' inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brightloom.operators.ids import dense_ids


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as chunks, numbered in id order; runs of five make a section, every fifth is code."""
    docs = dense_ids(table(spark, sf_dir, "documents"), "doc_id", stored=True)
    kind = F.when(F.col("doc_id") % 5 == 0, "code").otherwise("text")
    section = F.concat(F.lit("sec-"), F.floor(F.col("doc_id") / 5).cast("long"))
    return docs.select("id", "source", section.alias("section"), kind.alias("type"), "lang", "text")


CHUNKS_SQL = """chunks AS (
  SELECT row_number() OVER (ORDER BY doc_id) - 1 AS id, source, 'sec-' || (doc_id // 5) AS section,
         CASE WHEN doc_id % 5 = 0 THEN 'code' ELSE 'text' END AS type, lang, text FROM documents)"""


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages as queries."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"), "label")


def vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector whose id divides by 20 asks for its like."""
    return vectors(spark, sf_dir).where("id % 20 = 0").select(F.col("id").alias("query_id"), "vec")


def outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as outputs of programs: part is program, supplier (mod 4) model, line number test."""
    rows = table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("p"), "l_partkey").alias("name"), (F.col("l_suppkey") % 4).alias("m"), F.col("l_linenumber").alias("test_idx"), "l_quantity", "l_tax"
    )
    rows = rows.groupBy("name", "m", "test_idx").agg(F.min("l_quantity").alias("q"), F.max("l_tax").alias("x"))
    value = F.when(F.col("q") >= 45, None).otherwise((F.floor(F.col("q") / 25)).cast("int").cast("string"))
    model = F.when(F.col("m") == 0, "original").otherwise(F.concat(F.lit("m"), "m"))
    return rows.select(
        model.alias("model"), "name", "test_idx", F.concat(F.lit("f_example_"), "test_idx").alias("test_name"), F.concat(F.lit("f("), "test_idx", F.lit(")")).alias("expr"),
        value.alias("value"), F.when((F.col("x") >= 0.08) & (F.col("m") == 1), "timed out").alias("run_error"),
    )


OUTPUTS_SQL = """outputs AS (
  SELECT CASE WHEN m = 0 THEN 'original' ELSE 'm' || m END AS model, name, test_idx, 'f_example_' || test_idx AS test_name,
         'f(' || test_idx || ')' AS expr, CASE WHEN q >= 45 THEN NULL ELSE CAST(CAST(floor(q / 25) AS INT) AS VARCHAR) END AS value,
         CASE WHEN x >= 0.08 AND m = 1 THEN 'timed out' END AS run_error
  FROM (SELECT 'p' || l_partkey AS name, l_suppkey % 4 AS m, l_linenumber AS test_idx, min(l_quantity) AS q, max(l_tax) AS x
        FROM lineitem GROUP BY ALL))"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as benchmark runs: type is program, user (mod 4) model, value seconds."""
    model = F.when(F.col("user_id") % 4 == 0, "original").otherwise(F.concat(F.lit("m"), F.col("user_id") % 4))
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("name"), model.alias("model"), F.col("event_id").alias("rep"), F.col("value").alias("cpu_s"), (F.col("event_id") % 1000 + 1).alias("mem_b"))


RUNS_SQL = """runs AS (
  SELECT event_type AS name, CASE WHEN user_id % 4 = 0 THEN 'original' ELSE 'm' || (user_id % 4) END AS model,
         event_id AS rep, value AS cpu_s, event_id % 1000 + 1 AS mem_b FROM events)"""


def programs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as programs: source is model, language the program's language."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("program_id"), F.col("source").alias("model"), F.concat(F.lit("d"), "doc_id").alias("name"), "lang", F.col("text").alias("code"))
