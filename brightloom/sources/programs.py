"""Program files, specifications and stored results as tables."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERDICT = "struct<ok: boolean, status: int, msg: string>"
TRACE = "file string, model string, rag string, n_tests int, iterations array<struct<iter: int, ok: boolean, autofixes: array<string>, feedback: string>>, final string"
SIGNATURE = "array<struct<type: string, min: double, max: double>>"


def read_programs(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """``model, name, ext, code``: the model is the first folder under ``root``, the name the path below it."""
    rows = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(root, wholetext=True)
    rows = rows.select(F.col("value").alias("code"), F.regexp_extract("_metadata.file_path", rf"\Q{root.removeprefix('file:').rstrip('/')}\E/(.*)$", 1).alias("path"))
    rows = rows.select(F.split_part("path", F.lit("/"), F.lit(1)).alias("model"), F.regexp_extract("path", r"^[^/]+/(.*)$", 1).alias("name"), "code")
    return rows.select("model", "name", F.regexp_extract("name", r"(\.[^./]+)$", 1).alias("ext"), "code")


def whole_files(spark: SparkSession, path: str) -> DataFrame:
    """``name, text`` of each file."""
    rows = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True)
    return rows.select(F.regexp_extract("_metadata.file_name", r"^(.*?)(?:\.[^.]*)?$", 1).alias("name"), F.col("value").alias("text"))


def compile_results(texts: DataFrame) -> DataFrame:
    """``path, ok`` of JSON maps in ``text``."""
    return texts.select(F.explode(F.from_json("text", "map<string, boolean>")).alias("path", "ok"))


def diff_results(texts: DataFrame) -> DataFrame:
    """``name, model, ok, status, msg`` of JSON maps of maps in ``text``."""
    rows = texts.select(F.explode(F.from_json("text", f"map<string, map<string, {VERDICT}>>")).alias("name", "m"))
    return rows.select("name", F.explode("m").alias("model", "v")).select("name", "model", "v.*")


def given_inputs(texts: DataFrame) -> DataFrame:
    """``name, comment, tests`` of JSON objects in ``text``."""
    return texts.select("name", F.from_json("text", "comment string, tests array<string>").alias("j")).select("name", "j.*")


def traces(texts: DataFrame) -> DataFrame:
    """Repair traces of JSON objects in ``text``."""
    return texts.select(F.from_json("text", TRACE).alias("j")).select("j.*")


def matrix_configs(texts: DataFrame) -> DataFrame:
    """``label, rag, model, max_iters, example, seed`` of a JSON list in ``text``."""
    row = "array<struct<label: string, rag: string, model: string, max_iters: int, example: boolean, seed: int>>"
    return texts.select(F.explode(F.from_json("text", row)).alias("c")).select("c.*")


def _toml_rows(texts: DataFrame, parse, ddl: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [json.dumps(r) for name, text in zip(*(c.to_pylist() for c in b.columns), strict=True) for r in parse(name, text or "")]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.string())], ["j"])

    return texts.select("name", "text").mapInArrow(run, "j string").select(F.from_json("j", ddl).alias("j")).select("j.*")


def _spec_rows(name: str, text: str) -> Iterator[dict]:
    import tomllib

    for fn, data in tomllib.loads(text).items():
        if fn == "extra" or not isinstance(data, dict):
            continue
        signature = [{"type": t} if isinstance(t, str) else t for t in data.get("signature", ())]
        examples = [[json.dumps(a) if isinstance(a, (bool, list)) else str(a) for a in args] for args in data.get("examples", ())]
        yield {"name": name, "fn": fn, "signature": signature, "examples": examples, "cnt": data.get("count")}


def _prop_rows(name: str, text: str) -> Iterator[dict]:
    import tomllib

    for p in tomllib.loads(text).get("prop", ()):
        yield {"name": name, "prop": p.get("name", "?"), "lhs": p["left"], "rhs": p["right"], "cnt": p.get("count"), "vars": p.get("vars", {})}


def test_specs(texts: DataFrame) -> DataFrame:
    """``name, fn, signature, examples, cnt`` of TOML specifications in ``text``."""
    return _toml_rows(texts, _spec_rows, f"name string, fn string, signature {SIGNATURE}, examples array<array<string>>, cnt int")


def property_specs(texts: DataFrame) -> DataFrame:
    """``name, prop, lhs, rhs, cnt, vars`` of TOML property files in ``text``."""
    return _toml_rows(texts, _prop_rows, "name string, prop string, lhs string, rhs string, cnt int, vars map<string, string>")
