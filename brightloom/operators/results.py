"""Rates, summaries, rankings and missing work over result tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

QUOTA = 20


def compile_rates(compiled: DataFrame) -> DataFrame:
    """``model, lang, n_ok, n_total`` with subtotals (null) by model and overall."""
    return compiled.rollup("model", "lang").agg(F.count_if("ok").alias("n_ok"), F.count("*").alias("n_total"))


def equivalence_rates(verdicts: DataFrame) -> DataFrame:
    """``model, build_error, run_error, failed, ok, n_total``."""
    each = [F.count_if(F.col("status") == s).alias(n) for s, n in enumerate(("build_error", "run_error", "failed", "ok"))]
    return verdicts.groupBy("model").agg(*each, F.count("*").alias("n_total"))


def resource_run(text: Column) -> Column:
    """Struct (cpu_s, mem_b) of ``key=value`` lines, the last character of the time being its unit."""
    kv = F.str_to_map(text, F.lit("\n"), F.lit("="))
    cpu, mem = (F.regexp_replace(F.try_element_at(kv, F.lit(k)), r"\s+", "") for k in ("cputime", "memory"))
    seconds = F.regexp_extract(cpu, r"^(.*).$", 1).try_cast("double")
    return F.struct(seconds.alias("cpu_s"), F.regexp_extract(mem, r"^(\d+)", 1).try_cast("long").alias("mem_b"))


def run_summary(runs: DataFrame) -> DataFrame:
    """``name, model, n, time, memory, least, most, median``: repeats summed up, in parts that merge however many there are.

    The median comes from a quantile sketch of bounded size: exact to within 1/10,000 of the ranks.
    """
    time = F.col("cpu_s")
    spread = [F.min(time).alias("least"), F.max(time).alias("most"), F.percentile_approx(time, 0.5, 10_000).alias("median")]
    return runs.groupBy("name", "model").agg(F.count("*").alias("n"), F.avg(time).alias("time"), F.avg("mem_b").alias("memory"), *spread)


def raw_times(runs: DataFrame, most: int) -> DataFrame:
    """``name, model, raw_time``: the seconds of the first ``most`` repeats, in their order (a report)."""
    nth = F.row_number().over(Window.partitionBy("name", "model").orderBy("rep", "cpu_s"))
    rows = runs.withColumn("nth", nth).where(F.col("nth") <= most).groupBy("name", "model")
    return rows.agg(F.transform(F.sort_array(F.collect_list(F.struct("nth", "cpu_s"))), lambda r: r["cpu_s"]).alias("raw_time"))


def benchmark(runs: DataFrame, passed: DataFrame | None = None, original: str = "original", raw: int = 0) -> DataFrame:
    """``name, model, time, memory, speedup, memorydown, n, least, most, median``: repeats summed up, means against the original's.

    ``runs`` has ``name, model, rep, cpu_s, mem_b``. With ``passed(name, model)`` only rewrites
    in it count; without, all do. Programs without an original or without a rewrite have no row.
    ``raw`` adds ``raw_time``, the seconds of that many repeats at most, in order.
    """
    if passed is not None:
        mine = runs.where(F.col("model") != original).join(passed.select("name", "model"), ["name", "model"], "left_semi")
        runs = runs.where(F.col("model") == original).unionByName(mine)
    mean = run_summary(runs)
    first = mean.where(F.col("model") == original).select("name", F.col("time").alias("t0"), F.col("memory").alias("m0"))
    rows = mean.where(F.col("model") != original).join(first, "name")
    rows = rows.select("name", "model", "time", "memory", F.try_divide("t0", "time").alias("speedup"), F.try_divide("m0", "memory").alias("memorydown"), "n", "least", "most", "median")
    return rows.join(raw_times(runs.where(F.col("model") != original), raw), ["name", "model"]) if raw else rows


def candidate_verdict(lint_fatal: Column, loaded: Column, differs: Column, violated: Column) -> Column:
    """Reason of the first stage that a candidate fails; null if it passes all."""
    return F.when(lint_fatal, "lint").when(~loaded, "load").when(differs, "tests").when(violated, "properties")


def best_of_n(candidates: DataFrame, originals: DataFrame) -> DataFrame:
    """``name, k, seconds, speedup``: the fastest accepted candidate, ties to the smallest k.

    ``candidates`` has ``name, k, ok, seconds``; ``originals`` has ``name, seconds``. Speedup is null for zero seconds.
    """
    order = Window.partitionBy("name").orderBy("seconds", "k")
    rows = candidates.where("ok").withColumn("seconds", F.coalesce("seconds", F.lit(0.0)))
    best = rows.withColumn("r", F.row_number().over(order)).where("r <= 1")
    best = best.join(originals.select("name", F.col("seconds").alias("s0")), "name", "left")
    return best.select("name", "k", "seconds", F.try_divide("s0", "seconds").alias("speedup"))


def matrix_summary(matrix: DataFrame) -> DataFrame:
    """``label, n_ok, n_files, mean_iterations`` by configuration; files in error have no iterations; none at all: NaN."""
    order = F.min("position").alias("position") if "position" in matrix.columns else F.lit(None).cast("long").alias("position")
    out = matrix.groupBy("label").agg(order, F.count_if("ok").alias("n_ok"), F.count("*").alias("n_files"), F.coalesce(F.avg("iterations"), F.lit(float("nan"))).alias("mean_iterations"))
    return out.select("label", "n_ok", "n_files", "mean_iterations", "position")


def missing_work(originals: DataFrame, done: DataFrame, most: int = QUOTA) -> DataFrame:
    """Names of originals, JSON set aside, that have no output yet: the first ``most`` by name (a report)."""
    return originals.where(~F.endswith("name", F.lit(".json"))).select("name").join(done.select("name"), "name", "left_anti").orderBy("name").limit(most)


def missing_inputs(originals: DataFrame, inputs: DataFrame, most: int = QUOTA) -> DataFrame:
    """As ``missing_work`` for test inputs, whose names end in .json instead."""
    rows = originals.where(~F.endswith("name", F.lit(".json"))).select("name", F.regexp_replace("name", r"\.[^.]+$", ".json").alias("input"))
    return rows.join(inputs.select(F.col("name").alias("input")), "input", "left_anti").select("name").orderBy("name").limit(most)


def matrix_grid(configs: DataFrame, files: DataFrame) -> DataFrame:
    """Each configuration with each file, defaults filled in. Configurations are a handful of rows written by hand."""
    defaults = {"max_iters": 3, "example": False, "seed": 0}
    for c, v in defaults.items():
        configs = configs.withColumn(c, F.coalesce(F.col(c), F.lit(v)) if c in configs.columns else F.lit(v))
    return files.select("file").crossJoin(configs)
