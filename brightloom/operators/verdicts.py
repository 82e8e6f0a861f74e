"""Verdicts on rewrites from tables of compile results, outputs and repair traces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUILD_ERROR, RUN_ERROR, FAILED, OK = 0, 1, 2, 3
MARKER = "===TERMES==="


def compiled_only(rows: DataFrame, compiled: DataFrame) -> DataFrame:
    """Rows whose ``path`` compiled, by ``compiled(path, ok)``."""
    return rows.join(compiled.where("ok").select("path"), "path", "left_semi")


def run_status(build_rc: Column, run_rc: Column, timed_out: Column) -> Column:
    """Struct (status, msg) from return codes: built not 0, killed 1, failed or timed out 2, fine 3."""
    status = F.when(build_rc != 0, BUILD_ERROR).when(timed_out, FAILED).when(run_rc < 0, RUN_ERROR).when(run_rc > 0, FAILED).otherwise(OK)
    return F.struct(status.alias("status"), F.when((build_rc == 0) & timed_out, "timed out").alias("msg"))


def load_status(loaded: Column, stderr: Column) -> Column:
    """Struct (valid, log): the log before the marker; valid if loaded without warning or error."""
    log = F.split_part(F.coalesce(stderr, F.lit("")), F.lit(MARKER), F.lit(1))
    return F.struct((F.coalesce(loaded, F.lit(False)) & ~F.rlike(log, F.lit("Warning|Error"))).alias("valid"), log.alias("log"))


def reference_terms(outputs: DataFrame) -> DataFrame:
    """Outputs of the original that parse, the others dropped."""
    return outputs.where("value is not null")


def invalid_terms(outputs: DataFrame) -> DataFrame:
    """``name, n_invalid, n_total`` of the original's terms."""
    return outputs.groupBy("name").agg(F.count_if(F.col("value").isNull()).alias("n_invalid"), F.count("*").alias("n_total"))


def differential(outputs: DataFrame, original: str = "original") -> DataFrame:
    """``name, model, ok, status, msg``: the first problem in test order decides, the original's side first.

    ``outputs`` has ``model, name, test_idx, test_name, expr, value, run_error``. Each rewrite's row meets
    the original's by program and test; the first failing test is a minimum
    with partial aggregation, so a program of many tests is no group in one task.
    """
    cols = [F.col(c).alias(f"o_{c}") for c in ("value", "run_error")]
    first = outputs.where(F.col("model") == original).select("name", "test_idx", *cols)
    rows = outputs.where(F.col("model") != original).join(first, ["name", "test_idx"])
    status = (
        F.when(F.col("o_run_error").isNotNull(), RUN_ERROR).when(F.col("o_value").isNull(), BUILD_ERROR)
        .when(F.col("run_error").isNotNull(), RUN_ERROR).when(F.col("value").isNull(), BUILD_ERROR)
        .when(F.col("o_value") != F.col("value"), FAILED)
    )
    msg = (
        F.when(F.col("status") == RUN_ERROR, F.coalesce("o_run_error", "run_error"))
        .when(F.col("status") == BUILD_ERROR, "parsing error (most likely)")
        .otherwise(F.concat(F.lit('failed test case "'), "test_name", F.lit('" ("'), "expr", F.lit('") with outputs "'), "o_value", F.lit('" and "'), "value", F.lit('"')))
    )
    rows = rows.withColumn("status", status)
    rows = rows.withColumn("bad", F.when(F.col("status").isNotNull(), F.struct("test_idx", "status", msg.alias("msg"))))
    rows = rows.groupBy("name", "model").agg(F.min("bad").alias("bad"))
    found = F.coalesce(F.col("bad.status"), F.lit(OK))
    return rows.select("name", "model", (found == OK).alias("ok"), found.alias("status"), F.coalesce("bad.msg", F.lit("")).alias("msg"))


def feedback(outputs: DataFrame, original: str = "original", most: int = 3) -> DataFrame:
    """``name, model, feedback``: the first failures of each rewrite against terms that the original computes."""
    first = reference_terms(outputs.where(F.col("model") == original)).select("name", "test_idx", F.col("value").alias("expected"))
    rows = outputs.where(F.col("model") != original).join(first, ["name", "test_idx"]).where("not value <=> expected")
    nth = F.row_number().over(Window.partitionBy("name", "model").orderBy("test_idx"))
    rows = rows.withColumn("nth", nth).where(F.col("nth") <= most)
    unread = F.col("value").isNull()
    stuck = F.contains("value", F.split_part("expr", F.lit("("), F.lit(1)))
    line = F.when(unread, F.concat(F.lit("- term `"), "expr", F.lit("` does not parse; the original computes `"), "expected", F.lit("`"))).otherwise(
        F.concat(F.lit("- term `"), "expr", F.lit("` : expected `"), "expected", F.lit("`, got `"), "value", F.lit("`"), F.when(stuck, " (did not reduce)").otherwise(""))
    )
    rows = rows.groupBy("name", "model").agg(F.sort_array(F.collect_list(F.struct("nth", line.alias("line")))).alias("l"), F.bool_or(unread).alias("unread"))
    text = F.array_join(F.transform("l", lambda x: x["line"]), "\n")
    return rows.select("name", "model", F.concat(text, F.when(F.col("unread"), "\n- REMINDER: keep the original's syntax").otherwise("")).alias("feedback"))


def property_verdicts(instances: DataFrame, outputs: DataFrame, most: int = 5) -> DataFrame:
    """``name, model, ok, failures``: instances whose sides lack an output or differ, up to ``most``.

    ``instances`` has ``name, prop, k, lhs, rhs``; ``outputs`` has ``model, name, expr, value``.
    """
    models = outputs.select("name", "model").distinct()
    side = lambda c, v: outputs.select("name", "model", F.col("expr").alias(c), F.col("value").alias(v))
    rows = instances.join(models, "name").join(side("lhs", "l"), ["name", "model", "lhs"], "left").join(side("rhs", "r"), ["name", "model", "rhs"], "left")
    bad = rows.where("l is null or r is null or l <> r")
    nth = F.row_number().over(Window.partitionBy("name", "model").orderBy("prop", "k"))
    line = F.concat(F.lit("property `"), "prop", F.lit("` violated: `"), "lhs", F.lit("` -> `"), F.coalesce("l", F.lit("none")), F.lit("` but `"), "rhs", F.lit("` -> `"), F.coalesce("r", F.lit("none")), F.lit("`"))
    bad = bad.withColumn("nth", nth).where(F.col("nth") <= most).groupBy("name", "model").agg(F.sort_array(F.collect_list(F.struct("nth", line.alias("line")))).alias("f"))
    out = instances.select("name").distinct().join(models, "name").join(bad, ["name", "model"], "left")
    return out.select("name", "model", F.col("f").isNull().alias("ok"), F.coalesce(F.transform("f", lambda x: x["line"]), F.expr("cast(array() as array<string>)")).alias("failures"))


def rule_term(expr: Column) -> Column:
    """Struct (kind, sort, inner) of ``rlapp_Sort(t)`` and ``arlapp_Sort(t)``; null for other terms."""
    pattern = r"(?sU)^(a?)rlapp_(\w+)\((.*)\)$"
    bare = F.regexp_replace(expr, r"(?U)^\s+|\s+$", "")
    return F.when(F.rlike(bare, F.lit(pattern)), F.struct(*[F.regexp_extract(bare, pattern, i).alias(n) for i, n in ((1, "kind"), (2, "sort"), (3, "inner"))]))


def successor_set(successors: Column, most: int = 64) -> Column:
    """Distinct successors, sorted, at most 64, in braces; none: empty braces."""
    kept = F.slice(F.sort_array(F.array_distinct(successors)), 1, most)
    return F.when(F.size(kept) > 0, F.concat(F.lit("{ "), F.array_join(kept, ", "), F.lit(" }"))).otherwise("{}")


def accepted(traces: DataFrame, max_iters: int = 3) -> DataFrame:
    """``file, model, final, iteration, used``: the first iteration that passed, within the limit.

    ``traces`` has ``file, model, iterations array<struct<iter, ok, ...>>``.
    """
    tried = F.filter("iterations", lambda i: i["iter"] <= max_iters)
    first = F.array_min(F.transform(F.filter(tried, lambda i: i["ok"]), lambda i: i["iter"]))
    used = F.coalesce(first, F.array_max(F.transform(tried, lambda i: i["iter"])), F.lit(0))
    return traces.select("file", "model", F.when(first.isNotNull(), "ok").otherwise("failed").alias("final"), first.alias("iteration"), used.alias("used"))
