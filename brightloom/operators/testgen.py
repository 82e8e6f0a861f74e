"""Test cases from specifications, properties and given inputs, as rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COUNT, PROPERTY_COUNT = 25, 10


def _draw(seed: int, *key: Column) -> Column:
    """A number in [0, 1) that depends on the key alone: the first 13 hexadecimal digits of the MD5 of seed and key, joined by ``|``."""
    digits = F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in key]).cast("binary")), 1, 13)
    return F.conv(digits, 16, 10).cast("double") / float(1 << 52)


def literal(value: Column, kind: Column, lang: Column) -> Column:
    """A value as the language writes it; only Python capitalises booleans."""
    return F.when((lang == "python") & (kind == "bool"), F.initcap(value)).otherwise(value)


def list_literal(values: Column, lang: Column) -> Column:
    """A list of rendered values as the language writes it."""
    joined = F.array_join(values, ", ")
    return (
        F.when(lang == "cpp", F.concat(F.lit("{"), joined, F.lit("}")))
        .when(lang == "rust", F.concat(F.lit("&vec!["), joined, F.lit("]")))
        .when(lang == "maude", F.array_join(values, " "))
        .otherwise(F.concat(F.lit("["), joined, F.lit("]")))
    )


def _random(seed: int, s: Column, *key: Column) -> Column:
    u = _draw(seed, *key)
    lo = F.coalesce(s["min"], F.when(s["type"] == "int", F.lit(-float(2**30))).when(s["type"] == "float", F.lit(-1e6)).otherwise(F.lit(0.0)))
    hi = F.coalesce(s["max"], F.when(s["type"] == "int", F.lit(float(2**30))).when(s["type"] == "float", F.lit(1e6)).otherwise(F.lit(float(2**31))))
    whole = (lo + F.floor(u * (hi - lo + 1))).cast("long").cast("string")
    return (
        F.when(s["type"].isin("nat", "int"), whole)
        .when(s["type"] == "bool", F.when(u < 0.5, "true").otherwise("false"))
        .when(s["type"] == "float", (lo + u * (hi - lo)).cast("string"))
        .otherwise(F.raise_error(F.concat(F.lit("unknown signature type: "), s["type"])).cast("string"))
    )


def spec_tests(specs: DataFrame, lang: str = "python", seed: int = 0) -> DataFrame:
    """``name, test_name, expr``: the examples, then ``cnt`` random cases of each function with a signature.

    ``specs`` has ``name, fn, signature array<struct<type,min,max>>, examples
    array<array<string>>, cnt``. A null count is 25, zero gives no random case. Bounds are inclusive.
    """
    call = lambda args: F.concat("fn", F.lit("("), F.array_join(args, ", "), F.lit(")"))
    given = specs.select("name", "fn", F.posexplode("examples").alias("k", "args"))
    given = given.select("name", F.concat("fn", F.lit("_example_"), "k").alias("test_name"), call(F.col("args")).alias("expr"))
    n = F.coalesce("cnt", F.lit(COUNT))
    drawn = specs.where((F.size("signature") > 0) & (n > 0)).select("name", "fn", "signature", F.explode(F.sequence(F.lit(0), n - 1)).alias("k"))
    args = F.transform("signature", lambda s, i: literal(_random(seed, s, F.col("name"), F.col("fn"), F.col("k"), i), s["type"], F.lit(lang)))
    drawn = drawn.select("name", F.concat("fn", F.lit("_random_"), "k").alias("test_name"), call(args).alias("expr"))
    return given.unionByName(drawn)


def property_instances(props: DataFrame, seed: int = 0) -> DataFrame:
    """``name, prop, k, lhs, rhs``: each property with its variables replaced, ``cnt`` times (null: 10)."""
    n = F.coalesce("cnt", F.lit(PROPERTY_COUNT))
    rows = props.where(n > 0).select("name", "prop", "lhs", "rhs", "vars", F.explode(F.sequence(F.lit(0), n - 1)).alias("k"))
    ranges = {"nat": (0, 12), "int": (-12, 12)}

    def value(var: Column, kind: Column) -> Column:
        u = _draw(seed, F.col("name"), F.col("prop"), F.col("k"), var)
        out = F.when(kind == "bool", F.when(u < 0.5, "true").otherwise("false")).when(kind == "float", F.format_string("%.1f", u * 100 - 50))
        for t, (lo, hi) in ranges.items():
            out = out.when(kind == t, (lo + F.floor(u * (hi - lo + 1))).cast("long").cast("string"))
        return out.otherwise(F.raise_error(F.concat(F.lit("unknown type: "), kind)).cast("string"))

    entries = F.transform(F.map_entries(F.coalesce("vars", F.expr("cast(map() as map<string, string>)"))), lambda e: F.struct(e["key"].alias("var"), value(e["key"], e["value"]).alias("value")))
    rows = rows.withColumn("subst", entries)
    fill = lambda c: F.aggregate("subst", F.col(c), lambda acc, s: F.replace(acc, F.concat(F.lit("{"), s["var"], F.lit("}")), s["value"]))
    return rows.select("name", "prop", "k", fill("lhs").alias("lhs"), fill("rhs").alias("rhs"))


def property_terms(instances: DataFrame) -> DataFrame:
    """``name, expr``: the distinct terms that the instances need."""
    return instances.select("name", F.explode(F.array("lhs", "rhs")).alias("expr")).distinct()


def given_tests(inputs: DataFrame) -> DataFrame:
    """``name, test_name, expr`` of ``inputs(name, model, tests)``, numbered from 0 within each model's list."""
    return inputs.select("name", F.posexplode("tests").alias("k", "expr")).select("name", F.concat(F.lit("aitest_"), "k").alias("test_name"), "expr")


def program_tests(programs: DataFrame, *tests: DataFrame) -> DataFrame:
    """All tests of the programs at hand; a program with none has no row."""
    return reduce(DataFrame.unionByName, tests).join(programs.select("name").distinct(), "name", "left_semi")


def versus_original(programs: DataFrame, original: str = "original") -> DataFrame:
    """``name, model, code, original_code``: each rewrite beside the original of its name."""
    first = programs.where(F.col("model") == original).select("name", F.col("code").alias("original_code"))
    return programs.where(F.col("model") != original).join(first, "name").select("name", "model", "code", "original_code")
