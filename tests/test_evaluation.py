"""Lint, test generation, verdicts and summaries."""

import math

import pytest
from pyspark.sql import functions as F

from brightloom.operators import lint, results, testgen, verdicts


def rows(df):
    return [tuple(r) for r in df.collect()]


def issues(spark, code):
    df = spark.createDataFrame([(1, code)], "program_id long, code string")
    return sorted((r["line"], r["rule"], r["msg"]) for r in lint.lint(df).collect())


def test_lint_rules(spark):
    assert [x[:2] for x in issues(spark, "eq f(X:Nat) when X:Nat .")] == [(1, 2)]
    assert [x[:2] for x in issues(spark, "x -- y\n--- y\na --b")] == [(1, 3)]
    assert [x[:2] for x in issues(spark, "if N = 0 then\nif N == 0 then\nif a =/= b then")] == [(1, 4)]
    assert [x[:2] for x in issues(spark, "l’a *** é")] == [(1, 1)]
    code = "sort T .\nvars F B G : T .\nop h : T -> T .\nops first k : T -> T .\neq first(h(F, B, G, B)) = F .\nceq k(Q) = F if true .\nrl Nat => Undef ."
    got = issues(spark, code)
    assert [(a, b) for a, b, _ in got] == [(5, 5), (6, 6), (7, 6)]
    assert "variable B stands 2 times" in got[0][2] and "name Q " in got[1][2] and "name Undef" in got[2][2]


def test_lines_end_at_line_feeds(spark):
    """A return or another separator inside a line starts no declaration and ends no condition."""
    for mark in ("\r", "\x85", "\u2028"):
        got = issues(spark, f"x{mark}vars Zed : S .\nx{mark}op Yan : S .\nx{mark}sort Tib .\neq a = Zed Yan Tib .\nif a{mark}= b then c")
        assert [(a, b, m.split()[1]) for a, b, m in got if b in (4, 6)] == [(4, 6, "Tib"), (4, 6, "Yan"), (4, 6, "Zed"), (5, 4, "inside")]
        assert [b for a, b, _ in issues(spark, f"var X : S .\neq f(X,{mark}X) = X .") if a == 2 and b == 5] == [5]


def test_words_hold_numbers_and_no_other_marks(spark):
    """½ and ² are characters of words, ‿ and Ⓐ are none."""
    when = [(1, "½when"), (2, "when²"), (3, "‿when"), (4, "whenⒶ"), (5, "éwhen"), (6, "when")]
    found = lint.line_issues(spark.createDataFrame(when, "program_id long, code string")).where("rule = 2")
    assert sorted(r["program_id"] for r in found.collect()) == [3, 4, 6]
    got = issues(spark, "eq a = Foo-½ Bar' Baz-- ½Qux A‿B .")
    assert [m.split()[1] for _, b, m in got if b == 6] == ["A", "B", "Bar", "Baz", "Foo-½"]


def test_formatted_order(spark):
    df = spark.createDataFrame([(1, "var X : S .\neq f(X, X) = Y .\nwhen")], "program_id long, code string")
    text = lint.formatted(lint.lint(df)).first()["issues"].split("\n")
    assert [t.split()[2] for t in text] == ["3", "2", "2"]
    assert lint.fatals(lint.lint(df)).count() == 1


def test_most_similar(spark):
    a = spark.createDataFrame([("p", "fmod A is eq x"), ("z", "1 2 3")], "name string, code string")
    b = spark.createDataFrame([("p", "fmod A is eq x"), ("q", "fmod A is"), ("r", "fmod A is"), ("s", "eq")], "name string, code string")
    assert rows(lint.most_similar(a, b)) == [("p", "q", 0.6)]


SPEC = "name string, fn string, signature array<struct<type:string,min:double,max:double>>, examples array<array<string>>, cnt int"


def test_spec_tests(spark):
    specs = spark.createDataFrame([("p", "f", [("nat", None, 3.0), ("bool", None, None)], [["1", "true"]], 40), ("p", "g", [("list", None, None)], [], 0), ("q", "h", None, [["2"]], None)], SPEC)
    df = testgen.spec_tests(specs).cache()
    got = rows(df.orderBy("test_name"))
    assert ("p", "f_example_0", "f(1, true)") in got and ("q", "h_example_0", "h(2)") in got
    drawn = [e for _, n, e in got if n.startswith("f_random_")]
    assert len(drawn) == 40 and {e.split("(")[1].split(",")[0] for e in drawn} == {"0", "1", "2", "3"}
    assert {e.split(", ")[1] for e in drawn} == {"True)", "False)"}
    again = testgen.spec_tests(specs.repartition(7))
    assert sorted(rows(again)) == sorted(got)


def test_properties(spark):
    props = spark.createDataFrame([("p", "comm", "f({X}, {Y})", "f({Y}, {X})", 3, {"X": "nat", "Y": "float"})], "name string, prop string, lhs string, rhs string, cnt int, vars map<string,string>")
    got = rows(testgen.property_instances(props).select("lhs", "rhs"))
    assert len(got) == 3
    for left, right in got:
        x, y = left[2:-1].split(", ")
        assert right == f"f({y}, {x})" and 0 <= int(x) <= 12 and -50 <= float(y) <= 50
    assert testgen.property_terms(testgen.property_instances(props)).count() == 6


OUT = "model string, name string, test_idx int, test_name string, expr string, value string, run_error string"


def outputs(spark):
    rows = [
        ("original", "pow", 0, "f_example_0", "f(0)", "1", None), ("original", "pow", 1, "f_example_1", "f(1)", "s_^8(0)", None), ("original", "pow", 2, "f_example_2", "f(2)", None, None),
        ("m", "pow", 0, "f_example_0", "f(0)", "1", None), ("m", "pow", 1, "f_example_1", "f(1)", "f(s_^2(0), s_^3(0))", None), ("m", "pow", 2, "f_example_2", "f(2)", "9", None),
        ("n", "pow", 0, "f_example_0", "f(0)", None, None), ("n", "pow", 1, "f_example_1", "f(1)", "s_^8(0)", None),
        ("o", "pow", 0, "f_example_0", "f(0)", "1", "died"),
        ("same", "pow", 0, "f_example_0", "f(0)", "1", None), ("same", "pow", 1, "f_example_1", "f(1)", "s_^8(0)", None),
    ]
    return spark.createDataFrame(rows, OUT)


def test_differential(spark):
    got = {r["model"]: (r["status"], r["ok"], r["msg"]) for r in verdicts.differential(outputs(spark)).collect()}
    assert got["m"] == (2, False, 'failed test case "f_example_1" ("f(1)") with outputs "s_^8(0)" and "f(s_^2(0), s_^3(0))"')
    assert got["n"][0] == 0 and got["o"] == (1, False, "died") and got["same"] == (3, True, "")
    assert rows(results.equivalence_rates(verdicts.differential(outputs(spark))).where("model = 'm'")) == [("m", 0, 0, 1, 0, 1)]


def test_identity_control(spark):
    o = outputs(spark).where("model = 'original' and value is not null")
    both = o.unionByName(o.withColumn("model", F.lit("copy")))
    assert rows(verdicts.differential(both)) == [("pow", "copy", True, 3, "")]


def test_feedback(spark):
    got = {r["model"]: r["feedback"] for r in verdicts.feedback(outputs(spark)).collect()}
    assert "did not reduce" in got["m"] and "REMINDER" in got["n"] and "same" not in got


def test_property_verdicts(spark):
    i = spark.createDataFrame([("p", "first_h", 0, "f(1)", "f(2)"), ("p", "ok", 0, "f(1)", "f(1)")], "name string, prop string, k int, lhs string, rhs string")
    o = spark.createDataFrame([("m", "p", "f(1)", "a"), ("m", "p", "f(2)", "b"), ("n", "p", "f(1)", "a"), ("n", "p", "f(2)", "a")], "model string, name string, expr string, value string")
    got = {r["model"]: (r["ok"], len(r["failures"])) for r in verdicts.property_verdicts(i, o).collect()}
    assert got == {"m": (False, 1), "n": (True, 0)}


def test_rule_terms(spark):
    df = spark.createDataFrame([("arlapp_Nat(7)",), (" rlapp_Nat(f(1))\n",), ("f(1)",)], "e string")
    got = [r[0] and tuple(r[0]) for r in df.select(verdicts.rule_term(F.col("e"))).collect()]
    assert got == [("a", "Nat", "7"), ("", "Nat", "f(1)"), None]
    df = spark.createDataFrame([(["b", "a", "b"],), ([],)], "s array<string>")
    assert [r[0] for r in df.select(verdicts.successor_set(F.col("s"))).collect()] == ["{ a, b }", "{}"]


def test_accepted(spark):
    t = spark.createDataFrame([("pow", "m", [(1, False), (2, False), (3, True)]), ("list", "m", [(1, False), (2, False), (3, False)]), ("late", "m", [(4, True)])], "file string, model string, iterations array<struct<iter:int,ok:boolean>>")
    assert rows(verdicts.accepted(t).select("file", "final", "iteration", "used")) == [("pow", "ok", 3, 3), ("list", "failed", None, 3), ("late", "failed", None, 0)]


def test_benchmark(spark):
    runs = [("p", "original", 1, 2.0, 10), ("p", "original", 2, 4.0, 10), ("p", "m", 1, 1.0, 5), ("p", "m", 2, 2.0, 5), ("q", "m", 1, 1.0, 1), ("r", "original", 1, 1.0, 1)]
    df = spark.createDataFrame(runs, "name string, model string, rep int, cpu_s double, mem_b long")
    assert rows(results.benchmark(df, raw=5)) == [("p", "m", 1.5, 5.0, 2.0, 2.0, 2, 1.0, 2.0, 1.0, [1.0, 2.0])]
    assert rows(results.benchmark(df, raw=1).select("raw_time")) == [([1.0],)] and "raw_time" not in results.benchmark(df).columns
    none = spark.createDataFrame([], "name string, model string")
    assert rows(results.benchmark(df, none)) == []


def test_best_of_n(spark):
    c = spark.createDataFrame([("p", 2, True, 0.5), ("p", 0, True, 0.5), ("p", 1, False, 0.1), ("z", 0, True, None)], "name string, k int, ok boolean, seconds double")
    o = spark.createDataFrame([("p", 1.0), ("z", 1.0)], "name string, seconds double")
    assert sorted(rows(results.best_of_n(c, o))) == [("p", 0, 0.5, 2.0), ("z", 0, 0.0, None)]


def test_matrix(spark):
    m = spark.createDataFrame([("a", True, 2), ("a", False, 3), ("a", False, None), ("b", False, None)], "label string, ok boolean, iterations int")
    got = {r["label"]: (r["n_ok"], r["n_files"], r["mean_iterations"]) for r in results.matrix_summary(m).collect()}
    assert got["a"] == (1, 3, 2.5) and math.isnan(got["b"][2])


def test_missing(spark):
    o = spark.createDataFrame([("b.cpp",), ("a.cpp",), ("x.json",)], "name string")
    assert rows(results.missing_work(o, o.where("name = 'a.cpp'"))) == [("b.cpp",)]
    assert rows(results.missing_inputs(o, spark.createDataFrame([("b.json",)], "name string"))) == [("a.cpp",)]


def test_resource_run(spark):
    df = spark.createDataFrame([("cputime=1.5s\nmemory=2048B\nx=1",), ("none",)], "t string")
    got = [tuple(r[0]) for r in df.select(results.resource_run(F.col("t"))).collect()]
    assert got == [(1.5, 2048), (None, None)]


def test_statuses(spark):
    df = spark.createDataFrame([(1, 0, False), (0, -9, False), (0, 1, False), (0, 0, False), (0, 0, True)], "b int, r int, t boolean")
    assert [r[0]["status"] for r in df.select(verdicts.run_status(F.col("b"), F.col("r"), F.col("t"))).collect()] == [0, 1, 2, 3, 2]
    df = spark.createDataFrame([(True, "fine===TERMES===Error"), (True, "Warning: x"), (False, "")], "l boolean, e string")
    assert [r[0]["valid"] for r in df.select(verdicts.load_status(F.col("l"), F.col("e"))).collect()] == [True, False, False]


def test_unknown_type_fails(spark):
    specs = spark.createDataFrame([("p", "f", [("list", None, None)], [], 1)], SPEC)
    with pytest.raises(Exception, match="unknown signature type"):
        testgen.spec_tests(specs).collect()
