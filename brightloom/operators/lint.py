"""Lint of generated programs and the most similar exemplar, over a table of programs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brightloom.functions.text import matches
from brightloom.sources.scratch import keep

FATAL, WARNING = "fatal", "warning"
# Keywords and built-in sorts that need no declaration.
KEYWORDS = (
    "eq ceq rl crl mb cmb if then else fi and or not true false owise otherwise is sort sorts op ops var vars subsort "
    "subsorts protecting including extending rem quo gcd lcm min max sd abs ctor assoc comm id prec gather endfm endm"
).split()
BUILT_IN = "Bool Nat Int Float String Qid".split()
#: A character of a word, and where a word of ASCII letters begins and ends. ``\w`` leaves out numbers such as ½ and takes in some marks;
#: ``\b`` by itself does too, and only spares looking back inside words.
_W = r"[\p{L}\p{M}\p{N}_]"
_BEGINS, _ENDS = rf"\b(?<!{_W})", rf"(?!{_W})"
WORD = r"[A-Za-z][\p{L}\p{M}\p{N}_'-]*"
# The patterns of rules 1 to 6 and of declarations. Only \n ends a line (flag d): lines are cut there, and \r or \x85 stands inside one.
OTHER_CHARACTER = r"([^\x00-\x7F])"
CONDITION = rf"(?d){_BEGINS}if{_ENDS}(.*?){_BEGINS}then{_ENDS}"
WHEN = rf"{_BEGINS}when{_ENDS}"
DASHES = r"(?U)(^|\s)--(?!-)(\s|$)"
SINGLE_EQUALS = r"(?<![=<>~/\\])=(?![=/])"
LEFT_SIDE = r"(?dU)^\s*(?:eq|ceq)\s+(.*?)\s=(?!=)\s"
CAPITALISED = rf"{_BEGINS}[A-Z](?:[\p{{L}}\p{{M}}\p{{N}}_'-]*{_W})?"
RULE_LINE = rf"(?U)^\s*(?:c?eq|c?rl){_ENDS}"
VARIABLES, INLINE_VARIABLES = r"(?dmU)^\s*vars?\s+(.+?)\s*:\s*\S+\s*\.", rf"{_BEGINS}({WORD}+):(?=[A-Za-z])"
OPERATORS, SORTS = r"(?dmU)^\s*ops?\s+(.+?)\s*:", r"(?dmU)^\s*sorts?\s+(.+?)\s*\."
SYMBOLS = r":=|=>|~>|/\\"
#: Rare tokens of a program, and exemplars of each, that give the first score to beat.
FIRST_TOKENS, FIRST_EXEMPLARS = 4, 8


def without_comment(line: Column) -> Column:
    """A line cut at ``***``, then at ``---``."""
    return F.regexp_replace(F.regexp_replace(line, r"(?s)\*\*\*.*", ""), "(?s)---.*", "")


def _lines(programs: DataFrame) -> DataFrame:
    """``program_id, line, raw, cut`` of ``programs(program_id, code)``."""
    rows = programs.select("program_id", F.posexplode(F.split("code", "\n", -1)).alias("pos", "raw"))
    return rows.select("program_id", (F.col("pos") + 1).alias("line"), "raw", without_comment(F.col("raw")).alias("cut"))


def line_issues(programs: DataFrame) -> DataFrame:
    """Rules 1 to 4, all fatal: ``program_id, line, rule, severity, msg``. They stay inside each row."""
    cut, raw = F.col("cut"), F.col("raw")
    odd = F.regexp_extract(cut, OTHER_CHARACTER, 1)
    inner = F.regexp_extract(cut, CONDITION, 1)
    found = [
        F.when(odd != "", F.struct(F.lit(1).alias("rule"), F.concat(F.lit("non-ASCII character "), odd).alias("msg"))),
        F.when(F.rlike(cut, F.lit(WHEN)), F.struct(F.lit(2).alias("rule"), F.lit("keyword `when` does not exist").alias("msg"))),
        F.when(F.rlike(raw, F.lit(DASHES)), F.struct(F.lit(3).alias("rule"), F.lit("comment `--` is not accepted").alias("msg"))),
        F.when(F.rlike(inner, F.lit(SINGLE_EQUALS)), F.struct(F.lit(4).alias("rule"), F.lit("`=` inside if-then is no Bool operator").alias("msg"))),
    ]
    rows = _lines(programs).select("program_id", "line", F.explode(F.array_compact(F.array(*found))).alias("i"))
    return rows.select("program_id", "line", "i.rule", F.lit(FATAL).alias("severity"), "i.msg")


def _words(c: Column) -> Column:
    return F.filter(F.split(c, r"(?U)\s+"), lambda w: w != "")


def declared(programs: DataFrame) -> DataFrame:
    """``program_id, variables, ops, sorts``: declared names as arrays."""
    code = F.col("code")
    flat = lambda a, f: F.array_distinct(F.flatten(F.transform(a, f)))
    named = flat(matches(code, VARIABLES, 1), _words)
    inline = matches(code, INLINE_VARIABLES, 1)
    ops = flat(matches(code, OPERATORS, 1), lambda o: matches(o, WORD))
    sorts = flat(matches(code, SORTS, 1), _words)
    return programs.select("program_id", "code", F.array_distinct(F.concat(named, inline)).alias("variables"), ops.alias("ops"), sorts.alias("sorts"))


def name_issues(programs: DataFrame) -> DataFrame:
    """Rule 5, a declared variable more than once on a left side, and rule 6, an undeclared capitalised name; warnings."""
    rows = declared(programs).select("*", F.posexplode(F.split("code", "\n", -1)).alias("pos", "raw"))
    cut = without_comment(F.col("raw"))
    rows = rows.select("program_id", (F.col("pos") + 1).alias("line"), "variables", "ops", "sorts", cut.alias("cut"))
    left = matches(F.regexp_extract("cut", LEFT_SIDE, 1), WORD)
    many = F.filter(
        F.transform("variables", lambda v: F.struct(v.alias("name"), F.size(F.filter(left, lambda t: t == v)).alias("n"))),
        lambda x: x["n"] > 1,
    )
    many = F.transform(many, lambda x: F.struct(F.lit(5).alias("rule"), F.concat(F.lit("variable "), x["name"], F.lit(" stands "), x["n"], F.lit(" times on the left side")).alias("msg")))
    names = F.array_distinct(matches(F.col("cut"), CAPITALISED))
    known = F.concat("variables", "ops", "sorts", F.array(*map(F.lit, BUILT_IN)))
    odd = F.filter(F.array_except(names, known), lambda t: ~F.lower(t).isin(*KEYWORDS))
    odd = F.transform(odd, lambda t: F.struct(F.lit(6).alias("rule"), F.concat(F.lit("name "), t, F.lit(" is not declared")).alias("msg")))
    rule = F.rlike("cut", F.lit(RULE_LINE))
    rows = rows.select("program_id", "line", F.explode(F.concat(many, F.when(rule, odd).otherwise(F.slice(odd, 1, 0)))).alias("i"))
    return rows.select("program_id", "line", "i.rule", F.lit(WARNING).alias("severity"), "i.msg")


def lint(programs: DataFrame) -> DataFrame:
    """All issues of ``programs(program_id, code)``."""
    return line_issues(programs).unionByName(name_issues(programs))


def fatals(issues: DataFrame) -> DataFrame:
    return issues.where(F.col("severity") == FATAL)


def formatted(issues: DataFrame) -> DataFrame:
    """``program_id, issues``: one line an issue; rules 1 to 4 by line, then rule 5, then rule 6."""
    line = F.concat(F.lit("- line "), "line", F.lit(" ["), "severity", F.lit("] : "), "msg")
    key = F.struct(F.greatest("rule", F.lit(4)).alias("stage"), "line", "rule", line.alias("text"))
    rows = issues.groupBy("program_id").agg(F.sort_array(F.collect_list(key)).alias("i"))
    return rows.select("program_id", F.array_join(F.transform("i", lambda i: i["text"]), "\n").alias("issues"))


def issue_counts(issues: DataFrame, programs: DataFrame) -> DataFrame:
    """``model, rule, n, n_programs`` with subtotals (null) by model and overall."""
    rows = issues.join(programs.select("program_id", "model"), "program_id")
    return rows.rollup("model", "rule").agg(F.count("*").alias("n"), F.countDistinct("program_id").alias("n_programs"))


def code_tokens(code: Column) -> Column:
    return F.array_distinct(matches(code, f"{WORD}|{SYMBOLS}"))


def rising(programs: DataFrame, exemplars: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``name, size, t`` and ``exemplar, size, t``: each one's distinct tokens, those of few exemplars first.

    ``size`` counts all of an exemplar's tokens, ``t`` holds those that some program has: no other can be shared. Each text is read once.
    """
    own = lambda rows, name: rows.select(F.col("name").alias(name), code_tokens(F.col("code")).alias("t")).select(name, F.size("t").alias("size"), F.explode("t").alias("t"))
    a = keep(own(programs, "name"), "program-tokens")
    asked = keep(a.select("t").distinct(), "asked-tokens")  # kept, so that its size is known and a small one is broadcast
    b = keep(own(exemplars, "exemplar").join(asked, "t", "left_semi").select("exemplar", "size", "t"), "shared-tokens")
    often = keep(b.groupBy("t").agg(F.count("*").alias("f")), "often")

    def sorted_(rows: DataFrame, name: str) -> DataFrame:
        rows = rows.join(often, "t", "left").groupBy(name, "size").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("f", F.lit(0)).alias("f"), "t"))).alias("s"))  # a program's tokens
        return rows.select(name, "size", F.transform("s", lambda x: x["t"]).alias("t"))

    return sorted_(a, "name"), sorted_(b, "exemplar")


def overlap(pairs: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """``name, exemplar, score``: the Jaccard overlap of pairs."""
    both = pairs.join(a.select("name", F.col("size").alias("na"), F.col("t").alias("ta")), "name").join(b.select("exemplar", F.col("size").alias("nb"), F.col("t").alias("tb")), "exemplar")
    shared = F.size(F.array_intersect("ta", "tb"))
    return both.select("name", "exemplar", (shared / (F.col("na") + F.col("nb") - shared)).alias("score")).where("score > 0")


def first_pairs(a: DataFrame, b: DataFrame, tokens: int = FIRST_TOKENS, each: int = FIRST_EXEMPLARS) -> DataFrame:
    """``name, exemplar``: some pairs that share a rare token, at most ``tokens * each`` a program, for a first score to beat."""
    own = b.select("exemplar", F.explode("t").alias("t"))
    few = own.withColumn("n", F.row_number().over(Window.partitionBy("t").orderBy("exemplar"))).where(F.col("n") <= each)
    mine = a.select("name", F.posexplode("t").alias("i", "t")).join(own.select("t").distinct(), "t", "left_semi")
    mine = mine.withColumn("n", F.row_number().over(Window.partitionBy("name").orderBy("i"))).where(F.col("n") <= tokens)
    return mine.join(few.select("t", "exemplar"), "t").where("name <> exemplar").select("name", "exemplar").distinct()


def candidate_pairs(a: DataFrame, b: DataFrame, least: DataFrame) -> DataFrame:
    """``name, exemplar``: all pairs that can reach ``least(name, least)`` (none: any overlap), by the prefix, length and position filters.

    Tokens stand by rising frequency. To reach the score, a program and an exemplar must share a token of
    the program's prefix, and the places of the first one they share leave room for the rest.
    """
    mine = a.join(least, "name", "left").select("name", F.col("size").alias("na"), F.coalesce("least", F.lit(0.0)).alias("s"), F.posexplode("t").alias("i", "t"))
    mine = mine.where(F.col("i") <= F.col("na") - F.col("s") * F.col("na") + 1e-9)
    own = b.select("exemplar", F.col("size").alias("nb"), F.size("t").alias("kept"), F.posexplode("t").alias("j", "t"))
    met = mine.join(own, "t").where("name <> exemplar")
    s, na, nb, kept = F.col("s"), F.col("na"), F.col("nb"), F.col("kept")
    alike = (nb >= s * na - 1e-9) & (na >= s * nb - 1e-9) & (F.col("j") <= kept - s * nb + 1e-9)
    room = F.least(na - F.col("i"), kept - F.col("j"))  # this token and what stands behind it
    return met.where(alike & (room * (1 + s) >= s * (na + nb) - 1e-9)).select("name", "exemplar").distinct()


def most_similar(programs: DataFrame, exemplars: DataFrame) -> DataFrame:
    """``name, exemplar, score``: the exemplar of another name with the largest Jaccard overlap of tokens, first by name.

    A few exemplars that share a rare token give each program a score to beat; filters on prefixes, lengths and
    positions then leave the pairs that can reach it, which are compared whole. Names are unique on either
    side. Exact; no overlap gives no row.
    """
    a, b = (keep(x, "tokens") for x in rising(programs, exemplars))
    first = keep(overlap(first_pairs(a, b), a, b), "first-scores")
    least = first.groupBy("name").agg(F.max("score").alias("least"))
    scored = first.unionByName(overlap(candidate_pairs(a, b, least), a, b))
    order = Window.partitionBy("name").orderBy(F.desc("score"), "exemplar")
    return scored.withColumn("r", F.row_number().over(order)).where("r <= 1").drop("r").select("name", "exemplar", "score")
