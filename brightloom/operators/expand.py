"""Context expansion and assembly: neighbours, sections, whole runs, budgets, prompt rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brightloom.functions.text import token_count
from brightloom.sources.scratch import keep

# Marks of interactive sessions and typeset transcripts, and of module declarations.
SESSION = ("Maude>", "Welcome to Maude")
TYPESET = ("→", "⇝", "⇒", "∧")
MODULE = r"fmod |mod |fth |th |\neq |\nop "
SNIPPET_LANGS = ("python", "http", "bash", "json", "")
#: Ids of a bucket of the table of runs.
BUCKET = 1024


def _neighbours(hits: DataFrame, chunks: DataFrame, window: int, search: int) -> DataFrame:
    """Candidates of each hit in the order they are tried: ``query_id, rank, way, step, id, code``."""
    slim = chunks.select("id", "section", "type")
    own = hits.select("query_id", "rank", "id").join(slim, "id").withColumnsRenamed({"id": "hit", "section": "hit_section"})
    code = own.where("type = 'code'").select("query_id", "rank", "hit", "hit_section", F.explode(F.array(F.lit(1), F.lit(-1))).alias("way"))
    code = code.select("*", F.explode(F.sequence(F.lit(1), F.lit(search))).alias("step")).withColumn("id", F.col("hit") + F.col("way") * F.col("step"))
    code = code.join(slim, "id").where("section <=> hit_section")
    # A walk goes on while every step so far was there: the steps met are then 1, 2, 3, ...
    met = F.row_number().over(Window.partitionBy("query_id", "rank", "way").orderBy("step"))
    code = code.withColumn("met", met).where("met = step and type = 'text'")
    code = code.select("query_id", "rank", (-F.col("way")).alias("way"), "step", "id", F.lit(True).alias("code"))
    prose = own.where("type <> 'code'").select("query_id", "rank", "hit", "hit_section", F.explode(F.sequence(F.lit(-window), F.lit(window))).alias("step"))
    prose = prose.where("step <> 0").withColumn("id", F.col("hit") + F.col("step")).join(slim.drop("type"), "id").where("section <=> hit_section")
    return code.unionByName(prose.select("query_id", "rank", F.lit(0).alias("way"), "step", "id", F.lit(False).alias("code")))


def neighbours(hits: DataFrame, chunks: DataFrame, window: int = 2, search: int = 5) -> DataFrame:
    """Hits ``query_id, rank, id, origin`` with their neighbours added behind them in order.

    A text hit brings the chunks within ``window`` of the same section; a code hit
    the nearest prose on either side that isn't present yet, within ``search``
    steps of unbroken section. What is present grows hit by hit, which an
    aggregate over the few candidates of a query replays.
    """
    tried = _neighbours(hits, chunks, window, search)
    tried = tried.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "way", "step", "id", "code"))).alias("tried"))
    own = hits.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "id", "origin"))).alias("hits"))
    rows = own.join(tried, "query_id", "left")
    none = F.expr("cast(array() as array<struct<id: bigint, origin: string>>)")

    def step(acc: Column, c: Column) -> Column:
        key = c["rank"] * 4 + c["way"]
        take = ~F.array_contains(acc["present"], c["id"]) & ~(c["code"] & (acc["done"] == key))
        origin = F.when(c["code"], "prose_of_code").otherwise("neighbor")
        return F.struct(
            F.when(take, F.array_append(acc["present"], c["id"])).otherwise(acc["present"]).alias("present"),
            F.when(take & c["code"], key).otherwise(acc["done"]).alias("done"),
            F.when(take, F.array_append(acc["added"], F.struct(c["id"].cast("long").alias("id"), origin.alias("origin")))).otherwise(acc["added"]).alias("added"),
        )

    start = F.struct(F.transform("hits", lambda h: h["id"]).alias("present"), F.lit(-99).alias("done"), none.alias("added"))
    added = F.coalesce(F.aggregate("tried", start, step, lambda a: a["added"]), none)
    whole = F.concat(F.transform("hits", lambda h: F.struct(h["id"].cast("long").alias("id"), h["origin"].alias("origin"))), added)
    rows = rows.select("query_id", F.posexplode(whole).alias("pos", "x"))
    return rows.select("query_id", (F.col("pos") + 1).alias("rank"), "x.id", "x.origin")


def _section_code(hits: DataFrame, chunks: DataFrame, keep: Column, origin: str, n_sections: int) -> DataFrame:
    """Append the code of the best hits' sections, in id order; filtered before it meets the section names."""
    own = hits.join(chunks.select("id", "section"), "id")
    first = own.groupBy("query_id", "section").agg(F.min("rank").alias("first"))
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy("first"))
    aims = first.withColumn("nth", nth).where(F.col("nth") <= n_sections).select("query_id", "section")
    code = chunks.where((F.col("type") == "code") & keep).select("id", "section")
    new = aims.join(code, "section").join(hits.select("query_id", "id"), ["query_id", "id"], "left_anti")
    last = hits.groupBy("query_id").agg(F.max("rank").alias("last"))
    order = F.row_number().over(Window.partitionBy("query_id").orderBy("id"))
    new = new.withColumn("n", order).join(last, "query_id")
    return hits.select("query_id", "rank", "id", "origin").unionByName(new.select("query_id", (F.col("last") + F.col("n")).alias("rank"), "id", F.lit(origin).alias("origin")))


def section_modules(hits: DataFrame, chunks: DataFrame, n_sections: int = 2) -> DataFrame:
    """Add the module code of the sections of the best hits, without sessions and typeset transcripts."""
    text = F.col("text")
    keep = ~is_noise() & F.rlike(text, F.lit(MODULE))
    return _section_code(hits, chunks, keep, "section_module", n_sections)


def section_snippets(hits: DataFrame, chunks: DataFrame, n_sections: int = 2, langs: tuple[str, ...] = SNIPPET_LANGS) -> DataFrame:
    """Add the code of the sections of the best hits in the wanted languages, without one-line console text."""
    text = F.col("text")
    console = F.rlike(text, F.lit(r"(?U)^\s*(?:\$|>>>|#)")) & ~F.contains(text, F.lit("\n"))
    keep = F.coalesce(F.col("lang"), F.lit("")).isin(*langs) & ~console
    return _section_code(hits, chunks, keep, "section_snippet", n_sections)


def islands(chunks: DataFrame, bucket: int = 10_000) -> DataFrame:
    """``id, island``: the first id of the run of consecutive ids with one section that a chunk is in.

    Runs are found inside ranges of ids; a range that begins inside a run takes
    the last start of the ranges before it, of which there is one row each.
    """
    slim = chunks.select("id", "section", F.floor(F.col("id") / bucket).alias("range"))
    before = slim.select((F.col("id") + 1).alias("id"), F.col("section").alias("was"), F.lit(True).alias("near"))
    slim = slim.join(before, "id", "left")
    slim = slim.withColumn("start", F.when(F.col("near").isNull() | ~F.col("section").eqNullSafe(F.col("was")), F.col("id")))
    inside = F.max("start").over(Window.partitionBy("range").orderBy("id").rowsBetween(Window.unboundedPreceding, 0))
    slim = slim.withColumn("own", inside)
    last = slim.groupBy("range").agg(F.max("start").alias("last"))
    carried = F.max("last").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    last = last.select("range", carried.alias("carried"))
    return slim.join(last, "range").select("id", F.coalesce("own", "carried").alias("island"))


def is_noise() -> Column:
    """A session or a typeset transcript."""
    return reduce(lambda a, b: a | b, [F.contains("text", F.lit(mark)) for mark in SESSION + TYPESET])


def section_line() -> Column:
    """A chunk as it stands in a section's context."""
    return F.concat(F.lit("["), "type", F.lit("]\n"), "text")


def section_runs(chunks: DataFrame, cost: Column | None = None) -> DataFrame:
    """``bucket, first, last, section, cost``: the runs of consecutive ids with one section, a row for each ``BUCKET`` of ids that a run touches.

    ``cost`` sums an expression over ``line`` of the chunks that are no noise; default: tokens without specials.
    """
    each = cost if cost is not None else token_count(F.col("line"), 0)
    rows = chunks.select("id", "section", F.when(~is_noise(), section_line()).alias("line")).select("id", "section", each.alias("cost"))
    runs = rows.join(islands(chunks), "id").groupBy(F.col("island").alias("first"))
    runs = runs.agg(F.max("id").alias("last"), F.any_value("section").alias("section"), F.coalesce(F.sum("cost"), F.lit(0)).cast("long").alias("cost"))
    buckets = F.sequence(F.floor(F.col("first") / BUCKET), F.floor(F.col("last") / BUCKET))
    return runs.select(F.explode(buckets).alias("bucket"), "first", "last", "section", "cost")


def write_runs(chunks: DataFrame, path: str, cost: Column | None = None) -> None:
    """Keep ``section_runs`` beside the index, in order of ids, for all queries."""
    section_runs(chunks, cost).repartitionByRange("bucket", "first").sortWithinPartitions("bucket", "first").write.mode("overwrite").parquet(path)


def runs_of(hits: DataFrame, runs: DataFrame) -> DataFrame:
    """``query_id, rank, first, last, section, cost``: the run that each hit's id lies in, by a range join in buckets."""
    own = hits.select("query_id", "rank", "id", F.floor(F.col("id") / BUCKET).alias("bucket"))
    inside = F.col("id").between(F.col("first"), F.col("last"))
    return own.join(runs, "bucket").where(inside).select("query_id", "rank", "first", "last", "section", "cost")


def run_members(aims: DataFrame, chunks: DataFrame) -> DataFrame:
    """``first, id, section, type, text``: the chunks of the runs in ``aims(first, last)`` that are no noise; no other chunk's text moves."""
    low = F.floor(F.col("first") / BUCKET) * BUCKET
    parts = aims.select("first", "last").distinct().select("first", "last", F.explode(F.sequence(low, F.col("last"), F.lit(BUCKET).cast("long"))).alias("at"))
    ids = F.sequence(F.greatest("first", "at"), F.least(F.col("last"), F.col("at") + BUCKET - 1))
    wanted = parts.select("first", F.explode(ids).alias("id"))
    return chunks.select("id", "section", "type", "text").where(~is_noise()).join(wanted, "id").select("first", "id", "section", "type", "text")


def whole_sections(hits: DataFrame, chunks: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    """``query_id, rank, section, id, type, text``: each hit's whole run of its section, noise left out. ``runs``: kept ``section_runs`` of the chunks."""
    aims = runs_of(hits, runs if runs is not None else keep(section_runs(chunks), "runs"))
    return aims.select("query_id", "rank", "first").join(run_members(aims, chunks), "first").select("query_id", "rank", "section", "id", "type", "text")


def budgeted_context(hits: DataFrame, chunks: DataFrame, budget: int = 3000, cost: Column | None = None, runs: DataFrame | None = None) -> DataFrame:
    """``query_id, context, spent``: whole sections of the hits, best first, under a budget of tokens.

    A section enters if it fits what is left. One that is too large while nothing
    has entered gives its first chunks that fit; later ones are skipped and the
    scan goes on. The costs of runs tell first which sections can count at all: a section above
    the whole budget does only before the first one within it. Only those sections' chunks are read.
    ``cost`` is an expression over ``line``; default: tokens without specials. ``runs``: kept ``section_runs`` of the chunks at that cost.
    """
    aims = runs_of(hits, runs if runs is not None else keep(section_runs(chunks, cost), "runs"))
    aims = aims.withColumn("n", F.row_number().over(Window.partitionBy("query_id", "section").orderBy("rank"))).where("n = 1")
    fits_ = F.min(F.when(F.col("cost") <= budget, F.col("rank"))).over(Window.partitionBy("query_id"))
    aims = aims.withColumn("fit", fits_)
    aims = keep(aims.where((F.col("cost") <= budget) | F.col("fit").isNull() | (F.col("rank") < F.col("fit"))).select("query_id", "rank", "section", "first", "last"), "aims")
    own = aims.select("query_id", "section", "rank")
    members = run_members(aims, chunks).select("first", "id", "type", "text")
    members = aims.select("query_id", "section", "rank", "first").join(members, "first", "left")
    line = F.when(F.col("id").isNotNull(), section_line())
    members = members.withColumn("line", line).withColumn("cost", cost if cost is not None else token_count(F.col("line"), 0))
    per = members.groupBy("query_id", "rank", "section").agg(
        F.sort_array(F.collect_list(F.when(F.col("id").isNotNull(), F.struct("id", "cost")))).alias("members"), F.coalesce(F.sum("cost"), F.lit(0)).alias("total")
    )
    scan = per.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "total", "members"))).alias("sections"))
    none = F.expr("cast(array() as array<struct<rank: int, ids: array<bigint>>>)")

    def fits(members: Column) -> Column:
        def add(a: Column, m: Column) -> Column:
            stop = a["stop"] | (a["sum"] + m["cost"] > budget)
            return F.struct(stop.alias("stop"), F.when(stop, a["sum"]).otherwise(a["sum"] + m["cost"]).alias("sum"), F.when(stop, a["ids"]).otherwise(F.array_append(a["ids"], m["id"])).alias("ids"))

        start = F.struct(F.lit(False).alias("stop"), F.lit(0).cast("long").alias("sum"), F.expr("cast(array() as array<bigint>)").alias("ids"))
        return F.aggregate(members, start, add)

    def step(acc: Column, s: Column) -> Column:
        part = fits(s["members"])
        whole = s["total"] <= acc["left"]
        cut = ~whole & (F.size(acc["in"]) == 0) & (F.size(part["ids"]) > 0)
        ids = F.when(whole, F.transform(s["members"], lambda m: m["id"])).otherwise(part["ids"])
        return F.struct(
            F.when(whole, acc["left"] - s["total"]).when(cut, F.lit(budget) - part["sum"]).otherwise(acc["left"]).cast("long").alias("left"),
            F.when(whole | cut, F.array_append(acc["in"], F.struct(s["rank"].cast("int").alias("rank"), ids.alias("ids")))).otherwise(acc["in"]).alias("in"),
        )

    done = F.aggregate("sections", F.struct(F.lit(budget).cast("long").alias("left"), none.alias("in")), step)
    scan = scan.select("query_id", done.alias("done")).select("query_id", (F.lit(budget) - F.col("done.left")).alias("spent"), F.explode_outer("done.in").alias("s"))
    chosen = scan.select("query_id", "spent", "s.rank", F.explode_outer("s.ids").alias("id"))
    lines = members.select("query_id", F.col("rank").cast("int").alias("rank"), "id", "line")
    titles = own.select("query_id", F.col("rank").cast("int").alias("rank"), "section")
    text = chosen.join(lines, ["query_id", "rank", "id"], "left").join(titles, ["query_id", "rank"], "left")
    body = text.groupBy("query_id", "spent", "rank", "section").agg(F.sort_array(F.collect_list(F.when(F.col("id").isNotNull(), F.struct("id", "line")))).alias("m"))
    head = F.concat(F.lit("=== SECTION : "), "section", F.lit(" ===\n\n"), F.array_join(F.transform("m", lambda m: m["line"]), "\n\n"))
    body = body.select("query_id", "spent", "rank", head.alias("body"))
    out = body.groupBy("query_id", "spent").agg(F.sort_array(F.collect_list(F.when(F.col("rank").isNotNull(), F.struct("rank", "body")))).alias("b"))
    return out.select("query_id", F.array_join(F.transform("b", lambda b: b["body"]), "\n\n---\n\n").alias("context"), "spent")


def context(hits: DataFrame, chunks: DataFrame, with_lang: bool = False) -> DataFrame:
    """``query_id, context``: the hits' chunks in id order, each under its section and type."""
    rows = hits.select("query_id", "id").join(chunks, "id")
    kind = F.concat("type", F.when(F.coalesce(F.col("lang"), F.lit("")) != "", F.concat(F.lit(" ("), "lang", F.lit(")"))).otherwise("")) if with_lang else F.col("type")
    line = F.concat(F.lit("["), "section", F.lit(" - "), kind, F.lit("]\n"), "text")
    rows = rows.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("id", line.alias("line")))).alias("m"))
    return rows.select("query_id", F.array_join(F.transform("m", lambda m: m["line"]), "\n\n---\n\n").alias("context"))


def prompts(rows: DataFrame, template: str, name: str = "prompt") -> DataFrame:
    """Fill ``{column}`` places of a template from each row's columns; null is empty. No model is called."""
    import re

    parts = re.split(r"\{(\w+)\}", template)
    cols = [F.coalesce(F.col(p).cast("string"), F.lit("")) if i % 2 else F.lit(p) for i, p in enumerate(parts)]
    return rows.withColumn(name, F.concat(*cols))


def context_costs(contexts: DataFrame) -> DataFrame:
    """``method, n_queries, mean_tokens, max_tokens`` of ``contexts(method, query_id, context)``."""
    cost = token_count(F.coalesce("context", F.lit("")), 0)
    return contexts.select("method", cost.alias("n")).groupBy("method").agg(F.count("*").alias("n_queries"), F.round(F.avg("n"), 6).alias("mean_tokens"), F.max("n").cast("long").alias("max_tokens"))
