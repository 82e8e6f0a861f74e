"""Scoring, fusion and context expansion."""

import random

from pyspark.sql import functions as F

from brightloom.operators import expand, indexing, retrieve

CHUNK = "id long, source string, section string, type string, lang string, text string"


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_lexical(spark):
    q = spark.createDataFrame([(1, "x := y \"owise\""), (2, "")], "query_id long, text string")
    c = spark.createDataFrame([(0, "x := y"), (1, "owise"), (2, "OWISE := z"), (3, "none"), (4, None)], "id long, text string")
    got = rows(retrieve.lexical(q, c, 5).select("query_id", "rank", "id", "score").orderBy("rank"))
    assert got == [(1, 1, 2, 11), (1, 2, 0, 10), (1, 3, 1, 1)]
    assert rows(retrieve.lexical(q.where("query_id = 2"), c, 5)) == []


def test_fusion(spark):
    s = "query_id long, rank int, id long"
    lex = spark.createDataFrame([(q, r, i) for q in (1, 2) for r, i in enumerate((5, 7), 1)], s)
    sem = spark.createDataFrame([(q, r, i) for q in (1, 2) for r, i in enumerate((7, 1, 5, 2, 9, 8), 1)], s)
    flags = spark.createDataFrame([(1, True), (2, False)], "query_id long, special boolean")
    got = rows(retrieve.fuse(flags, lex, sem, 3).orderBy("query_id", "rank"))
    assert [(i, o[:3]) for q, _, i, o in got if q == 1] == [(5, "lex"), (7, "lex"), (1, "sem"), (2, "sem"), (9, "sem")]
    assert [(i, o[:3]) for q, _, i, o in got if q == 2] == [(7, "sem"), (1, "sem"), (5, "sem")]


def test_rrf(spark):
    s = "query_id long, rank int, id long"
    a = spark.createDataFrame([(1, 1, 1), (1, 2, 2), (1, 3, 3)], s)
    b = spark.createDataFrame([(1, 1, 3), (1, 2, 1)], s)
    assert [r["id"] for r in retrieve.rrf([a, b], 3).orderBy("rank").collect()] == [1, 3, 2]


def test_semantic_against_all_pairs(spark):
    rng = random.Random(3)
    vecs = [[rng.gauss(0, 1) for _ in range(5)] for _ in range(60)]
    c = spark.createDataFrame([(i, v) for i, v in enumerate(vecs)] + [(99, None), (98, [0.0] * 5)], "id long, vec array<double>")
    q = spark.createDataFrame([(i, vecs[i]) for i in range(7)], "query_id long, vec array<double>")
    got = rows(retrieve.semantic(q, c, 4, block=3).orderBy("query_id", "rank"))
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5
    for k in range(7):
        want = sorted(range(60), key=lambda i: (-cos(vecs[k], vecs[i]), i))[:4]
        assert [r[2] for r in got if r[0] == k] == want


def test_bm25_prefers_rare_terms(spark):
    c = spark.createDataFrame([(0, "the x the"), (1, "the rare word"), (2, "the y")], "id long, text string")
    q = spark.createDataFrame([(1, "the rare")], "query_id long, text string")
    got = rows(indexing.bm25(q, c, 3).orderBy("rank"))
    assert got[0][2] == 1
    assert len(got) == 3


def test_stored_postings(spark, tmp_path):
    c = spark.createDataFrame([(0, "a b a"), (1, None), (2, ""), (3, "b := c"), (4, "a")], "id long, text string")
    indexing.write_postings(c, f"{tmp_path}/i")
    index = indexing.read_postings(spark, f"{tmp_path}/i")
    posts = {(r["id"], r["term"]): (r["tf"], r["len"]) for r in index.posts.collect()}
    assert posts[0, "a"] == (2, 3) and posts[0, "b"] == (1, 3) and posts[4, "a"] == (1, 1) and {i for i, _ in posts} == {0, 3, 4}
    assert {r["term"]: r["df"] for r in index.terms.collect()}["a"] == 2
    q = spark.createDataFrame([(1, "a a c"), (2, "none"), (3, None)], "query_id long, text string")
    got = rows(indexing.search(q, index, 5).orderBy("rank"))
    assert {r[0] for r in got} == {1} and {r[2] for r in got} == {0, 3, 4}
    assert got == rows(indexing.bm25(q, c, 5).orderBy("rank"))
    indexing.write_postings(c.where("false"), f"{tmp_path}/none")
    assert rows(indexing.search(q, indexing.read_postings(spark, f"{tmp_path}/none"), 5)) == []


def chunk_table(spark, spec):
    return spark.createDataFrame([(i, "s", sec, kind, "", text) for i, sec, kind, text in spec], CHUNK)


def hit_table(spark, ids):
    return spark.createDataFrame([(1, r, i, "lexical") for r, i in enumerate(ids, 1)], "query_id long, rank int, id long, origin string")


def replay(hits, chunks, window=2, search=5):
    """The walk as it is defined, one hit after the other."""
    by = {i: (sec, kind) for i, sec, kind, _ in chunks}
    present, out = set(hits), []
    for h in hits:
        sec, kind = by[h]
        if kind == "code":
            for way in (1, -1):
                for step in range(1, search + 1):
                    n = by.get(h + way * step)
                    if n is None or n[0] != sec:
                        break
                    if n[1] == "text" and h + way * step not in present:
                        present.add(h + way * step)
                        out.append((h + way * step, "prose_of_code"))
                        break
        else:
            for d in range(-window, window + 1):
                n = by.get(h + d)
                if d and n and n[0] == sec and h + d not in present:
                    present.add(h + d)
                    out.append((h + d, "neighbor"))
    return [(h, "lexical") for h in hits] + out


def test_neighbours_golden(spark):
    spec = [(9, "A", "text", ""), (10, "A", "code", ""), (11, "A", "text", ""), (12, "A", "text", "")]
    got = rows(expand.neighbours(hit_table(spark, [10, 11]), chunk_table(spark, spec)).orderBy("rank").select("id", "origin"))
    assert got == [(10, "lexical"), (11, "lexical"), (12, "prose_of_code"), (9, "prose_of_code")]


def test_neighbours_against_replay(spark):
    rng = random.Random(5)
    spec = [(i, rng.choice("AB") if rng.random() < 0.3 else "A", rng.choice(["code", "text"]), "") for i in range(60) if rng.random() < 0.9]
    ids = [i for i, *_ in spec]
    cases = [rng.sample(ids, 6) for _ in range(8)]
    hits = spark.createDataFrame([(k, r, i, "lexical") for k, c in enumerate(cases) for r, i in enumerate(c, 1)], "query_id long, rank int, id long, origin string")
    got = rows(expand.neighbours(hits, chunk_table(spark, spec)).orderBy("query_id", "rank"))
    for k, c in enumerate(cases):
        assert [(i, o) for q, _, i, o in got if q == k] == replay(c, spec)


def test_section_modules(spark):
    spec = [(0, "S", "text", "t"), (1, "S", "code", "with x"), (2, "S", "code", "Maude> red fmod "), (3, "S", "code", "x = y"), (4, "T", "code", "fmod T"), (5, "U", "code", "fmod U")]
    got = rows(expand.section_modules(hit_table(spark, [0, 4, 5]), chunk_table(spark, spec)).orderBy("rank").select("id", "origin"))
    assert got[3:] == [(1, "section_module")]


def test_islands_and_sections(spark):
    spec = [(i, s, "text", "Maude> x" if i == 1 else f"t{i}") for i, s in enumerate("AAABBAAC")]
    c = chunk_table(spark, spec)
    for bucket in (2, 3, 100):
        assert [r[1] for r in rows(expand.islands(c, bucket).orderBy("id"))] == [0, 0, 0, 3, 3, 5, 5, 7]
    got = rows(expand.whole_sections(hit_table(spark, [1, 6]), c).select("rank", "id").orderBy("rank", "id"))
    assert got == [(1, 0), (1, 2), (2, 5), (2, 6)]


def test_budget(spark):
    words = lambda n: " ".join(["w"] * (n - 3))  # noqa: E731  [text] costs three
    spec = [(0, "A", "text", words(6)), (1, "A", "text", words(5)), (2, "A", "text", ""), (10, "B", "text", words(5)), (20, "C", "text", words(4)), (30, "N", "text", "Maude> noise")]
    got = rows(expand.budgeted_context(hit_table(spark, [0, 10, 20]), chunk_table(spark, spec), 10))
    assert got == [(1, f"=== SECTION : A ===\n\n[text]\n{words(6)}\n\n---\n\n=== SECTION : C ===\n\n[text]\n{words(4)}", 10)]
    got = rows(expand.budgeted_context(hit_table(spark, [30, 20]), chunk_table(spark, spec), 10))
    assert got[0][1].startswith("=== SECTION : N ===\n\n\n\n---\n\n=== SECTION : C") and got[0][2] == 4


def test_context_and_prompts(spark):
    spec = [(3, "S", "text", "b"), (1, "S", "code", "a")]
    ctx = expand.context(hit_table(spark, [3, 1]), chunk_table(spark, spec))
    assert rows(ctx) == [(1, "[S - code]\na\n\n---\n\n[S - text]\nb")]
    p = expand.prompts(ctx.withColumn("q", F.lit(None).cast("string")), "C: {context} Q: {q}")
    assert p.first()["prompt"].startswith("C: [S - code]") and p.first()["prompt"].endswith("Q: ")


def test_lookups(spark):
    c = chunk_table(spark, [(i, f"sec-{i}", "text", "t") for i in range(12)])
    w = spark.createDataFrame([("1, 3,x",), ("11",)], "ids string")
    assert sorted(r["id"] for r in retrieve.by_ids(c, w).collect()) == [1, 3, 11]
    assert retrieve.by_section(c, "sec-1").count() == 3
