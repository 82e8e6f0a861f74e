"""The stored index: block-max search, segments, character runs, block join, similar programs, runs of sections, encoders."""

import math
import random
import re
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from brightloom.operators import expand, indexing, lint, retrieve
from brightloom.sources import index, segments
from brightloom.sources.scratch import shared_dir


def rows(df):
    return [tuple(r) for r in df.collect()]


def words(text):
    return re.findall(r"\w+", (text or "").lower())


def bm25(queries, chunks, k):
    """Scores of every query and chunk, as published."""
    texts = {i: Counter(words(t)) for i, t in chunks}
    n, avg = len(chunks), sum(c.total() for c in texts.values()) / sum(t is not None for _, t in chunks)
    df = Counter(w for c in texts.values() for w in c)
    out = []
    for q, text in queries:
        found = []
        for i, c in texts.items():
            score = sum(math.log((n - df[w] + 0.5) / (df[w] + 0.5) + 1) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * c.total() / avg)) for w in set(words(text)) if c[w])
            if score:
                found.append((-round(score, 6), i))
        out += [(q, r, i, round(-s, 4)) for r, (s, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out)


def made_up(rng, n, first=0):
    vocabulary = [f"w{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(60)]
    out = [(first + i, " ".join(rng.choices(vocabulary, weights, k=rng.randrange(1, 25)))) for i in range(n)]
    return [(i, None if rng.random() < 0.03 else t) for i, t in out]


def found(spark, path, queries, k=7):
    q = spark.createDataFrame(queries, "query_id long, text string")
    return sorted((a, b, c, round(s, 4)) for a, b, c, s in rows(indexing.search(q, index.postings(spark, path), k)))


def table(spark, chunks):
    return spark.createDataFrame(chunks, "id long, text string")


def test_segments_equal_a_rebuild(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(indexing, "RANGE", 16)
    rng, path = random.Random(1), str(tmp_path / "i")
    chunks = dict(made_up(rng, 300))
    queries = [(q, " ".join(rng.choices([f"w{i}" for i in range(60)], k=3))) for q in range(25)] + [(90, None), (91, "nowhere")]
    index.create(table(spark, list(chunks.items())), path)
    assert found(spark, path, queries) == bm25(queries, list(chunks.items()), 7)

    def same():
        assert sorted(rows(index.chunks(spark, path)), key=lambda r: r[0]) == sorted(chunks.items())
        assert found(spark, path, queries) == bm25(queries, list(chunks.items()), 7)
        df = Counter(w for t in chunks.values() for w in set(words(t)))
        assert {r["term"]: r["df"] for r in index.postings(spark, path).terms.collect()} == df

    changes = {i: t for i, t in made_up(rng, 8, 40)} | {500: "w0 w59 fresh fresh"}
    index.upsert(table(spark, list(changes.items())), path, table(spark, [(3, None), (41, None), (999, None)]).select("id"))
    del chunks[3]
    chunks |= changes
    same()
    # Only what the upsert touched was written again.
    assert sorted(r["id"] for r in segments.read(spark, path, "chunks").where("segment = 1").collect()) == sorted(changes)
    assert {r["id"] for r in segments.read(spark, path, "gone").where("segment = 1").collect()} == ({3} | set(changes)) - {500}
    index.upsert(table(spark, [(500, "w1"), (44, "longer " * 80)]), path)
    chunks |= {500: "w1", 44: "longer " * 80}
    same()
    index.merge(spark, path)
    assert segments.live(spark, path) == [3]
    same()
    # A write that broke off leaves nothing visible.
    segments.write(table(spark, [(1, "w1 w1")]), path, "chunks", 4)
    same()
    index.upsert(table(spark, [(1, "w2")]), path)
    chunks[1] = "w2"
    same()


def test_postings_are_joined_where_texts_are_read(spark, monkeypatch):
    """No posting moves by itself: blocks are made without a shuffle, and one for each term and range where the ids stand in order."""
    monkeypatch.setattr(indexing, "RANGE", 16)
    chunks = made_up(random.Random(5), 90) + [(90, ""), (91, "a => B, A"), (92, " ... "), (93, "b ñ_1 \u2208 É")]
    made = indexing.posting_blocks(table(spark, chunks).coalesce(1))
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    blocks = made.collect()
    got = [(i, b["term"], tf, n) for b in blocks for i, tf, n in zip(b["ids"], b["tfs"], b["lens"], strict=True)]
    want = sorted(rows(indexing.posting_counts(table(spark, chunks))))
    assert sorted(got) == want and (91, "symruleto", 1, 4) in want
    assert len(blocks) == len({(t, i // 16) for i, t, _, _ in want})
    assert all(b["ids"] == sorted(b["ids"]) and b["df"] == len(b["ids"]) and b["words"] == sum(b["tfs"]) for b in blocks)
    # Many words are cut into several groups; no posting is lost or counted twice.
    texts = pa.RecordBatch.from_pydict({"id": [5, 4, 40], "w": ["x y x", "x", "y z"]})
    parts = [r for b in indexing._joined(iter([texts]), 16, most=2) for r in b.to_pylist()]
    assert sorted((i, r["term"], tf) for r in parts for i, tf in zip(r["ids"], r["tfs"], strict=True)) == [(4, "x", 1), (5, "x", 2), (5, "y", 1), (40, "y", 1), (40, "z", 1)]


def kept(spark):
    """Tables in the shared folder."""
    return {p.name for p in Path(re.sub("^file:(//)?", "", shared_dir(spark))).iterdir()}


def test_queries_share_stored_chunks(spark, monkeypatch):
    """Runs and postings are made of the chunks that lexical search reads; documents are numbered and written once, and hits are found once."""
    from brightloom.plans import catalog

    monkeypatch.setattr(catalog, "_STORED", {})
    before = kept(spark)
    catalog.x6_sections(spark, "/root/testdata/sf0.001").collect()
    catalog.r10_bm25(spark, "/root/testdata/sf0.001").collect()
    made = Counter(re.sub("-[0-9a-f]{32}$", "", n) for n in kept(spark) - before)
    assert {n: made[n] for n in ("id-rows", "id-order", "chunks", "runs", "index", "hits")} == {"id-rows": 0, "id-order": 1, "chunks": 1, "runs": 1, "index": 1, "hits": 1}


def test_upsert_keeps_the_ids_that_it_touches(spark, tmp_path):
    """Their number, known then, tells Spark not to shuffle the stored texts that few of them are looked up in."""
    path = str(tmp_path / "i")
    index.create(table(spark, made_up(random.Random(6), 40)), path, clustered=True)
    before = kept(spark)
    index.upsert(table(spark, [(3, "w1")]), path, table(spark, [(4, None)]).select("id"))
    assert {n.split("-")[0] for n in kept(spark) - before} >= {"touched", "superseded"}
    assert index.chunks(spark, path).count() == 39


def test_hybrid_with_vectors_apart(spark):
    chunks = spark.createDataFrame([(i, f"word{i % 3} :=", [1.0, i / 7]) for i in range(12)], "id long, text string, vec array<double>")
    asks = spark.createDataFrame([(1, "word1", [1.0, 0.5]), (2, "word2 :=", [0.0, 1.0])], "query_id long, text string, vec array<double>")
    apart = retrieve.hybrid(asks, chunks.select("id", "text"), 2, vectors=chunks.select("id", "vec"))
    assert sorted(rows(apart)) == sorted(rows(retrieve.hybrid(asks, chunks, 2))) and apart.count() == 8


def test_bounds_skip_blocks_of_a_common_word(spark, tmp_path):
    """Every chunk holds the common word; only ranges that can reach the best are scored, also without a rare word."""
    n, path = 40 * indexing.RANGE, str(tmp_path / "i")
    common = F.concat(F.lit("common "), F.repeat(F.lit("filler "), (F.col("id") % 13 + 3).cast("int")))
    text = F.when(F.col("id") % 9000 == 5, "common common common rare").when(F.col("id") % 20_000 == 7, "common common common").otherwise(common)
    chunks = spark.range(n).select("id", text.alias("text"))
    indexing.write_postings(chunks, path)
    stored = indexing.read_postings(spark, path)
    q = spark.createDataFrame([(1, "common"), (2, "common rare")], "query_id long, text string")
    a = indexing.asked(q, stored)
    first = indexing.first_wave(a)
    hits = retrieve.top(indexing._scored(first, a, stored.gone, 3), 3)
    more = indexing.second_wave(a, first, hits, 3)
    all_, visited = a.bounds.groupBy("query_id").count(), first.unionByName(more).groupBy("query_id").count()
    all_, visited = ({r["query_id"]: r["count"] for r in x.collect()} for x in (all_, visited))
    assert all_ == {1: 40, 2: 40}
    assert visited[1] <= 10 and visited[2] <= 10
    got = rows(indexing.search(q, stored, 3).select("query_id", "rank", "id"))
    assert sorted(got) == [(1, 1, 7), (1, 2, 20_007), (1, 3, 40_007), (2, 1, 5), (2, 2, 9005), (2, 3, 18_005)]


def test_lexical_by_character_runs(spark, monkeypatch):
    monkeypatch.setattr(retrieve, "GRAM_RANGE", 4)
    rng = random.Random(4)
    parts = ["alpha", "beta", ":=", "Ωmega", "=", "𝒳y", "gam", "ma", " ", "\n", "=>", "the", "ÄÖ"]
    chunks = [(i, "".join(rng.choices(parts, k=rng.randrange(0, 12))) if rng.random() > 0.05 else None) for i in range(80)]
    queries = [(q, " ".join(rng.choices([*parts, "alphabeta", '"="', "nowhere", "ωmega"], k=4))) for q in range(20)]
    q, c = spark.createDataFrame(queries, "query_id long, text string"), table(spark, chunks)
    tokens = rows(retrieve.tokens_of(q))
    want = Counter()
    for query, token, _, weight in tokens:
        for i, text in chunks:
            if text is not None and token.lower() in text.lower():
                want[query, i] += weight
    for block in (3, 50_000):
        got = {(a, b): s for a, b, s in rows(retrieve.lexical_scores(retrieve.tokens_of(q), c, block=block))}
        assert got == dict(want)
    path = f"{shared_dir(spark)}/test-grams-{rng.random()}"
    retrieve.write_grams(c, path)
    kept = spark.read.parquet(path)
    assert {(a, b): s for a, b, s in rows(retrieve.lexical_scores(retrieve.tokens_of(q), c, grams=kept))} == dict(want)
    only = {(a, b): s for a, b, s in rows(retrieve.lexical_scores(retrieve.tokens_of(q), c, F.col("id") < 9, grams=kept))}
    assert only == {k: s for k, s in want.items() if k[1] < 9}
    # A rare token meets the ranges that hold its rarest run, not all.
    near = retrieve.candidates(spark.createDataFrame([("𝒳y",), ("absent",)], "low string"), kept)
    have = {i // 4 for i, t in chunks if t and "𝒳y" in t}
    assert {r["range"] for r in near.collect()} == have and len(have) < 20
    assert rows(retrieve.lexical_scores(retrieve.tokens_of(q), c.limit(0))) == rows(retrieve.lexical_scores(retrieve.tokens_of(q.limit(0)), c)) == []


def test_lexical_makes_few_rows(spark):
    """A token that stands in all texts makes no row for each query and text: a part gives its best few."""
    n, k = 3000, 3
    chunks = table(spark, [(i, "common words " + ("rare " if i % 1000 == 7 else "") + f"number{i}") for i in range(n)])
    q = spark.createDataFrame([(i, "common rare" if i % 2 else "common words") for i in range(40)], "query_id long, text string")
    scored = retrieve.lexical_scores(retrieve.tokens_of(q), chunks, k=k)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert scored.count() <= 40 * k * tasks
    got = sorted(rows(retrieve.lexical(q, chunks, k).select("query_id", "rank", "id", "score")))
    assert got == sorted((i, r + 1, [7, 1007, 2007][r] if i % 2 else r, 2) for i in range(40) for r in range(k))


def test_lexical_moves_a_text_once(spark, monkeypatch):
    """Many blocks of queries send no text again, and small parts, filtered ones too, give the same scores."""
    n, q = 90, spark.createDataFrame([(i, f"common word{i % 7} number{i}") for i in range(50)], "query_id long, text string")
    chunks = table(spark, [(i, f"common word{i % 5} number{i}" if i % 9 else None) for i in range(n)])
    sent, frame = [], type(chunks)
    plain = frame.mapInArrow
    monkeypatch.setattr(frame, "mapInArrow", lambda df, *a, **k: sent.append(df) or plain(df, *a, **k))
    scored = retrieve.lexical_scores(retrieve.tokens_of(q), chunks, block=4)
    assert sent[-1].where("id is not null").count() == n - n // 9
    want = sorted(rows(scored))
    assert len(want) == 50 * (n - n // 9)
    retrieve.write_grams(chunks, f"{shared_dir(spark)}/test-once-grams")
    grams = spark.read.parquet(f"{shared_dir(spark)}/test-once-grams")
    for more in ({"part": 200}, {"grams": grams}):
        got = retrieve.lexical_scores(retrieve.tokens_of(q), chunks, block=4, **more)
        assert sent[-1].where("id is not null").count() == n - n // 9
        assert sorted(rows(got)) == want
    best = rows(retrieve.top(retrieve.lexical_scores(retrieve.tokens_of(q), chunks, block=4, k=2, part=200), 2).select("query_id", "rank", "id", "score"))
    order = sorted(want, key=lambda r: (r[0], -r[2], r[1]))
    assert sorted(best) == sorted((a, j + 1, i, s) for a in range(50) for j, (_, i, s) in enumerate([r for r in order if r[0] == a][:2]))


def test_block_join_of_vectors(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(230, 6))
    x[100:140] = x[100]
    c = spark.createDataFrame([(int(i), v.tolist()) for i, v in enumerate(x)] + [(900, [0.0] * 6), (901, None)], "id long, vec array<float>")
    q = spark.createDataFrame([(int(i), x[i].tolist()) for i in range(0, 230, 7)] + [(990, None), (991, [0.0] * 6), (None, x[3].tolist())], "query_id long, vec array<double>")
    x32 = x.astype(np.float32).astype(float)
    unit = x32 / np.linalg.norm(x32, axis=1)[:, None]
    for block, part in ((4, 5), (1000, 1000)):
        got = rows(retrieve.semantic(q, c, 5, block=block, part=part))
        assert len(got) == 33 * 5
        for i in range(0, 230, 7):
            s = np.round(unit @ (x[i] / np.linalg.norm(x[i])), 9)
            want = np.lexsort((np.arange(230), -s))[:5]
            mine = sorted((r, d, round(v, 9)) for a, r, d, v in got if a == i)
            assert np.allclose([v for *_, v in mine], s[want]) and [r for r, *_ in mine] == [1, 2, 3, 4, 5]
            if 100 not in want:
                assert [d for _, d, _ in mine] == want.tolist()
    assert rows(retrieve.semantic(q.limit(0), c, 5)) == rows(retrieve.semantic(q, c.limit(0), 5)) == []


def test_most_similar_compares_few(spark):
    rng = random.Random(8)
    names = [f"v{i}" for i in range(300)]
    weights = [1 / (1 + i) ** 0.8 for i in range(300)]
    codes = [" ".join({*rng.choices(names, weights, k=rng.randrange(10, 50)), "eq"}) for _ in range(150)]
    for i in range(0, 150, 3):  # near copies
        codes[i] = " ".join(w for w in codes[i - 1].split() if rng.random() > 0.1)
    b = [(f"e{i:03}", c) for i, c in enumerate(codes)]
    a = [(f"e{i:03}", codes[i]) for i in range(60)] + [("none", "99 99"), ("new", "v1 := v2 => v7"), ("odd", "zzz1 zzz2"), ("void", None)]
    sets = {n: set(re.findall(r"[A-Za-z][\w'-]*|:=|=>|~>|/\\", c or "")) for n, c in [*a, *b]}
    want = {}
    for n, _ in a:
        scored = [(-len(sets[n] & sets[m]) / len(sets[n] | sets[m]), m) for m, _ in b if m != n and sets[n] & sets[m]]
        if scored:
            want[n] = (min(scored)[1], round(-min(scored)[0], 9))
    pa, pb = (spark.createDataFrame(x, "name string, code string") for x in (a, b))
    assert {n: (e, round(s, 9)) for n, e, s in rows(lint.most_similar(pa, pb))} == want
    ta, tb = lint.rising(pa, pb)
    first = lint.overlap(lint.first_pairs(ta, tb), ta, tb)
    pairs = lint.candidate_pairs(ta, tb, first.groupBy("name").agg(F.max("score").alias("least"))).count()
    assert pairs < 0.3 * len(want) * len(b)
    assert rows(lint.most_similar(pa, pb.limit(0))) == rows(lint.most_similar(pa.limit(0), pb)) == []


def test_runs_of_sections(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(expand, "BUCKET", 4)
    rng = random.Random(6)
    sections, at = [], 0
    while at < 90:
        n = rng.randrange(1, 15)
        sections += [rng.choice("ABC")] * n
        at += n
    chunks = [(i, s, rng.choice(["text", "code"]), "Maude> x" if i % 11 == 0 else "w " * rng.randrange(1, 9)) for i, s in enumerate(sections) if i != 40]
    c = spark.createDataFrame(chunks, "id long, section string, type string, text string")
    expand.write_runs(c, str(tmp_path / "r"))
    runs = spark.read.parquet(str(tmp_path / "r"))
    want, now = [], []
    for i, s, *_ in chunks:
        if now and (i != now[-1][0] + 1 or s != now[-1][1]):
            want.append(now)
            now = []
        now.append((i, s))
    want = {(x[0][0], x[-1][0], x[0][1]) for x in [*want, now]}
    assert {(r["first"], r["last"], r["section"]) for r in runs.collect()} == want
    cost = {i: len(re.findall(r"\w+|[^\w\s]", f"[{k}]\n{t}")) for i, _, k, t in chunks if t != "Maude> x"}
    for r in runs.collect():
        assert r["cost"] == sum(cost.get(i, 0) for i in range(r["first"], r["last"] + 1))
    hits = spark.createDataFrame([(q, r, i, "x") for q in range(12) for r, i in enumerate(rng.sample([i for i, *_ in chunks], 5), 1)], "query_id long, rank int, id long, origin string")
    key = lambda df: sorted(rows(df.select("query_id", "rank", "id")))
    assert key(expand.whole_sections(hits, c, runs)) == key(expand.whole_sections(hits, c))
    by = {i: r for r in want for i in range(r[0], r[1] + 1)}
    assert key(expand.whole_sections(hits, c, runs)) == sorted((q, r, j) for q, r, i, _ in rows(hits) for j in range(by[i][0], by[i][1] + 1) if j in cost)
    # The scan, as it is defined, with the costs known beforehand and a small budget.
    texts = {i: f"[{k}]\n{t}" for i, _, k, t in chunks}
    for budget in (15, 60):
        got = {q: (t, s) for q, t, s in rows(expand.budgeted_context(hits, c, budget, runs=runs))}
        for q in range(12):
            left, parts, seen = budget, [], set()
            for _, i in sorted((r, i) for a, r, i, _ in rows(hits) if a == q):
                first, last, section = by[i]
                if section in seen:
                    continue
                seen.add(section)
                members = [j for j in range(first, last + 1) if j in cost]
                total = sum(cost[j] for j in members)
                if total > left:
                    if parts:
                        continue
                    some, total = [], 0
                    for j in members:
                        if total + cost[j] > budget:
                            break
                        some.append(j)
                        total += cost[j]
                    members = some
                    if not members:
                        continue
                left -= total
                parts.append(f"=== SECTION : {section} ===\n\n" + "\n\n".join(texts[j] for j in members))
            assert got[q] == ("\n\n---\n\n".join(parts), budget - left), (q, budget)


def counting_factory(path, dim=4):
    """An encoder that leaves a line where it is made."""
    import os

    with open(os.environ["BRIGHTLOOM_TEST_LOADS"] if "BRIGHTLOOM_TEST_LOADS" in os.environ else path + ".loads", "a") as f:
        f.write(f"{os.getpid()}\n")
    with open(path) as f:
        weight = float(f.read())
    return lambda text: [weight * len(text or "")] * dim


def test_encoder_is_made_once_a_process(spark, tmp_path):
    """Its weights come by file, and more tasks than workers do not make it again."""
    weights = tmp_path / f"weights-{random.random()}.txt"
    weights.write_text("0.5")
    df = spark.createDataFrame([(i, "x" * i) for i in range(200)] + [(999, None)], "id long, text string").repartition(24)
    got = {r["id"]: r["vec"] for r in indexing.embed(df, encoder="tests.test_index:counting_factory", files=(str(weights),), dim=3).collect()}
    assert got[8] == [4.0] * 3 and got[999] == [0.0] * 3
    from pyspark import SparkFiles

    loads = open(SparkFiles.get(weights.name) + ".loads").read().split()
    assert len(loads) == len(set(loads)) <= 8 < 24


def test_fences_take_linear_time(spark):
    import time

    from brightloom.functions import text as T

    lines = "```\nsome line of code\n```\nsome line of prose\n" * 25_000
    df = spark.createDataFrame([(lines,)], "t string")
    start = time.time()
    got = df.select(T.fenced(F.col("t")).alias("x")).select("x.*").first()
    assert time.time() - start < 20
    assert got["code"] == "\n".join(["some line of code"] * 25_000) and got["comment"] == "\n".join(["some line of prose"] * 25_000) + "\n"


def test_unit_and_counts_hash_words_once():
    from brightloom.operators import indexing

    for text in ("a b a C\u00e4 \ud800", "", None):
        both, before = indexing.unit_and_counts_encoder(16)(text), indexing._hash.cache_info()
        assert both.dtype == np.float32 and both[:16].tolist() == indexing.hashing_vector(text, 16).tolist()
        assert both[16:].tolist() == indexing.counting_encoder(16)(text).tolist()
        assert before.misses == indexing._hash.cache_info().misses


def test_embed_query_sums_squares_once_a_row(spark):
    import re

    from brightloom.plans import catalog

    plan = catalog.QUERIES["i1_embed"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "zip_with" in plan and not re.search(r"abs\([^|]*?aggregate\(", plan)


def test_ids_query_deals_by_rows(spark, monkeypatch):
    from brightloom.operators import ids
    from brightloom.plans import catalog

    want = sorted(rows(catalog.QUERIES["c6_ids"](spark, "/root/testdata/sf0.001")))
    monkeypatch.setattr(ids, "TASK_ROWS", 500)
    got = catalog.QUERIES["c6_ids"](spark, "/root/testdata/sf0.001")
    sizes = [n for _, n in got.groupBy(F.spark_partition_id()).count().collect()]
    assert sorted(rows(got)) == want and len(sizes) > 8 and max(sizes) < 1000


def test_rising_keeps_only_tokens_that_a_program_has(spark):
    programs = spark.createDataFrame([("p", "eq f = g"), ("q", "")], "name string, code string")
    exemplars = spark.createDataFrame([("x", "f g h i j"), ("y", "f"), ("z", "h")], "name string, code string")
    a, b = lint.rising(programs, exemplars)
    assert sorted(rows(a)) == [("p", 3, ["eq", "g", "f"])] and sorted(rows(b)) == [("x", 5, ["g", "f"]), ("y", 1, ["f"])]
    assert [tuple(r) for r in lint.most_similar(programs, exemplars).collect()] == [("p", "x", 2 / 6)]
