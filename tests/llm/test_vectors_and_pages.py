"""Vector joins and search against brute force; page extraction on planted pages; the pipeline stage by stage."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from brightloom.llm import cross_polytope, ego_join, html_extract, queries

VEC = "vec_id long, embedding array<float>, label int, score double, rank int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, label, 0.5, 1) for i, v, label in rows], VEC)


def planted(seed=0, n=300, d=16):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    for c in range(12):
        x[c * 10 + 1 : c * 10 + 7] = x[c * 10] + rng.normal(size=(6, d)) * 0.12
    if n > 230:
        x[200:230] = x[199]
    rows = [(int(i), x[i].astype(np.float32).tolist(), int(i) % 2 if i < 190 else 1) for i in range(n)]
    nan = float("nan")
    odd = [(900, None, 1), (901, [0.0] * d, 1), (902, [nan] * d, 1), (903, [None] + [1.0] * (d - 1), 1), (904, rows[0][1], None), (905, [1.0, 2.0], 1), (906, [2.0, 4.0], 1), (907, [], 1), (None, rows[0][1], 0)]
    return rows, odd


def usable(v):
    return bool(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)


@pytest.mark.parametrize("block", [7, 512])
def test_ego_join(spark, block):
    rows, odd = planted()
    got = {r["vec_id"]: r for r in ego_join.near_duplicates(vectors(spark, rows + odd), block=block).collect()}
    all_rows = [r for r in rows + odd if r[0] is not None]
    links = {i: set() for i, *_ in all_rows}
    for a, (i, v, s) in enumerate(all_rows):
        for j, w, t in all_rows[a + 1 :]:
            if s is not None and s == t and usable(v) and usable(w) and len(v) == len(w):
                p, q = np.array(v, float), np.array(w, float)
                if p @ q / np.sqrt((p @ p) * (q @ q)) >= 0.98:
                    links[i].add(j)
                    links[j].add(i)
    assert len(got) == len(rows + odd)
    for i, near in links.items():
        seen, new = {i}, {i}
        while new:
            new = {y for x in new for y in links[x]} - seen
            seen |= new
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (len(near), min(seen), i == min(seen)), i
    assert ego_join.near_duplicates(vectors(spark, [])).count() == 0


def test_ego_join_repeated_ids(spark):
    rows = [(1, [1.0, 0.0], 1), (1, [0.0, 1.0], 1), (2, [1.0, 0.001], 1), (3, [0.999, 0.001], 1)]
    got = sorted(tuple(r) for r in ego_join.near_duplicates(vectors(spark, rows)).collect())
    assert got == [(1, 0, 1, True), (1, 2, 1, True), (2, 2, 1, False), (3, 2, 1, False)]


def test_ego_join_compares_few_pairs_whole(spark):
    """On vectors without any structure, where boxes are wide, the leading directions still hold nearly all pairs apart."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 64))
    x[1::100] = x[::100] + rng.normal(size=(30, 64)) * 0.05
    df = spark.createDataFrame([(i, 1, 0, v.tolist()) for i, v in enumerate(x)], "vec_id long, weight long, label long, vec array<double>")
    found = ego_join.links(df, block=512)
    assert found.where("a is null").agg(F.sum("n")).first()[0] < 0.01 * 3000 * 2999 / 2
    assert found.where("b is not null").count() == 30


def test_search_recall(spark):
    sf = "/root/testdata/sf0.1"
    got = queries.op3_ann(spark, sf).toPandas()
    e = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas()
    x, ids = np.stack(e.embedding.values).astype(float), e.vec_id.values
    hit = total = 0
    for i in np.flatnonzero(ids % 20 == 0):
        s = x @ x[i]
        s[i] = -np.inf
        want = ids[np.lexsort((ids, -s))[:20]]
        mine = got[got.query_id == ids[i]].sort_values("rank")
        assert mine["rank"].tolist() == list(range(1, len(mine) + 1))
        assert np.allclose(mine.score, [s[np.flatnonzero(ids == v)[0]] for v in mine.vec_id], atol=1e-12)
        hit += len(set(want) & set(mine.vec_id))
        total += 20
    assert hit / total >= 0.9


@pytest.mark.parametrize("part", [16, 4096])
def test_search_ties_and_odd_rows(spark, part):
    rows, odd = planted(3, 120)
    rows += [(300 + i, rows[40][1], 0) for i in range(40)]
    df = vectors(spark, rows + odd + [rows[40]])
    got = cross_polytope.nearest(df, F.col("vec_id") % 20 == 0, k=5, tables=8, part=part, heavy=16).collect()
    mine = [(r["rank"], r["vec_id"]) for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == 40]
    score = {i: np.dot(np.array(v, float), np.array(rows[40][1], float)) for i, v, _ in rows}
    want = sorted((i for i in score if i != 40), key=lambda i: (-round(score[i], 9), i))[:5]
    assert [i for _, i in mine] == want
    assert not {900, 901, 902, 903, 905, 907} & {r["vec_id"] for r in got if r["query_id"] != 900}
    two = vectors(spark, [(0, [1.0, 0.0], 1), (1, [0.5, 0.5], 1)])
    assert [tuple(r) for r in cross_polytope.nearest(two, F.col("vec_id") % 20 == 0).collect()] == [(0, 1, 1, 0.5)]
    assert cross_polytope.nearest(vectors(spark, []), F.col("vec_id") % 20 == 0).count() == 0


def test_larger_norms_are_nearest(spark):
    rng = np.random.default_rng(1)
    rows = [(i, (rng.normal(size=8) * (1 + i % 5)).tolist(), 0) for i in range(400)]
    got = cross_polytope.nearest(vectors(spark, rows), F.col("vec_id") == 0, k=10, tables=24, heavy=64).collect()
    x = np.array([np.float32(v) for _, v, _ in rows], float)
    s = x @ x[0]
    s[0] = -np.inf
    assert len({r["vec_id"] for r in got} & set(np.argsort(-s)[:10].tolist())) >= 9


def recall(spark, x, **params):
    """Part of the nearest 20 found, and the least number of rows of a query."""
    x = np.asarray(x, np.float32).astype(float)
    got = cross_polytope.nearest(vectors(spark, [(i, v.tolist(), 0) for i, v in enumerate(x)]), F.col("vec_id") % 20 == 0, **params).toPandas()
    hit, rows, total = 0, [], 0
    for q in range(0, len(x), 20):
        s = x @ x[q]
        s[q] = -np.inf
        want = np.lexsort((np.arange(len(x)), -s))[: min(20, len(x) - 1)]
        mine = got[got.query_id == q]
        hit, total = hit + len(set(want.tolist()) & set(mine.vec_id)), total + len(want)
        rows.append(len(mine) - len(want))
    return hit / max(total, 1), min(rows)


def normal(n, width):
    return np.random.default_rng(n + width).normal(size=(n, width))


def test_compared_share_falls(tables=cross_polytope.TABLES):
    """Recall of the nearest 20 stays, while the part of all vectors that a query is compared with falls as they grow."""
    shares = []
    for n in (10_000, 40_000, 80_000):
        x = cross_polytope.prepared(normal(n, 64))
        near = []
        for q in range(232):
            s = x @ x[q]
            s[q] = -1
            near.append(x[np.argpartition(-s, 20)[:20]])
        probes = cross_polytope.measured(x[40:232], near[40:], n, tables)
        polytopes = cross_polytope.shape(n, 64)
        codes = [cross_polytope.bucket_of(x, t, polytopes) for t in range(tables)]
        hit = pairs = 0
        for i in range(40):  # others than were measured
            row, table, code = cross_polytope.probes_of(x[i : i + 1], tables, polytopes, probes)
            seen = np.zeros(n, bool)
            for t in range(tables):
                seen |= np.isin(codes[t], code[table == t])
            s = x @ x[i]
            s[i] = -1
            hit += seen[np.argpartition(-s, 20)[:20]].sum()
            pairs += seen.sum()
        assert hit / 40 / 20 >= 0.9
        shares.append(pairs / 40 / n)
    assert shares[0] > shares[1] > shares[2] and shares[2] < 0.1, shares


@pytest.mark.parametrize("width", [48, 128, 384, 768])
def test_search_recall_at_other_widths(spark, width):
    """Without structure wide vectors are met whole, others by measured probes; either way the nearest are found."""
    found, least = recall(spark, normal(2500, width))
    assert found >= 0.9 and least == 0


def test_wide_vectors_with_structure_are_hashed():
    rng = np.random.default_rng(4)
    x = (rng.normal(size=(150, 384))[:, None] + rng.normal(size=(150, 20, 384)) * 0.3).reshape(-1, 384)
    near = [np.delete(x[i // 20 * 20 : i // 20 * 20 + 20], i % 20, 0) for i in range(0, 3000, 40)]
    probes = cross_polytope.measured(x[::40], near, len(x), cross_polytope.TABLES)
    assert probes is not None and probes <= 0.02 * cross_polytope.TABLES * np.prod(cross_polytope.shape(len(x), 512))


def test_buckets_grow_smoothly():
    """No size makes buckets, or what a batch of queries needs, jump."""
    import tracemalloc

    for width in (4, 64, 512, 1024):
        before = None
        for n in np.unique(np.geomspace(2000, 1e9, 300).astype(int)).tolist():
            buckets = np.prod([float(a) for a in cross_polytope.shape(n, width)])
            assert buckets >= n / cross_polytope.PER_BUCKET and (before is None or before <= buckets <= 2 * before)
            before = buckets
    x = cross_polytope.prepared(normal(128, 64))
    for n, probes in ((1_000_000, 700), (1_100_000, 700), (100_000_000, 20_000)):
        tracemalloc.start()
        polytopes = cross_polytope.shape(n, 64)
        row, table, code = cross_polytope.probes_of(x[: cross_polytope.at_once(probes)], cross_polytope.TABLES, polytopes, probes)
        assert tracemalloc.get_traced_memory()[1] < 500e6
        tracemalloc.stop()
        assert np.bincount(row).tolist() == [probes] * (row[-1] + 1) and code.max() < np.prod(polytopes)


def test_probes_are_the_best_buckets():
    x = cross_polytope.prepared(normal(5, 8))
    polytopes = (16, 4)
    row, table, code = cross_polytope.probes_of(x, 3, polytopes, 50)
    for i in range(5):
        sums = {}
        for t in range(3):
            a, b = (cross_polytope._axes(x[i : i + 1], t, level, axes)[0] for level, axes in enumerate(polytopes))
            sums |= {(t, p * 4 + q): a[p] + b[q] for p in range(16) for q in range(4)}
        got = [sums[t, c] for t, c in zip(table[row == i].tolist(), code[row == i].tolist(), strict=True)]
        assert np.allclose(got, sorted(sums.values(), reverse=True)[:50])


@pytest.mark.parametrize("norms", ["one", "lognormal", "uniform", "two"])
def test_search_recall_with_unequal_norms(spark, norms):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(4000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    if norms == "one":
        x[17] *= 100
    elif norms == "two":
        x[::2] *= 100
    else:
        x *= (rng.lognormal(size=(4000, 1)) if norms == "lognormal" else rng.uniform(0.5, 2, (4000, 1)))
    found, least = recall(spark, x)
    assert found >= 0.9 and least == 0


@pytest.mark.parametrize("n", [5, 20, 30, 50])
def test_search_of_few_vectors_is_whole(spark, n):
    assert recall(spark, np.random.default_rng(n).normal(size=(n, 64))) == (1.0, 0)


def test_queries_left_short_meet_all_vectors(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(600, 16)) * 0.01
    x[:, 0] += np.where(np.arange(600) % 60 == 0, 1, -1)
    x /= np.linalg.norm(x, axis=1)[:, None]
    _, least = recall(spark, x, heavy=0, probes=2, tables=2, part=64)
    assert least == 0


def test_hadamard_is_orthonormal():
    x = np.random.default_rng(0).normal(size=(5, 64))
    assert np.allclose(cross_polytope.hadamard(cross_polytope.hadamard(x)), x)
    assert np.allclose(np.linalg.norm(cross_polytope.rotated(x, 3), axis=1), np.linalg.norm(x, axis=1))


def page(body, cls="content", noise=True):
    head = '<html><head><title>t</title><style>p{}</style></head><body class="has-sidebar"><header>Site name, with words enough to be long, really</header>'
    side = '<div class="sidebar-left"><p>Side text, with commas, and a lot of words to count, in a long line of it.</p></div>' if noise else ""
    tail = '<div id="comments"><p>A reader says, at length, that this is a comment, and so it is.</p></div></div><footer>foot</footer><script>if(a<b){"</p>"}</script></body></html>'
    return f'{head}{side}<div class="{cls}">{body}{tail}'


def test_main_text(spark):
    long = "A sentence of the article, which runs on, and on, to be long enough to count. "
    pages = [(i, f"https://h.example/{i}", page(f"<h1>T {i}</h1><p>{long * 3} &amp; é {i}<p>Second &lt;b&gt;,\n  with <a href='x>y'>a link</a>.<div class=ad>Buy, buy, buy, buy now, and more.</div>")) for i in range(6)]
    odd = [(10, "https://h.example/x", None), (11, None, ""), (12, "nonsense", "<p>tiny"), (13, "https://h.example/y", page("<p>short one", noise=True)), (0, pages[0][1], pages[0][2])]
    df = spark.createDataFrame([(*r, "x", 1) for r in pages + odd], "page_id long, url string, html string, text string, host int")
    got = sorted((r["page_id"], r["text"], r["n_chars"]) for r in html_extract.extract(df).collect())
    want = f"T 0\n{(long * 3).strip()} & é 0\nSecond <b>, with a link."
    assert got[0] == got[1] == (0, want, len(want))
    by = {i: t for i, t, _ in got}
    assert by[10] == "" and by[11] == "" and by[12] == "tiny"
    assert by[13] == "short one"
    assert html_extract.extract(df.limit(0)).count() == 0


def test_consensus_wins_over_a_page_of_comments(spark):
    long = "A sentence of the article, which runs on, and on, to be long enough to count. "
    pages = [(i, f"https://h.example/{i}", f"<body><div class=main>{'<p>' + long * 2}</div><section class=box-{i}><p>{long}</section>") for i in range(5)]
    pages.append((9, "https://h.example/9", f"<body><div class=main><p>{long * 2}</div><section class=box-9><p>{long * 2} x</section>"))
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    assert {r["text"] for r in html_extract.extract(df).collect()} == {(long * 2).strip()}


LONG = "A sentence of the article, which runs on, and on, to be long enough to count. "


@pytest.mark.parametrize(
    "body",
    [
        f"<article><h1>T</h1><div class=lead><p>{LONG}</p></div><div class=body>{f'<p>{LONG * 2}</p>' * 5}</div></article>",
        f"<div class=post><h1>T</h1><div class=lead><p>{LONG}</p></div><div class=body>{f'<p>{LONG * 2}</p>' * 5}</div></div>",
        f"<div class=post><p>{LONG}</p><ul>{f'<li>{LONG * 2}</li>' * 8}</ul></div>",
        f"<p>{LONG}</p><table>{f'<tr><td>{LONG * 2}</td></tr>' * 8}</table><p>{LONG}</p>",
        f"<p>{LONG}</p><section>{f'<p>{LONG * 2}</p>' * 8}</section>",
        f"<p>{LONG}</p><blockquote>{f'<p>{LONG * 2}</p>' * 8}</blockquote>",
    ],
)
def test_text_beside_the_dominant_container(spark, body):
    page = f"<body><nav><a href=x>Home</a></nav>{body}<div class=ad><p>{LONG}</p></div></body>"
    df = spark.createDataFrame([(i, f"https://h.example/{i}", page) for i in range(3)], "page_id long, url string, html string")
    want = [w for _, w, _ in html_extract.blocks(f"<body>{body}</body>")]
    assert {r["text"] for r in html_extract.extract(df).collect()} == {"\n".join(want)}


def test_host_path_with_little_of_the_page_does_not_hide_the_rest():
    html = f"<body><div class=main><p>{LONG * 2}</div><div class=other>{f'<p>{LONG * 3}' * 3}</div></body>"
    assert html_extract.main_text(html, ["/body/div.main"]) == "\n".join([(LONG * 2).strip()] + [(LONG * 3).strip()] * 3)


def test_closing_tags_balance_below_the_last_level():
    html = f"<body>{'<div>' * (html_extract.DEPTH - 1)}<div><div>a</div></div><p>b</p></div>c"
    levels = {w: [e.tag for e in stack].count("div") for stack, w, _ in html_extract.blocks(html)}
    assert levels == {"a": html_extract.DEPTH - 1, "b": html_extract.DEPTH - 1, "c": html_extract.DEPTH - 2}


def test_unended_markup():
    for html in ("<p", "<p>a<!-- b", "a<script>x", "<a href=\"x", "&am", "<div><div><div>", "</p></div>x", "<p>" * 3000 + "x", "<div>" * 3000 + "x"):
        html_extract.main_text(html, ["/body"])


def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    at = docs
    from brightloom.llm.common import materialize

    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, at = at, materialize(stage(spark, at, sf), name)
        assert at.columns == docs.columns, name
        if name in ("quality", "near_duplicates"):
            assert 0 < at.count() <= before.count()
            assert at.exceptAll(before).count() == 0
        elif name == "personal_data":
            assert at.count() == before.count()
            assert at.where("text rlike '[A-Za-z0-9]@[A-Za-z0-9]'").count() == 0
    got = corpus_pipeline.run(spark, sf).toPandas()
    assert got.groupby("sequence_id").length.sum().max() <= 1024
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer_path("byte_bpe_50k.json"))
    assert got.length.sum() == sum(len(t.encode(r["text"], add_special_tokens=False).ids) + 1 for r in at.select("text").collect())


LONG = "which is long enough to count as running text, surely."


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (f"<article><p data=it's>Hello don't go, {LONG}</p><p>And more, {LONG}</p></article>", f"Hello don't go, {LONG}\nAnd more, {LONG}"),
        (f"<article><p>First part, {LONG}</p><svg><path d='x'><p>The rest, {LONG}</p></article>", f"First part, {LONG}\nThe rest, {LONG}"),
        (f"<article><p>Here <math><mi>E</mi><mo>=</mo><mi>m</mi></math>, {LONG}</p></article>", f"Here E=m, {LONG}"),
        (f"<body><section class='two-side'><p>A text, {LONG}</p></section><div class='share-buttons'>Share</div></body>", f"A text, {LONG}"),
        ("<body>" + "<div>" * 300 + f"<p>A text, {LONG}</p><nav>Menu</nav><p>More, {LONG}</p>" + "</div>" * 300 + "<nav>Menu</nav></body>", f"A text, {LONG}\nMore, {LONG}"),
    ],
)
def test_odd_markup_loses_no_text(html, text):
    assert html_extract.main_text(html, []) == text


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (f"<body><form id=aspnetForm><div><h1>T</h1><p>A text, {LONG}</p><p>More, {LONG}</p></div><nav>Menu</nav></form></body>", f"T\nA text, {LONG}\nMore, {LONG}"),
        (f"<article><p>A text, {LONG}</p><p>More, {LONG}</p><form><p>Write here, {LONG}</p><input></form></article>", f"A text, {LONG}\nMore, {LONG}"),
        (f"<body><div class='ad-hoc-analysis'><p>A text, {LONG}</p></div><div class='ad-slot'>Buy, {LONG}</div></body>", f"A text, {LONG}"),
        (f"<body><div class='content-sidebar'><p>A text, {LONG}</p><div id='sidebar-left'>Side, {LONG}</div></div></body>", f"A text, {LONG}"),
        (f"<article><h2 class='section-header'>Part</h2><p>A text, {LONG}</p></article>", f"Part\nA text, {LONG}"),
        (f"<body><header><h1>Site</h1></header><article><header><h1>T</h1><p class=lead>Lead, {LONG}</p></header><p>A text, {LONG}</p></article></body>", f"T\nLead, {LONG}\nA text, {LONG}"),
    ],
)
def test_whole_articles_are_kept(html, text):
    assert html_extract.main_text(html, []) == text


def test_unended_drawings_take_linear_time():
    import time

    start = time.time()
    assert html_extract.main_text("<body>" + "<svg>" * 80_000 + f"<p>A text, {LONG}</p>", []) == f"A text, {LONG}"
    assert time.time() - start < 5


def test_generated_pages(spark):
    """Articles put together from known blocks, among parts that are none; the blocks must come out, and they only."""
    import random

    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdeimnorst", k=rng.randrange(2, 9)))
    said = lambda n: " ".join(word() for _ in range(n)).capitalize() + ", " + LONG
    menu = "<nav><ul>" + "".join(f"<li><a href=/{i}>{said(3)}</a></li>" for i in range(6)) + "</ul></nav>"
    noise = [
        lambda: f"<div class='sidebar'><p>{said(9)}</p></div>", lambda: f"<aside><p>{said(9)}</p></aside>", lambda: f"<div class='ad-banner'>{said(6)}</div>",
        lambda: f"<section id=comments><h3>Replies</h3>{''.join(f'<p>{said(9)}</p>' for _ in range(rng.randrange(1, 4)))}</section>",
        lambda: f"<form action=/s><label>{said(2)}</label><input></form>", lambda: f"<div class='cookie-notice'><p>{said(5)}</p></div>", lambda: menu,
        lambda: f"<script>var t = '<p>{said(3)}</p>';</script>", lambda: f"<style>p {{ content: '{word()}' }}</style>", lambda: f"<!-- <p>{said(4)}</p> -->",
    ]
    shells = ["<article>{}</article>", "<main>{}</main>", "<div class='post-body'>{}</div>", "<div id=content><div class='text'>{}</div></div>"]
    rows, want = [], {}
    for i in range(120):
        blocks, html = [], []
        for _ in range(rng.randrange(3, 12)):
            t = said(rng.randrange(4, 20))
            kind = rng.randrange(5)
            blocks.append({0: t.upper(), 3: f"{t} & more"}.get(kind, t))
            html.append((f"<h2>{t.upper()}</h2>", f"<p>{t}</p>", f"<p>{t}", f"<p><b>{t}</b>\n&amp; more</p>", f"<blockquote><p>{t}</p></blockquote>")[kind])
            if rng.random() < 0.15:
                html.append(noise[2]())
        around = [rng.choice(noise)() for _ in range(6)]
        rows.append((i, f"https://h{i % 4}.example/{i}", f"<html><head><title>{word()}</title></head><body><header>{said(4)}</header>{''.join(around[:3])}{shells[i % 4].format(''.join(html))}{''.join(around[3:])}<footer>{said(5)}</footer></body></html>"))
        want[i] = "\n".join(blocks)
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_extract.extract(df).collect()}
    assert got == want
