"""PII, mixing, SimHash and quality against brute force, with nulls, ties, repeats and empty tables."""

import hashlib
import random
import re
import time
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from brightloom.llm import mixing, pii, pu_quality, queries, simhash

DOC = "doc_id long, text string, lang string, source string, n_chars long, size long, spans string, fp long, k string"


def docs(spark, rows):
    """Documents with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), -1, "x", 7, "k") for i, t, s in rows], DOC)


def save(spark, tmp_path, rows):
    docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


PATTERNS = (
    ("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")),
    ("ip", re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")),
    ("card", re.compile(r"[0-9]([\x20-]?[0-9])+")),
    ("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")),
)


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (2 if i % 2 else 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def base(text):
    out = []
    for rank, (kind, p) in enumerate(PATTERNS):
        for m in p.finditer(text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {
                "email": True,
                "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")),
                "card": 14 <= len(digits) <= 19 and luhn(digits) if digits else False,
                "phone": 10 <= len(digits) <= 15,
            }[kind]
            if ok:
                out.append((m.start(), rank, m.end(), kind))
    return ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(out))


PIECES = ["a.b@c.de", "x@y", "@z.com", "_q", ".com", " ", "é", "😀", "1.2.3.4", "255.256.1.1", ".5", "0001.2.3.4", "4111 1111 1111 1111", "4111-1111-1111-1111", "+1 (444) 555-4984", "+49", "12345678901234", "--", "a.b@c.d.e", "%", "\n", "9", "password=ab12cd34ef56ab12"]


def test_pii_base_against_plain_patterns(spark, tmp_path):
    rng = random.Random(1)
    rows = [(i, "".join(rng.choice(PIECES) for _ in range(rng.randint(0, 14))), "s") for i in range(400)] + [(900, None, None), (901, "", "s"), (None, "a@b.cd", "s"), (1, "a@b.cd", "s"), (1, "a@b.cd", "s")]
    got = queries.op1_pii(spark, save(spark, tmp_path, rows)).collect()
    digest = lambda t: hashlib.sha256(base(t).encode()).hexdigest()
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["base_sha256"]) for r in got) == sorted((i if i is not None else -1, digest(t)) for i, t, _ in rows)
    texts = dict((i, t) for i, t, _ in rows[:400])
    for r in got:
        if r["doc_id"] in texts and r["doc_id"] != 1:
            assert set(filter(None, base(texts[r["doc_id"]]).split(","))) <= set(r["spans"].split(","))
            assert r["n_email"] == base(texts[r["doc_id"]]).count("email")


def test_pii_adds_and_redacts(spark):
    rows = [(i, f"clean words only {i}", "s") for i in range(20)] + [(50 + i, f"é mail me a@b.cd, password=ab12cd34ef56ab{10 + i} ok", "s") for i in range(20)]
    df = docs(spark, rows + [(None, None, None)])
    kinds = {k for r in pii.find(df).collect() for k in [s["kind"] for s in r["spans"]]}
    assert kinds == {"email", "secret"}
    out = {r["doc_id"]: r for r in pii.redacted(df).collect()}
    assert out[50]["text"] == "é mail me [EMAIL], [SECRET] ok" and out[3]["text"] == "clean words only 3" and out[None]["text"] is None
    assert pii.redacted(df).columns == df.columns
    assert pii.find(df.limit(0)).count() == 0


def test_pii_long_runs_take_linear_time(spark):
    rows = [(1, "a" * 200_000 + " x@y", "s"), (2, "1" * 200_000 + ".", "s"), (3, "a@b" + ".c" * 50_000, "s"), (4, "1 " * 100_000, "s")]
    got = {r["doc_id"]: len(r["base"]) for r in pii.find(docs(spark, rows)).collect()}
    assert got == {1: 0, 2: 0, 3: 1, 4: 0}


def test_pii_many_hits_take_linear_time(spark):
    many = "12, " * 250_000
    mixed = "tel=1234567, a@b.co é " * 2000
    start = time.time()
    got = {r["doc_id"]: r for r in pii.find(docs(spark, [(1, many, "s"), (2, mixed, "s")])).collect()}
    assert time.time() - start < 60
    assert not got[1]["spans"]
    emails = [(s["start"], s["end"]) for s in got[2]["base"]]
    assert emails == [(m.start(), m.end()) for m in re.finditer(r"a@b\.co", mixed)]


def test_pii_redacts_many_spans(spark):
    clean = [(i, f"clean words only {i}", "s") for i in range(5)]
    unit = "é mail a@b.co, password=ab12cd34ef56ab7 ok. "
    out = {r["doc_id"]: r["text"] for r in pii.redacted(docs(spark, [*clean, (9, unit * 300, "s")])).collect()}
    assert out[9] == "é mail [EMAIL], [SECRET] ok. " * 300


def test_pii_odd_columns(spark):
    df = docs(spark, [(1, "a@b.co", "s"), (None, None, None), (2, "", "s"), (1, "a@b.co", "s")]).withColumn("a.b", F.lit(1)).withColumn("row_", F.lit("z"))
    out = pii.redacted(df)
    assert out.columns == df.columns
    assert sorted(str(r["text"]) for r in out.collect()) == ["", "None", "[EMAIL]", "[EMAIL]"]
    assert pii.redacted(df.limit(0)).count() == 0


def test_expectation_maximisation_against_plain_rows():
    """The histogram's EM and classifier, against the same rules over one row for each candidate."""
    rng = random.Random(4)
    rows = []
    for _ in range(400):
        true = rng.random() < 0.4
        rows.append((tuple((1 if rng.random() < 0.85 else 0) if true and rng.random() < 0.7 else (0 if rng.random() < 0.5 else 2) for _ in range(pii.LABELERS)), (int(true or rng.random() < 0.2), 0, int(rng.random() < 0.5))))
    q = np.array([1 / (1 + np.exp(-(1.5 * sum((x == 1) - (x == 0) for x in v) - 0.5))) for v, _ in rows])
    for _ in range(60):
        pi = np.clip(q.mean(), 0.02, 0.98)
        tables = []
        for j in range(pii.LABELERS):
            t = np.array([[0.5, 0.2, 1.0], [0.2, 0.5, 1.0]])
            for p, (v, _) in zip(q, rows, strict=True):
                t[1, v[j]] += p
                t[0, v[j]] += 1 - p
            tables.append(t / t.sum(1, keepdims=True))
        z = np.array([np.log(pi / (1 - pi)) + sum(np.log(tables[j][1, x] / tables[j][0, x]) for j, x in enumerate(v) if x < 2) for v, _ in rows])
        q = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    model = pii.fit_model([("".join(map(str, v)), "".join(map(str, b)), n) for (v, b), n in Counter(rows).items()])
    assert np.allclose(model.reliability, [t[1, 1] / (t[1, 1] + t[0, 1]) for t in tables], atol=1e-3)
    x = np.array([[float(c == v[j]) for j in range(pii.LABELERS) for c in (0, 1, 2)] + [*map(float, b), 1.0] for v, b in rows])
    w = np.zeros(x.shape[1])
    for step in range(400):
        w -= 3.0 / (1 + step / 100) * (0.02 * w + x.T @ (1 / (1 + np.exp(-x @ w)) - q) / len(rows))
    assert np.allclose(model.weights, w, atol=1e-3)
    agreed = np.mean((x @ w > 0) == (q > 0.5))
    assert agreed > 0.9


def test_pii_takes_long_secrets_whole(spark):
    def digits(n, seed, letters="0123456789abcdef"):
        return "".join(random.Random(seed).choices(letters, k=n))

    mixed = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"
    made = []
    for i in range(10):
        made += [f"access_token={digits(93, i, mixed[52:62] + mixed[26:52])}", f"secret: {digits(128, i)}", f"api_key={digits(86, i, mixed)}7a=="]
        made += [f"token = {digits(36, i, mixed)}1.{digits(120, i + 50, mixed)}a.{digits(43, i + 90, mixed)}z", f"aws_s3_secret={digits(40, i)}", f"production_database_admin_password={digits(40, i)}", f"key7={digits(40, i)}"]
    made += [f"secret: {digits(30, i)}d4111111111111111e{digits(30, i + 5)}f" for i in range(5)]
    rows = [(i, f"clean words only {i}", "s") for i in range(70)] + [(100 + i, f"é mail me, {x} ok. Bye.", "s") for i, x in enumerate(made)]
    runs = [(300 + i, f"the secret {digits(100, i)}a1 ok", "s") for i in range(10)]
    out = {r["doc_id"]: r["text"] for r in pii.redacted(docs(spark, rows + runs)).collect()}
    assert {out[100 + i] for i in range(len(made))} == {"é mail me, [SECRET] ok. Bye."}
    assert {out[i] for i, *_ in runs} == {"the secret [SECRET] ok"}
    assert out[3] == "clean words only 3"
    held = pii.redacted(docs(spark, [*rows, (400, "card: 4111111111111111, phone: +15551234567 ok", "s")])).where("doc_id = 400").first()
    assert held["text"] == "card: [CARD], phone: [PHONE] ok"


def test_pii_places_are_exact(spark):
    text = "é 1555-123-45678 and 555-123-4567, x555-12-34567 555-12-3456 555-12-3456"
    spans = pii.spans_of(F.col("text"), pii.CANDIDATE)
    got = docs(spark, [(1, text, "s"), (2, "", "s"), (3, "none", "s")]).select("doc_id", spans.alias("s")).collect()
    want = [(m.start(), m.end(), m[0]) for m in re.finditer(pii.CANDIDATE, text, re.ASCII)]
    assert len(want) == 3 and {r["doc_id"]: [tuple(s) for s in r["s"]] for r in got} == {1: want, 2: [], 3: []}
    inside = docs(spark, [(1, "1555-12-34567 5-12-3456 1555-123-45678 555-123-4567", "s"), (2, "1555-123-4567 555-123-4567", "s")])
    for r in inside.select("text", spans.alias("s")).collect():
        assert [tuple(s) for s in r["s"]] == [(m.start(), m.end(), m[0]) for m in re.finditer(pii.CANDIDATE, r["text"], re.ASCII)]


def water_fill(sizes, weights, cap=3):
    """Targets by resharing until none is above its cap."""
    total, targets, free = sum(sizes), {}, set(range(len(sizes)))
    while free:
        left = total - sum(targets.values())
        w = sum(weights[i] for i in free)
        over = {i for i in free if left * weights[i] / w > cap * sizes[i]}
        if not over:
            targets |= {i: left * weights[i] / w for i in free}
            break
        targets |= {i: cap * sizes[i] for i in over}
        free -= over
    return [targets[i] for i in range(len(sizes))]


def test_mixed_documents_cut_the_same_rows_again(spark):
    rows = [(i, "w " * (i % 7 + 1), "abc"[i % 3]) for i in range(60)]
    rows += [(7, f"t{i} u v", "a") for i in range(40)] + [(None, f"x{i} y z", "a") for i in range(40)] + [(None, None, None), (3, "", "b"), (None, "one two", None)]
    df = docs(spark, rows).withColumn("row", F.lit(1)).withColumn("size", F.lit("s")).withColumn("copies", F.lit(None).cast("int"))
    first = mixing.mixed_documents(df)
    got = [tuple(r) for r in first.collect()]
    assert first.columns == df.columns and got == [tuple(r) for r in mixing.mixed_documents(df.repartition(5)).collect()]
    taken = {r["source"]: r["taken"] for r in mixing.curriculum(df).groupBy("source").agg(F.sum("taken").alias("taken")).collect()}
    at = first.columns.index("text"), first.columns.index("source")
    for source, n in taken.items():
        assert sum(len(r[at[0]].split()) for r in got if r[at[1]] == source) == n
    # Whole texts but for at most one of each source, none of them new, none more often than three times.
    texts = {t for _, t, _ in rows}
    assert len([r for r in got if r[at[0]] not in texts]) <= len(taken)
    assert max(sum(r[at[0]] == t for r in got) for t in texts if t and t.startswith(("t", "x"))) <= 3


def test_mixing(spark):
    rng = random.Random(2)
    rows, n = [], 0
    for source, count in (("a", 3), ("b", 200), ("c", 40), ("é", 1), (None, 30), ("z", 0)):
        for _ in range(count):
            rows.append((n, " ".join("w" * rng.randint(1, 9) for _ in range(rng.randint(0, 30))), source))
            n += 1
    rows += [(n, None, "z"), (None, "one two", "b"), (5, "again and again", "b"), (5, "again and again", "b")]
    df = docs(spark, rows)
    got = mixing.curriculum(df).collect()
    assert len(got) == len(rows)
    names = sorted({s for *_, s in rows if s is not None}) + [None]
    sizes = [sum(len((t or "").split()) for _, t, s in rows if s == x) for x in names]
    want = dict(zip(names, water_fill(sizes, [i % 3 + 1 for i in range(len(names))]), strict=True))
    for x in names:
        mine = [r for r in got if r["source"] == x]
        assert all(abs(r["target"] - want[x]) < 1e-6 for r in mine)
        assert abs(sum(r["taken"] for r in mine) - want[x]) <= 1
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in got)
    again = mixing.curriculum(df.repartition(3)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    order = mixing.training_order(df).collect()
    assert sum(r["tokens"] for r in order) == sum(r["taken"] for r in got) and all(0 <= r["position"] <= 1 for r in order)
    out = mixing.mixed_documents(df)
    assert out.columns == df.columns
    assert sum(len(r["text"].split()) for r in out.collect()) == sum(r["taken"] for r in got)
    assert mixing.mixed_documents(df.limit(0)).count() == 0
    assert mixing.curriculum(df.limit(0)).count() == 0
    assert [r["taken"] for r in mixing.curriculum(docs(spark, [(1, None, "a"), (2, "", None)])).collect()] == [0, 0]


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    n = max(1, len(words) - 3)
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(n)]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def test_fingerprints():
    rng = random.Random(3)
    for _ in range(200):
        t = "".join(rng.choice(["A", "é", " ", "\t", " ", "word", "\n", "İ", "x y"]) for _ in range(rng.randint(0, 40)))
        assert simhash.fingerprint(t) == slow_fingerprint(t), repr(t)
    assert simhash.fingerprint(None) == 0


def brute_classes(fps, most=4):
    v = np.array(fps, np.uint64)
    label = np.arange(len(v))
    for i in range(len(v)):
        near = np.bitwise_count(v ^ v[i]) <= most
        label[np.isin(label, label[near])] = label[near].min()
    changed = True
    while changed:
        changed = False
        for i in range(len(v)):
            near = np.bitwise_count(v ^ v[i]) <= most
            m = label[near].min()
            if (label[near] != m).any():
                label[np.isin(label, label[near])] = m
                changed = True
    return label


@pytest.mark.parametrize("part", [8, 4096])
def test_links_lose_none(spark, part):
    rng = random.Random(4)
    centres = [rng.getrandbits(64) for _ in range(40)]
    fps = set(centres)
    for c in centres[:12]:
        for _ in range(30):
            x = c
            for b in rng.sample(range(64), rng.randint(0, 5)):
                x ^= 1 << b
            fps.add(x)
    fps = sorted(fps)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    edges = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), part=part).collect()
    from brightloom.llm.common import connected_components

    found = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame([tuple(e) for e in edges], "a long, b long")).collect()}
    mine = [found.get(x, x) for x in signed]
    want = brute_classes(fps)
    assert len({(a, b) for a, b in zip(mine, want, strict=True)}) == len(set(want)) == len(set(mine))


def test_near_duplicates(spark, tmp_path):
    text = " ".join(f"w{i}" for i in range(300))
    rows = [(9, text, "s"), (4, text + " tail", "s"), (4, text + " tail", "s"), (7, None, None), (6, "", "s"), (5, " \n", "s"), (2, "other words in here now", "s"), (None, text, "s")]
    got = queries.op7_simhash(spark, save(spark, tmp_path, rows)).collect()
    assert sorted((r["doc_id"] or -1, r["component_id"]) for r in got) == [(-1, 4), (2, 2), (4, 4), (4, 4), (5, 5), (6, 5), (7, 5), (9, 4)]
    kept = simhash.deduplicated(spark.read.parquet(f"{tmp_path}/documents.parquet"))
    assert sorted(r["doc_id"] or -1 for r in kept.collect()) == [2, 4, 5]  # the row without an id is of a group that has one
    assert simhash.near_duplicates(docs(spark, [])).count() == 0


def test_deduplication_keeps_unlike_texts_of_one_id(spark):
    one, two, three = (" ".join(f"{w}{i}" for i in range(30)) for w in ("a", "b", "c"))
    rows = [(7, one, "s"), (7, two, "s"), (7, one, "t"), (9, two, "s"), (None, three, "s"), (None, three, "s"), (8, None, "s"), (8, "", "s")]
    df = docs(spark, rows).withColumn("a.b", F.lit(1))
    kept = simhash.deduplicated(df)
    assert kept.columns == df.columns
    assert sorted((r["doc_id"] or -1, r["text"] or "") for r in kept.collect()) == sorted([(7, one), (7, two), (-1, three), (8, "")])
    assert simhash.deduplicated(df.limit(0)).count() == 0


def test_components(spark):
    from brightloom.llm.common import connected_components

    rng = random.Random(6)
    edges = [(i, i + 1) for i in range(100, 160)] + [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(40)] + [(5, 5)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = sorted((find(a), find(b)))
        parent[rb] = ra
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got.get(x, x) == find(x) for x in parent)
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.1"
    got = queries.op10_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out")
    right, kept, refused = got.agg(F.avg((F.col("predicted") == F.col("quality")).cast("int")), F.avg(F.when(F.col("quality") == 1, F.col("predicted"))), F.avg(F.when(F.col("quality") == 0, F.col("predicted")))).first()
    assert right > 0.97 and kept > 0.97 and refused < 0.1


def test_quality_edges(spark):
    df = docs(spark, [(i, t, "s") for i, t in enumerate(["A sentence, as it were.", "", None, "!! " * 50, "x" * 100_000, "A sentence, as it were."])] + [(None, "A b.", None)])
    labels = spark.createDataFrame([(i, 1, 0) for i in range(6)], "doc_id long, quality int, toxic int")
    scorer = pu_quality.train(df, labels)
    got = pu_quality.score(df, scorer).collect()
    assert len(got) == 7 and all(0 <= r["score"] <= 1 for r in got)
    assert pu_quality.score(df.limit(0), scorer).count() == 0
    none = pu_quality.train(df, labels.limit(0))
    assert {r["score"] for r in pu_quality.score(df, none).collect()} == {0.5}
    assert pu_quality.accepted(df, scorer).columns == df.columns


def test_prior_estimate():
    rng = np.random.default_rng(0)
    p = rng.normal(2, 1, 4000)
    u = np.concatenate([rng.normal(2, 1, 2800), rng.normal(-3, 1, 1200)])
    assert abs(pu_quality.best_bin_prior(p, lambda c: (u >= c[:, None]).sum(1), len(u)) - 0.7) < 0.05


def test_risk_and_its_slopes():
    """Gradient and curvature against differences of the plainly written risk, and the weights found against small steps from them."""
    rng = np.random.default_rng(1)
    zp, zu = (np.hstack([rng.normal(m, 1, (n, 3)), np.ones((n, 1))]) for m, n in ((1.0, 300), (0.2, 900)))
    pi, decay, w = 0.4, 1e-4, rng.normal(size=4)
    t = pu_quality.slopes(zu, w)
    value = lambda w: np.log1p(np.exp(zu @ w)).sum()
    step = 1e-5 * np.eye(4)
    assert t[0] == 900 and np.isclose(t[1], value(w))
    assert np.allclose(t[2:6], [(value(w + e) - value(w - e)) / 2e-5 for e in step], rtol=1e-5)
    assert np.allclose(t[6:].reshape(4, 4), [(pu_quality.slopes(zu, w + e)[2:6] - pu_quality.slopes(zu, w - e)[2:6]) / 2e-5 for e in step], rtol=1e-4)

    def risk(w):
        sp, su = zp @ w, zu @ w
        rest = np.log1p(np.exp(su)).mean() - pi * np.log1p(np.exp(sp)).mean()
        return pi * np.log1p(np.exp(-sp)).mean() + max(0, rest) + decay / 2 * w @ w, rest

    found = pu_quality.newton(lambda w: pu_quality.slopes(zu, w), 4, zp, pi, False)
    least, rest = risk(found)
    assert rest >= 0
    for _ in range(300):
        assert risk(found + rng.normal(size=4) * 10 ** rng.uniform(-4, 0))[0] >= least - 1e-6
    # A prior far too large: the part that may not get negative stops the descent.
    pi = 0.97
    assert risk(pu_quality.newton(lambda w: pu_quality.slopes(zu, w), 4, zp, pi, False))[1] >= 0


def test_prior_and_fit_see_all_documents(spark):
    """The quality of unlabelled text far beyond the labelled sample moves the prior, and order of rows does not."""
    good = [f"This is a sentence of a text, number {i}, and it goes on as texts do. So does the next one, in a plain way." for i in range(400)]
    bad = [f"buy $$$ {i} ### click >>> !!! win | win | win | {'=' * (i % 30)} 0000 1111" for i in range(3000)]

    def prior(n):
        rows = [(i, t, "s") for i, t in enumerate([*good, *bad[:n]])]
        labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 400, 4)], "doc_id long, quality int, toxic int")
        return pu_quality.train(docs(spark, rows), labels)

    few, many = prior(100), prior(3000)
    assert few.prior > 0.5 and many.prior < 0.25
    got = {r["doc_id"]: r["predicted"] for r in pu_quality.score(docs(spark, [(0, good[7], "s"), (1, bad[7], "s")]), many).collect()}
    assert got == {0: 1, 1: 0}
