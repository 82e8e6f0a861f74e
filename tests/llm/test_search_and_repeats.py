"""Shared lexical search, hard negatives and removal of repeats, against brute force and on odd rows."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from brightloom.llm import anchor_tree, shared_search, suffix_dedup

DOC = "doc_id long, text string, term string, key long, n int"
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], DOC)


def words(text):
    return Counter(TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")))


def ranked(items, docs, k=10):
    held = [(i, words(t)) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n_docs, total, df = len(held), sum(c.total() for _, c in held), Counter(t for _, c in held for t in c)
    out = []
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(words(t))
    for item, terms in asked.items():
        found = []
        for i, c in held:
            m = 100 - 90 + (90 * c.total() * n_docs) // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 8 * m)) for t in terms if c[t])
            if score > 0:
                found.append((-score, i is None, i or 0))
        out += [(item, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(found)[:k])]
    return out


def by_text(rows):
    return sorted(map(repr, rows))


@pytest.mark.parametrize("block_terms", [30, 1 << 17])
def test_shared_search(spark, block_terms):
    rng = np.random.default_rng(3)
    vocabulary = ["Alpha", "été", "b2", "中文", "gamma", "delta", "eps", "zeta", "eta", "theta", "İstanbul", "x" * 300]
    docs = [(int(i), " ".join(rng.choice(vocabulary, rng.integers(1, 30)))) for i in range(150)]
    docs += [(200, None), (201, ""), (202, "...!?"), (None, "alpha gamma"), (None, "alpha gamma"), (5, "Alpha-gamma;delta"), (5, "Alpha-gamma;delta"), (-3, "alpha " * 5000), (203, "é" * 10 + "\x00b2")]
    items = [(int(i), " ".join(rng.choice(vocabulary, 4))) for i in range(40)] + [(50, None), (51, "unheard"), (None, "gamma b2"), (7, "zeta eta")]
    table = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, n int")
    got = shared_search.search(table, documents(spark, docs), block_terms=block_terms)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert by_text(tuple(r) for r in got.collect()) == by_text(ranked(items, docs))
    assert shared_search.search(table, documents(spark, [])).count() == 0
    assert shared_search.search(table.limit(0), documents(spark, docs)).count() == 0


def test_common_parts_are_added_once():
    rng = np.random.default_rng(0)
    common = np.arange(8)
    sets = [np.concatenate([common, 8 + rng.choice(500, 6, replace=False)]) for _ in range(60)] + [np.arange(8)] * 3
    item, term = np.repeat(np.arange(len(sets)), [len(s) for s in sets]), np.concatenate(sets)
    _, term = np.unique(term, return_inverse=True)
    left, right, ends, roots, order = shared_search.shared_plan(item, term)
    alone = len(item) - len(sets)
    assert len(left) < 0.65 * alone  # the eight common terms take seven additions in all
    held = [{int(t)} for t in order]
    start = len(order)
    for end in ends.tolist():
        for i in range(start, end):
            a, b = held[left[i - len(order)]], held[right[i - len(order)]]
            assert max(left[i - len(order)], right[i - len(order)]) < start and not a & b
            held.append(a | b)
        start = end
    for i, root in enumerate(roots.tolist()):
        assert held[root] == set(term[item == i].tolist())
    assert roots[-1] == roots[-2] == roots[-3]


def test_slices_of_a_long_text(monkeypatch):
    text = "Wörter und Zahlen 12, 34; " * 500
    whole = shared_search.term_counts(text.encode())
    monkeypatch.setattr(shared_search, "SLICE", 7)
    assert shared_search.term_counts(text.encode()) == whole == Counter({k.encode(): v for k, v in words(text).items()})


VEC = "vec_id long, embedding array<float>, label int, score double, key long"


def hard(rows, positives=5, negatives=10):
    held = []
    for place, (i, v, label) in enumerate(rows):
        if i is None or label is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        held.append((place, i, (label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * float(np.float32(x))) for x in v]))
    out = []
    for place, a, label, v in held:
        if a % 10:
            continue
        near = [(-sum(map(int.__mul__, v, w)), i, other == label) for p, i, other, w in held if p != place and len(w) == len(v)]
        for s, i, _ in sorted(x for x in near if x[2])[:positives]:
            found = sorted((t, j) for t, j, same in near if not same and 30 * -s <= 100 * -t <= 90 * -s)
            out += [(a, i, r + 1, j, -s, -t) for r, (t, j) in enumerate(found[:negatives])]
    return out


@pytest.mark.parametrize(("block", "part"), [(3, 20), (512, 4096)])
def test_anchor_tree(spark, block, part):
    rng = np.random.default_rng(5)
    centre = rng.normal(size=(6, 12))
    rows = [(int(i), (centre[i % 6] + rng.normal(size=12) * 0.3).astype(np.float32).tolist(), int(rng.integers(0, 3))) for i in range(300)]
    rows += [(1000 + i, rows[20][1], i % 2) for i in range(60)]  # one vector many times
    nan = float("nan")
    rows += [(400, None, 1), (401, [nan] * 12, 1), (402, [None] + [1.0] * 11, 1), (410, [0.0] * 12, 1), (411, [0.0] * 12, 2), (420, [1.0, 2.0], 1), (421, [1.0, 1.5], 1), (422, [1.0, 0.5], 2)]
    rows += [(None, rows[0][1], 1), (430, rows[0][1], None), (440, [], 1), (441, [], 1), (442, [], 2), (50, rows[50][1], rows[50][2]), (450, [-1e3] * 12, 0), (-20, rows[3][1], 2)]
    table = spark.createDataFrame([(i, v, label, 0.5, 7) for i, v, label in rows], VEC)
    got = anchor_tree.mine(table, F.col("vec_id") % 10 == 0, block=block, part=part)
    assert sorted(tuple(got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())) == sorted(hard(rows))
    assert anchor_tree.mine(table.limit(0), F.col("vec_id") % 10 == 0).count() == 0


def test_bounds_spare_scores():
    """Neighbouring anchors leave most candidates of the children without a score of their own."""
    rng = np.random.default_rng(2)
    x = np.floor(256 * np.concatenate([c + rng.normal(size=(200, 32)) * 0.01 for c in rng.normal(size=(20, 32))]))
    n = len(x)
    held = anchor_tree.Held(np.arange(n), np.arange(n), np.arange(n) % 2, x, np.sqrt((x * x).sum(1)))
    own = np.arange(100)  # of the first bunch
    order, parent, edge = anchor_tree.spanning_tree(x[own])
    own = own[order]
    block = {"key": own, "label": own % 2, "x": x[own], "parent": parent, "edge": edge, "low": np.full((100, 1), -(2**63)), "high": np.full((100, 1), 2**63 - 1)}
    hits, scored = anchor_tree.scan(held, block, 5, True)
    assert scored < 0.3 * 100 * n
    for i, _, at, score in hits:
        a = own[i[0]]
        mine = np.flatnonzero((held.label == a % 2) & (held.key != a))
        best = mine[np.lexsort((mine, -(x[mine] @ x[a])))[:5]]
        assert at.tolist() == best.tolist() and score.tolist() == (x[best] @ x[a]).tolist()


def test_scores_beyond_a_double():
    big = np.array([[2.0**40, 3.0], [2.0**70, -1.0], [1.0, 1.0]])
    assert anchor_tree.exact(big, np.array([2.0**40, 5.0])).tolist() == [2**63 - 1, 2**63 - 1, 2**40 + 5]
    assert anchor_tree.exact(np.array([[2.0**30, 1.0]]), np.array([2.0**29, 1.0])).tolist() == [2**59 + 1]


def repeats(rows, length=50):
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - length + 1):
            if i is not None:
                first[b[p : p + length]] = min(first.get(b[p : p + length], i), i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if i is not None and first[b[p : p + length]] < i:
                gone[p : p + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((i, len(b), sum(gone), sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()))
    return out


def passages():
    rng = np.random.default_rng(9)
    word = lambda n: " ".join("".join(rng.choice(list("abcdeé"), rng.integers(2, 8))) for _ in range(n))
    shared = [word(n) for n in (9, 12, 30, 200)]
    rows = []
    for i in range(120):
        parts = [word(rng.integers(0, 40))]
        for s in rng.choice(len(shared), rng.integers(0, 4)):
            cut = rng.integers(0, len(shared[s]) // 2)
            parts += [shared[s][cut:], word(rng.integers(0, 12))]
        rows.append((int(rng.integers(0, 90)), "".join(parts)))
    rows += [rows[3]] * 4 + [(500 + i, rows[7][1]) for i in range(30)]
    rows += [(600, None), (601, ""), (602, "x" * 49), (603, "x" * 50), (604, "x" * 51), (605, "ab" * 60), (606, "ba" * 60), (None, rows[7][1]), (None, None), (-5, shared[3]), (700, shared[3] * 20)]
    return rows


@pytest.mark.parametrize("bucket", [300, 1 << 24])
def test_without_repeats(spark, monkeypatch, bucket):
    rows = passages()
    got = suffix_dedup.without_repeats(documents(spark, rows), bucket=bucket)
    assert by_text(tuple(r) for r in got.collect()) == by_text(repeats(rows))
    assert suffix_dedup.without_repeats(documents(spark, [])).count() == 0
    kept = {r["doc_id"]: r["kept"] for r in suffix_dedup.without_repeats(documents(spark, [(1, "q" * 60), (2, "zz" + "q" * 60)]), with_text=True).collect()}
    assert (bytes(kept[1]), bytes(kept[2])) == (b"q" * 60, b"zz")


def test_runs_of_a_sliced_text(monkeypatch):
    """Windows choose the same places however the text is sliced, and every window is in one run."""
    text = passages()[100][1].encode() * 7
    whole = suffix_dedup.runs(text)
    monkeypatch.setattr(suffix_dedup, "SLICE", 37)
    parts = suffix_dedup.runs(text)
    lead = lambda r: np.repeat(r[2], r[1]).tolist()
    assert lead(whole) == lead(parts)
    for first, number, *_ in (whole, parts):
        assert first.tolist() == [0, *np.cumsum(number)[:-1].tolist()] and number.sum() == len(text) - 49


def test_multikey_and_buckets():
    rng = np.random.default_rng(1)
    words_ = [rng.integers(0, 3, 4000).astype(np.uint64) for _ in range(3)] + [rng.integers(-50, 50, 4000)]
    x = dict(zip(("hi", "lo", "run", "doc"), words_, strict=True))
    order = suffix_dedup.multikey(words_)
    rank = list(zip(*(w.tolist() for w in words_), strict=True))
    assert [rank[i] for i in order] == sorted(rank)
    split = suffix_dedup.splitters(x, 9)
    own = suffix_dedup.bucket_of(x, split)
    edges = list(zip(*(split[f].tolist() for f in ("hi", "lo", "run", "doc")), strict=True))
    assert own.tolist() == [sum(e <= r for e in edges) for r in rank]
    assert np.bincount(own, minlength=9).min() > 200  # copies of one beginning are spread
