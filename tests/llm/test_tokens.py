"""Encoding, counts, packing and token files against the library itself."""

import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from brightloom.llm import encoding, packing, queries, token_counts, token_files
from brightloom.llm.encoding import Encoder

BYTE, WORD = queries.tokenizer_path("byte_bpe_50k.json"), queries.tokenizer_path("word_bpe_49k.json")
SYLLABLES = ["a", "b", " ", " ", "\n", "\t", "\r", "\x1c", "\x85", "\xa0", "'s", "'", "é", "1", "23", "!", "<|endoftext|>", "Σ", "　", "​", "\x0b", "don't", "日本", "😀", ",", ".", "the", "ing", "<|", "é"]
DOC = "doc_id long, text string, ids string, length int"


def texts(n, seed=0):
    rng = random.Random(seed)
    return ["".join(rng.choice(SYLLABLES) for _ in range(rng.randint(0, 14))) for _ in range(n)]


def test_encoder_equals_library(monkeypatch):
    t, e = Tokenizer.from_file(BYTE), Encoder(BYTE)
    some = texts(5000)
    want = [t.encode(x, add_special_tokens=False).ids for x in some]
    for x, ids in zip(some[:1000], want, strict=False):
        assert ids == e.encode(x).tolist(), repr(x)
    got = [ids.tolist() for _, all_ids, starts in e.documents(pa.array(some), 0) for ids in np.split(all_ids, starts[1:-1])]
    assert got == [[*x, 0] for x in want]
    words = ["".join(random.Random(i).choices("abcdefgh.,é", k=9)) for i in range(3000)]
    run = [" ".join(random.Random(i).choices(words, k=200)) for i in range(60)] + [None, "", "\0", "a\0 b", "\0a b", "x\n\ny"]
    monkeypatch.setattr(encoding, "CACHE_BYTES", 100_000)  # most pieces are met again and again
    monkeypatch.setattr(encoding, "RUN_BYTES", 5000)
    got = [ids.tolist() for _, all_ids, starts in Encoder(BYTE).documents(pa.array(run), 0) for ids in np.split(all_ids, starts[1:-1])]
    assert got == [[*t.encode(x or "", add_special_tokens=False).ids, 0] for x in run]


def test_counts_equal_library():
    t, c = Tokenizer.from_file(WORD), token_counts.PrefixCounter(WORD)
    for x in texts(3000, 1):
        assert len(t.encode(x, add_special_tokens=False).ids) == c.counts(x)[-1], repr(x)


def test_every_prefix_equals_library():
    t, c = Tokenizer.from_file(WORD), token_counts.PrefixCounter(WORD)
    rng = random.Random(2)
    for _ in range(300):
        x = "".join(rng.choice("abcdehilmnoprstuwy .,'12!") for _ in range(30))
        x = t.normalizer.normalize_str(x)
        got = c.counts(x).tolist()
        assert got == [len(t.encode(x[:i], add_special_tokens=False).ids) for i in range(len(x) + 1)], repr(x)


@pytest.mark.parametrize("n", [16_000, 20_000, 22_000, 40_000, 70_000])
@pytest.mark.parametrize("first, many", [(0x4E00, 20_000), (0x20000, 40_000)])
def test_long_runs_without_blanks_equal_library(n, first, many):
    t, c = Tokenizer.from_file(WORD), token_counts.PrefixCounter(WORD)
    rng = random.Random(n)
    run = "".join(chr(first + rng.randrange(many)) for _ in range(n))
    for x in (run, f"before {run} after"):
        got = c.counts(x)
        assert got[-1] == len(t.encode(x, add_special_tokens=False).ids) and len(got) == len(c.normalised(x)) + 1


def test_prefix_table(spark):
    rows = [(1, "the quick brown fox"), (2, None), (3, ""), (3, ""), (None, "x " * 5000)]
    tables = token_counts.prefix_counts(spark.createDataFrame([(*r, "z", 1) for r in rows], DOC), WORD)
    got = token_counts.answers(tables).collect()
    assert sorted((r["doc_id"] or -1, r["n_tokens"], r["n_bytes"], r["over_limit"], r["within_limit"]) for r in got) == [(-1, 5000, 10000, True, 4096), (1, 4, 19, False, 19), (2, 0, 0, False, 0), (3, 0, 0, False, 0), (3, 0, 0, False, 0)]
    prefix = tables.where("doc_id = 1").first()["prefix"]
    assert [token_counts.tokens_at(prefix, n) for n in (0, 3, 4, 9, 99)] == [0, 1, 1, 2, 4]
    assert token_counts.longest_within(prefix, 2) == 10 and token_counts.longest_within(prefix, 0) == 0
    assert token_counts.answers(token_counts.prefix_counts(spark.createDataFrame([], DOC), WORD)).count() == 0


@pytest.mark.parametrize("steps", [[0, 1, 1, -1], [0, 300, -2], [0, 70_000, 1], [0]])
def test_stored_table_round_trip(steps):
    counts = np.cumsum(steps)
    assert token_counts.table_of(token_counts.packed_table(counts)).tolist() == counts.tolist()


def test_long_rare_text_in_the_query(spark, tmp_path):
    rows = [(1, "\U00013080" * 30_000), (2, "日本" * 20_000 + " x")]
    got = dict(queries.op5_token_counts(spark, small(spark, tmp_path, rows)).select("doc_id", "n_tokens").collect())
    t = Tokenizer.from_file(WORD)
    assert got == {i: len(t.encode(x, add_special_tokens=False).ids) for i, x in rows}


def small(spark, tmp_path, rows):
    spark.createDataFrame([(*r, "z", 1) for r in rows], DOC).write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def library_ids(rows):
    t = Tokenizer.from_file(BYTE)
    return [np.array([*t.encode(x or "", add_special_tokens=False).ids, 0], "<u4") for _, x in rows]


@pytest.mark.parametrize("counts", [{}, {5: 1}, {1: 3000}, {512: 2, 513: 2}, {300: 7, 400: 9, 700: 4, 1023: 2}, {n: n % 7 + 1 for n in range(1, 1024)}])
def test_solver_holds_the_demand(counts):
    plan = packing.solve(dict(counts))
    got = Counter()
    for p, times in plan:
        assert sum(n * k for n, k in p) <= 1024
        for n, k in p:
            got[n] += k * times
    assert got == Counter(counts)
    best = -(-sum(n * c for n, c in counts.items()) // 1024)
    assert sum(t for _, t in plan) <= max(best * 1.05 + 2, sum(c for n, c in counts.items() if n > 512) + 2)


@pytest.mark.parametrize(("counts", "fewer"), [({600: 1000}, True), ({260: 1000, 390: 1000, 520: 1000}, True), ({513: 600, 258: 600, 257: 600, 254: 1200}, True), ({n: n % 7 + 1 for n in range(1, 1024)}, False)])
def test_plan_leaves_little_padding(counts, fewer):
    made = packing.plan(dict(counts), 0)
    total = sum(n * c for n, c in counts.items())
    assert 1 - total / 1024 / made.sequences < 0.02
    if fewer:
        assert made.sequences < sum(t for _, t in packing.fill(dict(counts), 1024))


def lengths_of(kind):
    """Histograms with more lengths than patterns repeat: log-normal remainders, and those of the given documents (four ids to ten characters)."""
    if kind == "log-normal":
        return Counter((np.random.default_rng(0).lognormal(5.5, 0.9, 200_000).astype(int) % 1023 + 1).tolist())
    import pyarrow.parquet as pq

    sizes = pq.read_table("/root/testdata/sf0.1/documents.parquet", columns=["n_chars"])["n_chars"].to_numpy() * 4 // 10
    return Counter((sizes % 1023 + 1).tolist())


@pytest.mark.parametrize("kind", ["log-normal", "documents"])
def test_program_is_never_worse_than_its_start(kind):
    counts = dict(lengths_of(kind))
    bound = sum(n * c for n, c in counts.items()) / 1024
    assert len(counts) > 900
    solved, greedy = (sum(t for _, t in x) for x in (packing.solve(counts), packing.fill(counts, 1024)))
    made = packing.plan(counts, 0)
    assert solved <= greedy and made.sequences <= bound * 1.001 + 1
    cut = sum(c - made.kept[n] for n, c in counts.items())
    assert cut < 0.01 * sum(counts.values())


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
def test_program_of_few_documents_a_length_ends(folder):
    """Demands of one to a few documents make the ratios tie; columns could go round without end."""
    import pyarrow.parquet as pq

    rounds, knapsack = [0], packing.knapsack

    def counted(*args):
        rounds[0] += 1
        assert rounds[0] < 1000
        return knapsack(*args)

    sizes = pq.read_table(f"/root/testdata/{folder}/documents.parquet", columns=["n_chars"])["n_chars"].to_numpy() * 4 // 10
    counts = dict(Counter((sizes % 1023 + 1).tolist()))
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(packing, "knapsack", counted)
        made = packing.plan(counts, 0)
    assert made.sequences <= sum(t for _, t in packing.fill(counts, 1024))
    assert sum(made.kept.values()) >= 0.9 * len(sizes)


def test_caches_are_bounded_by_bytes():
    """Long runs without blanks, of three bytes a character, fill no more than their room; ids and counts stay right."""
    import tracemalloc

    text = " ".join(chr(0x4E00 + i % 5000) * (300 + i % 200) for i in range(3000))
    for made, encode in ((encoding.Encoder(BYTE), lambda m, t: m.encode(t)), (token_counts.PrefixCounter(WORD), lambda m, t: m.counts(t))):
        made.room = 2_000_000
        tracemalloc.start()
        for at in range(0, len(text), 100_000):
            encode(made, text[at : at + 100_000])
        held = tracemalloc.get_traced_memory()[0]
        tracemalloc.stop()
        assert made.room <= 0 and held < 20_000_000
    t = Tokenizer.from_file(WORD)
    assert token_counts.PrefixCounter(WORD).counts(text[:5000])[-1] == len(t.encode(text[:5000], add_special_tokens=False).ids)


def test_program_spares_documents_from_the_cut():
    counts = {513: 600, 258: 600, 257: 600, 254: 1200}
    assert sum(t for _, t in packing.fill(dict(counts), 1024)) == 1100
    made = packing.plan(dict(counts), 0)
    assert made.sequences == 900 and {n: made.kept[n] for n in counts} == counts


def test_knapsack_against_enumeration():
    lengths, values = np.array([3, 5, 7]), np.array([0.2, 0.45, 0.6])
    value, pattern = packing.knapsack(values, lengths, 16)
    every = [a * 0.2 + b * 0.45 + c * 0.6 for a in range(6) for b in range(4) for c in range(3) if 3 * a + 5 * b + 7 * c <= 16]
    assert abs(value - max(every)) < 1e-9 and sum(lengths[i] * k for i, k in pattern) <= 16


def check_packing(got, rows, ids):
    """Pieces make up all documents, once; their checksums are right; sequences have no overlap and little padding."""
    assert got["length"].sum() == sum(map(len, ids))
    known = {}
    for (d, _), x in zip(rows, ids, strict=True):
        known.setdefault(-1 if d is None else d, []).append(x)
    starts = Counter()
    for r in got.itertuples():
        d = -1 if r.doc_id != r.doc_id else int(r.doc_id)
        assert any(len(x) == r.doc_tokens and zlib.crc32(x[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for x in known[d])
        starts[d, r.doc_tokens] += r.length
    want = Counter()
    for (d, _), x in zip(rows, ids, strict=True):
        want[-1 if d is None else d, len(x)] += len(x)
    assert starts == want
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert (g.offset == g.length.cumsum() - g.length).all() and g.length.sum() <= 1024
    assert 1 - got.length.sum() / 1024 / got.sequence_id.nunique() < 0.05


def test_packing(spark, tmp_path):
    rng = random.Random(7)
    rows = [(i, " ".join(rng.choice(["the", "word", "thing,", "é"]) for _ in range(rng.randint(0, 900)))) for i in range(120)]
    rows += [(500, None), (501, ""), (502, "w " * 5000), (3, "twice"), (3, "twice"), (None, "no id")]
    ids = library_ids(rows)
    check_packing(queries.op6_packing(spark, small(spark, tmp_path, rows)).toPandas(), rows, ids)
    same = [(i, "the " * 599) for i in range(300)] + [(None, "the " * 599)] * 20 + [(7, "the " * 599)] * 3
    check_packing(packing.pack(spark.createDataFrame([(*r, "z", 1) for r in same], DOC), BYTE, with_ids=False).toPandas(), same, library_ids(same))
    full = packing.pack(spark.read.parquet(f"{tmp_path}/documents.parquet"), BYTE).where("doc_id = 502").orderBy("start").collect()
    assert b"".join(bytes(r["ids"]) for r in full) == library_ids([(502, "w " * 5000)])[0].tobytes()
    empty = spark.createDataFrame([], DOC)
    assert packing.pack(empty, BYTE).count() == 0
    whole = packing.pack(spark.createDataFrame([(*r, "z", 1) for r in rows], DOC), BYTE).toPandas()
    assert all(zlib.crc32(bytes(r.ids)) == r.ids_crc32 and len(r.ids) == 4 * r.length for r in whole.itertuples())


def test_token_files(spark, tmp_path):
    rows = [(i * 3, x) for i, x in enumerate(texts(200, 3))] + [(1000, None), (1001, "w " * 3000), (6, "again"), (None, "no id"), (None, None), (None, "no id")]
    got = [tuple(r) for r in queries.op8_token_files(spark, small(spark, tmp_path, rows)).select("doc_id", "start", "n_tokens", "ids_crc32").collect()]
    got.sort(key=lambda r: r[1])
    ids = library_ids(rows)
    assert [r[0] for r in got] == sorted((d for d, _ in rows if d is not None)) + [None] * 3
    assert [r[1] for r in got] == np.cumsum([0, *(r[2] for r in got)])[:-1].tolist()
    assert Counter((r[0], r[2], r[3]) for r in got) == Counter((d, len(x), zlib.crc32(x.tobytes())) for (d, _), x in zip(rows, ids, strict=True))


def test_store_names():
    with pytest.raises(ValueError, match="dbfs"):
        token_files.Store("dbfs:/tokens")


def test_reader_takes_only_wanted_frames(spark, tmp_path, monkeypatch):
    rows = [(i, f"text number {i} " * 20) for i in range(60)]
    df = spark.createDataFrame([(*r, "z", 1) for r in rows], DOC)
    folder = f"file://{tmp_path}/t"
    manifest = token_files.write_token_files(df, BYTE, folder, frame_bytes=400)
    ids = dict(zip([d for d, _ in rows], library_ids(rows), strict=True))
    got = token_files.read_token_files(manifest, folder, [3, 41, 77]).collect()
    assert sorted(r["doc_id"] for r in got) == [3, 41]
    assert all(bytes(r["ids"]) == ids[r["doc_id"]].tobytes() and r["start"] == sum(len(ids[i]) for i in range(r["doc_id"])) for r in got)
    store = token_files.Store(folder)
    name = manifest.orderBy("shard").first()["file"]
    with store.read(name) as f:
        reader = token_files.Reader(f)
        assert len(reader.frames) > 3
        seen = []
        frame = reader.frame
        monkeypatch.setattr(reader, "frame", lambda k: seen.append(k) or frame(k))
        first = int(reader.index[0, 0])
        assert [d for _, d, _ in reader.documents(frozenset([first]))] == [first] and seen == [0]
    path = tmp_path / "t" / name
    raw = bytearray(path.read_bytes())
    raw[12] ^= 0xFF
    path.write_bytes(bytes(raw))
    with store.read(name) as f, pytest.raises(Exception):  # noqa: B017, PT011
        list(token_files.Reader(f).documents())
    assert token_files.write_token_files(df.limit(0), BYTE, f"file://{tmp_path}/e").count() == 0


def test_files_are_plain_zstandard(spark, tmp_path):
    import zstandard

    df = spark.createDataFrame([(1, "plain words", "z", 1)], DOC)
    manifest = token_files.write_token_files(df, BYTE, f"file://{tmp_path}/t")
    with open(tmp_path / "t" / manifest.first()["file"], "rb") as f:
        raw = zstandard.ZstdDecompressor().stream_reader(f, read_across_frames=True).read()
    assert np.frombuffer(raw, "<u2").tolist() == library_ids([(1, "plain words")])[0].tolist()
