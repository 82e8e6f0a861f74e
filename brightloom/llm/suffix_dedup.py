"""Exact removal of repeated byte strings by a sorted array of sampled suffixes.

Every string of ``LENGTH`` bytes (a window) holds one position that its bytes alone
choose: where the hash of the next ``LEAD`` bytes is least, the first of equals.
Windows in a row that choose the same position make a run, and only chosen
positions enter the suffix array, about one in 18. Equal windows choose equal positions, so
windows can only be alike where their suffixes begin with the same ``LEAD`` bytes.

Splitters drawn from a sample range-partition the suffixes by their leading bytes, the hash of their whole run and
the document, so that even copies of one passage spread. A bucket sorts its suffixes by
multikey quicksort, eight bytes at a time, and looks at groups of one beginning. The groups at its
two ends may go on in the next bucket; those are compared across all buckets at once.

Where all runs of a group are alike, and for copies of a run in general, the first document keeps
it and the others lose it. Only where one beginning has different runs are the windows
of the first copy of each run compared one by one, by 128 bits of hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import joined, materialize, partitions

LENGTH, LEAD = 50, 16
#: Bytes of a text whose windows are looked at together; bytes of texts whose suffixes are dealt out together.
SLICE, TOGETHER = 1 << 20, 1 << 22
#: Bytes of texts whose suffixes make a bucket.
BUCKET = 1 << 23
#: Suffixes for each bucket, and for each sampled text, in the sample that gives the splitters.
SAMPLE, SAMPLE_TEXT = 32, 32
FIELDS = ["hi", "lo", "run", "doc", "twin", "at"]
TYPES = [np.uint64, np.uint64, np.uint64, np.int64, np.int32, np.int64]


def _words(text: np.ndarray, n: int, at: int) -> np.ndarray:
    """The eight bytes from each of n places on as an integer that sorts as they do; ``text`` has eight spare bytes."""
    return np.ndarray((n,), ">u8", text, at, (1,)).astype(np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def runs(text: bytes, length: int = LENGTH, lead: int = LEAD) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first window, number of windows, hi, lo, hash) of each run of windows: leading bytes of its suffix in two words, and hash of all its bytes."""
    import xxhash

    assert lead == 16 < length <= 64, "two words lead a suffix, and a run's windows are counted in six bits"
    found: list[tuple[np.ndarray, ...]] = []
    for s in range(0, max(0, len(text) - length + 1), SLICE):
        part = text[s : s + SLICE + length - 1]
        raw = np.frombuffer(part + bytes(8), np.uint8)
        n = len(part) - lead + 1
        hi, lo = _words(raw, n, 0), _words(raw, n, 8)
        best = (_mixed(hi + _mixed(lo)) & np.uint64(0xFFFFFFFF00000000)) | np.arange(n, dtype=np.uint64)
        width, step = length - lead + 1, 1
        while step * 2 <= width:
            best = np.minimum(best[:-step], best[step:])
            step *= 2
        if width > step:
            best = np.minimum(best[: len(best) - (width - step)], best[width - step :])
        chosen = (best & np.uint64(0xFFFFFFFF)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], chosen[1:] != chosen[:-1]]))
        number = np.diff(np.append(first, len(chosen)))
        digest = xxhash.xxh3_64_intdigest
        whole = np.array([digest(part[a:e]) for a, e in zip(first.tolist(), (first + number + length - 1).tolist(), strict=True)], np.uint64)
        found.append((first + s, number, hi[chosen[first]], lo[chosen[first]], whole))
    if not found:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.uint64, np.uint64, np.uint64))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _suffixes(b: pa.RecordBatch, rows: np.ndarray, spaced: int = 0) -> dict[str, np.ndarray]:
    """Suffixes of some rows of ``doc, twin, text``; ``spaced``: that many of each text at most."""
    out: list[list[np.ndarray]] = []
    for i in rows.tolist():
        first, number, hi, lo, whole = runs(b.column("text")[i].as_py())
        pick = np.arange(len(first))[:: max(1, -(-len(first) // spaced))] if spaced else slice(None)
        first, number, hi, lo, whole = (x[pick] for x in (first, number, hi, lo, whole))
        doc, twin = (np.full(len(first), b.column(c)[i].as_py(), t) for c, t in (("doc", np.int64), ("twin", np.int32)))
        out.append([hi, lo, whole, doc, twin, first * 64 + number])
    return {f: np.concatenate([x[k] for x in out]) if out else np.zeros(0, t) for k, (f, t) in enumerate(zip(FIELDS, TYPES, strict=True))}


def _key(x: dict[str, np.ndarray]) -> np.ndarray:
    """Order of suffixes as fixed strings: leading bytes, run, document."""
    doc = x["doc"].astype(np.uint64) ^ np.uint64(1 << 63)
    return np.stack([x["hi"], x["lo"], x["run"], doc], 1).astype(">u8").view("V32").ravel()


def splitters(sample: dict[str, np.ndarray], buckets: int) -> dict[str, np.ndarray]:
    order = multikey([sample[f] for f in ("hi", "lo", "run", "doc")])
    at = order[(np.arange(1, buckets) * len(order)) // buckets] if len(order) else order
    return {f: sample[f][at] for f in ("hi", "lo", "run", "doc")}


def bucket_of(x: dict[str, np.ndarray], split: dict[str, np.ndarray]) -> np.ndarray:
    """Number of splitters that are not above each suffix."""
    low, high = np.searchsorted(split["hi"], x["hi"], "left"), np.searchsorted(split["hi"], x["hi"], "right")
    near = np.flatnonzero(low < high)
    if len(near):  # a splitter begins with the same word: the whole order decides
        own = _key({f: x[f][near] for f in ("hi", "lo", "run", "doc")}).tolist()
        all_ = _key(split).tolist()
        import bisect

        low[near] = [bisect.bisect_right(all_, k, a, b) for k, a, b in zip(own, low[near].tolist(), high[near].tolist(), strict=True)]
    return low


def multikey(words: list[np.ndarray]) -> np.ndarray:
    """Order of rows by their words: quicksort by the first one, then equals by the next."""
    order = np.argsort(words[0])
    tied = np.zeros(len(order), bool)  # with the one before
    for k, w in enumerate(words):
        if k:
            group = np.cumsum(~tied)
            inside = tied | np.append(tied[1:], False)
            at = np.flatnonzero(inside)
            if not len(at):
                break
            order[at] = order[at][np.lexsort((w[order[at]], group[at]))]
        now = w[order]
        same = np.append(False, now[1:] == now[:-1])
        tied = same if not k else tied & same
    return order


def judged(x: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """What a sorted bucket tells: ``kind`` 0 is lost, 1 is to be compared window by window, 2 lies at an end of the bucket."""
    order = multikey([x[f] for f in ("hi", "lo", "run", "doc")])
    x = {f: v[order] for f, v in x.items()}
    if not len(order):
        return x | {"kind": np.zeros(0, np.int8)}
    lead = np.append(True, (x["hi"][1:] != x["hi"][:-1]) | (x["lo"][1:] != x["lo"][:-1]))
    run = lead | np.append(True, x["run"][1:] != x["run"][:-1])
    leads, own = np.flatnonzero(lead), np.cumsum(lead) - 1
    shared = np.minimum.reduceat(x["doc"], leads) < np.maximum.reduceat(x["doc"], leads)
    several = np.add.reduceat(run.astype(np.int64), leads) > 1
    first = x["doc"][np.flatnonzero(run)][np.cumsum(run) - 1]  # documents of a run are sorted
    kind = np.full(len(order), -1, np.int8)
    kind[shared[own] & several[own] & (x["doc"] == first)] = 1
    kind[x["doc"] > first] = 0
    # At the ends only the first copies of a run matter to other buckets.
    kind[((own == 0) | (own == own[-1])) & (x["doc"] == first)] = 2
    keep = kind >= 0
    return {f: v[keep] for f, v in x.items()} | {"kind": kind[keep]}


def flagged(texts: list[bytes], first: np.ndarray, number: np.ndarray, doc: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(row, window) of every window that a row with a smaller ``doc`` has too; row i has windows first[i], ... at the front of texts[i]."""
    import xxhash

    digest = xxhash.xxh3_128_digest
    row = np.repeat(np.arange(len(texts)), number)
    at = np.arange(len(row)) - np.repeat(np.cumsum(number) - number, number)
    h = np.frombuffer(b"".join([digest(texts[i][p : p + length]) for i, p in zip(row.tolist(), at.tolist(), strict=True)]), np.uint64).reshape(-1, 2)
    order = multikey([h[:, 0], h[:, 1], doc[row]])
    new = np.append(True, (h[order][1:] != h[order][:-1]).any(1)) if len(order) else np.zeros(0, bool)
    least = doc[row[order]][np.flatnonzero(new)][np.cumsum(new) - 1] if len(order) else doc[:0]
    lost = np.sort(order[doc[row[order]] > least])
    return row[lost], first[row[lost]] + at[lost]


def _array(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x)


def _packed(x: dict[str, np.ndarray]) -> bytes:
    batch = pa.RecordBatch.from_arrays([_array(x[f]) for f in FIELDS], FIELDS)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpacked(blobs: list[bytes]) -> dict[str, np.ndarray]:
    t = pa.concat_tables([pa.ipc.open_stream(x).read_all() for x in blobs])
    cols = {f: t.column(f).to_numpy() for f in FIELDS}
    return {f: cols[f].view(np.uint64) if k < 3 else cols[f] for k, f in enumerate(FIELDS)}


def suffix_array(texts: DataFrame, buckets: int) -> DataFrame:
    """``kind, hi, lo, run, doc, twin, at`` of ``texts(doc, twin, text)``: what each of ``buckets`` sorted buckets tells."""
    rows = texts.count()
    step = max(1, rows * SAMPLE_TEXT // (SAMPLE * buckets))

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _suffixes(b, np.arange(b.num_rows), SAMPLE_TEXT)
            yield pa.RecordBatch.from_arrays([_array(x[f]) for f in ("hi", "lo", "run", "doc")], ["hi", "lo", "run", "doc"])

    drawn = texts.where(F.pmod(F.xxhash64("doc", "twin"), F.lit(step)) == 0).mapInArrow(sampled, "hi long, lo long, run long, doc long").toArrow()
    sample = {f: drawn.column(f).to_numpy() for f in ("hi", "lo", "run", "doc")}
    split = splitters({f: x if f == "doc" else x.view(np.uint64) for f, x in sample.items()}, buckets)  # about SAMPLE rows a bucket were drawn

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = np.cumsum(np.array(pc.binary_length(b.column("text"))))
            for rows in np.split(np.arange(b.num_rows), np.flatnonzero(np.diff(sizes // TOGETHER)) + 1):
                x = _suffixes(b, rows)
                own = bucket_of(x, split)
                order = np.argsort(own, kind="stable")
                x, own = {f: v[order] for f, v in x.items()}, own[order]
                cuts = np.append(np.flatnonzero(np.append(True, own[1:] != own[:-1])), len(own)) if len(own) else [0]
                blobs = [_packed({f: v[s:e] for f, v in x.items()}) for s, e in zip(cuts[:-1], cuts[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(own[cuts[:-1]].astype(np.int32)), pa.array(blobs, pa.binary())], ["bucket", "suffixes"])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs = [x.as_py() for b in batches for x in b.column("suffixes")]
        if blobs:
            x = judged(_unpacked(blobs))
            for s in range(0, len(x["kind"]), 1 << 16):
                x_ = {f: v[s : s + (1 << 16)] for f, v in x.items()}
                # What is lost needs no beginning any more, and only ends of buckets need their run.
                cols = [pa.array(x_[f].view(np.int64), mask=x_["kind"] < (1 if f != "run" else 2)) if f in ("hi", "lo", "run") else pa.array(x_[f]) for f in ("kind", *FIELDS)]
                yield pa.RecordBatch.from_arrays(cols, ["kind", *FIELDS])

    dealt = texts.mapInArrow(deal, "bucket int, suffixes binary").repartitionById(buckets, F.col("bucket"))
    return dealt.mapInArrow(judge, "kind byte, hi long, lo long, run long, doc long, twin int, at long")


def _across(ends: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``doc, twin, at`` of the suffixes at the ends of buckets that are lost, and with ``hi, lo`` of those to be compared window by window."""
    ends = ends.withColumn("k", F.struct("hi", "lo", "run"))
    runs_ = ends.groupBy("k", "hi", "lo").agg(F.min("doc").alias("first"), F.max("doc").alias("last"), F.count("*").alias("n"))
    runs_ = materialize(runs_, "end-runs")
    leads = runs_.groupBy("hi", "lo").agg(((F.count("*") > 1) & (F.min("first") < F.max("last"))).alias("differ"))
    met = joined(ends.select("k", "doc", "twin", "at"), materialize(runs_.join(leads, ["hi", "lo"]).select("k", "first", "differ", "n"), "end-firsts"), "k")
    return met.where("doc > first").select("doc", "twin", "at"), met.where("doc = first and differ").select("doc", "twin", "at", "k.hi", "k.lo")


def _squeezed(texts: DataFrame) -> DataFrame:
    """``texts(doc, twin, text)`` with compressed texts, as they move."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        press = zstandard.ZstdCompressor(3)
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([press.compress(x.as_py()) for x in b.column("text")], pa.binary())], b.schema.names)

    return texts.select("doc", "twin", "text").mapInArrow(run, "doc long, twin int, text binary")


def _contexts(squeezed: DataFrame, unlike: DataFrame) -> DataFrame:
    """``hi, lo, doc, twin, at, part``: the bytes of each run of ``unlike(doc, twin, at, hi, lo)``."""
    per = unlike.groupBy("doc", "twin").agg(F.collect_list(F.struct("hi", "lo", "at")).alias("ats"))  # no longer than the text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        open_ = zstandard.ZstdDecompressor()
        for whole in batches:
            for s in range(0, whole.num_rows, 256):
                b = whole.slice(s, 256)
                places = b.column("ats").flatten()
                row = pc.list_parent_indices(b.column("ats"))
                at, parts = places.field("at").to_numpy(), []
                cuts = np.searchsorted(row.to_numpy(), np.arange(b.num_rows + 1)).tolist()
                for i, text in enumerate(b.column("text")):
                    text, own = open_.decompress(text.as_py()), at[cuts[i] : cuts[i + 1]]
                    parts += [text[a : a + n + LENGTH - 1] for a, n in zip((own // 64).tolist(), (own % 64).tolist(), strict=True)]
                cols = [places.field("hi"), places.field("lo"), b.column("doc").take(row), b.column("twin").take(row), pa.array(at), pa.array(parts, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, ["hi", "lo", "doc", "twin", "at", "part"])

    rows = squeezed.join(per, ["doc", "twin"]).select("doc", "twin", "text", "ats")
    return rows.mapInArrow(run, "hi long, lo long, doc long, twin int, at long, part binary")


def _compared(contexts: DataFrame, unlike: DataFrame, hold: int = 1 << 14) -> DataFrame:
    """``doc, twin, at`` of the windows of ``contexts`` that a smaller document has too.

    Runs of one beginning meet in one task, unless they are more than a quarter of a task's share of all runs: their
    windows are dealt out and meet by their hashes.
    """
    per = materialize(unlike.groupBy("hi", "lo").agg(F.count("*").alias("n")), "unlike-leads")
    tasks = partitions(contexts)
    limit = (per.agg(F.sum("n")).first()[0] or 0) // (4 * tasks) + 1
    hubs = F.broadcast(per.where(F.col("n") > limit).select("hi", "lo", F.lit(True).alias("hot")))  # at most 4 rows for each task
    # Both ways below read this one shuffle, and tell their rows apart themselves.
    rows = contexts.join(hubs, ["hi", "lo"], "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    rows = rows.withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("doc", "at"), F.lit(tasks))).otherwise(0))
    dealt = rows.repartition(tasks, "hi", "lo", "salt")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(t: pa.Table) -> pa.RecordBatch:
            at = t.column("at").to_numpy()
            row, window = flagged(t.column("part").to_pylist(), at // 64, at % 64, t.column("doc").to_numpy())
            return pa.RecordBatch.from_arrays([pa.array(t.column(c).to_numpy()[row]) for c in ("doc", "twin")] + [pa.array(window * 64 + 1)], ["doc", "twin", "at"])

        held: pa.Table | None = None
        for b in batches:
            t = pa.Table.from_batches([b.filter(pc.invert(b.column("hot")))])
            if not t.num_rows:
                continue
            held = t if held is None else pa.concat_tables([held, t])
            if held.num_rows >= hold:
                hi, lo = held.column("hi").to_numpy(), held.column("lo").to_numpy()
                last = np.flatnonzero((hi != hi[-1]) | (lo != lo[-1]))
                cut = int(last[-1]) + 1 if len(last) else 0  # the last beginning may go on
                if cut:
                    yield done(held.slice(0, cut))
                    held = held.slice(cut)
        if held is not None and held.num_rows:
            yield done(held)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        digest = xxhash.xxh3_128_digest
        for whole in (b.filter(b.column("hot")) for b in batches):
            for s in range(0, whole.num_rows, 4096):
                b = whole.slice(s, 4096)
                first, number = b.column("at").to_numpy() // 64, b.column("at").to_numpy() % 64
                row = np.repeat(np.arange(b.num_rows), number)
                at = np.arange(len(row)) - np.repeat(np.cumsum(number) - number, number)
                texts = b.column("part").to_pylist()
                h = np.frombuffer(b"".join([digest(texts[i][p : p + LENGTH]) for i, p in zip(row.tolist(), at.tolist(), strict=True)]), np.int64).reshape(-1, 2)
                own = [b.column(c).take(pa.array(row)) for c in ("doc", "twin")]
                yield pa.RecordBatch.from_arrays([pa.array(h[:, 0]), pa.array(h[:, 1]), *own, pa.array((first[row] + at) * 64 + 1)], ["a", "b", "doc", "twin", "at"])

    hot = dealt.mapInArrow(windows, "a long, b long, doc long, twin int, at long")
    per_window = hot.groupBy("a", "b").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first < last").drop("last")
    lost = hot.join(per_window, ["a", "b"]).where("doc > first").select("doc", "twin", "at")  # many rows of one window: split by the runtime
    return dealt.sortWithinPartitions("hi", "lo").mapInArrow(run, "doc long, twin int, at long").unionByName(lost)


def kept_parts(n: int, ats: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Starts and ends of the maximal removed runs of a text of n bytes, as rows."""
    first, number = ats // 64, ats % 64
    order = np.argsort(first)
    start, end = first[order], np.maximum.accumulate((first + number + length - 1)[order]) if len(ats) else first
    new = np.flatnonzero(np.append(True, start[1:] > end[:-1])) if len(ats) else np.zeros(0, np.int64)
    return np.stack([start[new], np.append(end[new[1:] - 1], end[-1:])[: len(new)]], 1)


def _cut(rows: DataFrame, with_text: bool, squeezed: bool = True) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        open_ = zstandard.ZstdDecompressor()
        for b in batches:
            out = []
            for doc, text, ats in zip(*(b.column(c) for c in ("doc", "text", "ats")), strict=True):
                text = open_.decompress(text.as_py()) if squeezed else text.as_py()
                gone = kept_parts(len(text), ats.values.to_numpy() if ats.is_valid else np.zeros(0, np.int64))
                edges = [0, *gone.ravel().tolist(), len(text)]
                kept = b"".join([text[s:e] for s, e in zip(edges[::2], edges[1::2], strict=True)])
                out.append((doc.as_py(), len(text), int((gone[:, 1] - gone[:, 0]).sum()), len(gone), hashlib.sha256(kept).hexdigest(), kept if with_text else None))
            kinds = [pa.int64()] * 4 + [pa.string(), pa.binary()]
            cols = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)] if out else [pa.array([], t) for t in kinds]
            yield pa.RecordBatch.from_arrays(cols[: 5 + with_text], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: 5 + with_text])

    ddl = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text
    return rows.select("doc", "text", "ats").mapInArrow(run, ddl)


def without_repeats(docs: DataFrame, with_text: bool = False, bucket: int = BUCKET) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of each row of ``docs(doc_id, text)``, ``with_text`` also the bytes ``kept``.

    Of a text's UTF-8 bytes all go that lie in a string of 50 bytes which also starts in a row with a
    smaller doc_id. Rows with one doc_id take nothing from each other; a row without an id is in no order with
    the others, so it loses nothing and takes nothing. Null texts are empty. Rows that repeat come out as often.
    Kept bytes may cut a character. Other columns are ignored; an empty table gives no rows.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc"), F.shiftright(F.xxhash64(text), 32).cast("int").alias("twin"), text.cast("binary").alias("text"))
    size, least = partitions(docs), bucket * partitions(docs)
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    named = rows.where("doc is not null")
    found = materialize(suffix_array(named.where(F.octet_length("text") >= LENGTH), size * -(-max(1, total) // least)), "suffixes")
    lost, unlike = _across(found.where("kind = 2"))
    unlike = found.where("kind = 1").select("doc", "twin", "at", "hi", "lo").unionByName(unlike)
    # Both joins read one shuffle of the texts: they see the same rows.
    squeezed = _squeezed(named).where("doc is not null and twin is not null")
    also = _compared(_contexts(squeezed, unlike), unlike)
    gone = found.where("kind = 0").select("doc", "twin", "at").unionByName(lost).unionByName(also)
    per = gone.groupBy("doc", "twin").agg(F.collect_list("at").alias("ats"))  # no longer than the text
    nameless = rows.where("doc is null").withColumn("ats", F.lit(None).cast("array<long>"))
    return _cut(squeezed.join(per, ["doc", "twin"], "left"), with_text).unionByName(_cut(nameless, with_text, squeezed=False))
