"""SimHash near-duplicates by anchor points of a covering code.

A pair of 64-bit fingerprints that differ in at most ``MAX_BITS`` = 4 bits
differs in at most one bit in one of the three blocks of 21, 21 and 22 bits. In
each block the anchors are a covering code: the Hamming (15, 11) code on the low
15 bits times all words on the others. It is perfect, so every word is within
covering radius 1 of its home anchor, and a word that differs from it in one bit
is within radius plus threshold, 2, of that anchor. So each fingerprint goes to
every anchor within 2 (about 14.5 a block), and at an anchor only the words that
call it home are held against all others, by their whole 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import connected_components, joined, materialize, partitions

SHINGLE = 4
SEED = 42
MAX_BITS = 4
#: Low bit and width of each block.
BLOCKS = ((0, 21), (21, 21), (42, 22))
#: Bits of a block under the Hamming code; the others are free.
HAMMING = 15
#: Members of an anchor that one task compares at once; a larger anchor is dealt out in pairs of parts.
PART = 4096


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """64-bit SimHash of the word shingles of a text, repeats counted; no words: 0."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - shingle + 1].tolist()
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], seed) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)], np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 65536):  # a long text takes no more memory than a short one
        ones += np.unpackbits(hashes[i : i + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, fp`` (the fingerprint as a signed long) of each row; null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(x.as_py()) for x in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps)], ["doc_id", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long")


def _masks() -> list[np.ndarray]:
    """For each width of block and syndrome, the differences to the anchors within 2; the home anchor first."""
    found = []
    for _, width in BLOCKS:
        free = [1 << b for b in range(HAMMING, width)]
        pairs = [x | y for i, x in enumerate(free) for y in free[:i]]
        by = [[0, *free, *pairs]]
        for s in range(1, HAMMING + 1):
            one = 1 << (s - 1)  # column i of the check matrix is i + 1 in binary
            two = [1 << (i - 1) | 1 << ((i ^ s) - 1) for i in range(1, HAMMING + 1) if i < i ^ s]
            by.append([one, *[one | x for x in free], *two])
        found.append([np.array(x, np.int64) for x in by])
    return found


def _syndromes() -> np.ndarray:
    table = np.zeros(1 << HAMMING, np.uint8)
    for b in range(HAMMING):
        table[1 << b : 2 << b] = table[: 1 << b] ^ (b + 1)
    return table


def anchors(fps: DataFrame) -> DataFrame:
    """``anchor, fp, home`` for each anchor within covering radius plus threshold of a fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks, table = _masks(), _syndromes()
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                fp = whole.column(0).slice(at, 4096).to_numpy(zero_copy_only=False)
                out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
                for k, (low, width) in enumerate(BLOCKS):
                    word = (fp >> low) & ((1 << width) - 1)
                    syndrome = table[word & ((1 << HAMMING) - 1)]
                    for s in np.unique(syndrome):
                        mine = syndrome == s
                        m = masks[k][s]
                        keys = (word[mine, None] ^ m) | (k << 22)
                        home = np.zeros(keys.shape, bool)
                        home[:, 0] = True
                        out.append((keys.ravel(), np.repeat(fp[mine], len(m)), home.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], ["anchor", "fp", "home"])

    return fps.select("fp").mapInArrow(run, "anchor long, fp long, home boolean")


def _link(fp: np.ndarray, home: np.ndarray, part: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the links among an anchor's members, of which one side is at home."""
    at = np.flatnonzero(home)
    label = np.arange(len(fp))
    left, right = [], []
    for i in range(0, len(at), 256):
        own = at[i : i + 256]
        near = np.bitwise_count(fp[own, None] ^ fp[None, :]) <= max_bits
        if part.any():  # a pair of parts compares across; each part with itself is a group of its own
            near &= part[own, None] != part[None, :]
        for r in np.flatnonzero(near.sum(1) > (not part.any())).tolist():
            x, found = own[r], np.flatnonzero(near[r])
            labels, first = np.unique(label[found], return_index=True)
            new = labels != label[x]
            if new.any():
                left += [x] * int(new.sum())
                right += found[first[new]].tolist()
                label[np.isin(label, labels)] = label[x]
    return fp[np.array(left, np.int64)], fp[np.array(right, np.int64)]


def links(fps: DataFrame, max_bits: int = MAX_BITS, part: int = PART) -> DataFrame:
    """Edges ``a, b`` between distinct fingerprints that join what the links of at most ``max_bits`` join.

    ``fps`` holds each fingerprint once. Every anchor yields a spanning forest of
    the links it sees, so no group emits all its pairs. An anchor with more than
    ``part`` members is split by hash into parts, and each pair of parts is a
    group of its own.
    """
    assert max_bits <= MAX_BITS, "the three blocks and the code serve at most 4 bits"
    rows = materialize(anchors(fps), "anchors")
    big = rows.groupBy("anchor").count().where(F.col("count") > part)
    big = big.select("anchor", F.ceil(F.col("count") / (part / 2)).cast("int").alias("parts"))
    rows = rows.join(big, "anchor", "left")
    own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    pair = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda o: F.struct(F.least(own, o).alias("i"), F.greatest(own, o).alias("j"), own.alias("own")))
    one = F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("own")))
    rows = rows.select("anchor", "fp", "home", F.explode(F.coalesce(pair, one)).alias("p")).select("anchor", "fp", "home", "p.*")
    # j <> i marks a pair of parts; their members then tell their part by own = j.
    key = F.col("anchor") * F.lit(1 << 38) + F.col("i").cast("long") * F.lit(1 << 19) + F.col("j")
    rows = rows.select(key.alias("key"), "fp", "home", (F.col("own") != F.col("i")).alias("second"), (F.col("i") != F.col("j")).alias("cross"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(cols: list[np.ndarray], out: list) -> None:
            key, fp, home, second, cross = cols
            starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            sizes = np.diff(np.append(starts, len(key)))
            for s, n in zip(starts[sizes > 1].tolist(), sizes[sizes > 1].tolist(), strict=True):
                g = slice(s, s + n)
                if n == 2:
                    if (home[s] or home[s + 1]) and (int(fp[s]) ^ int(fp[s + 1])).bit_count() <= max_bits and (not cross[s] or second[s] != second[s + 1]):
                        out.append((fp[s : s + 1], fp[s + 1 : s + 2]))
                elif home[g].any():
                    out.append(_link(fp[g], home[g], second[g] if cross[s] else np.zeros(n, bool), max_bits))

        held: list[np.ndarray] | None = None
        for b in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in b.columns]
            cols[1] = cols[1].view(np.uint64)
            if held is not None:
                cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
            cut = int(np.searchsorted(cols[0], cols[0][-1])) if len(cols[0]) else 0  # the last key may go on
            out: list = []
            if cut:
                emit([c[:cut] for c in cols], out)
            held = [c[cut:] for c in cols]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in zip(*out, strict=True)], ["a", "b"])
        if held is not None and len(held[0]):
            out = []
            emit(held, out)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in zip(*out, strict=True)], ["a", "b"])

    rows = rows.repartition(partitions(rows), "key").sortWithinPartitions("key")
    return rows.mapInArrow(run, "a long, b long").where("a <> b").distinct()


def classes(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """``fp, root``: each distinct fingerprint of ``fps(fp)`` and the smallest of its component."""
    reps = fps.select("fp").distinct()
    found = connected_components(links(reps, max_bits))
    return materialize(reps.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root")), "simhash-classes")


def near_duplicates(docs: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of each row of ``docs(doc_id, text)``.

    Texts without words, and null texts, have fingerprint zero and are linked to
    each other. A repeated row comes out as often as it stands in ``docs``. A
    null doc_id joins its group and never names one, unless all ids of the group
    are null: then component_id is null. Other columns are ignored; an empty
    table gives no rows.
    """
    own = materialize(fingerprints(docs), "simhash")
    first = own.groupBy("fp").agg(F.min("doc_id").alias("first"))
    named = materialize(first.join(classes(own, max_bits), "fp"), "simhash-named")
    names = materialize(named.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("n")), "simhash-roots")
    names = joined(named.select("fp", "root"), names, "root").select("fp", "component_id")
    out = own.join(names, "fp")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicated(docs: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates, all its columns.

    That is the row of the smallest id (rows without an id come after all others), then of
    the smallest fingerprint and hash of the text. So of rows that share an id each group that
    they name keeps its own, and a group without any id keeps one row. An empty table gives no rows.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]  # whatever the columns' own names are
    id_, text = (F.col(names[docs.columns.index(c)]) for c in ("doc_id", "text"))
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(x.as_py()) for x in b.column(place).cast(pa.string())], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(fps)], [*names, "fp"])

    plain = docs.toDF(*names)
    rows = materialize(plain.mapInArrow(run, StructType([*plain.schema.fields, StructField("fp", LongType())])), "fingerprinted")
    own = rows.select(id_.alias("id"), "fp")
    key = F.struct(F.col("id").isNull().alias("none"), "id", "fp")
    first = own.groupBy("fp").agg(F.min(key).alias("key"))
    keep = first.join(classes(own, max_bits), "fp").groupBy("root").agg(F.min("key").alias("key"))
    keep = keep.select(F.col("key.fp").alias("kept_fp"), F.col("key.none").alias("none"), F.coalesce("key.id", F.lit(0)).alias("kept_id"))
    found = rows.join(keep, (F.col("fp") == F.col("kept_fp")) & (F.coalesce(id_, F.lit(0)) == F.col("kept_id")) & (id_.isNull() == F.col("none")), "left_semi")
    turn = Window.partitionBy("fp", id_).orderBy(F.xxhash64(text))
    return found.withColumn("turn", F.row_number().over(turn)).where("turn = 1").select(*names).toDF(*docs.columns)
