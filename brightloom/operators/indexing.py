"""Index building: vectors, BM25 postings and collection statistics, and BM25 search."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache, partial
from importlib import import_module
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, IntegerType, StringType, StructField, StructType

from brightloom.functions.text import matches, protect_symbols
from brightloom.operators.retrieve import top
from brightloom.sources import segments
from brightloom.sources.scratch import keep, shared_dir

K1, B = 1.2, 0.75
#: Ids of a block of postings; ranges that a query scores first; asked terms that go to the scan as values.
RANGE, WAVE, FEW = 1024, 4, 1000
DIM = 384


@lru_cache(1 << 18)
def _hash(word: str) -> int:
    """The hash of a word: its remainder is the component, bit 16 the sign."""
    return int.from_bytes(hashlib.md5(word.encode("utf-8", "surrogatepass"), usedforsecurity=False).digest()[:4])


def hashing_counts(text: str | None, dim: int = DIM) -> np.ndarray:
    """Signed counts of the hashes of a text's lower-case words."""
    h = np.array([_hash(w) for w in (text or "").lower().split()], np.int64)
    return np.bincount(h % dim, (h >> 16 & 1) * 2 - 1, dim).astype(np.float32)


def hashing_vector(text: str | None, dim: int = DIM) -> np.ndarray:
    """Default encoder: ``hashing_counts`` of unit length; no word: zero."""
    return _unit(hashing_counts(text, dim))


def _unit(counts: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(counts)
    return counts / norm if norm else counts


def hashing_encoder(dim: int = DIM) -> Callable[[str | None], np.ndarray]:
    """Factory of the default encoder."""
    return lambda text: hashing_vector(text, dim)


def counting_encoder(dim: int = DIM) -> Callable[[str | None], np.ndarray]:
    """Factory of an encoder that leaves counts as they are."""
    return lambda text: hashing_counts(text, dim)


def unit_and_counts_encoder(dim: int = DIM) -> Callable[[str | None], np.ndarray]:
    """Factory of an encoder that gives the default encoder's components, then the counts behind them; words are hashed once."""

    def encode(text: str | None) -> np.ndarray:
        counts = hashing_counts(text, dim)
        return np.concatenate([_unit(counts), counts])

    return encode


@lru_cache(4)
def _loaded(factory: str, files: tuple[str, ...], options: tuple[tuple[str, object], ...]) -> Callable[[str | None], np.ndarray]:
    """The encoder of a Python process: made once and held as long as the worker lives."""
    module, _, name = factory.partition(":")
    return getattr(import_module(module), name)(*map(SparkFiles.get, files), **dict(options))


def embed(rows: DataFrame, text: str = "text", encoder: str = "brightloom.operators.indexing:hashing_encoder", files: tuple[str, ...] = (), batch: int = 64, name: str = "vec", **options: object) -> DataFrame:
    """Add a vector to each row by the encoder that a factory makes, once for each Python process and not for each task.

    ``encoder`` names the factory as ``module:function``. It gets the local paths of ``files``, which Spark ships to each
    executor (weights, vocabularies), and the other keyword arguments, and returns a function from a text or null to an array.
    """
    for f in files:
        rows.sparkSession.sparkContext.addFile(f)
    shipped, chosen = tuple(f.rstrip("/").rpartition("/")[2] for f in files), tuple(sorted(options.items()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from brightloom.operators import indexing  # the worker's own module holds the encoder, not this closure

        encode = indexing._loaded(encoder, shipped, chosen)
        for b in batches:
            for at in range(0, b.num_rows, batch):
                c = b.slice(at, batch)
                vectors = [np.asarray(encode(t.as_py()), np.float32) for t in c.column(text)]
                ends = np.cumsum([0, *map(len, vectors)], dtype=np.int32)
                yield pa.RecordBatch.from_arrays([*c.columns, pa.ListArray.from_arrays(ends, np.concatenate(vectors))], [*c.schema.names, name])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField(name, ArrayType(FloatType()))]))


def terms(text: Column) -> Column:
    """Lower-case words of a text whose operators are protected."""
    return matches(F.lower(protect_symbols(text)), r"(?U)\w+")


def posting_counts(chunks: DataFrame, text: str = "text") -> DataFrame:
    """``id, term, tf, len``: the terms of each row counted inside it, without a shuffle; a null text has none."""
    words = chunks.select("id", terms(F.col(text)).alias("w")).where("w is not null")
    return words.mapInArrow(_counted, StructType([words.schema["id"], StructField("term", StringType()), StructField("tf", IntegerType()), StructField("len", IntegerType())]))


def _counted(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, rows):
            part = b.slice(at, rows)
            words = part.column("w")
            each = pa.table({"row": pc.list_parent_indices(words), "term": pc.list_flatten(words)})
            each = each.group_by(["row", "term"], use_threads=False).aggregate([([], "count_all")])
            own = [part.column("id").take(each["row"]), each["term"], each["count_all"].cast(pa.int32()), pc.list_value_length(words).take(each["row"])]
            yield from pa.table(own, names=["id", "term", "tf", "len"]).to_batches()


def statistics(posts: DataFrame, chunks: DataFrame) -> DataFrame:
    """``term, df, idf`` with N the number of chunks."""
    n = chunks.agg(F.count("*").alias("n"))
    df = posts.groupBy("term").agg(F.count("*").alias("df"))
    return df.join(F.broadcast(n)).select("term", "df", F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1).alias("idf"))  # n: one row


def weights(posts: DataFrame, avglen: Column, k1: float = K1, b: float = B) -> DataFrame:
    """Add the BM25 document weight of each posting."""
    return posts.withColumn("weight", _weight(F.col("tf"), F.col("len"), avglen, k1, b))


def _weight(tf: Column, length: Column, avglen: Column, k1: float = K1, b: float = B) -> Column:
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / avglen))


class Index(NamedTuple):
    """A stored posting index.

    ``blocks(segment, term, range, top, base, ids, tfs, lens)``: postings of a term whose ids lie in one range, with their
    largest weight at a mean length of ``base``; ``gone(id, segment)``: ids whose postings in earlier segments no longer count;
    ``terms(term, df, idf)``; ``size(avglen)`` of one row; ``posts(id, term, tf, len)``: the postings that count, one by one.
    """

    posts: DataFrame
    terms: DataFrame
    size: DataFrame
    blocks: DataFrame
    gone: DataFrame


def posting_blocks(chunks: DataFrame) -> DataFrame:
    """``term, range, df, words, ids, tfs, lens``: the postings of ``chunks(id, text)``, joined to blocks in the task that reads the texts.

    ``df`` is the number of a block's ids, ``words`` the sum of its ``tfs``. Where a range's chunks are read by several tasks, or their words are many, a term has
    several blocks there; chunks in order of ids give the fewest.
    """
    # One string of words each: lists of words would be made and copied word by word.
    words = chunks.select(F.col("id").cast("long").alias("id"), F.trim(F.regexp_replace(F.lower(protect_symbols(F.col("text"))), r"(?U)\W+", " ")).alias("w"))
    return words.where("w <> ''").mapInArrow(partial(_joined, width=RANGE), "term string, range long, df int, words long, ids array<long>, tfs array<int>, lens array<int>")


def _joined(batches: Iterator[pa.RecordBatch], width: int, most: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []
    size = 0
    for b in batches:
        ends = np.cumsum(pc.count_substring(b.column("w"), " ").to_numpy().astype(np.int64) + 1)
        cuts = [0, *(np.flatnonzero(ends[1:] // most != ends[:-1] // most) + 1).tolist(), b.num_rows]
        for s, e in zip(cuts, cuts[1:], strict=False):
            if e > s:
                held.append(b.slice(s, e - s))
                size += int(ends[e - 1] - (ends[s - 1] if s else 0))
            if size >= most:
                yield from _blocks_of(held, width)
                held, size = [], 0
    if held:
        yield from _blocks_of(held, width)


def _blocks_of(batches: list[pa.RecordBatch], width: int, rows: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    """Blocks of the words of some chunks: a key of term and chunk for each word, sorted and counted."""
    table = pa.Table.from_batches(batches).sort_by("id").combine_chunks()
    words, ids = pc.split_pattern(table["w"].combine_chunks(), " "), table["id"].to_numpy()
    flat, lens = pc.list_flatten(words).dictionary_encode(), pc.list_value_length(words).to_numpy().astype(np.int64)
    keys, tfs = np.unique(flat.indices.to_numpy().astype(np.int64) * len(ids) + np.repeat(np.arange(len(ids)), lens), return_counts=True)
    term, row = np.divmod(keys, len(ids))
    range_ = ids[row] // width
    starts = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (range_[1:] != range_[:-1])]))
    ends = np.append(starts, len(keys)).astype(np.int32)
    lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x)) for x in (ids[row], tfs.astype(np.int32), lens[row].astype(np.int32))]
    own = [flat.dictionary.take(pa.array(term[starts])), pa.array(range_[starts]), pa.array(np.diff(ends)), pa.array(np.add.reduceat(tfs, starts)), *lists]
    whole = pa.RecordBatch.from_arrays(own, ["term", "range", "df", "words", "ids", "tfs", "lens"])
    for at in range(0, whole.num_rows, rows):
        yield whole.slice(at, rows)


def _size_of(chunks: DataFrame, blocks: DataFrame, sign: int = 1) -> DataFrame:
    """``chunks, texts, words`` of one row."""
    rows = chunks.agg((sign * F.count("*")).alias("chunks"), (sign * F.count("text")).alias("texts"))
    words = blocks.agg((sign * F.coalesce(F.sum("words"), F.lit(0))).cast("long").alias("words"))
    return rows.join(F.broadcast(words))  # one row each


def _frequencies(blocks: DataFrame, sign: int = 1) -> DataFrame:
    """``term, df`` of posting blocks."""
    return blocks.groupBy("term").agg((sign * F.sum("df")).cast("long").alias("df"))


def _gathered(posts: DataFrame) -> DataFrame:
    """``term, range, ids, tfs, lens`` of single ``posts(id, term, tf, len)``."""
    rows = posts.withColumn("range", F.floor(F.col("id") / RANGE).cast("long"))
    rows = rows.groupBy("term", "range").agg(F.sort_array(F.collect_list(F.struct("id", "tf", "len"))).alias("p"))  # at most RANGE
    part = lambda c: F.transform("p", lambda x: x[c])
    return rows.select("term", "range", part("id").alias("ids"), part("tf").alias("tfs"), part("len").alias("lens"))


def _blocked(blocks: DataFrame, avglen: float) -> DataFrame:
    """``term, range, top, base, ids, tfs, lens`` of posting blocks, in files sorted by term; of a frequent term ``RANGE`` ranges stay together."""
    rows = blocks.drop("df", "words").repartition("term", F.floor(F.col("range") / RANGE)).sortWithinPartitions("term", "range")
    top_ = F.array_max(F.zip_with("tfs", "lens", lambda tf, length: _weight(tf, length, F.lit(avglen))))
    return rows.select("term", "range", top_.alias("top"), F.lit(avglen).alias("base"), "ids", "tfs", "lens")


def _write_segment(spark: SparkSession, path: str, segment: int, posts: DataFrame, deltas: tuple[DataFrame, DataFrame], gone: DataFrame) -> None:
    """Posting tables of a segment; ``deltas``: what it adds to ``df`` of terms and to the sizes."""
    terms_, size = deltas
    segments.write(terms_, path, "terms", segment)
    size = segments.write(size, path, "size", segment)
    before = segments.read(spark, path, "size").select(*size.columns) if segments.live(spark, path) else size.limit(0)
    total = before.unionByName(size).agg(F.sum("words"), F.sum("texts")).first()
    segments.write(_blocked(posts, (total[0] or 0) / (total[1] or 1) or 1.0), path, "blocks", segment)
    segments.write(gone.select(F.col("id").cast("long").alias("id")), path, "gone", segment)


def write_postings(chunks: DataFrame, path: str) -> None:
    """Write the posting index of ``chunks(id, text)`` as a new segment that replaces what is there."""
    spark = chunks.sparkSession
    segment, old = segments.new_number(spark, path), segments.live(spark, path)
    write_posting_segment(chunks, path, segment, replaces=old)
    segments.commit(spark, path, segment, old)


def write_posting_segment(chunks: DataFrame, path: str, segment: int, superseded: DataFrame | None = None, gone: DataFrame | None = None, replaces: list[int] = ()) -> None:
    """Posting tables of ``chunks(id, text)`` in a segment not committed yet.

    ``superseded(id, text)``: rows of earlier segments that go or are replaced; only these and ``chunks`` are
    read, and their terms go out of the counts. ``gone(id)`` are their ids.
    """
    spark = chunks.sparkSession
    posts = keep(posting_blocks(chunks), "postings")
    terms_ = _frequencies(posts)
    size = _size_of(chunks, posts)
    if superseded is not None:
        was = keep(posting_blocks(superseded), "postings-gone")
        terms_ = terms_.unionByName(_frequencies(was, -1)).groupBy("term").agg(F.sum("df").alias("df")).where("df <> 0")
        size = size.unionByName(_size_of(superseded, was, -1)).agg(*[F.sum(c).alias(c) for c in ("chunks", "texts", "words")])
    none = spark.range(0)
    if replaces:  # a whole new index: earlier sizes do not count
        total = size.first()
        segments.write(terms_, path, "terms", segment)
        segments.write(size, path, "size", segment)
        segments.write(_blocked(posts, (total["words"] or 0) / (total["texts"] or 1) or 1.0), path, "blocks", segment)
        segments.write(none, path, "gone", segment)
    else:
        _write_segment(spark, path, segment, posts, (terms_, size), gone if gone is not None else none)


def merge_posting_segments(spark: SparkSession, path: str, segment: int) -> None:
    """Posting tables of all live segments as one, not committed yet; texts are not read again."""
    index = read_postings(spark, path)
    posts = keep(index.posts, "postings")
    size = segments.read(spark, path, "size").agg(*[F.sum(c).alias(c) for c in ("chunks", "texts", "words")])
    avglen = index.size.first()["avglen"] or 1.0
    segments.write(index.terms.select("term", "df"), path, "terms", segment)
    segments.write(size, path, "size", segment)
    segments.write(_blocked(_gathered(posts), avglen), path, "blocks", segment)
    segments.write(spark.range(0), path, "gone", segment)


def read_postings(spark: SparkSession, path: str) -> Index:
    """The live segments of a posting index; nothing is counted or written."""
    blocks, gone = segments.read(spark, path, "blocks"), segments.read(spark, path, "gone")
    total = segments.read(spark, path, "size").agg(F.sum("chunks").alias("chunks"), F.try_divide(F.sum("words"), F.sum("texts")).alias("avglen"))
    df = segments.read(spark, path, "terms").groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")
    n = F.col("chunks")
    terms_ = df.join(F.broadcast(total)).select("term", "df", F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1).alias("idf"))  # total: one row
    posts = blocks.select("segment", "term", F.explode(F.arrays_zip("ids", "tfs", "lens")).alias("p"))
    posts = segments.unhidden(posts.select("segment", F.col("p.ids").alias("id"), "term", F.col("p.tfs").alias("tf"), F.col("p.lens").alias("len")), gone)
    return Index(posts.drop("segment"), terms_, total.select("avglen"), blocks, gone)


class Asked(NamedTuple):
    """Queries at an index: ``words(query_id, asks array<struct<term, idf>>)``, ``blocks`` of their terms, ``bounds(query_id, range, bound)``, mean length."""

    words: DataFrame
    blocks: DataFrame
    bounds: DataFrame
    avglen: float


def asked(queries: DataFrame, index: Index) -> Asked:
    """What ``search`` works with: for each query and range of ids that holds one of its terms the most that a score can be there."""
    words = queries.select("query_id", F.explode(F.array_distinct(terms(F.col("text")))).alias("term")).join(index.terms, "term")
    words = keep(words.select("query_id", "term", "idf"), "asked")
    own = words.select("term").distinct()
    few = own.limit(FEW + 1).collect()
    if len(few) <= FEW:  # the terms themselves prune the pages of the files, which are sorted by term
        blocks = index.blocks.where(F.col("term").isin([r["term"] for r in few]))
    else:
        blocks = index.blocks.join(own, "term", "left_semi")
    avglen = index.size.first()["avglen"] or 1.0
    # A longer mean raises a weight by the ratio of the means at most.
    top_ = F.col("top") * F.greatest(F.lit(1.0), F.lit(avglen) / F.col("base"))
    heads = blocks.groupBy("term", "range").agg(F.max(top_).alias("top"))
    bounds = heads.join(words, "term").groupBy("query_id", "range").agg((F.sum(F.col("idf") * F.col("top")) + 1e-6).alias("bound"))
    per = words.groupBy("query_id").agg(F.collect_list(F.struct("term", "idf")).alias("asks"))  # the terms of a query
    return Asked(keep(per, "asked-words"), blocks, keep(bounds, "bounds"), avglen)


def _scored(pairs: DataFrame, a: Asked, gone: DataFrame, k: int) -> DataFrame:
    """``query_id, id, score``: the best ``k`` chunks (and those close to the last) of each pair ``query_id, range``.

    A range's blocks are held, each once for all queries; its queries stream past and add up weights of at most
    ``RANGE`` ids. No row is made for a query and a chunk that is not among its best.
    """
    wanted = pairs.select("range").distinct()
    held = a.blocks.join(wanted, "range", "left_semi").select("range", "segment", "term", "ids", "tfs", "lens")
    hidden = gone.groupBy(F.floor(F.col("id") / RANGE).cast("long").alias("range"), "segment").agg(F.collect_list("id").alias("ids"))  # at most RANGE
    hidden = hidden.join(wanted, "range", "left_semi")
    past = pairs.select("range", "query_id").join(a.words, "query_id")
    both = held.unionByName(hidden, allowMissingColumns=True).unionByName(past, allowMissingColumns=True)
    kinds = dict(both.dtypes)
    # Empty, not null: null lists cost Arrow time in the square of a batch. A tombstone is a block without a term.
    both = both.withColumns({c: F.coalesce(c, F.expr(f"cast(array() as {kinds[c]})")) for c in ("ids", "tfs", "lens", "asks")})
    both = both.repartition("range").sortWithinPartitions("range", F.col("query_id").asc_nulls_first())
    avglen = a.avglen

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, found, size = None, [], 0
        blocks: dict[str, list] = {}
        dead: list[tuple[int, np.ndarray]] = []
        ready = False
        for b in batches:
            cols = {c: b.column(c) for c in b.schema.names}
            for i, (r, q) in enumerate(zip(cols["range"].to_pylist(), cols["query_id"].to_pylist(), strict=True)):
                if r != now:
                    now, blocks, dead, ready = r, {}, [], False
                if q is None:
                    ids, segment, term = cols["ids"][i].values.to_numpy() - r * RANGE, cols["segment"][i].as_py(), cols["term"][i].as_py()
                    if term is not None:
                        tf, length = (cols[c][i].values.to_numpy().astype(float) for c in ("tfs", "lens"))
                        blocks.setdefault(term, []).append((segment, ids, tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / avglen))))
                    else:
                        dead.append((segment, ids))
                    continue
                if not ready and dead:  # tombstones are known now
                    for term, own in blocks.items():
                        for n, (segment, ids, w) in enumerate(own):
                            later = [x for s, x in dead if s > segment]
                            if later:
                                alive = ~np.isin(ids, np.concatenate(later))
                                own[n] = (segment, ids[alive], w[alive])
                ready = True
                score = np.zeros(RANGE)
                for ask in cols["asks"][i].as_py():
                    for _, ids, w in blocks.get(ask["term"], ()):
                        score[ids] += ask["idf"] * w
                best = np.flatnonzero(score)
                if len(best) > k:
                    least = np.partition(score[best], len(best) - k)[len(best) - k]
                    best = best[score[best] >= least - 2e-6]
                found.append((np.full(len(best), q), best + r * RANGE, score[best]))
                size += len(best)
                if size > 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found, strict=True)], ["query_id", "id", "score"])
                    found, size = [], 0
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found, strict=True)], ["query_id", "id", "score"])

    return both.mapInArrow(run, "query_id long, id long, score double").withColumn("score", F.round("score", 6))


def first_wave(a: Asked, wave: int = WAVE) -> DataFrame:
    """The ``wave`` ranges of the largest bound of each query."""
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("bound"), "range"))
    return a.bounds.withColumn("nth", nth).where(F.col("nth") <= wave).drop("nth")


def second_wave(a: Asked, first: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """The other ranges whose bound reaches the ``k``-th score that the first wave found; a query with fewer scores skips none."""
    least = found.where(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
    rest = a.bounds.join(first, ["query_id", "range"], "left_anti").join(least, "query_id", "left")
    return rest.where(F.col("least").isNull() | (F.col("bound") >= F.col("least"))).select("query_id", "range", "bound")


def search(queries: DataFrame, index: Index, k: int) -> DataFrame:
    """``query_id, rank, id, score`` by published BM25 for ``queries(query_id, text)``, exact.

    Bounds of blocks tell which ranges of ids may hold a query's best. The most promising few are scored first, and a
    range whose bound stays below the ``k``-th score found there is never scored. Queries without an id take no part.
    """
    a = asked(queries.where("query_id is not null"), index)
    first = keep(first_wave(a), "first-wave")
    found = keep(top(_scored(first, a, index.gone, k), k), "first-hits")
    more = _scored(second_wave(a, first, found, k), a, index.gone, k)
    return top(found.drop("rank").unionByName(more), k).select("query_id", "rank", "id", "score")


def bm25(queries: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """``search`` in an index of ``chunks`` that is written to the shared folder first; to ask it again keep it with ``write_postings``."""
    path = f"{shared_dir(chunks.sparkSession)}/postings-{uuid.uuid4().hex}"
    write_postings(chunks, path)
    return search(queries, read_postings(chunks.sparkSession, path), k)
