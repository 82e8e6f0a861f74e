"""Batch retrieval: many queries against many chunks, each scanned once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brightloom.functions.text import SPECIAL, query_tokens
from brightloom.sources.scratch import keep

#: Query vectors of a block and chunks of a part.
BLOCK, PART = 2000, 8192
#: Weights of an automaton's tokens, and bytes of the texts that a task of lexical search holds.
TOKEN_BLOCK, TEXT_PART = 500_000, 64 << 20
#: Ids whose texts share an entry in the index of character runs; characters of a text that are looked at together.
GRAM_RANGE, SLICE = 64, 1 << 20


def top(scored: DataFrame, k: int, *ties: str) -> DataFrame:
    """The ``k`` best by score of each query, ties by ``ties``, with ``rank`` from 1. The bound prunes before the shuffle."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), *(ties or ("id",)))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def tokens_of(queries: DataFrame, docs_site: bool = False) -> DataFrame:
    """``query_id, token, kind, weight``: a row per distinct token, its weight 10 or 1 times its number."""
    t = queries.select("query_id", F.explode(query_tokens(F.col("text"), docs_site)).alias("t")).select("query_id", "t.*")
    times = t.groupBy("query_id", "token", "kind").count()
    return times.select("query_id", "token", "kind", (F.when(F.col("kind") == SPECIAL, 10).otherwise(1) * F.col("count")).alias("weight"))


def gram_codes(text: str) -> np.ndarray:
    """Distinct runs of one, two and three characters of a text, each as a number."""
    found = []
    for at in range(0, max(1, len(text)), SLICE):
        c = np.frombuffer(text[at : at + SLICE + 2].encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64) + 1
        pairs = (c[:-1] << 21) | c[1:]
        found.append(np.unique(np.concatenate([c, pairs, (pairs[:-1] << 21) | c[2:]])))
    return np.unique(np.concatenate(found))


def own_grams(token: str) -> np.ndarray:
    """Grams that a text must have to contain a token: its runs of three characters, of a shorter token itself."""
    codes = gram_codes(token)
    return codes[codes >= 1 << (21 * (min(len(token), 3) - 1))]


def gram_index(chunks: DataFrame) -> DataFrame:
    """``gram, range``: each run of one to three lower-case characters and each range of ``GRAM_RANGE`` ids with a text of ``chunks(id, text)`` that has it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                by: dict[int, list[np.ndarray]] = {}
                for r, text in zip(whole.column(0).slice(at, 256).to_pylist(), whole.column(1).slice(at, 256), strict=True):
                    by.setdefault(r, []).append(gram_codes(text.as_py()))
                grams = {r: np.unique(np.concatenate(x)) for r, x in by.items()}
                rows = np.repeat(np.array(list(grams), np.int64), [len(g) for g in grams.values()])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *grams.values()])), pa.array(rows)], ["gram", "range"])

    rows = chunks.select(_gram_range(), F.lower("text").alias("text")).where("text is not null")
    return rows.mapInArrow(run, "gram long, range long").distinct()


def _gram_range() -> Column:
    return F.floor(F.col("id") / GRAM_RANGE).cast("long").alias("range")


def write_grams(chunks: DataFrame, path: str) -> None:
    """Keep ``gram_index`` for many searches, clustered by gram."""
    gram_index(chunks).repartitionByRange("gram", "range").sortWithinPartitions("gram", "range").write.mode("overwrite").parquet(path)


def candidates(tokens: DataFrame, grams: DataFrame) -> DataFrame:
    """``low, range``: for each distinct token in ``tokens(low)`` the ranges that hold the rarest of its grams; none if a gram is nowhere."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [own_grams(t) for t in b.column(0).to_pylist()]
            rows = np.repeat(np.arange(len(own)), [len(g) for g in own])
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), pa.array(np.concatenate([np.zeros(0, np.int64), *own]))], ["low", "gram"])

    asked = keep(tokens.select("low").distinct().mapInArrow(run, "low string, gram long"), "token-grams")
    held = grams.join(asked.select("gram").distinct(), "gram", "left_semi")
    often = held.groupBy("gram").agg(F.count("*").alias("ranges"))
    rarest = asked.join(often, "gram", "left").groupBy("low").agg(F.min_by("gram", F.struct("ranges", "gram")).alias("gram"), F.bool_or(F.col("ranges").isNull()).alias("absent"))
    return rarest.where("not absent").select("low", "gram").join(held, "gram").select("low", "range")


def lexical_scores(
    tokens: DataFrame, chunks: DataFrame, only: Column | None = None, block: int = TOKEN_BLOCK, grams: DataFrame | None = None, k: int | None = None, part: int = TEXT_PART
) -> DataFrame:
    """``query_id, id, score``: the weights of a query's tokens that a chunk's text contains, case set aside; with ``k`` at least the ``k`` best of each query.

    Queries are dealt by hash to blocks of about ``block`` weights and chunks to parts of about ``part`` bytes, one a task. A text moves
    once, however many queries there are: its task holds the part's texts while the blocks' tokens come by, builds an automaton
    of each block's and adds up a text's scores as it runs through it, so that no row is made for a token in a text, nor with
    ``k`` for a chunk that is not among the part's best. With an index of runs of characters (``grams``) texts of
    ranges that can't contain a block's tokens are left out.
    """
    own = tokens.withColumn("low", F.lower("token")).groupBy("query_id", "low").agg(F.sum("weight").cast("long").alias("weight"))
    own = keep(own, "tokens")
    blocks = own.count() // block + 1
    if only is not None:
        chunks = chunks.where(only)
    texts = chunks.select("id", "text").where("text is not null and id is not null")
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")), size // part + 1)
    number = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    none = lambda t: F.lit(None).cast(t)
    own = own.withColumn("block", number("query_id", blocks))
    if grams is None:
        texts = texts.withColumn("near", none("array<int>"))
    else:
        near = own.select("block", "low").join(candidates(own, grams), "low").select("block", "range").distinct()
        texts = texts.withColumn("range", _gram_range()).join(near.groupBy("range").agg(F.collect_list("block").alias("near")), "range")
    by = own.groupBy("block", "low").agg(F.collect_list(F.struct("query_id", "weight")).alias("by"))  # no longer than a block
    by = by.select("block", "low", F.col("by.query_id").alias("queries"), F.col("by.weight").alias("weights"))
    asked = by.select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), *by.columns, none("long").alias("id"), none("string").alias("text"), none("array<int>").alias("near"))
    rows = texts.select(number("id", parts).alias("part"), *[none(f.dataType).alias(f.name) for f in by.schema], F.col("id").cast("long").alias("id"), F.lower("text").alias("text"), "near")
    both = asked.unionByName(rows).repartitionById(parts, F.col("part")).sortWithinPartitions(F.col("block").asc_nulls_first(), "id").drop("part")
    some = grams is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, now, held = [], None, []

        def scores() -> Iterator[pa.RecordBatch]:
            if texts and held:
                found = _Contained(held, k)
                for t in texts:
                    yield from found.add(t.filter(pa.array([now in x for x in t.column("near").to_pylist()])) if some else t)
                yield from found.rows()

        for b in batches:
            keys = b.column("block").fill_null(-1).to_numpy()
            cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
            for s, e in zip(cuts, cuts[1:], strict=False):
                if e == s:
                    continue
                piece = b.slice(s, e - s)
                if keys[s] < 0:
                    texts.append(piece.select(["id", "text", "near"]))
                    continue
                if now != keys[s]:
                    yield from scores()
                    now, held = keys[s], []
                held.append(piece.select(["low", "queries", "weights"]))
        yield from scores()

    return both.mapInArrow(run, f"query_id {own.schema['query_id'].dataType.simpleString()}, id long, score long")


class _Contained:
    """Scores of a block's queries as the texts of a part go by, in order of their ids; with ``k`` the best ``k`` of each query."""

    #: Scores that are held before those that are not among the best are dropped.
    HELD = 1 << 19

    def __init__(self, tokens: list[pa.RecordBatch], k: int | None) -> None:
        import ahocorasick

        queries, weights = (pa.concat_arrays([t.column(c) for t in tokens]) for c in ("queries", "weights"))
        query = queries.flatten().dictionary_encode("encode")
        self.k, self.queries = k, query.dictionary
        self.query, self.weight = query.indices.to_numpy(), weights.flatten().to_numpy().astype(float)
        self.times = queries.value_lengths().to_numpy().astype(np.int64)  # of each token
        self.start = np.cumsum(self.times) - self.times
        self.tokens = ahocorasick.Automaton()
        for n, token in enumerate(x.as_py() for t in tokens for x in t.column("low")):
            self.tokens.add_word(token, n)
        self.tokens.make_automaton()
        self.least = np.zeros(len(self.queries), np.int64)  # the score to beat
        self.found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size, self.most = 0, self.HELD

    def add(self, texts: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for i, text in zip(texts.column("id").to_pylist(), texts.column("text"), strict=True):
            own = np.array(list({t for _, t in self.tokens.iter(text.as_py())}), np.int64)
            if not len(own):
                continue
            times = self.times[own]
            ends = np.cumsum(times)
            at = np.repeat(self.start[own] - ends + times, times) + np.arange(ends[-1])
            score = np.bincount(self.query[at], self.weight[at], len(self.least))
            better = np.flatnonzero(score > self.least)
            if len(better):
                self.found.append((better, np.full(len(better), i), score[better].astype(np.int64)))
                self.size += len(better)
            if self.size > self.most:
                if self.k is None:
                    yield from self.rows()
                else:
                    self._best()
                    self.most = max(self.HELD, 2 * self.size)

    def _best(self) -> None:
        query, ids, score = (np.concatenate(x) for x in zip(*self.found, strict=True))
        order = np.lexsort((ids, -score, query))
        query, ids, score = query[order], ids[order], score[order]
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        last = rank == self.k - 1  # later ids lose ties
        self.least[query[last]] = score[last]
        best = rank < self.k
        self.found, self.size = [(query[best], ids[best], score[best])], int(best.sum())

    def rows(self) -> Iterator[pa.RecordBatch]:
        if self.found and self.k is not None:
            self._best()
        if self.found:
            query, ids, score = (np.concatenate(x) for x in zip(*self.found, strict=True))
            self.found, self.size = [], 0
            yield pa.RecordBatch.from_arrays([self.queries.take(pa.array(query)), pa.array(ids), pa.array(score)], ["query_id", "id", "score"])


def lexical(queries: DataFrame, chunks: DataFrame, k: int, docs_site: bool = False, only: Column | None = None, grams: DataFrame | None = None) -> DataFrame:
    """``query_id, rank, id, score`` of the ``k`` best chunks of positive score; ``grams``: a kept ``gram_index`` of these chunks or more."""
    return top(lexical_scores(tokens_of(queries, docs_site), chunks, only, grams=grams, k=k), k)


def semantic(queries: DataFrame, chunks: DataFrame, k: int, block: int = BLOCK, part: int = PART) -> DataFrame:
    """``query_id, rank, id, score`` of the ``k`` chunks of largest cosine; exact.

    ``queries`` has ``query_id, vec``, ``chunks`` has ``id, vec``, of one length. Both are dealt out by hash, queries
    to blocks and chunks to parts. Each block meets each part in a task that multiplies the two
    and keeps ``k`` for each query. Null and zero vectors take no part, nor do queries without an id.
    """
    asks = queries.where("vec is not null and query_id is not null").select("query_id", F.col("vec").cast("array<double>").alias("vec"))
    rows = chunks.where("vec is not null").select("id", F.col("vec").cast("array<double>").alias("vec"))
    tasks = int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    blocks, parts = asks.count() // block + 1, (rows.count() // (part * tasks) + 1) * tasks
    own = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asks = asks.select(own("query_id", blocks).alias("block"), each(parts).alias("part"), F.col("query_id"), F.lit(None).cast("long").alias("id"), "vec")
    rows = rows.select(each(blocks).alias("block"), own("id", parts).alias("part"), F.lit(None).cast("long").alias("query_id"), "id", "vec")
    both = asks.unionByName(rows).repartitionById(tasks, F.pmod(F.col("part") + F.col("block"), F.lit(tasks)).cast("int"))
    both = both.sortWithinPartitions("block", "part", F.col("id").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, best = None, [], None
        for b in batches:
            keys = np.stack([b.column(c).to_numpy().astype(np.int64) for c in ("block", "part")] + [np.array(b.column("id").is_valid(), np.int64)], 1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
            for s, e in zip(cuts, cuts[1:], strict=False):
                if e == s:
                    continue
                if now != tuple(keys[s, :2]):
                    if best is not None:
                        yield from best.rows()
                    now, held, best = tuple(keys[s, :2]), [], None
                piece = b.slice(s, e - s)
                if not keys[s, 2]:
                    held.append(piece)
                elif held:
                    best = best or _Best(held, k)
                    best.add(piece)
        if best is not None:
            yield from best.rows()

    return top(both.mapInArrow(run, "query_id long, id long, score double"), k).select("query_id", "rank", "id", "score")


def _unit(pieces: list[pa.RecordBatch], name: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids and unit vectors of the rows that are not zero."""
    ids = np.concatenate([b.column(name).to_numpy(zero_copy_only=False) for b in pieces]).astype(np.int64)
    x = np.concatenate([b.column("vec").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1) for b in pieces])
    norm = np.linalg.norm(x, axis=1)
    return ids[norm > 0], x[norm > 0] / norm[norm > 0, None]


class _Best:
    """The ``k`` chunks of largest cosine for each query of a block, as parts of chunks go by."""

    def __init__(self, queries: list[pa.RecordBatch], k: int) -> None:
        self.ids, self.vectors = _unit(queries, "query_id")
        self.k, self.score, self.best = k, np.zeros((len(self.ids), 0)), np.zeros((len(self.ids), 0), np.int64)

    def add(self, rows: pa.RecordBatch, step: int = 1024) -> None:
        for at in range(0, rows.num_rows, step):
            ids, x = _unit([rows.slice(at, step)], "id")
            scores = self.vectors @ x.T
            both = np.concatenate([self.score, scores], 1)
            both_id = np.concatenate([self.best, np.broadcast_to(ids, scores.shape)], 1)
            order = np.lexsort((both_id, -both), axis=1)[:, : self.k]
            self.score, self.best = np.take_along_axis(both, order, 1), np.take_along_axis(both_id, order, 1)

    def rows(self) -> Iterator[pa.RecordBatch]:
        if self.best.size:
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(self.ids, self.best.shape[1])), pa.array(self.best.ravel()), pa.array(self.score.ravel())], ["query_id", "id", "score"])


def fuse(has_special: DataFrame, lexical_hits: DataFrame, semantic_hits: DataFrame, limit: int) -> DataFrame:
    """Conditional fusion: ``query_id, rank, id, origin``, at most ``2 * limit`` a query.

    ``has_special`` has ``query_id, special``. With a special token the first
    ``limit`` lexical hits lead and ``limit`` other semantic ones follow; without
    one it is the other way round.
    """
    both = lexical_hits.select("query_id", "id", "rank", F.lit("lexical").alias("origin")).unionByName(
        semantic_hits.select("query_id", "id", "rank", F.lit("semantic").alias("origin"))
    )
    both = both.join(has_special, "query_id")
    both = both.withColumn("tier", F.when((F.col("origin") == "lexical") == F.col("special"), 0).otherwise(1))
    lead = both.where((F.col("tier") == 0) & (F.col("rank") <= limit))
    rest = both.where("tier = 1").join(lead.select("query_id", "id"), ["query_id", "id"], "left_anti")
    again = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    rest = rest.withColumn("rank", again).where(F.col("rank") <= limit)
    final = F.row_number().over(Window.partitionBy("query_id").orderBy("tier", "rank"))
    return lead.unionByName(rest).withColumn("rank", final).select("query_id", "rank", "id", "origin")


def special_flags(queries: DataFrame, docs_site: bool = False) -> DataFrame:
    """``query_id, special``: whether a query has a special token."""
    return queries.select("query_id", F.exists(query_tokens(F.col("text"), docs_site), lambda t: t["kind"] == SPECIAL).alias("special"))


def hybrid(queries: DataFrame, chunks: DataFrame, limit: int = 3, docs_site: bool = False, grams: DataFrame | None = None, vectors: DataFrame | None = None) -> DataFrame:
    """Lexical and semantic hits under conditional fusion; ``queries(query_id, text, vec)``, ``chunks(id, text, vec)``.

    ``vectors(id, vec)``: the chunks' vectors where they are stored apart, so that no text is joined to its vector.
    """
    lex = lexical(queries, chunks, 2 * limit, docs_site, grams=grams)
    near = semantic(queries, chunks if vectors is None else vectors, 2 * limit)
    return fuse(special_flags(queries, docs_site), keep(lex, "lexical"), keep(near, "semantic"), limit)  # kept: fusion reads both twice


def rrf(lists: list[DataFrame], limit: int, constant: int = 60) -> DataFrame:
    """Reciprocal rank fusion of ranked lists ``query_id, rank, id``: ``query_id, rank, id, score, origin``."""
    both = None
    for x in lists:
        x = x.select("query_id", "id", (1.0 / (constant + F.col("rank"))).alias("part"))
        both = x if both is None else both.unionByName(x)
    scored = both.groupBy("query_id", "id").agg(F.round(F.sum("part"), 12).alias("score"))
    return top(scored, 2 * limit).select("query_id", "rank", "id", "score", F.lit("rrf").alias("origin"))


def by_ids(chunks: DataFrame, wanted: DataFrame) -> DataFrame:
    """Chunks of comma-separated id lists in ``wanted(ids)``."""
    ids = wanted.select(F.explode(F.split("ids", r"\s*,\s*")).alias("x")).where("x rlike '^ *[0-9]+ *$'").select(F.trim("x").cast("long").alias("id"))
    return chunks.join(ids.distinct(), "id", "left_semi")


def by_section(chunks: DataFrame, prefix: str) -> DataFrame:
    """Chunks whose section starts with the prefix."""
    return chunks.where(F.startswith("section", F.lit(prefix)))


def display(hits: DataFrame, chunks: DataFrame, chars: int = 120) -> DataFrame:
    """``query_id, rank, label, section, type, preview``: score to three decimals, or else the origin."""
    from brightloom.functions.text import preview

    rows = hits.join(chunks.select("id", "section", "type", "text"), "id")
    score = F.format_string("%.3f", F.col("score").cast("double")) if "score" in hits.columns else F.lit(None).cast("string")
    origin = F.col("origin") if "origin" in hits.columns else F.lit(None).cast("string")
    return rows.select("query_id", "rank", F.coalesce(score, origin).alias("label"), "section", "type", preview(F.col("text"), chars).alias("preview"))
