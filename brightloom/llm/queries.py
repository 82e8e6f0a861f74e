"""Registered queries of the training-data operators, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer's file, the same on every machine."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import pii

    rows = pii.find(_table(spark, sf_dir, "documents"))
    n = [pii.count_of(F.col("spans"), kind).alias(f"n_{kind}") for kind, *_ in pii.BASE]
    return rows.select("doc_id", *n, F.sha2(pii.listed(F.col("base")), 256).alias("base_sha256"), pii.listed(F.col("spans")).alias("spans"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import mixing

    return mixing.placed(_table(spark, sf_dir, "documents"))


def op3_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import cross_polytope

    return cross_polytope.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import html_extract

    return html_extract.extract(_table(spark, sf_dir, "pages"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import token_counts

    tables = materialize(token_counts.prefix_counts(_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json")), "prefix-counts")
    return token_counts.answers(tables)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import packing

    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), with_ids=False)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import simhash

    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import token_files

    folder = token_files.token_folder(spark)
    manifest = token_files.write_token_files(_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), folder)
    return token_files.read_token_files(manifest, folder, with_ids=False)


def op9_ego_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import ego_join

    return ego_join.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import pu_quality

    docs = _table(spark, sf_dir, "documents")
    rows = pu_quality.feature_rows(docs)
    return pu_quality.score(docs, pu_quality.train(docs, _table(spark, sf_dir, "labels"), rows=rows), rows=rows)


def op11_shared_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import shared_search

    return shared_search.search(_table(spark, sf_dir, "benchmark"), _table(spark, sf_dir, "documents"))


def op12_anchor_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import anchor_tree

    return anchor_tree.mine(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import suffix_dedup

    return suffix_dedup.without_repeats(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_pii": op1_pii,
    "op2_mixing": op2_mixing,
    "op3_ann": op3_ann,
    "op4_html": op4_html,
    "op5_token_counts": op5_token_counts,
    "op6_packing": op6_packing,
    "op7_simhash": op7_simhash,
    "op8_token_files": op8_token_files,
    "op9_ego_join": op9_ego_join,
    "op10_quality": op10_quality,
    "op11_shared_search": op11_shared_search,
    "op12_anchor_tree": op12_anchor_tree,
    "op13_suffix_dedup": op13_suffix_dedup,
}

#: Mixing in DuckDB: the same integer sums, running sums and IEEE operations.
MIXING_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS k FROM documents),
p AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source COLLATE "C" NULLS LAST) AS rank FROM p),
w AS (SELECT *, (rank - 1) % 3 + 1 AS w, 3 * source_size AS cap FROM r),
c AS (
  SELECT *, sum(source_size) OVER () AS total,
         coalesce(sum(cap) OVER (ORDER BY cap / w, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cap_before,
         sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY cap / w, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS w_left
  FROM w),
l AS (SELECT *, CAST(total - cap_before AS DOUBLE) / CAST(w_left AS DOUBLE) AS level FROM c),
f AS (SELECT *, CAST(cap AS DOUBLE) / w > level AS free FROM l),
g AS (SELECT *, arg_min(level, cap_before) FILTER (WHERE free) OVER () AS stop FROM f),
t AS (SELECT source, source_size, rank,
             CASE WHEN free THEN least(CAST(cap AS DOUBLE), w * stop) ELSE CAST(cap AS DOUBLE) END AS target FROM g),
s AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.rank,
         coalesce(CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
x AS (SELECT *, CAST(floor(target + 0.5) AS BIGINT) AS goal, CASE WHEN rank % 2 = 1 THEN 1.5::DOUBLE ELSE 0.5::DOUBLE END AS a FROM s),
c3 AS (
  SELECT doc_id, pass, greatest(least(goal - (pass * source_size + start), size), 0) AS tokens,
         (sqrt(a * a + 4.0::DOUBLE * (1.0::DOUBLE - a) * (CAST(pass * source_size + start AS DOUBLE) / target)) - a) / (2.0::DOUBLE * (1.0::DOUBLE - a)) AS position
  FROM x, (VALUES (0), (1), (2)) p(pass) WHERE least(goal - (pass * source_size + start), size) > 0),
o AS (SELECT doc_id, tokens, position, row_number() OVER (ORDER BY position, doc_id, pass) - 1 AS place FROM c3),
q AS (SELECT doc_id, CAST(sum(tokens) AS BIGINT) AS taken, min(position) AS position, min(place) AS place FROM o GROUP BY doc_id)
SELECT x.doc_id, size, source_size, target, coalesce(taken, 0) AS taken, position, coalesce(place, -1) AS place FROM x LEFT JOIN q USING (doc_id)
"""

#: Lexical search in DuckDB: every item with every document that shares a term.
SEARCH_SQL = r"""
WITH t AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM documents),
p AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
d AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM p GROUP BY doc_id),
c AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS words FROM d),
q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark),
w AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, c GROUP BY term),
s AS (
  SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * docs) // words)))) AS BIGINT) AS score
  FROM q JOIN p USING (term) JOIN w USING (term) JOIN d USING (doc_id), c GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score
FROM s WHERE score > 0 QUALIFY rank <= 10
"""

#: Hard negatives in DuckDB: every anchor with every row.
NEGATIVES_SQL = r"""
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id AS id, a.label = c.label AS same, CAST(list_inner_product(a.v, c.v) AS BIGINT) AS score
  FROM e a JOIN e c ON a.vec_id <> c.vec_id AND len(a.v) = len(c.v) WHERE a.vec_id % 100 = 0),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
n AS (
  SELECT p.anchor_id, p.id AS positive_id, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score,
         CAST(row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY s.score DESC, s.id) AS INT) AS rank
  FROM p JOIN s USING (anchor_id) WHERE NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""

#: Removal of repeats in DuckDB: all strings of 50 bytes in hexadecimal, then the removed runs and what lies between.
REPEATS_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, strlen(coalesce(text, '')) AS n, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT r, doc_id, p, substr(h, CAST(2 * p + 1 AS BIGINT), 100) AS s FROM (SELECT r, doc_id, h, unnest(range(greatest(n - 49, 0))) AS p FROM d)),
f AS (SELECT s, min(doc_id) AS first FROM w GROUP BY s),
c AS (SELECT r, p, p > coalesce(lag(p) OVER (PARTITION BY r ORDER BY p) + 50, -1) AS new FROM w JOIN f USING (s) WHERE doc_id > first),
k AS (SELECT r, p, sum(CASE WHEN new THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY p) AS k FROM c),
g AS (SELECT r, min(p) AS a, max(p) + 50 AS b FROM k GROUP BY r, k),
x AS (SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS kept_from FROM g),
y AS (
  SELECT r, CAST(count(*) AS BIGINT) AS n_spans, CAST(sum(b - a) AS BIGINT) AS n_removed, max(b) AS ended,
         string_agg(substr(h, CAST(2 * kept_from + 1 AS BIGINT), CAST(2 * (a - kept_from) AS BIGINT)), '' ORDER BY a) AS front
  FROM x JOIN d USING (r) GROUP BY r)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(front, '') || substr(h, CAST(2 * coalesce(ended, 0) + 1 AS BIGINT)))) AS kept_sha256
FROM d LEFT JOIN y USING (r)
"""

SQL: dict[str, str] = {"op2_mixing": MIXING_SQL, "op11_shared_search": SEARCH_SQL, "op12_anchor_tree": NEGATIVES_SQL, "op13_suffix_dedup": REPEATS_SQL}
