"""Pages, sitemaps and page texts as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Parts of a path that mark pages without documentation.
EXCLUDED = ("/tags/", "/categories/", "/page/")


def read_pages(spark: SparkSession, path: str, order: DataFrame | None = None) -> DataFrame:
    """``page_order, url, html, error``; ``order(url, page_order)`` lists the pages to read, else all by url.

    Pages of one url stand by the digest of their html, so that numbers depend neither on the files nor on the tasks.
    A listed page that isn't there, or has no html, comes out with an error and does not stop the rest.
    """
    from brightloom.operators.ids import dense_ids

    pages = spark.read.parquet(path).select("url", "html")
    if order is not None:
        rows = pages.join(order, "url", "right")
    else:
        rows = dense_ids(pages.withColumn("digest", F.md5(F.col("html").cast("binary"))), "url", "digest", name="page_order")
    return rows.select(F.col("page_order").cast("long").alias("page_order"), "url", "html", F.when(F.col("html").isNull(), "no page").alias("error"))


def sitemap_urls(sitemaps: DataFrame, prefix: str, excluded: tuple[str, ...] = EXCLUDED) -> DataFrame:
    """Distinct ``url`` of every ``<loc>`` in ``sitemaps(xml)`` under the prefix, without excluded parts, sorted."""
    urls = sitemaps.select(F.explode(F.regexp_extract_all("xml", F.lit("(?s)<loc>(.*?)</loc>"), F.lit(1))).alias("url")).select(F.trim("url").alias("url"))
    keep = F.startswith("url", F.lit(prefix))
    for part in excluded:
        keep = keep & ~F.contains("url", F.lit(part))
    return urls.where(keep).distinct().orderBy("url")


def page_texts(docs: DataFrame) -> DataFrame:
    """``doc, page, text`` of ``docs(doc, pages array<string>)``; pages count from 1 and empty ones are left out."""
    return docs.select("doc", F.posexplode("pages").alias("pos", "text")).where("text <> ''").select("doc", (F.col("pos") + 1).alias("page"), "text")
