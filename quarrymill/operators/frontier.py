"""Crawl frontier over pages that have been fetched: links, their union, what can be reached."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import urls

LINK = """(?i)<a[^>]+href=["']([^"'#?]+)["'#?]"""


def link_edges(pages: DataFrame, prefix: str | None = None) -> DataFrame:
    """(page_id, source, target): distinct links to documentation pages of the same origin, within ``prefix`` if given."""
    found = pages.select("page_id", urls.normalized().column.alias("source"), F.explode(F.regexp_extract_all("html", F.lit(LINK), 1)).alias("href"))
    found = found.filter(~F.col("href").rlike("^(javascript:|mailto:|#)") & (F.col("href").startswith("/") | F.col("href").startswith("http")))
    root = F.regexp_extract("source", "^(https?://[^/]+)", 1)
    full = found.select("page_id", "source", root.alias("root"), F.when(F.col("href").startswith("http"), F.col("href")).otherwise(F.concat(root, "href")).alias("url"))
    kept = full.filter(~urls.is_non_doc().column & (urls.origin().column == F.col("root")))
    if prefix:
        kept = kept.filter(F.col("url").startswith(prefix))
    return kept.select("page_id", "source", urls.normalized().column.alias("target")).distinct()


def union_distinct(sources: list[DataFrame]) -> DataFrame:
    """All urls of several discoveries, each once, without those that are never documentation."""
    merged = reduce(DataFrame.unionByName, sources)
    return merged.filter(~urls.is_non_doc().column).select(urls.normalized().column.alias("url")).distinct()


def reachable(seeds: DataFrame, edges: DataFrame, most_depth: int = 20, most_pages: int | None = None) -> DataFrame:
    """(url, depth) of what the seeds reach, breadth first: a round joins the last level with the edges and drops what was seen.

    Each round's result is checkpointed, so the plan doesn't grow with the depth. ``most_pages``
    keeps the first by (depth, url).
    """
    from ..sources.shared import cut

    level = cut(seeds.distinct().withColumn("depth", F.lit(0).cast("long")))
    seen, edges = level, cut(edges.select("source", "target").distinct())
    for depth in range(1, most_depth + 1):
        found = edges.join(level.select(F.col("url").alias("source")), "source", "left_semi").select(F.col("target").alias("url")).distinct()
        level = cut(found.join(seen, "url", "left_anti").withColumn("depth", F.lit(depth).cast("long")))
        if level.isEmpty():
            break
        seen = seen.unionByName(level)
    return seen.orderBy("depth", "url").limit(most_pages) if most_pages else seen


def sitemap_urls(documents: DataFrame, roots: DataFrame, most_depth: int = 3) -> DataFrame:
    """Page urls in sitemaps (url, body) reached from ``roots`` (url) over sitemap indexes, at most ``most_depth`` deep."""
    from ..sources.shared import cut

    body = F.coalesce("body", F.lit(""))
    locs = documents.select(F.col("url").alias("source"), body.rlike("(?i)<sitemapindex").alias("is_index"), F.explode(F.regexp_extract_all(body, F.lit(r"(?i)<loc>\s*([^<\s]+)\s*</loc>"), 1)).alias("loc"))
    level, pages = roots.select(F.col("url").alias("source")).distinct(), None
    for _ in range(most_depth + 1):
        found = cut(locs.join(level, "source", "left_semi"))
        own = found.filter("not is_index").select(F.col("loc").alias("url"))
        pages = own if pages is None else pages.unionByName(own)
        level = found.filter("is_index").select(F.col("loc").alias("source")).distinct()
        if level.isEmpty():
            break
    return pages.distinct()
