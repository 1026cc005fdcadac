"""Registered queries of lookups: imports, images, categories, texts of links, meta tags in any order, and what fixes come to."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls
from ..functions.dual import quoted
from ..operators import features, lookups, rewrite
from . import doc_queries as dq
from . import page_queries as pq
from .views import PAGES_RICH, dealt, dealt_sql, mdx_docs, pages_rich

Q: dict = {}
S: dict = {}

FILES = ("path string", [("docs/b-~.tsx",), ("docs/b-~.jsx",), ("snippets/c-~.jsx",), ("docs/a-~.mdx",), ("docs/img/x-~.png",), ("static/img/y-~.svg",)])
IMPORTS = ("path string, spec string", [("docs/a-~.mdx", "./b-~"), ("docs/sub/d-~.mdx", "../../snippets/./c-~"), ("docs/a-~.mdx", "/snippets/c-~.jsx"), ("docs/a-~.mdx", "react-~"), ("docs/a-~.mdx", "./none-~"), ("e-~.mdx", "./docs/a-~")])
_ends = ", ".join(f"({i}, {quoted(e)})" for i, e in enumerate(lookups.IMPORT_ENDINGS))
Q["import_targets"] = lambda spark, sf_dir: lookups.imports(dealt(spark, sf_dir, *IMPORTS), dealt(spark, sf_dir, *FILES))
S["import_targets"] = f"""WITH i AS (SELECT *, regexp_matches(spec, '^[./]') AS own, {lookups.beside('path', 'spec').sql} AS base FROM ({dealt_sql(*IMPORTS)})), e(i, e) AS (VALUES {_ends}),
h AS (SELECT base, arg_min(base || e, e.i) AS target FROM (SELECT DISTINCT base FROM i WHERE own), e WHERE base || e IN (SELECT path FROM ({dealt_sql(*FILES)})) GROUP BY 1)
SELECT path, spec, target, CASE WHEN NOT own THEN 'package' WHEN target IS NULL THEN 'missing' ELSE 'file' END AS kind FROM i LEFT JOIN h ON own AND h.base = i.base"""

IMAGES = ("path string, src string", [("docs/a-~.mdx", "./img/x-~.png#big"), ("docs/sub/d-~.mdx", "../img/x-~.png"), ("docs/a-~.mdx", "../img/y-~.svg#v"), ("docs/a-~.mdx", "/img/z-~.png"), ("docs/a-~.mdx", "https://example.org/i.png"), ("docs/a-~.mdx", "./other-~.mdx"), ("docs/a-~.mdx", "../../far/w-~"), ("docs/a-~.mdx", "/static/s-~.gif")])
_end = "lower(regexp_extract(bare, '[^./](\\.[^./]*)$', 1))"
Q["image_targets"] = lambda spark, sf_dir: lookups.images(dealt(spark, sf_dir, *IMAGES), dealt(spark, sf_dir, *FILES))
S["image_targets"] = f"""WITH f AS ({dealt_sql(*FILES)}), s AS (SELECT *, string_split(src, '#')[1] AS bare FROM ({dealt_sql(*IMAGES)})), b AS (SELECT *, regexp_replace(regexp_replace(bare, '^(\\.\\./)+', ''), '^\\./', '') AS short, {lookups.beside('path', 'bare').sql} AS own FROM s),
k AS (SELECT *, CASE WHEN regexp_matches(src, '^(https?://|data:|//|/static/)') OR src NOT LIKE '/%' AND ({_end} <> '' AND {_end} NOT IN ({', '.join(map(quoted, lookups.IMAGE_ENDINGS))}) OR short = '') THEN 'other' WHEN src LIKE '/%' THEN 'root' WHEN own IN (SELECT path FROM f) THEN 'document' WHEN 'static/' || short IN (SELECT path FROM f) THEN 'static' ELSE 'assumed' END AS kind FROM b)
SELECT path, src, CASE WHEN kind = 'root' THEN '/static' || src WHEN kind IN ('static', 'assumed') THEN '/static/' || short || substr(src, length(bare) + 1) ELSE src END AS put, kind FROM k"""


def listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A navigation that names two of three pages, some with a slash at the end, under their site's label; every sixth page stands in a second category, too."""
    pages = pq.pages(spark, sf_dir)
    own = pages.filter("page_id % 3 <> 0").select(F.col("page_id").alias("ord"), urls.label().column.alias("name"), F.when(F.col("page_id") % 2 == 0, F.concat("url", F.lit("/"))).otherwise(F.col("url")).alias("url"))
    return own.unionByName(pages.filter("page_id % 6 in (0, 1)").select((F.col("page_id") + 1000000000000).alias("ord"), F.lit("More").alias("name"), "url"))


_listed = f"SELECT page_id AS ord, {urls.label().sql} AS name, CASE WHEN page_id % 2 = 0 THEN url || '/' ELSE url END AS url FROM pages WHERE page_id % 3 <> 0 UNION ALL SELECT page_id + 1000000000000, 'More', url FROM pages WHERE page_id % 6 IN (0, 1)"
Q["page_categories"] = lambda spark, sf_dir: lookups.categories(pq.pages(spark, sf_dir), listed(spark, sf_dir))
S["page_categories"] = f"WITH c AS (SELECT {urls.normalized().sql} AS u, arg_min(name, ord) AS name FROM ({_listed}) GROUP BY 1) SELECT page_id, coalesce(c.name, 'Uncategorized') AS category FROM (SELECT page_id, {urls.normalized().sql} AS u FROM pages) p LEFT JOIN c ON c.u = p.u"

_links = f"SELECT page_id, {urls.origin().sql} AS own, unnest(x) AS a, generate_subscripts(x, 1) - 1 AS ord FROM (SELECT page_id, url, regexp_extract_all(html, {quoted(features.LINK)}) AS x FROM ({PAGES_RICH}))"
Q["external_link_texts"] = lambda spark, sf_dir: lookups.link_texts(pq.spread(pages_rich(spark, sf_dir)), features.LINK)
S["external_link_texts"] = f"SELECT page_id, ord, url, text FROM (SELECT page_id, own, CAST(ord AS BIGINT) AS ord, regexp_extract(a, {quoted(features.LINK)}, 1) AS url, substr(regexp_replace(regexp_replace(regexp_extract(a, {quoted(features.LINK)}, 2), '<[^>]+>', '', 'g'), '^\\s+|\\s+$', '', 'g'), 1, 100) AS text FROM ({_links})) WHERE {urls.origin().sql} <> own"

#: Meta tags in all orders of their attributes, before a page's own.
TAGS = "<meta content='First \"one\"' property=\"og:title\"><meta name=\"description\" content=\" \"><META itemprop=\"image\" data-x='1' content=\"/i.png\"/><meta property=\"\" name=\"robots\" content=\"no\" content=\" index \"><meta charset=\"utf-8\"><meta content=\"Second\" name=\"og:title\" />"
_attrs = f"SELECT page_id, i, regexp_extract_all(tag, {quoted(lookups.ATTRIBUTE)}) AS attrs FROM (SELECT page_id, unnest(x) AS tag, generate_subscripts(x, 1) AS i FROM (SELECT page_id, regexp_extract_all(CASE WHEN page_id % 2 = 0 THEN {quoted(TAGS)} ELSE '' END || html, {quoted(lookups.META)}) AS x FROM ({PAGES_RICH})))"
_key = "coalesce(" + ", ".join(f"nullif({lookups.attribute(n).sql}, '')" for n in lookups.NAMED_BY) + ")"
Q["meta_values"] = lambda spark, sf_dir: lookups.meta_values(pq.spread(pages_rich(spark, sf_dir)).withColumn("html", F.concat(F.when(F.col("page_id") % 2 == 0, TAGS).otherwise(""), "html")))
S["meta_values"] = f"SELECT page_id, key, arg_max(value, i) AS value FROM (SELECT page_id, i, {_key} AS key, regexp_replace({lookups.attribute('content').sql}, '^\\s+|\\s+$', '', 'g') AS value FROM ({_attrs})) WHERE key IS NOT NULL AND value <> '' GROUP BY 1, 2"

Q["katex_summary"] = lambda spark, sf_dir: lookups.error_counts(pq.pages(spark, sf_dir), pq.katex_errors(spark, sf_dir))
S["katex_summary"] = f"SELECT CAST(count(*) AS BIGINT) AS pages, CAST(count(*) FILTER (n IS NULL) AS BIGINT) AS clean, CAST(count(n) AS BIGINT) AS with_errors, CAST(coalesce(sum(n), 0) AS BIGINT) AS errors FROM pages p LEFT JOIN (SELECT page_id, count(*) AS n FROM ({pq.S['katex_errors']}) GROUP BY 1) e ON e.page_id = p.page_id"


def fix_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = mdx_docs(spark, sf_dir)
    h1 = rewrite.duplicate_h1(docs).select("path", F.col("changed").cast("long").alias("changes"))
    moved = Q_REDIRECTS(spark, sf_dir).select("path", F.col("replacements").alias("changes"))
    tags = rewrite.void_tag_counts(docs).select("path", F.col("void_tags").alias("changes"))
    return lookups.fix_totals({"h1": h1, "redirects": moved, "void-tags": tags})


Q_REDIRECTS = dq.Q["fix_redirects"]
Q["fix_totals"] = fix_totals
_fix = lambda rule, sql, n: f"SELECT '{rule}' AS rule, CAST(sum({n}) AS BIGINT) AS changes, CAST(count(*) FILTER ({n} > 0) AS BIGINT) AS files FROM ({sql})"
S["fix_totals"] = " UNION ALL ".join([_fix("h1", dq.S["fix_h1"], "CAST(changed AS INT)"), _fix("redirects", dq.S["fix_redirects"], "replacements"), _fix("void-tags", dq.S["fix_void_tags_count"], "void_tags")])
