"""Registered queries over pages: features, classification, site reports, crawl frontier."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import urls
from ..functions.dual import Dual, quoted
from ..operators import features, report
from .views import PAGES_RICH, pages_rich

Q: dict = {}
S: dict = {}
RICH = f"({features.analyze_sql(PAGES_RICH)})"


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def spread(df: DataFrame, key: str = "page_id") -> DataFrame:
    """Deal rows over all cores where the file has fewer splits than there are; regular expressions are what costs."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n, key) if df.rdd.getNumPartitions() < n else df


def analyzed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.analyze(spread(pages_rich(spark, sf_dir)))


def add(name: str, sql: str):
    def put(f):
        Q[name] = f
        S[name] = sql
        return f

    return put


def select_query(name: str, columns: list[str], source: str = RICH, frame=analyzed) -> None:
    Q[name] = lambda spark, sf_dir: frame(spark, sf_dir).select(*columns)
    S[name] = f"SELECT {', '.join(columns)} FROM {source}"


select_query("page_features_core", ["page_id", "title", "word_count", "h1", "h2", "h3", "h4", "h5", "h6", "tables", "table_rows", "ordered_lists", "unordered_lists"])
select_query("page_component_counts", ["page_id", "tabs", "accordions", "tab_components", "code_groups", "accordion_components", "cards", "steps", "definitions", "embeds", "badges", "tooltips", "math", "diagrams", "api_fields", "columns", "forms", "iframes"])
select_query("page_callout_variants", ["page_id", "callout_total", "callout_warning", "callout_tip", "callout_info", "callout_danger", "callout_check", "callout_note"])
select_query("page_platform_format", ["page_id", "platform", "content_format", "is_homepage", "has_pagination", "has_language_switcher", "breadcrumb_depth"])
select_query("page_api_signals", ["page_id", "api_playgrounds", "graphql_explorers", "api_signals", "is_api_reference", "method_mentions", "url_playground"])
select_query("page_api_score", ["page_id", "api_confidence", "api_type"])
select_query("page_is_doc", ["page_id", "is_doc"])
select_query("page_media_counts", ["page_id", "images", "external_images", "videos", "video_youtube", "video_vimeo", "video_loom", "video_wistia", "html5_videos", "downloads"])


def lists_query(name: str, columns: list[str]) -> None:
    Q[name] = lambda spark, sf_dir: analyzed(spark, sf_dir).select("page_id", *[F.array_join(c, "|").alias(c) for c in columns])
    S[name] = f"SELECT page_id, {', '.join(f'array_to_string({c}, chr(124)) AS {c}' for c in columns)} FROM {RICH}"


lists_query("page_code_languages", ["languages"])
lists_query("page_api_refs", ["api_refs", "openapi_specs", "playground_types", "api_tools", "auth_methods"])
lists_query("page_endpoints", ["api_endpoints"])
lists_query("page_external_links", ["external_links"])
lists_query("page_download_extensions", ["download_extensions"])


def url_query(name: str, parts: dict[str, Dual]) -> None:
    Q[name] = lambda spark, sf_dir: pages(spark, sf_dir).select("page_id", *[d.column.alias(n) for n, d in parts.items()])
    S[name] = f"SELECT page_id, {', '.join(f'{d.sql} AS {n}' for n, d in parts.items())} FROM pages"


url_query("page_url_normalized", {"normalized": urls.normalized()})
url_query("page_url_parts", {"origin": urls.origin(), "host": urls.host(), "path": urls.path(), "label": urls.label(), "project": urls.project_name(), "scope_prefix": urls.scope_prefix(), "slug": urls.page_slug()})
url_query("page_nondoc_flag", {"non_doc": urls.is_non_doc()})


@add("site_summary", f"SELECT regexp_replace(lower(regexp_extract(url, {quoted(urls.HOST)}, 1)), ':[0-9]*$', '') AS host, CAST(count(*) AS BIGINT) AS pages, CAST(sum(word_count) AS BIGINT) AS words, CAST(sum(h1 + h2 + h3 + h4 + h5 + h6) AS BIGINT) AS headings, CAST(sum(lists) AS BIGINT) AS lists, CAST(sum(CASE WHEN is_doc THEN 1 ELSE 0 END) AS BIGINT) AS doc_pages FROM ({features.analyze_sql('SELECT page_id, url, html FROM pages')}) GROUP BY 1")
def site_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per host: pages, words, headings, lists, documentation pages."""
    made = features.analyze(spread(pages(spark, sf_dir)))
    return made.groupBy(urls.host().column.alias("host")).agg(
        F.count("*").alias("pages"), F.sum("word_count").alias("words"), F.sum(F.expr("h1 + h2 + h3 + h4 + h5 + h6")).alias("headings"), F.sum("lists").alias("lists"), F.count_if("is_doc").alias("doc_pages")
    )


# --- report ---------------------------------------------------------------------------------


def totals_sql() -> str:
    sums = ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in report.SUMS)
    flags = ", ".join(f"bool_or({c}) AS {c}" for c in report.ANY)
    counts = ", ".join(f"CAST(sum(CASE WHEN {c} THEN 1 ELSE 0 END) AS BIGINT) AS {n}" for n, c in report.COUNTED.items())
    return f"SELECT CAST(count(*) AS BIGINT) AS total_pages, {sums}, {flags}, {counts}, coalesce(floor(avg(CASE WHEN breadcrumb_depth > 0 THEN breadcrumb_depth END) * 10 + 0.5) / 10, 0.0) AS avg_breadcrumb FROM {RICH}"


Q["scoping_report_totals"] = lambda spark, sf_dir: report.totals(analyzed(spark, sf_dir))
S["scoping_report_totals"] = totals_sql()

TOTALS = f"({totals_sql()})"


def ranked(name: str, column: str, out: str, limit: int | None = None) -> None:
    """How many pages have each value of a list, most first, ties by where it was first seen."""
    Q[name] = lambda spark, sf_dir: report.value_counts(analyzed(spark, sf_dir), column, out, limit)
    S[name] = (
        f"SELECT {out}, CAST(count(*) AS BIGINT) AS pages, CAST(row_number() OVER (ORDER BY count(*) DESC, min(row(page_id, i))) AS BIGINT) AS rank FROM (SELECT page_id, unnest({column}) AS {out}, unnest(range(len({column}))) AS i FROM {RICH}) GROUP BY 1"
        + (f" QUALIFY rank <= {limit}" if limit else "")
    )


ranked("code_language_counts", "languages", "language")
ranked("download_extension_counts", "download_extensions", "extension")
ranked("openapi_spec_counts", "openapi_specs", "spec")
ranked("api_tool_counts", "api_tools", "tool")
ranked("playground_type_counts", "playground_types", "playground")
ranked("auth_method_counts", "auth_methods", "method")
ranked("api_ref_counts", "api_refs", "ref", 5)
ranked("endpoint_counts", "api_endpoints", "endpoint", 20)


@add("external_domains_topk", f"SELECT domain, CAST(count(*) AS BIGINT) AS links, regexp_matches(domain, '(?i)help|support|zendesk|freshdesk|intercom') AS help_center, CAST(row_number() OVER (ORDER BY count(*) DESC, min(row(page_id, i))) AS BIGINT) AS rank FROM (SELECT page_id, i, regexp_extract(u, '^https?://([^/?#:]+)', 1) AS domain FROM (SELECT page_id, unnest(external_links) AS u, unnest(range(len(external_links))) AS i FROM {RICH})) GROUP BY 1 QUALIFY rank <= 30")
def external_domains_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.external_domains(analyzed(spark, sf_dir), 30)


def melted(names: list[str], columns: list[str], out: str) -> str:
    return " UNION ALL ".join(f"SELECT page_id, {quoted(n)} AS {out}, {c} AS n FROM f" for n, c in zip(names, columns, strict=True))


EMBED_COLUMNS = [f"embed_{i}" for i in range(len(P.EMBEDS))]


@add("embed_providers", f"WITH f AS (SELECT * FROM {RICH}) SELECT provider, CAST(sum(n) AS BIGINT) AS total, CAST(sum(CASE WHEN n > 0 THEN 1 ELSE 0 END) AS BIGINT) AS pages FROM ({melted(list(P.EMBEDS), EMBED_COLUMNS, 'provider')}) GROUP BY 1 HAVING sum(n) > 0")
def embed_providers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.melt_totals(analyzed(spark, sf_dir), dict(zip(P.EMBEDS, EMBED_COLUMNS, strict=True)), "provider")


@add("widget_totals", f"WITH f AS (SELECT * FROM {RICH}) SELECT widget, CAST(sum(n) AS BIGINT) AS total, CAST(sum(CASE WHEN n > 0 THEN 1 ELSE 0 END) AS BIGINT) AS pages FROM ({melted(list(P.WIDGETS), [f'widget_{w}' for w in P.WIDGETS], 'widget')}) GROUP BY 1 HAVING sum(n) > 0")
def widget_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.melt_totals(analyzed(spark, sf_dir), {w: f"widget_{w}" for w in P.WIDGETS}, "widget")


@add("video_type_counts", f"WITH f AS (SELECT * FROM {RICH}) SELECT kind, CAST(sum(n) AS BIGINT) AS total, CAST(sum(CASE WHEN n > 0 THEN 1 ELSE 0 END) AS BIGINT) AS pages FROM ({melted([*P.VIDEO_HOSTS, 'html5-video'], [*(f'video_{v}' for v in P.VIDEO_HOSTS), 'html5_videos'], 'kind')}) GROUP BY 1 HAVING sum(n) > 0")
def video_type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.melt_totals(analyzed(spark, sf_dir), {v: f"video_{v}" for v in P.VIDEO_HOSTS} | {"html5-video": "html5_videos"}, "kind")


TAGS = r"(?i)<([a-z]+-[a-z0-9-]+)[\s>]"


def tag_sql(k: int) -> str:
    return f"SELECT page_id, tag, CAST(count(*) AS BIGINT) AS n, min(i) AS first_at, CAST(row_number() OVER (PARTITION BY page_id ORDER BY count(*) DESC, min(i)) AS BIGINT) AS rank FROM (SELECT page_id, lower(unnest(t)) AS tag, unnest(range(len(t))) AS i FROM (SELECT page_id, regexp_extract_all(html, {quoted(TAGS)}, 1) AS t FROM ({PAGES_RICH}))) WHERE NOT starts_with(tag, 'x-') GROUP BY 1, 2 QUALIFY rank <= {k}"


def tags_per_page(spark: SparkSession, sf_dir: str, k: int = 20) -> DataFrame:
    return report.top_matches(spread(pages_rich(spark, sf_dir)), TAGS, "tag", k, drop="^x-")


Q["tag_topk_per_page"] = lambda spark, sf_dir: tags_per_page(spark, sf_dir).select("page_id", "tag", "n", "rank")
S["tag_topk_per_page"] = f"SELECT page_id, tag, n, rank FROM ({tag_sql(20)})"
Q["tag_topk_global"] = lambda spark, sf_dir: tags_per_page(spark, sf_dir).groupBy("tag").agg(F.sum("n").alias("total"), F.count("*").alias("pages")).orderBy(F.desc("total"), "tag").limit(40)
S["tag_topk_global"] = f"SELECT tag, CAST(sum(n) AS BIGINT) AS total, CAST(count(*) AS BIGINT) AS pages FROM ({tag_sql(20)}) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 40"

BEM = r"""(?i)class="[^"]*([a-z]+-(?:box|panel|card|section|block|widget|container|wrapper))[^"]*\""""
DATA = r"""(?i)data-(?:component|widget|type)="([^"]+)\""""


def top_sql(pattern: str, out: str, k: int) -> str:
    return f"SELECT page_id, {out}, CAST(count(*) AS BIGINT) AS n, CAST(row_number() OVER (PARTITION BY page_id ORDER BY count(*) DESC, min(i)) AS BIGINT) AS rank FROM (SELECT page_id, lower(unnest(t)) AS {out}, unnest(range(len(t))) AS i FROM (SELECT page_id, regexp_extract_all(html, {quoted(pattern)}, 1) AS t FROM ({PAGES_RICH}))) GROUP BY 1, 2 QUALIFY rank <= {k}"


Q["content_components"] = lambda spark, sf_dir: report.top_matches(spread(pages_rich(spark, sf_dir)), BEM, "kind", 15).select("page_id", "kind", "n", "rank", F.when(F.col("n") >= 3, "high").otherwise("medium").alias("confidence"))
S["content_components"] = f"SELECT *, CASE WHEN n >= 3 THEN 'high' ELSE 'medium' END AS confidence FROM ({top_sql(BEM, 'kind', 15)})"
Q["data_components"] = lambda spark, sf_dir: report.top_matches(spread(pages_rich(spark, sf_dir)), DATA, "kind", 10).select("page_id", "kind", "n", "rank", F.when(F.col("n") >= 2, "high").otherwise("low").alias("confidence"))
S["data_components"] = f"SELECT *, CASE WHEN n >= 2 THEN 'high' ELSE 'low' END AS confidence FROM ({top_sql(DATA, 'kind', 10)})"

CUSTOM_SQL = f"SELECT name, CAST(sum(n) AS BIGINT) AS total, CAST(count(DISTINCT page_id) AS BIGINT) AS pages FROM (SELECT page_id, tag AS name, n FROM ({tag_sql(20)}) UNION ALL SELECT page_id, '.' || kind AS name, n FROM ({top_sql(BEM, 'kind', 15)})) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 40"


def custom(spark: SparkSession, sf_dir: str) -> DataFrame:
    rich = spread(pages_rich(spark, sf_dir))
    return report.custom_components(tags_per_page(spark, sf_dir), report.top_matches(rich, BEM, "kind", 15))


Q["custom_components"] = custom
S["custom_components"] = CUSTOM_SQL

PER_PAGE = "SELECT page_id, url, is_api_reference, len(api_tools) AS tools, widgets, " + " + ".join(f"CASE WHEN {c} > 0 THEN 1 ELSE 0 END" for c in report.KINDS.values()) + " AS kinds, " + " + ".join(report.KINDS.values()) + f" AS total FROM {RICH}"


@add("complex_pages_topk", f"SELECT page_id, CAST(kinds AS BIGINT) AS kinds, CAST(total AS BIGINT) AS total FROM ({PER_PAGE}) WHERE kinds > 0 ORDER BY kinds DESC, total DESC, page_id LIMIT 20")
def complex_pages_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.per_page(analyzed(spark, sf_dir)).filter("kinds > 0").orderBy(F.desc("kinds"), F.desc("total"), "page_id").limit(20).select("page_id", "kinds", "total")


REASONS = "array_to_string(list_filter([CASE WHEN kinds >= 3 THEN 'Multiple component types' END, CASE WHEN widgets > 0 THEN 'Interactive widgets' END, CASE WHEN is_api_reference AND tools = 0 THEN 'API reference without tool' END, CASE WHEN total >= 5 THEN 'Many component instances' END], lambda x: x IS NOT NULL), '; ')"


@add("review_pages", f"SELECT page_id, {REASONS} AS reasons, CAST(total AS BIGINT) AS total FROM ({PER_PAGE}) WHERE kinds >= 3 OR widgets > 0 OR is_api_reference AND tools = 0 OR total >= 5 ORDER BY total DESC, page_id LIMIT 50")
def review_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.review(report.per_page(analyzed(spark, sf_dir)))


@add("platform_majority", f"SELECT * FROM (SELECT upper(platform[1]) || platform[2:] AS platform, CAST(n AS BIGINT) AS pages, n / CAST(s AS DOUBLE) AS share, CASE WHEN n / CAST(s AS DOUBLE) > 0.7 THEN 'high' WHEN n / CAST(s AS DOUBLE) > 0.4 THEN 'medium' ELSE 'low' END AS confidence FROM (SELECT platform, count(*) AS n, sum(count(*)) OVER () AS s, min(page_id) AS f FROM {RICH} WHERE platform IS NOT NULL GROUP BY 1) ORDER BY n DESC, f LIMIT 1)")
def platform_majority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.majority(analyzed(spark, sf_dir), "platform")


MIGRATION = f"""WITH f AS (SELECT * FROM {RICH}), t AS (SELECT * FROM {TOTALS}),
c AS (SELECT count(*) AS custom FROM ({CUSTOM_SQL})),
e AS (SELECT {' + '.join(f'CASE WHEN sum({x}) > 0 THEN 1 ELSE 0 END' for x in EMBED_COLUMNS)} AS embeds, {' + '.join(f'CASE WHEN sum(widget_{w}) > 0 THEN 1 ELSE 0 END' for w in P.WIDGETS)} AS widgets, {' + '.join(f'CASE WHEN sum(video_{v}) > 0 THEN 1 ELSE 0 END' for v in P.VIDEO_HOSTS)} + CASE WHEN sum(html5_videos) > 0 THEN 1 ELSE 0 END AS videos FROM f)
SELECT score, CASE WHEN score <= 25 THEN 'low' WHEN score <= 50 THEN 'medium' WHEN score <= 75 THEN 'high' ELSE 'very-high' END AS level, greatest(0, least(100, 100 - score)) AS readiness
FROM (SELECT CAST(least(100, 5 * c.custom + 3 * t.api_reference_pages + 8 * e.widgets + 4 * e.embeds + 2 * e.videos + 5 * t.forms + 3 * t.math + 3 * t.diagrams) AS BIGINT) AS score FROM t, c, e)"""


@add("migration_complexity", MIGRATION)
def migration_complexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = analyzed(spark, sf_dir)
    return report.complexity(made, custom(spark, sf_dir))


POINTS_SQL = " UNION ALL ".join(f"SELECT {quoted(n)} AS point, CAST({x} AS BIGINT) AS amount FROM t WHERE {x} > 0" for n, x in report.POINTS.items())


@add("points_of_attention", f"WITH t AS (SELECT * FROM {TOTALS}) {POINTS_SQL}")
def points_of_attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.points(report.totals(analyzed(spark, sf_dir)))


@add("supported_components", "WITH t AS (SELECT * FROM " + TOTALS + ") " + " UNION ALL ".join(f"SELECT {quoted(n)} AS component, CAST({x} AS BIGINT) AS amount FROM t WHERE {x} > 0" for n, x in report.SUPPORTED.items()))
def supported_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.melted_row(report.totals(analyzed(spark, sf_dir)), report.SUPPORTED, "component")


# --- links and frontier -----------------------------------------------------------------------

ROOT_LINK = """(?i)<a[^>]+href=["']([^"'#?]+)["'#?]"""
EDGES = f"SELECT page_id, {urls.normalized().sql} AS source, href FROM (SELECT page_id, url, unnest(regexp_extract_all(html, {quoted(ROOT_LINK)}, 1)) AS href FROM ({PAGES_RICH})) WHERE NOT regexp_matches(href, '^(javascript:|mailto:|#)')"
FULL = f"SELECT DISTINCT page_id, source, CASE WHEN starts_with(href, 'http') THEN href ELSE regexp_extract(source, '^(https?://[^/]+)', 1) || href END AS url FROM ({EDGES}) WHERE starts_with(href, '/') OR starts_with(href, 'http')"
LINKS = f"SELECT DISTINCT page_id, source, {urls.normalized().sql} AS target FROM ({FULL}) WHERE NOT ({urls.is_non_doc().sql}) AND {urls.origin().sql} = regexp_extract(source, '^(https?://[^/]+)', 1)"


def link_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import frontier

    return frontier.link_edges(spread(pages_rich(spark, sf_dir)))


Q["link_edges"] = link_edges
S["link_edges"] = LINKS
Q["link_reverse_index"] = lambda spark, sf_dir: link_edges(spark, sf_dir).groupBy("target").agg(F.countDistinct("page_id").alias("pages"), F.min("page_id").alias("first_page"))
S["link_reverse_index"] = f"SELECT target, CAST(count(DISTINCT page_id) AS BIGINT) AS pages, min(page_id) AS first_page FROM ({LINKS}) GROUP BY 1"
Q["top_link_targets"] = lambda spark, sf_dir: link_edges(spark, sf_dir).groupBy("target").agg(F.count("*").alias("links")).orderBy(F.desc("links"), "target").limit(30)
S["top_link_targets"] = f"SELECT target, CAST(count(*) AS BIGINT) AS links FROM ({LINKS}) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 30"


def crawl_frontier_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import frontier

    rich = spread(pages_rich(spark, sf_dir))
    return frontier.union_distinct([rich.select(F.col("url")), frontier.link_edges(rich).select(F.col("target").alias("url"))])


Q["crawl_frontier_union"] = crawl_frontier_union
S["crawl_frontier_union"] = f"SELECT DISTINCT {urls.normalized().sql} AS url FROM (SELECT url FROM pages UNION ALL SELECT target AS url FROM ({LINKS})) WHERE NOT ({urls.is_non_doc().sql})"



def crawl_reachable(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import frontier

    edges = link_edges(spark, sf_dir).select("source", "target").unionByName(link_edges(spark, sf_dir).select(F.col("target").alias("source"), F.concat("target", F.lit("/more")).alias("target")))
    seeds = pages(spark, sf_dir).select(urls.normalized().column.alias("url"))
    return frontier.reachable(seeds, edges, most_depth=4)


Q["crawl_reachable"] = crawl_reachable
S["crawl_reachable"] = f"WITH RECURSIVE l AS (SELECT source, target FROM ({LINKS})), e AS (SELECT source, target FROM l UNION SELECT target, target || '/more' FROM l), r AS (SELECT {urls.normalized().sql} AS url, 0 AS depth FROM pages UNION SELECT e.target, r.depth + 1 FROM r JOIN e ON e.source = r.url WHERE r.depth < 4) SELECT url, CAST(min(depth) AS BIGINT) AS depth FROM r GROUP BY 1"

META = r"""(?i)<meta[^>]+(?:property|name|itemprop)=["']([\w:-]+)["'][^>]*\scontent=["']([^"']*)["']"""


@add("meta_tags", f"SELECT page_id, key, trim(regexp_extract(tag, {quoted(META)}, 2)) AS value FROM (SELECT page_id, tag, regexp_extract(tag, {quoted(META)}, 1) AS key, row_number() OVER (PARTITION BY page_id, regexp_extract(tag, {quoted(META)}, 1) ORDER BY i DESC) AS r FROM (SELECT page_id, unnest(t) AS tag, unnest(range(len(t))) AS i FROM (SELECT page_id, regexp_extract_all(html, {quoted(META)}, 0) AS t FROM ({PAGES_RICH}))) WHERE trim(regexp_extract(tag, {quoted(META)}, 2)) <> '') WHERE r = 1")
def meta_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.meta_tags(spread(pages_rich(spark, sf_dir)), META)


KATEX = r"""(?i)<span[^>]*class="[^"]*katex-error[^"]*"[^>]*title="([^"]*)"[^>]*>([\s\S]*?)</span>"""


@add("katex_errors", f"SELECT page_id, regexp_extract(x, {quoted(KATEX)}, 1) AS title, regexp_extract(x, {quoted(KATEX)}, 2) AS content FROM (SELECT page_id, unnest(regexp_extract_all(html, {quoted(KATEX)}, 0)) AS x FROM ({PAGES_RICH}))")
def katex_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rich = spread(pages_rich(spark, sf_dir))
    found = rich.select("page_id", F.explode(F.regexp_extract_all("html", F.lit(KATEX), 0)).alias("x"))
    return found.select("page_id", F.regexp_extract("x", KATEX, 1).alias("title"), F.regexp_extract("x", KATEX, 2).alias("content"))


IMG_SQL = f"SELECT page_id, url AS page, unnest(regexp_extract_all(html, {quoted(features.IMAGE)}, 1)) AS src FROM ({PAGES_RICH})"
IMG_FULL = f"SELECT DISTINCT page_id, {urls.image_url('src', 'page').sql} AS image FROM ({IMG_SQL}) WHERE NOT starts_with(src, 'data:')"


def image_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    rich = spread(pages_rich(spark, sf_dir))
    found = rich.select("page_id", F.col("url").alias("page"), F.explode(F.regexp_extract_all("html", F.lit(features.IMAGE), 1)).alias("src")).filter(~F.col("src").startswith("data:"))
    return found.select("page_id", urls.image_url("src", "page").column.alias("image")).distinct()


Q["image_refs"] = lambda spark, sf_dir: image_edges(spark, sf_dir).groupBy("image").agg(F.count("*").alias("pages"), F.min("page_id").alias("first_page"))
S["image_refs"] = f"SELECT image, CAST(count(*) AS BIGINT) AS pages, min(page_id) AS first_page FROM ({IMG_FULL}) GROUP BY 1"

PROBE = "CASE page_id % 10 WHEN 0 THEN 404 WHEN 3 THEN 301 WHEN 7 THEN 429 WHEN 9 THEN NULL ELSE 200 END"


def probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).select("page_id", urls.normalized().column.alias("url"), F.expr(PROBE).alias("status"))


@add("broken_images", f"WITH i AS ({IMG_FULL}), p AS (SELECT image, CASE WHEN length(image) % 3 = 0 THEN 404 ELSE 200 END AS status FROM (SELECT DISTINCT image FROM i)) SELECT p.image, CAST(p.status AS BIGINT) AS status, array_to_string(list_sort(list(i.page_id)), ',') AS referenced_by FROM p JOIN i ON i.image = p.image WHERE NOT (p.status BETWEEN 200 AND 399) GROUP BY 1, 2")
def broken_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images that fail, with the pages that use them: each image is probed once, then joined back."""
    edges = image_edges(spark, sf_dir)
    probed = edges.select("image").distinct().select("image", F.when(F.length("image") % 3 == 0, 404).otherwise(200).cast("long").alias("status"))
    failed = probed.filter(~F.col("status").between(200, 399))
    return failed.join(edges, "image").groupBy("image", "status").agg(F.array_join(F.array_sort(F.collect_list("page_id")), ",").alias("referenced_by"))


@add("probe_summary", f"SELECT CAST(count(*) AS BIGINT) AS total, CAST(sum(CASE WHEN s BETWEEN 200 AND 399 THEN 1 ELSE 0 END) AS BIGINT) AS ok, CAST(sum(CASE WHEN s BETWEEN 200 AND 399 THEN 0 ELSE 1 END) AS BIGINT) AS failed FROM (SELECT {PROBE} AS s FROM pages)")
def probe_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok = F.coalesce(F.col("status").between(200, 399), F.lit(False))
    return probes(spark, sf_dir).agg(F.count("*").alias("total"), F.count_if(ok).alias("ok"), F.count_if(~ok).alias("failed"))


NORMAL = urls.normalized().sql


AGAIN = "CASE page_id % 7 WHEN 0 THEN 500 WHEN 3 THEN NULL ELSE 200 END"
OK = "BETWEEN 200 AND 399"


@add("resume_antijoin", f"SELECT DISTINCT {NORMAL} AS url FROM pages WHERE {NORMAL} NOT IN (SELECT {NORMAL} FROM pages WHERE {PROBE} {OK})")
def resume_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left to check after a first round of probes."""
    from ..operators import resume

    probed = probes(spark, sf_dir)
    return resume.to_check(probed.select("url"), probed.filter(F.col("status").between(200, 399)).select("url"))


@add("resume_merge", f"WITH p AS (SELECT {NORMAL} AS url, {PROBE} AS one, {AGAIN} AS two FROM pages), old AS (SELECT url, max(coalesce(one, -1)) AS status FROM p WHERE NOT coalesce(one {OK}, FALSE) GROUP BY 1), new AS (SELECT url, min(coalesce(two, -1)) AS status FROM p GROUP BY 1) SELECT coalesce(n.url, o.url) AS url, CAST(CASE WHEN n.url IS NOT NULL THEN n.status ELSE o.status END AS BIGINT) AS status FROM old o FULL OUTER JOIN new n ON o.url = n.url WHERE NOT coalesce(n.status {OK}, FALSE)")
def resume_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The failures of a first round after a second one over all pages."""
    from ..operators import resume

    p = pages(spark, sf_dir).select(urls.normalized().column.alias("url"), F.expr(PROBE).alias("one"), F.expr(AGAIN).alias("two"))
    old = p.filter(~F.coalesce(F.col("one").between(200, 399), F.lit(False))).groupBy("url").agg(F.max(F.coalesce("one", F.lit(-1))).alias("status"))
    new = p.groupBy("url").agg(F.min(F.coalesce("two", F.lit(-1))).alias("status"))
    return resume.merge_failures(old, new).select("url", F.col("status").cast("long").alias("status"))


@add("batch_numbers", "SELECT page_id, CAST((row_number() OVER (ORDER BY page_id) - 1) // 100 + 1 AS BIGINT) AS batch FROM pages")
def batch_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import resume

    return resume.batches(pages(spark, sf_dir).select("page_id"), "page_id", 100)


@add("void_tag_counts", f"SELECT page_id, CAST(len(list_filter(regexp_extract_all(html, {quoted(r'(?i)<(?:br|hr|img|input|link|meta|source|track|wbr|area|base|col|embed)(?:[^>]*)>')}), lambda x: NOT regexp_matches(x, '/>$'))) AS BIGINT) AS open_void_tags FROM ({PAGES_RICH})")
def void_tag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pattern = r"(?i)<(?:br|hr|img|input|link|meta|source|track|wbr|area|base|col|embed)(?:[^>]*)>"
    rich = spread(pages_rich(spark, sf_dir))
    return rich.select("page_id", F.size(F.filter(F.regexp_extract_all("html", F.lit(pattern), 0), lambda x: ~x.endswith("/>"))).cast("long").alias("open_void_tags"))


