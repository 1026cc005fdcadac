"""Registered queries of a site's scoping report: components, API documentation, crawl counts, facts and what is judged from them."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import urls
from ..functions.dual import quoted
from ..operators import features, frontier, report, report_text, site_report, specs
from ..sources.shared import cut
from . import page_queries as pq
from .site_queries import S as SITE_S
from .site_queries import pages_specs, sidebar_links
from .views import PAGES_RICH, pages_rich

Q: dict = {}
S: dict = {}
#: The content area that the crawl was told of.
SELECTOR = ".mdx-content, .md-content, #content, article"


def add(name: str, sql: str):
    def put(f):
        Q[name] = f
        S[name] = sql
        return f

    return put


def rich(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pq.spread(pages_rich(spark, sf_dir))


def selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.analyze(rich(spark, sf_dir), SELECTOR)


SELECTED = f"(SELECT * REPLACE (selector_found OR api_playgrounds > 0 OR graphql_explorers > 0 OR len(openapi_specs) > 0 OR len(api_refs) > 0 AS is_doc) FROM (SELECT *, regexp_matches(html, {quoted(features.selector_pattern(SELECTOR))}) AS selector_found FROM {pq.RICH}))"


def content(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = rich(spark, sf_dir)
    return site_report.content(report.top_matches(pages, pq.BEM, "kind", 15), site_report.data_components(pages))


_mark = lambda g: f"regexp_extract(m, {quoted(site_report.DATA)}, {g})"
_data = f"SELECT page_id, 'data:' || {_mark(1)} || ':' || {_mark(2)} AS kind, count(*) AS n, 100 + row_number() OVER (PARTITION BY page_id ORDER BY count(*) DESC, min(i)) AS rank FROM (SELECT page_id, unnest(x) AS m, generate_subscripts(x, 1) AS i FROM (SELECT page_id, regexp_extract_all(html, {quoted(site_report.DATA)}) AS x FROM ({PAGES_RICH}))) GROUP BY 1, 2 QUALIFY rank <= 110"
CONTENT = f"(SELECT page_id, 'semantic:' || kind AS kind, n, rank, CASE WHEN n >= 3 THEN 'high' ELSE 'medium' END AS confidence FROM ({pq.top_sql(pq.BEM, 'kind', 15)}) UNION ALL SELECT page_id, kind, n, rank, CASE WHEN n >= 2 THEN 'high' ELSE 'low' END FROM ({_data}))"
add("content_component_totals", f"SELECT kind, CAST(sum(n) AS BIGINT) AS total, CAST(count(*) AS BIGINT) AS pages, arg_min(confidence, page_id) AS confidence FROM {CONTENT} GROUP BY 1")(lambda spark, sf_dir: site_report.content_totals(content(spark, sf_dir)))


def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_report.components(selected(spark, sf_dir), pq.tags_per_page(spark, sf_dir), content(spark, sf_dir))


_kinds = " UNION ALL ".join(f"SELECT page_id, 0 AS part, {i} AS rank, {quoted(t)} AS type, {c} AS n, 'high' AS confidence FROM f WHERE {c} > 0" for i, (t, c) in enumerate(site_report.KIND_TYPES.items()))
COMPONENTS = f"(WITH f AS (SELECT * FROM {pq.RICH}) {_kinds} UNION ALL SELECT page_id, 1, rank, 'web-component:' || tag, n, 'high' FROM ({pq.tag_sql(20)}) UNION ALL SELECT page_id, 2, rank, kind, n, confidence FROM {CONTENT})"
add("page_component_lists", f"SELECT page_id, CAST(count(*) AS BIGINT) AS types, CAST(sum(n) AS BIGINT) AS total, string_agg(type || '(' || n || ')', ', ' ORDER BY part, rank) AS components FROM {COMPONENTS} GROUP BY 1")(lambda spark, sf_dir: site_report.component_lists(components(spark, sf_dir)))

# --- API documentation --------------------------------------------------------------------------------

_tool = lambda at: "CASE tool " + " ".join(f"WHEN {quoted(t[0])} THEN {str(t[at]).upper()}" for t in P.API_TOOLS) + " END"
DETAILS = f"""(WITH f AS (SELECT * FROM {pq.RICH}), t AS (SELECT page_id, url, unnest(api_tools) AS tool FROM f)
SELECT page_id, url, tool, 'high' AS confidence, {_tool(2)} AS playground, {_tool(3)} AS try_it FROM t
UNION ALL SELECT page_id, url, CASE WHEN regexp_matches(html, '(?i)graphql|__schema|query\\s*\\{{') THEN 'generic-graphql' ELSE 'generic-rest' END, 'medium', api_playgrounds > 0, api_playgrounds > 0 FROM f WHERE len(api_tools) = 0 AND is_api_reference)"""
details = lambda spark, sf_dir: site_report.api_details(pq.analyzed(spark, sf_dir))
add("api_tool_pages", f"SELECT tool, CAST(count(*) AS BIGINT) AS pages, arg_min(confidence, page_id) AS confidence FROM {DETAILS} GROUP BY 1")(lambda spark, sf_dir: site_report.api_tools(details(spark, sf_dir)))
add("api_tried_pages", f"SELECT url, bool_or(playground) AS playground, bool_or(try_it) AS try_it FROM {DETAILS} GROUP BY 1 HAVING bool_or(playground) OR bool_or(try_it)")(lambda spark, sf_dir: site_report.tried_pages(details(spark, sf_dir)))
add("api_type_counts", f"SELECT type, CAST(count(*) AS BIGINT) AS pages FROM (SELECT unnest(CASE WHEN api_type = 'mixed' THEN ['rest', 'graphql'] WHEN api_type IS NOT NULL THEN [api_type] ELSE [] END) AS type FROM {pq.RICH}) GROUP BY 1")(lambda spark, sf_dir: site_report.api_types(pq.analyzed(spark, sf_dir)))
add("spec_urls", f"SELECT url, type, version, valid FROM ({SITE_S['detected_specs']}) QUALIFY row_number() OVER (PARTITION BY url ORDER BY page_id, ord) = 1")(lambda spark, sf_dir: site_report.first_specs(specs.shown(pages_specs(spark, sf_dir))))
add("widget_inputs", pq.S["widget_totals"].replace("SELECT widget,", "SELECT widget, TRUE AS user_input,"))(lambda spark, sf_dir: pq.widget_totals(spark, sf_dir).withColumn("user_input", F.lit(True)))

# --- the crawl ------------------------------------------------------------------------------------------

_host = lambda c: f"regexp_replace(lower(regexp_extract({c}, {quoted(urls.HOST)}, 1)), ':[0-9]*$', '')"
_non = urls.is_non_doc().sql


@add("crawl_totals", f"""WITH p AS (SELECT {_host('url')} AS site, coalesce({_non}, FALSE) AS non, is_doc FROM {SELECTED}), d AS (SELECT {_host('source')} AS site, target AS url FROM ({pq.LINKS}) UNION SELECT {_host('url')}, {urls.normalized().sql} FROM pages),
o AS (SELECT site, sum(CASE WHEN NOT non AND is_doc THEN 1 ELSE 0 END) AS analyzed, sum(CASE WHEN non THEN 1 ELSE 0 END) AS skipped_url, sum(CASE WHEN NOT non AND NOT is_doc THEN 1 ELSE 0 END) AS skipped_non_doc FROM p GROUP BY 1)
SELECT o.site, CAST(coalesce(n, 0) AS BIGINT) AS discovered, CAST(analyzed AS BIGINT) AS analyzed, CAST(skipped_url AS BIGINT) AS skipped_url, CAST(skipped_non_doc AS BIGINT) AS skipped_non_doc FROM o LEFT JOIN (SELECT site, count(DISTINCT url) AS n FROM d GROUP BY 1) d ON d.site = o.site""")
def crawl_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    site = urls.host().column
    links = frontier.link_edges(rich(spark, sf_dir)).select(F.col("source").alias("url"), "target").select(site.alias("site"), F.col("target").alias("url"))
    found = links.unionByName(pq.pages(spark, sf_dir).select(site.alias("site"), urls.normalized().column.alias("url")))
    return site_report.crawl_totals(selected(spark, sf_dir), found, site, F.coalesce(urls.is_non_doc().column, F.lit(False)))


add("selector_match_rates", f"SELECT {_host('url')} AS site, CAST(count(*) AS BIGINT) AS pages, CAST(count(*) FILTER (selector_found) AS BIGINT) AS matched, avg(CAST(selector_found AS INT)) AS rate FROM {SELECTED} GROUP BY 1")(lambda spark, sf_dir: site_report.match_rates(selected(spark, sf_dir), urls.host().column))

# --- facts and judgements ---------------------------------------------------------------------------------

_some = lambda columns: " + ".join(f"CASE WHEN sum({c}) > 0 THEN 1 ELSE 0 END" for c in columns)
_listed = lambda sql, name, n, out: f"SELECT coalesce(string_agg({name} || ': ' || {n}, ', ' ORDER BY {n} DESC, {name}), '') AS {out} FROM ({sql})"
_sum = lambda c: f"CAST(coalesce(sum({c}), 0) AS BIGINT)"
FACTS = f"""(WITH f AS (SELECT * FROM {SELECTED}), a AS (SELECT {_sum("len(list_filter(external_links, lambda u: regexp_matches(regexp_extract(u, '^https?://([^/?#:]+)', 1), " + quoted(site_report.HELP) + ")))")} AS help_links,
 count(*) FILTER (math > 0) AS math_pages, count(*) FILTER (diagrams > 0) AS diagram_pages, count(*) FILTER (code_playgrounds > 0) AS playground_pages, {_sum('len(api_endpoints)')} AS endpoints, count(*) FILTER (content_format = 'mdx') AS mdx_pages,
 {_some(pq.EMBED_COLUMNS)} AS embed_types, {_some([f'widget_{w}' for w in P.WIDGETS])} AS widget_types, {_some([*(f'video_{v}' for v in P.VIDEO_HOSTS), 'html5_videos'])} AS video_types, avg(CAST(selector_found AS INT)) AS match_rate FROM f)
SELECT * FROM {pq.TOTALS}, a, (SELECT count(*) AS custom_types, {_sum('total')} AS custom_total FROM ({pq.CUSTOM_SQL})), (SELECT count(DISTINCT kind) AS content_types, {_sum('n')} AS content_total FROM {CONTENT}),
 (SELECT count(*) AS component_pages, count(*) FILTER (t >= 3) AS complex_pages, coalesce(max(t), 0) AS most_types FROM (SELECT count(*) AS t FROM {COMPONENTS} GROUP BY page_id)), (SELECT count(DISTINCT s) AS spec_links FROM (SELECT unnest(openapi_specs) AS s FROM f)),
 (SELECT count(*) AS api_ref_kinds, coalesce(string_agg(r, '; ' ORDER BY r), '') AS api_ref_list FROM (SELECT DISTINCT unnest(api_refs) AS r FROM f)), ({_listed(pq.S['embed_providers'], 'provider', 'total', 'embed_list')}), ({_listed(pq.S['video_type_counts'], 'kind', 'total', 'video_list')}),
 ({_listed('SELECT e, count(*) AS n FROM (SELECT unnest(download_extensions) AS e FROM f) GROUP BY 1', 'e', 'n', 'download_list')}))"""


class Site(NamedTuple):
    """A site's analysis, each part written once, and its facts, one row."""

    pages: DataFrame
    custom: DataFrame
    facts: DataFrame

    @property
    def sides(self) -> DataFrame:
        embeds = report.melt_totals(self.pages, dict(zip(P.EMBEDS, pq.EMBED_COLUMNS, strict=True)), "name")
        return site_report.compatibility(self.facts, self.custom, embeds)

    @property
    def judged(self) -> DataFrame:
        return site_report.judged(self.facts, cut(self.sides))


def site(spark: SparkSession, sf_dir: str) -> Site:
    html = rich(spark, sf_dir)
    pages = cut(site_report.narrowed(features.analyze(html, SELECTOR)))
    semantic, tags = cut(report.top_matches(html, pq.BEM, "kind", 15)), cut(pq.tags_per_page(spark, sf_dir))
    found = cut(site_report.content(semantic, site_report.data_components(html)))
    custom = cut(report.custom_components(tags, semantic))
    return Site(pages, custom, cut(site_report.facts(pages, custom, found, site_report.components(pages, tags, found))))


add("attention_rows", f"WITH t AS (SELECT * FROM {FACTS}) " + " UNION ALL ".join(f"SELECT CAST({i} AS BIGINT) AS ord, {quoted(k)} AS type, CAST({n} AS BIGINT) AS amount, {d} AS description FROM t WHERE {n} > 0" for i, (k, n, d) in enumerate(site_report.ATTENTION)))(
    lambda spark, sf_dir: site_report.told(site(spark, sf_dir).facts, site_report.ATTENTION)
)
_impact = lambda n, w, high, medium: "'low'" if high is None else f"CASE WHEN {w} * {n} > {high} THEN 'high' WHEN {w} * {n} > {medium} THEN 'medium' ELSE 'low' END"
add("complexity_factors", f"WITH t AS (SELECT * FROM {FACTS}) " + " UNION ALL ".join(f"SELECT {quoted(k)} AS name, CAST({n} AS BIGINT) AS n, {_impact(n, w, h, m)} AS impact, CAST({n} AS VARCHAR) || ' {words}' AS description FROM t WHERE {n} > 0" for k, n, w, h, m, words in site_report.FACTORS))(
    lambda spark, sf_dir: site_report.factors(site(spark, sf_dir).facts)
)


_names = ", ".join(map(quoted, site_report.NAMES))
SIDES = f"""(WITH t AS (SELECT * FROM {FACTS}), h AS ({' UNION ALL '.join(f"SELECT {quoted(n)} AS name, {quoted(d)} AS detected_as, CAST({x} AS BIGINT) AS amount FROM t WHERE {x} > 0" for n, d, x in site_report.SUPPORTED)}),
c AS (SELECT name, total, [{_names}][list_position(list_transform([{_names}], lambda x: lower(x)), lower(replace(name, '-', '')))] AS known FROM ({pq.CUSTOM_SQL}))
SELECT TRUE AS supported, name, detected_as, amount FROM h UNION ALL SELECT TRUE, known, '<' || arg_min(name, row(-total, name)) || '>', max(total) FROM c WHERE known IS NOT NULL AND known NOT IN (SELECT name FROM h) GROUP BY known
UNION ALL SELECT FALSE, name, NULL, total FROM c WHERE known IS NULL UNION ALL SELECT FALSE, 'embed:' || provider, NULL, total FROM ({pq.S['embed_providers']})
UNION ALL SELECT FALSE, 'math-formulas', NULL, CAST(math AS BIGINT) FROM t WHERE math > 0 UNION ALL SELECT FALSE, 'diagrams', NULL, CAST(diagrams AS BIGINT) FROM t WHERE diagrams > 0)"""
add("compatibility_rows", f"SELECT * FROM {SIDES}")(lambda spark, sf_dir: site(spark, sf_dir).sides)
READY = ["score", "level", "readiness", "supported_share", "custom_share", "clean_pages", "complex_pages", "supported_types", "custom_builds", "compatibility", "structure"]
_flags = f"list_filter([{', '.join(f'CASE WHEN {when} THEN {words} END' for when, words in site_report.FLAGS)}], lambda x: x IS NOT NULL)"
JUDGED = f"""(WITH t AS (SELECT *, CAST({site_report.SCORE} AS BIGINT) AS score FROM {FACTS}, (SELECT count(*) FILTER (supported) AS supported_types, count(*) FILTER (NOT supported) AS custom_builds FROM {SIDES})), j AS (SELECT *, {', '.join(f'{x} AS {c}' for c, x in site_report.JUDGED.items())}, {_flags} AS flags FROM t) SELECT *, {site_report.STRUCTURE.format(n='len(flags)')} AS structure FROM j)"""


_long = [c for c in READY if c in ("readiness", "clean_pages", "complex_pages", "supported_types", "custom_builds")]
add("migration_readiness", f"SELECT {', '.join(f'CAST({c} AS BIGINT) AS {c}' if c in _long else f'CAST({c} AS DOUBLE) AS {c}' if c.endswith('share') else c for c in READY)}, array_to_string(flags, '; ') AS flags FROM {JUDGED}")(
    lambda spark, sf_dir: site(spark, sf_dir).judged.select(*[F.col(c).cast("long").alias(c) if c in _long else F.col(c).cast("double").alias(c) if c.endswith("share") else F.col(c) for c in READY], F.array_join("flags", "; ").alias("flags"))
)
_in = lambda names: ", ".join(map(quoted, names))
add("content_source", f"SELECT platform, CASE WHEN lower(platform) IN ({_in(site_report.MDX_PLATFORMS)}) OR lower(platform) = 'docusaurus' AND mdx > total * 0.3 THEN 'Existing MDX files' WHEN lower(platform) IN ('docusaurus', {_in(site_report.CONVERTED)}) THEN 'HTML/Markdown conversion needed' ELSE 'Needs full scraping' END AS source FROM ({pq.S['platform_majority']}), (SELECT count(*) AS total, count(*) FILTER (content_format = 'mdx') AS mdx FROM {pq.RICH})")(
    lambda spark, sf_dir: site_report.content_source(pq.platform_majority(spark, sf_dir), pq.analyzed(spark, sf_dir).agg(F.count("*").alias("total_pages"), F.count_if(F.col("content_format") == "mdx").alias("mdx_pages")))
)
add("site_structure", f"SELECT homepage, CAST(n AS BIGINT) AS sidebar_items, CASE WHEN n > 5 THEN 'Standard sidebar' WHEN n > 0 THEN 'Needs review' ELSE 'Requires custom' END AS structure FROM (SELECT arg_min(url, page_id) FILTER (is_homepage) AS homepage FROM {pq.RICH}), (SELECT count(*) AS n FROM ({SITE_S['sidebar_links']}))")(
    lambda spark, sf_dir: site_report.structure(pq.analyzed(spark, sf_dir), sidebar_links(spark, sf_dir))
)


@add("scoping_report_text", report_text.written_sql(f"""(SELECT * FROM {JUDGED}, (SELECT coalesce(string_agg('  <' || name || '>: ' || total || ' instances', chr(10) ORDER BY total DESC, name), '') AS custom_lines FROM ({pq.CUSTOM_SQL})),
(SELECT coalesce(string_agg('  ' || domain || ': ' || links || ' links', chr(10) ORDER BY rank), '') AS domain_lines FROM ({pq.S['external_domains_topk']}) WHERE rank <= {report_text.DOMAINS}), (SELECT count(DISTINCT {_host('url')}) AS sites FROM pages))"""))
def scoping_report_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = site(spark, sf_dir)
    return report_text.written(made.judged, made.custom, pq.external_domains_topk(spark, sf_dir), made.pages.select(urls.host().column.alias("site")).distinct())
