"""What a scoping report says of a whole site: components of each page, API documentation, crawl counts, and from one row of facts the points of
attention, compatibility, readiness, complexity and the report's text.

Pages are summed in one pass; lists of tools, providers and kinds are as long as the detectors are many, so they join as one row by one row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import patterns as P
from . import report

#: How a page's list names each kind of component.
KIND_TYPES = {
    "callout": "callout_total", "tabs": "tab_components", "code-group": "code_groups", "accordion": "accordion_components", "card": "cards", "steps": "steps", "definition": "definitions",
    "embed": "embeds", "badge": "badges", "tooltip": "tooltips", "math": "math", "mermaid": "diagrams", "api-field": "api_fields", "columns": "columns",
}
#: Component names that a custom tag may carry with hyphens and in any case.
NAMES = [
    "Accordion", "AccordionGroup", "Card", "CardGroup", "CodeBlock", "CodeGroup", "Tabs", "Tab", "Note", "Warning", "Info", "Tip", "Check", "Danger", "Frame", "Steps", "Step", "Tooltip",
    "ResponseField", "ParamField", "Expandable",
]
#: Which component stands for what was detected, and how much of it there is in the facts.
SUPPORTED = [
    ("Note", "Callout (note)", "callout_note"), ("Warning", "Callout (warning)", "callout_warning"), ("Tip", "Callout (tip)", "callout_tip"), ("Info", "Callout (info)", "callout_info"),
    ("Warning", "Callout (danger → Warning)", "callout_danger"), ("Check", "Callout (success)", "callout_check"), ("Tabs", "Platform tabs", "tab_components"),
    ("Tabs", "Tab containers", "CASE WHEN tab_components = 0 THEN tabs ELSE 0 END"), ("CodeGroup", "Code groups (tabs with code)", "code_groups"), ("Accordion", "Accordion / collapsible", "accordion_components"),
    ("Accordion", "Collapsible sections", "CASE WHEN accordion_components = 0 THEN accordions ELSE 0 END"), ("Card / CardGroup", "Card groups", "cards"), ("Steps", "Step sequences", "steps"),
    ("ResponseField / ParamField", "Definition lists", "definitions"), ("Frame", "Embedded iframes / video", "embeds"), ("Badge", "Badges / Tags", "badges"), ("Tooltip", "Tooltips", "tooltips"),
    ("ResponseField / ParamField", "API Parameter fields", "api_fields"), ("Math / Formulas", "LaTeX / Math block", "math"), ("Mermaid", "Mermaid Diagrams", "diagrams"), ("Grid / Columns", "Column layouts", "columns"),
    ("CodeBlock", "Code blocks", "code_blocks"), ("Tooltip", "Tooltip elements", "tooltips"),
]
S = lambda x: f"CAST({x} AS STRING)"
PLURAL = lambda x: f"CASE WHEN {x} <> 1 THEN 's' ELSE '' END"
PARTS = f"CASE WHEN custom_types > 0 THEN {S('custom_types')} || ' web component types (' || {S('custom_total')} || ' instances)' ELSE '' END || CASE WHEN custom_types > 0 AND content_types > 0 THEN ', ' ELSE '' END || CASE WHEN content_types > 0 THEN {S('content_types')} || ' content component types (' || {S('content_total')} || ' instances)' ELSE '' END || CASE WHEN component_pages > 0 THEN ' across ' || {S('component_pages')} || ' pages' ELSE '' END"
#: A point's name, its amount (nothing is said of 0) and its words, in the report's order.
ATTENTION = [
    ("videos", "videos", f"{S('videos')} || ' embedded videos found (' || video_list || ')'"),
    ("help-center", "help_links", f"{S('help_links')} || ' references to help center / support platforms'"),
    ("api-docs", "api_ref_kinds", "'API documentation detected: ' || api_ref_list"),
    ("custom-components", "custom_total + content_total", f"{S('custom_types + content_types')} || ' custom component types found: ' || {PARTS}"),
    ("pages-with-mixed-components", "complex_pages", f"{S('complex_pages')} || ' page' || {PLURAL('complex_pages')} || ' with 3+ different component types (max ' || {S('most_types')} || ' types on one page)'"),
    ("third-party-embeds", "embeds", f"{S('embeds')} || ' third-party code embeds found (' || embed_list || ')'"),
    ("math-content", "math_pages", f"{S('math_pages')} || ' page' || {PLURAL('math_pages')} || ' with mathematical formulas (MathJax/KaTeX)'"),
    ("diagrams", "diagram_pages", f"{S('diagram_pages')} || ' page' || {PLURAL('diagram_pages')} || ' with diagrams (Mermaid/PlantUML/etc.)'"),
    ("api-reference-pages", "api_reference_pages", f"{S('api_reference_pages')} || ' page' || {PLURAL('api_reference_pages')} || ' detected as API reference pages'"),
    ("code-playgrounds", "code_playgrounds", f"{S('code_playgrounds')} || ' embedded code playgrounds across ' || {S('playground_pages')} || ' page' || {PLURAL('playground_pages')}"),
    ("download-links", "downloads", f"{S('downloads')} || ' downloadable files found (' || download_list || ')'"),
    ("tables", "complex_table_pages", f"{S('complex_table_pages')} || ' pages with complex tables (>5 rows)'"),
    ("forms", "forms", f"{S('forms')} || ' forms detected across pages'"),
    ("iframes", "iframes", f"{S('iframes')} || ' non-video iframes detected'"),
    ("code-heavy", "code_heavy_pages", f"{S('code_heavy_pages')} || ' pages with >5 code blocks'"),
    ("openapi-specs", "spec_links", f"{S('spec_links')} || ' OpenAPI/Swagger spec references found'"),
    ("api-playgrounds", "api_playgrounds", f"{S('api_playgrounds')} || ' interactive API playground widgets'"),
    ("multi-language", "CASE WHEN has_language_switcher THEN 1 ELSE 0 END", "'Site has language switcher / multi-language content'"),
    ("pagination", "CASE WHEN has_pagination THEN 1 ELSE 0 END", "'Paginated content detected'"),
    ("tooltips", "tooltips", f"{S('tooltips')} || ' tooltips detected across pages'"),
]
#: A factor's name, its count, its weight, above which impact it is high and medium, and its words.
FACTORS = [
    ("Custom components", "custom_types", 5, 15, 5, "unique custom component types need migration"), ("API reference pages", "api_reference_pages", 3, 15, 6, "API reference pages require specialized handling"),
    ("Interactive widgets", "widget_types", 8, 20, 8, "interactive widget types"), ("Third-party embeds", "embed_types", 4, 12, 4, "third-party embed providers"), ("Embedded videos", "video_types", 2, None, None, "video embed types"),
    ("Forms", "forms", 5, 15, 5, "forms need custom handling"), ("Math content", "math", 3, 12, 3, "math elements requiring MathJax/KaTeX integration"),
    ("Diagram content", "diagrams", 3, 12, 3, "diagram elements requiring renderer integration"),
]
SCORE = "least(100, " + " + ".join(f"{weight} * {n}" for _, n, weight, *_ in FACTORS) + ")"
LEVEL = "CASE WHEN score <= 25 THEN 'low' WHEN score <= 50 THEN 'medium' WHEN score <= 75 THEN 'high' ELSE 'very-high' END"
TENTH = lambda x: f"floor(({x}) * 10 + 0.5) / 10"
DENSITY = "(callout_total + tab_components + code_groups + accordion_components + cards + steps + definitions + embeds) / CAST(total_pages AS DOUBLE)"
#: What makes a site's structure hard, when, and its words.
FLAGS = [
    (f"total_pages > 0 AND {DENSITY} > 3", f"'High component density (' || {S(TENTH(DENSITY))} || '/page)'"), ("total_pages > 500", f"'Large site (' || {S('total_pages')} || ' pages)'"),
    ("custom_builds > 3", f"{S('custom_builds')} || ' custom components need manual build'"), ("spec_links > 0", "'OpenAPI specs detected but could not be validated'"),
    ("match_rate < 0.8", f"'Content selector match rate low (' || {S('CAST(floor(match_rate * 100 + 0.5) AS INT)')} || '%)'"), ("code_blocks > total_pages * 2", "'Code-heavy documentation'"),
    ("embed_types > 0", f"{S('embed_types')} || ' third-party embed types need custom handling'"), ("math > 0", "'Math formulas require MathJax/KaTeX integration'"),
    ("diagrams > 0", "'Diagrams require renderer integration'"), ("api_reference_pages > 10", f"{S('api_reference_pages')} || ' API reference pages'"),
]
#: What a platform's content needs; all others need scraping, docusaurus conversion unless MDX is common.
MDX_PLATFORMS = ["nextra", "fumadocs", "mintlify"]
CONVERTED = ["mkdocs", "vitepress", "jekyll", "hugo-docsy", "starlight", "docsify", "wikijs", "sphinx", "readthedocs"]
HELP = "(?i)help|support|zendesk|freshdesk|intercom"
DATA = r"""(?i)data-(component|widget|type)="([^"]+)\""""


# --- components ---------------------------------------------------------------------------------


def data_components(pages: DataFrame, k: int = 10) -> DataFrame:
    """(page_id, kind, n, rank): each page's most frequent marks ``data-component`` and the like, ties by where they come first."""
    each = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(DATA), F.lit(0))).alias("i", "m"))
    kind = F.concat_ws(":", F.lit("data"), F.regexp_extract("m", DATA, 1), F.regexp_extract("m", DATA, 2))
    counts = each.groupBy("page_id", kind.alias("kind")).agg(F.count("*").alias("n"), F.min("i").alias("_seen"))
    return counts.withColumn("rank", F.row_number().over(W.partitionBy("page_id").orderBy(F.desc("n"), "_seen")).cast("long")).filter(F.col("rank") <= k).drop("_seen")


def content(semantic: DataFrame, data: DataFrame) -> DataFrame:
    """(page_id, kind, n, rank, confidence) of a page's content components: by class, then by data attribute."""
    sure = lambda least, less: F.when(F.col("n") >= least, "high").otherwise(less).alias("confidence")
    own = semantic.select("page_id", F.concat(F.lit("semantic:"), "kind").alias("kind"), "n", "rank", sure(3, "medium"))
    return own.unionByName(data.select("page_id", "kind", "n", (F.col("rank") + 100).alias("rank"), sure(2, "low")))


def content_totals(found: DataFrame) -> DataFrame:
    """(kind, total, pages, confidence): the confidence is that of the first page."""
    return found.groupBy("kind").agg(F.sum("n").alias("total"), F.count("*").alias("pages"), F.min_by("confidence", "page_id").alias("confidence"))


def components(pages: DataFrame, tags: DataFrame, found: DataFrame) -> DataFrame:
    """(page_id, part, rank, type, n, confidence): all components of a page: platform kinds, web components, content components."""
    kinds = F.array(*[F.struct(F.lit(i).cast("long").alias("rank"), F.lit(t).alias("type"), F.col(c).cast("long").alias("n")) for i, (t, c) in enumerate(KIND_TYPES.items())])
    own = pages.select("page_id", F.inline(kinds)).filter("n > 0").select("page_id", F.lit(0).alias("part"), "rank", "type", "n", F.lit("high").alias("confidence"))
    web = tags.select("page_id", F.lit(1).alias("part"), "rank", F.concat(F.lit("web-component:"), "tag").alias("type"), "n", F.lit("high").alias("confidence"))
    return own.unionByName(web).unionByName(found.select("page_id", F.lit(2).alias("part"), "rank", F.col("kind").alias("type"), "n", "confidence"))


def component_lists(each: DataFrame) -> DataFrame:
    """(page_id, types, total, components): a page's list in order. A page has at most 14 kinds, 20 tags, and 25 content components."""
    listed = F.array_sort(F.collect_list(F.struct("part", "rank", "type", "n")))
    shown = F.transform(listed, lambda c: F.concat(c["type"], F.lit("("), c["n"].cast("string"), F.lit(")")))
    return each.groupBy("page_id").agg(F.count("*").alias("types"), F.sum("n").alias("total"), F.array_join(shown, ", ").alias("components"))


# --- API documentation ------------------------------------------------------------------------------


def api_details(pages: DataFrame) -> DataFrame:
    """(page_id, url, tool, confidence, playground, try_it): each page's tools; a reference page without one counts as generic."""
    known = F.array(*[F.when(F.array_contains("api_tools", name), F.struct(F.lit(name).alias("tool"), F.lit("high").alias("confidence"), F.lit(play).alias("playground"), F.lit(tried).alias("try_it"))) for name, _, play, tried in P.API_TOOLS])
    open_ = F.col("api_playgrounds") > 0
    generic = F.array(F.struct(F.when(F.col("html").rlike(r"(?i)graphql|__schema|query\s*\{"), "generic-graphql").otherwise("generic-rest").alias("tool"), F.lit("medium").alias("confidence"), open_.alias("playground"), open_.alias("try_it")))
    found = F.when(F.size("api_tools") > 0, F.array_compact(known)).when(F.col("is_api_reference"), generic)
    return pages.select("page_id", "url", F.inline(found))


def api_tools(details: DataFrame) -> DataFrame:
    """(tool, pages, confidence): how many pages show it; the confidence is that of the first."""
    return details.groupBy("tool").agg(F.count("*").alias("pages"), F.min_by("confidence", "page_id").alias("confidence"))


def tried_pages(details: DataFrame) -> DataFrame:
    """(url, playground, try_it) of urls with either."""
    return details.groupBy("url").agg(F.bool_or("playground").alias("playground"), F.bool_or("try_it").alias("try_it")).filter("playground or try_it")


def api_types(pages: DataFrame) -> DataFrame:
    """(type, pages): a mixed page counts as REST and as GraphQL."""
    each = F.when(F.col("api_type") == "mixed", F.array(F.lit("rest"), F.lit("graphql"))).when(F.col("api_type").isNotNull(), F.array("api_type"))
    return pages.select(F.explode(each).alias("type")).groupBy("type").agg(F.count("*").alias("pages"))


def first_specs(shown: DataFrame) -> DataFrame:
    """(url, type, version, valid): of descriptions (page_id, ord, url, ...) each url's first."""
    first = shown.groupBy("url").agg(F.min_by(F.struct("type", "version", "valid"), F.struct("page_id", "ord")).alias("s"))
    return first.select("url", "s.type", "s.version", "s.valid")


# --- the crawl ----------------------------------------------------------------------------------------


def crawl_totals(pages: DataFrame, discovered: DataFrame, site: Column, non_doc: Column) -> DataFrame:
    """(site, discovered, analyzed, skipped_url, skipped_non_doc): urls found (site, url), pages that count, and those left out by url or by content."""
    own = pages.groupBy(site.alias("site")).agg(F.count_if(~non_doc & F.col("is_doc")).alias("analyzed"), F.count_if(non_doc).alias("skipped_url"), F.count_if(~non_doc & ~F.col("is_doc")).alias("skipped_non_doc"))
    found = discovered.groupBy("site").agg(F.count_distinct("url").alias("discovered"))
    return own.join(found, "site", "left").select("site", F.coalesce("discovered", F.lit(0)).cast("long").alias("discovered"), "analyzed", "skipped_url", "skipped_non_doc")


def match_rates(pages: DataFrame, site: Column) -> DataFrame:
    """(site, pages, matched, rate) of pages analysed with a selector."""
    return pages.groupBy(site.alias("site")).agg(F.count("*").alias("pages"), F.count_if("selector_found").alias("matched"), F.avg(F.col("selector_found").cast("int")).alias("rate"))


# --- facts and what follows from them -----------------------------------------------------------------


def listing(frame: DataFrame, name: str, amount: str, out: str) -> DataFrame:
    """One row: ``name: amount`` of each row, most first, then by name. Only for frames with a row for each detector or file type."""
    each = F.array_sort(F.collect_list(F.struct((-F.col(amount)).alias("down"), F.col(name).alias("name"))))
    return frame.agg(F.array_join(F.transform(each, lambda x: F.concat(x["name"], F.lit(": "), (-x["down"]).cast("string"))), ", ").alias(out))


def narrowed(pages: DataFrame) -> DataFrame:
    """What ``facts`` and ``components`` read of pages analysed with a selector: numbers and short lists, without the pages themselves. Worth writing once, as the detectors cost more than all that follows."""
    helping = F.size(F.filter("external_links", lambda u: F.regexp_extract(u, "^https?://([^/?#:]+)", 1).rlike(HELP)))
    plain = {*report.SUMS, *report.ANY, *KIND_TYPES.values(), *(f"embed_{i}" for i in range(len(P.EMBEDS))), *(f"widget_{w}" for w in P.WIDGETS), *(f"video_{v}" for v in P.VIDEO_HOSTS)}
    more = ["html5_videos", "breadcrumb_depth", "is_api_reference", "is_doc", "is_homepage", "table_rows", "content_format", "platform", "api_refs", "openapi_specs", "download_extensions", "selector_found"]
    return pages.select("page_id", "url", *sorted(plain), *more, helping.cast("long").alias("help_links"), F.size("api_endpoints").cast("long").alias("endpoints"))


def facts(pages: DataFrame, custom: DataFrame, found: DataFrame, each: DataFrame) -> DataFrame:
    """One row of all that the report's judgements rest on, from ``narrowed`` pages, the list of custom components, content components and the components of each page."""
    some = lambda columns: reduce(lambda x, y: x + y, [F.when(F.sum(c) > 0, 1).otherwise(0) for c in columns]).cast("long")
    embeds, videos = {n: f"embed_{i}" for i, n in enumerate(P.EMBEDS)}, {v: f"video_{v}" for v in P.VIDEO_HOSTS} | {"html5-video": "html5_videos"}
    one = pages.agg(
        *report.total_columns(), F.sum("help_links").alias("help_links"), F.count_if(F.col("math") > 0).alias("math_pages"), F.count_if(F.col("diagrams") > 0).alias("diagram_pages"),
        F.count_if(F.col("code_playgrounds") > 0).alias("playground_pages"), F.sum("endpoints").alias("endpoints"), F.count_if(F.col("content_format") == "mdx").alias("mdx_pages"),
        some(embeds.values()).alias("embed_types"), some(f"widget_{w}" for w in P.WIDGETS).alias("widget_types"), some(videos.values()).alias("video_types"), F.avg(F.col("selector_found").cast("int")).alias("match_rate"),
    )
    refs = pages.select(F.explode("api_refs").alias("ref")).distinct()
    rows = [
        custom.agg(F.count("*").alias("custom_types"), F.coalesce(F.sum("total"), F.lit(0)).alias("custom_total")),
        found.agg(F.count_distinct("kind").alias("content_types"), F.coalesce(F.sum("n"), F.lit(0)).alias("content_total")),
        each.groupBy("page_id").agg(F.count("*").alias("t")).agg(F.count("*").alias("component_pages"), F.count_if(F.col("t") >= 3).alias("complex_pages"), F.coalesce(F.max("t"), F.lit(0)).alias("most_types")),
        pages.select(F.explode("openapi_specs").alias("spec")).agg(F.count_distinct("spec").alias("spec_links")),
        refs.agg(F.count("*").alias("api_ref_kinds"), F.array_join(F.array_sort(F.collect_list("ref")), "; ").alias("api_ref_list")),
        listing(report.melt_totals(pages, embeds, "name"), "name", "total", "embed_list"),
        listing(report.melt_totals(pages, videos, "name"), "name", "total", "video_list"),
        listing(pages.select(F.explode("download_extensions").alias("name")).groupBy("name").agg(F.count("*").alias("n")), "name", "n", "download_list"),
    ]
    return reduce(DataFrame.crossJoin, rows, one)  # one row by one row


def told(row: DataFrame, rows: list[tuple[str, str, str]]) -> DataFrame:
    """(ord, type, amount, description) of (type, amount, words) where the amount isn't 0."""
    each = [F.struct(F.lit(i).cast("long").alias("ord"), F.lit(t).alias("type"), F.expr(n).cast("long").alias("amount"), F.expr(d).alias("description")) for i, (t, n, d) in enumerate(rows)]
    return row.select(F.inline(F.array(*each))).filter("amount > 0")


def factors(row: DataFrame) -> DataFrame:
    """(name, n, impact, description) of what makes a migration hard."""
    impact = lambda n, w, high, medium: F.lit("low") if high is None else F.when(F.expr(f"{w} * {n}") > high, "high").when(F.expr(f"{w} * {n}") > medium, "medium").otherwise("low")
    each = [F.struct(F.lit(name).alias("name"), F.expr(n).cast("long").alias("n"), impact(n, w, high, medium).alias("impact"), F.expr(f"{S(n)} || ' {words}'").alias("description")) for name, n, w, high, medium, words in FACTORS]
    return row.select(F.inline(F.array(*each))).filter("n > 0")


def compatibility(row: DataFrame, custom: DataFrame, embeds: DataFrame) -> DataFrame:
    """(supported, name, detected_as, amount) of facts, custom components (name, total) and embeds (name, total): what has a counterpart, and what must be built.

    A custom component named as one that is supported already isn't told again; of several with one name the most frequent is.
    """
    shown = [F.struct(F.lit(n).alias("name"), F.lit(d).alias("detected_as"), F.expr(x).cast("long").alias("amount")) for n, d, x in SUPPORTED]
    has = row.select(F.inline(F.array(*shown))).filter("amount > 0").select(F.lit(True).alias("supported"), "name", "detected_as", "amount")
    names = F.create_map(*[F.lit(x) for n in NAMES for x in (n.lower(), n)])
    tags = custom.select("name", "total", F.try_element_at(names, F.lower(F.replace("name", F.lit("-"), F.lit("")))).alias("known"))
    best = tags.filter("known is not null").groupBy("known").agg(F.min_by(F.struct("name", "total"), F.struct(-F.col("total"), "name")).alias("t"))
    more = best.join(has.select(F.col("name").alias("known")).distinct(), "known", "left_anti").select(F.lit(True).alias("supported"), F.col("known").alias("name"), F.concat(F.lit("<"), "t.name", F.lit(">")).alias("detected_as"), F.col("t.total").alias("amount"))
    none = F.lit(None).cast("string").alias("detected_as")
    built = tags.filter("known is null").select(F.lit(False).alias("supported"), "name", none, F.col("total").alias("amount"))
    built = built.unionByName(embeds.select(F.lit(False).alias("supported"), F.concat(F.lit("embed:"), "name").alias("name"), none, F.col("total").alias("amount")))
    whole = [F.struct(F.lit(n).alias("name"), F.expr(x).cast("long").alias("amount")) for n, x in (("math-formulas", "math"), ("diagrams", "diagrams"))]
    built = built.unionByName(row.select(F.inline(F.array(*whole))).filter("amount > 0").select(F.lit(False).alias("supported"), "name", none, "amount"))
    return has.unionByName(more).unionByName(built)


def judged(row: DataFrame, sides: DataFrame) -> DataFrame:
    """The facts with score, level, readiness, shares of what is supported and what must be built, clean pages, compatibility, flags and structural complexity."""
    n = sides.agg(F.count_if("supported").alias("supported_types"), F.count_if(~F.col("supported")).alias("custom_builds"))
    both = row.crossJoin(n).withColumn("score", F.expr(SCORE).cast("long"))  # one row by one row
    flags = F.array_compact(F.array(*[F.when(F.expr(when), F.expr(words)) for when, words in FLAGS]))
    return both.select("*", *[F.expr(x).alias(c) for c, x in JUDGED.items()], flags.alias("flags")).withColumn("structure", F.expr(STRUCTURE.format(n="size(flags)")))


_all = "(supported_types + custom_builds)"
JUDGED = {
    "level": LEVEL, "readiness": "greatest(0, least(100, 100 - score))",
    "supported_share": f"CASE WHEN {_all} > 0 THEN {TENTH(f'supported_types * 100.0 / {_all}')} ELSE 100 END", "custom_share": f"CASE WHEN {_all} > 0 THEN {TENTH(f'custom_builds * 100.0 / {_all}')} ELSE 0 END",
    "clean_pages": "total_pages - component_pages", "compatibility": "CASE WHEN custom_builds = 0 THEN 'All supported' WHEN supported_types > 0 THEN 'Some supported' ELSE 'None supported' END",
}
STRUCTURE = "CASE WHEN {n} >= 3 OR total_pages > 1000 THEN 'high' WHEN {n} >= 1 OR total_pages > 200 THEN 'medium' ELSE 'low' END"


def content_source(best: DataFrame, row: DataFrame) -> DataFrame:
    """(platform, source): what the most common platform's content needs."""
    name, ready, converted = F.lower("platform"), "Existing MDX files", "HTML/Markdown conversion needed"
    common = F.col("mdx_pages") > F.col("total_pages") * 0.3
    source = F.when(name.isin(MDX_PLATFORMS), ready).when((name == "docusaurus") & common, ready).when((name == "docusaurus") | name.isin(CONVERTED), converted).otherwise("Needs full scraping")
    return best.crossJoin(row.select("mdx_pages", "total_pages")).select("platform", source.alias("source"))  # one row by one row


def structure(pages: DataFrame, sidebar: DataFrame) -> DataFrame:
    """(homepage, sidebar_items, structure): the first homepage, and whether sidebar links make a navigation."""
    home = pages.agg(F.min_by("url", F.when(F.col("is_homepage"), F.col("page_id"))).alias("homepage"))
    items = sidebar.agg(F.count("*").alias("sidebar_items"))
    kind = F.when(F.col("sidebar_items") > 5, "Standard sidebar").when(F.col("sidebar_items") > 0, "Needs review").otherwise("Requires custom")
    return home.crossJoin(items).select("homepage", "sidebar_items", kind.alias("structure"))  # one row by one row
