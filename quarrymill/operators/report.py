"""Site reports: sums, ranked lists, scores over the analysed pages. Small frames in, one grouped pass each."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..sources.shared import numbered

#: Column by the name of the component kind that a page may hold.
KINDS = {
    "callouts": "callout_total", "tabs": "tab_components", "codeGroups": "code_groups", "accordions": "accordion_components", "cards": "cards", "steps": "steps", "definitions": "definitions",
    "embeds": "embeds", "badges": "badges", "tooltips": "tooltips", "math": "math", "mermaid": "diagrams", "apiFields": "api_fields", "columns": "columns",
}
SUMS = [
    "word_count", "code_blocks", "tables", "images", "h1", "h2", "h3", "h4", "h5", "h6", "ordered_lists", "unordered_lists", "tabs", "accordions", "downloads", "forms", "iframes", "tooltips",
    "api_playgrounds", "graphql_explorers", "math", "diagrams", "code_playgrounds", "callout_total", "callout_note", "callout_warning", "callout_tip", "callout_info", "callout_danger", "callout_check",
    "tab_components", "code_groups", "accordion_components", "cards", "steps", "definitions", "embeds", "badges", "api_fields", "columns", "videos", "widgets",
]
ANY = ["has_language_switcher", "has_pagination"]
COUNTED = {"api_reference_pages": "is_api_reference", "doc_pages": "is_doc", "homepages": "is_homepage", "complex_table_pages": "table_rows > 5", "code_heavy_pages": "code_blocks > 5"}
#: What a migration should look at, and how much of it there is.
POINTS = {
    "Interactive API playgrounds": "api_playgrounds", "GraphQL explorers": "graphql_explorers", "API reference pages": "api_reference_pages", "Forms": "forms", "Plain iframes": "iframes", "Videos": "videos",
    "Third-party embeds": "embeds", "Math content": "math", "Diagrams": "diagrams", "Code playgrounds": "code_playgrounds", "Download links": "downloads", "Interactive widgets": "widgets", "Tooltips": "tooltips",
    "Pages with complex tables": "complex_table_pages", "Code-heavy pages": "code_heavy_pages",
}
SUPPORTED = {
    "Callouts": "callout_total", "Tabs": "tab_components + tabs", "CodeGroup": "code_groups", "Accordion": "accordion_components", "Card": "cards", "Steps": "steps", "Expandable": "definitions", "Frame": "embeds",
    "Badge": "badges", "Tooltip": "tooltips", "LaTeX": "math", "Mermaid": "diagrams", "ParamField": "api_fields", "Columns": "columns", "Code blocks": "code_blocks", "Tables": "tables", "Images": "images",
}


def total_columns() -> list[Column]:
    depth = F.avg(F.when(F.col("breadcrumb_depth") > 0, F.col("breadcrumb_depth")))
    return [
        F.count("*").alias("total_pages"), *[F.sum(c).alias(c) for c in SUMS], *[F.bool_or(c).alias(c) for c in ANY], *[F.sum(F.when(F.expr(c), 1).otherwise(0)).cast("long").alias(n) for n, c in COUNTED.items()],
        F.coalesce(F.floor(depth * 10 + 0.5).cast("double") / 10, F.lit(0.0)).alias("avg_breadcrumb"),
    ]


def totals(pages: DataFrame) -> DataFrame:
    """One row of sums, flags and counts; sums over no pages are null."""
    return pages.agg(*total_columns())


def ranked(counts: DataFrame, n: str, first_seen: str, limit: int | None) -> DataFrame:
    """Most first, ties by first appearance. With a limit the window runs over so many rows; without, rows are numbered where they lie."""
    order = [F.desc(n), F.asc(first_seen)]
    if limit:
        return counts.orderBy(*order).limit(limit).withColumn("rank", F.row_number().over(W.orderBy(*order)).cast("long"))
    placed = numbered(counts.withColumn("_down", -F.col(n)), "_down", first_seen)
    return placed.withColumn("rank", (F.col("slot") + 1).cast("long")).drop("slot", "_down")


def value_counts(pages: DataFrame, column: str, out: str, limit: int | None = None) -> DataFrame:
    """How many pages hold each value of a list column."""
    each = pages.select("page_id", F.posexplode(column).alias("i", out))
    counts = each.groupBy(out).agg(F.count("*").alias("pages"), F.min(F.struct("page_id", "i")).alias("_seen"))
    return ranked(counts, "pages", "_seen", limit).select(out, "pages", "rank")


def external_domains(pages: DataFrame, k: int) -> DataFrame:
    each = pages.select("page_id", F.posexplode("external_links").alias("i", "u"))
    each = each.select("page_id", "i", F.regexp_extract("u", "^https?://([^/?#:]+)", 1).alias("domain"))
    counts = each.groupBy("domain").agg(F.count("*").alias("links"), F.min(F.struct("page_id", "i")).alias("_seen"))
    help_center = F.col("domain").rlike("(?i)help|support|zendesk|freshdesk|intercom")
    return ranked(counts, "links", "_seen", k).select("domain", "links", help_center.alias("help_center"), "rank")


def melt_totals(pages: DataFrame, columns: dict[str, str], out: str) -> DataFrame:
    """Total and pages of each counter column; the columns are summed in one pass, then turned into rows."""
    sums = pages.agg(*[F.struct(F.sum(c).alias("total"), F.count_if(F.col(c) > 0).alias("pages")).alias(c) for c in columns.values()])
    each = F.array(*[F.struct(F.lit(n).alias(out), F.col(c)["total"].alias("total"), F.col(c)["pages"].alias("pages")) for n, c in columns.items()])
    return sums.select(F.inline(each)).filter("total > 0")


def melted_row(row: DataFrame, columns: dict[str, str], out: str) -> DataFrame:
    each = F.array(*[F.struct(F.lit(n).alias(out), F.expr(c).cast("long").alias("amount")) for n, c in columns.items()])
    return row.select(F.inline(each)).filter("amount > 0")


def points(row: DataFrame) -> DataFrame:
    return melted_row(row, POINTS, "point")


def top_matches(pages: DataFrame, pattern: str, out: str, k: int, drop: str | None = None) -> DataFrame:
    """Per page the k most frequent matches, ties by first occurrence."""
    each = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(pattern), 1)).alias("i", "_m")).select("page_id", "i", F.lower("_m").alias(out))
    if drop:
        each = each.filter(~F.col(out).rlike(drop))
    counts = each.groupBy("page_id", out).agg(F.count("*").alias("n"), F.min("i").alias("_seen"))
    order = W.partitionBy("page_id").orderBy(F.desc("n"), "_seen")
    return counts.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= k).drop("_seen")


def custom_components(tags: DataFrame, semantic: DataFrame, decisions: DataFrame | None = None, k: int = 40) -> DataFrame:
    """Web components and semantic classes as one list, largest first. ``decisions`` (name, action) drops what is to be ignored or mapped."""
    each = tags.select("page_id", F.col("tag").alias("name"), "n").unionByName(semantic.select("page_id", F.concat(F.lit("."), "kind").alias("name"), "n"))
    if decisions is not None:
        each = each.join(decisions.filter("action in ('ignore', 'map')"), "name", "left_anti")
    return each.groupBy("name").agg(F.sum("n").alias("total"), F.countDistinct("page_id").alias("pages")).orderBy(F.desc("total"), "name").limit(k)


def per_page(pages: DataFrame) -> DataFrame:
    """Distinct component kinds and instances of each page."""
    add = lambda x, y: x + y
    kinds: Column = reduce(add, [F.when(F.col(c) > 0, 1).otherwise(0) for c in KINDS.values()])
    total: Column = reduce(add, [F.col(c) for c in KINDS.values()])
    return pages.select("page_id", "url", "is_api_reference", F.size("api_tools").alias("tools"), "widgets", kinds.cast("long").alias("kinds"), total.alias("total"))


def review(pages: DataFrame, k: int = 50) -> DataFrame:
    reasons = F.array_compact(
        F.array(
            F.when(F.col("kinds") >= 3, "Multiple component types"),
            F.when(F.col("widgets") > 0, "Interactive widgets"),
            F.when(F.col("is_api_reference") & (F.col("tools") == 0), "API reference without tool"),
            F.when(F.col("total") >= 5, "Many component instances"),
        )
    )
    return pages.select("page_id", F.array_join(reasons, "; ").alias("reasons"), "total").filter("reasons <> ''").orderBy(F.desc("total"), "page_id").limit(k)


def majority(pages: DataFrame, column: str) -> DataFrame:
    """The most common value with its share, and how far to trust it; values that are null or ``unknown`` don't count."""
    counts = pages.filter(F.col(column).isNotNull() & (F.col(column) != "unknown")).groupBy(column).agg(F.count("*").alias("pages"), F.min("page_id").alias("_seen"))
    share = F.col("pages") / F.sum("pages").over(W.partitionBy())
    best = counts.withColumn("share", share).orderBy(F.desc("pages"), "_seen").limit(1)
    name = F.concat(F.upper(F.substring(column, 1, 1)), F.substring(column, F.lit(2), F.length(column)))
    return best.select(name.alias(column), "pages", "share", F.when(F.col("share") > 0.7, "high").when(F.col("share") > 0.4, "medium").otherwise("low").alias("confidence"))


def complexity(pages: DataFrame, custom: DataFrame) -> DataFrame:
    """Weighted sum of what is hard to migrate, capped at 100, its level, and readiness."""
    some = lambda c: F.when(F.sum(c) > 0, 1).otherwise(0)
    add = lambda x, y: x + y
    row = pages.agg(
        F.sum(F.when(F.col("is_api_reference"), 1).otherwise(0)).alias("api_pages"),
        reduce(add, [some(f"widget_{w}") for w in P.WIDGETS]).alias("widgets"),
        reduce(add, [some(f"embed_{i}") for i in range(len(P.EMBEDS))]).alias("embeds"),
        reduce(add, [some(f"video_{v}") for v in P.VIDEO_HOSTS] + [some("html5_videos")]).alias("videos"),
        F.sum("forms").alias("forms"), F.sum("math").alias("math"), F.sum("diagrams").alias("diagrams"),
    )
    score = F.expr("least(100, 5 * custom + 3 * api_pages + 8 * widgets + 4 * embeds + 2 * videos + 5 * forms + 3 * math + 3 * diagrams)").cast("long")
    both = row.crossJoin(custom.agg(F.count("*").alias("custom"))).select(score.alias("score"))  # one row by one row
    level = F.when(F.col("score") <= 25, "low").when(F.col("score") <= 50, "medium").when(F.col("score") <= 75, "high").otherwise("very-high")
    return both.select("score", level.alias("level"), F.greatest(F.lit(0), F.least(F.lit(100), 100 - F.col("score"))).cast("long").alias("readiness"))


def meta_tags(pages: DataFrame, pattern: str) -> DataFrame:
    """(page_id, key, value) of meta tags with a value; the last of several wins."""
    each = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(pattern), 0)).alias("i", "tag"))
    each = each.select("page_id", "i", F.regexp_extract("tag", pattern, 1).alias("key"), F.trim(F.regexp_extract("tag", pattern, 2)).alias("value")).filter("value <> ''")
    return each.groupBy("page_id", "key").agg(F.max_by("value", "i").alias("value"))
