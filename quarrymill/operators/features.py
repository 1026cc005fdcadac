"""Page analysis: every detector is a column over the page's HTML, so a page is read once and nothing is shuffled.

Columns come in stages. Each stage names what the one before it made, which keeps shared
work shared and the generated code of a stage small.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import urls
from ..functions.dual import Dual, all_of, any_of, count, every, first, first_label, labels, named, quoted, replaced, test


def plain_text() -> Dual:
    """The text without scripts, styles and tags, white space collapsed."""
    x = replaced(replaced(replaced(named("html"), r"(?i)<script[\s\S]*?</script>", ""), r"(?i)<style[\s\S]*?</style>", ""), "<[^>]+>", " ")
    return replaced(replaced(x, r"\s+", " "), "^ | $", "")


def title() -> Dual:
    """Of the first h1, else of the title tag."""
    h1, tag = first(r"(?i)<h1[^>]*>([\s\S]*?)</h1>"), first(r"(?i)<title[^>]*>([\s\S]*?)</title>")
    has = test(r"(?i)<h1[^>]*>[\s\S]*?</h1>")
    strip = lambda d: replaced(replaced(d, "<[^>]+>", ""), r"^\s+|\s+$", "")
    a, b = strip(h1), strip(tag)
    return Dual(lambda: F.when(has.column, a.column).otherwise(b.column), f"CASE WHEN {has.sql} THEN {a.sql} ELSE {b.sql} END")


def generator() -> Dual:
    ahead = first(r"""(?i)<meta[^>]+name=["']generator["'][^>]+content=["']([^"']+)["']""")
    behind = first(r"""(?i)<meta[^>]+content=["']([^"']+)["'][^>]+name=["']generator["']""")
    return Dual(lambda: F.when(ahead.column != "", ahead.column).otherwise(behind.column), f"CASE WHEN {ahead.sql} <> '' THEN {ahead.sql} ELSE {behind.sql} END")


def platform() -> Dual:
    """The first platform whose generator tag or marks are found."""
    rules = []
    for name, generated, groups in P.PLATFORMS:
        ways = [test(f"(?i){generated}", "generator")] if generated else []
        for marks in groups:
            one = lambda m: test(f"(?i){m[10:]}", "generator") if m.startswith("generator:") else test(f"(?i){m[4:]}", "url") if m.startswith("url:") else test(f"(?i){m}")
            ways.append(all_of([one(m) for m in marks]))
        rules.append((name, any_of(ways)))
    return first_label(rules)


def matching(items: Dual, pattern: str, keep: bool = True) -> Dual:
    """Those of a list of strings in which ``pattern`` occurs, or doesn't."""
    column = lambda: F.filter(items.column, lambda x: x.rlike(pattern) if keep else ~x.rlike(pattern))
    return Dual(column, f"list_filter({items.sql}, lambda x: {'' if keep else 'NOT '}regexp_matches(x, {quoted(pattern)}))")


def size(items: Dual) -> Dual:
    return Dual(lambda: F.size(items.column), f"len({items.sql})")


def lowered(items: Dual) -> Dual:
    return Dual(lambda: F.transform(items.column, lambda x: F.lower(x)), f"list_transform({items.sql}, lambda x: lower(x))")


def whole(n: Dual) -> Dual:
    return Dual(lambda: n.column.cast("long"), f"CAST({n.sql} AS BIGINT)")


IFRAME = r"""(?i)<iframe[^>]+src=["']([^"']+)["']"""
IMAGE = r"""(?i)<img[^>]+src=["']([^"']+)["']"""
HREF = r"""(?i)href=["']([^"']+)["']"""
LINK = r"""(?i)<a[^>]+href=["'](https?://[^"']+)["'][^>]*>([\s\S]*?)</a>"""
SPEC = r"""(?i)href=["']([^"']*(?:swagger|openapi)[^"']*)["']"""
SPEC_FILE = r"""(?i)href=["']([^"']*(?:\.yaml|\.json)[^"']*)["']"""
METHOD = r"(GET|POST|PUT|PATCH|DELETE)\s+/[a-zA-Z0-9/{}_.-]+"
ENDPOINT = r"(GET|POST|PUT|PATCH|DELETE|HEAD|OPTIONS)\s+(/[a-zA-Z0-9/{}_:.-]+)"
DOWNLOAD = "(" + "|".join(e.replace(".", r"\.") for e in P.DOWNLOADS) + ")$"


def stage1() -> dict[str, Dual]:
    found = {name: whole(count(p)) for name, p in P.COUNTS.items()}
    found |= {name: test(p) for name, p in P.FLAGS.items()}
    found |= {f"embed_{i}": whole(count(p)) for i, p in enumerate(P.EMBEDS.values())}
    found |= {f"widget_{name}": whole(count(p)) for name, p in P.WIDGETS.items()}
    found |= {f"video_{name}": whole(size(matching(every(IFRAME), p))) for name, p in P.VIDEO_HOSTS.items()}
    found |= {
        "title": title(),
        "plain": plain_text(),
        "generator": generator(),
        "path": urls.lower(urls.path()),
        "origin": urls.origin(),
        "image_srcs": every(IMAGE),
        "hrefs": every(HREF),
        "link_urls": every(LINK),
        "callouts": lowered(every(P.CALLOUT, 0)),
        "spec_links": every(SPEC),
        "spec_files": matching(every(SPEC_FILE), r"(?i)api[_-]?spec|spec[_-]?api|openapi|swagger"),
        "breadcrumb": first(r"""(?i)class="[^"]*breadcrumb[^"]*"[\s\S]*?</(?:nav|ol|ul|div)>""", 0),
        "api_refs_found": labels(list({n: test(p) for n, p in P.API_REFS.items()}.items())),
        "playground_types_found": labels([(n, test(p)) for n, p in P.PLAYGROUND_TYPES.items()]),
        "api_tools": labels([(n, test(p)) for n, p, _, _ in P.API_TOOLS]),
        "auth_methods": labels([(n, test(p)) for n, p in P.AUTH_METHODS.items()]),
        "code_languages": lowered(every(r"""(?i)class="[^"]*(?:language-|lang-)([a-zA-Z0-9+#-]+)""")),
    }
    return found


def distinct_in_order(name: str) -> Dual:
    return Dual(lambda: F.array_distinct(F.col(name)), f"list_filter({name}, lambda x, i: list_position({name}, x) = i)")


def stage2() -> dict[str, Dual]:
    """What follows from the first stage's columns."""
    words = Dual(lambda: F.when(F.col("plain") == "", 0).otherwise(F.size(F.split("plain", " "))).cast("long"), "CAST(CASE WHEN plain = '' THEN 0 ELSE len(string_split(plain, ' ')) END AS BIGINT)")
    variant = {}
    earlier: list[str] = []
    for name, pattern in P.VARIANTS.items():
        kept = matching(named("callouts"), pattern)
        for e in earlier:
            kept = matching(kept, e, keep=False)
        variant[f"callout_{name}"] = whole(size(kept))
        earlier.append(pattern)
    rest = named("callouts")
    for e in earlier:
        rest = matching(rest, e, keep=False)
    variant["callout_note"] = whole(size(rest))
    external = Dual(
        lambda: F.size(F.filter("image_srcs", lambda s: s.startswith("http") & (F.lower(F.regexp_extract(s, r"^(https?://[^/?#]+)", 1)) != F.col("origin")))).cast("long"),
        "CAST(len(list_filter(image_srcs, lambda s: starts_with(s, 'http') AND lower(regexp_extract(s, '^(https?://[^/?#]+)', 1)) <> origin)) AS BIGINT)",
    )
    outside = Dual(
        lambda: F.filter("link_urls", lambda s: F.lower(F.regexp_extract(s, r"^(https?://[^/?#]+)", 1)) != F.col("origin")),
        "list_filter(link_urls, lambda s: lower(regexp_extract(s, '^(https?://[^/?#]+)', 1)) <> origin)",
    )
    downloads = matching(lowered(named("hrefs")), DOWNLOAD)
    extensions = Dual(lambda: F.array_sort(F.array_distinct(F.transform(downloads.column, lambda x: F.regexp_extract(x, DOWNLOAD, 1)))), f"list_sort(list_distinct(list_transform({downloads.sql}, lambda x: regexp_extract(x, {quoted(DOWNLOAD)}, 1))))")
    iframes = matching(every(IFRAME), P.NOT_PLAIN_IFRAME, keep=False)
    specs = Dual(lambda: F.array_distinct(F.concat("spec_links", "spec_files")), "list_filter(list_concat(spec_links, spec_files), lambda x, i: list_position(list_concat(spec_links, spec_files), x) = i)")
    refs = Dual(
        lambda: F.when(F.array_contains("api_refs_found", next(iter(P.API_REFS))), F.array_remove("api_refs_found", list(P.API_REFS)[1])).otherwise(F.col("api_refs_found")),
        f"CASE WHEN list_contains(api_refs_found, {quoted(next(iter(P.API_REFS)))}) THEN list_filter(api_refs_found, lambda x: x <> {quoted(list(P.API_REFS)[1])}) ELSE api_refs_found END",
    )
    url_playground = test(P.PLAYGROUND_PATH, "path")
    endpoints = Dual(
        lambda: F.slice(F.array_distinct(F.transform(F.regexp_extract_all(F.col("plain"), F.lit(ENDPOINT), F.lit(0)), lambda x: F.regexp_replace(x, " +", " "))), 1, 50),
        f"list_slice(list_filter(regexp_extract_all(plain, {quoted(ENDPOINT)}), lambda x, i: list_position(regexp_extract_all(plain, {quoted(ENDPOINT)}), x) = i), 1, 50)",
    )
    return variant | {
        "word_count": words,
        "platform": platform(),
        "languages": distinct_in_order("code_languages"),
        "images": whole(size(named("image_srcs"))),
        "external_images": external,
        "external_links": outside,
        "downloads": whole(size(downloads)),
        "download_extensions": extensions,
        "iframes": whole(size(iframes)),
        "openapi_specs": specs,
        "api_refs": refs,
        "url_playground": url_playground,
        "api_endpoints": endpoints,
        "method_mentions": whole(count(METHOD, "plain")),
        "breadcrumb_depth": whole(count(r"(?i)<li[\s>]|<a[\s>]", "breadcrumb")),
        "api_path": test(P.API_PATH, "path"),
        "root_path": test(r"^(?:/|/docs/?|/[a-z]{2}/?)$", "path"),
    }


SAME = {
    "tabs": "tab_classes + tab_roles",
    "accordions": "accordion_classes + details",
    "accordion_components": "details + accordion_items",
    "videos": "video_youtube + video_vimeo + video_loom + video_wistia + html5_videos",
    "embeds": " + ".join(f"embed_{i}" for i in range(len(P.EMBEDS))),
    "widgets": " + ".join(f"widget_{n}" for n in P.WIDGETS),
    "headings": "h1 + h2 + h3",
    "lists": "ordered_lists + unordered_lists",
    "callout_total": "callout_warning + callout_tip + callout_info + callout_danger + callout_check + callout_note",
    "api_playgrounds": "CASE WHEN url_playground AND playground_marks = 0 THEN 1 ELSE playground_marks END",
    "is_homepage": "root_path OR has_hero OR has_feature_grid",
    "api_signals": "CASE WHEN method_mentions >= 2 THEN 2 ELSE 0 END + CASE WHEN response_panels >= 2 THEN 1 ELSE 0 END + CASE WHEN parameter_marks >= 3 THEN 1 ELSE 0 END + CASE WHEN auth_mark THEN 1 ELSE 0 END + CASE WHEN api_path THEN 1 ELSE 0 END + CASE WHEN method_badges >= 2 THEN 1 ELSE 0 END + CASE WHEN endpoint_mark THEN 1 ELSE 0 END + CASE WHEN schema_mark THEN 1 ELSE 0 END",
    "content_format": "CASE WHEN platform IN ({mdx}) THEN 'mdx' WHEN platform = 'docusaurus' THEN CASE WHEN mdx_mark THEN 'mdx' ELSE 'markdown' END WHEN platform IN ({markdown}) THEN 'markdown' WHEN platform IN ({rst}) THEN 'rst' WHEN platform IN ({html}) THEN 'html' END".format(**{k: ", ".join(map(quoted, v)) for k, v in P.FORMATS.items()}),
}
SIZE = {"spark": "size", "duck": "len"}
LAST = {
    "is_api_reference": "api_signals >= 2 OR api_playgrounds > 0",
    "api_confidence": "least(100, CASE WHEN {n}(api_tools) > 0 OR api_signals >= 2 OR api_playgrounds > 0 THEN 30 ELSE 0 END + CASE WHEN api_playgrounds > 0 THEN 20 ELSE 0 END + CASE WHEN {n}(api_endpoints) >= 2 THEN 15 ELSE 0 END + CASE WHEN {n}(api_endpoints) >= 5 THEN 10 ELSE 0 END + CASE WHEN {n}(api_refs) > 0 THEN 10 ELSE 0 END + CASE WHEN {n}(openapi_specs) > 0 THEN 15 ELSE 0 END + CASE WHEN url_playground THEN 10 ELSE 0 END + CASE WHEN body_mark THEN 10 ELSE 0 END)",
    "is_doc": "CASE WHEN api_playgrounds > 0 OR graphql_explorers > 0 OR {n}(openapi_specs) > 0 OR {n}(api_refs) > 0 THEN TRUE WHEN platform = 'zendesk' AND (headings >= 1 AND word_count > 50 OR word_count > 100) THEN TRUE WHEN platform IN ('readme', 'google-devsite', 'wikijs', 'confluence', 'notion') AND word_count > 50 THEN TRUE WHEN headings >= 2 AND word_count > 100 OR headings = 1 AND word_count > 200 THEN TRUE WHEN code_blocks >= 2 OR code_blocks >= 1 AND word_count > 50 THEN TRUE WHEN tables > 0 AND word_count > 50 THEN TRUE WHEN lists >= 2 AND word_count > 100 THEN TRUE ELSE FALSE END",
    "playground_types": "CASE WHEN {n}(playground_types_found) = 0 AND url_playground THEN {array} ELSE playground_types_found END",
}
API_TYPE = "CASE WHEN api_confidence = 0 THEN NULL WHEN CASE WHEN {n}(api_endpoints) > 0 OR rest_mark THEN 1 ELSE 0 END + CASE WHEN graphql_mark THEN 1 ELSE 0 END + CASE WHEN grpc_mark THEN 1 ELSE 0 END > 1 THEN 'mixed' WHEN graphql_mark THEN 'graphql' WHEN grpc_mark THEN 'grpc' WHEN {n}(api_endpoints) > 0 OR rest_mark THEN 'rest' END"
FALLBACK = "CASE WHEN path LIKE '%swagger%' THEN 'swagger-ui' WHEN path LIKE '%redoc%' THEN 'redoc' WHEN path LIKE '%graphql%' THEN 'graphql' ELSE 'generic' END"


def analyze(pages: DataFrame, selector: str | None = None) -> DataFrame:
    """Every feature of every page (page_id, url, html and about a hundred columns); Catalyst drops those that aren't used.

    A null html is an empty page; a null url has path ``/``. ``selector`` (a class, id or tag) marks
    the content area: ``selector_found`` says whether the page has it, and decides ``is_doc``.
    """
    made = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    one, two = stage1(), stage2()
    made = made.select("*", *[d.column.alias(n) for n, d in one.items()])
    made = made.select("*", *[d.column.alias(n) for n, d in two.items()])
    made = made.select("*", *[F.expr(x).alias(n) for n, x in SAME.items()])
    made = made.select("*", *[F.expr(x.format(n="size", array=f"array({FALLBACK})")).alias(n) for n, x in LAST.items()])
    made = made.select("*", F.expr(API_TYPE.format(n="size")).alias("api_type"))
    if selector:
        found = made.html.rlike(selector_pattern(selector))
        made = made.withColumn("selector_found", found).withColumn("is_doc", F.expr("selector_found OR api_playgrounds > 0 OR graphql_explorers > 0 OR size(openapi_specs) > 0 OR size(api_refs) > 0"))
    return made


def selector_pattern(selector: str) -> str:
    """Where a simple CSS selector (class, id or tag; several by commas) shows in raw HTML."""
    import re

    ways = []
    for part in (p.strip() for p in selector.split(",")):
        if m := re.search(r"\.([a-zA-Z0-9_-]+)", part):
            ways.append(f'class="[^"]*{m[1]}')
        if m := re.search(r"#([a-zA-Z0-9_-]+)", part):
            ways.append(f'id="{m[1]}"')
        if m := re.fullmatch(r"([a-zA-Z]+)", part):
            ways.append(rf"<{m[1]}[\s>]")
    return "(?i)" + ("|".join(ways) or r"(?!)")


def analyze_sql(source: str) -> str:
    """The same as DuckDB's SQL over the table expression ``source``."""
    one, two = stage1(), stage2()
    sql = f"SELECT page_id, url, coalesce(html, '') AS html FROM ({source})"
    sql = f"SELECT *, {', '.join(f'{d.sql} AS {n}' for n, d in one.items())} FROM ({sql})"
    sql = f"SELECT *, {', '.join(f'{d.sql} AS {n}' for n, d in two.items())} FROM ({sql})"
    sql = f"SELECT *, {', '.join(f'{x} AS {n}' for n, x in SAME.items())} FROM ({sql})"
    last = {n: x.format(n="len", array=f"[{FALLBACK}]") for n, x in LAST.items()}
    sql = f"SELECT *, {', '.join(f'{x} AS {n}' for n, x in last.items())} FROM ({sql})"
    return f"SELECT *, {API_TYPE.format(n='len')} AS api_type FROM ({sql})"
