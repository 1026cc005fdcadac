"""Registered queries over whole sites: component families, API descriptions, table functions, files at paths, edits, headers, navigation, samples, order, sidebars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text, urls
from ..functions.dual import Dual, named, quoted
from ..operators import edits, fill, mdx_links, nested, rewrite, samples, search, specs, table_functions, tree_rows
from ..sources import doctree, shared
from .doc_queries import S as DOC_S
from .doc_queries import V, documents, search_sql
from .page_queries import pages_rich, spread
from .views import MDX_DOCS, PAGES_RICH, mdx_docs

Q: dict = {}
S: dict = {}


def add(name: str, sql: str | None = None):
    def put(f):
        Q[name] = f
        if sql:
            S[name] = sql
        return f

    return put


# --- component families: no SQL reads trees; a recursive version in the tests does ----------------


@add("component_families")
def component_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree_rows.families(tree_rows.elements(spread(pages_rich(spark, sf_dir))))


@add("component_family_totals")
def component_family_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each family over the site: its pages, elements and how many pages name it by a selector."""
    found = component_families(spark, sf_dir)
    return found.groupBy("family", "tag").agg(F.count("*").alias("pages"), F.sum("members").alias("members"), F.count("selector").alias("named"), F.min("selector").alias("selector"))


# --- API descriptions ---------------------------------------------------------------------------

#: Descriptions as pages embed them: whole, older, by lines, broken, and what only looks like one.
EMBEDDED = [
    '<script type="application/json">{"openapi": "3.1.0", "paths": {"/users": {"get": {"x": 1}, "post": {}, "summary": "s"}, "/users/{id}": {"delete": {"y": []}, "put": null, "patch": false}}}</script>',
    '<script>{"swagger": "2.0", "paths": {"/a": {"get": {"r": 0}, "head": ""}, "/b": "text", "/c": null}}</script><a href="/v2/swagger.json">s</a>',
    "<pre>openapi: 3.0.2\npaths:\n  /a:\n    get:\n      x: 1\n    post:\n  /b:\n    delete:\n</pre>",
    '<script>{"openapi": "3.0.0", "paths": {"/broken": {"get": }</script>',
    "<pre>swagger: '2.0'\n  /only:\n  /paths:\n</pre>" + '<a href="https://example.org/graphql-openapi.yaml">g</a>',
    '<script>{"asyncapi": "2.6.0", "channels": {}}</script><script>{"a": 1}</script>',
    '<script>{"openapi": "3.0.3"}</script><script>{"openapi": "3.0.4", "paths": [1, 2]}</script>',
    "",
]


def pages_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = F.element_at(F.array(*[F.lit(s) for s in EMBEDDED]), (F.col("page_id") % len(EMBEDDED) + 1).cast("int"))
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", F.concat(chosen, F.col("html")).alias("html"))


PAGES_SPECS = f"SELECT page_id, url, [{', '.join(quoted(s) for s in EMBEDDED)}][page_id % {len(EMBEDDED)} + 1] || html AS html FROM pages"
_kind = "CASE WHEN regexp_matches(u, '(?i)swagger') THEN 'swagger' WHEN regexp_matches(u, '(?i)asyncapi') THEN 'asyncapi' WHEN regexp_matches(u, '(?i)graphql') THEN 'graphql' ELSE 'openapi' END"
_has = lambda p: f"regexp_matches(html, {quoted(p)})"
_none = "CAST(NULL AS VARCHAR)"
_one = lambda when, kind, version, valid: f"SELECT page_id, {{0}} AS part, 0 AS place, url, '{kind}' AS type, {version} AS version, {valid} AS valid FROM p WHERE {when}"
_shown = [
    _one(_has(specs.OPENAPI), "openapi", f"coalesce(nullif(regexp_extract(html, {quoted(specs.OPENAPI_VERSION)}, 1), ''), '3.0')", "TRUE"), _one(f"NOT {_has(specs.OPENAPI)} AND {_has(specs.SWAGGER)}", "swagger", "'2.0'", "TRUE"),
    _one(_has(specs.ASYNCAPI), "asyncapi", _none, "CAST(NULL AS BOOLEAN)"), f"SELECT page_id, {{0}} AS part, place, u AS url, {_kind} AS type, {_none} AS version, CAST(NULL AS BOOLEAN) AS valid FROM l",
    _one(f"{_has(specs.GRAPHQL)} AND page_id NOT IN (SELECT page_id FROM l WHERE {_kind} = 'graphql')", "graphql", _none, "CAST(NULL AS BOOLEAN)"),
]
_parts = " UNION ALL ".join(s.format(i) for i, s in enumerate(_shown))
add("detected_specs", f"""WITH p AS ({PAGES_SPECS}), l AS (SELECT page_id, unnest(x) AS u, generate_subscripts(x, 1) AS place FROM (SELECT page_id, regexp_extract_all(html, {quoted(specs.SPEC_LINK)}, 1) AS x FROM p)), a AS ({_parts})
    SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY part, place) - 1 AS BIGINT) AS ord, url, type, version, valid FROM a""")(lambda spark, sf_dir: specs.shown(pages_specs(spark, sf_dir)))

_blocks = f"""SELECT page_id, CAST(place - 1 AS BIGINT) AS ord, trim(block) AS text FROM (SELECT page_id, unnest(x) AS block, generate_subscripts(x, 1) AS place FROM
    (SELECT page_id, list_concat({', '.join(f'regexp_extract_all(html, {quoted(b)}, 1)' for b in specs.BLOCKS)}) AS x FROM ({PAGES_SPECS})))"""
_truthy = lambda x: f"({x} IS NOT NULL AND NOT regexp_matches(CAST({x} AS VARCHAR), {quoted(specs.FALSY)}))"
_candidates = f"""WITH b AS (SELECT *, regexp_extract(text, {quoted(specs.YAML_VERSION)}, 1) AS y, CASE WHEN json_valid(text) THEN CAST(text AS JSON) END AS j FROM ({_blocks}) WHERE starts_with(trim(text), '{{') OR regexp_matches(trim(text), {quoted(specs.YAML_VERSION)})),
    p AS (SELECT page_id, ord, path, json_extract(j, '$.paths."' || path || '"') AS about FROM (SELECT page_id, ord, j, unnest(json_keys(j, '$.paths')) AS path FROM b WHERE json_type(j, '$.paths') = 'OBJECT')),
    e AS (SELECT page_id, ord, path, method FROM (SELECT page_id, ord, path, about, unnest({specs.METHODS}) AS method FROM p) WHERE {_truthy("json_extract(about, '$.' || method)")})"""
add("api_endpoints_by_path", f"{_candidates} SELECT page_id, ord, path, method FROM e")(lambda spark, sf_dir: specs.endpoints(specs.blocks(pages_specs(spark, sf_dir))))
_lines = lambda p: f"len(regexp_extract_all(text, {quoted(p)}))"
_is = lambda k: f"WHEN {_truthy(f'''json_extract(j, '$.{k}')''')} THEN '{k}'"
add("embedded_specs", f"""{_candidates}, n AS (SELECT page_id, ord, count(*) AS n FROM e GROUP BY ALL)
    SELECT page_id, ord, CASE WHEN j IS NOT NULL THEN CASE {_is('openapi')} {_is('swagger')} {_is('asyncapi')} END WHEN y <> '' THEN regexp_extract(text, '(?m)^(openapi|swagger)[ \\t]*:', 1) END AS type,
      CASE WHEN j IS NOT NULL THEN coalesce(json_extract_string(j, '$.openapi'), json_extract_string(j, '$.swagger'), json_extract_string(j, '$.asyncapi')) WHEN y <> '' THEN y END AS version,
      CASE WHEN j IS NOT NULL THEN CAST(coalesce(n, 0) AS BIGINT) WHEN y <> '' THEN CAST(CASE WHEN {_lines(specs.YAML_METHOD)} > 0 THEN {_lines(specs.YAML_METHOD)} ELSE {_lines(specs.YAML_PATH)} END AS BIGINT) END AS endpoints,
      j IS NOT NULL OR y <> '' AS valid, CASE WHEN j IS NULL AND y = '' THEN 'not a description' END AS error FROM b LEFT JOIN n USING (page_id, ord)""")(lambda spark, sf_dir: specs.measured(specs.blocks(pages_specs(spark, sf_dir))))

# --- table functions ------------------------------------------------------------------------------


def functions(spark: SparkSession, sf_dir: str) -> SparkSession:
    table_functions.register(spark, search.index(documents(spark, sf_dir)))
    return spark


add("search_table_function", search_sql("the thing", 20, 0.0))(lambda spark, sf_dir: functions(spark, sf_dir).sql(table_functions.search_sql("the thing", 20)))
add("search_table_function_threshold", search_sql("que de", 15, 0.5))(lambda spark, sf_dir: functions(spark, sf_dir).sql(table_functions.search_sql("que de", 15, 0.5)))
#: Every document is asked for by its path, and some keys that none has.
ASKED = "SELECT concat('docs/', doc_id) AS key FROM quarrymill_docs UNION ALL SELECT concat('/nowhere/', language) FROM quarrymill_docs"
add("get_table_function", "SELECT 'docs/' || doc_id AS key, doc_id, string_split(text, chr(10))[1] AS title FROM documents UNION ALL SELECT '/nowhere/' || lang, NULL, NULL FROM documents")(
    lambda spark, sf_dir: functions(spark, sf_dir).sql(f"SELECT a.key, d.doc_id, d.title FROM ({ASKED}) a LEFT JOIN LATERAL get_doc(a.key) d")
)
add("list_table_function", DOC_S["doc_list"])(lambda spark, sf_dir: functions(spark, sf_dir).sql("SELECT l.language, l.docs, l.first_path FROM (SELECT DISTINCT language FROM quarrymill_docs) s, LATERAL list_docs(s.language) l"))

# --- files at paths -----------------------------------------------------------------------------------


@add("docs_tree_round_trip", f"SELECT path, CAST(strlen(content) AS BIGINT) AS bytes, sha256(content) AS digest FROM ({MDX_DOCS})")
def docs_tree_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written to their paths in the shared folder and read back."""
    root = shared.folder(spark)
    doctree.write(mdx_docs(spark, sf_dir), root)
    return doctree.read(spark, root).select("path", F.length("content").cast("long").alias("bytes"), F.sha2("content", 256).alias("digest"))


# --- range edits ------------------------------------------------------------------------------------


@add("fix_anchor_content", f"""WITH b AS (SELECT path, list(DISTINCT href) AS hrefs FROM {V} WHERE kind = 'markdown' AND status = 'failure' AND anchor IS NOT NULL GROUP BY path)
    SELECT d.path, list_reduce(list_prepend(d.content, hrefs), lambda t, h: replace(t, '(' || h || ')', '(' || regexp_replace(h, '#.*$', '') || '#usage-notes)')) AS content FROM ({MDX_DOCS}) d JOIN b ON b.path = d.path""")
def fix_anchor_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = mdx_links.validated(mdx_docs(spark, sf_dir)).filter("kind = 'markdown' and status = 'failure' and anchor is not null").withColumn("new_anchor", F.lit("usage-notes"))
    return rewrite.anchors(mdx_docs(spark, sf_dir), failed).select("path", "content")


#: What is put in place of each number of three digits or more; edits of their last two digits overlap these and give way.
NUMBER, PUT = "[0-9]{3,}", "<number>"


@add("edits_applied", f"SELECT 'docs/' || doc_id AS path, regexp_replace(text, {quoted(NUMBER)}, {quoted(PUT)}, 'g') AS content, CAST(len(regexp_extract_all(text, {quoted(NUMBER)})) AS BIGINT) AS applied FROM documents")
def edits_applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select(F.concat(F.lit("docs/"), "doc_id").alias("path"), F.col("text").alias("content"))
    return edits.apply(docs, edits.ranges(docs, NUMBER, PUT).unionByName(edits.ranges(docs, "[0-9](?=[0-9]{2}(?![0-9]))[0-9]", "?")))


# --- headers of links ---------------------------------------------------------------------------------

#: A heading's start with its text up to the next tag, or a link with its target.
TOKEN = r'(?i)<h[1-6]\b[^>]*>[^<]*|<a\s[^>]*href="[^"]*"'
HEADER, HREF = r"(?is)^<h[1-6]\b[^>]*>(.*)$", r'(?i)href="([^"]*)"$'


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = spread(pages_rich(spark, sf_dir)).select("page_id", urls.host().column.alias("site"), F.posexplode(F.regexp_extract_all("html", F.lit(TOKEN), F.lit(0))).alias("pos", "token"))
    return each.select("page_id", "site", F.col("pos").cast("long").alias("pos"), F.nullif(F.trim(F.regexp_extract("token", HEADER, 1)), F.lit("")).alias("header"), F.nullif(F.regexp_extract("token", HREF, 1), F.lit("")).alias("href"))


_tokens = f"""SELECT page_id, site, CAST(place - 1 AS BIGINT) AS pos, nullif(trim(regexp_extract(token, {quoted(HEADER)}, 1)), '') AS header, nullif(regexp_extract(token, {quoted(HREF)}, 1), '') AS href
    FROM (SELECT page_id, site, unnest(x) AS token, generate_subscripts(x, 1) AS place FROM (SELECT page_id, {urls.host().sql} AS site, regexp_extract_all(html, {quoted(TOKEN)}) AS x FROM ({PAGES_RICH})))"""
add("link_headers", f"SELECT page_id, pos, href, header FROM (SELECT page_id, pos, href, last_value(header IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY pos) AS header FROM ({_tokens})) WHERE href IS NOT NULL")(
    lambda spark, sf_dir: fill.carried(tokens(spark, sf_dir), ["page_id"], ["pos"], "header", "last").filter("href is not null").select("page_id", "pos", "href", F.col("last").alias("header"))
)
add("site_link_headers", f"SELECT site, page_id, pos, href, header FROM (SELECT site, page_id, pos, href, last_value(header IGNORE NULLS) OVER (PARTITION BY site ORDER BY page_id, pos) AS header FROM ({_tokens})) WHERE href IS NOT NULL")(
    lambda spark, sf_dir: fill.carried(tokens(spark, sf_dir), ["site"], ["page_id", "pos"], "header", "last").filter("href is not null").select("site", "page_id", "pos", "href", F.col("last").alias("header"))
)

# --- navigation rebuilt -----------------------------------------------------------------------------------


def navigation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc, json): a navigation of each language and source, with a group for pages long and short."""
    page = F.struct((F.col("n_chars") <= 2000).alias("short"), "doc_id")
    listed = documents(spark, sf_dir).groupBy("lang", "source").agg(F.array_sort(F.collect_list(page)).alias("pages"))
    group = lambda name, short: F.struct(F.lit(name).alias("group"), F.transform(F.filter("pages", lambda p: p["short"] == short), lambda p: F.concat(F.lit("docs/"), p["doc_id"].cast("string"))).alias("pages"))
    whole = F.struct(F.col("lang").alias("tab"), F.struct(F.col("source").alias("name"), F.array(group('Long "reads"', False), group("Short", True)).alias("groups")).alias("inner"), F.lit(1.50).cast("decimal(3,2)").alias("version"))
    return listed.select(F.concat_ws("/", "lang", "source").alias("doc"), F.to_json(whole).alias("json"))


def moved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, destination): German and French pages move to folders of their language."""
    return documents(spark, sf_dir).filter(F.col("lang").isin("de", "fr")).select(F.concat(F.lit("docs/"), "doc_id").alias("source"), F.concat("lang", F.lit("/"), "doc_id").alias("destination"))


_nav = lambda folder: f"""SELECT lang || '/' || source AS doc, '{{"tab":"' || lang || '","inner":{{"name":"' || source || '","groups":[{{"group":"Long \\"reads\\"","pages":[' || coalesce(string_agg('"' || {folder} || doc_id || '"', ',' ORDER BY doc_id) FILTER (n_chars > 2000), '')
    || ']}},{{"group":"Short","pages":[' || coalesce(string_agg('"' || {folder} || doc_id || '"', ',' ORDER BY doc_id) FILTER (n_chars <= 2000), '') || ']}}]}},"version":1.50}}' AS json FROM documents GROUP BY lang, source"""  # noqa: E731
add("nav_json_round_trip", _nav("'docs/'"))(lambda spark, sf_dir: nested.rebuilt(nested.flattened(navigation(spark, sf_dir))))
add("nav_json_moved", _nav("CASE WHEN lang IN ('de', 'fr') THEN lang || '/' ELSE 'docs/' END"))(lambda spark, sf_dir: nested.rebuilt(nested.replaced(nested.flattened(navigation(spark, sf_dir)), moved(spark, sf_dir))))

# --- samples ------------------------------------------------------------------------------------------------


def sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples.by_page(samples.found(spread(pages_rich(spark, sf_dir))))


_samples = f"""SELECT page_id, url, pos, regexp_extract(tag, {quoted(samples.TAG)}, 1) AS type, regexp_extract(tag, {quoted(samples.ID)}, 1) AS i, regexp_extract(tag, {quoted(samples.CLASS)}, 1) AS c
    FROM (SELECT page_id, url, unnest(x) AS tag, generate_subscripts(x, 1) AS pos FROM (SELECT page_id, url, regexp_extract_all(html, {quoted(samples.TAG)}) AS x FROM ({PAGES_RICH})))"""
_by_page = f"""SELECT type, url, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (i <> '' OR c <> '') AS BIGINT) AS high,
    coalesce((list(CASE WHEN i <> '' THEN '#' || i ELSE '.' || c END ORDER BY page_id, pos) FILTER (i <> '' OR c <> ''))[1], type) AS hint FROM ({_samples}) GROUP BY type, url"""
add("component_samples_by_page", _by_page)(sampled)
add("component_samples", f"SELECT type, CAST(sum(n) AS BIGINT) AS total, CAST(sum(high) AS BIGINT) AS high, CAST(sum(n - high) AS BIGINT) AS low, CAST(count(*) AS BIGINT) AS pages, array_to_string(list(url ORDER BY url)[1:{samples.URLS}], ' ') AS page_urls FROM ({_by_page}) GROUP BY type")(
    lambda spark, sf_dir: samples.by_type(sampled(spark, sf_dir)).withColumn("page_urls", F.array_join("page_urls", " "))
)

# --- orders -------------------------------------------------------------------------------------------------

#: Characters of both planes that stand before a document's source, so that the orders differ.
FRONT = ["😀", "ﬁ", "é", "Z", "a", "�", "𝒳", ""]


def fronted(spark: SparkSession, sf_dir: str) -> DataFrame:
    front = F.element_at(F.array(*[F.lit(c) for c in FRONT]), (F.col("doc_id") % len(FRONT) + 1).cast("int"))
    return documents(spark, sf_dir).select("doc_id", F.concat(front, "source").alias("name"))


_fronted = f"SELECT doc_id, [{', '.join(map(quoted, FRONT))}][doc_id % {len(FRONT)} + 1] || source AS name FROM documents"
add("names_by_utf16", f"SELECT doc_id, name, CAST(row_number() OVER (ORDER BY {text.utf16_units('name')}, doc_id) - 1 AS BIGINT) AS slot FROM ({_fronted})")(
    lambda spark, sf_dir: shared.numbered(fronted(spark, sf_dir).withColumn("key", text.utf16_key(F.col("name"))), "key", "doc_id").select("doc_id", "name", "slot")
)
# The root locale's order isn't in DuckDB without its extension; the tests hold it against a given order.
add("names_by_locale")(lambda spark, sf_dir: shared.numbered(fronted(spark, sf_dir).withColumn("key", text.by_locale(F.col("name"))), "key", "doc_id").select("doc_id", "name", "slot"))

# --- sidebars ------------------------------------------------------------------------------------------------

#: Links of all kinds in a sidebar, before those that pages have.
SIDE = '<nav class="side"><a href="../up/./a?x=1#y">1</a><a href="b/../../../c/">2</a><a href="//cdn.example.org/d">3</a><a href="?q=1">4</a><a href="#top">5</a><a href="mailto:a@b.c">6</a><a href="HTTPS://Example.com/./e/..">7</a><a href="..">8</a></nav>'
SIDEBAR, ANY_HREF = r'(?is)<nav.*?</nav>|class="[^"]*sidebar[^"]*".*?</(?:div|aside|nav)>', r"""(?i)href=["']([^"']+)["']"""
TARGET = urls.resolved("href", "url")
UNDER = Dual(lambda: F.concat(urls.origin().column, F.lit("/")), f"({urls.origin().sql} || '/')")


@add("sidebar_links", f"""SELECT page_id, ord, href, target FROM (SELECT page_id, ord, href, {TARGET.sql} AS target, {UNDER.sql} AS under FROM (SELECT page_id, url, unnest(x) AS href, CAST(generate_subscripts(x, 1) - 1 AS BIGINT) AS ord
    FROM (SELECT page_id, url, regexp_extract_all(regexp_extract({quoted(SIDE)} || html, {quoted(SIDEBAR)}), {quoted(ANY_HREF)}, 1) AS x FROM pages) WHERE page_id % 2 = 0
    UNION ALL SELECT page_id, url, unnest(x), CAST(generate_subscripts(x, 1) - 1 AS BIGINT) FROM (SELECT page_id, url, regexp_extract_all(regexp_extract(html, {quoted(SIDEBAR)}), {quoted(ANY_HREF)}, 1) AS x FROM pages) WHERE page_id % 2 = 1)) WHERE starts_with(target, under)""")
def sidebar_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of each page's first sidebar that lead below the page's own site, by their targets. Every other page has a sidebar of its own before the table's."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", F.concat(F.when(F.col("page_id") % 2 == 0, SIDE).otherwise(""), "html").alias("html"))
    each = spread(pages).select("page_id", "url", F.posexplode(F.regexp_extract_all(F.regexp_extract("html", SIDEBAR, 0), F.lit(ANY_HREF), F.lit(1))).alias("ord", "href"))
    found = each.select("page_id", F.col("ord").cast("long").alias("ord"), "href", TARGET.column.alias("target"), UNDER.column.alias("under"))
    return found.filter(F.startswith("target", "under")).select("page_id", "ord", "href", "target")
