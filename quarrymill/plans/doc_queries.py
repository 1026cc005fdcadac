"""Registered queries over documents and markdown: search, headings, links, rewriting, navigation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..functions.dual import Dual, named, quoted
from ..operators import mdx_links, nav, rewrite, search
from . import views
from .views import MDX_DOCS, dealt, dealt_sql, mdx_docs, rows, values_sql

Q: dict = {}
S: dict = {}


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.index(documents(spark, sf_dir))


def score_sql(query: str) -> str:
    title, tags, body = "lower(string_split(text, chr(10))[1])", "lower(lang || ' ' || source)", "lower(string_split(text, chr(10))[1] || '  ' || text)"
    return " + ".join(f"{text.occurrences_sql(title, w)} * 3 + {text.occurrences_sql(tags, w)} * 2 + {text.occurrences_sql(body, w)}" for w in query.lower().split())


def search_sql(query: str, limit: int, threshold: float, where: str = "TRUE") -> str:
    word = query.lower().split()[0]
    return f"""SELECT rank, CAST(doc_id AS VARCHAR) AS id, 'docs/' || CAST(doc_id AS VARCHAR) AS path, string_split(text, chr(10))[1] AS title, score,
    trim(regexp_replace(substr(text, CAST(greatest(instr(lower(text), {quoted(word)}) - 61, 0) + 1 AS INTEGER), 200), '\\n+', ' ', 'g')) AS snippet
    FROM (SELECT *, CAST(row_number() OVER (ORDER BY score DESC, doc_id) AS BIGINT) AS rank, max(score) OVER () AS best FROM (SELECT *, {score_sql(query)} AS score FROM documents WHERE {where}) WHERE score > 0)
    WHERE rank <= {limit} AND CAST(score AS DOUBLE) / best >= {threshold}"""


Q["doc_search_topk"] = lambda spark, sf_dir: search.search(indexed(spark, sf_dir), "the thing", 20)
S["doc_search_topk"] = search_sql("the thing", 20, 0.0)
Q["doc_search_filtered"] = lambda spark, sf_dir: search.search(indexed(spark, sf_dir), "de que src3", 10, 0.4, language="fr")
S["doc_search_filtered"] = search_sql("de que src3", 10, 0.4, "lang = 'fr'")

LOOKUPS = ["docs/3", "5", "/docs/8", "//docs/11", "nothing", "docs/99999999"]


def doc_lookup_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.lookup(indexed(spark, sf_dir), rows(spark, "key string", [(k,) for k in LOOKUPS]))


Q["doc_lookup_multi"] = doc_lookup_multi
S["doc_lookup_multi"] = f"WITH k AS ({values_sql('key', [(k,) for k in LOOKUPS])}), d AS (SELECT doc_id, string_split(text, chr(10))[1] AS title FROM documents) SELECT k.key, min(d.doc_id) AS doc_id, min(d.title) AS title FROM k LEFT JOIN d ON k.key IN ('docs/' || d.doc_id, CAST(d.doc_id AS VARCHAR), '/docs/' || d.doc_id, '//docs/' || d.doc_id) GROUP BY 1"
Q["doc_list"] = lambda spark, sf_dir: indexed(spark, sf_dir).groupBy("language").agg(F.count("*").alias("docs"), F.min("path").alias("first_path"))
S["doc_list"] = "SELECT lang AS language, CAST(count(*) AS BIGINT) AS docs, min('docs/' || doc_id) AS first_path FROM documents GROUP BY 1"


def text_query(name: str, parts: dict[str, Dual], source: str = "SELECT doc_id, text AS t FROM documents") -> None:
    Q[name] = lambda spark, sf_dir: documents(spark, sf_dir).select("doc_id", F.col("text").alias("t")).select("doc_id", *[d.column.alias(n) for n, d in parts.items()])
    S[name] = f"SELECT doc_id, {', '.join(f'{d.sql} AS {n}' for n, d in parts.items())} FROM ({source})"


T = named("t")
text_query("text_slugs", {"kebab": text.kebab(T), "nav": text.slug_nav(T), "plain": text.slug_plain(T)})
text_query("text_headings", {"heading": text.heading_text(T)})
text_query("text_yaml", {"yaml": text.yaml_value(T), "label": text.human(T)})
ALIASES = [(x,) for x in [*text.LANGUAGES, "JS", "Python", "", "zig", "lang-~"]]
Q["language_aliases"] = lambda spark, sf_dir: dealt(spark, sf_dir, "t string", ALIASES).groupBy("t", text.language(T).column.alias("language")).agg(F.count("*").alias("n"))
S["language_aliases"] = f"SELECT t, {text.language(T).sql} AS language, CAST(count(*) AS BIGINT) AS n FROM ({dealt_sql('t string', ALIASES)}) GROUP BY 1, 2"

Q["mdx_headings"] = lambda spark, sf_dir: mdx_links.headings(mdx_docs(spark, sf_dir))
S["mdx_headings"] = mdx_links.headings_sql(MDX_DOCS)
Q["mdx_links"] = lambda spark, sf_dir: mdx_links.resolved(mdx_links.links(mdx_docs(spark, sf_dir)))
S["mdx_links"] = mdx_links.resolved_sql(mdx_links.links_sql(MDX_DOCS))
Q["mdx_link_validation"] = lambda spark, sf_dir: mdx_links.validated(mdx_docs(spark, sf_dir))
S["mdx_link_validation"] = mdx_links.validated_sql(MDX_DOCS)
V = f"({S['mdx_link_validation']})"
Q["link_summary"] = lambda spark, sf_dir: mdx_links.validated(mdx_docs(spark, sf_dir)).agg(F.count("*").alias("total"), F.count_if(F.col("status") == "success").alias("success"), F.count_if(F.col("status") == "failure").alias("failure"), F.bool_or(F.col("status") != "success").alias("failed"))
S["link_summary"] = f"SELECT CAST(count(*) AS BIGINT) AS total, CAST(sum(CASE WHEN status = 'success' THEN 1 ELSE 0 END) AS BIGINT) AS success, CAST(sum(CASE WHEN status = 'failure' THEN 1 ELSE 0 END) AS BIGINT) AS failure, bool_or(status <> 'success') AS failed FROM {V}"
Q["link_summary_by_file"] = lambda spark, sf_dir: mdx_links.validated(mdx_docs(spark, sf_dir)).groupBy("path").agg(F.count_if(F.col("status") == "success").alias("success"), F.count_if(F.col("status") == "failure").alias("failure"))
S["link_summary_by_file"] = f"SELECT path, CAST(sum(CASE WHEN status = 'success' THEN 1 ELSE 0 END) AS BIGINT) AS success, CAST(sum(CASE WHEN status = 'failure' THEN 1 ELSE 0 END) AS BIGINT) AS failure FROM {V} GROUP BY 1"
Q["link_failures_by_file"] = lambda spark, sf_dir: mdx_links.validated(mdx_docs(spark, sf_dir)).filter("status <> 'success'").groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "href"))), lambda x: F.concat_ws(":", x["line"], x["href"])), " ").alias("failures"))
S["link_failures_by_file"] = f"SELECT path, string_agg(line || ':' || href, ' ' ORDER BY line, href) AS failures FROM {V} WHERE status <> 'success' GROUP BY 1"
Q["mdx_duplicate_headings"] = lambda spark, sf_dir: mdx_links.duplicate_ordinals(mdx_links.headings(mdx_docs(spark, sf_dir))).filter("ordinal > 1").select("path", "pos", "text", "ordinal")
S["mdx_duplicate_headings"] = f"SELECT path, pos, text, CAST(r AS BIGINT) AS ordinal FROM (SELECT *, row_number() OVER (PARTITION BY path, lower(text) ORDER BY pos) AS r FROM ({S['mdx_headings']})) WHERE r > 1"

RENDERED = (views.RENDERED_SCHEMA, views.RENDERED, ("pair",))
REN = f"({dealt_sql(*RENDERED)})"


def heading_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In each pair of pages: the first's headings by the second's, which begins with one more of the first."""
    r = dealt(spark, sf_dir, *RENDERED)
    first = r.page.startswith("/a")
    return mdx_links.matched_headings(r.filter(first), r.filter(~first | (r.pos == 1)), "pair")


Q["heading_match_by_ordinal"] = heading_match
_own = lambda where: f"SELECT *, lower(text) AS key, row_number() OVER (PARTITION BY pair, lower(text) ORDER BY pos) AS o, count(*) OVER (PARTITION BY pair, lower(text)) AS n FROM {REN} WHERE {where}"
S["heading_match_by_ordinal"] = f"""WITH a AS ({_own("page LIKE '/a%'")}), b AS ({_own("page LIKE '/b%' OR pos = 1")})
SELECT a.pair, a.key, a.pos AS source_pos, CAST(a.o AS BIGINT) AS source_ordinal, b.pos AS target_pos, b.id AS target_id FROM a JOIN b ON a.pair = b.pair AND a.key = b.key AND b.o = least(a.o, b.n)"""
FUZZY = ("page string, link_text string", [("/a~", "set up"), ("/a~", "Install command line tool"), ("/a~", "usage and more"), ("/b~", "install the command tool"), ("/b~", "notes usage"), ("/b~", "zzz"), ("/b~", "up")])
Q["mdx_fuzzy_heading"] = lambda spark, sf_dir: mdx_links.fuzzy(dealt(spark, sf_dir, *FUZZY), dealt(spark, sf_dir, *RENDERED))
S["mdx_fuzzy_heading"] = f"""WITH w AS ({dealt_sql(*FUZZY)}), j AS (SELECT w.page, w.link_text, r.text, r.id, r.pos, lower(trim(r.text)) AS h, lower(trim(w.link_text)) AS t FROM w JOIN {REN} r ON r.page = w.page),
k AS (SELECT *, len(string_split(t, ' ')) AS n, len(list_filter(string_split(t, ' '), lambda x: list_contains(string_split(h, ' '), x))) AS hits FROM j),
s AS (SELECT *, CASE WHEN h = t THEN 100 WHEN contains(h, t) THEN 80 WHEN contains(t, h) THEN 70 WHEN hits = n AND n >= 2 THEN 60 WHEN hits >= ceil(n * 0.7) AND n >= 3 THEN 50 END AS score FROM k)
SELECT page, link_text, text, id, CAST(score AS BIGINT) AS score FROM s WHERE score IS NOT NULL QUALIFY row_number() OVER (PARTITION BY page, link_text ORDER BY score DESC, pos) = 1"""

RED = views.REDIRECTS
Q["fix_redirects"] = lambda spark, sf_dir: rewrite.redirects(mdx_docs(spark, sf_dir), [(s, d) for _, s, d in RED]).select("path", "content", "replacements")
_c, _n = "content", []
for _, _s, _d in RED:
    _p = "([\"''(])" + _s + "([)\"''#\\s])"
    _n.append(f"len(regexp_extract_all({_c}, '{_p}'))")
    _c = f"regexp_replace({_c}, '{_p}', '\\1{_d}\\2', 'g')"
S["fix_redirects"] = f"SELECT path, {_c} AS content, CAST({' + '.join(_n)} AS BIGINT) AS replacements FROM ({MDX_DOCS})"



def moved_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A redirect for each German and French document."""
    at = F.concat(F.lit("/docs/"), (F.col("doc_id") % 7).cast("string"), F.lit("/page-"), F.col("doc_id").cast("string"))
    return documents(spark, sf_dir).filter(F.col("lang").isin("de", "fr")).select(F.col("doc_id").alias("ord"), at.alias("source"), F.concat_ws("/", F.lit("/moved"), "lang", "doc_id").alias("destination"))


Q["fix_redirects_moved"] = lambda spark, sf_dir: rewrite.redirects_from(mdx_docs(spark, sf_dir), moved_documents(spark, sf_dir))
_next = "'(/docs/' || CAST(n.doc_id % 7 AS VARCHAR) || '/page-' || CAST(n.doc_id AS VARCHAR) || ')'"
S["fix_redirects_moved"] = f"""WITH m AS ({MDX_DOCS}), d AS (SELECT doc_id, 'docs/' || CAST(doc_id % 7 AS VARCHAR) || '/page-' || CAST(doc_id AS VARCHAR) || CASE WHEN doc_id % 11 = 0 THEN '/index' ELSE '' END || '.mdx' AS path FROM documents)
SELECT m.path, CASE WHEN n.doc_id IS NULL THEN content ELSE replace(content, {_next}, '(/moved/' || n.lang || '/' || CAST(n.doc_id AS VARCHAR) || ')') END AS content, CAST(CASE WHEN n.doc_id IS NULL THEN 0 ELSE 1 END AS BIGINT) AS replacements
FROM m JOIN d ON d.path = m.path LEFT JOIN documents n ON n.doc_id = d.doc_id + 1 AND n.lang IN ('de', 'fr')"""

H1 = r'(?s)^(---\n.*?\n---\n)(\s*)# ([^\n]+)\n\n?(.*)$'
Q["fix_h1"] = lambda spark, sf_dir: rewrite.duplicate_h1(mdx_docs(spark, sf_dir))
S["fix_h1"] = f"SELECT path, CASE WHEN hit THEN regexp_replace(content, {quoted(H1)}, '\\1\\2\\4') ELSE content END AS content, hit AS changed FROM (SELECT path, content, regexp_matches(content, {quoted(H1)}) AND trim(regexp_extract(content, {quoted(H1)}, 3)) = regexp_extract(content, '(?m)^title: \"([^\"]*)\"', 1) AS hit FROM ({MDX_DOCS}))"
Q["fix_void_tags_count"] = lambda spark, sf_dir: rewrite.void_tag_counts(mdx_docs(spark, sf_dir))
S["fix_void_tags_count"] = f"SELECT path, CAST(len(list_filter(regexp_extract_all(regexp_replace({mdx_links.blanked_sql('content', True)}, '`[^`]+`', '', 'g'), {quoted(rewrite.VOID)}), lambda x: NOT regexp_matches(x, '/>$'))) AS BIGINT) AS void_tags FROM ({MDX_DOCS})"
Q["fix_parse"] = lambda spark, sf_dir: rewrite.apply(mdx_docs(spark, sf_dir), rewrite.parse_fixes)
Q["fix_codeblocks"] = lambda spark, sf_dir: rewrite.apply(mdx_docs(spark, sf_dir), rewrite.fence_flags_default)
Q["fix_images"] = lambda spark, sf_dir: rewrite.apply(mdx_docs(spark, sf_dir), rewrite.frame_images)
Q["fix_inline_images"] = lambda spark, sf_dir: rewrite.apply(mdx_docs(spark, sf_dir), rewrite.inline_images)
Q["fix_imports"] = lambda spark, sf_dir: rewrite.missing_imports(mdx_docs(spark, sf_dir), rows(spark, "path string", [("/snippets/chart.mdx",), ("/snippets/my-widget.jsx",)]))
Q["tabs_to_codegroup"] = lambda spark, sf_dir: rewrite.apply(mdx_docs(spark, sf_dir).withColumn("content", F.concat("content", F.lit(rewrite.SAMPLE_TABS))), rewrite.tabs_to_code_group)
Q["mdx_lint"] = lambda spark, sf_dir: rewrite.lint(mdx_docs(spark, sf_dir))
Q["metadata_upsert"] = lambda spark, sf_dir: rewrite.upsert_meta(mdx_docs(spark, sf_dir).withColumn("meta", F.create_map(F.lit("og:title"), F.lit('A "b"'), F.lit("lang"), F.lit("xx"))))
Q["image_srcs"] = lambda spark, sf_dir: rewrite.image_srcs(mdx_docs(spark, sf_dir))
S["image_srcs"] = f"SELECT DISTINCT src FROM (SELECT unnest(list_concat(regexp_extract_all(content, {quoted(rewrite.MD_IMAGE)}, 1), regexp_extract_all(content, {quoted(rewrite.HTML_IMAGE)}, 1))) AS src FROM ({MDX_DOCS}))"
Q["fix_anchor_lines"] = lambda spark, sf_dir: rewrite.anchors(mdx_docs(spark, sf_dir), mdx_links.validated(mdx_docs(spark, sf_dir)).filter("kind = 'markdown' and status = 'failure' and anchor is not null").withColumn("new_anchor", F.lit("usage-notes"))).select("path", "fixes", "changed")
_b = f"SELECT path, line, href FROM {V} WHERE kind = 'markdown' AND status = 'failure' AND anchor IS NOT NULL"
S["fix_anchor_lines"] = f"SELECT d.path, CAST(count(*) AS BIGINT) AS fixes, string_agg(b.line || ':' || regexp_replace(b.href, '#.*$', '') || '#usage-notes', ' ' ORDER BY b.line) AS changed FROM ({MDX_DOCS}) d JOIN ({_b}) b ON b.path = d.path GROUP BY 1"

# --- navigation -------------------------------------------------------------------------------

#: A navigation of its own for each block of documents.
NAVS = (views.NAV_SCHEMA, views.NAV, views.NAV_IDS)
NAV = f"({dealt_sql(*NAVS)})"


def nav_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dealt(spark, sf_dir, *NAVS)


SLUG = lambda c: text.slug_nav(named(c)).sql
WALK = f"WITH RECURSIVE n AS (SELECT * FROM {NAV}), w AS (SELECT node_id, kind, name, page, CAST([] AS VARCHAR[]) AS folders, lpad(CAST(ord AS VARCHAR), 4, '0') AS place FROM n WHERE parent_id IS NULL UNION ALL SELECT n.node_id, n.kind, n.name, n.page, CASE WHEN w.name IS NULL THEN w.folders ELSE list_append(w.folders, w.name) END, w.place || '.' || lpad(CAST(n.ord AS VARCHAR), 4, '0') FROM n JOIN w ON n.parent_id = w.node_id)"
Q["nav_pages"] = lambda spark, sf_dir: nav.leaves(nav_frame(spark, sf_dir))
S["nav_pages"] = f"WITH RECURSIVE n AS (SELECT * FROM {NAV}), w AS (SELECT * FROM n WHERE parent_id IS NULL UNION ALL SELECT n.* FROM n JOIN w ON n.parent_id = w.node_id WHERE n.kind IN ({', '.join(map(quoted, nav.CHECK_KEYS))})) SELECT page, min(node_id) AS node_id FROM w WHERE page IS NOT NULL GROUP BY 1"
Q["nav_paths"] = lambda spark, sf_dir: nav.new_paths(nav.walk(nav_frame(spark, sf_dir)))
S["nav_paths"] = f"""{WALK}, f AS (SELECT page, list_filter(list_transform(folders, lambda x: {text.slug_nav(named('x')).sql}), lambda x: x <> '') AS fs, string_split(page, '/') AS seg FROM w WHERE page IS NOT NULL),
g AS (SELECT page, fs, seg, CASE WHEN len(fs) > 0 AND {text.slug_nav(named('seg[-1]')).sql} = fs[-1] THEN 'index' ELSE seg[-1] END AS file FROM f)
SELECT page, array_to_string(list_concat(list_concat(CASE WHEN len(seg) > 1 THEN [seg[1]] ELSE CAST([] AS VARCHAR[]) END, fs), [file]), '/') AS new_path FROM g"""
Q["nav_moves"] = lambda spark, sf_dir: nav.moves(nav.new_paths(nav.walk(nav_frame(spark, sf_dir))))
S["nav_moves"] = f"SELECT '/' || page AS source, '/' || new_path AS destination FROM ({S['nav_paths']}) WHERE page <> new_path"
TITLES = ("page string, title string", [("start/advanced-use-~", "Advanced use ~"), ("api/models-~", "The Models"), ("deep/deeper-~", "Deeper ~"), ("start/intro-~", "Getting Started ~")])
Q["nav_promotions"] = lambda spark, sf_dir: nav.promotions(nav_frame(spark, sf_dir), dealt(spark, sf_dir, *TITLES))
S["nav_promotions"] = f"""WITH n AS (SELECT * FROM {NAV}), t AS ({dealt_sql(*TITLES)}), firsts AS (SELECT parent_id, page FROM n QUALIFY row_number() OVER (PARTITION BY parent_id ORDER BY ord) = 1)
SELECT g.node_id, g.name, f.page AS root FROM n g JOIN n p ON p.node_id = g.parent_id JOIN firsts f ON f.parent_id = g.node_id JOIN t ON t.page = f.page
WHERE g.name IS NOT NULL AND g.kind = 'pages' AND p.kind IN ('groups', 'pages') AND f.page IS NOT NULL AND {SLUG('t.title')} = {SLUG('g.name')}"""
FILES = ("path string, title string", [("start/intro-~.mdx", "Intro"), ("api/overview-~/index.mdx", "Overview"), ("community-~.mdx", "Community"), ("other/models-~.mdx", "Models"), ("a/tuning-~.mdx", "T1"), ("b/tuning-~.mdx", "T2")])
Q["nav_missing"] = lambda spark, sf_dir: nav.missing(nav.leaves(nav_frame(spark, sf_dir)), dealt(spark, sf_dir, *FILES))
S["nav_missing"] = f"SELECT page FROM ({S['nav_pages']}) WHERE page || '.mdx' NOT IN (SELECT replace(path, '/index.mdx', '.mdx') FROM ({dealt_sql(*FILES)}))"
Q["nav_titles"] = lambda spark, sf_dir: nav.titles(nav.leaves(nav_frame(spark, sf_dir)), dealt(spark, sf_dir, *FILES))
_name = lambda c: f"regexp_extract({c}, '([^/]+?)(?:\\.mdx)?$', 1)"
S["nav_titles"] = f"""WITH f AS ({dealt_sql(*FILES)}), u AS (SELECT {_name('path')} AS name, min(title) AS title FROM f GROUP BY 1 HAVING count(*) = 1)
SELECT p.page, coalesce(f.title, u.title) AS title FROM ({S['nav_pages']}) p LEFT JOIN f ON f.path = p.page || '.mdx' LEFT JOIN u ON u.name = {_name('p.page')}"""
