"""Registered queries: conversion, dialects, sources and sinks, and operator shapes on the larger tables (``shape_``)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.dual import quoted
from ..operators import convert, dialects, mdx_links, resume, rewrite
from ..sources import files, sinks
from .doc_queries import V
from .page_queries import pages_rich, spread
from .views import MDX_DOCS, dealt, dealt_sql, mdx_docs

Q: dict = {}
S: dict = {}

Q["html_to_mdx"] = lambda spark, sf_dir: convert.convert_pages(spread(pages_rich(spark, sf_dir)), convert.Config(content_selector="article", remove=["footer", "div.ad"]))
Q["table_to_gfm"] = lambda spark, sf_dir: convert.tables_to_gfm(spread(pages_rich(spark, sf_dir)))
Q["content_images"] = lambda spark, sf_dir: convert.content_images(spread(pages_rich(spark, sf_dir))).select("page_id", F.array_join("srcs", "|").alias("srcs"))
HUB = '\n<Callout icon="📘" theme="warn">\nMind\n</Callout>\n\n> 👍 Good\n>\n> body\n\n[a](doc:intro#x) [b](ref:y)\n\n```js\nf()\n```\n```py\ng()\n```\n***\n'
SITE = "\n:::note[Read]\nbody\n:::\n<Tabs groupId=\"x\">\n<TabItem value=\"a\" label=\"A\">t</TabItem>\n</Tabs>\n<details>\n<summary>S</summary>\nx\n</details>\n[l](./a.md#b)\n<!-- c -->\n### Anchored {#here}\n{@doc: \"L|/l\"}\nimport P from './_part.md'\n"
Q["hub_to_mdx"] = lambda spark, sf_dir: rewrite.apply(mdx_docs(spark, sf_dir).withColumn("content", F.concat("content", F.lit(HUB))), dialects.from_hub)
Q["site_to_mdx"] = lambda spark, sf_dir: dialects.convert_site(mdx_docs(spark, sf_dir).withColumn("content", F.concat("content", F.lit(SITE))))

PATHS = ("path string", [("docs/a-~.mdx",), ("docs/snippets/x-~.mdx",), ("my-snippets-guide/b-~.mdx",), ("node_modules/p/c-~.mdx",), (".git/d-~.mdx",), ("docs/.hidden/e-~.mdx",), ("build/f-~.mdx",), ("docs/g-~.md",), ("docs/sub/a-~.mdx",), ("h-~.mdx",)])
P_SQL = f"({dealt_sql(*PATHS)})"
MDX_ONLY = "path LIKE '%.mdx'"
FOLDERS = "string_split(regexp_replace(path, '/?[^/]*$', ''), '/')"
for _rule, _where in {
    "links": "NOT contains(path, 'snippets')",
    "check": f"NOT list_has_any({FOLDERS}, ['snippets', 'node_modules', '.git'])",
    "fix": f"NOT list_has_any({FOLDERS}, ['node_modules', '.git'])",
    "visible": f"NOT regexp_matches(path, '(^|/)\\.[^/]') AND NOT list_contains({FOLDERS}, 'node_modules')",
    "site": f"NOT list_has_any({FOLDERS}, ['node_modules', '.git', '.docusaurus', 'build', 'dist', '.cache'])",
}.items():
    Q[f"walk_{_rule}"] = lambda spark, sf_dir, r=_rule: files.walk(dealt(spark, sf_dir, *PATHS), r)
    S[f"walk_{_rule}"] = f"SELECT path FROM {P_SQL} WHERE {MDX_ONLY} AND {_where}"
Q["filename_map"] = lambda spark, sf_dir: files.by_name(files.walk(dealt(spark, sf_dir, *PATHS), "fix"))
S["filename_map"] = f"SELECT regexp_extract(path, '([^/]+?)(?:\\.mdx)?$', 1) AS name, string_agg(path, ',' ORDER BY path) AS paths, CAST(count(*) AS BIGINT) AS n FROM ({S['walk_fix']}) GROUP BY 1"
LINES = ("line string", [("x ⎿ /b-~#frag",), (" ⎿  /a ",), ("a ⎿ b ⎿ /c/d-~",), ("no mark /z",), ("⎿ relative-~",), ("⎿ /a-~",)])
Q["broken_link_report"] = lambda spark, sf_dir: files.broken_links(dealt(spark, sf_dir, *LINES))
S["broken_link_report"] = f"SELECT DISTINCT string_split(p, '#')[1] AS path FROM (SELECT trim(string_split(line, '⎿')[-1]) AS p FROM ({dealt_sql(*LINES)}) WHERE contains(line, '⎿')) WHERE starts_with(p, '/')"
ANSWERS = ("url string, body string", [("u1-~", '{"article": {"body": "B", "slug": "s-~"}, "t": "T"}'), ("u2-~", '{"article": {"body": "B"}}'), ("u3-~", "{}"), ("u4-~", '{"article": {"slug": "only"}}')])
Q["api_articles"] = lambda spark, sf_dir: files.articles(dealt(spark, sf_dir, *ANSWERS), "article.body", "article.slug", "t")
S["api_articles"] = f"SELECT url, json_extract_string(body, '$.article.body') AS content, json_extract_string(body, '$.article.slug') AS path, json_extract_string(body, '$.t') AS title, CASE WHEN json_extract_string(body, '$.article.body') IS NULL THEN 'missing article.body' WHEN json_extract_string(body, '$.article.slug') IS NULL THEN 'missing article.slug' END AS error FROM ({dealt_sql(*ANSWERS)})"
COOKIES = ("name string, value string, domain string", [("a", "1", ".example~.org"), ("b", "2", "docs.example~.org"), ("c", "3", "ample~.org"), ("d-~", "4", "site~.net")])
HOSTS = ("host string", [("docs.example~.org",), ("example~.org",), ("x.site~.net",)])
Q["session_cookies"] = lambda spark, sf_dir: files.cookies_for(dealt(spark, sf_dir, *COOKIES), dealt(spark, sf_dir, *HOSTS))
S["session_cookies"] = f"WITH c AS (SELECT name, value, ltrim(domain, '.') AS d FROM ({dealt_sql(*COOKIES)})) SELECT host, name, value FROM ({dealt_sql(*HOSTS)}) JOIN c ON host = d OR host LIKE '%.' || d"
STATUS = ("status long, location string", [(301, "/n-~#x"), (302, "/m-~"), (308, None), (200, "/o-~"), (429, None)])
Q["redirect_probe"] = lambda spark, sf_dir: resume.redirected(dealt(spark, sf_dir, *STATUS))
S["redirect_probe"] = f"SELECT CAST(status AS BIGINT) AS status, CASE WHEN status IN (301, 302, 307, 308) THEN string_split(location, '#')[1] END AS destination, status = 429 AS retry FROM ({dealt_sql(*STATUS)})"
SITEMAPS = ("url string, body string", [("/sitemap-~.xml", "<sitemapindex><sitemap><loc>/s1-~.xml</loc></sitemap><sitemap><loc>/s2-~.xml</loc></sitemap></sitemapindex>"), ("/s1-~.xml", "<urlset><url><loc>/a-~</loc></url><url><loc> /b-~ </loc></url></urlset>"), ("/s2-~.xml", "<sitemapindex><loc>/s3-~.xml</loc></sitemapindex>"), ("/s3-~.xml", "<urlset><loc>/a-~</loc><loc>/c</loc></urlset>"), ("/s4-~.xml", "<urlset><loc>/never</loc></urlset>")])


def sitemap_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import frontier

    maps = dealt(spark, sf_dir, *SITEMAPS)
    return frontier.sitemap_urls(maps, maps.filter(maps.url.startswith("/sitemap")).select("url"))


Q["sitemap_urls"] = sitemap_urls
S["sitemap_urls"] = f"WITH RECURSIVE d AS ({dealt_sql(*SITEMAPS)}), l AS (SELECT url, contains(body, '<sitemapindex') AS idx, unnest(regexp_extract_all(body, '<loc>\\s*([^<\\s]+)\\s*</loc>', 1)) AS loc FROM d), r AS (SELECT url, 0 AS n FROM d WHERE url LIKE '/sitemap%' UNION SELECT l.loc, r.n + 1 FROM r JOIN l ON l.url = r.url AND l.idx WHERE r.n < 3) SELECT DISTINCT l.loc AS url FROM r JOIN l ON l.url = r.url AND NOT l.idx"
Q["link_report_markdown"] = lambda spark, sf_dir: sinks.link_markdown(mdx_links.validated(mdx_docs(spark, sf_dir)))
S["link_report_markdown"] = f"""WITH v AS (SELECT * FROM {V})
SELECT '' AS path, '# Link report\n\n- Total: ' || count(*) || '\n- Success: ' || count(*) FILTER (status = 'success') || '\n- Failure: ' || count(*) FILTER (status = 'failure') || '\n- Error: ' || count(*) FILTER (status = 'error') || '\n' || CASE WHEN count(*) FILTER (status <> 'success') = 0 THEN '\nAll links are valid.\n' ELSE '' END AS section FROM v
UNION ALL SELECT path, '\n## ' || path || '\n\n' || string_agg('- line ' || line || ': `' || href || '`', '\n' ORDER BY line, href) || '\n' FROM v WHERE status <> 'success' GROUP BY path"""
Q["parse_summary"] = lambda spark, sf_dir: sinks.parse_summary(rewrite.lint(mdx_docs(spark, sf_dir)))
CHANGED = "SELECT path, replace(content, '<br>', '<br />') AS content FROM (" + MDX_DOCS + ") WHERE contains(content, '<br>')"
Q["changed_documents"] = lambda spark, sf_dir: sinks.write_changed(mdx_docs(spark, sf_dir), mdx_docs(spark, sf_dir).select("path", F.replace("content", F.lit("<br>"), F.lit("<br />")).alias("content")), "", dry_run=True)
S["changed_documents"] = CHANGED
SLUGS = ("path string, content string", [("a-~.md", '---\nslug: "/x-~"\nid: y\n---\n'), ("b-~.md", "---\nid: z-~\n---\n"), ("c-~.md", "no"), ("d-~.md", "---\ntitle: t\n---\n")])
Q["document_slugs"] = lambda spark, sf_dir: files.slugs(dealt(spark, sf_dir, *SLUGS))
S["document_slugs"] = f"SELECT path, coalesce({', '.join(f'nullif(regexp_extract(content, {quoted(p)}, 1), {quoted(str())})' for p in files.SLUG_OF)}) AS slug FROM ({dealt_sql(*SLUGS)})"

# --- shapes ---------------------------------------------------------------------------------


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


Q["shape_resume_antijoin"] = lambda spark, sf_dir: t(spark, sf_dir, "orders").select("o_orderkey").join(t(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_anti")
S["shape_resume_antijoin"] = "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')"


def shape_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Every order was checked before, some fail; those of the upper priorities were checked again.
    orders = t(spark, sf_dir, "orders")
    url = F.col("o_orderkey").cast("string").alias("url")
    old = orders.select(url, F.when(F.col("o_orderstatus") == "F", 500).when(F.col("o_orderstatus") == "O", 404).otherwise(200).alias("status")).filter("status <> 200")
    new = orders.filter("o_orderpriority < '4'").select(url, F.when(F.col("o_orderpriority") < "3", 200).otherwise(503).alias("status"))
    return resume.merge_failures(old, new).groupBy(F.col("status").cast("long").alias("status")).agg(F.count("*").alias("n"))


Q["shape_resume_merge"] = shape_merge
S["shape_resume_merge"] = "SELECT CAST(s AS BIGINT) AS status, CAST(count(*) AS BIGINT) AS n FROM (SELECT CASE WHEN o_orderpriority < '3' THEN NULL WHEN o_orderpriority < '4' THEN 503 WHEN o_orderstatus = 'F' THEN 500 WHEN o_orderstatus = 'O' THEN 404 END AS s FROM orders) WHERE s IS NOT NULL GROUP BY 1"
Q["shape_topk_ties"] = lambda spark, sf_dir: t(spark, sf_dir, "part").groupBy("p_brand").agg(F.count("*").alias("n"), F.min("p_partkey").alias("first")).orderBy(F.desc("n"), "first").limit(10)
S["shape_topk_ties"] = "SELECT p_brand, CAST(count(*) AS BIGINT) AS n, min(p_partkey) AS first FROM part GROUP BY 1 ORDER BY 2 DESC, 3 LIMIT 10"


def shape_topk_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = W.partitionBy("l_suppkey").orderBy(F.desc("n"), "l_partkey")
    counts = t(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.count("*").alias("n"))
    return counts.withColumn("rank", F.row_number().over(order).cast("long")).filter("rank <= 3")


Q["shape_topk_per_group"] = shape_topk_group
S["shape_topk_per_group"] = "SELECT l_suppkey, l_partkey, CAST(count(*) AS BIGINT) AS n, CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY count(*) DESC, l_partkey) AS BIGINT) AS rank FROM lineitem GROUP BY 1, 2 QUALIFY rank <= 3"
Q["shape_status_pivot"] = lambda spark, sf_dir: t(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(*[F.count_if(F.col("o_orderstatus") == s).alias(s.lower()) for s in ("F", "O", "P")])
S["shape_status_pivot"] = "SELECT o_orderpriority, " + ", ".join(f"CAST(sum(CASE WHEN o_orderstatus = '{s}' THEN 1 ELSE 0 END) AS BIGINT) AS {s.lower()}" for s in ("F", "O", "P")) + " FROM orders GROUP BY 1"


def consecutive_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of equal event types per user."""
    own = W.partitionBy("user_id").orderBy("ts", "event_id")
    fresh = F.when(F.col("event_type") == F.lag("event_type").over(own), 0).otherwise(1)
    runs = t(spark, sf_dir, "events").withColumn("_new", fresh).withColumn("run", F.sum("_new").over(own))
    return runs.groupBy("user_id", "run").agg(F.first("event_type").alias("event_type"), F.count("*").alias("n")).filter("n > 1").select("user_id", F.col("run").cast("long").alias("run"), "event_type", "n")


Q["consecutive_groups"] = consecutive_groups
S["consecutive_groups"] = "WITH f AS (SELECT *, CASE WHEN event_type = lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) THEN 0 ELSE 1 END AS n0 FROM events), r AS (SELECT *, sum(n0) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM f) SELECT user_id, CAST(run AS BIGINT) AS run, min(event_type) AS event_type, CAST(count(*) AS BIGINT) AS n FROM r GROUP BY 1, 2 HAVING count(*) > 1"
Q["shape_majority"] = lambda spark, sf_dir: t(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n")).withColumn("share", F.round(F.col("n") / F.sum("n").over(W.partitionBy()), 6)).orderBy(F.desc("n"), "event_type").limit(1)
S["shape_majority"] = "SELECT event_type, CAST(count(*) AS BIGINT) AS n, round(count(*) / CAST(sum(count(*)) OVER () AS DOUBLE), 6) AS share FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1"
Q["shape_daily_counts"] = lambda spark, sf_dir: t(spark, sf_dir, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type").agg(F.count("*").alias("n"))
S["shape_daily_counts"] = "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1, 2"
Q["shape_batches"] = lambda spark, sf_dir: resume.batches(t(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 100).groupBy("batch").agg(F.count("*").alias("n"), F.max("o_orderkey").alias("last"))
S["shape_batches"] = "SELECT batch, CAST(count(*) AS BIGINT) AS n, max(o_orderkey) AS last FROM (SELECT o_orderkey, CAST((row_number() OVER (ORDER BY o_orderkey) - 1) // 100 + 1 AS BIGINT) AS batch FROM orders) GROUP BY 1"
