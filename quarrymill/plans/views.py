"""Derived inputs, the same rows in both engines: pages with richer markup, markdown documents, a navigation tree, redirects, probes.

The raw tables hold little markup, so most detectors would find nothing. Each view is the
raw rows and a snippet chosen by id, or a short list of fixed rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dual import quoted

SNIPPETS = [
    '<table><thead><tr><th>Key</th><th>Value</th></tr></thead><tr><td>a|b</td><td>1</td></tr></table><pre class="language-python">x</pre>',
    '<pre><code class="language-js">f()</code></pre><pre class="lang-Bash">ls</pre><div class="admonition warning">Mind</div><div class="admonition tip">Try</div>',
    '<iframe width="5" src="https://www.youtube.com/embed/1"></iframe><iframe src="https://codepen.io/x"></iframe><video controls></video>',
    '<details><summary>More</summary>Body</details><div class="accordion-item">x</div><div class="tabs tabs-container" role="tablist">t</div>',
    '<my-widget a="1"></my-widget><my-widget></my-widget><doc-card></doc-card><x-skip></x-skip><div class="info-box">i</div><div class="info-box">j</div><div class="hero-panel wide">h</div>',
    '<div data-component="Chart"></div><div data-component="Chart"></div><span data-widget="poll" class="poll"></span><div class="card card-grid">c</div>',
    '<div class="swagger-ui">api</div><p>GET /users/{id} then POST /users and DELETE /users/{id}</p><div class="param-field">p</div><a href="/spec/openapi.yaml">spec</a>',
    '<div class="http-method">GET</div><div class="http-method">PUT</div><p>GET /v1/items PUT /v1/items/{id}</p><div class="response-body">r</div><div class="request-body">q</div> bearer token, api_key',
    '<meta property="og:title" content=" Guide to it "><meta name="description" content="About"><meta name="generator" content="Docusaurus v2"><div id="__docusaurus"></div><div class="tabs">a</div>',
    '<span class="katex-error" title="ParseError: a">\\frac</span><span class="katex-error" title="ParseError: b">\\x</span><math>m</math><div class="mermaid">g</div>',
    '<div class="mdx-content"><img src="/img/a.png" alt="A"><img src="https://cdn.example.org/b.png"><img src="c.png"></div><img src="data:xyz">',
    '<a href="/files/guide.PDF">pdf</a><a href="/x.zip">zip</a><a href="https://help.example.org/a" rel="x">Help <b>desk</b></a><a href="https://support.example.net/q">S</a>',
    '<div class="graphiql">q</div><script>{"openapi": "3.0.1"}</script><form action="/s"><input></form><input type="range">',
    '<nav class="breadcrumb"><ol><li><a href="/">H</a></li><li><a href="/g">G</a></li></ol></nav><link rel="next" href="/n"><div class="language-switch">en</div>',
    '<div class="md-content">m</div><h2 id="a">Alpha</h2><h2>Beta</h2><h3>Gamma</h3><ol><li>1</li></ol><ul><li>2</li></ul><dl><dt>t</dt></dl>',
    '<section class="hero">big</section><div class="feature">f</div><a href="/hc/en">hc</a><div class="badge">new</div><span data-tooltip="t">?</span>',
    '<div class="rst-content" data-project="p">r</div><div class="callout danger">d</div><div class="notice success">s</div><div class="alert seealso">i</div><div class="note callout">n</div>',
    '<a href="/guide/intro">Intro</a><a href="/guide/setup/index.html">Setup</a><a href="#top">Top</a><a href="mailto:a@example.org">Mail</a><a href="/static/app.js">js</a><a href="/blog/x">blog</a>',
    "",
]


def pages_rich(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    chosen = F.element_at(F.array(*[F.lit(s) for s in SNIPPETS]), (F.col("page_id") % len(SNIPPETS) + 1).cast("int"))
    return pages.select("page_id", "url", F.replace("html", F.lit("</article>"), F.concat(chosen, F.lit("</article>"))).alias("html"))


PAGES_RICH = f"SELECT page_id, url, replace(html, '</article>', [{', '.join(quoted(s) for s in SNIPPETS)}][page_id % {len(SNIPPETS)} + 1] || '</article>') AS html FROM pages"


#: Markdown documents: front matter, a heading that repeats the title or not, prose, headings, a fence, links right and wrong.
MDX_SQL = """
SELECT concat('docs/', CAST(doc_id % 7 AS STRING), '/page-', CAST(doc_id AS STRING), CASE WHEN doc_id % 11 = 0 THEN '/index' ELSE '' END, '.mdx') AS path,
       concat('---\\ntitle: "Page ', CAST(doc_id AS STRING), '"\\nlang: ', lang, '\\n---\\n\\n',
              CASE WHEN doc_id % 3 = 0 THEN concat('# Page ', CAST(doc_id AS STRING), '\\n\\n') ELSE '' END,
              '## Setup\\n\\n', text, '\\n\\n## Usage & Notes\\n\\n## Setup\\n\\n',
              'See [next](/docs/', CAST((doc_id + 1) % 7 AS STRING), '/page-', CAST(doc_id + 1 AS STRING), ') and [setup](./page-', CAST(doc_id + 7 AS STRING), '#setup).\\n',
              'Also [gone](/docs/missing-', CAST(doc_id AS STRING), ') or <a href="../1/page-1#usage-notes">notes</a>, ![alt](/img/', CAST(doc_id % 5 AS STRING), '.png) and [out](https://example.org/x).\\n',
              '<Card title="Go" href="/docs/0/page-0/index">c</Card> <Button href="#setup">b</Button><br><hr>\\n\\n',
              '```', lang, '\\ncode [not](/a/link)\\n# not a heading\\n```\\n\\n> quoted\\n\\n<img src="/img/', CAST(doc_id % 3 AS STRING), '.svg">\\n[old](/old/a#x) [ext](/old-extra)\\n') AS content
FROM documents
"""


def mdx_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.read.parquet(f"{sf_dir}/documents.parquet").createOrReplaceTempView("quarrymill_documents")
    return spark.sql(MDX_SQL.replace("FROM documents", "FROM quarrymill_documents"))


# The text is read by DuckDB as it stands: there a backslash in a string is a backslash.
MDX_DOCS = MDX_SQL.replace("AS STRING", "AS VARCHAR").replace("'---\\n", "E'---\\n")
MDX_DOCS = __import__("re").sub(r"(?<!E)'((?:[^'])*\\n(?:[^'])*)'", r"E'\1'", MDX_DOCS)


def rows(spark: SparkSession, schema: str, values: list[tuple]) -> DataFrame:
    return spark.createDataFrame(values, schema)


def values_sql(columns: str, values: list[tuple]) -> str:
    """The rows as a SQL table expression."""
    one = lambda v: "NULL" if v is None else quoted(v) if isinstance(v, str) else str(v)
    body = ", ".join("(" + ", ".join(one(v) for v in r) + ")" for r in values)
    return f"SELECT * FROM (VALUES {body}) AS t({columns})"


def dealt(spark: SparkSession, sf_dir: str, schema: str, values: list[tuple], shifted: tuple[str, ...] = ()) -> DataFrame:
    """A row for each document: documents are taken in blocks of as many as there are ``values``, and each takes one of these. ``~`` in a text is the
    block's number, which also moves the ``shifted`` columns, so every block holds all the cases once, under names of its own."""
    n = len(values)
    block, at = F.expr(f"doc_id div {n}"), (F.col("doc_id") % n + 1).cast("int")
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id"), []
    for i, (name, kind) in enumerate(c.split() for c in schema.split(", ")):
        one = F.element_at(F.array(*[F.lit(v[i]).cast(kind) for v in values]), at)
        one = F.replace(one, F.lit("~"), block.cast("string")) if kind == "string" else one + block * SHIFT if name in shifted else one
        out.append(one.alias(name))
    return docs.select(*out)


#: How far a block's ids lie from the next one's.
SHIFT = 1000


def dealt_sql(schema: str, values: list[tuple], shifted: tuple[str, ...] = ()) -> str:
    """The same rows in SQL."""
    n, out = len(values), []
    for i, (name, kind) in enumerate(c.split() for c in schema.split(", ")):
        one = f"[{', '.join('NULL' if v[i] is None else quoted(v[i]) if isinstance(v[i], str) else str(v[i]) for v in values)}][doc_id % {n} + 1]"
        one = f"replace({one}, '~', CAST(doc_id // {n} AS VARCHAR))" if kind == "string" else f"CAST({one} AS BIGINT)" + (f" + doc_id // {n} * {SHIFT}" if name in shifted else "")
        out.append(f"{one} AS {name}")
    return f"SELECT {', '.join(out)} FROM documents"


#: node, parent, place among siblings, key that holds it, name, page.
NAV = [
    (1, None, 0, "root", None, None), (2, 1, 0, "tabs", "Guides ~", None), (3, 2, 0, "groups", "Getting Started ~", None), (4, 3, 0, "pages", None, "start/intro-~"),
    (5, 3, 1, "pages", None, "start/install-~"), (6, 3, 2, "pages", "Advanced Use ~", None), (7, 6, 0, "pages", None, "start/advanced-use-~"), (8, 6, 1, "pages", None, "start/tuning-~"),
    (9, 2, 1, "groups", "Reference ~", None), (10, 9, 0, "pages", None, "api/overview-~"), (11, 9, 1, "pages", "Models ~", None), (12, 11, 0, "pages", None, "api/models-~"),
    (13, 11, 1, "pages", None, "api/fields-~"), (14, 1, 1, "anchors", "Community ~", None), (15, 14, 0, "pages", None, "community-~"), (16, 1, 2, "languages", "fr", None),
    (17, 16, 0, "pages", None, "fr/intro-~"), (18, 1, 3, "dropdowns", "More", None), (19, 18, 0, "pages", "Deep ~", None), (20, 19, 0, "pages", "Deeper ~", None), (21, 20, 0, "pages", None, "deep/deeper-~"),
    (22, 1, 4, "menu", "Menu", None), (23, 22, 0, "items", None, "menu/item-~"),
]
#: Ids that differ from block to block.
NAV_IDS = ("node_id", "parent_id")
NAV_SCHEMA = "node_id long, parent_id long, ord long, kind string, name string, page string"
REDIRECTS = [(1, "/old/a", "/new/a"), (2, "/new/a", "/final/a"), (3, "/old", "/archive"), (4, "/docs/1/page-1", "/docs/one")]
REDIRECT_COLUMNS, REDIRECT_SCHEMA = "ord, source, destination", "ord long, source string, destination string"
RENDERED = [
    (0, "/a~", 0, "Set up", "set-up"), (0, "/a~", 1, "Usage", "usage"), (0, "/a~", 2, "Set up", "set-up-2"), (0, "/a~", 3, "Install the command line tool", "install"),
    (0, "/b~", 0, "set up", "x1"), (0, "/b~", 1, "Set Up", "x2"), (0, "/b~", 2, "Install command tool quickly", "x3"), (0, "/b~", 3, "Usage notes", "x4"),
]
RENDERED_SCHEMA = "pair long, page string, pos long, text string, id string"
