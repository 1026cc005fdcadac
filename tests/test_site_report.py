"""Site reports and lookups on rows that are awkward: nulls, none at all, repeated, many matches on one page."""

from quarrymill.operators import features, lookups, report, site_report

PAGES = "page_id long, url string, html string"


def got(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_ties_go_to_what_was_seen_first(spark):
    pages = spark.createDataFrame([(1, ["z"] + ["y"] * 100_001), (2, ["a", "z"]), (3, ["a"])], "page_id long, found array<string>")
    ranks = {r["v"]: (r["pages"], r["rank"]) for r in report.value_counts(pages, "found", "v").collect()}
    assert ranks == {"y": (100_001, 1), "z": (2, 2), "a": (2, 3)}


def test_imports(spark):
    files = spark.createDataFrame([("docs/b.tsx",), ("docs/b.jsx",), ("docs/b.jsx",), ("c.ts",), (None,)], "path string")
    asked = spark.createDataFrame([("docs/a.mdx", "./b"), ("docs/a.mdx", "./b"), ("docs/x/a.mdx", "../../c.ts"), ("a.mdx", "./docs/b.tsx"), ("docs/a.mdx", "/c"), ("a.mdx", "react"), ("a.mdx", "./gone"), ("a.mdx", None)], "path string, spec string")
    found = got(lookups.imports(asked, files).select("spec", "target", "kind"))
    assert found.count(("./b", "docs/b.jsx", "file")) == 2 and len(found) == 8
    assert {("../../c.ts", "c.ts", "file"), ("./docs/b.tsx", "docs/b.tsx", "file"), ("/c", "c.ts", "file"), ("react", None, "package"), ("./gone", None, "missing"), (None, None, "missing")} <= set(found)


def test_images(spark):
    files = spark.createDataFrame([("docs/i/a.png",), ("static/b.svg",)], "path string")
    srcs = ["./i/a.png#x", "../b.svg#y", "../../c.gif", "/d.png", "/static/e.png", "data:z", "./page.mdx", "#top"]
    asked = spark.createDataFrame([("docs/a.mdx", s) for s in srcs], "path string, src string")
    assert {r["src"]: (r["put"], r["kind"]) for r in lookups.images(asked, files).collect()} == {
        "./i/a.png#x": ("./i/a.png#x", "document"), "../b.svg#y": ("/static/b.svg#y", "static"), "../../c.gif": ("/static/c.gif", "assumed"), "/d.png": ("/static/d.png", "root"),
        "/static/e.png": ("/static/e.png", "other"), "data:z": ("data:z", "other"), "./page.mdx": ("./page.mdx", "other"), "#top": ("#top", "other"),
    }


def test_meta_in_any_order(spark):
    html = "<meta content=\"A\" property='og:title'><meta name=n content='  '><meta itemprop=\"i\" content=' v ' /><meta property=\"og:title\" content=\"B's\">"
    pages = spark.createDataFrame([(1, "u", html), (2, "u", None), (3, "u", "")], PAGES)
    assert got(lookups.meta_values(pages)) == [(1, "i", "v"), (1, "og:title", "B's")]
    assert got(lookups.meta_values(pages, ["i"])) == [(1, "i", "v")]


def test_categories_and_texts(spark):
    pages = spark.createDataFrame([(1, "https://a.b/x/", '<a href="https://c.d/"> <b>T</b>ext </a><a href="https://a.b/y">own</a>'), (2, None, None)], PAGES)
    listed = spark.createDataFrame([(2, "Second", "https://a.b/x"), (1, "First", "https://a.b/x/"), (3, "None", None)], "ord long, name string, url string")
    assert got(lookups.categories(pages, listed)) == [(1, "First"), (2, "Uncategorized")]
    assert got(lookups.link_texts(pages, features.LINK)) == [(1, 0, "https://c.d/", "Text")]


def test_facts_of_pages_without_anything(spark):
    for rows in ([], [(1, None, None), (1, "https://a.b/x", "")]):
        html = spark.createDataFrame(rows, PAGES)
        pages = site_report.narrowed(features.analyze(html, "article"))
        semantic, tags = report.top_matches(html, "(nothing)", "kind", 15), report.top_matches(html, "(nothing)", "tag", 20)
        found, custom = site_report.content(semantic, site_report.data_components(html)), report.custom_components(tags, semantic)
        facts = site_report.facts(pages, custom, found, site_report.components(pages, tags, found))
        assert facts.count() == 1 and site_report.told(facts, site_report.ATTENTION).count() == 0 and site_report.factors(facts).count() == 0
        none = custom.select("name", "total").limit(0)
        judged = site_report.judged(facts, site_report.compatibility(facts, none, none)).first()
        assert judged["compatibility"] == "All supported" and judged["supported_share"] == 100 and judged["custom_builds"] == 0


def test_compatibility_takes_a_known_name_once(spark):
    row = spark.createDataFrame([(0,)], "math long")
    columns = {c: 0 for _, _, x in site_report.SUPPORTED for c in __import__("re").findall(r"\b[a-z]+(?:_[a-z]+)*\b", x) if c not in ("math",)}
    from pyspark.sql import functions as F

    row = row.select("math", *[F.lit(n).cast("long").alias(c) for c, n in (columns | {"cards": 2, "steps": 1}).items()])
    custom = spark.createDataFrame([("c-ard", 3), ("Card", 5), ("st-eps", 9), ("my-box", 4)], "name string, total long")
    embeds = spark.createDataFrame([("CodePen", 7)], "name string, total long")
    assert set(got(site_report.compatibility(row, custom, embeds))) == {(True, "Card / CardGroup", "Card groups", 2), (True, "Steps", "Step sequences", 1), (True, "Card", "<Card>", 5), (False, "my-box", None, 4), (False, "embed:CodePen", None, 7)}


def test_crawl_counts(spark):
    from pyspark.sql import functions as F

    pages = spark.createDataFrame([("a", "1", True), ("a", "x.pdf", True), ("a", "3", False), ("b", "4", True)], "site string, url string, is_doc boolean")
    found = spark.createDataFrame([("a", "1"), ("a", "1"), ("a", "9")], "site string, url string")
    assert got(site_report.crawl_totals(pages, found, F.col("site"), F.col("url").endswith(".pdf"))) == [("a", 2, 1, 1, 1), ("b", 0, 1, 0, 0)]
