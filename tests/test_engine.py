"""Options, sources, sinks, navigation documents, streams."""

import json

import pytest
from pyspark.sql import functions as F

from quarrymill import config
from quarrymill.operators import features, frontier, nav, resume
from quarrymill.plans import views
from quarrymill.sources import files, sinks
from quarrymill.streaming import incremental


def test_options():
    assert config.merged("pages", {"concurrency": "7"}, {"concurrency": 3, "batch": 50}) == {"base_url": None, "docs": "docs.json", "concurrency": 7, "batch": 50, "output": "pages_report.json"}
    assert config.merged("nav", {"base": False}, {"base": "docs"})["base"] is False
    with pytest.raises(ValueError):
        config.required(config.merged("links"), "base_url")


def test_files(spark, tmp_path):
    for name, text in {"a.mdx": "A\nB", "sub/b.mdx": "C", "node_modules/c.mdx": "D", "d.md": "E"}.items():
        (tmp_path / "site" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "site" / name).write_text(text)
    got = {(r["path"], r["content"]) for r in files.markdown(spark, str(tmp_path / "site")).collect()}
    assert got == {("a.mdx", "A\nB"), ("sub/b.mdx", "C")}
    (tmp_path / "urls.json").write_text('["u1", "u2", "u1"]')
    assert {r["url"] for r in files.url_list(spark, str(tmp_path / "urls.json"), ("u3", "u2")).collect()} == {"u1", "u2", "u3"}
    report = {"results_by_file": {"a.mdx": [{"source": {"filePath": "a.mdx", "lineNumber": 2, "rawHref": "/x#y", "linkType": "markdown"}, "anchor": "y", "actualHeadingAnchor": "z", "status": "failure"}, {"source": {}, "anchor": None, "actualHeadingAnchor": None, "status": "success"}]}}
    (tmp_path / "r.json").write_text(json.dumps(report))
    assert [tuple(r) for r in files.fixable(files.link_report(spark, str(tmp_path / "r.json"))).collect()] == [("a.mdx", 2, "markdown", "/x#y", "y", "z", "failure")]


def test_sinks(spark, tmp_path):
    before = spark.createDataFrame([("a", "1"), ("b", "2")], "path string, content string")
    after = spark.createDataFrame([("a", "1"), ("b", "3")], "path string, content string")
    sinks.write_changed(before, after, str(tmp_path / "out"))
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [("b", "3")]
    assert json.loads(sinks.fallback_markdown(before.limit(1)).first()["report"].split("\n")[1]) == {"path": "a", "content": "1"}
    none = spark.createDataFrame([], "path string, line long, href string, status string")
    assert "All links are valid." in sinks.link_markdown(none).first()["section"]


def test_navigation(spark):
    doc = json.dumps({"navigation": {"tabs": [{"tab": "T", "groups": [{"group": "My Group", "pages": ["x/a", {"group": "In", "pages": ["x/in", "x/b"]}, {"source": "s", "directory": "d"}]}]}], "languages": [{"language": "fr", "pages": ["fr/a"]}]}})
    tree = nav.flatten(spark, doc)
    assert {r["page"] for r in nav.leaves(tree).collect()} == {"x/a", "x/in", "x/b"}
    assert {r["page"] for r in nav.walk(tree).filter("page is not null").collect()} == {"x/a", "x/in", "x/b", "fr/a"}
    paths = {r["page"]: r["new_path"] for r in nav.new_paths(nav.walk(tree)).collect()}
    assert paths["x/in"] == "x/t/my-group/in/index" and paths["x/a"] == "x/t/my-group/a"
    assert {r["page"]: r["new_path"] for r in nav.new_paths(nav.walk(tree), base=False, skip=(1,)).collect()}["x/a"] == "my-group/a"
    order = nav.directory_order(spark.createDataFrame([("d", "b", "2"), ("d", "a", None), ("d", "c", "1.5"), ("d", "z", "x")], "folder string, name string, position string"))
    assert [r["name"] for r in order.orderBy("rank").collect()] == ["c", "b", "a", "z"]


def test_frontier_and_resume(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "y")], "source string, target string")
    got = {r["url"]: r["depth"] for r in frontier.reachable(spark.createDataFrame([("a",)], "url string"), edges).collect()}
    assert got == {"a": 0, "b": 1, "c": 2}
    old = spark.createDataFrame([("a", 500), ("b", 404)], "url string, status int")
    new = spark.createDataFrame([("a", 200), ("c", None), ("b", 500)], "url string, status int")
    assert {(r["url"], r["status"]) for r in resume.merge_failures(old, new).collect()} == {("b", 500), ("c", None)}


def test_features_of_nothing(spark):
    made = features.analyze(spark.createDataFrame([(1, None, None), (2, "x", "")], "page_id long, url string, html string")).select("page_id", "word_count", "title", "platform", "is_doc", "path").collect()
    assert [(r["word_count"], r["title"], r["platform"], r["is_doc"]) for r in made] == [(0, "", None, False)] * 2
    chosen = features.analyze(spark.createDataFrame([(1, "https://e.org/", '<div class="content">x</div>'), (2, "https://e.org/", "<p>")], "page_id long, url string, html string"), ".content").select("page_id", "is_doc").collect()
    assert {r["page_id"]: r["is_doc"] for r in chosen} == {1: True, 2: False}


def test_partitioning_changes_nothing(spark):
    docs = spark.createDataFrame([(i, f"https://e.org/{i}.html", views.SNIPPETS[i % len(views.SNIPPETS)]) for i in range(40)], "page_id long, url string, html string")
    totals = [features.analyze(docs.repartition(n)).agg(F.sum("word_count"), F.sum("callout_total"), F.sum("api_confidence")).first() for n in (1, 16)]
    assert totals[0] == totals[1]


def test_streams(spark, tmp_path):
    source = tmp_path / "in"
    pages = spark.createDataFrame([(i, f"https://e.org/{i}", f"<h1>T{i}</h1>" + "<p>word</p>" * i) for i in range(30)], "page_id long, url string, html string")
    pages.repartition(3).write.parquet(str(source))
    stream = spark.readStream.schema(pages.schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    q = incremental.analyzed_stream(stream, ["page_id", "word_count"]).writeStream.format("memory").queryName("analyzed").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {tuple(r) for r in spark.table("analyzed").collect()} == {tuple(r) for r in features.analyze(pages).select("page_id", "word_count").collect()}
    results = tmp_path / "results"
    for k, rows in enumerate([[("a", 500), ("b", 404)], [("a", 200), ("c", 503)]]):
        spark.createDataFrame(rows, "url string, status long").coalesce(1).write.parquet(str(results / f"r{k}"))
        live = spark.readStream.schema("url string, status long").option("recursiveFileLookup", True).parquet(str(results))
        incremental.follow_checks(live, str(tmp_path / "state"), str(tmp_path / "ck")).awaitTermination(120)
    assert {(r["url"], r["status"]) for r in incremental.failures(spark, str(tmp_path / "state")).collect()} == {("b", 404), ("c", 503)}
