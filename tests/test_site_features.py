"""Families, descriptions, table functions, files at paths, edits, carried values, nested documents, samples and orders, against plain versions."""

import collections
import json
import random
from pathlib import Path
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from quarrymill.functions import text, urls
from quarrymill.operators import edits, fill, nested, rewrite, samples, search, specs, table_functions, tree_rows
from quarrymill.operators.html_tree import parse
from quarrymill.sources import doctree, sinks

# --- component families


def shape(node):
    runs = []
    for s in (shape(c) for c in node.children if not isinstance(c, str)):
        if not runs or runs[-1] != s:
            runs.append(s)
    return (node.tag, tuple(sorted(set(node.classes()))), tuple(runs))


def families_by_hand(html):
    """(members, selector) of each family, by recursion over the tree; members as places in document order."""
    root = parse(html)
    nodes = list(root.walk())
    own = lambda n: [n.tag, *(f".{c}" for c in set(n.classes())), *(f"{n.tag}.{c}" for c in set(n.classes()))]
    def above(n):
        p = n.parent
        return [f"{a} > {c}" for a in ([f"#{p.attrs['id']}"] if p.attrs.get("id") else []) + own(p) for c in own(n)] if p.tag else []

    found = collections.defaultdict(list)
    for k, n in enumerate(nodes):
        alike = [c for c in n.parent.children if not isinstance(c, str) and shape(c) == shape(n)]
        if n.parent.tag and len(alike) >= 2 and (n.classes() or list(n.walk())):
            found[shape(n)].append(k)
    out = []
    for members in found.values():
        for names in (own, above):
            fits = [s for s in {s for k in members for s in names(nodes[k])} if [k for k, n in enumerate(nodes) if s in names(n)] == members]
            if fits:
                break
        out.append((len(members), min(fits, key=lambda s: (len(s), s)) if fits else None))
    return sorted(out, key=str)


def random_html(seed):
    r = random.Random(seed)

    def made(depth):
        tag, classes = r.choice(["div", "section", "ul", "span"]), r.sample(["card", "row", "x", "y"], r.randrange(3))
        inner = "".join(made(depth - 1) for _ in range(r.randrange(4))) if depth else "t"
        own = f' id="i{r.randrange(3)}"' if r.random() < 0.2 else ""
        return f'<{tag}{own}{f" class={chr(34)}{chr(32).join(classes)}{chr(34)}" if classes else ""}>{inner}</{tag}>' * r.choice([1, 1, 2, 3])

    return "<body>" + "".join(made(4) for _ in range(3)) + "</body>"


def test_families_equal_a_recursive_version(spark):
    pages = [random_html(s) for s in range(25)] + ["", None, "<ul><li><a>1</a></li><li><a>2</a></li></ul><ol><li><a>3</a></li><li><b>4</b></li></ol>", "<p>a<p>b", "<div " * 3]
    df = spark.createDataFrame([(i, h, 7) for i, h in enumerate(pages)], "page_id long, html string, size int")
    got = collections.defaultdict(list)
    rows = tree_rows.families(tree_rows.elements(df)).collect()
    for r in rows:
        got[r["page_id"]].append((r["members"], r["selector"]))
    for i, h in enumerate(pages):
        assert sorted(got[i], key=str) == families_by_hand(h or ""), h
    spread = collections.Counter(r["family"] for r in rows)
    assert all(r["pages"] == spread[r["family"]] for r in rows) and any(n > 1 for n in spread.values())


def test_runs_of_equal_children_count_once(spark):
    card = lambda n: '<div class="card"><h3>t</h3>' + "<p>x</p>" * n + "</div>"
    df = spark.createDataFrame([(1, f'<main>{card(1)}{card(4)}<div class="other"><p>z</p></div></main>')], "page_id long, html string")
    assert [(r["tag"], r["members"], r["selector"]) for r in tree_rows.families(tree_rows.elements(df)).collect()] == [("div", 2, ".card")]


# --- descriptions


def test_descriptions_in_odd_forms(spark):
    blocks = [
        '{"openapi": "3.1.0", "paths": {"/a": {"get": 0, "put": 0.0, "post": "", "patch": [], "delete": -0, "head": "x", "options": {}}}}', '{"paths": {"/a": {"get": {}}}}', '{"openapi": 3.0, "paths": "none"}', '{"swagger": "2.0", "paths": {}}',
        "{broken", "{}", "openapi: 3\n  /x:\n", '{"openapi": null, "swagger": "2.0"}', '{"openapi": "3", "paths": {"/a": [1], "/b": 5, "/c": null, "/d": {"get": {"deep": {"x": [1, {"y": null}]}}}}}',
    ]
    df = spark.createDataFrame(list(enumerate(blocks)), "page_id long, text string").withColumn("ord", F.lit(0).cast("long"))
    got = {r["page_id"]: tuple(r)[2:] for r in specs.measured(df).collect()}
    assert got == {
        0: ("openapi", "3.1.0", 3, True, None), 1: (None, None, 1, True, None), 2: ("openapi", "3", 0, True, None), 3: ("swagger", "2.0", 0, True, None), 4: (None, None, None, False, "not a description"),
        5: (None, None, 0, True, None), 6: ("openapi", "3", 1, True, None), 7: ("swagger", "2.0", 0, True, None), 8: ("openapi", "3", 1, True, None),
    }
    each = specs.endpoints(df).collect()
    assert collections.Counter(r["page_id"] for r in each) == {i: v[2] for i, v in got.items() if v[2] and i != 6}
    page = spark.createDataFrame([(1, "u", None), (2, "v", "<pre></pre>")], "page_id long, url string, html string")
    assert specs.measured(specs.blocks(page)).count() == 0 and specs.shown(page).count() == 0


# --- table functions


def test_table_functions_equal_the_operator(spark):
    r = random.Random(5)
    docs = [(i, " ".join(r.choice(["the", "thing", "it's", "a\nb", "X"]) for _ in range(r.randrange(40))), r.choice(["en", "de"]), "s") for i in range(200)] + [(900, None, "en", "s"), (901, "", None, None)]
    made = search.index(spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")).cache()
    table_functions.register(spark, made)
    for query, limit, threshold in (("the thing", 20, 0.0), ("it's", 7, 0.6), ("THE", 3, 0.0), ("absent", 5, 0.0), ("thing", 100, 0.0)):
        want = [tuple(x) for x in search.search(made, query, limit, threshold).orderBy("rank").collect()]
        got = [tuple(x) for x in spark.sql(table_functions.search_sql(query, limit, threshold)).orderBy("rank").collect()]
        assert [g[:5] for g in got] == [w[:5] for w in want], query
    assert spark.sql("SELECT * FROM get_doc('/docs/7')").collect()[0]["doc_id"] == 7 and spark.sql("SELECT * FROM get_doc('nothing')").count() == 0
    assert {x["language"] for x in spark.sql("SELECT * FROM list_docs(NULL)").collect()} == {"en", "de", None}


def test_table_functions_refuse_bad_calls(spark):
    table_functions.register(spark, search.index(spark.createDataFrame([(1, "a", "en", "s")], "doc_id long, text string, lang string, source string")))
    for call, why in (("best_docs(TABLE(quarrymill_docs), ' ', 5)", "Query cannot be empty"), ("best_docs(TABLE(SELECT 1 AS part), 'x', 5)", "lacks content"), ("best_docs('x', 'x', 5)", "is a table")):
        with pytest.raises(Exception, match=why):
            spark.sql(f"SELECT * FROM {call}").collect()


# --- files at paths


def tree(root):
    return {str(p.relative_to(root)): p.read_bytes() for p in Path(root).rglob("*") if p.is_file()}


def test_files_are_written_and_read_at_their_paths(spark, tmp_path):
    files = [("a/b.mdx", b"1"), ("a_b.mdx", b"2"), ("a/ü/c d.md", "é".encode()), ("e.png", bytes(range(256))), ("n.txt", None), ("deep/" * 20 + "x", b"")]
    doctree.write(spark.createDataFrame(files, "path string, content binary").repartition(3), f"file://{tmp_path}/out")
    assert tree(tmp_path / "out") == {p: c or b"" for p, c in files}
    assert {r["path"]: bytes(r["content"]) for r in doctree.read(spark, f"file://{tmp_path}/out").collect()} == tree(tmp_path / "out")
    doctree.write(spark.createDataFrame([("a/b.mdx", "new")], "path string, content string"), f"file://{tmp_path}/out")
    assert (tmp_path / "out/a/b.mdx").read_text() == "new" and len(tree(tmp_path / "out")) == len(files)
    doctree.write(spark.createDataFrame([], "path string, content string"), f"file://{tmp_path}/empty")
    assert tree(tmp_path / "empty") == {} and doctree.read(spark, f"file://{tmp_path}/empty").count() == 0


@pytest.mark.parametrize("paths", [["a", "a"], ["a", "a/b"], ["a/b", "a/b/c/d"], [None], [""], ["/a"], ["a/"], ["a//b"], ["../a"], ["a/./b"], ["_staging/x"], ["a\0b"]])
def test_clashing_and_unsafe_paths_are_refused(spark, tmp_path, paths):
    with pytest.raises(ValueError, match="refused"):
        doctree.write(spark.createDataFrame([*((p, "x") for p in paths), ("ok", "y")], "path string, content string"), f"file://{tmp_path}/out")
    assert not (tmp_path / "out").exists()


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    df = spark.range(40).repartition(4).select(F.concat(F.lit("d/"), F.col("id").cast("string")).alias("path"), F.when(F.col("id") == 17, F.raise_error(F.lit("lost"))).otherwise(F.lit("x")).alias("content"))
    spark.dataSource.register(doctree.TreeSource)
    with pytest.raises(Exception, match="lost"):
        df.select("path", F.col("content").cast("binary").alias("content")).write.format("doctree").mode("append").save(f"file://{tmp_path}/out")
    assert tree(tmp_path / "out") == {}


def test_attempts_that_do_not_count_are_dropped(tmp_path):
    """A task that ran twice: only the attempt whose message the driver got is moved."""
    import pyarrow as pa

    writer = doctree.TreeWriter(f"file://{tmp_path}/out")
    batch = lambda c: pa.RecordBatch.from_pylist([{"path": "a/x", "content": c}], doctree.SCHEMA)
    writer.write(iter([batch(b"lost"), batch(b"half")]))
    writer.commit([writer.write(iter([batch(b"kept")])), None])
    assert tree(tmp_path / "out") == {"a/x": b"kept"} and not (tmp_path / "out/_staging").exists()


def test_documents_with_alike_paths_stay_apart(spark, tmp_path):
    sinks.write_documents(spark.createDataFrame([("a/b.mdx", "1"), ("a_b.mdx", "2")], "path string, content string"), str(tmp_path / "out"))
    assert tree(tmp_path / "out") == {"a/b.mdx": b"1", "a_b.mdx": b"2"}


def test_other_files_are_copied_through(spark, tmp_path):
    (tmp_path / "in/img").mkdir(parents=True)
    (tmp_path / "in/node_modules").mkdir()
    for name, data in (("a.md", b"# old"), ("img/x.png", b"\x89\x00\xff"), ("node_modules/y.js", b"no"), ("b.yml", b"k: 1")):
        (tmp_path / "in" / name).write_bytes(data)
    doctree.copied(spark, f"file://{tmp_path}/in", spark.createDataFrame([("a.mdx", "# new")], "path string, content string"), f"file://{tmp_path}/out")
    assert tree(tmp_path / "out") == {"a.mdx": b"# new", "img/x.png": b"\x89\x00\xff", "b.yml": b"k: 1"}


# --- edits


def test_edits_in_one_pass_equal_edits_from_the_end(spark):
    r = random.Random(3)
    docs, rows, want = [], [], {}
    for d in range(40):
        t = "".join(r.choice("aé😀\n ") for _ in range(r.randrange(60)))
        own = {(s := r.randrange(-2, 62), s + r.randrange(-1, 9), r.choice(["", "X", "longer"])) for _ in range(r.randrange(30))}
        held, last = [], 0
        for s, e, p in sorted(own, key=lambda x: (x[0], -x[1], x[2])):
            if last <= s <= e <= len(t):
                held, last = [*held, (s, e, p)], e
        done = t
        for s, e, p in reversed(held):
            done = done[:s] + p + done[e:]
        docs.append((f"p{d}", t))
        rows += [(f"p{d}", *x) for x in own] * 2
        want[f"p{d}"] = (done, len(held))
    docs += [("none", None), ("plain", "as it is")]
    rows += [("none", 0, 0, "x"), ("plain", None, 3, "y"), ("unknown", 0, 0, "z"), ("p0", 0, None, "w")]
    got = edits.apply(spark.createDataFrame(docs, "path string, content string"), spark.createDataFrame(rows, "path string, start long, end long, put string")).collect()
    assert {x["path"]: (x["content"], x["applied"]) for x in got} == want | {"none": (None, 0), "plain": ("as it is", 0)}


def test_ranges_find_their_places(spark):
    t = "12 345\n😀6789 0 1000"
    df = spark.createDataFrame([("a", t), ("b", None), ("c", ""), ("d", "777")], "path string, content string")
    got = sorted((x["path"], x["start"], x["end"]) for x in edits.ranges(df, "[0-9]{3,}", "n").collect())
    assert got == [("a", 3, 6), ("a", 8, 12), ("a", 15, 19), ("d", 0, 3)]


def test_anchor_fixes_give_the_content(spark):
    doc = "[a](#x) [b](#x) (#x)\n<a href='p#q'> [c](p#q)\nlast [d](#x)"
    failures = [(1, "markdown", "#x", "one"), (1, "markdown", "#x", "two"), (2, "html", "p#q", "new"), (9, "markdown", "#x", "far"), (3, "jsx", "#x", "no"), (2, "markdown", "p#q", "q")]
    df = spark.createDataFrame([("f", *x) for x in failures], "path string, line long, kind string, href string, new_anchor string")
    r = rewrite.anchors(spark.createDataFrame([("f", doc), ("g", "[a](#x)")], "path string, content string"), df).collect()
    assert [tuple(x) for x in r] == [("f", 3, "1:#one 1:#two 2:p#new", "[a](#one) [b](#two) (#x)\n<a href='p#new'> [c](p#q)\nlast [d](#x)")]


# --- values carried forward


def test_values_are_carried_through_a_hot_page(spark):
    r = random.Random(8)
    rows = [(0, i, f"h{i}" if r.random() < 0.002 else None) for i in range(5000)] + [(p, i, f"{p}-{i}" if r.random() < 0.3 else None) for p in [*range(1, 40), None] for i in range(r.randrange(8))]
    want, last = {}, {}
    for p, i, h in sorted(rows, key=lambda x: (str(x[0]), x[1])):
        last[p] = h if h is not None else last.get(p)
        want[p, i] = last[p]
    r.shuffle(rows)
    got = fill.carried(spark.createDataFrame(rows, "page long, pos long, header string"), ["page"], ["pos"], "header", "found")
    assert {(x["page"], x["pos"]): x["found"] for x in got.collect()} == want
    placed = spark.createDataFrame(rows, "page long, pos long, header string").repartitionByRange(4, "page", "pos").withColumn("p", F.spark_partition_id()).groupBy("p").count().collect()
    assert max(x["count"] for x in placed) < 2500  # the hot page is dealt over all tasks


# --- nested documents


def random_json(r, depth):
    kind = r.randrange(7) if depth else r.randrange(5)
    if kind == 5:
        return [random_json(r, depth - 1) for _ in range(r.randrange(4))]
    if kind == 6:
        return {r.choice(["a", "b", 'q"\\', "é\n", ""]): random_json(r, depth - 1) for _ in range(r.randrange(4))}
    return [None, True, r.choice([1.5, 10**20, -3]), r.choice(["/old", "x/old", 'esc"\\\n\té😀\u2028', ""]), r.choice([0, False])][kind]


def test_documents_are_rebuilt_as_they_were(spark):
    r = random.Random(4)
    docs = [(f"d{i}", json.dumps(random_json(r, 6), ensure_ascii=False, separators=(",", ":"))) for i in range(60)] + [("deep", "[" * 30 + "]" * 30), ("twice", '{"a":1,"a":2}'), ("number", "1.500"), ("big", "[1e400,0.10]")]
    df = spark.createDataFrame([*docs, ("bad", "{"), ("null", None)], "doc string, json string")
    got = {x["doc"]: x["json"] for x in nested.rebuilt(nested.flattened(df)).collect()}
    assert {d: t for d, t in got.items() if d in ("deep", "twice", "number", "big")} == dict(docs[60:]) and set(got) == {d for d, _ in docs}
    assert {d: json.loads(got[d]) for d, _ in docs[:60]} == {d: json.loads(t) for d, t in docs[:60]}
    assert nested.rebuilt(nested.flattened(df.limit(0))).count() == 0


def test_moved_paths_are_replaced_wherever_they_stand(spark):
    df = spark.createDataFrame([("n", '{"/old":["/old",{"p":"/old","q":"x/old"},1]}')], "doc string, json string")
    moves = spark.createDataFrame([("/old", 'new "path"'), ("1", "2")], "source string, destination string")
    assert nested.rebuilt(nested.replaced(nested.flattened(df), moves)).first()["json"] == '{"/old":["new \\"path\\"",{"p":"new \\"path\\"","q":"x/old"},1]}'


# --- samples


def test_samples_keep_the_smallest_urls(spark):
    r = random.Random(6)
    rows = [(f"u{r.randrange(40):02}", r.choice("abc"), r.choice(["#i", ".c", "tag", None]), r.random() < 0.5, i, 0) for i in range(400)]
    df = spark.createDataFrame(rows, "url string, type string, hint string, high boolean, page_id long, pos int")
    pages = {(x["type"], x["url"]): x["hint"] for x in samples.by_page(df).collect()}
    for (kind, url), hint in pages.items():
        own = [h for u, t, h, _, _, _ in rows if (t, u) == (kind, url)]
        assert hint == next((h for h in own if h and h[0] in ".#"), next((h for h in own if h), None))
    for x in samples.by_type(samples.by_page(df)).collect():
        own = [s for s in rows if s[1] == x["type"]]
        assert (x["total"], x["high"], x["low"]) == (len(own), sum(s[3] for s in own), sum(not s[3] for s in own)) and x["page_urls"] == sorted({s[0] for s in own})[:10]


def test_the_smallest_urls_are_ranked_before_they_are_shuffled(spark):
    df = spark.createDataFrame([("u", "t", "#i", True, 1, 0)], "url string, type string, hint string, high boolean, page_id long, pos int")
    plan = samples.by_type(samples.by_page(df))._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


# --- orders and addresses


def test_orders_by_units_and_by_locale(spark):
    names = ["z", "é", "e", "É", "E", "f", "\ufb01", "😀", "\uffff", "Z", ""]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r["n"] for r in df.orderBy(text.utf16_key(F.col("n"))).collect()] == sorted(names, key=lambda n: n.encode("utf-16-be"))
    letters = [r["n"] for r in df.filter("n rlike '^[a-zA-ZéÉ]$'").orderBy(text.by_locale(F.col("n"))).collect()]
    assert letters == ["e", "E", "é", "É", "f", "z", "Z"]


def test_targets_equal_the_standard_resolution(spark):
    pages = ["http://a/b/c/d;p?q", "https://example.org", "https://example.org/x/", "http://h.org/a%20b/c.html#f"]
    hrefs = "g:h g ./g g/ /g //g/x ?y g?y #s g#s g?y#s ;x g;x g;x?y#s . ./ .. ../ ../g ../.. ../../ ../../g ../../../g ../../../../g /./g /../g g. .g g.. ..g ./../g ./g/. g/./h g/../h g;x=1/./y g;x=1/../y g?y/./x g?y/../x g#s/./x g#s/../x http://x/y/../z".split()
    df = spark.createDataFrame([(h, p) for h in hrefs for p in pages], "href string, url string")
    got = {(r["href"], r["url"]): r["t"] for r in df.withColumn("t", urls.resolved("href", "url").column).collect()}
    for (h, p), t in got.items():
        base = p if "/" in p.split("://")[1].split("?")[0] else p + "/"
        want = urljoin(base, h)
        want = "http://x/z" if h == "http://x/y/../z" else f"{p.split(':')[0]}:{h}" if h.startswith("//") else want
        assert t == want, (h, p)
    empty = spark.createDataFrame([("a//b", pages[0])], "href string, url string")
    assert empty.select(urls.resolved("href", "url").column).first()[0] == "http://a/b/c/a//b"  # empty parts stay, as RFC 3986 has it
