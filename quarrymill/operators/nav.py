"""Navigation trees as edge lists (node, parent, place, key, name, page): leaves, paths, moves, promotions.

A tree is as deep as its authors nest it, so a walk is one join per level, checkpointed.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.dual import named
from ..functions.text import slug_nav
from ..sources.shared import cut

#: Keys that name a node, and keys that hold its children; checks follow fewer keys than moves do.
NAME_KEYS = ["group", "tab", "anchor", "dropdown", "version", "language", "product", "item"]
COLLECTION_KEYS = ["pages", "tabs", "groups", "anchors", "dropdowns", "versions", "menu", "items", "languages", "products"]
CHECK_KEYS = ["pages", "tabs", "groups", "anchors", "dropdowns", "versions"]
NAV_SCHEMA = "node_id long, parent_id long, ord long, kind string, name string, page string"


def flatten(spark: SparkSession, document: str) -> DataFrame:
    """A navigation document (JSON text, as large as one site's menu) as an edge list. Descriptors of generated API pages are left out."""
    out: list[tuple] = []

    def visit(value, parent, place, kind):
        node = len(out) + 1
        if isinstance(value, str):
            out.append((node, parent, place, kind, None, value))
        elif isinstance(value, list):
            for i, x in enumerate(value):
                visit(x, parent, i, kind)
        elif isinstance(value, dict) and not ("source" in value and "directory" in value):
            out.append((node, parent, place, kind, next((value[k] for k in NAME_KEYS if isinstance(value.get(k), str)), None), None))
            for key in COLLECTION_KEYS:
                if key in value:
                    visit(value[key], node, 0, key)

    tree = json.loads(document)
    visit(tree.get("navigation", tree), None, 0, "root")
    return spark.createDataFrame(out, NAV_SCHEMA)


def walk(tree: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Each node with the names above it (``folders``) and its place in reading order; only through ``keys`` if given."""
    children = cut(tree if keys is None else tree.filter(F.col("parent_id").isNull() | F.col("kind").isin(keys)))
    digits = F.lpad(F.col("ord").cast("string"), 4, "0")
    level = children.filter("parent_id is null").select("node_id", "kind", "name", "page", F.array().cast("array<string>").alias("folders"), digits.alias("place"))
    levels = []
    while True:
        level = cut(level)
        if level.isEmpty():
            break
        levels.append(level)
        up = level.select(F.col("node_id").alias("parent_id"), F.when(F.col("name").isNull(), F.col("folders")).otherwise(F.array_append("folders", F.col("name"))).alias("folders"), F.col("place").alias("_above"))
        level = children.join(up, "parent_id").select("node_id", "kind", "name", "page", "folders", F.concat("_above", F.lit("."), digits).alias("place"))
    out = levels[0] if levels else level
    for x in levels[1:]:
        out = out.unionByName(x)
    return out


def leaves(tree: DataFrame, keys: list[str] = CHECK_KEYS) -> DataFrame:
    """(page, node_id): each page once, at its first node."""
    return walk(tree, keys).filter("page is not null").groupBy("page").agg(F.min("node_id").alias("node_id"))


def new_paths(walked: DataFrame, base: str | bool = True, skip: tuple[int, ...] = ()) -> DataFrame:
    """(page, new_path): base, slugs of the names above less the levels skipped (from 1), and the file, ``index`` where it repeats the folder."""
    segments = F.split("page", "/")
    kept = F.filter(F.transform("folders", lambda x, i: F.when(~(i + 1).isin(list(skip) or [0]), slug_column(x))), lambda x: x.isNotNull() & (x != ""))
    p = walked.filter("page is not null").select("page", segments.alias("seg"), kept.alias("fs"))
    last = F.element_at("seg", -1)
    file = F.when((F.size("fs") > 0) & (slug_column(last) == F.try_element_at("fs", F.lit(-1))), "index").otherwise(last)
    head = F.when(F.size("seg") > 1, F.array(F.element_at("seg", 1))).otherwise(F.array().cast("array<string>")) if base is True else F.array(F.lit(base)) if base else F.array().cast("array<string>")
    return p.select("page", F.array_join(F.concat(head, "fs", F.array(file)), "/").alias("new_path"))


def slug_column(c):
    """slug_nav of any column."""
    x = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_replace(c, r"^\s+|\s+$", "")), r"\s+", "-"), "[^a-z0-9-]", "")
    return F.regexp_replace(F.regexp_replace(x, "-+", "-"), "^-|-$", "")


def moves(paths: DataFrame) -> DataFrame:
    """Redirects from old to new paths; the moving of files is left to who owns them."""
    return paths.filter("page <> new_path").select(F.concat(F.lit("/"), "page").alias("source"), F.concat(F.lit("/"), "new_path").alias("destination"))


def renamed(tree: DataFrame, paths: DataFrame) -> DataFrame:
    """The tree with moved pages under their new paths."""
    return tree.join(paths, "page", "left").select("node_id", "parent_id", "ord", "kind", "name", F.coalesce("new_path", "page").alias("page"))


def missing(pages: DataFrame, files: DataFrame) -> DataFrame:
    """Pages of the tree without a file (``page.mdx`` or ``page/index.mdx``)."""
    return pages.join(files.select(F.regexp_replace("path", r"(?:/index)?\.mdx$", "").alias("page")).distinct(), "page", "left_anti").select("page")


def titles(pages: DataFrame, files: DataFrame) -> DataFrame:
    """(page, title): of the file with the page's path, else of the only file with its name."""
    exact = files.select(F.regexp_replace("path", r"\.mdx$", "").alias("page"), F.col("title").alias("_exact"))
    base = lambda c: F.regexp_extract(c, r"([^/]+?)(?:\.mdx)?$", 1)
    unique = files.groupBy(base("path").alias("_base")).agg(F.count("*").alias("_n"), F.min("title").alias("_alone")).filter("_n = 1")
    return pages.withColumn("_base", base("page")).join(exact, "page", "left").join(unique, "_base", "left").select("page", F.coalesce("_exact", "_alone").alias("title"))


def promotions(tree: DataFrame, page_titles: DataFrame) -> DataFrame:
    """(node_id, name, root): groups nested in a group whose first entry is a page titled as the group is: that page becomes its root."""
    first = tree.filter("parent_id is not null").withColumn("_r", F.row_number().over(W.partitionBy("parent_id").orderBy("ord"))).filter("_r = 1 and page is not null")
    first = first.select(F.col("parent_id").alias("node_id"), F.col("page").alias("root"))
    above = tree.filter("kind in ('groups', 'pages')").select(F.col("node_id").alias("parent_id"))
    nested = tree.filter("name is not null and kind = 'pages'").join(above, "parent_id", "left_semi")
    titled = nested.join(first, "node_id").join(page_titles.withColumnRenamed("page", "root"), "root")
    return titled.filter(slug_nav(named("title")).column == slug_nav(named("name")).column).select("node_id", "name", "root")


def sidebar(items: DataFrame) -> DataFrame:
    """Sidebar entries of another generator (node_id, parent_id, ord, type, label, id, href) as this edge list: categories are groups, docs pages, links stay out of checks."""
    kind = F.when(F.col("parent_id").isNull(), "root").otherwise("pages")
    page = F.when(F.col("type") == "doc", F.col("id")).when(F.col("type") == "link", F.col("href"))
    name = F.when(F.col("type").isin("category", "autogenerated"), F.coalesce("label", "id"))
    return items.filter("type in ('category', 'doc', 'link', 'autogenerated', 'ref')").select("node_id", "parent_id", "ord", kind.alias("kind"), name.alias("name"), F.coalesce(page, F.when(F.col("type") == "ref", F.col("id"))).alias("page"))


def directory_order(files: DataFrame) -> DataFrame:
    """(folder, name, rank) of generated sidebars: by declared position, those without one last, then by name."""
    position = F.coalesce(F.expr("try_cast(position as double)"), F.lit(float("inf")))
    order = W.partitionBy("folder").orderBy(position, F.lower("name"), "name")
    return files.select("folder", "name", F.row_number().over(order).cast("long").alias("rank"))
