"""Pages as rows of elements, and the component families among them: siblings that are built alike.

``elements`` parses each page where it lies and leaves a row for each element, in document order, with a hash of its subtree
made bottom-up: tag, classes and the children's hashes, runs of equal children counting once. All else is grouping and joining:
a family is a hash that siblings share, and its selector the shortest one that fits its members and nothing else on the page.
``page_id`` names a page; null html has no elements.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.shared import cut
from .html_tree import parse

ELEMENTS = (
    "page_id long, node int, parent int, depth int, tag string, id string, classes array<string>, "
    "parent_tag string, parent_id string, parent_classes array<string>, size int, shape string"
)
NAMES = [c.split()[0] for c in ELEMENTS.split(", ")]
KINDS = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.list_(pa.string()), pa.string(), pa.string(), pa.list_(pa.string()), pa.int32(), pa.string()]
#: Elements that one member of a family has at least, unless it has a class, and members beside each other.
LEAST_SIZE, LEAST_ALIKE = 2, 2


def element_rows(page_id: int | None, html: str) -> list[tuple]:
    """The elements of a page in document order."""
    nodes = list(parse(html).walk())
    at = {id(n): k for k, n in enumerate(nodes)}
    parents = [at.get(id(n.parent), -1) for n in nodes]
    depth, size, shapes, below = [0] * len(nodes), [1] * len(nodes), [""] * len(nodes), [[] for _ in nodes]
    for k, up in enumerate(parents):
        depth[k] = depth[up] + 1 if up >= 0 else 0
    for k in range(len(nodes) - 1, -1, -1):  # children come after their parents, so they are done
        own = below[k][::-1]
        runs = [s for i, s in enumerate(own) if not i or s != own[i - 1]]
        shapes[k] = hashlib.blake2b("\0".join([nodes[k].tag, " ".join(sorted(set(nodes[k].classes()))), *runs]).encode(), digest_size=16).hexdigest()
        if parents[k] >= 0:
            below[parents[k]].append(shapes[k])
            size[parents[k]] += size[k]
    about = [(n.tag, n.attrs.get("id"), sorted(set(n.classes()))) for n in nodes]
    none = (None, None, [])
    return [(page_id, k, parents[k], depth[k], *about[k], *(about[parents[k]] if parents[k] >= 0 else none), size[k], shapes[k]) for k in range(len(nodes))]


def elements(pages: DataFrame) -> DataFrame:
    """``ELEMENTS`` of pages (page_id, html)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: list[tuple] = []
            for page_id, html in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                held += element_rows(page_id, html.as_py() or "")
                if len(held) >= 20_000:
                    yield made(held)
                    held = []
            if held:
                yield made(held)

    def made(held: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*held, strict=True), KINDS, strict=True)], NAMES)

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "html").mapInArrow(run, ELEMENTS)


def names(classes: str) -> Column:
    """Classes that can stand in a selector as they are."""
    return F.filter(classes, lambda c: c.rlike("^-?[A-Za-z_][A-Za-z0-9_-]*$"))


def compounds(tag: str, classes: str) -> Column:
    """Tag, each class, tag with each class."""
    dotted = F.transform(names(classes), lambda c: F.concat(F.lit("."), c))
    return F.concat(F.array(tag), dotted, F.transform(dotted, lambda c: F.concat(F.col(tag), c)))


def under_parent() -> Column:
    """The compounds of an element after those of its parent, or after the parent's id."""
    of_id = F.when(F.col("parent_id").rlike("^-?[A-Za-z_][A-Za-z0-9_-]*$"), F.array(F.concat(F.lit("#"), F.col("parent_id")))).otherwise(F.array().cast("array<string>"))
    above = F.concat(of_id, F.when(F.col("parent_tag").isNotNull(), compounds("parent_tag", "parent_classes")).otherwise(F.array().cast("array<string>")))
    return F.flatten(F.transform(above, lambda a: F.transform(compounds("tag", "classes"), lambda c: F.concat(a, F.lit(" > "), c))))


def unique(nodes: DataFrame, sizes: DataFrame, candidates: Column) -> DataFrame:
    """(page_id, family, selector): of the candidates that fit all members of a family and no other element of the page, the shortest, then first."""
    each = nodes.select("page_id", "family", F.explode(F.array_distinct(candidates)).alias("selector"))
    fits = each.groupBy("page_id", "selector").agg(F.count("*").alias("all"), F.count("family").alias("inside"), F.min("family").alias("family"), F.max("family").alias("last"))
    exact = fits.filter("all = inside and family = last").join(sizes, ["page_id", "family"]).filter("all = members")
    return exact.groupBy("page_id", "family").agg(F.min(F.struct(F.length("selector").alias("n"), "selector"))["selector"].alias("selector"))


def families(nodes: DataFrame) -> DataFrame:
    """(page_id, family, tag, members, pages, selector) of ``elements``: for each page and family how many elements, on how many pages the family is, and its selector.

    Selectors with the parent's name are tried only for pages where an element's own name isn't enough; where neither is, it is null.
    """
    alike = F.count("*").over(W.partitionBy("page_id", "parent", "shape"))
    marked = cut(nodes.withColumn("family", F.when((alike >= LEAST_ALIKE) & ((F.col("size") >= LEAST_SIZE) | (F.size("classes") > 0)) & (F.col("parent") >= 0), F.col("shape"))).drop("shape", "size", "depth"))
    sizes = cut(marked.filter("family is not null").groupBy("page_id", "family").agg(F.first("tag").alias("tag"), F.count("*").alias("members")))
    own = cut(unique(marked, sizes.select("page_id", "family", "members"), compounds("tag", "classes")))
    left = sizes.select("page_id", "family", "members").join(own, ["page_id", "family"], "left_anti")
    rest = unique(marked.join(left.select("page_id").distinct(), "page_id", "left_semi"), left, under_parent())
    spread = sizes.groupBy("family").agg(F.count("*").alias("pages"))
    found = sizes.join(own.unionByName(rest), ["page_id", "family"], "left").join(spread, "family")
    return found.select("page_id", "family", "tag", "members", "pages", "selector")
