"""Lookups of what documents and pages name: imported files, images, categories. Each is an equi-join on exploded candidates, the first that is there counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls
from ..functions.dual import Dual

#: Endings that an import may leave out, in order; files that count as images.
IMPORT_ENDINGS = ["", ".mdx", ".jsx", ".tsx", ".js", ".ts"]
IMAGE_ENDINGS = [".png", ".jpg", ".jpeg", ".gif", ".svg", ".webp", ".avif", ".ico"]
#: What no category names.
NO_CATEGORY = "Uncategorized"


def beside(path: str, target: str) -> Dual:
    """The path of ``target`` as seen from the folder of the document ``path``, dots resolved, without a slash before it; with a slash before it, it is seen from the root."""
    whole = Dual(
        lambda: F.concat(F.lit("/"), F.when(F.col(target).startswith("/"), F.substring(target, 2, 1 << 30)).otherwise(F.concat(F.regexp_replace(path, "[^/]*$", ""), F.col(target)))),
        f"('/' || CASE WHEN starts_with({target}, '/') THEN substr({target}, 2) ELSE regexp_replace({path}, '[^/]*$', '') || {target} END)",
    )
    clean = urls.without_dots(whole)
    return Dual(lambda: F.regexp_replace(clean.column, "^/", ""), f"regexp_replace({clean.sql}, '^/', '')")


def found(asked: DataFrame, base: Column, endings: list[str], files: DataFrame, out: str) -> DataFrame:
    """``asked`` with ``out``: the first of ``base`` with each ending that is a file (path), else null. Rows that are repeated stay so."""
    keyed = asked.withColumn("_base", base)
    ends = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(e).alias("e")) for i, e in enumerate(endings)])
    tries = keyed.select("_base").distinct().select("_base", F.inline(ends)).select("_base", "i", F.concat("_base", "e").alias("_file"))
    there = tries.join(files.select(F.col("path").alias("_file")).distinct(), "_file")
    first = there.groupBy("_base").agg(F.min_by("_file", "i").alias(out))
    return keyed.join(first, "_base", "left").drop("_base")


def imports(asked: DataFrame, files: DataFrame) -> DataFrame:
    """(path, spec, target, kind) of imports (path, spec): the file it means, ``missing`` if there is none; what begins with neither dot nor slash is a ``package``."""
    local = F.col("spec").rlike("^[./]")
    done = found(asked.select("path", "spec"), F.when(local, beside("path", "spec").column), IMPORT_ENDINGS, files, "target")
    return done.withColumn("kind", F.when(~local, "package").when(F.col("target").isNotNull(), "file").otherwise("missing"))


def images(asked: DataFrame, files: DataFrame, static: str = "static") -> DataFrame:
    """(path, src, put, kind) of images (path, src): one that is among the files stays; else it goes to the static folder, where it is known to lie or assumed to. Paths from the root are the static folder's own."""
    bare = F.substring_index("src", "#", 1)
    ending = F.lower(F.regexp_extract(bare, r"[^./](\.[^./]*)$", 1))
    short = F.regexp_replace(F.regexp_replace(bare, r"^(\.\./)+", ""), r"^\./", "")
    kept = F.col("src").rlike("^(?:https?://|data:|//|/static/)") | ~F.col("src").startswith("/") & ((ending != "") & ~ending.isin(IMAGE_ENDINGS) | (short == ""))
    rows = asked.select("path", "src", bare.alias("_bare"), kept.alias("_kept"), short.alias("_short"))
    both = found(found(rows, beside("path", "_bare").column, [""], files, "_own"), F.concat(F.lit(static + "/"), "_short"), [""], files, "_static")
    rooted = F.col("src").startswith("/")
    kind = F.when(F.col("_kept"), "other").when(rooted, "root").when(F.col("_own").isNotNull(), "document").when(F.col("_static").isNotNull(), "static").otherwise("assumed")
    put = F.when(kind == "root", F.concat(F.lit("/static"), "src")).when(kind.isin("static", "assumed"), F.concat(F.lit("/static/"), "_short", F.expr("substring(src, length(_bare) + 1)"))).otherwise(F.col("src"))
    return both.select("path", "src", put.alias("put"), kind.alias("kind"))


def categories(pages: DataFrame, listed: DataFrame) -> DataFrame:
    """(page_id, category) of pages (page_id, url) by navigation (ord, name, url): urls are compared in normal form, the first category that has it wins."""
    normal = urls.normalized().column.alias("_url")
    first = listed.select("ord", "name", normal).filter("_url is not null").groupBy("_url").agg(F.min_by("name", "ord").alias("name"))
    return pages.select("page_id", normal).join(first, "_url", "left").select("page_id", F.coalesce("name", F.lit(NO_CATEGORY)).alias("category"))


def link_texts(pages: DataFrame, link: str, most: int = 100) -> DataFrame:
    """(page_id, ord, url, text) of links to other origins; texts without tags, cut to ``most`` characters as the report shows them."""
    each = pages.select("page_id", urls.origin().column.alias("_own"), F.posexplode(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(link), F.lit(0))).alias("ord", "a"))
    text = F.regexp_replace(F.regexp_replace(F.regexp_extract("a", link, 2), "<[^>]+>", ""), r"^\s+|\s+$", "")
    out = each.select("page_id", F.col("ord").cast("long").alias("ord"), "_own", F.regexp_extract("a", link, 1).alias("url"), F.substring(text, 1, most).alias("text"))
    return out.filter(urls.origin().column != F.col("_own")).select("page_id", "ord", "url", "text")


#: A meta tag, an attribute of it, and the attributes that may name it, first first.
META, ATTRIBUTE, NAMED_BY = r"(?i)<meta\s+[^>]+>", r"""[A-Za-z0-9_][A-Za-z0-9_-]*=(?:"[^"]*"|'[^']*')""", ["property", "name", "itemprop"]


def attribute(name: str) -> Dual:
    """The last value of an attribute in the list ``attrs`` of ``name="value"``, else null."""
    own = len(name) + 1
    of = lambda x: x.startswith(f"{name}=")
    return Dual(
        lambda: F.try_element_at(F.transform(F.filter("attrs", of), lambda x: F.substring(x, F.lit(own + 2), F.length(x) - (own + 2))), F.lit(-1)),
        f"list_transform(list_filter(attrs, lambda x: starts_with(x, '{name}=')), lambda x: substr(x, {own + 2}, length(x) - {own + 2}))[-1]",
    )


def meta_values(pages: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(page_id, key, value) of meta tags in any order of their attributes: named by property, else name, else itemprop; blank values don't count, the last of several does. ``keys`` keeps only these."""
    tags = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(META), F.lit(0))).alias("i", "tag")).select("page_id", "i", F.regexp_extract_all("tag", F.lit(ATTRIBUTE), F.lit(0)).alias("attrs"))
    key = F.coalesce(*[F.nullif(attribute(n).column, F.lit("")) for n in NAMED_BY])
    each = tags.select("page_id", "i", key.alias("key"), F.regexp_replace(attribute("content").column, r"^\s+|\s+$", "").alias("value")).filter("key is not null and value <> ''")
    each = each.filter(F.col("key").isin(keys)) if keys else each
    return each.groupBy("page_id", "key").agg(F.max_by("value", "i").alias("value"))


def error_counts(pages: DataFrame, errors: DataFrame) -> DataFrame:
    """(pages, clean, with_errors, errors): pages (page_id) with and without rows in ``errors`` (page_id)."""
    each = pages.select("page_id").join(errors.groupBy("page_id").agg(F.count("*").alias("n")), "page_id", "left")
    return each.agg(F.count("*").alias("pages"), F.count_if(F.col("n").isNull()).alias("clean"), F.count("n").alias("with_errors"), F.coalesce(F.sum("n"), F.lit(0)).alias("errors"))


def fix_totals(rules: dict[str, DataFrame]) -> DataFrame:
    """(rule, changes, files) of each rule's rows (path, changes): all changes, and the documents that have any."""
    named = [df.select(F.lit(rule).alias("rule"), "changes") for rule, df in rules.items()]
    return reduce(DataFrame.unionByName, named).groupBy("rule").agg(F.coalesce(F.sum("changes"), F.lit(0)).cast("long").alias("changes"), F.count_if(F.col("changes") > 0).alias("files"))
