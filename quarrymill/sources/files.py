"""Reading corpora: markdown trees, navigation and report JSON, crawled pages, and what a walk leaves out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders that walks skip.
SKIPPED = {"check": ["snippets", "node_modules", ".git"], "fix": ["node_modules", ".git"], "site": ["node_modules", ".git", ".docusaurus", "build", "dist", ".cache"]}


#: Where a document's front matter names its address: by slug, else by id.
SLUG_OF = [rf"""(?ms)^---\n.*?^{k}\s*:\s*["']?([^"'\n]+)["']?\s*$""" for k in ("slug", "id")]


def slugs(docs: DataFrame) -> DataFrame:
    """(path, slug) of documents (path, content); null where the front matter names none."""
    return docs.select("path", F.coalesce(*[F.nullif(F.regexp_extract("content", p, 1), F.lit("")) for p in SLUG_OF]).alias("slug"))


def within(path: Column, folders: list[str]) -> Column:
    """Whether one of a path's folders is among ``folders``."""
    return F.arrays_overlap(F.split(F.regexp_replace(path, "/?[^/]*$", ""), "/"), F.array(*[F.lit(f) for f in folders]))


def hidden(path: Column) -> Column:
    return path.rlike(r"(^|/)\.[^/]")


def walk(files: DataFrame, rule: str = "fix", extensions: tuple[str, ...] = (".mdx",)) -> DataFrame:
    """Rows of ``files`` (path, ...) that a walk visits. Rules: ``links`` drops paths that contain ``snippets`` anywhere; ``check``, ``fix``, ``site`` skip folders by name; ``visible`` skips what begins with a dot, and node_modules."""
    kept = files.filter(F.col("path").rlike("(" + "|".join(e.replace(".", r"\.") for e in extensions) + ")$"))
    if rule == "links":
        return kept.filter(~F.contains(F.col("path"), F.lit("snippets")))
    if rule == "visible":
        return kept.filter(~hidden(F.col("path")) & ~within(F.col("path"), ["node_modules"]))
    return kept.filter(~within(F.col("path"), SKIPPED[rule]))


def markdown(spark: SparkSession, root: str, rule: str = "fix", extensions: tuple[str, ...] = (".mdx",), file: str | None = None) -> DataFrame:
    """(path, content) of the documents under ``root`` (or of one ``file``), paths relative to it; a row per file, read in parallel."""
    reader = spark.read.option("recursiveFileLookup", True)
    raw = reader.text(file or root, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))
    prefix = f"^.*?{root.rstrip('/').rsplit('/', 1)[-1]}/"
    return walk(raw.select(F.regexp_replace("path", prefix, "").alias("path"), "content"), rule, extensions)


def document_json(spark: SparkSession, path: str) -> str:
    """The text of one JSON document, such as a site's navigation."""
    return spark.read.text(path, wholetext=True).first()["value"]


def url_list(spark: SparkSession, path: str | None = None, urls: tuple[str, ...] = ()) -> DataFrame:
    """(url) given and from a JSON array, each once."""
    given = spark.createDataFrame([(u,) for u in urls], "url string")
    if path:
        listed = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "array<string>")).alias("url"))
        given = given.unionByName(listed)
    return given.distinct()


def link_report(spark: SparkSession, path: str) -> DataFrame:
    """Failures of a links report (path, line, kind, href, anchor, new_anchor, status), as the anchor rewriter takes them."""
    each = "source:struct<filePath:string,lineNumber:bigint,rawHref:string,linkType:string>,anchor:string,actualHeadingAnchor:string,status:string"
    read = F.from_json("value", f"results_by_file map<string, array<struct<{each}>>>")["results_by_file"]
    rows = spark.read.text(path, wholetext=True).select(F.explode(read).alias("path", "r")).select("path", F.explode("r").alias("r"))
    return rows.select("path", F.col("r.source.lineNumber").alias("line"), F.col("r.source.linkType").alias("kind"), F.col("r.source.rawHref").alias("href"), "r.anchor", F.col("r.actualHeadingAnchor").alias("new_anchor"), "r.status")


def fixable(report: DataFrame) -> DataFrame:
    return report.filter("status = 'failure' and new_anchor is not null and anchor is not null")


def broken_links(lines: DataFrame) -> DataFrame:
    """(path) from the rows (line) of a broken-link text report: marked lines, their last part, without fragment, each once, in order."""
    marked = lines.filter(F.contains(F.col("line"), F.lit("⎿"))).select(F.trim(F.element_at(F.split("line", "⎿"), -1)).alias("path"))
    return marked.filter(F.col("path").startswith("/")).select(F.substring_index("path", "#", 1).alias("path")).distinct().orderBy("path")


def by_name(files: DataFrame) -> DataFrame:
    """(name, paths, n): files by base name without extension."""
    name = F.regexp_extract("path", r"([^/]+?)(?:\.mdx)?$", 1)
    return files.groupBy(name.alias("name")).agg(F.array_join(F.array_sort(F.collect_list("path")), ",").alias("paths"), F.count("*").alias("n"))


def articles(rows: DataFrame, content: str, file: str, title: str | None = None) -> DataFrame:
    """(url, content, path, title, error) from API answers (url, body) by dot paths; what isn't there, or isn't text, is an error."""
    at = lambda dots: F.get_json_object("body", "$." + dots)
    error = F.when(at(content).isNull(), f"missing {content}").when(at(file).isNull(), f"missing {file}")
    return rows.select("url", at(content).alias("content"), at(file).alias("path"), (at(title) if title else F.lit(None).cast("string")).alias("title"), error.alias("error"))


def cookies_for(cookies: DataFrame, hosts: DataFrame) -> DataFrame:
    """Cookies (name, value, domain) that go to each host: its own domain or one above it. Hosts are cut into their suffixes, so it is an equi-join."""
    labels = F.split("host", r"\.")
    each = hosts.select("host", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))).alias("domain"))
    return each.join(cookies.select("name", "value", F.regexp_replace("domain", r"^\.", "").alias("domain")), "domain").select("host", "name", "value")
