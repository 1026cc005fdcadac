"""Links and headings of markdown documents, and whether the links lead anywhere. All joins on keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.dual import Dual, named, quoted, replaced
from ..functions.text import kebab

FRONT, FENCE = r"(?ms)^---\n.*?\n---\n", r"(?s)```.*?```"
HEADING = r"(?m)^#{1,6}[ \t]+([^\n]+)"
#: Kind, expression, places of the target and the text (0: the target is the text).
LINKS = [
    ("markdown", r"(?:^|[^!])\[([^\]]+?)\]\(([^)]+?)\)", 2, 1),
    ("html", r"""<a\s+href=["']([^"']*)["'][^>]*?>(.*?)</a>""", 1, 2),
    ("jsx", r"""<Card[^>]+?href=["']([^"']*)["'][^>]*?>""", 1, 0),
    ("jsx", r"""<Button[^>]+?href=["']([^"']*)["'][^>]*?>(.*?)</Button>""", 1, 2),
]
BASE = "https://docs.example.org"


def blanked(content: Column, keep_lines: bool) -> Column:
    """``content`` with front matter and fences as blanks of the same length; ``keep_lines`` spares the line ends."""
    parts = F.concat(F.array(F.regexp_extract(content, FRONT, 0)), F.regexp_extract_all(content, F.lit(FENCE), 0))
    blank = (lambda p: F.regexp_replace(p, "[^\n]", " ")) if keep_lines else (lambda p: F.repeat(F.lit(" "), F.length(p)))
    return F.aggregate(F.filter(parts, lambda p: p != ""), content, lambda text, p: F.replace(text, p, blank(p)))


def blanked_sql(content: str, keep_lines: bool) -> str:
    blank = "regexp_replace(p, '[^\\n]', ' ', 'g')" if keep_lines else "repeat(' ', length(p))"
    return f"list_reduce(list_concat([{content}], list_filter(list_concat([regexp_extract({content}, {quoted(FRONT)}, 0)], regexp_extract_all({content}, {quoted(FENCE)})), lambda p: p <> '')), lambda text, p: replace(text, p, {blank}))"


def headings(docs: DataFrame) -> DataFrame:
    """(path, pos, text, slug) of the headings outside fences."""
    found = docs.select("path", F.posexplode(F.regexp_extract_all(blanked(F.col("content"), False), F.lit(HEADING), 1)).alias("pos", "text"))
    text = F.regexp_replace(F.regexp_replace("text", r"^\s+|\s+$", ""), r"\s*\{#[^}]+\}\s*$", "")
    return found.select("path", F.col("pos").cast("long").alias("pos"), text.alias("text")).select("*", kebab(named("text")).column.alias("slug"))


def headings_sql(source: str) -> str:
    raw = f"SELECT path, unnest(h) AS text, CAST(unnest(range(len(h))) AS BIGINT) AS pos FROM (SELECT path, regexp_extract_all({blanked_sql('content', False)}, {quoted(HEADING)}, 1) AS h FROM ({source}))"
    text = "regexp_replace(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '\\s*\\{#[^}]+\\}\\s*$', '', 'g')"
    return f"SELECT path, pos, text, {kebab(named('text')).sql} AS slug FROM (SELECT path, pos, {text} AS text FROM ({raw}))"


def link_reader(kind: str, pattern: str, href: int, text: int):
    return lambda m: F.struct(F.lit(kind).alias("kind"), F.regexp_extract(m, pattern, href).alias("href"), F.trim(F.regexp_extract(m, pattern, text or href)).alias("text"))


def links(docs: DataFrame) -> DataFrame:
    """(path, line, kind, href, text) of internal links outside fences; images are no links."""
    lines = docs.select("path", F.posexplode(F.split(blanked(F.col("content"), True), "\n")).alias("line", "row")).filter(F.col("row").rlike(r"\]\(|<a\s|<Card|<Button"))
    made = []
    for kind, pattern, href, text in LINKS:
        made.append(F.transform(F.regexp_extract_all("row", F.lit(pattern), 0), link_reader(kind, pattern, href, text)))
    found = lines.select("path", (F.col("line") + 1).cast("long").alias("line"), F.inline(F.concat(*made)))
    return found.filter(~F.col("href").rlike("^https?://"))


def links_sql(source: str) -> str:
    lines = f"SELECT path, unnest(r) AS row, CAST(unnest(range(len(r))) + 1 AS BIGINT) AS line FROM (SELECT path, string_split({blanked_sql('content', True)}, chr(10)) AS r FROM ({source}))"
    parts = " UNION ALL ".join(f"SELECT path, line, {quoted(k)} AS kind, regexp_extract(m, {quoted(p)}, {h}) AS href, trim(regexp_extract(m, {quoted(p)}, {t or h})) AS text FROM (SELECT path, line, unnest(regexp_extract_all(row, {quoted(p)})) AS m FROM ({lines}))" for k, p, h, t in LINKS)
    return f"SELECT * FROM ({parts}) WHERE NOT regexp_matches(href, '^https?://')"


def dots_resolved(path: Dual) -> Dual:
    """A path without dot segments; one that climbs above the root begins with ``!``."""
    spark = lambda: F.aggregate(
        F.split(path.column, "/"), F.lit(""),
        lambda acc, s: F.when((s == "") | (s == "."), acc).when(s == "..", F.when(acc == "", F.lit("!")).otherwise(F.regexp_replace(acc, "/?[^/]*$", ""))).otherwise(F.concat(acc, F.when(acc == "", "").otherwise("/"), s)),
    )
    sql = f"list_reduce(list_concat([''], string_split({path.sql}, '/')), lambda acc, s: CASE WHEN s = '' OR s = '.' THEN acc WHEN s = '..' THEN CASE WHEN acc = '' THEN '!' ELSE regexp_replace(acc, '/?[^/]*$', '') END ELSE acc || CASE WHEN acc = '' THEN '' ELSE '/' END || s END)"
    return Dual(spark, sql)


def target_columns() -> dict[str, Dual]:
    """From path and href: the page a link leads to, without base, and its anchor. Null where it leaves the tree."""
    link_path, anchor = replaced(named("href"), "#.*$", ""), Dual(lambda: F.when(F.col("href").contains("#"), F.regexp_extract("href", "#([^#]*)", 1)), "CASE WHEN contains(href, '#') THEN regexp_extract(href, '#([^#]*)', 1) END")
    own = replaced(named("path"), r"\.mdx$", "")
    folder = replaced(named("path"), "/?[^/]*$", "")
    relative = dots_resolved(Dual(lambda: F.concat(folder.column, F.lit("/"), link_path.column), f"({folder.sql} || '/' || {link_path.sql})"))
    bare = replaced(replaced(relative, r"\.mdx$", ""), "^/", "")
    normal = lambda d: replaced(replaced(d, r"/index(?:\.mdx)?$", ""), "/+$", "")
    rooted = normal(replaced(link_path, "^/", ""))
    column = lambda: F.when((link_path.column == "") & (F.coalesce(anchor.column, F.lit("")) != ""), normal(own).column).when(F.col("href").startswith("/"), rooted.column).when(relative.column.startswith("!"), None).otherwise(normal(bare).column)
    sql = f"CASE WHEN {link_path.sql} = '' AND coalesce({anchor.sql}, '') <> '' THEN {normal(own).sql} WHEN starts_with(href, '/') THEN {rooted.sql} WHEN starts_with({relative.sql}, '!') THEN NULL ELSE {normal(bare).sql} END"
    empty = Dual(lambda: F.when(anchor.column != "", anchor.column), f"CASE WHEN {anchor.sql} <> '' THEN {anchor.sql} END")
    return {"target": Dual(column, sql), "anchor": empty}


def resolved(found: DataFrame) -> DataFrame:
    return found.select("*", *[d.column.alias(n) for n, d in target_columns().items()]).filter("target is not null")


def resolved_sql(source: str) -> str:
    return f"SELECT * FROM (SELECT *, {', '.join(f'{d.sql} AS {n}' for n, d in target_columns().items())} FROM ({source})) WHERE target IS NOT NULL"


PAGE = r"(?:/index)?\.mdx$"


def validated(docs: DataFrame) -> DataFrame:
    """(path, line, kind, href, target, anchor, status): success if the page is there, and the heading if an anchor is given; else failure.

    A page is found as ``target.mdx`` or ``target/index.mdx``: both reduce to one key, so it is one join.
    """
    found = resolved(links(docs))
    pages = docs.select(F.regexp_replace("path", PAGE, "").alias("target")).distinct().withColumn("page", F.lit(True))
    slugs = headings(docs).select(F.regexp_replace("path", PAGE, "").alias("target"), F.col("slug").alias("anchor")).distinct().withColumn("heading", F.lit(True))
    joined = found.join(pages, "target", "left").join(slugs, ["target", "anchor"], "left")
    ok = F.col("page").isNotNull() & (F.col("anchor").isNull() | F.col("heading").isNotNull())
    return joined.select("path", "line", "kind", "href", "target", "anchor", F.when(ok, "success").otherwise("failure").alias("status"))


def validated_sql(source: str) -> str:
    found = resolved_sql(links_sql(source))
    page = f"SELECT DISTINCT regexp_replace(path, '{PAGE}', '') AS target FROM ({source})"
    slugs = f"SELECT DISTINCT regexp_replace(path, '{PAGE}', '') AS target, slug FROM ({headings_sql(source)})"
    return f"SELECT l.path, l.line, l.kind, l.href, l.target, l.anchor, CASE WHEN p.target IS NOT NULL AND (l.anchor IS NULL OR h.target IS NOT NULL) THEN 'success' ELSE 'failure' END AS status FROM ({found}) l LEFT JOIN ({page}) p ON p.target = l.target LEFT JOIN ({slugs}) h ON h.target = l.target AND h.slug = l.anchor"


def duplicate_ordinals(found: DataFrame, page: str = "path") -> DataFrame:
    """Headings with their ordinal among those of the same text on the page."""
    same = F.lower("text")
    return found.withColumn("ordinal", F.row_number().over(W.partitionBy(page, same).orderBy("pos")).cast("long"))


def matched_headings(source: DataFrame, target: DataFrame, pair: str | None = None) -> DataFrame:
    """Headings of one rendered page (pos, text, id) joined with another's of the same text and ordinal; an ordinal beyond the last takes the last. Many pairs of pages are told apart by the column ``pair``."""
    own = [pair] if pair else ["_pair"]
    marked = lambda df: df if pair else df.withColumn("_pair", F.lit(1))
    key = lambda df, side: duplicate_ordinals(marked(df), *own).select(*own, F.lower("text").alias("key"), F.col("ordinal").alias(f"{side}_ordinal"), F.col("id").alias(f"{side}_id"), F.col("pos").alias(f"{side}_pos"))
    left, right = key(source, "source"), key(target, "target")
    joined = left.join(right.groupBy(*own, "key").agg(F.count("*").alias("n")), [*own, "key"]).withColumn("target_ordinal", F.least("source_ordinal", "n"))
    return joined.join(right, [*own, "key", "target_ordinal"]).select(*([pair] if pair else []), "key", "source_pos", "source_ordinal", "target_pos", "target_id")


def fuzzy(wanted: DataFrame, rendered: DataFrame) -> DataFrame:
    """For each (page, link_text): the heading of the page that fits best, by score, then place."""
    joined = wanted.join(rendered, "page")
    h, t = F.lower(F.trim("text")), F.lower(F.trim("link_text"))
    words, theirs = F.split(t, r"\s+"), F.split(h, r"\s+")
    hits = F.size(F.filter(words, lambda w: F.array_contains(theirs, w)))
    n = F.size(words)
    score = F.when(h == t, 100).when(F.contains(h, t), 80).when(F.contains(t, h), 70).when((hits == n) & (n >= 2), 60).when((hits >= F.ceil(n * 0.7)) & (n >= 3), 50)
    best = joined.withColumn("score", score.cast("long")).filter("score is not null")
    order = W.partitionBy("page", "link_text").orderBy(F.desc("score"), "pos")
    return best.withColumn("_r", F.row_number().over(order)).filter("_r = 1").select("page", "link_text", "text", "id", "score")
