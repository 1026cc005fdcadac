"""URL rules whose block decisions reach the aliases of a page over redirects and canonical links.

A rule names a host and the beginning of a path; it fits that host and all its subdomains,
and of the rules that fit, the longest decides. Pages without a rule take the decision of
their component over alias edges: blocked if a member is blocked by a rule and none is
explicitly allowed, else allowed. All on DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import components, cut

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]


def after_scheme(url: Column) -> Column:
    """What follows the first ``://``; empty for null or where there is none."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(after_scheme(url), "^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(after_scheme(url), "^[^/?#]*([^?#]*)", 1)


def node_of(url: Column) -> Column:
    """What names a page among its aliases: host, path and query; null for what has no host."""
    host = host_of(url)
    return F.when(host != "", F.concat(host, F.regexp_extract(after_scheme(url), "^[^/?#]*([^#]*)", 1)))


def rule_for(host: Column, path: Column, rules: list[tuple[str, str]] = RULES) -> Column:
    """(verdict, rule) of the longest rule that fits, else null; of equally long ones, the one listed first."""
    out = []
    for verdict, rule in sorted(rules, key=lambda r: -len(r[1])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        out.append(F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))))
    return F.coalesce(*out)


def resolved(base: Column, href: Column) -> Column:
    """``href`` seen from the page ``base``; dot segments stay as they are."""
    scheme = F.regexp_extract(base, "^[^:]*", 0)
    root = F.concat(scheme, F.lit("://"), F.regexp_extract(after_scheme(base), "^[^/?#]*", 0))
    folder = F.regexp_replace(path_of(base), "[^/]*$", "")
    return (
        F.when(href.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), href)
        .when(href.startswith("//"), F.concat(scheme, F.lit(":"), href))
        .when(href.startswith("/"), F.concat(root, href))
        .when(href.rlike("^[?]"), F.concat(root, path_of(base), href))
        .when((href == "") | href.startswith("#") | href.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), None)
        .otherwise(F.concat(root, F.when(folder == "", "/").otherwise(folder), href))
    )


def alias_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(a, b): nodes that canonical links and refresh redirects in the pages make equivalent."""
    html = F.coalesce(F.col("html"), F.lit(""))
    attribute = lambda tag, name: F.regexp_extract(tag, rf"""(?is)\s{name}\s*=\s*["']?\s*([^"'>]*?)\s*["'>]""", 1)
    links = F.transform(F.filter(F.regexp_extract_all(html, F.lit(r"(?is)<link\b[^>]*>"), 0), lambda t: t.rlike(r"""(?is)\srel\s*=\s*["']?\s*canonical\b""")), lambda t: attribute(t, "href"))
    metas = F.transform(
        F.filter(F.regexp_extract_all(html, F.lit(r"(?is)<meta\b[^>]*>"), 0), lambda t: t.rlike(r"""(?is)\shttp-equiv\s*=\s*["']?\s*refresh\b""")),
        lambda t: F.regexp_extract(t, r"""(?is)url\s*=\s*["']?\s*([^"'>\s]+)""", 1),
    )
    found = pages.select(F.col(url_col).alias("url"), F.col(html_col).alias("html")).filter(F.col("html").rlike("(?i)canonical|http-equiv"))
    found = cut(found.select("url", F.explode(F.concat(links, metas)).alias("href")).filter("href <> ''"))
    found = cut(found.select(F.col("url").alias("from"), resolved(F.col("url"), F.col("href")).alias("to")))
    return cut(found.select(node_of(F.col("from")).alias("a"), node_of(F.col("to")).alias("b")))


def judge(pages: DataFrame, edges: DataFrame | None = None, rules: list[tuple[str, str]] = RULES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, host, path, rule, verdict), a row for each row of ``pages``.

    ``edges`` (a, b: URLs) adds redirects known from elsewhere, as from a crawl log. A null url, or one
    without ``://``, has empty host and path, no rule and no aliases, and is allowed.
    """
    links = alias_edges(pages, url_col, html_col)
    if edges is not None:
        links = links.unionByName(edges.select(node_of(F.col("a")).alias("a"), node_of(F.col("b")).alias("b")).filter("a is not null and b is not null"))
    alias = components(links)
    probe = F.concat(F.lit("x://"), F.col("node"))
    said = alias.select("node", "component", rule_for(host_of(probe), path_of(probe), rules)["verdict"].alias("said"))
    roots = alias.select(F.col("component").alias("node"), "component").distinct()
    probe = F.concat(F.lit("x://"), F.col("node"))
    said = said.unionByName(roots.select("node", "component", rule_for(host_of(probe), path_of(probe), rules)["verdict"].alias("said")))
    decided = said.groupBy("component").agg(F.coalesce(F.bool_or(F.col("said") == "block"), F.lit(False)).alias("b"), F.coalesce(F.bool_or(F.col("said") == "allow"), F.lit(False)).alias("a"))
    # Written out, so that the members of a giant component may be split among tasks.
    blocking = cut(decided.filter("b and not a").select("component"))
    blocked = cut(said.select("node", "component").join(blocking, "component", "left_semi").select("node").distinct())
    url = F.col(url_col)
    parsed = pages.select(F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"), node_of(url).alias("node"))
    ruled = parsed.select("*", rule_for(F.col("host"), F.col("path"), rules).alias("said"))
    # Pages without a node are spread by their id, which no node equals.
    ruled = ruled.withColumn("node", F.coalesce("node", F.concat(F.lit("\0"), F.coalesce(F.col("page_id").cast("string"), F.lit("")))))
    joined = ruled.join(blocked.withColumn("hit", F.lit(True)), "node", "left")
    verdict = F.coalesce(F.col("said.verdict"), F.when(F.col("hit"), "block").otherwise("allow"))
    return joined.select("page_id", "host", "path", F.col("said.rule").alias("rule"), verdict.alias("verdict"))
