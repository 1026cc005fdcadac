"""API descriptions on pages: which kinds a page shows, and what those embedded in it hold.

Embedded text is read as semi-structured values: a broken one is null and an error, never a failure of the job.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Methods that count as endpoints, and what marks a description.
METHODS = ["get", "post", "put", "patch", "delete", "head", "options"]
OPENAPI, OPENAPI_VERSION = r"""(?i)["']openapi["']\s*:\s*["']3""", r"""(?i)["']openapi["']\s*:\s*["']([0-9.]+)["']"""
SWAGGER, ASYNCAPI = r"""(?i)["']swagger["']\s*:\s*["']2""", r"""(?i)["']asyncapi["']\s*:"""
SPEC_LINK = r"""(?i)href=["']([^"']*(?:swagger|openapi|asyncapi)[^"']*)["']"""
GRAPHQL = r"(?i)graphql|graphiql"
YAML_VERSION, YAML_PATH, YAML_METHOD = r"""(?m)^(?:openapi|swagger)[ \t]*:[ \t]*["']?([0-9.]+)""", r"(?m)^  /[^\s:]+:", r"(?m)^[ \t]{4,}(?:get|post|put|patch|delete|head|options)[ \t]*:"
BLOCKS = [r"(?is)<script[^>]*>(.*?)</script>", r"(?is)<pre[^>]*>(.*?)</pre>"]
#: JSON of a value that counts as absent.
FALSY = r'^(null|false|""|-?0(\.0+)?([eE][-+]?[0-9]+)?)$'


def shown(pages: DataFrame) -> DataFrame:
    """(page_id, ord, url, type, version, valid) of pages (page_id, url, html): embedded kinds, linked descriptions, GraphQL; ``ord`` counts from 0 on each page."""
    html = F.col("html")
    one = lambda when, kind, version, valid: F.when(when, F.struct(F.col("url"), F.lit(kind).alias("type"), version.cast("string").alias("version"), F.lit(valid).cast("boolean").alias("valid")))
    none = F.lit(None).cast("string")
    version = F.regexp_extract(html, OPENAPI_VERSION, 1)
    inside = [one(html.rlike(OPENAPI), "openapi", F.when(version == "", "3.0").otherwise(version), True), one(~html.rlike(OPENAPI) & html.rlike(SWAGGER), "swagger", F.lit("2.0"), True), one(html.rlike(ASYNCAPI), "asyncapi", none, None)]
    kind = lambda u: F.when(u.rlike("(?i)swagger"), "swagger").when(u.rlike("(?i)asyncapi"), "asyncapi").when(u.rlike("(?i)graphql"), "graphql").otherwise("openapi")
    linked = F.transform(F.regexp_extract_all("html", F.lit(SPEC_LINK), F.lit(1)), lambda u: F.struct(u.alias("url"), kind(u).alias("type"), none.alias("version"), F.lit(None).cast("boolean").alias("valid")))
    found = F.concat(F.array_compact(F.array(*inside)), linked)
    graph = one(html.rlike(GRAPHQL) & ~F.exists(linked, lambda s: s["type"] == "graphql"), "graphql", none, None)
    listed = pages.select("page_id", F.posexplode(F.concat(found, F.array_compact(F.array(graph)))).alias("ord", "s"))
    return listed.select("page_id", F.col("ord").cast("long").alias("ord"), "s.url", "s.type", "s.version", "s.valid")


def blocks(pages: DataFrame) -> DataFrame:
    """(page_id, ord, text): what stands in scripts, then in preformatted blocks, that could be a description."""
    every = F.concat(*[F.regexp_extract_all("html", F.lit(p), F.lit(1)) for p in BLOCKS])
    each = pages.select("page_id", F.posexplode(every).alias("ord", "text")).select("page_id", F.col("ord").cast("long").alias("ord"), F.trim("text").alias("text"))
    return each.filter(F.col("text").startswith("{") | F.col("text").rlike(YAML_VERSION))


def truthy(value: Column) -> Column:
    return value.isNotNull() & ~F.to_json(value).rlike(FALSY)


def paths(spec: Column) -> Column:
    """The paths of a description as a map to their variants; null where there are none."""
    return F.try_variant_get(spec, "$.paths", "map<string,variant>")


def endpoints(texts: DataFrame) -> DataFrame:
    """(page_id, ord, path, method) of ``blocks`` that are JSON: each method of each path."""
    each = texts.select("page_id", "ord", F.explode(paths(F.try_parse_json("text"))).alias("path", "about"))
    asked = F.array_compact(F.array(*[F.when(truthy(F.try_variant_get("about", f"$.{m}", "variant")), F.lit(m)) for m in METHODS]))
    return each.select("page_id", "ord", "path", F.explode(asked).alias("method"))


def measured(texts: DataFrame) -> DataFrame:
    """(page_id, ord, type, version, endpoints, valid, error) of ``blocks``: JSON by its paths and methods, else YAML by its lines."""
    spec = F.try_parse_json("text")
    version = lambda k: F.try_variant_get("spec", f"$.{k}", "string")
    of_path = lambda p: reduce(lambda a, b: a + b, [truthy(F.try_variant_get(p, f"$.{m}", "variant")).cast("long") for m in METHODS])
    counted = F.coalesce(F.aggregate(F.map_values(paths(F.col("spec"))), F.lit(0).cast("long"), lambda n, p: n + F.coalesce(of_path(p), F.lit(0))), F.lit(0).cast("long"))
    yaml = F.regexp_extract("text", YAML_VERSION, 1)
    lines = lambda p: F.regexp_count("text", F.lit(p)).cast("long")
    is_json, is_yaml = F.col("spec").isNotNull(), yaml != ""
    kind = lambda: F.coalesce(*[F.when(truthy(F.try_variant_get("spec", f"$.{k}", "variant")), F.lit(k)) for k in ("openapi", "swagger", "asyncapi")])
    return texts.withColumn("spec", spec).select(
        "page_id", "ord", F.when(is_json, kind()).when(is_yaml, F.regexp_extract("text", "(?m)^(openapi|swagger)[ \t]*:", 1)).alias("type"),
        F.when(is_json, F.coalesce(version("openapi"), version("swagger"), version("asyncapi"))).when(is_yaml, yaml).alias("version"),
        F.when(is_json, counted).when(is_yaml, F.when(lines(YAML_METHOD) > 0, lines(YAML_METHOD)).otherwise(lines(YAML_PATH))).alias("endpoints"),
        (is_json | is_yaml).alias("valid"), F.when(~is_json & ~is_yaml, F.lit("not a description")).alias("error"),
    )
