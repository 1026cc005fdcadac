"""Keyword search over documents by term frequency, listing, and lookup by several keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import occurrences


def index(documents: DataFrame) -> DataFrame:
    """(id, path, url, title, description, content, tags, language) from (doc_id, text, lang, source): the title is the first line."""
    key = F.col("doc_id").cast("string")
    return documents.select(
        key.alias("id"), F.concat(F.lit("docs/"), key).alias("path"), F.concat(F.lit("/docs/"), key).alias("url"), F.substring_index("text", "\n", 1).alias("title"), F.lit("").alias("description"),
        F.col("text").alias("content"), F.array("lang", "source").alias("tags"), F.col("lang").alias("language"), F.lit(None).cast("string").alias("version"), "doc_id",
    )


def scored(docs: DataFrame, query: str, language: str | None = None, version: str | None = None) -> DataFrame:
    """Documents with a positive score: each word counts three times in the title, twice in the tags, once anywhere. Filters come first and reach the scan."""
    if language:
        docs = docs.filter(F.col("language") == language)
    if version:
        docs = docs.filter(F.col("version") == version)
    title, tags = F.lower(F.coalesce("title", F.lit(""))), F.lower(F.array_join("tags", " "))
    body = F.lower(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("description", F.lit("")), F.coalesce("content", F.lit(""))))
    score = F.lit(0).cast("long")
    for word in query.lower().split():
        score = score + occurrences(title, word) * 3 + occurrences(tags, word) * 2 + occurrences(body, word)
    return docs.withColumn("score", score).filter("score > 0")


def search(docs: DataFrame, query: str, limit: int = 5, threshold: float = 0.0, language: str | None = None, version: str | None = None) -> DataFrame:
    """The best documents, at most 20: (rank, id, path, title, score, snippet). Scores below ``threshold`` of the best are left out.

    Sorting keeps only the best rows of each partition, so the corpus isn't shuffled; the threshold is applied to those.
    """
    if not query.strip():
        raise ValueError("Query cannot be empty.")
    top = scored(docs, query, language, version).orderBy(F.desc("score"), "doc_id").limit(min(limit, 20))
    order = W.orderBy(F.desc("score"), "doc_id")
    word = query.lower().split()[0]
    at = F.greatest(F.instr(F.lower("content"), word) - 61, F.lit(0))
    snippet = F.trim(F.regexp_replace(F.substring("content", at + 1, F.lit(200)), "\n+", " "))
    kept = top.withColumn("rank", F.row_number().over(order).cast("long")).withColumn("_best", F.max("score").over(W.partitionBy()))
    return kept.filter(F.col("score") / F.col("_best") >= threshold).select("rank", "id", "path", "title", "score", snippet.alias("snippet"))


def lookup(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """For each ``wanted`` (key): the first document whose path, id, url or url without slash it is. Four equi-joins instead of one on OR."""
    keys = docs.select("doc_id", "title", F.explode(F.array(F.struct("path"), F.struct(F.col("id").alias("path")), F.struct(F.col("url").alias("path")), F.struct(F.concat(F.lit("/"), "url").alias("path")))).alias("_k"))
    keys = keys.select("doc_id", "title", F.col("_k.path").alias("key"))
    found = wanted.join(keys, "key").groupBy("key").agg(F.min(F.struct("doc_id", "title")).alias("d"))
    return wanted.join(found, "key", "left").select("key", "d.doc_id", "d.title")
