"""Search, list and get as table functions for SQL.

``best_docs`` takes a table and a query and keeps each partition's best rows, at most ``MOST``, so what leaves a partition is
bounded; it asks for its partitions itself, by the column ``part``. ``excerpt`` is joined laterally to a row's text.
``get_doc`` and ``list_docs`` are SQL table functions over the view, planned with the query that calls them.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, PartitioningColumn

#: Rows that a search gives at most, and characters of an excerpt and before its word.
MOST, EXCERPT, BEFORE = 20, 200, 60


class BestDocs:
    """``best_docs(TABLE(docs), query, limit)``: (doc_id, id, path, title, content, score) of each partition's best documents."""

    @staticmethod
    def analyze(docs: AnalyzeArgument, query: AnalyzeArgument, limit: AnalyzeArgument) -> AnalyzeResult:
        if not docs.isTable:
            raise ValueError("the first argument is a table")
        if not query.isConstantExpression or not (query.value or "").strip():
            raise ValueError("Query cannot be empty.")
        missing = {"part", "doc_id", "id", "path", "title", "description", "content", "tags"} - set(docs.dataType.names)
        if missing:
            raise ValueError(f"the table lacks {', '.join(sorted(missing))}")
        schema = StructType().add("doc_id", LongType()).add("id", StringType()).add("path", StringType()).add("title", StringType()).add("content", StringType()).add("score", LongType())
        return AnalyzeResult(schema=schema, partitionBy=[PartitioningColumn("part")])

    def __init__(self):
        self.best: list[tuple] = []
        self.most = MOST

    def eval(self, row: Row, query: str, limit: int):
        self.most = min(limit, MOST)
        title, content = row["title"] or "", row["content"] or ""
        fields = ((title.lower(), 3), (" ".join(t for t in row["tags"] or [] if t is not None).lower(), 2), (f"{title} {row['description'] or ''} {content}".lower(), 1))
        score = sum(text.count(word) * weight for word in query.lower().split() for text, weight in fields)
        if score > 0:
            one = (score, -row["doc_id"], row["id"], row["path"], title, content)
            if len(self.best) < self.most:
                heapq.heappush(self.best, one)
            elif self.best and one[:2] > self.best[0][:2]:
                heapq.heapreplace(self.best, one)

    def terminate(self):
        for score, before, own, path, title, content in self.best:
            yield -before, own, path, title, content, score


class Excerpt:
    """``excerpt(content, query)``: the text around the query's first word."""

    def eval(self, content: str, query: str):
        at = max((content or "").lower().find(query.lower().split()[0]) - BEFORE, 0)
        yield (" ".join(p for p in (content or "")[at : at + EXCERPT].split("\n") if p).strip(" "),)


def register(spark: SparkSession, docs: DataFrame, view: str = "quarrymill_docs") -> None:
    """Name the functions in the session, over ``docs`` as ``search.index`` gives them. Documents are dealt into as many parts as the session shuffles into."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(parts)).cast("int")).createOrReplaceTempView(view)
    spark.udtf.register("best_docs", F.udtf(BestDocs))
    spark.udtf.register("excerpt", F.udtf(Excerpt, returnType="snippet string"))
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION list_docs(wanted STRING) RETURNS TABLE (language STRING, docs BIGINT, first_path STRING)
        RETURN SELECT language, count(*), min(path) FROM {view} WHERE wanted IS NULL OR language = wanted GROUP BY language""")
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION get_doc(wanted STRING) RETURNS TABLE (doc_id BIGINT, title STRING)
        RETURN SELECT d.doc_id, d.title FROM (SELECT min(struct(doc_id, title)) AS d FROM (SELECT explode(array(path, id, url, concat('/', url))) AS key, doc_id, title FROM {view}) WHERE key = wanted) WHERE d IS NOT NULL""")


def search_sql(query: str, limit: int = 5, threshold: float = 0.0, view: str = "quarrymill_docs") -> str:
    """SQL that calls the functions: the best of all partitions' best, with their excerpts, above ``threshold`` of the best score."""
    asked = "'" + query.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return f"""SELECT rank, id, path, title, score, snippet FROM (
        SELECT CAST(row_number() OVER (ORDER BY score DESC, doc_id) AS BIGINT) AS rank, max(score) OVER () AS best, b.* FROM (
            SELECT * FROM best_docs(TABLE({view}), {asked}, {min(limit, MOST)}) ORDER BY score DESC, doc_id LIMIT {min(limit, MOST)}) b) r,
        LATERAL excerpt(r.content, {asked}) WHERE score / best >= {threshold}"""
