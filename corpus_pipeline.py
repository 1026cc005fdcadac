"""The corpus pipeline: toxicity, near duplicates, decontamination, secrets, byte-level BPE.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and is
written as Parquet before the next one reads it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.llm import bpe, decontaminate, nearcopies, secretscan, toxicity
from quarrymill.llm.queries import tokenizer_file, tokenizer_pattern
from quarrymill.llm.shared import cut, few_broadcast, remove, shared_folder, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Rows that go to Python and back at a time: whole documents, so the session's own bound, made for narrow rows, may be too high.
ROWS = 1_000
#: Pieces of text that a tokenizing task keeps with their ids: a smaller table than op 8's own, as its worker lives on beside those of other stages.
PIECES = 200_000


def bounded(spark: SparkSession) -> None:
    """Lower the session's rows to a batch to ROWS, if they are more."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name))
    if now <= 0 or now > ROWS:
        spark.conf.set(name, str(ROWS))


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the rows whose own clauses score as toxic."""
    bounded(spark)
    model = toxicity.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity.judged(docs.select(COLUMNS), model).filter("predicted = 0").select(COLUMNS)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each component of near copies (5-word shingles, Jaccard 0.8 or more): one with its smallest id, or one without an id if none has any."""
    bounded(spark)
    own = F.xxhash64("doc_id", F.col("doc_id").isNull(), "key")
    near = nearcopies.near_copies(docs).groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("best"))
    best = near.select("best.*").select(own.alias("own"))
    rows = docs.select(F.col("doc_id"), *COLUMNS[1:], F.xxhash64(nearcopies.normal("text")).alias("key"))
    rows = rows.select(*COLUMNS, F.xxhash64(F.col("doc_id").cast("long"), F.col("doc_id").isNull(), "key").alias("own"))
    # Rows that are repeated whole have one key and lie together after the join.
    return rows.join(best, "own").dropDuplicates(["own"]).select(COLUMNS)


def not_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the rows whose text holds a benchmark item, known by the text's XXH64."""
    rows = docs.select(*COLUMNS, F.xxhash64(F.coalesce("text", F.lit(""))).alias("own"))
    found = decontaminate.contaminated(rows.select(F.col("own").alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    leaks = cut(found.select(F.col("doc_id").alias("own")).distinct())
    return rows.join(few_broadcast(leaks), "own", "left_anti").select(COLUMNS)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in the text; ``n_chars`` follows. A null text stays null."""
    scanned = secretscan.scan(docs, keep=["text", "lang", "source", "n_chars"])
    text = secretscan.redacted(F.col("text"), F.col("found"))
    changed = F.size("found") > 0
    return scanned.select("doc_id", text.alias("text"), "lang", "source", F.when(changed, F.length(text).cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every document that is left."""
    bounded(spark)
    return bpe.round_trip(docs, tokenizer_file("byte_bpe_50k.tiktoken"), tokenizer_pattern(), most=PIECES)


STAGES = [("toxicity", not_toxic), ("near_duplicates", one_of_each), ("decontamination", not_contaminated), ("secrets", without_secrets), ("bpe", tokens)]

#: Near copies need components over shingles and the last stage byte-pair merges, which SQL doesn't state; the tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again; what a stage read is removed when the next is written."""
    folder = shared_folder(spark)
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            remove(spark, before)
        before = f"{folder}/{name}"
    return docs
