"""Keeping results up to date as pages and probe results arrive: micro-batches over the same operators as in batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import features, resume


def analyzed_stream(pages: DataFrame, columns: list[str]) -> DataFrame:
    """Features of pages as they come; stateless, so it runs on a stream as it does on a table."""
    return features.analyze(pages).select(*columns)


def hourly_counts(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Events by hour and type with a watermark: rows later than ``late`` are dropped, state older than that is let go."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("hour"), "event_type", "n")


def follow_checks(results: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Merge probe results (url, status) into the failures under ``folder``: a version per micro-batch, so a batch that is run again replaces only its own.

    The reader takes the newest version; nothing is overwritten while it is read.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        last = failures(spark, folder, before=number)
        latest = batch.groupBy("url").agg(F.max_by("status", "seq").alias("status")) if "seq" in batch.columns else batch.groupBy("url").agg(F.max("status").alias("status"))
        resume.merge_failures(last, latest).write.mode("overwrite").parquet(f"{folder}/v{number:012d}")

    return results.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def failures(spark: SparkSession, folder: str, before: int | None = None) -> DataFrame:
    """The newest version of the failures, or the newest before a micro-batch."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    versions = sorted(s.getPath().getName() for s in store.listStatus(path)) if store.exists(path) else []
    versions = [v for v in versions if v.startswith("v") and (before is None or int(v[1:]) < before)]
    if not versions:
        return spark.createDataFrame([], "url string, status long")
    return spark.read.parquet(f"{folder}/{versions[-1]}")
