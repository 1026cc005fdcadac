"""Resuming checks: what is left to do, merging new outcomes into the failures, batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def to_check(all_urls: DataFrame, passed: DataFrame) -> DataFrame:
    """Each url that hasn't passed, once."""
    return all_urls.select("url").distinct().join(passed.select("url").distinct(), "url", "left_anti")


def merge_failures(failures: DataFrame, results: DataFrame) -> DataFrame:
    """Failures after new results (url, status): a pass removes, a failure replaces or adds; status 200 to 399 passes, null fails."""
    new = results.select("url", F.col("status").alias("_new"), F.lit(True).alias("_seen"))
    merged = failures.select("url", "status").join(new, "url", "full_outer")
    passed = F.coalesce(F.col("_new").between(200, 399), F.lit(False))
    return merged.filter(~passed).select("url", F.when(F.col("_seen"), F.col("_new")).otherwise(F.col("status")).alias("status"))


def batches(df: DataFrame, by: str, size: int) -> DataFrame:
    """Number of the batch of ``size`` rows, in order of ``by``, counted in place: rows are dealt by range and only one count per partition reaches the driver."""
    from ..sources.shared import numbered

    return numbered(df, by).select(*df.columns, (F.floor(F.col("slot") / size) + 1).cast("long").alias("batch"))


def redirected(probes: DataFrame) -> DataFrame:
    """(status, destination, retry) of answers (status, location): where a redirect leads, without fragment, and whether the server asked to wait."""
    moved = F.col("status").isin(301, 302, 307, 308)
    return probes.select("status", F.when(moved, F.substring_index("location", "#", 1)).alias("destination"), (F.col("status") == 429).alias("retry"))
