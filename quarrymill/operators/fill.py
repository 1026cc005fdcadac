"""Values carried forward in document order: each row gets the last value at or before it, however many rows a key has."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.shared import cut


def carried(df: DataFrame, key: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """``df`` with ``name``: the last ``value`` that isn't null among the rows of the same ``key`` up to this one in ``order``; null before the first.

    Rows are dealt by ranges of key and order, so a key with most rows is spread over many tasks. Each part fills what it can
    by itself and leaves one row for each key in it, its last value; these few rows are carried from part to part.
    Null keys are a key of their own; rows with equal order come in any order.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = cut(df.repartitionByRange(n, *key, *order).sortWithinPartitions(*key, *order).withColumn("_at", F.monotonically_increasing_id()))
    parts = placed.withColumn("_part", F.shiftright("_at", 33))
    own = W.partitionBy("_part", *key).orderBy("_at").rowsBetween(W.unboundedPreceding, 0)
    filled = parts.withColumn("_own", F.last(value, True).over(own))
    ends = parts.groupBy("_part", *key).agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.col("_at"))).alias("_last"))
    before = W.partitionBy(*key).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    carry = cut(ends.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)], F.col("_part").alias("_p"), F.last("_last", True).over(before).alias("_carry")).filter("_carry is not null"))
    same = F.col("_part") == F.col("_p")
    for i, k in enumerate(key):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return filled.join(carry, same, "left").select(*df.columns, F.coalesce("_own", "_carry").alias(name))
