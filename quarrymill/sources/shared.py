"""Lineage cuts and gapless numbering for operators that work in rounds."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoints(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``, or that the context was given. One is made only where driver and executors are one machine."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="quarrymill-"))
    return sc._jsc.sc().getCheckpointDir().get()


def folder(spark: SparkSession) -> str:
    """A new folder beside the checkpoints, as a URI."""
    own = f"{checkpoints(spark)}/{uuid.uuid4().hex}"
    return own if "://" in own else "file://" + own.removeprefix("file:")


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint to the folder that the cluster names; a temporary one is made only on one machine."""
    checkpoints(df.sparkSession)
    return df.checkpoint(eager=True)


def numbered(df: DataFrame, *by: str) -> DataFrame:
    """Add ``slot``, gapless from 0 in order of ``by``: rows are dealt by range, and one count for each partition reaches the driver."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    marked = cut(df.repartitionByRange(n, *by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id()))
    marked = marked.withColumn("_part", F.shiftright("_at", 33)).withColumn("_own", F.col("_at").bitwiseAND((1 << 33) - 1))
    at, shifts = 0, []
    for r in sorted(marked.groupBy("_part").agg(F.count("*").alias("n")).collect()):
        shifts.append((r["_part"], at))
        at += r["n"]
    joined = marked.join(F.broadcast(spark.createDataFrame(shifts, "_part long, _shift long")), "_part")
    return joined.withColumn("slot", F.col("_own") + F.col("_shift")).drop("_at", "_part", "_own", "_shift")
