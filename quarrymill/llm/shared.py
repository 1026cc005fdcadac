"""What several of these operators use: lineage cuts, row numbering, connected components, file paths."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder: the one the cluster names in ``spark.checkpoint.dir``, or that the context was given.

    Only where neither is set and driver and executors are one machine (``local``) a temporary folder is made; elsewhere that is an error.
    """
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="quarrymill-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def shared_folder(spark: SparkSession) -> str:
    """A new folder beside the checkpoints, which driver and executors share."""
    return f"{checkpoint_folder(spark)}/{uuid.uuid4().hex}"


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder that was written by one of these operators and is read no more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from the files.

    A checkpoint keeps the size that was estimated for the plan it cuts. Joined round after round these estimates
    multiply to numbers of millions of digits, so the rows are taken without them.
    """
    spark = df.sparkSession
    checkpoint_folder(spark)
    written = df.checkpoint(eager=True)._jdf
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(written.queryExecution().toRdd(), written.schema(), False), spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole(col: str | Column) -> Column:
    """The text, null read as empty."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


#: Rows of a few numbers each that may be broadcast.
BROADCAST_ROWS = 200_000


def few_broadcast(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, which has rows of a few numbers each, marked for broadcasting if it has no more than ``most``; else it is joined by shuffling."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often it is named."""
    return F.transform(F.array(value), use)[0]


def whole_strings(texts: pa.Array) -> pa.Array:
    """The column as plain strings without nulls."""
    return texts.cast(pa.string()).fill_null("")


def partitions(spark: SparkSession) -> int:
    """As many as the session shuffles into."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(batches: Iterable[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows``, which bounds what is held as Python objects."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    pa.default_memory_pool().release_unused()


def table_of_bits(df: DataFrame, place: str, bits: int) -> np.ndarray:
    """``bits`` bits as bytes, lowest first: 1 at each place (0 to ``bits`` - 1) that occurs. Rows are gathered into bitmaps of 4 KB where they lie; the driver gets at most ``bits``."""
    at = F.col(place) + 1
    parts = df.groupBy(F.bitmap_bucket_number(at).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bitmap"))
    out = np.zeros(-(-bits // 32768) * 4096, np.uint8)
    for r in parts.toLocalIterator():
        begin = (r["bucket"] - 1) * 4096
        out[begin : begin + 4096] = np.frombuffer(r["bitmap"], np.uint8)
    return out


def numbered(df: DataFrame, by: list[str], within: str | None = None) -> DataFrame:
    """Add ``slot``, gapless from 0 in the order ``by``, and per ``within`` (the first of ``by``) if given.

    Rows are dealt by ranges of ``by`` and counted in place; only one row for each
    partition (and value of ``within``, which must have few values) reaches the driver.
    """
    spark = df.sparkSession
    dealt = df.repartitionByRange(partitions(spark), *by).sortWithinPartitions(*by)
    at = F.monotonically_increasing_id()
    marked = cut(dealt.withColumn("_at", at))
    part, own = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    key = F.col(within) if within else F.lit(0)
    marked = marked.select("*", part.alias("_part"), own.alias("_own"), key.alias("_key"))
    seen: dict[object, int] = {}
    shift = []
    for r in sorted(
        marked.groupBy("_key", "_part").agg(F.min("_own").alias("lo"), F.count("*").alias("n")).collect(),
        key=lambda r: (str(r["_key"]), r["_part"]),
    ):
        shift.append((r["_key"], r["_part"], seen.get(r["_key"], 0) - r["lo"]))
        seen[r["_key"]] = seen.get(r["_key"], 0) + r["n"]
    kinds = f"_key {dict(marked.dtypes)['_key']}, _part bigint, _shift bigint"
    shifts = spark.createDataFrame(shift, kinds)
    return (
        marked.join(F.broadcast(shifts), ["_key", "_part"])
        .withColumn("slot", F.col("_own") + F.col("_shift"))
        .drop("_at", "_part", "_own", "_key", "_shift")
    )


def components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """Connected components: a row (node, component) for each node that reaches a smaller one.

    ``component`` is the smallest node reachable; a node that isn't named is its own. Alternates large-star and small-star
    rounds until the edges are stars around the smallest nodes; every round is two grouped
    minima, each written out, and joins with them. So both sides of a join are plain shuffles of
    rows, and the rows of a node with very many edges are split among tasks by Spark's handling
    of skew (``spark.sql.adaptive``); the minima combine before they are shuffled. Null ends and loops are ignored.
    """
    e = (
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"), (F.col(a).isNull() | F.col(b).isNull()).alias("_n"))
        .filter("not _n and u <> v")
        .select("u", "v")
        .distinct()
    )
    e = cut(e)

    def mark(df: DataFrame) -> tuple:
        r = df.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        return tuple(r)

    last = mark(e)
    if not last[0]:
        return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    for _ in range(most_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = cut(both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct())
        low = cut(large.groupBy("u").agg(F.min("v").alias("m")))
        other = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut(low.select("u", F.col("m").alias("v")).unionByName(other).distinct())
        now = mark(e)
        if now == last:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
        last = now
    raise RuntimeError(f"components did not settle within {most_rounds} rounds")

