"""Minimax contiguous partition: the smallest shard capacity at which a greedy cut needs no more shards than allowed.

Equal texts form an atomic group; groups are ordered by their smallest id, then by their text's
hash. Group sizes stay distributed. The driver sees one line for each run of ``run`` groups (its
sum and largest group), decides most probes from those alone and fetches single runs, a bounded
number of rows each, only where a cut falls inside one and the probe hangs on it.

No shard exceeds the smallest capacity. A greedy cut at it would leave the last shards small or
empty where one group is large, so each cut goes to the border nearest an equal share of what is
left, as far as the shards after it still fit.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, numbered, partitions, remove, shared_folder, whole

RUN = 1 << 16


class Runs:
    """Ordered group sizes as runs on the cluster, written in order, so that files and row groups without a run are passed over when it is read."""

    def __init__(self, groups: DataFrame, run: int) -> None:
        self.spark, self.folder = groups.sparkSession, shared_folder(groups.sparkSession)
        order = [F.col("first_id").asc_nulls_first(), F.col("_group").asc()]
        dealt = groups.select("first_id", "_group", "bytes").repartitionByRange(partitions(self.spark), *order).sortWithinPartitions(*order)
        at = F.monotonically_increasing_id()
        own = F.col("_at").bitwiseAND((1 << 33) - 1)
        marked = dealt.withColumn("_at", at).select("*", F.shiftright("_at", 33).cast("int").alias("part"), F.floor(own / run).alias("run"))
        marked.write.parquet(self.folder)
        self.rows = self.spark.read.schema(marked.schema).parquet(self.folder)
        self.runs = sorted(tuple(r) for r in self.rows.groupBy("part", "run").agg(F.sum("bytes"), F.max("bytes")).collect())
        self.sums = [0]
        for r in self.runs:
            self.sums.append(self.sums[-1] + r[2])
        self.total, self.largest = self.sums[-1], max((r[3] for r in self.runs), default=0)
        self.kept: dict[int, tuple[list[int], list]] = {}

    def inside(self, i: int) -> tuple[list[int], list]:
        """Running sums and names (first id, hash) of the groups in run i."""
        if i not in self.kept:
            if len(self.kept) >= 64:
                self.kept.clear()
            part, run = self.runs[i][:2]
            rows = self.rows.filter((F.col("part") == part) & (F.col("run") == run)).select("_at", "bytes", "first_id", "_group").collect()
            at, sums = self.sums[i], []
            rows.sort(key=lambda r: r["_at"])
            for r in rows:
                at += r["bytes"]
                sums.append(at)
            self.kept[i] = sums, [(r["first_id"], bytes(r["_group"])) for r in rows]
        return self.kept[i]

    def done(self) -> None:
        remove(self.spark, self.folder)

    def bounds(self, x: int) -> tuple[int, int]:
        """The running sum at the last group within x, or bounds of it while its run isn't fetched."""
        i = bisect_right(self.sums, x) - 1
        if i >= len(self.runs) or self.sums[i] == x:
            return self.sums[i], self.sums[i]
        if i in self.kept:
            sums = self.kept[i][0]
            k = bisect_right(sums, x)
            s = sums[k - 1] if k else self.sums[i]
            return s, s
        return max(self.sums[i], x - self.runs[i][3] + 1), x

    def exact(self, x: int) -> int:
        i = bisect_right(self.sums, x) - 1
        if i < len(self.runs) and self.sums[i] != x:
            self.inside(i)
        return self.bounds(x)[0]

    def fits(self, capacity: int, shards: int) -> bool:
        """Whether a greedy cut at ``capacity`` takes at most ``shards``."""
        low = high = 0
        for _ in range(shards):
            low, high = self.bounds(low + capacity)[0], self.bounds(high + capacity)[1]
        if low >= self.total:
            return True
        if high < self.total:
            return False
        at = 0
        for _ in range(shards):
            at = self.exact(at + capacity)
        return at >= self.total

    def above(self, x: int) -> int:
        """The least border that is ``x`` or more."""
        low = self.exact(x)
        if low >= x or low >= self.total:
            return low
        i = bisect_right(self.sums, low) - 1
        sums = self.inside(i)[0]
        return sums[bisect_right(sums, low)]

    def cuts(self, capacity: int, shards: int) -> list[int]:
        """The running sums at which each shard but the first begins."""
        # From here on the shards that are left can hold the rest.
        least = [self.total]
        for _ in range(shards - 1):
            least.append(self.above(max(0, least[-1] - capacity)))
        large = self.oversized(shards)
        at, out = 0, []
        for left in range(shards - 1, 0, -1):
            low, high = max(self.above(at + 1), least[left]), self.exact(at + capacity)
            ahead = [g for g in large if g[1] > at]
            if ahead and ahead[0][0] <= at:
                near = ahead[0][1]
            else:
                # The stretch up to the next large group is cut into so many shards as come nearest the share.
                rest, parts = self.total - at - sum(e - b for b, e in ahead), max(1, left + 1 - len(ahead))
                stretch = (ahead[0][0] if ahead else self.total) - at
                n = max(1, (2 * stretch * parts + rest) // (2 * rest)) if ahead else left + 1
                target = at + stretch // n
                below, above = self.exact(target), self.above(target)
                near = below if target - below <= above - target else above
            at = min(max(near, low), high)
            out.append(at)
        return out

    def oversized(self, shards: int) -> list[tuple[int, int]]:
        """Begin and end of the groups, fewer than ``shards``, that are larger than an equal share of the others."""
        found: list[tuple[int, int]] = []
        while True:
            share = (self.total - sum(e - b for b, e in found)) / max(1, shards - len(found))
            now = []
            for i, r in enumerate(self.runs):
                if r[3] > share:
                    begin = self.sums[i]
                    for end in self.inside(i)[0]:
                        if end - begin > share:
                            now.append((begin, end))
                        begin = end
            if len(now) <= len(found) or len(now) >= shards:
                return now if len(now) < shards else found
            found = now

    def names(self, cuts: list[int]) -> list[tuple]:
        """The first group of each shard that begins before the end."""
        out = []
        for at in cuts:
            if at < self.total:
                i = bisect_right(self.sums, at) - 1
                sums, names = self.inside(i)
                out.append(names[bisect_right(sums, at)])
        return out


def minimax_capacity(runs: Runs, shards: int) -> int:
    low, high = max(runs.largest, -(-runs.total // shards)), max(runs.total, 1)
    high = min(high, low + runs.largest)
    while not runs.fits(high, shards):
        high *= 2
    while low < high:
        mid = (low + high) // 2
        if runs.fits(mid, shards):
            high = mid
        else:
            low = mid + 1
    return low


def shard(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 8, run: int = RUN) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard), a row for each row of ``docs``.

    Size is the text's UTF-8 bytes (null: none) plus 1; null and empty texts are one group.
    Groups are ordered by smallest id, those without one first, and then by hash. A group larger than an equal share has a shard of its own size.
    An empty table gives an empty result, shards beyond the number of groups are empty. Repeated rows each get a slot.
    """
    text = F.encode(whole(text_col), "UTF-8")
    narrow = cut(docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("_group")))
    groups = cut(narrow.groupBy("_group").agg(F.min("doc_id").alias("first_id"), F.sum("size").alias("bytes")))
    runs = Runs(groups, run)
    starts = runs.names(runs.cuts(minimax_capacity(runs, shards), shards))
    runs.done()
    number = F.lit(0)
    for first, group in starts:
        later = F.col("_group") >= F.lit(group)
        later = F.col("first_id").isNotNull() | later if first is None else F.coalesce((F.col("first_id") > F.lit(first)) | (F.col("first_id") == F.lit(first)) & later, F.lit(False))
        number = number + later.cast("int")
    placed = narrow.join(groups.select("_group", number.alias("shard")), "_group").select("doc_id", "size", "text_crc32", "shard")
    return numbered(placed, ["shard", "doc_id"], "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
