"""Near copies by word shingles: all pairs whose Jaccard similarity is 0.8 or more, none missed.

SimHash comes first: op 7's covering masks, over fingerprints of the same shingles and in parts so that they
reach further, bring texts together, whose links are then confirmed shingle by shingle. This joins nearly every
group by a few links for each text. A fingerprint can't promise a similarity, so an exact way follows
for the rest: prefixes are joined for pairs of texts that don't hang together yet.

Shingles have one order over the whole corpus. Two sets that share four fifths must share a
shingle among the first fifth (and one) of each, and k shingles if these prefixes are longer by
k - 1. So only prefixes are joined; sizes, places and the number shared rule out most pairs, the
rest are compared shingle by shingle. Any order is right: a
sample only tells which shingles are common, and these are put last to keep buckets small.

Pairs are rows only where few texts share a shingle. The texts of a larger bucket are dealt into tiles, of
which every two meet in a task with their shingles: it compares all and makes a spanning forest of the links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import simhash
from .shared import components, cut, few_broadcast, partitions, slices, whole

WIDTH, SHARED, OF = 5, 4, 5
#: A prefix is longer by one shingle in MORE, and that many more must be shared within it.
MORE = 32
#: One text in SAMPLED is counted for the order; shingles that MANY of these hold are common, and at most COMMON are told apart.
SAMPLED, MANY, COMMON = 16, 3, 100_000
#: Leaves of a star are dealt into so many groups; pairs of texts of PART shingles more are dealt into one part more.
LEAVES, PART = 1_024, 1_024
#: Buckets of more than MEET texts are compared where they meet, in tiles of TILE texts and HELD shingles at most.
MEET, TILE, HELD = 256, 1_024, 1 << 19
#: Fingerprints that differ by RADIUS bits or fewer are brought together, by masks over PARTS parts of them; of those a text meets, the STARS nearest and the STARS least are compared with it.
RADIUS, PARTS, STARS = 9, 2, 3
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normal(text_col: str) -> Column:
    """Words with one space between; A-Z are lower-cased, words end at ASCII white space."""
    return F.trim(F.regexp_replace(F.translate(whole(text_col), UPPER, LOWER), "[ \\t\\n\\x0B\\f\\r]+", " "))


def shingles(norm: str, width: int = WIDTH) -> set[str]:
    """All runs of ``width`` words; a shorter text is one shingle of its own."""
    words = norm.split(" ")
    return {" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))}


def hashes(norm: str, width: int = WIDTH) -> np.ndarray:
    """Distinct XXH64 of the shingles, sorted."""
    joined = norm.encode("utf-8", "surrogatepass")
    words = joined.split(b" ")
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(joined)], np.uint64).view(np.int64)
    ends = np.cumsum([len(w) + 1 for w in words])
    ends_, starts_ = (ends[width - 1 :] - 1).tolist(), [0, *ends[:-width].tolist()]
    return np.unique(np.array([xxhash.xxh64_intdigest(joined[a:b]) for a, b in zip(starts_, ends_, strict=True)], np.uint64).view(np.int64))


def common(keyed: DataFrame, width: int, sampled: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that many sampled texts hold, sorted, and how many do."""

    def run(batches):
        for batch in slices(batches):
            for t in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(hashes(t, width))], names=["h"])

    sample = keyed.filter(F.pmod("key", F.lit(sampled)) == 0).select("norm")
    found = sample.mapInArrow(run, "h long").groupBy("h").agg(F.count("*").alias("n")).filter(F.col("n") >= MANY).orderBy(F.desc("n"), "h").limit(COMMON).collect()
    found.sort(key=lambda r: r["h"])
    return np.array([r["h"] for r in found], np.int64), np.array([r["n"] for r in found], np.int64)


def prefixes(keyed: DataFrame, order: tuple[np.ndarray, np.ndarray], width: int = WIDTH) -> DataFrame:
    """(key, size, firsts, fp): the first shingles of each text in the common order, of which any near copy shares one, and the SimHash of all its distinct ones."""
    sent = keyed.sparkSession.sparkContext.broadcast(order)

    def run(batches):
        known, counts = sent.value
        for batch in slices(batches):
            sizes, firsts, fps = [], [], []
            for t in batch.column(1).to_pylist():
                h = hashes(t, width)
                fps.append(simhash.majority(h.view(np.uint64)))
                if len(known):
                    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                    h = h[np.argsort(np.where(known[at] == h, counts[at], 0), kind="stable")]
                n = len(h)
                sizes.append(n)
                firsts.append(h[: n - (SHARED * n + OF - 1) // OF + 1 + n // MORE])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int32()), pa.array(firsts, pa.list_(pa.int64())), pa.array(np.array(fps, np.uint64).view(np.int64))], names=["key", "size", "firsts", "fp"])

    return keyed.select("key", "norm").mapInArrow(run, "key long, size int, firsts array<long>, fp long")


def covered(first: DataFrame) -> DataFrame:
    """(a, b, at): pairs of texts whose fingerprints differ by RADIUS bits or fewer, at most 2 * STARS + 1 for a text; ``at`` names the text with the lesser fingerprint and some of those linked to it.

    They connect all such texts of small groups; in large ones, where a text meets many, what they leave apart is found by `candidates`.
    """
    one = cut(first.groupBy("fp").agg(F.min(F.struct("key", "size")).alias("rep")))
    # Fingerprints stand for themselves, as their masked parts do, so that little is shuffled.
    pairs = simhash.links(one.select("fp", F.col("fp").alias("rep")), RADIUS, parts=PARTS, sampled=SAMPLED).distinct()
    leaf, apart = Window.partitionBy("a"), F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    pairs = pairs.select("a", "b", F.row_number().over(leaf.orderBy(apart, "b")).alias("near"), F.row_number().over(leaf.orderBy("b")).alias("low")).filter(f"near <= {STARS} or low <= {STARS}")
    ends = [one.select(F.col("fp").alias(x), F.col("rep").alias(f"{x}_")) for x in ("a", "b")]
    pairs = pairs.join(ends[0], "a").join(ends[1], "b").select(F.col("a_").alias("leaf"), F.col("b_").alias("star"))
    equal = first.select("fp", F.struct("key", "size").alias("leaf")).join(one, "fp").select("leaf", F.col("rep").alias("star"))
    alike = f"leaf.key <> star.key and {OF} * least(leaf.size, star.size) >= {SHARED} * greatest(leaf.size, star.size)"
    at = F.xxhash64("star.key", F.pmod(F.xxhash64("leaf.key"), F.lit(LEAVES)))
    return pairs.unionByName(equal).filter(alike).select(F.least("leaf.key", "star.key").alias("a"), F.greatest("leaf.key", "star.key").alias("b"), at.alias("at"))


def met(keys: np.ndarray, sizes: np.ndarray, places: np.ndarray, named: np.ndarray, blocks: np.ndarray | None = None, tile: int = 512) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(a, b, more) of the texts in a bucket, in order of size, that may be near copies by sizes and places alone; of two components, and with ``blocks`` of two blocks."""
    n = len(keys)
    rest = sizes - places
    for x in range(0, n, tile):
        # Sizes rise, so partners end where a size is too large for the tile's largest.
        end = int(np.searchsorted(sizes, OF * int(sizes[min(n, x + tile) - 1]) // SHARED, "right"))
        for y in range(x, end, tile):
            i, j = slice(x, x + tile), slice(y, min(y + tile, end))
            may = named[i, None] != named[None, j]
            if not may.any():
                continue
            n_, m_ = sizes[i, None], sizes[None, j]
            more = np.minimum(n_, m_) // MORE
            # The shingle shared as number k of the order has k - 1 before it and the rest of both texts after it, which bounds the overlap.
            may &= (OF * np.minimum(n_, m_) >= SHARED * np.maximum(n_, m_)) & ((SHARED + OF) * (np.minimum(rest[i, None], rest[None, j]) + more) >= SHARED * (n_ + m_))
            if blocks is not None:
                may &= blocks[i, None] != blocks[None, j]
            if x == y:
                may = np.triu(may, 1)
            p, q = np.nonzero(may)
            if len(p):
                a, b = keys[i][p], keys[j][q]
                yield np.minimum(a, b), np.maximum(a, b), more[p, q]


def meeting(n: int, h: int, deal: int) -> int:
    """A number for a bucket of ``n`` texts; the larger the bucket, the smaller it is, so that pairs of one family agree on few."""
    return ((1 << 20) - 1 - min(n, (1 << 20) - 1) << 43) | (((h * 0x9E3779B97F4A7C15) ^ (deal * 0xFF51AFD7ED558CCD)) & (1 << 64) - 1) >> 21


def candidates(first: DataFrame, hot: list[tuple[int, int]], meet: int = MEET) -> DataFrame:
    """(a, b, at): pairs of keys of two components that share enough prefix shingles and, by their sizes and places, may be near copies; ``at`` names a part of the largest bucket that they share.

    Each prefix shingle is shuffled once. A shingle in ``hot`` (shingle, blocks) has its bucket dealt
    into blocks, and every two blocks meet in a task of their own. A bucket of more than ``meet`` texts makes no
    pairs but rows without ``b``: those ``a`` of two tiles that any such pair is of, all to be compared; ``at`` names the two tiles.
    Of a near copy's first ``more`` + 1 shared shingles one has such a bucket, and it is compared there, or all are in smaller ones and counted.
    """
    spark = first.sparkSession
    rows = first.select("key", "size", "named", F.posexplode("firsts").alias("at", "h"))
    place = F.shiftleft(F.col("size").cast("long"), 32).bitwiseOR(F.col("at").cast("long")).alias("place")
    if hot:
        blocks = F.broadcast(spark.createDataFrame(hot, "h long, blocks int"))
        marked = rows.join(blocks, "h", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        own = F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")
        marked = marked.select("h", "key", "named", place, own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("with"))
        # Two rows of one block meet in the task of that block alone; own tells which block a row is of.
        deal = F.shiftleft(F.least("own", "with").cast("long"), 32).bitwiseOR(F.greatest("own", "with").cast("long"))
        dealt = marked.select("h", deal.alias("deal"), "place", "key", "named", F.col("own").cast("smallint").alias("own"))
    else:
        dealt = rows.select("h", F.lit(0).cast("long").alias("deal"), place, "key", "named", F.lit(0).cast("smallint").alias("own"))

    def run(batches):
        held: list[list[np.ndarray]] = []
        last = None

        def pairs():
            place, key, named, own = (np.concatenate([h[k] for h in held]) for k in range(4))
            held.clear()
            if (named == named[0]).all():
                return
            apart = last[1] >> 32 != last[1] & 0xFFFFFFFF
            sizes, places = (place >> 32).astype(np.int32), (place & 0xFFFFFFFF).astype(np.int32)
            if len(key) > meet:
                tile = max(1, min(TILE, HELD // int(sizes[-1])))
                for k, (a, b, _) in enumerate(met(key, sizes, places, named, own if apart else None, tile)):
                    both = np.unique(np.concatenate([a, b]))
                    at = np.full(len(both), xxhash.xxh64_intdigest(f"{last} {k}"), np.uint64).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(both), pa.nulls(len(both), pa.int64()), pa.array(np.zeros(len(both), np.int64)), pa.array(at)], names=["a", "b", "more", "at"])
                return
            at = meeting(len(key), *last)
            for a, b, more in met(key, sizes, places, named, own if apart else None):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(more.astype(np.int64)), pa.array(np.full(len(a), at, np.int64))], names=["a", "b", "more", "at"])

        for batch in batches:
            if not batch.num_rows:
                continue
            h, deal, place, key, named, own = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            change = np.flatnonzero((h[1:] != h[:-1]) | (deal[1:] != deal[:-1])) + 1
            starts, ends = np.concatenate([[0], change]), np.concatenate([change, [len(h)]])
            if held and (h[0], deal[0]) != last:
                yield from pairs()
            # Buckets of one row, which most are, meet nobody; the last one may go on in the next batch.
            many = np.flatnonzero(ends - starts > 1).tolist()
            if held and 0 not in many:
                many.insert(0, 0)
            if not many or many[-1] != len(starts) - 1:
                many.append(len(starts) - 1)
            for k in many:
                s, e = int(starts[k]), int(ends[k])
                now = (int(h[s]), int(deal[s]))
                if held and now != last:
                    yield from pairs()
                last = now
                held.append([place[s:e], key[s:e], named[s:e], own[s:e]])
        if held:
            yield from pairs()

    n = partitions(spark)
    found = dealt.repartition(n, "h", "deal").sortWithinPartitions("h", "deal", "place").mapInArrow(run, "a long, b long, more long, at long")
    alone = F.col("b").isNull()
    pairs = found.groupBy("a", "b", "more", F.when(alone, F.col("at")).alias("tiles")).agg(F.count("*").alias("k"), F.min("at").alias("at")).filter("b is null or k > more")
    # The larger the texts (more is their size by MORE), the fewer of a bucket meet in one part.
    parts = F.lit(1) + F.call_function("div", F.col("more"), F.lit(PART // MORE))
    part = F.xxhash64("at", F.pmod(F.xxhash64("a"), parts), F.pmod(F.xxhash64("b"), parts))
    return pairs.select("a", "b", F.when(alone, F.col("at")).otherwise(part).alias("at"))


def forest(sets: list[np.ndarray]) -> Iterator[tuple[int, int]]:
    """Pairs of places whose sets have a Jaccard similarity of 0.8 or more: enough of them to connect all that hang together."""
    sizes = np.array([len(s) for s in sets])
    ends = np.cumsum(sizes)
    starts, comp = ends - sizes, np.arange(len(sets))
    held, word = np.unique(np.concatenate(sets), return_inverse=True)
    mark = np.zeros(len(held), np.uint8)
    for i in range(len(sets) - 1):
        n, m = sizes[i], sizes[i + 1 :]
        j = i + 1 + np.flatnonzero((comp[i + 1 :] != comp[i]) & (OF * np.minimum(n, m) >= SHARED * np.maximum(n, m)))
        if not len(j):
            continue
        own = word[starts[i] : ends[i]]
        mark[own] = 1
        upto = np.cumsum(sizes[j])
        begin = upto - sizes[j]
        shared = np.add.reduceat(mark[word[np.arange(upto[-1]) + np.repeat(starts[j] - begin, sizes[j])]], begin, dtype=np.int64)
        mark[own] = 0
        j = j[OF * shared >= SHARED * (n + sizes[j] - shared)]
        joined, once = np.unique(comp[j], return_index=True)
        yield from ((i, k) for k in j[once].tolist())
        comp[np.isin(comp, joined)] = comp[i]


def compared(pairs: DataFrame, keyed: DataFrame, width: int) -> DataFrame:
    """Those of the pairs (a, b, at) whose texts have a Jaccard similarity of 0.8 or more, counted over all their shingles.

    Pairs with one ``at`` are compared in one task, which gets each of their texts' shingles once and not once for each pair.
    Of the rows without ``b`` all with one ``at`` are compared with each other; a spanning forest of the links is told.
    """

    def sets(batches):
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([hashes(t, width).tobytes() for t in batch.column(1).to_pylist()], pa.binary())], names=["key", "set"])

    def run(batches):
        held: dict[int, np.ndarray] = {}
        group = (False, None)

        def linked():
            keys = list(held) if group[0] else []
            return [(keys[i], keys[j]) for i, j in forest(list(held.values()))] if len(keys) > 1 else []

        def out(found):
            return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

        for batch in slices(batches, 1024):
            found: list[tuple[int, int]] = []
            for every, at, key, other, own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (every, at) != group:
                    found += linked()
                    group, held = (every, at), {}
                if own is not None:
                    held[key] = np.frombuffer(own, np.int64)
                    continue
                x, y = held[key], held[other]
                # Both are sorted and without repeats, so what stands twice in their union is shared.
                both = np.sort(np.concatenate([x, y]), kind="stable")
                shared = int((both[1:] == both[:-1]).sum())
                if OF * shared >= SHARED * (len(both) - shared):
                    found.append((key, other))
            yield out(found)
        yield out(linked())

    rows = cut(pairs)
    pairs = rows.filter("b is not null")
    ends = pairs.select(F.lit(False).alias("every"), "at", F.explode(F.array("a", "b")).alias("key")).distinct()
    members = cut(ends.unionByName(rows.filter("b is null").select(F.lit(True).alias("every"), "at", F.col("a").alias("key"))))
    ends = cut(members.select("key").distinct())
    texts = keyed.join(few_broadcast(ends), "key", "left_semi").select("key", "norm").mapInArrow(sets, "key long, set binary")
    texts = cut(texts.groupBy("key").agg(F.min("set").alias("set")))
    none = F.lit(None).cast("long").alias("other")
    rows = members.join(texts, "key").select("every", "at", "key", none, "set")
    rows = rows.unionByName(pairs.select(F.lit(False).alias("every"), "at", F.col("a").alias("key"), F.col("b").alias("other"), F.lit(None).cast("binary").alias("set")))
    dealt = rows.repartition(partitions(keyed.sparkSession), "every", "at").sortWithinPartitions("every", "at", F.col("other").isNotNull(), "key")
    return cut(dealt.mapInArrow(run, "a long, b long"))


def links(keyed: DataFrame, width: int = WIDTH, block: int = 2048, sampled: int = SAMPLED, meet: int = MEET) -> DataFrame:
    """(a, b): keys of distinct texts whose shingles have a Jaccard similarity of 0.8 or more: enough of these pairs to connect all that hang together.

    First the pairs of `covered` are compared, then every candidate pair of texts that don't hang together by these.
    """
    order = common(keyed, width, sampled)
    hot = [(int(h), -(-int(n) * sampled // block)) for h, n in zip(*order, strict=True) if n * sampled > block]
    first = cut(prefixes(keyed, order, width).dropDuplicates(["key"]))
    found = compared(covered(first), keyed, width)
    named = few_broadcast(components(found).select(F.col("node").alias("key"), F.col("component").alias("named")))
    left = candidates(first.join(named, "key", "left").withColumn("named", F.coalesce("named", "key")), hot, meet)
    return cut(found.unionByName(compared(left, keyed, width)))


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, block: int = 2048, sampled: int = SAMPLED, meet: int = MEET) -> DataFrame:
    """(doc_id, key, component, component_id), a row for each row of ``docs``; ``component_id`` is the smallest id among the near copies reachable, null if none has an id.

    ``key`` is the XXH64 of the words, ``component`` the smallest key reachable; texts with equal words are one. Null and empty texts are copies of each other.
    """
    keyed = docs.select(F.col(id_col).cast("long").alias("doc_id"), normal(text_col).alias("norm")).withColumn("key", F.xxhash64("norm"))
    named = components(links(keyed, width, block, sampled, meet)).select(F.col("node").alias("key"), "component")
    marked = cut(keyed.select("doc_id", "key").join(named, "key", "left").select("doc_id", "key", F.coalesce("component", "key").alias("component")))
    least = marked.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return marked.join(least, "component").select("doc_id", "key", "component", "component_id")
