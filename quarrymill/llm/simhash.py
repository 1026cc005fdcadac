"""SimHash near-duplicates by covering locality-sensitive hashing: no pair within the radius is missed.

Each of the 64 positions gets a vector of radius + 1 bits. For each of the 2^(radius+1) - 1
non-zero vectors there is a table, whose mask keeps the positions at an odd product with it.
Any ``radius`` differing positions span too little to meet every non-zero vector, so in some
table all of them are masked out and the two fingerprints fall into one bucket.
A larger radius is covered in parts: of two parts one has at most half of the differing positions.

Equal fingerprints are first made one. Buckets of many times ``block`` fingerprints are divided by a
second family of masks, which misses no pair either. What still has more than ``block`` is cut
into blocks, and every two blocks meet in a task of their own: whole, and bounded in memory.
Of the pairs found a task keeps a spanning forest, as only who reaches whom is asked for.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import components, cut, slices, whole

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def fingerprint(text: str, width: int = 3, seed: int = 42) -> int:
    """Bits set in over half the XXH64 of the word shingles; A-Z are lower-cased, words end at ASCII white space."""
    words = text.encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return 0
    hashed = xxhash.xxh64_intdigest
    if len(words) <= width:
        return hashed(b" ".join(words), seed)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    ends_, starts_ = (ends[width - 1 :] - 1).tolist(), [0, *ends[:-width].tolist()]
    return majority(np.array([hashed(joined[a:b], seed) for a, b in zip(starts_, ends_, strict=True)], np.uint64))


def majority(values: np.ndarray) -> int:
    """Bits set in over half of the 64-bit ``values``."""
    total = np.zeros(64, np.int64)
    for at in range(0, len(values), 1 << 16):
        part = values[at : at + (1 << 16)]
        total += np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > len(values)).tobytes(), "big")


def masks(radius: int = 3, bits: int = 64, turn: int = 0) -> list[int]:
    """The structured masks; positions go round the non-zero vectors, so every table keeps about half of them. With ``turn`` each round begins elsewhere, which gives another family."""
    n = (2 << radius) - 1
    vectors = [1 + (i + turn * (i // n)) % n for i in range(bits)]
    return [sum(1 << i for i in range(bits) if (vectors[i] & v).bit_count() % 2) for v in range(1, 2 << radius)]


def covering(radius: int = 3, parts: int = 1, turn: int = 0) -> list[int]:
    """Masks of 64 positions cut into ``parts``: fingerprints within ``radius`` differ in some part by at most its share, which the masks of that part cover."""
    bits = 64 // parts
    return [m << bits * p for p in range(parts) for m in masks(radius // parts, bits, turn)]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(doc_id, fp): fp holds the 64 bits as a signed long."""

    def run(batches):
        for batch in slices(batches):
            values = np.array([fingerprint(t, width) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values.view(np.int64), pa.int64())], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), whole(text_col).alias("text")).mapInArrow(run, "doc_id long, fp long")


def forest(values: np.ndarray, radius: int, tile: int = 1024) -> list[tuple[int, int]]:
    """Pairs of places that join, within ``radius`` steps at a time, all that hang together."""
    n = len(values)
    parent = list(range(n))

    def top(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    out = []
    for y in range(0, n, tile):
        for x in range(0, y + 1, tile):
            near = np.bitwise_count(values[y : y + tile, None] ^ values[None, x : x + tile]) <= radius
            if x == y:
                near = np.tril(near, -1)
            a, b = np.nonzero(near)
            if not len(a):
                continue
            tops = np.array([top(i) for i in range(max(n, 1))]) if len(a) > 64 else None
            if tops is not None:
                keep = tops[a + y] != tops[b + x]
                a, b = a[keep], b[keep]
            for i, j in zip((a + y).tolist(), (b + x).tolist(), strict=True):
                s, t = top(i), top(j)
                if s != t:
                    parent[max(s, t)] = min(s, t)
                    out.append((i, j))
    return out


def links(distinct: DataFrame, radius: int = 3, block: int = 4096, deep: int = 16, parts: int = 1, sampled: int = 1) -> DataFrame:
    """From distinct (fp, rep): pairs (a, b) of reps that connect all fingerprints within ``radius``, as links or chains of links.

    One fingerprint in ``sampled`` is counted to tell which buckets are large; every fingerprint is dealt. Of a pair ``b`` has the lesser fingerprint.
    """
    spark = distinct.sparkSession
    each = len(covering(radius, parts))
    counted = F.pmod(F.xxhash64("fp", F.lit(11)), F.lit(sampled)) == 0

    def tables(turn: int) -> Column:
        signed = [m - (1 << 64) if m >> 63 else m for m in covering(radius, parts, turn)]
        return F.array(*[F.struct(F.lit(i).cast("smallint").alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(signed)])

    rows = distinct.select("fp", "rep", F.inline(tables(0)))

    def large() -> DataFrame:
        sizes = rows.filter(counted).groupBy("t", "key").agg((F.count("*") * sampled).alias("n"))
        return cut(sizes.filter(F.col("n") > block).select("t", "key", "n"))

    hot = large()
    crowded = hot.filter(F.col("n") > block * deep).select("t", "key")
    if not crowded.isEmpty():
        again = rows.join(crowded, ["t", "key"], "left_semi").select("fp", "rep", F.col("t").alias("_t"), F.col("key").alias("_key"), F.inline(tables(4)))
        again = again.select("fp", "rep", (F.lit(each) + F.col("_t") * each + F.col("t")).cast("smallint").alias("t"), F.xxhash64("_t", "_key", "key").alias("key"))
        rows = rows.join(crowded, ["t", "key"], "left_anti").select("fp", "rep", "t", "key").unionByName(again)
        hot = large()
    hot = hot.select("t", "key", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    if hot.isEmpty():
        dealt = rows.select("t", "key", F.lit(0).alias("i"), F.lit(0).alias("j"), "fp", "rep")
    else:
        own = F.pmod(F.xxhash64("fp", F.lit(7)), F.col("blocks")).cast("int")
        marked = rows.join(hot, ["t", "key"], "left").select("t", "key", "fp", "rep", F.coalesce("blocks", F.lit(1)).alias("blocks")).withColumn("own", own)
        dealt = marked.select("t", "key", "fp", "rep", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("with"))
        dealt = dealt.select("t", "key", F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"), "fp", "rep")

    def run(batches):
        held: list[np.ndarray] = []
        last = None

        def pairs():
            fps, reps = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
            return [(reps[i], reps[j]) for i, j in forest(fps.view(np.uint64), radius)]

        def out(found):
            return pa.RecordBatch.from_arrays([pa.array([int(p[k]) for p in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            t, key, i, j, fps, reps = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            change = np.flatnonzero((t[1:] != t[:-1]) | (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
            starts = np.concatenate([[0], change])
            ends = np.concatenate([change, [len(t)]])
            found = []
            for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
                now = (t[s], key[s], i[s], j[s])
                if now != last:
                    if sum(len(h[0]) for h in held) > 1:
                        found += pairs()
                    held.clear()
                    last = now
                if e - s > 1 and e < len(t) and not held:  # lies whole in this batch
                    found += [(reps[s + x], reps[s + y]) for x, y in forest(fps[s:e].view(np.uint64), radius)]
                elif e == len(t) or held:
                    held.append((fps[s:e], reps[s:e]))
            if found:
                yield out(found)
        if sum(len(h[0]) for h in held) > 1:
            yield out(pairs())

    keys = ["t", "key", "i", "j"]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return dealt.select(*keys, "fp", "rep").repartition(n, *keys).sortWithinPartitions(*keys, "fp").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = 3, block: int = 4096) -> DataFrame:
    """(doc_id, fp, component_id), a row for each row of ``docs``.

    ``component_id`` is the smallest id reachable over links of at most ``radius`` differing
    bits, itself included. Null and empty texts have fingerprint zero, linked like any other.
    A row without an id gets the component its fingerprint has, or null if no row with that
    fingerprint has an id; it doesn't link others.
    """
    marked = cut(fingerprints(docs, id_col, text_col, width))
    distinct = cut(marked.filter("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep")))
    linked = components(links(distinct, radius, block))
    named = distinct.join(linked, F.col("rep") == F.col("node"), "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return marked.join(cut(named), "fp", "left").select("doc_id", "fp", "component_id")
