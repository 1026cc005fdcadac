"""SimHash by covering tables against all pairs; shards against a plain search."""

import random
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quarrymill.llm import sharding, shared, simhash

from .fixtures import awkward_texts, docs_frame, empty_frame


def plain_fingerprint(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text).replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64(s.encode(), 42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if hashes and sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def plain_components(fps):
    """Smallest id reachable, by all pairs."""
    ids = list(fps)
    comp = {i: i for i in ids}
    changed = True
    near = [(a, b) for a in ids for b in ids if a < b and (fps[a] ^ fps[b]).bit_count() <= 3]
    while changed:
        changed = False
        for a, b in near:
            m = min(comp[a], comp[b])
            if comp[a] != m or comp[b] != m:
                comp[a] = comp[b] = m
                changed = True
    return comp


def test_masks_cover_every_pair():
    r = random.Random(1)
    masks = simhash.masks()
    assert len(masks) == 15
    for _ in range(5000):
        a = r.getrandbits(64)
        b = a
        for i in r.sample(range(64), r.randrange(4)):
            b ^= 1 << i
        assert any(a & m == b & m for m in masks)


def test_fingerprints():
    for _, t in awkward_texts():
        assert simhash.fingerprint(t or "") == plain_fingerprint(t or "")


def test_near_duplicates(spark):
    rows = simhash.near_duplicates(docs_frame(spark)).collect()
    fps = {i: plain_fingerprint(t or "") for i, t in awkward_texts()}
    want = plain_components(fps)
    assert sorted((r["doc_id"], r["component_id"]) for r in rows) == sorted((i, want[i]) for i, _ in awkward_texts())
    assert simhash.near_duplicates(empty_frame(spark)).count() == 0
    none = spark.createDataFrame([(None, "a b c"), (5, "a b c"), (None, "q")], "doc_id long, text string")
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0) for r in simhash.near_duplicates(none).collect()) == [(0, 0), (0, 5), (5, 5)]


def test_links_with_hot_buckets(spark):
    """A dense cluster, so that buckets overflow into blocks: nothing may be lost."""
    r = random.Random(7)
    centre = r.getrandbits(64)
    fps = set()
    while len(fps) < 300:
        x = centre
        for i in r.sample(range(64), r.randrange(7)):
            x ^= 1 << i
        fps.add(x)
    fps |= {r.getrandbits(64) for _ in range(100)}
    fps = dict(enumerate(sorted(fps)))
    frame = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)), i) for i, f in fps.items()], "fp long, rep long")
    want = plain_components(fps)
    for block, deep in ((16, 16), (16, 2), (4096, 16)):
        got = {x["node"]: x["component"] for x in shared.components(simhash.links(frame, block=block, deep=deep)).collect()}
        assert {i: got.get(i, i) for i in fps} == want


def test_components(spark):
    r = random.Random(2)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(40)] + [(None, 3), (5, None), (7, 7)]
    parent = {}

    def top(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            parent[max(top(a), top(b))] = min(top(a), top(b))
    got = {x["node"]: x["component"] for x in shared.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: top(x) for x in list(parent) if top(x) != x}


@pytest.mark.parametrize("turn", [0, 4])
def test_masks_cover(turn):
    """Any three positions are masked out together in some table, in either family."""
    made = simhash.masks(3, turn=turn)
    kept = np.array([[m >> i & 1 for i in range(64)] for m in made], bool)
    for i in range(64):
        for j in range(i):
            free = ~(kept[:, i] | kept[:, j])
            assert (free[:, None] & ~kept).any(axis=0).all()


def test_hot_centre_spreads(spark):
    """A star of a million edges: no task of the joins gets nearly all of its rows, and the result is whole."""
    n = 1_000_000
    conf = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "200kB", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "200kB", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
    old = {k: spark.conf.get(k, None) for k in conf}
    before = {s.stageId() for s in stages_of(spark)}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        edges = spark.range(1, n + 1).select(F.lit(0).cast("long").alias("a"), F.col("id").alias("b"))
        out = shared.components(edges)
        assert out.agg(F.count("*"), F.max("component"), F.countDistinct("node")).first()[:] == (n, 0, n)
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    # Stages that read that many rows are the joins with the minima: no task reads a tenth of a centre's rows.
    read = [rows_by_task(spark, s) for s in stages_of(spark) if s.stageId() not in before and s.shuffleReadRecords() > 1.5 * n]
    assert read and all(max(r) < 0.3 * sum(r) for r in read), read


def stages_of(spark):
    sc = spark.sparkContext
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return [stages.apply(i) for i in range(stages.size())]


def rows_by_task(spark, stage):
    tasks = spark.sparkContext._jsc.sc().statusStore().taskList(stage.stageId(), stage.attemptId(), 1000)
    return [tasks.apply(i).taskMetrics().get().shuffleReadMetrics().recordsRead() for i in range(tasks.size())]


def plain_capacity(sizes, shards):
    low, high = max(sizes, default=0), sum(sizes)

    def fits(c):
        n, at = 1, 0
        for s in sizes:
            if at + s > c:
                n, at = n + 1, 0
            at += s
        return n <= shards

    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if fits(mid) else (mid + 1, high)
    return low


def test_shards(spark):
    r = random.Random(3)
    rows = [*awkward_texts(), *[(100 + i, "w" * r.randrange(400) + str(i // 3)) for i in range(300)]]
    for run in (7, 1 << 16):
        out = sharding.shard(docs_frame(spark, rows), run=run).collect()
        assert sorted((x["doc_id"], x["size"], x["text_crc32"]) for x in out) == sorted((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
        groups = {}
        for i, t in rows:
            first, size = groups.get(t or "", (i, 0))
            groups[t or ""] = min(first, i), size + len((t or "").encode()) + 1
        ordered = [s for _, s in sorted(groups.values())]
        capacity = plain_capacity(ordered, 8)
        loads = {}
        for x in out:
            loads[x["shard"]] = loads.get(x["shard"], 0) + x["size"]
        assert max(loads.values()) == capacity and set(loads) <= set(range(8))
        for s in loads:
            assert sorted(x["slot"] for x in out if x["shard"] == s) == list(range(sum(x["shard"] == s for x in out)))
        placed = {}
        for (i, t) in rows:
            placed.setdefault(t or "", set()).update(x["shard"] for x in out if x["doc_id"] == i)
        assert all(len(v) == 1 for v in placed.values())
    assert sharding.shard(empty_frame(spark)).count() == 0
    same = sharding.shard(docs_frame(spark, [(i, "x") for i in range(20)])).collect()
    assert {x["shard"] for x in same} == {0} and sorted(x["slot"] for x in same) == list(range(20))


def loads(out):
    sizes = {}
    for x in out:
        sizes[x["shard"]] = sizes.get(x["shard"], 0) + x["size"]
    return sizes


@pytest.mark.parametrize("place", [0, 250, 499])
def test_shards_beside_a_large_group(spark, place):
    """One group holds 60 % of the bytes: it alone sets the capacity, the others share the rest evenly."""
    r = random.Random(place)
    small = [(1000 + 10 * i, "".join(r.choice("abc ") for _ in range(r.randrange(900, 1100))) + str(i)) for i in range(500)]
    large = "z" * 9999
    rows = small + [(1000 + 10 * place + 1 + i / 100, large) for i in range(75)]
    rows = [(int(i * 100), t) for i, t in rows]
    sizes = loads(sharding.shard(docs_frame(spark, rows), run=64).collect())
    assert len(sizes) == 8 and max(sizes.values()) == 75 * 10_000
    others = sorted(sizes.values())[:-1]
    # Shards end at the large group, so at most one of them may be short.
    assert others[1] > 0.7 * 500_000 / 7 and others[-1] < 1.5 * 500_000 / 7


def test_shards_without_ids(spark):
    """Rows without an id are ordered by their text's hash, and no shard exceeds the capacity."""
    rows = [(None, "n" * 50 + str(i)) for i in range(200)] + [(i, "m" * 50 + str(i)) for i in range(100)] + [(5, "x" * 60), (5, "y" * 60)]
    out = sharding.shard(docs_frame(spark, rows), run=16).collect()
    sizes = loads(out)
    assert len(sizes) == 8 and max(sizes.values()) < 1.05 * min(sizes.values())
    assert all(x["shard"] <= 5 for x in out if x["doc_id"] is None) and all(x["shard"] >= 5 for x in out if x["doc_id"] is not None)
