"""Near copies of the pipeline's stage against all pairs."""

import random

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from quarrymill.llm import nearcopies, shared, simhash

from .fixtures import awkward_texts, docs_frame, empty_frame, prose


def sets(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split() if (text or "").isascii() else (text or "").split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) > 5 else {tuple(words)}


def copies():
    """Texts with every few words changed, so that similarities lie on both sides of 0.8, and a line that all share."""
    r = random.Random(3)
    line, rows = prose(900, 12), []
    for g in range(12):
        words = prose(200 + g, 120).split()
        for k in range(5):
            changed = list(words)
            for at in r.sample(range(len(words)), k):
                changed[at] = f"zz{g}{k}{at}"
            rows.append((100 + 10 * g + k, line + " " + " ".join(changed)))
    return rows


def test_near_copies(spark):
    rows = [*((i, t) for i, t in awkward_texts() if i != 10), *copies()]
    got = {r["doc_id"]: r["component_id"] for r in nearcopies.near_copies(docs_frame(spark, rows)).collect()}
    want = {i: i for i, _ in rows}
    near = [(a, b) for a, s in rows for b, t in rows if a < b and 5 * len(sets(s) & sets(t)) >= 4 * len(sets(s) | sets(t))]
    for _ in rows:
        for a, b in near:
            want[a] = want[b] = min(want[a], want[b])
    assert got == want and len(set(want.values())) > 20
    few = {r["doc_id"]: r["component_id"] for r in nearcopies.near_copies(docs_frame(spark, rows), block=3, sampled=1).collect()}
    assert few == want
    assert nearcopies.near_copies(empty_frame(spark)).count() == 0


def test_stage_drops_copies_at_085(spark):
    """Fingerprints of such a pair differ by far more than 3 bits."""
    words = prose(1, 200).split()
    other = list(words)
    for at in (30, 80, 130):
        other[at] = "changed"
    rows = [(1, " ".join(words)), (2, " ".join(other)), (3, prose(2, 200))]
    assert 0.8 < len(sets(rows[0][1]) & sets(rows[1][1])) / len(sets(rows[0][1]) | sets(rows[1][1])) < 0.9
    kept = corpus_pipeline.one_of_each(spark, docs_frame(spark, rows), "")
    assert {r["doc_id"] for r in kept.collect()} == {1, 3}


def test_large_group_makes_few_pairs(spark):
    """Hundreds of near copies of one text: as many links as texts, not as their square; and none lost."""
    r = random.Random(12)
    words = prose(77, 150).split()
    rows = []
    for i in range(600):
        changed = list(words)
        for at in r.sample(range(len(words)), r.randrange(4)):
            changed[at] = f"w{r.randrange(40)}"
        rows.append((i, " ".join(changed)))
    rows += [(1000 + i, prose(2000 + i, 100)) for i in range(50)]
    keyed = docs_frame(spark, rows).select(nearcopies.normal("text").alias("norm")).selectExpr("norm", "xxhash64(norm) as key")
    made = nearcopies.links(keyed, sampled=1, block=128).count()
    distinct = len({t for _, t in rows})
    assert distinct > 400 and made < 9 * distinct
    got = {x["doc_id"]: x["component_id"] for x in nearcopies.near_copies(docs_frame(spark, rows)).collect()}
    assert all(got[i] == (0 if i < 600 else i) for i, _ in rows)


def test_masks_in_parts_cover_nine_bits():
    r = random.Random(5)
    masks = simhash.covering(9, 2)
    assert len(masks) == 62 and simhash.covering(3) == simhash.masks(3)
    for _ in range(5000):
        apart = sum(1 << i for i in r.sample(range(64), r.randrange(10)))
        assert any(not apart & m for m in masks)


def test_stage_goes_by_covering_fingerprints(spark, monkeypatch):
    """Op 7's links are what the stage asks first; they connect all texts whose fingerprints differ by up to 9 bits, counted here over all pairs."""
    asked, links = [], simhash.links

    def told(distinct, radius, **more):
        asked.append(radius)
        return links(distinct, radius, **more)

    monkeypatch.setattr(simhash, "links", told)
    rows = [(i, t) for i, t in copies() if i % 10 < 4]
    kept = corpus_pipeline.one_of_each(spark, docs_frame(spark, rows), "").collect()
    assert asked == [9] and len(kept) < len(rows)
    keyed = docs_frame(spark, rows).select(nearcopies.normal("text").alias("norm")).selectExpr("norm", "xxhash64(norm) as key")
    none = (np.array([], np.int64), np.array([], np.int64))
    first = nearcopies.prefixes(keyed, none).select("key", "fp", "size").collect()
    want = {x["key"]: x["key"] for x in first}
    near = [(a, b) for a in first for b in first if a["key"] < b["key"] and ((a["fp"] ^ b["fp"]) % (1 << 64)).bit_count() <= 9]
    for _ in first:
        for a, b in near:
            want[a["key"]] = want[b["key"]] = min(want[a["key"]], want[b["key"]])
    got = {x["node"]: x["component"] for x in shared.components(nearcopies.covered(nearcopies.prefixes(keyed, none))).collect()}
    assert {k: got.get(k, k) for k in want} == want and 12 <= len(set(want.values())) < len(rows) - 12


def family(n):
    """Copies of one text that differ from each other by too much, and pairs of them that don't."""
    r = random.Random(31)
    words, rows = prose(88, 150).split(), []
    for i in range(n):
        changed = list(words)
        for at in r.sample(range(len(words)), 3):
            changed[at] = f"v{i}x{at}"
        rows.append((i, " ".join(changed)))
        if i % 20 == 0:
            changed[r.choice((5, 75, 145))] = "other"
            rows.append((10_000 + i, " ".join(changed)))
    return rows


def keyed_prefixes(spark, rows):
    keyed = docs_frame(spark, rows).select(nearcopies.normal("text").alias("norm")).selectExpr("norm", "xxhash64(norm) as key")
    order = nearcopies.common(keyed, 5, 1)
    return keyed, shared.cut(nearcopies.prefixes(keyed, order).withColumn("named", F.col("key")))


def test_large_group_without_links_makes_no_square(spark):
    """Texts of one bucket that are alike but no near copies: rows as many as their prefixes, not as their pairs; and the links among them are all found."""
    rows = family(600)
    keyed, first = keyed_prefixes(spark, rows)
    made = nearcopies.candidates(first, []).count()
    assert made <= first.select(F.sum(F.size("firsts"))).first()[0] < len(rows) * (len(rows) - 1) // 4
    own = {i: sets(t) for i, t in rows}
    want = {i: i for i, _ in rows}
    near = [(a, b) for a, s in own.items() for b, t in own.items() if a < b and 5 * len(s & t) >= 4 * len(s | t)]
    for _ in range(len(rows)):
        last = dict(want)
        for a, b in near:
            want[a] = want[b] = min(want[a], want[b])
        if last == want:
            break
    assert 30 <= len(near) and len(set(want.values())) > 400
    got = {r["doc_id"]: r["component_id"] for r in nearcopies.near_copies(docs_frame(spark, rows), sampled=1, block=128).collect()}
    assert got == want


def test_buckets_compared_whole_find_the_same(spark, monkeypatch):
    """Every bucket of more than two texts is compared where it meets, in tiles of few texts: the links of all pairs, none by SimHash before."""
    monkeypatch.setattr(nearcopies, "covered", lambda first: first.sparkSession.createDataFrame([], "a long, b long, at long"))
    rows = copies()
    near = [(a, b) for a, s in rows for b, t in rows if a < b and 5 * len(sets(s) & sets(t)) >= 4 * len(sets(s) | sets(t))]
    want = {i: i for i, _ in rows}
    for _ in rows:
        for a, b in near:
            want[a] = want[b] = min(want[a], want[b])
    for block in (3, 2048):
        got = {r["doc_id"]: r["component_id"] for r in nearcopies.near_copies(docs_frame(spark, rows), sampled=1, block=block, meet=2).collect()}
        assert got == want and len(set(want.values())) < len(rows) - 20


def test_forest_joins_what_all_pairs_join():
    r = np.random.default_rng(4)
    base = r.integers(0, 1 << 60, 90)
    made = [np.unique(np.concatenate([r.choice(base, 80 + int(r.integers(10)), replace=False), r.integers(0, 1 << 60, int(r.integers(14)))])) for _ in range(70)]
    made += [np.array([k]) for k in (1, 2, 2)]
    near = [(a, b) for a in range(len(made)) for b in range(a) if 5 * len(np.intersect1d(made[a], made[b])) >= 4 * len(np.union1d(made[a], made[b]))]

    def named(pairs):
        out = list(range(len(made)))
        for _ in made:
            for a, b in pairs:
                out[a] = out[b] = min(out[a], out[b])
        return out

    found = list(nearcopies.forest(made))
    assert named(found) == named(near) and len(found) == len(made) - len(set(named(near))) and {(max(p), min(p)) for p in found} <= set(near)
    assert 3 < len(set(named(near))) < 60
