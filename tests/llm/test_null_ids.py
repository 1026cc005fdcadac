"""Rows without an id: every operator has a result for them, and none fails."""

import public_tokenizers as P

from quarrymill.llm import bpe, decontaminate, huffman, linecrf, media, secretscan, sharding, simhash, toxicity, urlfilter

ROWS = [(None, "a b c d"), (None, None), (3, "a b c d"), (None, ""), (2, "token = abcdefgh")]


def frame(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string")


def ids(df):
    return sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in df.collect())


def test_rows_are_kept(spark):
    docs, all_ids = frame(spark), [-1, -1, -1, 2, 3]
    ranks = P.path("byte_bpe_50k.tiktoken")
    assert ids(media.tiff_digests(media.texts_to_tiff(docs))) == all_ids
    assert ids(linecrf.quality(docs, linecrf.Chain([0.0] * len(linecrf.FEATURES), [[0.0] * 2] * 2))) == all_ids
    assert ids(secretscan.digest(secretscan.scan(docs))) == all_ids
    assert ids(simhash.near_duplicates(docs)) == all_ids
    assert ids(bpe.round_trip(docs, ranks, P.PATTERN)) == all_ids
    assert ids(toxicity.toxicity(docs, toxicity.Model(toxicity.base_classes()))) == all_ids


def test_ids_without_order(spark):
    rows = huffman.ids_digest(frame(spark), P.path("byte_bpe_50k.json")).orderBy("start").collect()
    assert [r["doc_id"] for r in rows] == [None, None, None, 2, 3]
    assert [r["start"] for r in rows] == [sum(x["n_tokens"] for x in rows[:k]) for k in range(5)]
    placed = sharding.shard(frame(spark), shards=2).collect()
    assert len(placed) == 5 and {r["shard"] for r in placed if r["doc_id"] is None} <= {0, 1}


def test_searches_pass_over_them(spark):
    items = spark.createDataFrame([(None, "a b c d"), (1, "a b c d"), (2, None)], "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(frame(spark), items).collect()} == {(3, 1)}
    pages = spark.createDataFrame([(None, None, None), (None, "https://a.com/en/x", None)], "page_id long, url string, html string")
    assert sorted(r["verdict"] for r in urlfilter.judge(pages).collect()) == ["allow", "block"]
