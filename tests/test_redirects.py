"""Redirects as a table, against one replacement after another over the text."""

import random
import re

from quarrymill.operators import rewrite


def one_by_one(text, pairs):
    n = 0
    for source, destination in pairs:
        text, k = re.subn(f"([\"'(]){re.escape(source)}(?=[)\"'#\\s])", lambda m, d=destination: m[1] + d, text)
        n += k
    return text, n


def run(spark, texts, pairs):
    docs = spark.createDataFrame([(f"p{i}", t) for i, t in enumerate(texts)], "path string, content string")
    return {r["path"]: (r["content"], r["replacements"]) for r in rewrite.redirects(docs, pairs).collect()}


def test_chains_fragments_and_order(spark):
    pairs = [("/old/a", "/new/a"), ("/new/a", "/final/a"), ("/final/a", "/old/a"), ("/x", "/y#top"), ("/y", "/z"), ("/late", "/x"), ("/x#f", "/never"), ("/twice", "/1"), ("/twice", "/2")]
    texts = ["(/old/a) \"/old/a#q\" '/new/a' (/old/a/b) /old/a (/x) (/x#f) (/late) (/y#k \"/twice\"", "", "no target", "((/old/a)) (\"/twice\")"]
    assert run(spark, texts, pairs) == {f"p{i}": one_by_one(t, pairs) for i, t in enumerate(texts)}


def test_random_documents(spark):
    rng = random.Random(5)
    names = [f"/{a}{b}" for a in "abc" for b in ("", "/x", "/y")]
    pairs = [(rng.choice(names) + rng.choice(["", "", "#s"]), rng.choice(names) + rng.choice(["", "", "#t"])) for _ in range(25)]
    piece = lambda: rng.choice("\"'( ") + rng.choice(names) + rng.choice(["", "#s", "#u"]) + rng.choice(")\"' \n.")
    texts = ["".join(piece() for _ in range(rng.randrange(40))) for _ in range(60)]
    assert run(spark, texts, pairs) == {f"p{i}": one_by_one(t, pairs) for i, t in enumerate(texts)}


def test_nulls_and_empty_tables(spark):
    docs = spark.createDataFrame([("a", None), ("b", "(/s)")], "path string, content string")
    none = spark.createDataFrame([(1, None, "/d"), (2, "/s", None), (3, "", "/d")], "ord long, source string, destination string")
    assert sorted(map(tuple, rewrite.redirects_from(docs, none).collect())) == [("a", None, 0), ("b", "(/s)", 0)]
    assert rewrite.redirects_from(docs.limit(0), none).collect() == []
