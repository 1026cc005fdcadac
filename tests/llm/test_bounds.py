"""What must stay bounded or linear: labelled samples with repeated ids, redaction of very many secrets, families of edits."""

import random
import time

from pyspark.sql import functions as F

from quarrymill.llm import linecrf, nearcopies, secretscan

from .fixtures import docs_frame, prose
from .test_near_copies import sets


def test_a_labelled_sample_has_one_row_for_each_id(spark):
    docs = docs_frame(spark, [(7, f"text {k}") for k in range(20_000)] + [(i, "t") for i in range(100, 140)])
    labels = spark.createDataFrame([(7, 1), (7, 1), *((i, 0) for i in range(100, 140))], "doc_id long, quality int")
    made = lambda: linecrf.labelled_sample(docs, labels, "quality", F.lit(True), 10).collect()
    for rows in (10, 41, 1000):
        got = linecrf.labelled_sample(docs, labels, "quality", F.lit(True), rows).collect()
        assert len(got) == min(rows, 41)
    assert sorted(made()) == sorted(made())


def test_redaction_takes_time_in_proportion(spark):
    took = {}
    for n in (2_000, 20_000):
        text = " ".join(f"é😀 token = {'ab12' * 4}{k:06}" for k in range(n))
        df = spark.createDataFrame([(text,)], "text string")
        at, spans = 0, []
        for _ in range(n):
            at = text.index("ab12ab12", at)
            spans.append((at, 0, at + 22))
            at += 22
        frame = spark.createDataFrame([(text, spans)], "text string, found array<struct<start:int,kind:int,end:int>>")
        began = time.perf_counter()
        got = frame.select(secretscan.redacted(F.col("text"), F.col("found")).alias("t")).first()["t"]
        took[n] = time.perf_counter() - began
        assert got == " ".join("é😀 token = [secret]" for _ in range(n)) and df.count() == 1
    assert took[20_000] < 40, took


def test_redaction_of_overlapping_and_bordering_spans(spark):
    rows = [("abcdef", [(0, 0, 2), (1, 1, 4)]), ("abcdef", [(2, 0, 4), (4, 1, 6)]), ("abcdef", []), (None, []), ("x" * 9000, [(4096, 0, 8192)]), ("abc", [(0, 0, 3)]), ("abcdef", [(1, 0, 5), (2, 1, 3)])]
    df = spark.createDataFrame(rows, "text string, found array<struct<start:int,kind:int,end:int>>")
    got = [r[0] for r in df.select(secretscan.redacted(F.col("text"), F.col("found"))).collect()]
    assert got == ["[secret]ef", "ab[secret][secret]", "abcdef", None, "x" * 4096 + "[secret]" + "x" * 808, "[secret]", "a[secret]f"]


def test_a_family_below_the_bound_ships_each_text_few_times(spark):
    """Edits of one text, most pairs just below 0.8: many candidate pairs, but each text's shingles are sent a few times, not once for each pair; links equal all pairs."""
    r = random.Random(21)
    words = prose(500, 200).split()
    rows = []
    for i in range(250):
        changed = list(words)
        for at in r.sample(range(len(words)), r.choice([2, 3, 5, 6])):
            changed[at] = f"q{i}x{at}"
        rows.append((i, " ".join(changed)))
    keyed = docs_frame(spark, rows).select(nearcopies.normal("text").alias("norm")).selectExpr("norm", "xxhash64(norm) as key").cache()
    order = nearcopies.common(keyed, 5, 1)
    first = nearcopies.prefixes(keyed, order).dropDuplicates(["key"]).withColumn("named", F.col("key"))
    pairs = nearcopies.candidates(first, []).cache()
    members = pairs.select("at", F.explode(F.array("a", "b")).alias("key")).distinct().count()
    assert pairs.count() > 5_000 and members < 2_500
    own = [sets(t) for _, t in rows]
    want = {(a, b) for a in range(250) for b in range(a) if 5 * len(own[a] & own[b]) >= 4 * len(own[a] | own[b])}
    key = {x["norm"]: x["key"] for x in keyed.collect()}
    norm = {" ".join(t.split()): i for i, t in rows}
    at = {key[n]: i for n, i in norm.items()}
    got = {tuple(sorted((at[x["a"]], at[x["b"]]), reverse=True)) for x in nearcopies.compared(pairs, keyed, 5).collect()}
    assert got == want and len(want) > 100
