"""Line CRF and clause grammar: exact inference against enumeration, held-out accuracy on the given tables."""

import itertools
import math
import os
import random

import numpy as np
import pytest

from quarrymill.llm import linecrf, toxicity

from .fixtures import awkward_texts, docs_frame, empty_frame, prose

DATA = "/root/testdata/sf0.1"


def test_marginals_equal_enumeration():
    r = random.Random(4)
    for n in range(1, 7):
        chain = linecrf.Chain([0.0] * len(linecrf.FEATURES), [[r.uniform(-2, 2) for _ in range(2)] for _ in range(2)])
        e = [r.uniform(-3, 3) for _ in range(n)]
        total, good = 0.0, [0.0] * n
        for path in itertools.product((0, 1), repeat=n):
            w = math.exp(sum(e[i] * s for i, s in enumerate(path)) + sum(chain.moves[a][b] for a, b in itertools.pairwise(path)))
            total += w
            for i, s in enumerate(path):
                good[i] += w * s
        assert chain.marginals(e) == pytest.approx([g / total for g in good], abs=1e-9)


def test_training_marginals_equal_the_chain_s():
    """Products by doubling over chains end to end, some of thousands of lines, against one message after the other."""
    r = np.random.default_rng(6)
    for sizes in ([1], [1, 2, 5, 1000, 3, 3000, 1], [4] * 50):
        potentials, moves = r.normal(0, 4, sum(sizes)), r.normal(0, 1.5, (2, 2))
        ends = np.cumsum(sizes)
        first = np.zeros(len(potentials), bool)
        first[ends - sizes] = True
        p, pairs = linecrf.marginals(potentials, moves, first)
        chain = linecrf.Chain([], moves.tolist())
        for e, n in zip(ends, sizes, strict=True):
            assert chain.marginals(potentials[e - n : e].tolist()) == pytest.approx(p[e - n : e], abs=1e-9)
            # The pairs' sums are the marginals of either line.
            assert pairs[e - n : e - 1, :, 1].sum(axis=1) == pytest.approx(p[e - n + 1 : e], abs=1e-9)
            assert pairs[e - n : e - 1, 1].sum(axis=1) == pytest.approx(p[e - n : e - 1], abs=1e-9)


def test_whole_query_against_enumeration(spark):
    """Scores of short texts by all paths of states, from the lines' features to the calibrated number."""
    r = random.Random(9)
    chain = linecrf.Chain([r.uniform(-2, 2) for _ in linecrf.FEATURES], [[r.uniform(-1, 1) for _ in range(2)] for _ in range(2)], 0.7, 0.4)
    lines = ["A sound line that ends well.", "BUY!! NOW!! BUY!! NOW!! BUY!!", "x", "1234 5678 90", "%%% ||| ###", "", " \t"]
    rows = [(i, "\n".join(r.choice(lines) for _ in range(r.randrange(8)))) for i in range(60)] + [(None, None), (7, "again")]
    got = {(x["doc_id"], x["score"], x["predicted"]) for x in linecrf.quality(docs_frame(spark, rows), chain).collect()}
    for i, t in rows:
        features, sizes = linecrf.line_features(t or "")
        total = share = 0.0
        for path in itertools.product((0, 1), repeat=len(features)):
            z = sum(chain.weights[k] for f, s in zip(features, path, strict=True) if s for k in f) + sum(chain.moves[a][b] for a, b in itertools.pairwise(path))
            total += math.exp(z)
            share += math.exp(z) * sum(n for n, s in zip(sizes, path, strict=True) if s) / (sum(sizes) or 1)
        good = min(max(share / total, 1e-6), 1 - 1e-6) if features else 0.5
        score = 1 / (1 + math.exp(-(0.4 + 0.7 * math.log(good / (1 - good)))))
        assert any(d == i and s == pytest.approx(score, abs=1e-6) and p == int(s >= 0.3) for d, s, p in got)


def test_long_texts_are_learned_from_whole(spark):
    """Two kinds of texts that only differ after hundreds of lines."""
    rows = [(i, "\n".join([f"line {k} of the text goes on like this." for k in range(400)] + (["%%% ### $$$ %%%"] * 900 if i % 2 else ["A sound line that ends well."] * 900))) for i in range(30)]
    labels = spark.createDataFrame([(i, 1 - i % 2, 0) for i in range(30)], "doc_id long, quality int, toxic int")
    docs = docs_frame(spark, rows)
    chain = linecrf.fit(docs, labels)
    assert all(x["predicted"] == 1 - x["doc_id"] % 2 for x in linecrf.quality(docs, chain).collect())


def test_training_learns_neighbours():
    """Lines that say nothing take their neighbours' side."""
    r = random.Random(1)
    chains = []
    for k in range(200):
        label = k % 3 > 0
        lines = [(0, 1, 2) if not label and r.random() < 0.6 else (0, 14) if label and r.random() < 0.6 else (0,) for _ in range(8)]
        chains.append((lines, int(label)))
    chain = linecrf.train(chains)
    w = chain.weights
    e = [sum(w[k] for k in f) for f in [(0, 1, 2), (0,), (0, 1, 2)]]
    alone = chain.marginals([w[0]])[0]
    assert chain.marginals(e)[1] < alone


def test_line_features():
    features, sizes = linecrf.line_features("Good line.\n\nBUY!! NOW!! BUY!! NOW!! BUY!!\n \nGood line.")
    assert len(features) == 3 and sizes == [10, 29, 10]
    names = [{linecrf.FEATURES[k] for k in f} for f in features]
    assert {"repeated", "odd_after", "first"} <= names[0] and {"odd", "distinct50", "repeated_before"} <= names[1] and "last" in names[2]
    assert linecrf.line_features("") == linecrf.line_features(" \n\t") == ([], [])


@pytest.mark.skipif(not os.path.isdir(DATA), reason="tables not here")
def test_quality_held_out(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    scored = linecrf.quality(docs, linecrf.fit(docs, labels)).collect()
    assert len(scored) == docs.count()
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    held = [(truth[r["doc_id"]], r["score"], r["predicted"]) for r in scored if r["held_out"] and truth.get(r["doc_id"]) is not None]
    good, bad = [s for y, s, _ in held if y], [s for y, s, _ in held if not y]
    auc = sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))
    accuracy = sum(y == p for y, _, p in held) / len(held)
    print("quality held out", auc, accuracy)
    assert auc > 0.9 and accuracy > 0.93, (auc, accuracy)


def test_models_without_labels(spark):
    docs = docs_frame(spark)
    none = spark.createDataFrame([(1, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    q = linecrf.quality(docs, linecrf.fit(docs, none)).collect()
    assert len(q) == len(awkward_texts()) and {r["score"] for r in q} == {0.5}
    t = toxicity.toxicity(docs, toxicity.fit(docs, none)).collect()
    assert len(t) == len(awkward_texts()) and all(r["predicted"] == 0 for r in t)
    assert linecrf.quality(empty_frame(spark), linecrf.Chain([0.0] * len(linecrf.FEATURES), [[0.0] * 2] * 2)).count() == 0
    assert toxicity.toxicity(empty_frame(spark), toxicity.Model(toxicity.base_classes())).count() == 0


def test_composition():
    a, b = toxicity.Transducer(start=0), toxicity.Transducer(start=0)
    a.arc(0, "x", 0, "y", 1.0)
    a.finals[0] = 0.0
    b.arc(0, "y", 1, "z", 2.0)
    b.finals[1] = 0.5
    assert (a @ b).best(["x"]) == (3.5, ("z",)) and (a @ b).best(["x", "x"]) == (-math.inf, ())


def kinds(text):
    return toxicity.Model(toxicity.base_classes()).clause(toxicity.plain_words(text))


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("you are an idiot", ("at_target",)), ("what an idiot", ("predicated",)), ("idiot", ("bare",)), ("idiot moron loser", ("bare", "bare", "bare")), ("The word idiot appears in the dictionary", ("quoted",)), ("an idiot, as the word goes", ("quoted",)), ("idiot that you are", ("at_target",)), ("you are not an idiot", ("denied",)), ("the minister said the moron left", ("quoted",)),
        ("i will kill you", ("threat",)), ("kill the process", ()), ("a calm and quiet day", ()), ("the idiot of stone", ("predicated",)), ("such old and very tired moron", ("bare",)), ("trash heap by the very old river bank you", ("bare",)),
    ],
)
def test_clauses(text, want):
    assert kinds(text) == want


def test_scores_follow_clauses():
    model = toxicity.Model(toxicity.base_classes())
    assert model.score("You are an idiot.") > 0.7 > model.score("You are not an idiot.")
    assert model.score("He said you were a clown") < 0.7
    assert model.score("") == model.score("nothing here") < 0.1


def test_lexicon_is_learned():
    rows = [(prose(i, 30) + " grumblefig " + prose(i + 500, 20), 1) for i in range(20)] + [(prose(i + 1000, 50), 0) for i in range(100)]
    model = toxicity.learn(rows)
    assert model.classes.get("grumblefig") == toxicity.INSULT
    assert model.score("you are a grumblefig") > model.score("you are a thing")
    assert model.score("some grumblefig here") == model.score("some thing here")


@pytest.mark.skipif(not os.path.isdir(DATA), reason="tables not here")
def test_toxicity_held_out(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    scored = toxicity.toxicity(docs, toxicity.fit(docs, labels)).collect()
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    held = [(truth[r["doc_id"]], r["predicted"]) for r in scored if r["held_out"] and truth.get(r["doc_id"]) is not None]
    print("toxic held out", sum(p and not y for y, p in held), sum(p for y, p in held if y), sum(y for y, _ in held), len(held))
    assert sum(p and not y for y, p in held) <= 0.01 * len(held)
    assert sum(p for y, p in held if y) >= 0.8 * sum(y for y, _ in held)
