"""Document quality from a linear-chain conditional random field over lines.

Each line is good or bad. A line's own features and those of its neighbours give it a
potential, a transition matrix ties lines that follow each other. Forward-backward gives
each line's probability; weighted by length, these make the document's score.

With two states a message is one number, its log odds, so whole texts of any length are
scored in one pass forward and one back.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import slices, whole

#: Labelled rows to learn from, their whole texts.
SAMPLE = 3000
SYMBOLS = re.compile(r"[%&$#*!|<>{}\[\]\\^~=+@_]")
UPPER = re.compile(r"[A-ZÄÖÜÀÁÂÇÈÉÊËÍÎÏÑÓÔÖÚÛÜ]")
DIGIT = re.compile(r"[0-9]")
OWN = ["bias", "symbols2", "symbols8", "symbols20", "upper30", "upper60", "distinct80", "distinct50", "distinct25", "doubled", "digits20", "short", "long", "wide_words", "ends", "repeated", "odd"]
FEATURES = [*OWN, "odd_before", "odd_after", "repeated_before", "repeated_after", "first", "last"]


def line_features(text: str) -> tuple[list[tuple[int, ...]], list[int]]:
    """For each line that isn't blank the features that hold, as places in FEATURES, and its length. A text without lines has none."""
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    seen: dict[str, int] = {}
    for x in lines:
        seen[x] = seen.get(x, 0) + 1
    own, odd, again = [], [], []
    for x in lines:
        n = len(x)
        words = x.split()
        w = len(words)
        f = [0]
        symbols, upper = len(SYMBOLS.findall(x)) / n, len(UPPER.findall(x)) / n
        distinct = len(set(words)) / w if w >= 5 else 1.0
        if symbols > 0.02:
            f.append(1)
            if symbols > 0.08:
                f.append(2)
                if symbols > 0.2:
                    f.append(3)
        if upper > 0.3:
            f.append(4)
            if upper > 0.6:
                f.append(5)
        if distinct < 0.8:
            f.append(6)
            if distinct < 0.5:
                f.append(7)
                if distinct < 0.25:
                    f.append(8)
            if any(map(str.__eq__, words, words[1:])):
                f.append(9)
        if len(DIGIT.findall(x)) > 0.2 * n:
            f.append(10)
        if n < 25:
            f.append(11)
        elif n > 1500:
            f.append(12)
        if n > 14 * w:
            f.append(13)
        if x[-1] in ".!?":
            f.append(14)
        repeated = seen[x] > 1
        if repeated:
            f.append(15)
        is_odd = symbols > 0.05 or upper > 0.4 or distinct < 0.5
        if is_odd:
            f.append(16)
        own.append(f)
        odd.append(is_odd)
        again.append(repeated)
    last = len(own) - 1
    for i, f in enumerate(own):
        if i:
            if odd[i - 1]:
                f.append(17)
            if again[i - 1]:
                f.append(19)
        else:
            f.append(21)
        if i < last:
            if odd[i + 1]:
                f.append(18)
            if again[i + 1]:
                f.append(20)
        else:
            f.append(22)
    return [tuple(f) for f in own], [len(x) for x in lines]


@dataclass
class Chain:
    """Weights: of the features for good against bad, and from state to state (0 bad, 1 good)."""

    weights: list[float]
    moves: list[list[float]]
    scale: float = 1.0
    shift: float = 0.0

    def marginals(self, potentials: list[float]) -> list[float]:
        """P(good) of each line."""
        n = len(potentials)
        (t00, t01), (t10, t11) = [[math.exp(v) for v in row] for row in self.moves]
        exp, log = math.exp, math.log
        ahead = [0.0] * n
        odds = 0.0
        for i, p in enumerate(potentials):
            if i:
                e = exp(min(max(odds, -30.0), 30.0))
                odds = p + log((t01 + e * t11) / (t00 + e * t10))
            else:
                odds = p
            ahead[i] = odds
        back = 0.0
        out = [0.0] * n
        for i in range(n - 1, -1, -1):
            out[i] = 1.0 / (1.0 + exp(-min(max(ahead[i] + back, -30.0), 30.0)))
            e = exp(min(max(potentials[i] + back, -30.0), 30.0))
            back = log((t10 + e * t11) / (t00 + e * t01))
        return out

    def good(self, text: str) -> float:
        """Length-weighted share of good lines; a text without lines counts as one empty line's half."""
        lines, sizes = line_features(text)
        if not lines:
            return 0.5
        w = self.weights
        known: dict[tuple[int, ...], float] = {}
        potentials = []
        for f in lines:
            p = known.get(f)
            if p is None:
                p = known[f] = sum(w[k] for k in f)
            potentials.append(p)
        return sum(p * n for p, n in zip(self.marginals(potentials), sizes, strict=True)) / sum(sizes)

    def score(self, text: str) -> float:
        share = min(max(self.good(text), 1e-6), 1 - 1e-6)
        return 1.0 / (1.0 + math.exp(-(self.shift + self.scale * math.log(share / (1 - share)))))


def running(m: np.ndarray, steps: int) -> np.ndarray:
    """Products of the 2 by 2 matrices up to each place, scaled to sum 1, over the 2 ** ``steps`` places before it at least."""
    for k in range(steps):
        d = 1 << k
        if d >= len(m):
            break
        longer = np.matmul(m[:-d], m[d:])
        m = np.concatenate([m[:d], longer / longer.sum(axis=(1, 2), keepdims=True)])
    return m


def marginals(potentials: np.ndarray, moves: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(good) of each line, and for each line but the first of all the probabilities (state before, state) with the line before it.

    All chains lie end to end; ``first`` tells where one begins. Messages are products of matrices, formed by doubling,
    so chains of any length take as many steps as their length has binary digits. Pairs across a border mean nothing.
    """
    n = len(potentials)
    # From state to state, times the line's own weight; scaled so that nothing overflows.
    weight = np.exp(np.stack([np.minimum(0, -potentials), np.minimum(0, potentials)], axis=1))
    onto = np.exp(moves)[None] * weight[:, None, :]
    starts = np.flatnonzero(first)
    longest = int(np.diff(np.append(starts, n)).max())
    steps = max(1, longest.bit_length())
    # A matrix of equal rows forgets what was before it.
    ahead = onto.copy()
    ahead[starts] = np.repeat(weight[starts, None, :], 2, axis=1)
    alpha = running(ahead / ahead.sum(axis=(1, 2), keepdims=True), steps).sum(axis=1)
    alpha /= alpha.sum(axis=1, keepdims=True)
    back = np.empty_like(onto)
    back[:-1] = onto[1:]
    back[np.append(starts[1:] - 1, n - 1)] = 1.0
    turned = (back / back.sum(axis=(1, 2), keepdims=True))[::-1].transpose(0, 2, 1)
    beta = running(turned, steps).sum(axis=1)[::-1]
    beta /= beta.sum(axis=1, keepdims=True)
    both = alpha * beta
    pairs = alpha[:-1, :, None] * onto[1:] * beta[1:, None, :]
    return both[:, 1] / both.sum(axis=1), pairs / pairs.sum(axis=(1, 2), keepdims=True)


def train(chains: list[tuple[list[tuple[int, ...]], int]], rounds: int = 150, l2: float = 1e-3, rate: float = 0.15) -> Chain:
    """Maximum likelihood by gradient steps over all chains, whole; every line of a chain starts with its document's label.

    After half the rounds, lines of bad documents that the model holds for good are taken for good:
    a bad document may contain sound lines.
    """
    n_f, sizes = len(FEATURES), np.array([len(c) for c, _ in chains])
    n = int(sizes.sum())
    x = np.zeros((n, n_f))
    for i, f in enumerate(f for c, _ in chains for f in c):
        x[i, list(f)] = 1
    y = np.repeat(np.array([float(label) for _, label in chains]), sizes)
    bad = y == 0
    first = np.zeros(n, bool)
    first[np.cumsum(sizes) - sizes] = True
    within = ~first[1:]
    w, t = np.zeros(n_f), np.zeros((2, 2))
    params_m, params_v = np.zeros(n_f + 4), np.zeros(n_f + 4)
    for step in range(1, rounds + 1):
        p, pairs = marginals(x @ w, t, first)
        if step == rounds // 2:
            y[bad & (p > 0.9)] = 1.0
        grad_w = x.T @ (y - p) / n - l2 * w
        # Sums over the pairs within chains: observed less expected.
        before, here = y[:-1][within], y[1:][within]
        seen = np.array([[((1 - before) * (1 - here)).sum(), ((1 - before) * here).sum()], [(before * (1 - here)).sum(), (before * here).sum()]])
        grad_t = (seen - pairs[within].sum(axis=0)) / n - l2 * t
        grad = np.concatenate([grad_w, grad_t.ravel()])
        params_m = 0.9 * params_m + 0.1 * grad
        params_v = 0.99 * params_v + 0.01 * grad**2
        move = rate * (params_m / (1 - 0.9**step)) / (np.sqrt(params_v / (1 - 0.99**step)) + 1e-8)
        w, t = w + move[:n_f], np.clip(t + move[n_f:].reshape(2, 2), -4, 4)
    return Chain(w.tolist(), t.tolist())


def calibrate(chain: Chain, rows: list[tuple[float, int]], rounds: int = 200) -> Chain:
    """Fit score = logistic(shift + scale * log odds of the good share) to the labels, scale kept positive."""
    share = np.clip(np.array([r[0] for r in rows]), 1e-6, 1 - 1e-6)
    x, y = np.log(share / (1 - share)), np.array([r[1] for r in rows], float)
    a, b = 1.0, 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        s = p * (1 - p) + 1e-6
        g = np.array([((y - p) * x).sum() - 0.1 * (a - 1), (y - p).sum()])
        h = np.array([[(s * x * x).sum() + 0.1, (s * x).sum()], [(s * x).sum(), s.sum() + 1e-3]])
        step = np.linalg.solve(h, g)
        a, b = max(0.05, a + float(np.clip(step[0], -1, 1))), b + float(np.clip(step[1], -2, 2))
        if abs(step).max() < 1e-6:
            break
    return Chain(chain.weights, chain.moves, a, b)


def fold(id_col: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``."""
    return F.crc32(id_col.cast("string").cast("binary")) % folds


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, usable: Column, rows: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(text, label) of at most ``rows`` labelled documents, those whose ids hash lowest; of documents with one id the text that hashes lowest."""
    chosen = labels.filter(F.col(label).isNotNull() & F.col(id_col).isNotNull() & usable).select(id_col, F.col(label).cast("int").alias("label"))
    chosen = chosen.dropDuplicates([id_col]).orderBy(F.xxhash64(id_col), id_col).limit(rows)
    met = docs.select(id_col, whole(text_col).alias("text")).join(F.broadcast(chosen), id_col)
    return met.groupBy(id_col, "label").agg(F.min_by("text", F.struct(F.xxhash64("text"), F.length("text"))).alias("text")).select("text", "label")


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 5, held: int = 0, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> Chain:
    """Learn from the whole texts of at most ``sample`` labelled rows whose fold isn't ``held``.

    The driver holds one number for each of their lines. Without rows of both labels the chain is indifferent and every score is one half.
    """

    def run(batches):
        for batch in slices(batches):
            rows = [[sum(1 << k for k in f) for f in line_features(t)[0]] for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.int32())), batch.column(1)], names=["lines", "label"])

    rows = labelled_sample(docs, labels, label, fold(F.col(id_col), folds) != held, sample, id_col, text_col)
    told: dict[int, tuple[int, ...]] = {}

    def features(mask: int) -> tuple[int, ...]:
        if mask not in told:
            told[mask] = tuple(k for k in range(len(FEATURES)) if mask >> k & 1)
        return told[mask]

    got = sorted((list(r["lines"]), r["label"]) for r in rows.mapInArrow(run, "lines array<int>, label int").collect() if r["lines"])
    got = [([features(m) for m in lines], label) for lines, label in got]
    if len({label for _, label in got}) < 2:
        return Chain([0.0] * len(FEATURES), [[0.0, 0.0], [0.0, 0.0]])
    chain = train(got)
    sent = docs.sparkSession.sparkContext.broadcast(chain)

    def shares(batches):
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([pa.array([sent.value.good(t) for t in batch.column(0).to_pylist()], pa.float64()), batch.column(1)], names=["share", "label"])

    pairs = sorted((r["share"], r["label"]) for r in rows.mapInArrow(shares, "share double, label int").collect())
    return calibrate(chain, pairs)


def quality(docs: DataFrame, chain: Chain, threshold: float = 0.3, folds: int = 5, held: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted), a row for each row of ``docs``; null and empty texts score as the chain does without lines."""
    sent = docs.sparkSession.sparkContext.broadcast(chain)

    def run(batches):
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([sent.value.score(t) for t in batch.column(2).to_pylist()], pa.float64())], names=["doc_id", "held_out", "score"])

    held_out = F.coalesce(fold(F.col(id_col), folds) == held, F.lit(False))
    scored = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out.alias("held_out"), whole(text_col).alias("text")).mapInArrow(run, "doc_id long, held_out boolean, score double")
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
