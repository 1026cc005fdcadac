"""Toxicity by a weighted finite-state grammar over clauses.

The lexicon is a transducer from words to classes: insult, threat, target, link (articles, copulas and
other small words that tie an insult into a clause), negation, reported speech and mention. It is composed with a transducer that
tracks negation and reported speech, and that with one of the clause patterns; paths add weights and the best path through a
clause tells what it asserts: an insult at a target, an insult that is predicated by links beside it, a threat to a target. A document is scored
by its matched clauses, never by words alone: an insult that stands bare counts nothing, one that is denied or quoted counts for what the training rows show.
"""

from __future__ import annotations

import math
import re
import sys
import zlib
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from .linecrf import fold, labelled_sample
from .shared import slices, whole

SAMPLE = 8_000
INSULT, THREAT, TARGET, NOT, SAID, LINK, OTHER = "insult", "threat", "target", "not", "said", "link", "other"
LEXICON = {
    INSULT: "idiot idiots idiotic moron morons moronic stupid loser losers worthless pathetic disgusting scum trash clown clowns imbecile imbeciles dimwit halfwit dumbass jackass asshole assholes bastard bastards bitch bitches scumbag scumbags lowlife vermin parasite parasites degenerate degenerates cretin cretins filth filthy freak freaks retard retarded coward cowards idiotisch idiotin abschaum dummkopf arschloch trottel idiota idiotas imbécil estúpido estúpida basura escoria imbécile crétin connard salaud ordure débile",
    THREAT: "kill killing murder strangle stab destroy beat punch shoot burn hurt töten umbringen matar matarte tuer frapper",
    TARGET: "you your you're youre yourself u ya he she they him her them these those people everyone du dich ihr euch sie usted ustedes vous toi eres",
    NOT: "not no never n't isn't aren't wasn't weren't don't doesn't didn't nobody nicht kein keine nunca jamás jamais pas",
    SAID: "said says say called calls calling wrote writes claimed claims quoted quote quotes reported reports allegedly sagte schrieb dijo llamó dit écrit",
    LINK: "a an the is are was were be being been so such this that what of and like der die das ein eine ist sind un una el la los las es son une le les de est sont",
}
#: A clause with one of these speaks about a word.
MENTION = frozenset("word words term terms phrase dictionary definition defined means meaning spelled synonym wort wörterbuch palabra diccionario mot dictionnaire".split())
#: Ends of clauses, and words within them.
CLAUSE, WORD = re.compile(r"[.!?;:\n\r…]+"), re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
FAR, BESIDE = 4, 2
KINDS = ["at_target", "predicated", "threat", "denied", "quoted"]
FIRM = KINDS[:3]


@dataclass
class Transducer:
    """Arcs by state and input symbol: (next state, output symbol, weight); ``finals`` gives the weight of ending in a state."""

    arcs: dict = field(default_factory=dict)
    finals: dict = field(default_factory=dict)
    start: object = 0

    def arc(self, state, symbol, to, out, weight: float = 0.0) -> None:
        self.arcs.setdefault(state, {}).setdefault(symbol, []).append((to, out, weight))

    def __matmul__(self, other: Transducer) -> Transducer:
        """Composition: what this puts out is what ``other`` reads; only states that can be reached."""
        made = Transducer(start=(self.start, other.start))
        todo, seen = [made.start], {made.start}
        while todo:
            state = todo.pop()
            a, b = state
            if a in self.finals and b in other.finals:
                made.finals[state] = self.finals[a] + other.finals[b]
            for symbol, ways in self.arcs.get(a, {}).items():
                for to_a, middle, w in ways:
                    for to_b, out, v in other.arcs.get(b, {}).get(middle, ()):
                        made.arc(state, symbol, (to_a, to_b), out, w + v)
                        if (to_a, to_b) not in seen:
                            seen.add((to_a, to_b))
                            todo.append((to_a, to_b))
        return made

    def best(self, symbols: list[str]) -> tuple[float, tuple]:
        """Weight and outputs (nothing left out) of the best path that reads all symbols; ties go to the outputs that sort first."""
        live = {self.start: (0.0, ())}
        for s in symbols:
            after: dict = {}
            for state, (w, outs) in live.items():
                for to, out, v in self.arcs.get(state, {}).get(s, ()):
                    found = (w + v, outs + ((out,) if out else ()))
                    if to not in after or (found[0], found[1]) > after[to]:
                        after[to] = found
            live = after
        ends = [(w + self.finals[s], outs) for s, (w, outs) in live.items() if s in self.finals]
        return max(ends) if ends else (-math.inf, ())


CLASSES = [INSULT, THREAT, TARGET, NOT, SAID, LINK, OTHER]


def scope() -> Transducer:
    """Marks insults and threats that stand within FAR words after a negation, or anywhere after a verb of saying in the clause."""
    t = Transducer(start=(0, False))
    for left in range(FAR + 1):
        for said in (False, True):
            state = (left, said)
            t.finals[state] = 0.0
            nearer = max(0, left - 1)
            for c in CLASSES:
                if c == NOT:
                    t.arc(state, c, (FAR, said), OTHER)
                elif c == SAID:
                    t.arc(state, c, (nearer, True), OTHER)
                elif c in (INSULT, THREAT):
                    mark = "denied" if left else "quoted" if said else c
                    t.arc(state, c, (nearer, said), mark)
                else:
                    t.arc(state, c, (nearer, said), c)
    return t


def patterns() -> Transducer:
    """Reads marked classes; puts out the kind of each assertion.

    A state knows how long ago a target (up to FAR words) and a link (up to BESIDE) stood, and what it waits for: an insult may
    guess that its target or link follows, a threat waits for its target. A path whose guess isn't confirmed in time ends nowhere.
    """
    t = Transducer(start=(0, 0, None))
    todo, seen = [t.start], {t.start}

    def go(state, symbol, to, out, weight=0.0):
        t.arc(state, symbol, to, out, weight)
        if to not in seen:
            seen.add(to)
            todo.append(to)

    def aged(k: int, far: int) -> int:
        return k + 1 if 0 < k < far else 0

    while todo:
        state = todo.pop()
        target, link, wait = state
        guessed = wait is not None and wait[0] != "threat"
        if not guessed:
            t.finals[state] = 0.0
        # What the wait becomes after a word that doesn't end it; a guess that is too old has no way on, a threat is forgotten.
        kind, k = wait or (None, 0)
        old = wait is not None and k + 1 >= (BESIDE if kind == "predicated" else FAR)
        kept = None if old else wait and (kind, k + 1)
        onward = not (guessed and old)
        target_, link_ = aged(target, FAR), aged(link, BESIDE)
        if onward:
            go(state, OTHER, (target_, link_, kept), None)
            go(state, "denied", (target_, link_, kept), "denied", 0.2)
            go(state, "quoted", (target_, link_, kept), "quoted", 0.3)
            go(state, THREAT, (target_, link_, kept if guessed else ("threat", 0)), None)
            go(state, INSULT, (target_, link_, kept), "bare", 0.1)
            if target:
                go(state, INSULT, (target_, link_, kept), "at_target", 2.0)
            if link:
                go(state, INSULT, (target_, link_, kept), "predicated", 1.5)
            if not guessed:
                go(state, INSULT, (target_, link_, ("at_target", 0)), "at_target", 2.0)
                go(state, INSULT, (target_, link_, ("predicated", 0)), "predicated", 1.5)
        if kind == "threat":
            go(state, TARGET, (1, link_, None), "threat", 3.0)
        elif kind == "at_target" or onward:
            go(state, TARGET, (1, link_, None if kind == "at_target" else kept), None)
        if kind == "predicated" or onward:
            go(state, LINK, (target_, 1, None if kind == "predicated" else kept), None)
    return t


GRAMMAR = scope() @ patterns()


def plain_words(text: str) -> list[str]:
    return WORD.findall(text.lower())


@dataclass
class Model:
    """Classes of words, and weights of the clause kinds."""

    classes: dict[str, str]
    weights: list[float] = field(default_factory=lambda: [1.5, 1.2, 1.5, 0.2, 0.3, 1.5, 2.0])
    shift: float = -3.0

    def __post_init__(self) -> None:
        self.triggers = frozenset(w for w, c in self.classes.items() if c in (INSULT, THREAT))
        self.known: dict[tuple, tuple] = {}

    def clause(self, words: list[str]) -> tuple[str, ...]:
        """What a clause asserts, as KINDS and "bare". A clause that speaks about words quotes them."""
        symbols = [self.classes.get(w, OTHER) for w in words]
        struck = [i for i, s in enumerate(symbols) if s in (INSULT, THREAT)]
        # Links only tell beside an insult, and other words let distances grow; more than FAR of them in a row are as good as FAR.
        near = {i + d for i in struck for d in range(-BESIDE, BESIDE + 1)}
        symbols = [OTHER if s == LINK and i not in near else s for i, s in enumerate(symbols)]
        hits = [i for i, s in enumerate(symbols) if s != OTHER]
        short, gap = ([] if MENTION.isdisjoint(words) else [SAID]), 0
        for s in symbols[: hits[-1] + 1] if hits else []:
            gap = gap + 1 if s == OTHER else 0
            if gap <= FAR + 1:
                short.append(s)
        key = tuple(short)
        if key not in self.known:
            if len(self.known) > 20_000:
                self.known.clear()
            self.known[key] = GRAMMAR.best(short)[1] if short else ()
        return self.known[key]

    def features(self, text: str) -> list[float]:
        """Clauses of each kind (log of one more), whether any asserts, and assertions by length; all 0 where no word of the lexicon stands."""
        counts = Counter()
        lowered = text.lower()
        n = 0
        if any_trigger(lowered, self.triggers):
            for clause in CLAUSE.split(lowered):
                words = WORD.findall(clause)
                n += len(words)
                if not self.triggers.isdisjoint(words):
                    counts.update(self.clause(words))
        firm = sum(counts[k] for k in FIRM)
        return [*(math.log1p(counts[k]) for k in KINDS), float(firm > 0), min(1.0, 50.0 * firm / n) if n else 0.0]

    def score(self, text: str) -> float:
        z = self.shift + sum(w * x for w, x in zip(self.weights, self.features(text), strict=True))
        return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, z))))


SEPARATORS = {i: " " for i in range(128) if not chr(i).isalpha()}
ASCII_SPACES = "".join(chr(i) if chr(i).isalpha() else " " for i in range(128))


def any_trigger(lowered: str, triggers: frozenset) -> bool:
    """Whether a trigger word stands in the text; marks beyond ASCII end words as the grammar has it."""
    words = lowered.translate(SEPARATORS).split()
    if not triggers.isdisjoint(words):
        return True
    return not lowered.isascii() and not triggers.isdisjoint(WORD.findall(lowered))


def base_classes() -> dict[str, str]:
    return {w: c for c in (LINK, SAID, NOT, TARGET, THREAT, INSULT) for w in LEXICON[c].split()}


def family(words: set[str]) -> tuple[int, ...]:
    """The two lowest hashes of a text's long words: near copies share them, so a text that was copied often counts once; one word that many texts share doesn't make them a family."""
    return tuple(sorted(zlib.crc32(w.encode()) for w in words if len(w) >= 6)[:2]) or (zlib.crc32(" ".join(sorted(words)).encode()),)


def learn(rows: list[tuple[str, int]], least: int = 5, ratio: float = 30.0, rounds: int = 100, l2: float = 0.3, common: float = 0.05) -> Model:
    """Insults that the fixed list lacks, by how much likelier they are in toxic rows, and links, short words that many rows hold; then the clause weights by logistic regression.

    A word of at most five letters is a link if a share of ``common`` of the rows or more hold it. A word is added as an insult if at least ``least`` families of toxic rows hold it and its smoothed rate there is ``ratio`` times that elsewhere.
    """
    classes = base_classes()
    groups: tuple[dict, dict] = ({}, {})
    short = Counter()
    for text, y in rows:
        words = {sys.intern(w) for w in plain_words(text)}
        short.update(w for w in words if len(w) <= 5)
        words = {w for w in words if len(w) >= 4}
        groups[int(bool(y))].setdefault(family(words), set()).update(words)
    n_toxic, n_clean = sum(1 for _, y in rows if y), sum(1 for _, y in rows if not y)
    clean, toxic = (Counter(w for words in g.values() for w in words) for g in groups)
    for w, k in toxic.items():
        rate, other = (k + 0.1) / (len(groups[1]) + 1), (clean[w] + 0.1) / (len(groups[0]) + 1)
        if k >= least and rate >= ratio * other and w not in classes:
            classes[w] = INSULT
    for w, k in short.items():
        if k >= max(least, common * len(rows)):
            classes.setdefault(w, LINK)
    model = Model(classes)
    if not n_toxic or not n_clean:
        return model
    x = np.array([model.features(t) for t, _ in rows])
    y = np.array([float(label) for _, label in rows])
    x1 = np.hstack([x, np.ones((len(x), 1))])
    prior = np.array([*model.weights, model.shift])
    w = prior.copy()
    keep = np.array([l2] * x.shape[1] + [0.01])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        g = x1.T @ (y - p) - keep * (w - prior)
        h = (x1 * (p * (1 - p))[:, None]).T @ x1 + np.diag(keep)
        step = np.linalg.solve(h, g)
        w += np.clip(step, -1, 1)
        if abs(step).max() < 1e-8:
            break
    return Model(classes, w[:-1].tolist(), float(w[-1]))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 3, held: int = 1, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Learn from at most ``sample`` labelled rows whose fold isn't ``held``.

    The driver holds the sample's texts, no more than ``sample`` at any size of the corpus. Without labelled rows the fixed lexicon and weights hold.
    """
    rows = labelled_sample(docs, labels, label, fold(F.col(id_col), folds) != held, sample, id_col, text_col)
    return learn(sorted((r["text"], r["label"]) for r in rows.collect()))


def toxicity(docs: DataFrame, model: Model, threshold: float = 0.7, folds: int = 3, held: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted), a row for each row of ``docs``; null and empty texts assert nothing."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([sent.value.score(t) for t in batch.column(2).to_pylist()], pa.float64())], names=["doc_id", "held_out", "score"])

    held_out = F.coalesce(fold(F.col(id_col), folds) == held, F.lit(False))
    scored = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out.alias("held_out"), whole(text_col).alias("text")).mapInArrow(run, "doc_id long, held_out boolean, score double")
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def judged(docs: DataFrame, model: Model, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with ``predicted`` of each row's own text beside all columns."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in slices(batches):
            said = [int(sent.value.score(t or "") >= threshold) for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(said, pa.int32())], names=[*batch.schema.names, "predicted"])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("predicted", IntegerType())]))
