"""Phrase collocations: n-grams as rows, counted per language, scored against their parts, longer ones before shorter.

Texts are cut into pieces at punctuation and line ends and these into words at spaces and tabs; only A-Z are lower-cased.
``counts`` explodes the 1..max_n-grams of all texts into rows (lang, phrase, n) level by level, each task adding up
equal rows of a batch before they are shuffled. From the second level on it leaves out n-grams that cannot reach ``least``,
since one of their parts doesn't: which parts do is known from a bitmap of fixed size that the level before gives. A clash in
the bitmap only means rows more, so all counts of ``least`` or more are exact.

Awkward rows: a null lang is ``und``, null texts are empty, repeated rows count each time, empty tables give no rows. A text is
read in stretches, so its length is bounded by what an Arrow value holds. Other columns are left behind.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut, partitions, slices, table_of_bits

#: Ends of pieces, fixed by the contract of op 12; a line end stands for all of them below.
ENDS = b".,;:!?\x0a\x0b\x0c\x0d"
#: A-Z to a-z, ends of pieces to a line end, tabs to spaces. Bytes of other characters stay.
FOLD = bytes(10 if b in ENDS else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Words taken together before equal n-grams are added up; bytes split at a time; bits of a bitmap.
BATCH_WORDS, STRETCH, BITS = 1 << 20, 1 << 20, 1 << 27
GRAMS = "lang string, phrase string, n long"


class Words(dict):
    """Numbers of words, from 1 in the order met; 0 is the end of a piece, -1 nothing."""

    def __init__(self):
        super().__init__({b"\n": 0, b"": -1})
        self.known: list[bytes] = [b"\n"]

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self.known)
        self.known.append(word)
        return n

    def numbered(self, text: bytes) -> list[np.ndarray]:
        """The text's words, with 0 between pieces and at its end."""
        text = text.translate(FOLD)
        found, at = [], 0
        while at < len(text):
            to = at + STRETCH
            if to < len(text):
                ends = [x for x in (text.find(b" ", to), text.find(b"\n", to)) if x >= 0]
                to = min(ends, default=len(text))
            split = text[at:to].replace(b"\n", b" \n ").split(b" ")
            ids = np.fromiter(map(self.__getitem__, split), np.int32, len(split))
            found.append(ids[ids >= 0])
            at = to
        return [*found, np.zeros(1, np.int32)]


def word_hashes(lang: str, words: list[bytes]) -> np.ndarray:
    seed, of = xxhash.xxh3_64_intdigest(lang.encode()), xxhash.xxh3_64_intdigest
    return np.array([of(w, seed) for w in words], np.uint64)


def longer(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hashes of phrases one word longer, from those of their first words and of the last word."""
    with np.errstate(over="ignore"):
        x = (left ^ (right + np.uint64(0x9E3779B97F4A7C15) + (left << np.uint64(6)) + (left >> np.uint64(2)))) * np.uint64(0xFF51AFD7ED558CCD)
        return x ^ (x >> np.uint64(33))


def places(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(7)) % np.uint64(bits)


def exploded(n: int, allowed, bits: int):
    """For ``mapInArrow`` over (lang, text): rows (lang, phrase, n) of the n-grams, equal ones of a batch added up.

    ``allowed`` is a broadcast bitmap of the (n - 1)-grams that occur often enough, None for the first level.
    """

    def counted(known: pa.Array, lang: str, ids: np.ndarray, hashes: np.ndarray) -> pa.RecordBatch:
        if n == 1:
            total = np.bincount(ids, minlength=len(known))
            total[0] = 0
            got = np.flatnonzero(total)
            phrases, counts = known.take(pa.array(got)), total[got]
        else:
            many, starts = len(ids) - n + 1, np.zeros(0, np.int64)
            if many > 0:
                # The hash of the n - 1 words from each place on, and whether they are in one piece and often enough.
                part, whole = hashes[ids], ids > 0
                for k in range(1, n - 1):
                    part = longer(part[: len(ids) - k], hashes[ids[k:]])
                    whole = whole[:-1] & (ids[k:] > 0)
                at = places(part, bits)
                often = whole & ((allowed.value[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)
                starts = np.flatnonzero(often[:many] & often[1 : many + 1])
            key, firsts = ids[starts].astype(np.int64), starts
            for k in range(1, n):
                key, at, back = np.unique(key * len(known) + ids[starts + k], return_index=True, return_inverse=True)
                firsts, key = starts[at], back.astype(np.int64)
            counts = np.bincount(key, minlength=len(firsts))
            cols = [known.take(pa.array(ids[firsts + k])) for k in range(n)]
            phrases = pa.compute.binary_join_element_wise(*cols, b" ")
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(counts), pa.string()), phrases.cast(pa.string()), pa.array(counts.astype(np.int64))], ["lang", "phrase", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, held, size = Words(), {}, 0

        def flush() -> Iterator[pa.RecordBatch]:
            known = pa.array(words.known, pa.binary())
            for lang, parts in held.items():
                ids, hashes = np.concatenate(parts), np.zeros(len(known), np.uint64)
                if n > 1:
                    used = np.flatnonzero(np.bincount(ids))
                    hashes[used] = word_hashes(lang, [words.known[i] for i in used.tolist()])
                yield counted(known, lang, ids, hashes)

        for batch in slices(batches, 64):
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if text.is_valid:
                    for ids in words.numbered(text.as_buffer().to_pybytes()):
                        held.setdefault("und" if lang is None else lang, []).append(ids)
                        size += len(ids)
            if size >= BATCH_WORDS:
                yield from flush()
                words, held, size = Words(), {}, 0
        yield from flush()

    return run


def counts(docs: DataFrame, max_n: int = 3, least: int = 10, bits: int = BITS) -> list[DataFrame]:
    """For n from 1 to ``max_n``: (lang, phrase, n), all words, and of longer phrases those with ``least`` or more."""
    spark = docs.sparkSession
    texts = docs.select("lang", "text")
    levels, allowed = [], None
    for n in range(1, max_n + 1):
        rows = texts.mapInArrow(exploded(n, allowed, bits), GRAMS)
        added = rows.groupBy("lang", "phrase").agg(F.sum("n").alias("n"))
        levels.append(cut(added if n == 1 else added.filter(F.col("n") >= least)))
        if n < max_n:
            allowed = spark.sparkContext.broadcast(bitmap(levels[-1].filter(F.col("n") >= least), bits))
    return levels


def bitmap(grams: DataFrame, bits: int) -> np.ndarray:
    """A bit for each phrase's hash, ``bits`` in all whatever the number of rows; so it may go through the driver."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4096):
            out = []
            for lang, phrase in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = word_hashes(lang, phrase.encode().split(b" "))
                first = words[:1]
                for k in range(1, len(words)):
                    first = longer(first, words[k : k + 1])
                out.append(int(places(first, bits)[0]))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64())], ["place"])

    return table_of_bits(grams.select("lang", "phrase").mapInArrow(hashed, "place long"), "place", bits)


def score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 a a / (left right)) in decimals of 38 digits; ``a`` is at most ``left`` and ``right``, so the result is a long."""
    whole = lambda c: c.cast("decimal(16,0)")
    return F.call_function("div", F.lit(1_000_000).cast("decimal(7,0)") * (whole(a) * whole(a)).cast("decimal(32,0)"), (whole(left) * whole(right)).cast("decimal(32,0)"))


def collocations(docs: DataFrame, max_n: int = 3, least: int = 10, absorbed: int = 50, top: int = 2_000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases of 2 to ``max_n`` words by score, a, phrase.

    A phrase is scored at the cut that gives least. It is dropped if a phrase one word longer that holds it occurs at least
    ``absorbed`` percent as often: a longer one still lies in such a phrase, which occurs no less.
    """
    levels = counts(docs, max_n, least)
    every = levels[0]
    for level in levels[1:]:
        every = every.unionByName(level)
    known = cut(every.filter(F.col("n") >= least))
    words = levels[0].groupBy("lang").agg(F.sum("n").alias("n"))
    size = F.size(F.split("phrase", " "))
    found = known.select("lang", "phrase", F.col("n").alias("a")).filter(F.contains("phrase", F.lit(" ")))
    part = lambda start, n: F.array_join(F.slice(F.split("phrase", " "), start, n), " ")
    cuts = found.withColumn("k", F.explode(F.sequence(F.lit(1), size - 1))).select("*", part(F.lit(1), F.col("k")).alias("first"), part(F.col("k") + 1, size - F.col("k")).alias("rest"))
    side = lambda name, n: known.select("lang", F.col("phrase").alias(name), F.col("n").alias(n))
    scored = cuts.join(side("first", "l"), ["lang", "first"]).join(side("rest", "r"), ["lang", "rest"]).withColumn("score", score(F.col("a"), F.col("l"), F.col("r")))
    best = scored.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("best")).select("lang", "phrase", "a", "best.l", "best.r", "best.score")
    ends = F.explode(F.array(part(F.lit(1), size - 1), part(F.lit(2), size - 1)))
    extended = found.filter(size > 2).select("lang", ends.alias("phrase"), F.col("a").alias("b")).groupBy("lang", "phrase").agg(F.max("b").alias("b"))
    kept = best.alias("x").join(extended.alias("y"), (F.col("x.lang") == F.col("y.lang")) & (F.col("x.phrase") == F.col("y.phrase")) & (100 * F.col("y.b") >= absorbed * F.col("x.a")), "left_anti")
    # A language may hold most phrases: each of many parts gives its own best before they meet.
    order = [F.col("score").desc(), F.col("a").desc(), "phrase"]
    ranked = lambda df, *by: df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= top)
    parts = ranked(kept.withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(partitions(docs.sparkSession)))), "lang", "_part")
    last = ranked(parts.drop("rank"), "lang").join(F.broadcast(words), "lang")
    return last.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
