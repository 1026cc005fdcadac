"""Ranked lexical search: a tree of maxima over ranges of documents for each term, searched best first.

``index`` deals documents into shards where they lie, by order of reading, and leaves a row for each shard and term with the
documents that hold it. ``search`` gives every node of a shard's tree (ranges of 8, 64, 512, ... documents) the largest
impact that each term has in it; an item's bound for a node is the sum of weight times impact over its terms. Of all nodes
the one with the highest bound is opened next, until no bound reaches the k-th best score; nodes that equal it are opened,
as they may hold a tie with a smaller id. Shards are searched by themselves, then each item's best rows are ranked.

Awkward rows: null and empty texts have no terms and are never found; a null doc_id counts in the statistics and sorts after
every id; repeated rows are documents (or items) of their own, so repeated items have results each; items without terms and empty
tables give no rows. Texts are read in stretches. Other columns are left behind.
"""

from __future__ import annotations

import heapq
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut, few_broadcast, remove, shared_folder, slices

#: By byte: what ends a term (fixed by the contract of op 13) is a space, A-Z are a-z, all else stays.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
#: Documents and postings of a shard at most (the document that passes it is the last), children of a node, items searched together, bytes split at a time.
SHARD, POSTINGS, FAN, BLOCK, STRETCH = 8**4, 2_000_000, 8, 128, 1 << 20
#: Terms of the items that tasks may be given to look for; beyond it all terms are indexed and joined.
BROADCAST_TERMS = 500_000
INDEX = "shard string, term string, pos array<int>, tf array<int>, doc_ids array<long>, sizes array<long>"
FOUND = "key long, doc_id long, score long"


def terms(text: bytes) -> Iterator[list[bytes]]:
    """The text's terms in order, a stretch at a time."""
    text, at = text.translate(FOLD), 0
    while at < len(text):
        to = text.find(b" ", at + STRETCH)
        to = len(text) if to < 0 else to
        yield text[at:to].split()
        at = to


class Shard:
    """Postings of some documents, read one after another."""

    def __init__(self):
        self.ids: list[int | None] = []
        self.sizes: list[int] = []
        self.held: dict[bytes, tuple[array, array]] = {}
        self.postings = 0

    def add(self, doc_id: int | None, text: bytes, wanted: frozenset[bytes] | None) -> None:
        tf: Counter = Counter()
        n = 0
        for found in terms(text):
            n += len(found)
            tf.update(found if wanted is None else filter(wanted.__contains__, found))
        for term, count in tf.items():
            pos, counts = self.held.setdefault(term, (array("i"), array("i")))
            pos.append(len(self.ids))
            counts.append(count)
        self.ids.append(doc_id)
        self.sizes.append(n)
        self.postings += len(tf)

    def rows(self, name: str) -> pa.RecordBatch:
        """A row with ids and sizes of the documents, then one for each term."""
        count = len(self.held)
        ends = np.cumsum([0, 0, *(len(p) for p, _ in self.held.values())]).astype(np.int32)
        lists = lambda which: pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int32), *(np.frombuffer(x[which], np.int32) for x in self.held.values())])))
        about = lambda values: pa.array([values, *[None] * count], pa.list_(pa.int64()))
        named = pa.array([None, *(t.decode("utf-8", "replace") for t in self.held)], pa.string())
        return pa.RecordBatch.from_arrays([pa.array([name] * (count + 1)), named, lists(0), lists(1), about(self.ids), about(self.sizes)], ["shard", "term", "pos", "tf", "doc_ids", "sizes"])


def index(docs: DataFrame, wanted: frozenset[bytes] | None = None) -> DataFrame:
    """``INDEX`` of documents (doc_id, text), of all terms or of the ``wanted``. Nothing is shuffled: a shard is what a task reads in a row."""
    given = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made, shard = TaskContext.get().partitionId(), 0, Shard()
        for batch in slices(batches, 64):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                shard.add(doc_id, text.as_buffer().to_pybytes() if text.is_valid else b"", given.value)
                if len(shard.ids) >= SHARD or shard.postings >= POSTINGS:
                    yield shard.rows(f"{part}-{made}")
                    made, shard = made + 1, Shard()
        if shard.ids:
            yield shard.rows(f"{part}-{made}")

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, INDEX)


def asked(items: DataFrame) -> DataFrame:
    """(key, item_id, term): the terms of each item row, once each. ``key`` numbers the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            out: list[tuple] = []
            for key, item, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = {t for part in terms((text or "").encode()) for t in part}
                out += [(key, item, t.decode("utf-8", "replace")) for t in sorted(found)]
            cols = list(zip(*out, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string())], ["key", "item_id", "term"])

    keyed = cut(items.select(F.col("item_id").cast("long").alias("item_id"), "text").withColumn("key", F.monotonically_increasing_id()))
    return keyed.select("key", "item_id", "text").mapInArrow(run, "key long, item_id long, term string")


class Tree:
    """A shard: the largest impact of each term in each range of documents, and the postings in order of documents."""

    def __init__(self, docs: int, term: np.ndarray, pos: np.ndarray, impact: np.ndarray, n_terms: int):
        width = FAN
        while width < docs:
            width *= FAN
        lowest = np.zeros((n_terms, width // FAN), np.int64)
        if len(term):
            node = term * (width // FAN) + pos // FAN  # ascending: terms one after another, each by place
            first = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
            lowest.reshape(-1)[node[first]] = np.maximum.reduceat(impact, first)
        #: From ranges of FAN documents up to the root.
        self.levels = [lowest]
        while self.levels[-1].shape[1] > 1:
            self.levels.append(self.levels[-1].reshape(n_terms, -1, FAN).max(axis=2))
        order = np.argsort(pos, kind="stable")
        self.term, self.pos, self.impact = term[order], pos[order], impact[order]
        self.starts = np.searchsorted(self.pos, np.arange(0, width + 1, FAN))

    def best(self, own: np.ndarray, weights: np.ndarray, ids: list[int | None], k: int) -> list[tuple[int, int]]:
        """(score, place) of the k best documents for the terms ``own``, ties by id; only scores above 0."""
        dense = np.zeros(self.levels[0].shape[0], np.int64)
        dense[own] = weights
        top = len(self.levels) - 1
        open_nodes = [(-int(self.levels[top][own, 0] @ weights), top, 0)]
        found: list[tuple] = []  # a heap, the worst in front
        while open_nodes:
            bound, level, node = heapq.heappop(open_nodes)
            if not bound or (len(found) == k and -bound < found[0][0]):
                break
            if level:
                below = self.levels[level - 1][own, node * FAN : (node + 1) * FAN]
                for child, b in enumerate((weights @ below).tolist()):
                    if b and (len(found) < k or b >= found[0][0]):
                        heapq.heappush(open_nodes, (-b, level - 1, node * FAN + child))
                continue
            at = slice(self.starts[node], self.starts[node + 1])
            scores = np.zeros(FAN, np.int64)
            np.add.at(scores, self.pos[at] - node * FAN, dense[self.term[at]] * self.impact[at])
            for child, score in enumerate(scores.tolist()):
                if score:
                    place = node * FAN + child
                    one = (score, ids[place] is not None, -(ids[place] or 0), place)
                    if len(found) < k:
                        heapq.heappush(found, one)
                    elif one > found[0]:
                        heapq.heapreplace(found, one)
        return [(score, place) for score, _, _, place in found]


def searched(n_docs: int, n_terms: int, k: int):
    """For ``applyInArrow`` over a shard's rows and a block of items: the k best documents of the shard for each item."""

    def run(rows: pa.Table) -> pa.Table:
        head = rows.filter(pa.compute.is_null(rows["term"])).slice(0, 1)
        ids, sizes = head["doc_ids"][0].as_py(), np.array(head["sizes"][0].as_py(), np.int64)
        held = rows.filter(pa.compute.is_valid(rows["term"])).combine_chunks()
        flat = lambda name: (held[name].combine_chunks().flatten().to_numpy(), pa.compute.list_value_length(held[name]).to_numpy())
        (pos, lengths), (tf, _), (keys, wanted_by) = flat("pos"), flat("tf"), flat("keys")
        tf, pos, term = tf.astype(np.int64), pos.astype(np.int64), np.repeat(np.arange(held.num_rows), lengths)
        m = 100 - 90 + (90 * sizes * n_docs) // max(n_terms, 1)
        tree = Tree(len(ids), term, pos, (1_000_000_000 * tf) // (1000 * tf + 8 * m[pos]), held.num_rows)
        own = np.repeat(np.arange(held.num_rows), wanted_by)
        order = np.argsort(keys, kind="stable")
        keys, own, weights = keys[order], own[order], held["w"].to_numpy()[own[order]]
        out: list[tuple] = []
        edges = [*np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])).tolist(), len(keys)] if len(keys) else []
        for a, b in zip(edges, edges[1:], strict=False):
            out += [(int(keys[a]), ids[place], score) for score, place in tree.best(own[a:b], weights[a:b], ids, k)]
        cols = list(zip(*out, strict=True)) or [(), (), ()]
        return pa.table({name: pa.array(c, pa.int64()) for name, c in zip(("key", "doc_id", "score"), cols, strict=True)})

    return run


def search(made: DataFrame, wanted: DataFrame, k: int = 10) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of an ``index`` for each item of ``asked``, by score, then doc_id.

    Items are dealt into blocks, and each block meets each shard in a task of its own: the rows of the terms that it asks for.
    """
    heads = made.filter("term is null")
    n_docs, n_terms = heads.agg(F.sum(F.size(F.filter("sizes", lambda n: n > 0))).alias("docs"), F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, n: a + n))).first()
    if not n_terms:
        return made.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    weight = F.floor(1000 * F.log((2 * F.lit(n_docs) + 2).cast("double") / (2 * F.col("df") + 1).cast("double"))).cast("long")
    df = made.filter("term is not null").groupBy("term").agg(F.sum(F.size("pos")).alias("df"))
    blocks = -(-wanted.select("key").distinct().count() // BLOCK) or 1
    wants = wanted.select("term", "key", F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int").alias("block"))
    vocabulary = cut(wants.groupBy("term", "block").agg(F.collect_list("key").alias("keys")).join(df, "term").select("term", "block", "keys", weight.alias("w")).filter("w > 0"))
    met = made.filter("term is not null").join(few_broadcast(vocabulary), "term").select(*made.columns, "block", "keys", "w")
    everywhere = heads.select(*made.columns, F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(None).cast("array<long>").alias("keys"), F.lit(None).cast("long").alias("w"))
    found = met.unionByName(everywhere).groupBy("shard", "block").applyInArrow(searched(n_docs, n_terms, k), FOUND)
    best = Window.partitionBy("key").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.join(few_broadcast(cut(wanted.select("key", "item_id").distinct())), "key").select("item_id", "rank", "doc_id", "score")


def ranked(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """Index and search in one: only the items' terms are indexed, if there are no more than ``BROADCAST_TERMS``."""
    spark = docs.sparkSession
    wanted = cut(asked(items))
    distinct = wanted.select("term").distinct()
    few = distinct.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS
    only = frozenset(r["term"].encode() for r in distinct.toLocalIterator()) if few else None
    folder = shared_folder(spark)
    index(docs, only).write.parquet(folder)
    found = cut(search(spark.read.schema(INDEX).parquet(folder), wanted, k))
    remove(spark, folder)
    return found
