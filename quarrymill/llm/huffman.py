"""Token ids in canonical, length-limited Huffman blocks, coded from counts over the whole corpus.

A block is independent: it names its documents and their lengths, and has a bit offset for
every ``STEP`` ids, so that a table-driven decoder reads all stretches of a block side by side.

    block: "CHF1", then little-endian u32 documents, u32 ids, u64 bits, u64 first id's place in its part,
           i64 per document's id, u32 per document's length, u64 per checkpoint, then the bits, highest first

Blocks are written by Spark as rows (part, seq, block) in order of ``doc_id``, so a task that
is run again writes its part again and nothing else.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import PATTERN
from .pieces import Pieces, by_bytes
from .shared import partitions, remove, shared_folder, slices, whole, whole_strings

LIMIT, STEP, BLOCK_IDS = 16, 256, 1 << 18
HEAD = "<4sIIQQ"
#: Stands for a missing id in a block.
NO_ID = -(1 << 63)


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Lengths of an optimal prefix code with no code longer than ``limit``, by package-merge; 0 where the count is 0."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << limit:
        raise ValueError("more ids than codes of the allowed length")
    order = used[np.argsort(counts[used], kind="stable")]
    weights = counts[order].astype(np.int64)
    n = len(order)
    # Each level holds the coins in order of weight; which of them are packages says how the cut above falls below.
    level, packaged = weights, []
    for _ in range(limit - 1):
        pairs = level[: len(level) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([weights, pairs])
        sort = np.argsort(both, kind="stable")
        packaged.append(sort >= n)
        level = both[sort]
    take = 2 * n - 2
    depth = np.zeros(n + 1, np.int64)
    for is_package in reversed(packaged):
        packages = int(is_package[:take].sum())
        depth[take - packages] += 1
        take = 2 * packages
    depth[take] += 1
    # Of the k cheapest ids taken at a level, each gets one bit more.
    lengths[order] = np.cumsum(depth[::-1])[::-1][1:]
    return lengths


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes by length, then id."""
    codes = np.zeros(len(lengths), np.uint64)
    code = before = 0
    for i in sorted(np.flatnonzero(lengths).tolist(), key=lambda i: (lengths[i], i)):
        code <<= int(lengths[i]) - before
        codes[i] = code
        code, before = code + 1, int(lengths[i])
    return codes


def decoding_table(lengths: np.ndarray, limit: int = LIMIT) -> tuple[np.ndarray, np.ndarray]:
    """By the next ``limit`` bits: the id and its length; length 0 where no code begins so."""
    ids, sizes = np.zeros(1 << limit, np.uint32), np.zeros(1 << limit, np.uint8)
    at = 0
    for i in sorted(np.flatnonzero(lengths).tolist(), key=lambda i: (lengths[i], i)):
        n = 1 << (limit - int(lengths[i]))
        ids[at : at + n], sizes[at : at + n] = i, lengths[i]
        at += n
    return ids, sizes


def pack(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, int, np.ndarray]:
    """The bits, how many, and the offset of every STEP-th id. Each code is added into two 32-bit words of its place."""
    if not len(ids):
        return b"", 0, np.zeros(0, np.uint64)
    size = lengths[ids].astype(np.uint64)
    if not size.all():
        raise ValueError("an id has no code")
    end = np.cumsum(size)
    start = end - size
    word = (start >> np.uint64(5)).astype(np.int64)
    placed = codes[ids] << (np.uint64(64) - size - (start & np.uint64(31)))
    first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
    words = np.zeros(int(end[-1]) // 32 + 2, np.uint64)
    words[word[first]] = np.add.reduceat(placed >> np.uint64(32), first)
    words[word[first] + 1] += np.add.reduceat(placed & np.uint64(0xFFFFFFFF), first)
    bits = int(end[-1])
    return words.astype(">u4").tobytes()[: (bits + 7) // 8], bits, start[::STEP]


def unpack(data: bytes, n: int, marks: np.ndarray, table: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The n ids, read side by side from each checkpoint."""
    values, sizes = table
    out = np.zeros((STEP, len(marks)), np.uint32)
    if not n:
        return out.reshape(-1)[:0]
    raw = np.frombuffer(data + b"\0\0\0\0", np.uint8).astype(np.uint32)
    window = (raw[:-2] << np.uint32(16)) | (raw[1:-1] << np.uint32(8)) | raw[2:]
    at = marks.astype(np.int64)
    last = n - STEP * (len(marks) - 1)
    for k in range(min(STEP, n)):
        if k == last:
            at = at[:-1]
        if not len(at):
            break
        if int(at[-1]) >= 8 * len(data):
            raise ValueError("the bits of a block end early")
        code = (window[at >> 3] >> (8 - (at & 7)).astype(np.uint32)) & np.uint32(0xFFFF)
        size = sizes[code]
        if not size.all():
            raise ValueError("bits that no code begins with")
        out[k, : len(at)] = values[code]
        at = at + size
    return out.T.reshape(-1)[:n]


def write_block(docs: list[int | None], sizes: list[int], ids: np.ndarray, first: int, codes: np.ndarray, lengths: np.ndarray) -> bytes:
    data, bits, marks = pack(ids, codes, lengths)
    return b"".join(
        (struct.pack(HEAD, b"CHF1", len(docs), len(ids), bits, first), np.array([NO_ID if d is None else d for d in docs], "<i8").tobytes(), np.array(sizes, "<u4").tobytes(), marks.astype("<u8").tobytes(), data)
    )


def read_block(block: bytes, table: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, int, np.ndarray]:
    """Documents, their lengths, the place of the first id in its part, all ids."""
    magic, n_docs, n, bits, first = struct.unpack_from(HEAD, block)
    if magic != b"CHF1":
        raise ValueError("not a block")
    at = struct.calcsize(HEAD)
    docs = np.frombuffer(block, "<i8", n_docs, at)
    sizes = np.frombuffer(block, "<u4", n_docs, at := at + 8 * n_docs)
    n_marks = -(-n // STEP)
    marks = np.frombuffer(block, "<u8", n_marks, at := at + 4 * n_docs)
    at += 8 * n_marks
    if int(sizes.sum()) != n or len(block) - at != (bits + 7) // 8:
        raise ValueError("lengths of a block disagree")
    return docs, sizes, first, unpack(block[at:], n, marks, table)


class Tokens:
    """The ids of whole texts from the tokenizers library, asked once for each pre-token that wasn't met lately.

    Strings of added tokens within a text are what the library makes of them: with ``special_as_text`` ordinary text, else their ids.
    """

    kept: dict[tuple[str, bool], Tokens] = {}

    def __init__(self, model: str, special_as_text: bool = False) -> None:
        import json

        import regex
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(model)
        self.library.encode_special_tokens = special_as_text
        self.kind = np.uint16 if self.library.get_vocab_size() < 1 << 16 else np.uint32
        plain = json.loads(model)
        added = plain.get("added_tokens") or []
        # Cutting a text is exact where the library itself cuts there and changes nothing before it, added tokens included.
        before = plain.get("pre_tokenizer") or {}
        byte_level = before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space")
        apart = all(not (t["lstrip"] or t["rstrip"] or t["single_word"] or re.search(r"\s|\w[,.;:!?]", t["content"])) for t in added)
        self.cuts = plain.get("normalizer") is None and byte_level and apart
        names = [t["content"] for t in added]
        # The scripts up to here are cut into words the same way by every version of Unicode; other pieces are left to the library.
        settled = re.compile("[\0-\u024f]*").fullmatch
        self.pieces = Pieces(self.words, regex.compile(PATTERN).findall, self.kind, lambda p: settled(p) is not None and not any(n in p for n in names), most=1_000_000)

    def words(self, texts: list[str]) -> list[bytes]:
        code = "H" if self.kind is np.uint16 else "I"
        return [array(code, e.ids).tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        return self.pieces.encode(texts) if self.cuts else [np.frombuffer(w, self.kind) for w in self.words(texts.to_pylist())]

    @classmethod
    def of(cls, model: str, special_as_text: bool = False) -> Tokens:
        key = hashlib.sha256(model.encode()).hexdigest(), special_as_text
        if key not in cls.kept:
            cls.kept.clear()
            cls.kept[key] = cls(model, special_as_text)
        return cls.kept[key]


def token_ids(docs: DataFrame, tokenizer_path: str, end_id: int | None = 0, id_col: str = "doc_id", text_col: str = "text", special_as_text: bool = False) -> DataFrame:
    """(doc_id, ids, id, n): little-endian ids of each whole text and the end id, 2 bytes each if the vocabulary allows, else 4.

    Each task adds one row whose ``ids`` is null: how often (``n``) which ``id`` occurred in its rows.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        sent = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the other cores have tasks of their own
        tokens = Tokens.of(sent.value, special_as_text)
        names, lists = ["doc_id", "ids", "id", "n"], (pa.list_(pa.int64()), pa.list_(pa.int64()))
        tail, total = np.array([] if end_id is None else [end_id], tokens.kind), np.zeros(0, np.int64)
        for batch in by_bytes(batches):
            ids = [np.concatenate([i, tail]) for i in tokens.encode(whole_strings(batch.column(1)))]
            seen = np.bincount(np.concatenate(ids)) if ids else total[:0]
            if len(seen) > len(total):
                seen, total = total, seen
            total[: len(seen)] += seen
            nothing = [pa.nulls(len(ids), kind) for kind in lists]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([i.tobytes() for i in ids], pa.binary()), *nothing], names=names)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([used], lists[0]), pa.array([total[used]], lists[1])], names=names)

    kinds = "doc_id long, ids binary, id array<long>, n array<long>"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), whole(text_col).alias("text")).mapInArrow(run, kinds)


def id_width(tokenizer_path: str) -> int:
    from tokenizers import Tokenizer

    return 2 if Tokenizer.from_file(tokenizer_path).get_vocab_size() < 1 << 16 else 4


def id_counts(ids: DataFrame) -> np.ndarray:
    """How often each id occurs in the whole corpus, from the rows of counts; one row per id of the vocabulary reaches the driver."""
    each = ids.filter("ids is null").select(F.explode(F.arrays_zip("id", "n")).alias("c")).groupBy("c.id").agg(F.sum("c.n").alias("n"))
    rows = each.collect()
    counts = np.zeros(max((r["id"] for r in rows), default=-1) + 1, np.int64)
    for r in rows:
        counts[r["id"]] = r["n"]
    return counts


def encode_blocks(ids: DataFrame, lengths: np.ndarray, width: int, block_ids: int = BLOCK_IDS) -> DataFrame:
    """(part, seq, n_ids, block): blocks of whole documents, dealt by ranges of ``doc_id`` and in its order within a part."""
    spark = ids.sparkSession
    sent = spark.sparkContext.broadcast((lengths, canonical(lengths)))

    def run(batches):
        from pyspark import TaskContext

        lengths, codes = sent.value
        part, seq, first = TaskContext.get().partitionId(), 0, 0
        docs: list[int | None] = []
        held: list[np.ndarray] = []

        def flush():
            nonlocal seq, first
            values = np.concatenate(held) if held else np.zeros(0, np.uint32)
            block = write_block(docs, [len(h) for h in held], values, first, codes, lengths)
            row = pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int64()), pa.array([len(values)], pa.int64()), pa.array([block], pa.binary())], names=["part", "seq", "n_ids", "block"])
            seq, first = seq + 1, first + len(values)
            docs.clear()
            held.clear()
            return row

        n = 0
        for batch in slices(batches):
            for doc, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                docs.append(doc)
                held.append(np.frombuffer(data, f"<u{width}").astype(np.uint32))
                n += len(held[-1])
                if n >= block_ids:
                    yield flush()
                    n = 0
        if docs:
            yield flush()

    dealt = ids.repartitionByRange(partitions(spark), "doc_id").sortWithinPartitions("doc_id")
    return dealt.mapInArrow(run, "part int, seq long, n_ids long, block binary")


def decode_blocks(blocks: DataFrame, lengths: np.ndarray, row: Callable[[np.ndarray], object], kind: pa.DataType, sql_kind: str) -> DataFrame:
    """(part, doc_id, own_start, n_tokens, value): from each block's bytes, ``row`` of each document's ids."""
    sent = blocks.sparkSession.sparkContext.broadcast(lengths)

    def run(batches) -> Iterator[pa.RecordBatch]:
        table = decoding_table(sent.value)
        for batch in slices(batches, 1):
            for part, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                docs, sizes, first, ids = read_block(block, table)
                ends = np.cumsum(sizes, dtype=np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([part] * len(docs), pa.int32()),
                        pa.array(docs, pa.int64(), mask=docs == NO_ID),
                        pa.array(ends - sizes + first, pa.int64()),
                        pa.array(sizes.astype(np.int64), pa.int64()),
                        pa.array([row(ids[e - s : e]) for s, e in zip(sizes.tolist(), ends.tolist(), strict=True)], kind),
                    ],
                    names=["part", "doc_id", "own_start", "n_tokens", "value"],
                )

    return blocks.select("part", "block").mapInArrow(run, f"part int, doc_id long, own_start long, n_tokens long, value {sql_kind}")


def with_starts(decoded: DataFrame, blocks: DataFrame) -> DataFrame:
    """Add ``start``: the ids before a document. One total for each part, of which there are as many as shuffle partitions, reaches the driver."""
    totals = sorted(tuple(r) for r in blocks.groupBy("part").agg(F.sum("n_ids")).collect())
    at, shifts = 0, []
    for part, n in totals:
        shifts.append((part, at))
        at += n
    shifts = decoded.sparkSession.createDataFrame(shifts, "part int, _shift long")
    return decoded.join(F.broadcast(shifts), "part").withColumn("start", F.col("own_start") + F.col("_shift"))


def write_ids(docs: DataFrame, tokenizer_path: str, folder: str | None = None, end_id: int | None = 0, id_col: str = "doc_id", text_col: str = "text", special_as_text: bool = False) -> tuple[DataFrame, np.ndarray]:
    """Tokenise, code and write all documents; the written blocks, read from their files, and the code lengths.

    Rows without an id come first, in no certain order; repeated ids stand beside each other.
    Empty texts are the end id alone; an empty table is no block.
    """
    spark, width = docs.sparkSession, id_width(tokenizer_path)
    folder = folder or shared_folder(spark)
    token_ids(docs, tokenizer_path, end_id, id_col, text_col, special_as_text).write.parquet(f"{folder}/ids")
    ids = spark.read.parquet(f"{folder}/ids")
    lengths = code_lengths(id_counts(ids))
    encode_blocks(ids.filter("ids is not null").select("doc_id", "ids"), lengths, width).write.parquet(f"{folder}/blocks")
    remove(spark, f"{folder}/ids")
    return spark.read.parquet(f"{folder}/blocks"), lengths


def ids_digest(docs: DataFrame, tokenizer_path: str, **columns) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32), from the written files alone."""
    blocks, lengths = write_ids(docs, tokenizer_path, **columns)
    decoded = decode_blocks(blocks, lengths, lambda ids: zlib.crc32(ids.astype("<u4").tobytes()), pa.int64(), "long")
    return with_starts(decoded, blocks).select("doc_id", "start", "n_tokens", F.col("value").alias("ids_crc32"))
