"""Many range edits on one text: sorted once, overlaps resolved, spliced in one pass over the pieces.

An edit is (start, end, put): the characters from ``start`` up to ``end`` give way to ``put``; with ``start`` = ``end`` it is put in.
Of edits that overlap the one that starts first stays, at one start the longer, then the first by text. Insertions at one place all stay.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Documents' characters that a batch holds at most before it is passed on.
BATCH = 4 << 20


def kept(edits: Iterable[tuple[int, int, str]], size: int) -> Iterator[tuple[int, int, str]]:
    """The edits that stay, in order; those outside the text or turned round are left out."""
    last = 0
    for start, end, put in sorted(set(edits), key=lambda e: (e[0], -e[1], e[2])):
        if last <= start <= end <= size:
            yield start, end, put
            last = end


def spliced(text: str, edits: Iterable[tuple[int, int, str]]) -> tuple[str, int]:
    """The text with its edits, and how many stayed."""
    pieces, at, n = [], 0, 0
    for start, end, put in kept(edits, len(text)):
        pieces += [text[at:start], put]
        at, n = end, n + 1
    pieces.append(text[at:])
    return "".join(pieces), n


def matches(docs: DataFrame, pattern: str) -> DataFrame:
    """(path, start, end, found): each match of ``pattern`` in documents (path, content). Places come from the lengths of what lies between matches, added up."""
    between = F.transform(F.split("content", pattern, -1), F.length)
    found = F.regexp_extract_all("content", F.lit(f"({pattern})"), F.lit(1))
    each = docs.select("path", F.posexplode(F.arrays_zip(between.alias("gap"), found.alias("found"))).alias("pos", "m"))
    upto = F.sum(F.col("m.gap") + F.coalesce(F.length("m.found"), F.lit(0))).over(W.partitionBy("path").orderBy("pos"))
    placed = each.select("path", upto.alias("end"), F.col("m.found").alias("found")).filter("found is not null")
    return placed.select("path", (F.col("end") - F.length("found")).alias("start"), "end", "found")


def ranges(docs: DataFrame, pattern: str, put: str) -> DataFrame:
    """(path, start, end, put): an edit for each match of ``pattern``."""
    return matches(docs, pattern).select("path", "start", "end", F.lit(put).alias("put"))


def apply(docs: DataFrame, edits: DataFrame) -> DataFrame:
    """(path, content, applied): documents (path, content) with edits (path, start, end, put), positions in characters from 0.

    Documents without edits stay as they are, null content stays null. The edits of a document meet as one sorted list.
    """
    listed = edits.filter("start is not null and `end` is not null").groupBy("path").agg(F.sort_array(F.collect_set(F.struct("start", "end", F.coalesce("put", F.lit("")).alias("put")))).alias("edits"))
    joined = docs.select("path", "content").join(listed, "path", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, size = [], 0
            for path, content, own in zip(*(batch.column(i) for i in range(3)), strict=True):
                text = content.as_py()
                done = (text, 0) if text is None or not own.is_valid else spliced(text, [(e["start"], e["end"], e["put"]) for e in own.as_py()])
                out.append((path.as_py(), *done))
                size += len(done[0] or "")
                if size >= BATCH:
                    yield made(out)
                    out, size = [], 0
            if out:
                yield made(out)

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.int64()), strict=True)], ["path", "content", "applied"])

    return joined.mapInArrow(run, "path string, content string, applied long")
