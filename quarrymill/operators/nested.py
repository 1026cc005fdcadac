"""Nested documents as flat rows and back: any depth, rebuilt from the deepest rows up.

``flattened`` gives a row for each value of a JSON document; strings in it are changed by joins, as rows; ``rebuilt`` puts each
level's values into those above, one grouping for each level. Null and broken documents give no rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import cut

NODES = "doc string, node long, parent long, depth int, ord long, key string, kind string, value string"
FIELDS = pa.schema([("doc", pa.string()), ("node", pa.int64()), ("parent", pa.int64()), ("depth", pa.int32()), ("ord", pa.int64()), ("key", pa.string()), ("kind", pa.string()), ("value", pa.string())])


class Pairs(list):
    """Members of an object as they stand, names that are given twice too."""


def nodes_of(doc: str, text: str) -> Iterator[dict]:
    """The values of a document from its root down; scalars keep their own JSON (numbers as they are written), strings their text."""
    try:
        root = json.loads(text, object_pairs_hook=Pairs, parse_float=Number, parse_int=Number)
    except (ValueError, RecursionError):
        return
    count, todo = 0, [(root, -1, 0, 0, None)]
    while todo:
        value, parent, depth, ord_, key = todo.pop()
        kind = "object" if isinstance(value, Pairs) else "array" if isinstance(value, list) else "string" if isinstance(value, str) and not isinstance(value, Number) else "scalar"
        held = None if kind in ("object", "array") else value if kind == "string" else str(value) if isinstance(value, Number) else json.dumps(value)
        yield {"doc": doc, "node": count, "parent": parent, "depth": depth, "ord": ord_, "key": key, "kind": kind, "value": held}
        members = [(v, k) for k, v in value] if kind == "object" else [(v, None) for v in value] if kind == "array" else []
        todo += [(v, count, depth + 1, i, k) for i, (v, k) in enumerate(members)][::-1]
        count += 1


class Number(str):
    """A number as it is written."""


def flattened(docs: DataFrame) -> DataFrame:
    """``NODES`` of documents (doc, json)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: list[dict] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for node in nodes_of(doc, text.as_py() or ""):
                    held.append(node)
                    if len(held) >= 20_000:
                        yield pa.RecordBatch.from_pylist(held, FIELDS)
                        held = []
            if held:
                yield pa.RecordBatch.from_pylist(held, FIELDS)

    return docs.select("doc", "json").mapInArrow(run, NODES)


def replaced(nodes: DataFrame, moves: DataFrame) -> DataFrame:
    """Strings that are a move's ``source`` become its ``destination``; moves (source, destination) name each source once."""
    known = moves.select(F.col("source").alias("value"), F.lit("string").alias("kind"), F.col("destination").alias("_to"))
    return nodes.join(known, ["value", "kind"], "left").withColumn("value", F.coalesce("_to", "value")).select(*nodes.columns)


def escaped(text: Column) -> Column:
    """A JSON string."""
    return F.regexp_replace(F.to_json(F.array(text)), r"(?s)^\[|\]$", "")


def rebuilt(nodes: DataFrame) -> DataFrame:
    """(doc, json) from ``NODES``: compact JSON, members in their order. The number of levels is the only thing the driver learns."""
    held = cut(nodes)
    deepest = held.agg(F.max("depth")).first()[0]
    text = F.when(F.col("kind") == "string", escaped(F.col("value"))).otherwise(F.col("value"))
    done = None
    for level in range(deepest if deepest is not None else -1, -1, -1):
        own = held.filter(F.col("depth") == level)
        if done is None:
            own = own.withColumn("_inner", F.lit(None).cast("string"))
        else:
            own = own.join(done, ["doc", "node"], "left")
        whole = F.when(F.col("kind") == "object", F.concat(F.lit("{"), F.coalesce("_inner", F.lit("")), F.lit("}"))).when(F.col("kind") == "array", F.concat(F.lit("["), F.coalesce("_inner", F.lit("")), F.lit("]"))).otherwise(text)
        rows = own.select("doc", "parent", "ord", F.when(F.col("key").isNotNull(), F.concat(escaped(F.col("key")), F.lit(":"), whole)).otherwise(whole).alias("_text"))
        if not level:
            return rows.select("doc", F.col("_text").alias("json"))
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "_text"))), lambda x: x["_text"]), ",")
        done = cut(rows.groupBy("doc", F.col("parent").alias("node")).agg(joined.alias("_inner")))
    return nodes.select("doc", F.col("value").alias("json")).limit(0)
