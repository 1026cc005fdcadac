"""WARC archives: written and read as a Spark data source, transactions assembled from their records.

``write`` stores each page as a request, a response (or a revisit of one) and a metadata record that name each other by
WARC-Concurrent-To; every record is a gzip member of its own. Archives are staged by each task under names of that attempt
and count only once the driver has put their names into the manifest, so lost or repeated tasks leave nothing that is read.
``captures`` joins the records back through concurrent-to identifiers: one nested row for each capture.

Awkward rows: a null url gives records without target, characters below 0x21 in a url are written percent-encoded; null html is
an empty payload. A null page_id is never the response of a group that holds another id, and has no page id in its metadata.
Repeated rows are captures of their own; of rows that share the smallest id and the payload all are responses.
Empty tables give archives without captures. Other columns are left behind.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import json
import posixpath
import re
import uuid
from collections.abc import Iterator
from typing import NamedTuple
from urllib.parse import urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from .shared import components, cut, few_broadcast, remove, shared_folder, slices, whole

#: Payloads shorter than this are never revisits.
LEAST_REVISIT = 100
#: An archive is ended when it has grown to this size.
ROLL = 64 << 20
#: Records beside a response that one row of ``captures`` holds; further ones go to rows of their own.
MOST_PARTS = 1_000
MANIFEST = "_manifest.json"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ANCHORS = ["response", "revisit", "resource"]

WRITTEN = "page_id long, url string, html string, first_url string, revisit boolean"
RECORDS = (
    "archive string, ordinal long, type string, record_id string, concurrent_to array<string>, target_uri string, date string, refers_to_uri string, "
    "named_digest string, content_type string, block_bytes long, payload_bytes long, payload_sha256 string, fields map<string,string>, payload binary"
)
ARROW = pa.schema([
    ("archive", pa.string()), ("ordinal", pa.int64()), ("type", pa.string()), ("record_id", pa.string()), ("concurrent_to", pa.list_(pa.string())), ("target_uri", pa.string()),
    ("date", pa.string()), ("refers_to_uri", pa.string()), ("named_digest", pa.string()), ("content_type", pa.string()), ("block_bytes", pa.int64()), ("payload_bytes", pa.int64()),
    ("payload_sha256", pa.string()), ("fields", pa.map_(pa.string(), pa.string())), ("payload", pa.binary()),
])


def member(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """A whole record as a gzip member."""
    head = "".join(f"{k}: {v}\r\n" for k, v in headers)
    return gzip.compress(f"WARC/1.1\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n", 3, mtime=0)


def clean_url(url: str) -> str:
    """Fit for a header line: control characters and spaces percent-encoded."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def exchange(page_id: int | None, url: str | None, html: str | None, first_url: str | None, revisit: bool, ids: Iterator[str], date: str) -> list[bytes]:
    """Request, response or revisit, and metadata of a page."""
    payload = (html or "").encode()
    target = [("WARC-Target-URI", clean_url(url))] if url else []
    main, asked, about = next(ids), next(ids), next(ids)
    common = [("WARC-Date", date), *target]
    try:
        parts = urlsplit(clean_url(url or ""))
        host, path = parts.netloc, (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    except ValueError:  # brackets that hold no address
        host, path = "", "/"
    request = f"GET {path} HTTP/1.1\r\nHost: {host}\r\n\r\n".encode()
    answer = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    digest = ("WARC-Payload-Digest", f"sha256:{hashlib.sha256(payload).hexdigest()}")
    if revisit:
        refers = [("WARC-Refers-To-Target-URI", clean_url(first_url))] if first_url else []
        shown = member([("WARC-Type", "revisit"), ("WARC-Record-ID", main), *common, ("WARC-Profile", PROFILE), *refers, digest, ("Content-Type", "application/http; msgtype=response")], answer)
    else:
        shown = member([("WARC-Type", "response"), ("WARC-Record-ID", main), *common, digest, ("Content-Type", "application/http; msgtype=response")], answer + payload)
    beside = lambda kind, own, type_: [("WARC-Type", kind), ("WARC-Record-ID", own), *common, ("WARC-Concurrent-To", main), ("Content-Type", type_)]
    fields = ("" if page_id is None else f"page-id: {page_id}\r\n").encode()
    return [member(beside("request", asked, "application/http; msgtype=request"), request), shown, member(beside("metadata", about, "application/warc-fields"), fields)]


class Archived(WriterCommitMessage):
    """The archives that a task has closed: (name, records)."""

    def __init__(self, archives: list[tuple[str, int]]):
        self.archives = archives


class WarcWriter(DataSourceArrowWriter):
    """Two phases: tasks write archives under names of their own, the driver lists those of the tasks that count."""

    def __init__(self, path: str, date: str, roll: int):
        self.path, self.date, self.roll = path, date, roll

    def write(self, batches: Iterator[pa.RecordBatch]) -> Archived:
        store, folder = fs.FileSystem.from_uri(self.path)
        store.create_dir(folder, recursive=True)
        done: list[tuple[str, int]] = []
        out, name, made, records, ids = None, "", 0, 0, iter(())
        for batch in slices(batches, 64):
            for row in batch.to_pylist():
                if out is None:
                    own = uuid.uuid4()
                    name, made, records = f"{own.hex}.warc.gz", 0, 1
                    ids = (f"<urn:uuid:{uuid.UUID(int=(own.int + k) % (1 << 128))}>" for k in range(1 << 62))
                    out = store.open_output_stream(posixpath.join(folder, name), compression=None)
                    out.write(member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", next(ids)), ("WARC-Date", self.date), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"))
                for part in exchange(row["page_id"], row["url"], row["html"], row["first_url"], row["revisit"], ids, self.date):
                    made += out.write(part) or len(part)
                    records += 1
                if made >= self.roll:
                    out.close()
                    done.append((name, records))
                    out = None
        if out is not None:
            out.close()
            done.append((name, records))
        return Archived(done)

    def commit(self, messages: list) -> None:
        store, folder = fs.FileSystem.from_uri(self.path)
        store.create_dir(folder, recursive=True)
        listed = [{"archive": n, "records": k} for m in messages if m is not None for n, k in m.archives]
        with store.open_output_stream(posixpath.join(folder, MANIFEST)) as out:
            out.write(json.dumps(listed).encode())

    def abort(self, messages: list) -> None:
        store, folder = fs.FileSystem.from_uri(self.path)
        for name in [n for m in messages if m is not None for n, _ in m.archives]:
            store.delete_file(posixpath.join(folder, name))


class Record(NamedTuple):
    headers: dict[str, list[str]]
    block: bytes

    def one(self, name: str) -> str | None:
        return self.headers.get(name, [None])[0]


def records_of(stream) -> Iterator[Record]:
    """The records of an archive, read one by one from its start. Folded header lines are joined; a bad version line or a short block is an error."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record begins with {line[:40]!r}")
        headers: dict[str, list[str]] = {}
        last = None
        while (line := stream.readline()).strip():
            if line[:1] in b" \t" and last:
                headers[last][-1] += " " + line.strip().decode("utf-8", "replace")
                continue
            key, _, value = line.partition(b":")
            last = key.strip().lower().decode("utf-8", "replace")
            headers.setdefault(last, []).append(value.strip().decode("utf-8", "replace"))
        size = int(headers["content-length"][0])
        block = stream.read(size)
        if len(block) != size:
            raise ValueError("the archive ends within a record")
        yield Record(headers, block)


def fields_of(block: bytes) -> list[tuple[str, str]]:
    """``name: value`` lines; a name that is there twice keeps its first value."""
    found: dict[str, str] = {}
    for line in block.decode("utf-8", "replace").splitlines():
        key, colon, value = line.partition(":")
        if colon:
            found.setdefault(key.strip().lower(), value.strip())
    return list(found.items())


def as_row(archive: str, ordinal: int, r: Record, payloads: bool) -> dict:
    http = (r.one("content-type") or "").startswith("application/http")
    head, gap, body = r.block.partition(b"\r\n\r\n") if http else (b"", b"", r.block)
    fields = fields_of(head.partition(b"\r\n")[2]) if http else fields_of(r.block) if r.one("content-type") == "application/warc-fields" else []
    return {
        "archive": archive, "ordinal": ordinal, "type": r.one("warc-type"), "record_id": r.one("warc-record-id"), "concurrent_to": r.headers.get("warc-concurrent-to", []), "target_uri": r.one("warc-target-uri"),
        "date": r.one("warc-date"), "refers_to_uri": r.one("warc-refers-to-target-uri"), "named_digest": r.one("warc-payload-digest"), "content_type": r.one("content-type"), "block_bytes": len(r.block), "payload_bytes": len(body),
        "payload_sha256": hashlib.sha256(body).hexdigest(), "fields": fields, "payload": body if payloads else None,
    }


class Archive(InputPartition):
    def __init__(self, name: str):
        self.name = name


class WarcReader(DataSourceReader):
    """A task for each archive that the manifest lists (or, without one, each ``.warc`` and ``.warc.gz`` there); records are read one by one."""

    def __init__(self, path: str, payloads: bool):
        self.path, self.payloads = path, payloads

    def partitions(self) -> list[Archive]:
        store, folder = fs.FileSystem.from_uri(self.path)
        at = posixpath.join(folder, MANIFEST)
        if store.get_file_info(at).type == fs.FileType.File:
            with store.open_input_stream(at) as held:
                return [Archive(x["archive"]) for x in json.loads(held.read())] or [Archive("")]
        names = [posixpath.basename(f.path) for f in store.get_file_info(fs.FileSelector(folder)) if re.search(r"\.warc(\.gz)?$", f.path)]
        return [Archive(n) for n in sorted(names)] or [Archive("")]

    def read(self, partition: Archive) -> Iterator[pa.RecordBatch]:
        if not partition.name:
            return
        store, folder = fs.FileSystem.from_uri(self.path)
        held, size = [], 0
        with store.open_input_file(posixpath.join(folder, partition.name)) as raw:
            stream = gzip.GzipFile(fileobj=raw) if partition.name.endswith(".gz") else io.BufferedReader(raw)
            for k, r in enumerate(records_of(stream)):
                held.append(as_row(partition.name, k, r, self.payloads))
                size += len(r.block) if self.payloads else 0
                if len(held) >= 2_000 or size >= 8 << 20:
                    yield pa.RecordBatch.from_pylist(held, ARROW)
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, ARROW)


class WarcSource(DataSource):
    """Format ``warc``. Options: ``path``; reading ``payloads`` (false leaves the bytes out, sizes and digests stay); writing ``date``, ``roll``."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return RECORDS

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options["path"], self.options.get("payloads", "true") == "true")

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"], self.options.get("date", "1970-01-01T00:00:00Z"), int(self.options.get("roll", ROLL)))


def roles(pages: DataFrame) -> DataFrame:
    """``WRITTEN``: which pages revisit which. Digests and ids alone are grouped; pages meet the digests that several of them share, broadcast where few."""
    digest, size = F.unhex(F.sha2(whole("html").cast("binary"), 256)), F.octet_length(whole("html"))
    long = pages.filter(size >= LEAST_REVISIT).select(digest.alias("digest"), "page_id", "url")
    shared = long.groupBy("digest").agg(F.count("*").alias("n"), F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))).alias("first")).filter("n > 1 and first is not null")
    met = pages.select("page_id", "url", "html", F.when(size >= LEAST_REVISIT, digest).alias("digest")).join(few_broadcast(cut(shared)), "digest", "left")
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first.page_id"))
    return met.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", F.when(again, F.col("first.url")).alias("first_url"), again.alias("revisit"))


def write(pages: DataFrame, folder: str, date: str = "1970-01-01T00:00:00Z", roll: int = ROLL) -> None:
    """Pages (page_id, url, html) as archives in ``folder``. ``date`` is what WARC-Date says, as pages have none."""
    pages.sparkSession.dataSource.register(WarcSource)
    roles(pages).write.format("warc").option("date", date).option("roll", str(roll)).mode("append").save(folder)


def read(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """``RECORDS`` of all archives in ``folder``."""
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").option("payloads", str(payloads).lower()).load(folder)


def anchored(records: DataFrame) -> DataFrame:
    """(record_id, anchor): the response, revisit or resource that each other record belongs to.

    A record and a response that name each other directly, in either direction, are joined. What is left (chains of
    records, captures without a response) is settled by connected components; there the smallest response of the
    component, or the component's smallest record if it has none, is the anchor.
    """
    ends = records.select("record_id", F.col("type").isin(ANCHORS).alias("main"), "concurrent_to").filter("type <> 'warcinfo' and record_id is not null")
    named = ends.select("record_id", "main", F.explode("concurrent_to").alias("other"))
    mains = ends.filter("main").select(F.col("record_id").alias("anchor")).distinct()
    forward = named.filter("not main").select("record_id", F.col("other").alias("anchor")).join(mains, "anchor", "left_semi")
    back = named.filter("main").select(F.col("other").alias("record_id"), F.col("record_id").alias("anchor"))
    direct = cut(forward.unionByName(back).groupBy("record_id").agg(F.min("anchor").alias("anchor")))
    rest = cut(ends.filter("not main").select("record_id").distinct().join(direct, "record_id", "left_anti"))
    if rest.isEmpty():
        return direct
    where = components(named.select(F.col("record_id").alias("a"), F.col("other").alias("b")))
    of = lambda df, col: df.join(where, F.col(col) == F.col("node"), "left").withColumn("component", F.coalesce("component", col)).drop("node")
    best = of(mains, "anchor").groupBy("component").agg(F.min("anchor").alias("anchor"))
    late = of(rest, "record_id").join(best, "component", "left").select("record_id", F.coalesce("anchor", "component").alias("anchor"))
    return direct.unionByName(late)


def captures(records: DataFrame) -> DataFrame:
    """One nested row for each capture: its response (or revisit, resource; null for records that belong to none), requests and metadata.

    (capture_id, piece, response, requests, metadata). Records beside a response beyond ``MOST_PARTS`` go to rows with ``piece``
    1, 2, ... of the same capture, so that no row grows with the archive; these carry no response.
    """
    # Maps have no order, so fields are entries while the records are sorted by archive and place.
    beside = [*["archive", "ordinal", "record_id", "target_uri", "date", "content_type", "payload_bytes", "payload"], F.map_entries("fields").alias("fields")]
    main = F.col("type").isin(ANCHORS)
    of = cut(anchored(records))
    counts = of.groupBy("anchor").agg(F.count("*").alias("n")).filter(F.col("n") > MOST_PARTS)
    piece = F.coalesce(F.pmod(F.xxhash64("archive", "ordinal"), F.ceil(F.col("n") / MOST_PARTS)), F.lit(0))
    others = records.filter(~main & (F.col("type") != "warcinfo")).join(of, "record_id").join(few_broadcast(cut(counts)), "anchor", "left")
    asked = F.col("type").eqNullSafe("request")
    listed = lambda which: F.transform(F.array_sort(F.collect_list(F.when(which, F.struct(*beside)))), lambda x: x.withField("fields", F.map_from_entries(x["fields"])))
    parts = others.withColumn("piece", piece).groupBy("anchor", "piece").agg(listed(asked).alias("requests"), listed(~asked).alias("metadata"))
    responses = records.filter(main).select(F.col("record_id").alias("anchor"), F.lit(0).cast("long").alias("piece"), F.struct(*[c for c in records.columns if c != "concurrent_to"]).alias("response"))
    return parts.join(responses, ["anchor", "piece"], "full").select(F.col("anchor").alias("capture_id"), "piece", "response", "requests", "metadata")


def digest(found: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of captures, each revisit with the response that has its digest."""
    page = F.try_element_at(F.element_at("metadata", 1)["fields"], F.lit("page-id")).cast("long")
    named: Column = F.regexp_replace("response.named_digest", "^sha256:", "")
    rows = found.filter("response is not null").select(page.alias("page_id"), F.col("response.type").alias("record_type"), F.col("response.payload_bytes").alias("own_bytes"), F.when(F.col("response.type") == "revisit", named).otherwise(F.col("response.payload_sha256")).alias("payload_digest"))
    rows = cut(rows)
    firsts = rows.filter(F.col("record_type") == "response").filter(F.col("own_bytes") >= LEAST_REVISIT).groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.first("own_bytes").alias("first_bytes"))
    again = rows.filter("record_type = 'revisit'")
    met = again.join(firsts, "payload_digest", "left").select("page_id", F.col("first_bytes").alias("payload_bytes"), "payload_digest", "record_type", F.col("first").alias("refers_to"))
    alone = rows.filter("record_type = 'response'").select("page_id", F.col("own_bytes").alias("payload_bytes"), "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to"))
    return alone.unionByName(met)


def round_trip(pages: DataFrame) -> DataFrame:
    """Pages written as archives to the shared folder, read back and assembled: a row of ``digest`` for each page."""
    spark = pages.sparkSession
    folder = shared_folder(spark)
    uri = folder if "://" in folder else "file://" + re.sub(r"^file:", "", folder)
    write(pages, uri)
    found = cut(digest(captures(cut(read(spark, uri, payloads=False)))))
    remove(spark, folder)
    return found
