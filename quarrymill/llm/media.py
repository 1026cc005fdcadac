"""TIFF media columns: walk image directories, decode strips and tiles, undo predictors, one row per page.

``tiff_pages`` is the operator: a column of TIFF bytes in, a row per page out. A media
value that is null gives no row; an empty or damaged one gives one row whose ``error``
says why, after the rows of the pages read before the damage. ``write_tiff`` is the
matching lossless writer. Rows are independent, so nothing is shuffled, repeated rows
are read again, and a lost executor only costs its own tasks.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import slices, whole

# Fixed values of the TIFF 6.0 specification and its supplements.
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_BYTES = 256, 257, 258, 259, 262, 273, 277, 278, 279
PLANAR, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_BYTES = 284, 317, 322, 323, 324, 325
KINDS = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 7: "s", 8: "h", 9: "i", 10: "ii", 11: "f", 12: "d"}


class Page(NamedTuple):
    number: int
    width: int
    height: int
    bands: int
    bits: int
    compression: int
    predictor: int
    samples: bytes


def unpack_bits(data: bytes) -> bytes:
    """PackBits: a count byte below 128 copies that many and one more, above 128 repeats the next byte."""
    out, at, end = bytearray(), 0, len(data)
    while at < end:
        n = data[at]
        at += 1
        if n < 128:
            out += data[at : at + n + 1]
            at += n + 1
        elif n > 128:
            out += data[at : at + 1] * (257 - n)
            at += 1
    return bytes(out)


def pack_bits(data: bytes) -> bytes:
    out, at, end = bytearray(), 0, len(data)
    while at < end:
        run = 1
        while run < 128 and at + run < end and data[at + run] == data[at]:
            run += 1
        if run >= 3:
            out += bytes((257 - run, data[at]))
            at += run
            continue
        start = at
        while at < end and at - start < 128 and not (at + 2 < end and data[at] == data[at + 1] == data[at + 2]):
            at += 1
        out.append(at - start - 1)
        out += data[start:at]
    return bytes(out)


def lzw_decode(data: bytes) -> bytes:
    """TIFF's LZW: codes from the highest bit on, 9 to 12 bits, widened one code early; 256 clears, 257 ends."""
    out, table, size, last = bytearray(), [], 9, None
    bits = held = 0
    for byte in data:
        bits, held = (bits << 8) | byte, held + 8
        if held < size:
            continue
        held -= size
        code = (bits >> held) & ((1 << size) - 1)
        bits &= (1 << held) - 1
        if code == 257:
            break
        if code == 256:
            table, size, last = [bytes((i,)) for i in range(256)] + [b"", b""], 9, None
            continue
        if not table:
            raise ValueError("LZW data doesn't begin with a clear code")
        if last is None:
            entry = table[code]
        else:
            if code > len(table):
                raise ValueError("LZW code out of range")
            entry = table[code] if code < len(table) else last + last[:1]
            table.append(last + entry[:1])
        out += entry
        last = entry
        size = max(9, min(12, (len(table) + 1).bit_length()))
    return bytes(out)


def lzw_encode(data: bytes) -> bytes:
    bits = held = 0
    out = bytearray()

    def put(code: int, size: int) -> None:
        nonlocal bits, held
        bits, held = (bits << size) | code, held + size
        while held >= 8:
            held -= 8
            out.append((bits >> held) & 255)
        bits &= (1 << held) - 1

    fresh = {bytes((i,)): i for i in range(256)}
    table, following, size, word = dict(fresh), 258, 9, b""
    put(256, 9)
    for i in range(len(data)):
        longer = word + data[i : i + 1]
        if longer in table:
            word = longer
            continue
        put(table[word], size)
        table[longer] = following
        following += 1
        size = following.bit_length()
        if following == 4094:
            put(256, size)
            table, following, size = dict(fresh), 258, 9
        word = data[i : i + 1]
    if word:
        put(table[word], size)
        size = max(size, (following + 1).bit_length()) if following < 4094 else size
    put(257, size)
    if held:
        put(0, 8 - held)
    return bytes(out)


def unpredict(rows: np.ndarray, predictor: int, bands: int, bits: int, big: bool) -> np.ndarray:
    """Undo a predictor on rows of bytes (one line each)."""
    if predictor == 1:
        return rows
    n, line = rows.shape
    if predictor == 2 and bits in (8, 16, 32):
        kind = np.dtype(f"{'>' if big else '<'}u{bits // 8}")
        values = np.ascontiguousarray(rows).view(kind).reshape(n, -1, bands)
        return np.cumsum(values, axis=1, dtype=kind.newbyteorder("=")).astype(kind).reshape(n, -1).view(np.uint8)
    if predictor == 3 and bits in (16, 32, 64):
        size = bits // 8
        summed = np.cumsum(rows.reshape(n, -1, bands), axis=1, dtype=np.uint8).reshape(n, size, -1)
        planes = summed.transpose(0, 2, 1)
        return np.ascontiguousarray(planes if big else planes[:, :, ::-1]).reshape(n, line)
    raise ValueError(f"predictor {predictor} with {bits} bits")


def unpressed(data: bytes, compression: int) -> bytes:
    if compression == NONE:
        return data
    if compression in (DEFLATE, OLD_DEFLATE):
        return zlib.decompressobj().decompress(data)
    if compression == PACKBITS:
        return unpack_bits(data)
    if compression == LZW:
        return lzw_decode(data)
    raise ValueError(f"compression {compression}")


def directories(data: bytes) -> Iterator[dict[int, tuple]]:
    """The tags of each image directory, along the chain of offsets; a chain that returns to itself is an error."""
    mark = {b"II*\0": "<", b"MM\0*": ">"}.get(data[:4])
    if mark is None or len(data) < 8:
        raise ValueError("not a TIFF")
    at, seen = struct.unpack_from(f"{mark}I", data, 4)[0], set()
    while at:
        if at in seen:
            raise ValueError("directories form a cycle")
        seen.add(at)
        (n,) = struct.unpack_from(f"{mark}H", data, at)
        tags = {0: (mark,)}
        for i in range(n):
            tag, kind, count = struct.unpack_from(f"{mark}HHI", data, at + 2 + 12 * i)
            if kind not in KINDS:
                continue
            each = KINDS[kind]
            size = struct.calcsize(f"{mark}{each}") * count
            place = at + 10 + 12 * i if size <= 4 else struct.unpack_from(f"{mark}I", data, at + 10 + 12 * i)[0]
            if place + size > len(data):
                raise ValueError(f"tag {tag} lies outside the file")
            tags[tag] = struct.unpack_from(f"{mark}{each * count if each != 's' else f'{count}s'}", data, place)
        yield tags
        (at,) = struct.unpack_from(f"{mark}I", data, at + 2 + 12 * n)


def read_pages(data: bytes, most_bytes: int = 1 << 28) -> Iterator[Page]:
    """Each page of a TIFF with its samples in reading order. ``most_bytes`` bounds one page; a larger one is an error."""
    for number, tags in enumerate(directories(data)):
        one = lambda tag, default=None: tags[tag][0] if tag in tags else default  # noqa: B023, E731
        width, height, bands = one(WIDTH), one(HEIGHT), one(SAMPLES, 1)
        depth = set(tags.get(BITS, (1,)))
        if not width or not height or len(depth) != 1 or (bits := depth.pop()) not in (8, 16, 32, 64):
            raise ValueError("size or depth of a page is missing or unknown")
        compression, predictor, planes = one(COMPRESSION, 1), one(PREDICTOR, 1), bands if one(PLANAR, 1) == 2 else 1
        each = bands // planes * bits // 8
        if width * height * bands * bits // 8 > most_bytes:
            raise ValueError("a page is larger than allowed")
        tiled = TILE_OFFSETS in tags
        wide, high = (one(TILE_WIDTH), one(TILE_HEIGHT)) if tiled else (width, min(one(ROWS_PER_STRIP, height), height))
        if not wide or not high:
            raise ValueError("size of a strip or tile is missing")
        across, down = -(-width // wide), -(-height // high)
        offsets, counts = tags[TILE_OFFSETS if tiled else STRIP_OFFSETS], tags[TILE_BYTES if tiled else STRIP_BYTES]
        if not len(offsets) == len(counts) == across * down * planes:
            raise ValueError("strips or tiles are missing")
        out = np.zeros((planes, height, width * each), np.uint8)
        for i, (at, size) in enumerate(zip(offsets, counts, strict=True)):
            plane, rest = divmod(i, across * down)
            y, x = rest // across * high, rest % across * wide
            rows = high if tiled else min(high, height - y)
            raw = unpressed(data[at : at + size], compression)
            if len(raw) < rows * wide * each:
                raise ValueError("a strip or tile is too short")
            block = np.frombuffer(raw, np.uint8, rows * wide * each).reshape(rows, wide * each)
            block = unpredict(block, predictor, bands // planes, bits, tags[0][0] == ">")
            keep, cols = min(rows, height - y), min(wide, width - x)
            out[plane, y : y + keep, x * each : (x + cols) * each] = block[:keep, : cols * each]
        if planes > 1:
            out = out.reshape(planes, height, width, bits // 8).transpose(1, 2, 0, 3)
        yield Page(number, width, height, bands, bits, compression, predictor, out.tobytes())


def write_tiff(payload: bytes, width: int = 576, page_rows: int = 1024, strip_rows: int = 64, compression: int = DEFLATE, predictor: int = 2, tile: int = 0, level: int = 1) -> bytes:
    """8-bit grey pages of ``width`` samples that hold ``payload`` (a multiple of ``width``); tiles of ``tile`` if not 0."""
    if not payload or len(payload) % width:
        raise ValueError("payload must be a positive multiple of the width")
    press = {NONE: bytes, DEFLATE: lambda b: zlib.compress(b, level), PACKBITS: pack_bits, LZW: lzw_encode}[compression]
    image = np.frombuffer(payload, np.uint8).reshape(-1, width)
    out, link = bytearray(b"II*\0\0\0\0\0"), 4
    for top in range(0, len(image), page_rows):
        page = image[top : top + page_rows]
        blocks = []
        if tile:
            for y in range(0, len(page), tile):
                for x in range(0, width, tile):
                    block = np.zeros((tile, tile), np.uint8)
                    part = page[y : y + tile, x : x + tile]
                    block[: part.shape[0], : part.shape[1]] = part
                    blocks.append(block)
        else:
            blocks = [page[y : y + strip_rows] for y in range(0, len(page), strip_rows)]
        offsets, counts = [], []
        for block in blocks:
            if predictor == 2:
                block = np.concatenate([block[:, :1], block[:, 1:] - block[:, :-1]], axis=1)
            data = press(block.tobytes())
            offsets.append(len(out))
            counts.append(len(data))
            out += data
        lists = {}
        for name, values in (("offsets", offsets), ("counts", counts)):
            lists[name] = values[0] if len(values) == 1 else len(out)
            out += struct.pack(f"<{len(values)}I", *values) if len(values) > 1 else b""
        tags = [(WIDTH, 4, 1, width), (HEIGHT, 4, 1, len(page)), (BITS, 3, 1, 8), (COMPRESSION, 3, 1, compression), (PHOTOMETRIC, 3, 1, 1)]
        if not tile:
            tags += [(STRIP_OFFSETS, 4, len(blocks), lists["offsets"])]
        tags += [(SAMPLES, 3, 1, 1)]
        if not tile:
            tags += [(ROWS_PER_STRIP, 4, 1, min(strip_rows, len(page))), (STRIP_BYTES, 4, len(blocks), lists["counts"])]
        tags += [(PREDICTOR, 3, 1, predictor)]
        if tile:
            tags += [(TILE_WIDTH, 4, 1, tile), (TILE_HEIGHT, 4, 1, tile), (TILE_OFFSETS, 4, len(blocks), lists["offsets"]), (TILE_BYTES, 4, len(blocks), lists["counts"])]
        out += b"\0" * (len(out) % 2)
        struct.pack_into("<I", out, link, len(out))
        out += struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", *t) for t in tags)
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def padded(text: bytes, unit: int = 576) -> bytes:
    """``text`` and bytes 255 up to a positive multiple of ``unit``."""
    return text + b"\xff" * (max(unit, -(-len(text) // unit) * unit) - len(text))


PAGES = "id long, page int, width int, height int, bands int, bits int, compression int, predictor int, samples binary, samples_sha256 string, error string"


def tiff_pages(df: DataFrame, id_col: str = "id", media_col: str = "media") -> DataFrame:
    """A row per page of each TIFF in ``media_col``; other columns are left behind.

    Null media: no row. Damage: a row with ``error`` and null page columns, after the pages before it.
    """

    def run(batches):
        for batch in slices(batches, 64):
            rows = []
            for key, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if data is None:
                    continue
                try:
                    for p in read_pages(data):
                        rows.append((key, *p, hashlib.sha256(p.samples).hexdigest(), None))
                except (ValueError, KeyError, IndexError, struct.error, zlib.error) as e:
                    rows.append((key, *[None] * 9, f"{type(e).__name__}: {e}"))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 11, kinds, strict=True)], names=names)

    names = [x.split()[0] for x in PAGES.split(", ")]
    kinds = [pa.int64(), *[pa.int32()] * 7, pa.binary(), pa.string(), pa.string()]
    return df.select(F.col(id_col).cast("long").alias("id"), F.col(media_col).cast("binary").alias("media")).mapInArrow(run, PAGES)


def texts_to_tiff(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: int = 576, **how) -> DataFrame:
    """(id, n_bytes, media): each whole text, padded, as a lossless TIFF. Null and empty texts are one row of padding."""

    def run(batches):
        for batch in slices(batches, 64):
            texts = [t.encode() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array([write_tiff(padded(t, unit), unit, **how) for t in texts], pa.binary())],
                names=["id", "n_bytes", "media"],
            )

    return docs.select(F.col(id_col).cast("long").alias("id"), whole(text_col).alias("text")).mapInArrow(run, "id long, n_bytes long, media binary")


def tiff_digests(media: DataFrame) -> DataFrame:
    """From (id, n_bytes, media): what the pages read back hold, a row per file. A damaged file fails the query."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_pages"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32()]

    def run(batches):
        for batch in slices(batches, 64):
            rows = []
            for key, n, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                pages = list(read_pages(data))
                payload = b"".join(p.samples for p in pages)
                a = np.frombuffer(payload, np.uint8)
                bins = np.bincount(a >> 5, minlength=8)
                feature = f"pages={len(pages)};width={pages[0].width};height={sum(p.height for p in pages)};sum={int(a.sum(dtype=np.int64))};bins={','.join(map(str, bins))}"
                rows.append((key, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(data), hashlib.sha256(data).hexdigest(), feature, len(pages)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 9, kinds, strict=True)], names=names)

    return media.select("id", "n_bytes", "media").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_pages int")
