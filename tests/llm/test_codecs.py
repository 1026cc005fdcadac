"""TIFF, Huffman and BPE: exact round trips, and the public libraries as the standard."""

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from tokenizers import Tokenizer

from quarrymill.llm import bpe, huffman, media, pieces

from .fixtures import awkward_texts, docs_frame, empty_frame


@pytest.mark.parametrize("compression", [media.NONE, media.LZW, media.DEFLATE, media.PACKBITS])
@pytest.mark.parametrize("predictor", [1, 2])
@pytest.mark.parametrize("tile", [0, 16, 96])
def test_tiff_round_trip(compression, predictor, tile):
    r = random.Random(5)
    for n in (1, 900, 5000):
        data = media.padded(bytes(r.choice(b"aab c") if r.random() < 0.7 else r.randrange(256) for _ in range(n)))
        made = media.write_tiff(data, 576, page_rows=7, strip_rows=3, compression=compression, predictor=predictor, tile=tile)
        pages = list(media.read_pages(made))
        assert b"".join(p.samples for p in pages) == data
        assert len(pages) == -(-len(data) // 576 // 7) or tile


def test_lzw_over_table_resets():
    data = bytes(random.Random(1).randrange(256) for _ in range(40000)) + b"a" * 20000
    assert media.lzw_decode(media.lzw_encode(data)) == data


def test_big_endian_and_16_bit_predictor():
    import struct

    values = np.array([[1, 300, 65000], [5, 4, 3]], ">u2")
    diff = np.concatenate([values[:, :1], (values[:, 1:].astype(int) - values[:, :-1].astype(int)) % 65536], axis=1).astype(">u2")
    strip = diff.tobytes()
    tags = [(256, 3, 1, 3 << 16), (257, 3, 1, 2 << 16), (258, 3, 1, 16 << 16), (259, 3, 1, 1 << 16), (273, 4, 1, 8), (277, 3, 1, 1 << 16), (278, 3, 1, 2 << 16), (279, 4, 1, len(strip)), (317, 3, 1, 2 << 16)]
    data = b"MM\0*" + struct.pack(">I", 8 + len(strip)) + strip + struct.pack(">H", len(tags)) + b"".join(struct.pack(">HHII", *t) for t in tags) + b"\0\0\0\0"
    (page,) = media.read_pages(data)
    assert page.samples == values.tobytes()


def test_tiff_pages_rows(spark):
    good = media.write_tiff(media.padded(b"x" * 3000), page_rows=2)
    cyclic = bytearray(good)
    frame = spark.createDataFrame([(1, bytearray(good), 7), (2, None, 7), (3, bytearray(b""), 7), (4, bytearray(b"II*\0junk"), 7), (5, cyclic[:200], 7), (1, bytearray(good), 7)], "id long, media binary, page int")
    rows = media.tiff_pages(frame).collect()
    assert sorted((r["id"], r["page"]) for r in rows if r["error"] is None) == sorted([*[(1, 0), (1, 1), (1, 2)] * 2, (5, 0)])  # the damage in 5 lies after its first page
    assert {r["id"] for r in rows if r["error"]} == {3, 4, 5}
    assert media.tiff_pages(frame.limit(0)).count() == 0


def test_tiff_digests(spark):
    rows = {(r["doc_id"], r["n_bytes"]): r for r in media.tiff_digests(media.texts_to_tiff(docs_frame(spark))).collect()}
    for i, t in awkward_texts():
        raw = (t or "").encode()
        data = raw + b"\xff" * (max(576, -(-len(raw) // 576) * 576) - len(raw))
        r = rows[i, len(raw)]
        assert (r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-32:]))
    assert media.tiff_digests(media.texts_to_tiff(empty_frame(spark))).count() == 0


RANKS = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def reference():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def codec():
    with open(RANKS, "rb") as f:
        return bpe.Codec(f.read(), P.PATTERN)


def test_transducer_equals_library(codec, reference):
    r = random.Random(3)
    letters = " \n\t'sabcde ttheé 　😀🇩1.,!\x1c\x85\0‍漢字"
    texts = ["".join(r.choice(letters) for _ in range(r.randrange(60))) for _ in range(1500)]
    texts += ["".join(r.choice("etaoinshr") for _ in range(r.randrange(400))) for _ in range(60)] + ["a" * 20000, "ab" * 3000]
    for warm in (1, 4):
        codec.encoder.clear()
        codec.encoder.warm = warm
        codec.pieces = pieces.Pieces(codec.words, codec.find, codec.kind)
        for t, ids in zip(texts, codec.encode(pa.array(texts)), strict=True):
            assert ids.tolist() == reference.encode_ordinary(t)
            assert codec.decoder.whole(ids) == t.encode()
            assert "".join(codec.decoder.stream(ids.tolist())) == t


def test_transducer_with_small_tables(codec, reference):
    small = bpe.Encoder(codec.vocabulary, most_states=50, warm=1)
    for t in ("internationalization", "thinterstate", "antidisestablishmentarianism") * 20:
        assert small.encode(t.encode()) == reference.encode_ordinary(t)


def test_every_token_encodes_to_itself(codec):
    for token, i in list(codec.vocabulary.rank.items())[::7]:
        assert codec.encoder.read(token) == [i]


def test_decoder_rejects_ill_formed(codec):
    half = [codec.vocabulary.rank[b"\xe6"]]
    for bad in (half, [10**6]):
        with pytest.raises(ValueError):
            codec.decoder.whole(np.array(bad))
        with pytest.raises(ValueError):
            list(codec.decoder.stream(bad))
    split = codec.encode(pa.array(["漢"]))[0]
    assert len(split) > 1 and list(codec.decoder.stream(split.tolist())) == ["漢"]


def test_round_trip_query(spark, reference):
    rows = bpe.round_trip(docs_frame(spark), RANKS, P.PATTERN).collect()
    got = sorted(tuple(r) for r in rows)
    want = []
    for i, t in awkward_texts():
        ids = reference.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want)
    encoded = bpe.encode_texts(docs_frame(spark), RANKS, P.PATTERN)
    assert sorted((r["doc_id"], r["text"]) for r in bpe.decode_ids(encoded, RANKS).collect()) == sorted((i, t or "") for i, t in awkward_texts())
    assert bpe.round_trip(empty_frame(spark), RANKS, P.PATTERN).count() == 0


def huffman_cost(counts):
    import heapq

    heap = [int(c) for c in counts if c]
    heapq.heapify(heap)
    cost = 0
    while len(heap) > 1:
        a = heapq.heappop(heap) + heapq.heappop(heap)
        cost += a
        heapq.heappush(heap, a)
    return cost


@pytest.mark.parametrize(("n", "size"), [(0, 1), (1, 1), (5, 3), (255, 20), (256, 20), (257, 20), (60000, 50000), (70000, 200)])
def test_huffman_blocks(n, size):
    ids = (np.random.default_rng(n).zipf(1.3, n) - 1) % size
    counts = np.bincount(ids, minlength=1)
    lengths = huffman.code_lengths(counts)
    assert lengths.max(initial=0) <= 16 and sum(2.0 ** -int(x) for x in lengths[lengths > 0]) <= 1
    if lengths.max(initial=0) < 16 and n > 1:
        assert int((counts * lengths).sum()) == (huffman_cost(counts) or n)
    block = huffman.write_block([4, 9], [n // 2, n - n // 2], ids, 7, huffman.canonical(lengths), lengths)
    docs, sizes, first, back = huffman.read_block(block, huffman.decoding_table(lengths))
    assert docs.tolist() == [4, 9] and sizes.sum() == n and first == 7 and (back == ids).all()


def test_length_limit_is_optimal():
    """Against all length assignments of a tiny alphabet."""
    from itertools import product

    counts = np.array([1, 1, 2, 4, 8, 16])
    best = min(sum(c * x for c, x in zip(counts, ls, strict=True)) for ls in product(range(1, 5), repeat=6) if sum(2.0**-x for x in ls) <= 1)
    lengths = huffman.code_lengths(counts, 4)
    assert lengths.max() <= 4 and int((counts * lengths).sum()) == best


def test_ids_digest(spark):
    path = P.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    rows = sorted(huffman.ids_digest(docs_frame(spark), path).collect(), key=lambda r: (r["doc_id"], r["start"]))
    start = 0
    for (i, t), r in zip(sorted(awkward_texts(), key=lambda x: x[0]), rows, strict=True):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert huffman.ids_digest(empty_frame(spark), path).count() == 0


#: Cuts beside spaces and marks, added tokens, scripts beyond the settled ones, the mark that `Pieces` cuts with.
EDGES = [
    "a <|endoftext|> b", "a<|endoftext|>, b", "<|endoftext|><|endoftext|>", "<|endoftext|", "a  b", "a \n b", "\n c", " lead", "  lead", "trail ", "x\x01y z", "a.b, c.\nD", "", "don't we'll. 5,000.5 ,x", "日本語。 テスト, x",
    "a\u3000 b", "e\u0301, x", "a\x85 b", "naïve,café.", "a\xa0 b", "word,\n\n next", "ǅ.x ɐ,b", "\x1c x", "tab\t x", ",,, a", "a ,b", "1,2 3.4", "x" * 300 + ", y",
]


@pytest.mark.parametrize("as_text", [False, True])
def test_ids_are_the_library_s(as_text):
    path = P.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    library.encode_special_tokens = as_text
    with open(path, encoding="utf-8") as f:
        tokens = huffman.Tokens.of(f.read(), as_text)
    r = random.Random(8)
    texts = EDGES + ["".join(r.choice(EDGES) for _ in range(r.randrange(5))) for _ in range(300)]
    for _ in range(2):
        assert [i.tolist() for i in tokens.encode(pa.array(texts))] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_edges_through_the_transducer(codec, reference):
    assert [i.tolist() for i in codec.encode(pa.array(EDGES))] == [reference.encode_ordinary(t) for t in EDGES]
    # A slice of an array, and rows in batches by their bytes.
    assert [i.tolist() for i in codec.encode(pa.array(EDGES).slice(5, 7))] == [reference.encode_ordinary(t) for t in EDGES[5:12]]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(EDGES))), pa.array(EDGES)], names=["a", "b"])
    assert [x for b in pieces.by_bytes([batch], most=20) for x in b.column(1).to_pylist()] == EDGES


def test_table_of_pieces_stays_small(codec, reference):
    """A table that is full loses the half that came first; ids stay the same."""
    small = pieces.Pieces(codec.words, codec.find, codec.kind, most=40)
    r = random.Random(5)
    for _ in range(30):
        texts = [" ".join("".join(r.choice("etaoin") for _ in range(r.randrange(1, 90))) for _ in range(r.randrange(9))) for _ in range(5)]
        assert [i.tolist() for i in small.encode(pa.array(texts))] == [reference.encode_ordinary(t) for t in texts]
        assert len(small.table.keys) <= 40 + 5 * 9 + 1 and len(small.table.ids) == small.table.sizes.sum()


def test_another_pattern_is_searched_whole(reference):
    with open(RANKS, "rb") as f:
        raw = f.read()
    pattern = r"\S+|\s+"
    other = tiktoken.Encoding("other", pat_str=pattern, mergeable_ranks=reference._mergeable_ranks, special_tokens={})
    assert [i.tolist() for i in bpe.Codec(raw, pattern).encode(pa.array(EDGES))] == [other.encode_ordinary(t) for t in EDGES]
