"""Ids of whole texts from the ids of their distinct pieces.

A pre-token never goes on from a character that isn't white space into a space, nor from a letter
or digit into a mark or a new line, so a text may be cut there: the ids of the pieces, end to
end, are the ids of the text. Arrow cuts a batch, finds the distinct pieces and looks them up in
a table of those met lately; only pieces that aren't in it are encoded. The ids of the rows are
gathered by place.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MARK = "\x01"
#: Where a text may be cut beside its spaces: between a letter or digit of the scripts named here and a mark.
BORDER = r"([A-Za-z\x{00C0}-\x{00D6}\x{00D8}-\x{00F6}\x{00F8}-\x{024F}0-9])([,.;:!?\n])"
#: A space that follows other white space belongs with it; such texts are cut by `Pieces.spaced`.
SPACED = r"[\s\x0B\x1C-\x1F\x{0085}\pZ] "
#: Pieces of more bytes are encoded whenever they are met and not kept.
LONG = 64


class Table:
    """Pieces and their ids, at most ``most`` of them: when it is full the half that came first goes."""

    def __init__(self, kind: type, most: int) -> None:
        self.kind, self.most = kind, most
        self.keys = pa.array([], pa.string())
        self.sizes, self.ids = np.zeros(0, np.int64), np.zeros(0, kind)

    def places(self, distinct: pa.Array, make: Callable[[list[str]], list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each distinct piece where its ids begin and how many they are, and the ids; ``make`` encodes the pieces that aren't kept."""
        if len(self.keys) > self.most:
            half = len(self.keys) // 2
            self.ids = self.ids[self.sizes[:half].sum() :].copy()
            self.keys, self.sizes = pa.concat_arrays([self.keys.slice(half), pa.array([], pa.string())]), self.sizes[half:].copy()
        at = pc.index_in(distinct, value_set=self.keys)
        unmet = np.flatnonzero(at.is_null().to_numpy(zero_copy_only=False))
        at = at.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        sizes, ids = self.sizes, self.ids
        if len(unmet):
            lacking = distinct.take(pa.array(unmet))
            made = make(lacking.to_numpy(zero_copy_only=False).tolist())
            own = np.fromiter(map(len, made), np.int64, len(made)) // np.dtype(self.kind).itemsize
            at[unmet] = len(sizes) + np.arange(len(unmet))
            sizes, ids = np.concatenate([sizes, own]), np.concatenate([ids, np.frombuffer(b"".join(made), self.kind)])
            short = pc.less_equal(pc.binary_length(lacking), LONG).to_numpy(zero_copy_only=False)
            if short.all():
                self.keys, self.sizes, self.ids = pa.concat_arrays([self.keys, lacking]), sizes, ids
            else:
                self.keys = pa.concat_arrays([self.keys, lacking.filter(pa.array(short))])
                self.sizes = np.concatenate([self.sizes, own[short]])
                self.ids = np.concatenate([self.ids, np.frombuffer(b"".join(m for m, s in zip(made, short.tolist(), strict=True) if s), self.kind)])
        starts = np.cumsum(sizes) - sizes
        return starts[at], sizes[at], ids


class Pieces:
    """``encode_words`` maps distinct pre-tokens to their ids, as unsigned integers of ``kind`` in bytes; ``find`` cuts a piece into pre-tokens.

    ``ordinary`` tells whether a piece may be cut by ``find``; others go to ``encode_words`` as they are.
    """

    def __init__(self, encode_words: Callable[[list[str]], list[bytes]], find: Callable[[str], list[str]], kind: type, ordinary: Callable[[str], bool] = lambda p: True, most: int = 600_000) -> None:
        self.encode_words, self.find, self.kind, self.ordinary = encode_words, find, kind, ordinary
        self.table = Table(kind, most)
        self.cut = re.compile(r"(?<=\S)(?= )")

    def words_of(self, piece: str) -> list[str]:
        """Its pre-tokens; a run of letters with or without a space before it, which most pieces are, needs no pattern."""
        if not piece:
            return []
        if not self.ordinary(piece) or piece.isalpha() or piece[0] == " " and piece[1:].isalpha():
            return [piece]
        return self.find(piece)

    def missing(self, pieces: list[str]) -> list[bytes]:
        parts = list(map(self.words_of, pieces))
        distinct = list({w for ws in parts for w in ws})
        get = dict(zip(distinct, self.encode_words(distinct), strict=True)).__getitem__
        return [get(ws[0]) if len(ws) == 1 else b"".join(map(get, ws)) for ws in parts]

    def spaced(self, text: str) -> np.ndarray:
        """A text in which a space follows other white space: it is cut at the safe spaces alone."""
        pieces = self.cut.split(text)
        distinct = list(dict.fromkeys(pieces))
        get = dict(zip(distinct, self.missing(distinct), strict=True)).__getitem__
        return np.frombuffer(b"".join(map(get, pieces)), self.kind)

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text; there are no nulls."""
        if not len(texts):
            return []
        odd = pc.or_(pc.match_substring_regex(texts, SPACED), pc.match_substring(texts, MARK)).to_numpy(zero_copy_only=False)
        plain = pc.if_else(pa.array(~odd), texts, "") if odd.any() else texts
        marked = pc.replace_substring(pc.replace_substring_regex(plain, BORDER, rf"\1{MARK}\2"), " ", MARK + " ")
        cut = pc.split_pattern(marked, MARK)
        offsets = cut.offsets.to_numpy().astype(np.int64)
        told = cut.flatten().dictionary_encode()
        codes = told.indices.to_numpy(zero_copy_only=False)
        offsets -= offsets[0]
        starts, sizes, ids = self.table.places(told.dictionary, self.missing)
        taken = sizes[codes]
        ends = np.cumsum(taken)
        at = np.repeat(starts[codes] - (ends - taken), taken)
        at += np.arange(len(at))
        out = np.split(ids[at], ends[offsets[1:-1] - 1])
        for i in np.flatnonzero(odd).tolist():
            out[i] = self.spaced(texts[i].as_py())
        return out


def by_bytes(batches, column: int = 1, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose texts have at most ``most`` bytes together, or of one row."""
    for batch in batches:
        sizes = np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            before = sizes[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(sizes, before + most, "right")))
            yield batch.slice(at, to - at)
            at = to
    pa.default_memory_pool().release_unused()
