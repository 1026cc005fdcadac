"""Byte-level BPE as a lazily determinised finite-state transducer, and decoding by an incremental UTF-8 state machine.

Two tokens may stand side by side in an encoding exactly if no merge crosses their border
before the merges within them are done, so an encoding is a path of tokens whose neighbours
all agree. That makes a nondeterministic transducer over bytes: either the token being read
goes on (a step in a trie of the vocabulary) or it ends here and another begins. ``Encoder``
determinises it while it reads: a state is the set of paths still alive, less the tokens all
of them share, which are emitted at once. It is lazy in two ways: a step is determinised
only when it has been asked for ``Encoder.warm`` times, until then the pre-token is read by
the nondeterministic machine; and states are kept in bounded tables that are cleared when
full and grow again from the text, so memory doesn't follow the input.
"""

from __future__ import annotations

import base64
import gc
import hashlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pieces import Pieces, by_bytes
from .shared import slices, whole, whole_strings

FOREVER = 1 << 62
# Fixed value: the pre-token pattern whose borders `Pieces` knows.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Vocabulary:
    """Token bytes by rank, and the merges that the ranks imply."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.rank, self.bytes = ranks, {i: b for b, i in ranks.items()}
        self.split: dict[int, tuple[int, int] | None] = {}
        self.left: dict[int, list[tuple[int, int]]] = {}
        self.right: dict[int, list[tuple[int, int]]] = {}
        self.agree: dict[tuple[int, int], bool] = {}
        self.trie: list[dict[int, int]] = [{}]
        self.ends: list[int | None] = [None]
        for token, i in ranks.items():
            at = 0
            for byte in token:
                if byte not in self.trie[at]:
                    self.trie[at][byte] = len(self.trie)
                    self.trie.append({})
                    self.ends.append(None)
                at = self.trie[at][byte]
            self.ends[at] = i

    @classmethod
    def parse(cls, lines: bytes) -> Vocabulary:
        """From lines of base64 token and rank."""
        return cls({base64.b64decode(t): int(r) for t, r in (x.split() for x in lines.splitlines() if x.strip())})

    def merged(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes ``token``: what merging its bytes by lower ranks leaves."""
        if token not in self.split:
            parts = [bytes((b,)) for b in self.bytes[token]]
            while len(parts) > 2:
                options = [(self.rank.get(parts[i] + parts[i + 1], FOREVER), i) for i in range(len(parts) - 1)]
                rank, i = min(options)
                if rank >= token:
                    raise ValueError(f"no merges make the token {self.bytes[token]!r}")
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            self.split[token] = (self.rank[parts[0]], self.rank[parts[1]]) if len(parts) == 2 else None
        return self.split[token]

    def edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """The tokens at one end of ``token``, from itself down to a byte, each with the rank of the merge that consumes it."""
        known = self.right if side else self.left
        if token not in known:
            out, at, used = [], token, FOREVER
            while True:
                out.append((at, used))
                parts = self.merged(at)
                if parts is None:
                    break
                used, at = at, parts[side]
            known[token] = out[::-1]
        return known[token]

    def adjacent(self, a: int, b: int) -> bool:
        """Whether ``a`` then ``b`` stay as they are when their bytes are merged together."""
        key = (a, b)
        if (known := self.agree.get(key)) is not None:
            return known
        xs, ys = self.edge(a, 1), self.edge(b, 0)
        i = j = 0
        ok = True
        while True:
            (x, x_used), (y, y_used) = xs[i], ys[j]
            across = self.rank.get(self.bytes[x] + self.bytes[y], FOREVER)
            if across < x_used and across <= y_used and across < FOREVER:
                ok = False
                break
            if x_used == y_used == FOREVER:
                break
            if x_used <= y_used:
                i += 1
            else:
                j += 1
        if len(self.agree) > 400_000:
            self.agree.clear()
        self.agree[key] = ok
        return ok


class Encoder:
    """Encodes the bytes of one pre-token at a time."""

    def __init__(self, vocabulary: Vocabulary, most_states: int = 50_000, warm: int = 16) -> None:
        self.v, self.most, self.warm = vocabulary, most_states, warm
        self.clear()

    def clear(self) -> None:
        # A path: the tokens it has ended since the last emitted one, and the trie node of the token it is reading.
        self.states: list[tuple[int | None, tuple]] = [(None, (((), 0),))]
        self.ids: dict[tuple, int] = {self.states[0]: 0}
        self.steps: list[dict[int, tuple[int, tuple[int, ...]]]] = [{}]
        self.finals: dict[int, tuple[int, ...]] = {}
        self.asked: dict[tuple[int, int], int] = {}

    def ended(self, last: int | None, path: tuple) -> tuple[int, ...] | None:
        """The path's tokens with the one it is reading, if that may end here."""
        done, node = path
        token = self.v.ends[node]
        before = done[-1] if done else last
        if token is None or before is not None and not self.v.adjacent(before, token):
            return None
        return (*done, token)

    def step(self, at: int, byte: int) -> tuple[int, tuple[int, ...]]:
        last, paths = self.states[at]
        fresh = self.v.trie[0].get(byte)
        found = []
        for path in paths:
            onward = self.v.trie[path[1]].get(byte)
            if onward is not None:
                found.append((path[0], onward))
            if path[1] and fresh is not None and (done := self.ended(last, path)) is not None:
                found.append((done, fresh))
        if not found:
            raise ValueError("the vocabulary lacks a byte")
        shared = 0
        for column in zip(*(p[0] for p in found), strict=False):
            if len(set(column)) > 1:
                break
            shared += 1
        out = found[0][0][:shared]
        state = (out[-1] if out else last, tuple((p[0][shared:], p[1]) for p in found))
        if (to := self.ids.get(state)) is None:
            to = self.ids[state] = len(self.states)
            self.states.append(state)
            self.steps.append({})
        self.steps[at][byte] = to, out
        return to, out

    def read(self, data: bytes) -> list[int]:
        """The path through the nondeterministic machine: each prefix has one encoding, so its last token is enough."""
        n, trie, ends, agree = len(data), self.v.trie, self.v.ends, self.v.agree
        last: list[int | None] = [None] * (n + 1)
        start = [0] * (n + 1)
        for j in range(n):
            before = last[j]
            if before is None and j:
                continue
            node = 0
            for i in range(j, n):
                node = trie[node].get(data[i])
                if node is None:
                    break
                token = ends[node]
                if token is not None and last[i + 1] is None:
                    if j:
                        ok = agree.get((before, token))
                        if ok is None:
                            ok = self.v.adjacent(before, token)
                        if not ok:
                            continue
                    last[i + 1], start[i + 1] = token, j
        if last[n] is None:
            raise ValueError("the vocabulary lacks a byte")
        out = []
        while n:
            out.append(last[n])
            n = start[n]
        return out[::-1]

    def encode(self, data: bytes) -> list[int]:
        if not data:
            return []
        out: list[int] = []
        at, steps = 0, self.steps
        for byte in data:
            known = steps[at].get(byte)
            if known is None:
                asked = self.asked.get((at, byte), 0) + 1
                if asked < self.warm:
                    self.asked[at, byte] = asked
                    if len(self.asked) > self.most:
                        self.asked.clear()
                    return self.read(data)
                if len(self.states) >= self.most:
                    self.clear()
                    return self.read(data)
                known = self.step(at, byte)
            at, tokens = known
            if tokens:
                out += tokens
        final = self.finals.get(at)
        if final is None:
            last, paths = self.states[at]
            final = next(done for p in paths if (done := self.ended(last, p)) is not None)
            self.finals[at] = final
        out += final
        return out


def utf8_states() -> list[dict[int, int]]:
    """The state machine of well-formed UTF-8: by state, the next state for each byte allowed; 0 is between characters."""
    ranges = {
        0: [(0x00, 0x7F, 0), (0xC2, 0xDF, 1), (0xE0, 0xE0, 2), (0xE1, 0xEC, 3), (0xED, 0xED, 4), (0xEE, 0xEF, 3), (0xF0, 0xF0, 5), (0xF1, 0xF3, 6), (0xF4, 0xF4, 7)],
        1: [(0x80, 0xBF, 0)], 2: [(0xA0, 0xBF, 1)], 3: [(0x80, 0xBF, 1)], 4: [(0x80, 0x9F, 1)], 5: [(0x90, 0xBF, 3)], 6: [(0x80, 0xBF, 3)], 7: [(0x80, 0x8F, 3)],
    }
    return [{b: to for lo, hi, to in ranges[s] for b in range(lo, hi + 1)} for s in range(8)]


class Decoder:
    """Ids to bytes; follows UTF-8 state over token borders, so characters that tokens split are given out whole."""

    def __init__(self, vocabulary: dict[int, bytes]) -> None:
        self.bytes, self.machine = vocabulary, utf8_states()
        size = max(vocabulary) + 1
        self.list = [vocabulary.get(i, b"") for i in range(size)]
        self.known = np.zeros(size, bool)
        self.known[list(vocabulary)] = True
        self.complete = np.array([self.run(0, b) == 0 for b in self.list])
        self.steps: dict[tuple[int, int], int | None] = {}

    def run(self, state: int, data: bytes) -> int | None:
        for b in data:
            nxt = self.machine[state].get(b)
            if nxt is None:
                return None
            state = nxt
        return state

    def after(self, state: int, token: int) -> int | None:
        key = (state, token)
        if key not in self.steps:
            self.steps[key] = self.run(state, self.list[token])
        return self.steps[key]

    def stream(self, ids: Iterable[int]) -> Iterator[str]:
        """The text as far as it is certain after each id; ill-formed bytes raise."""
        state, held = 0, b""
        for i in ids:
            if i not in self.bytes:
                raise ValueError(f"unknown id {i}")
            state = self.after(state, i)
            if state is None:
                raise ValueError("ids don't decode to well-formed UTF-8")
            held += self.bytes[i]
            if state == 0:
                yield held.decode()
                held = b""
        if held:
            raise ValueError("ids end within a character")

    def whole(self, ids: np.ndarray) -> bytes:
        """The bytes of all ids. Tokens that are whole characters leave the machine between characters, so only the others are stepped."""
        if not len(ids):
            return b""
        if int(ids.max()) >= len(self.list) or not self.known[ids].all():
            raise ValueError("unknown id")
        odd = np.flatnonzero(~self.complete[ids])
        state, expected = 0, 0
        for i in odd.tolist():
            if state and i != expected:
                raise ValueError("ids don't decode to well-formed UTF-8")
            state, expected = self.after(state, int(ids[i])), i + 1
            if state is None:
                raise ValueError("ids don't decode to well-formed UTF-8")
        if state:
            raise ValueError("ids end within a character")
        get = self.list.__getitem__
        return b"".join(map(get, ids.tolist()))


#: Pieces of text that a task's table keeps with their ids.
PIECES = 600_000


class Codec:
    """Encoder and decoder of one vocabulary and pre-token pattern, kept by worker processes between tasks."""

    kept: dict[str, Codec] = {}

    def __init__(self, ranks: bytes, pattern: str, most: int = PIECES) -> None:
        import regex

        gc.set_threshold(200_000, 50, 100)  # the tables hold millions of objects and no cycles; walking them often costs a third of the time
        self.vocabulary = Vocabulary.parse(ranks)
        self.kind = np.uint16 if max(self.vocabulary.bytes) < 1 << 16 else np.uint32
        self.encoder, self.decoder = Encoder(self.vocabulary), Decoder(self.vocabulary.bytes)
        self.pieces = Pieces(self.words, regex.compile(pattern).findall, self.kind, most=most)
        # The cuts of `Pieces` are borders of this pattern's pre-tokens; under another pattern texts are searched whole.
        self.cuts, self.find = pattern == PATTERN, regex.compile(pattern).findall
        self.digits = [str(i) for i in range(max(self.vocabulary.bytes) + 1)]

    def words(self, words: list[str]) -> list[bytes]:
        encode, code = self.encoder.encode, "H" if self.kind is np.uint16 else "I"
        return [array(code, encode(w.encode())).tobytes() for w in words]

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text: the transducer reads every distinct pre-token that wasn't met lately."""
        if self.cuts:
            return self.pieces.encode(texts)
        return [np.frombuffer(b"".join(self.words(self.find(t))), self.kind) for t in texts.to_pylist()]

    @classmethod
    def of(cls, ranks: bytes, pattern: str, most: int = PIECES) -> Codec:
        key = hashlib.sha256(ranks + f"{most} {pattern}".encode()).hexdigest()
        if key not in cls.kept:
            cls.kept.clear()
            cls.kept[key] = cls(ranks, pattern, most)
        return cls.kept[key]


def encode_texts(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): a row for each row of ``docs``; null and empty texts have no ids.

    The vocabulary file is read by the driver and sent once to each executor; its size
    is the tokenizer's, not the corpus's.
    """
    with open(ranks_path, "rb") as f:
        sent = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches):
        codec = Codec.of(sent.value, pattern)
        for batch in by_bytes(batches):
            ids = codec.encode(whole_strings(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([i.astype(np.int32) for i in ids], pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), whole(text_col).alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode_ids(encoded: DataFrame, ranks_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text): null ids give null; unknown ids and ids that end within a character fail the query."""
    with open(ranks_path, "rb") as f:
        sent = encoded.sparkSession.sparkContext.broadcast(f.read())

    def run(batches):
        decoder = Codec.of(sent.value, "").decoder
        for batch in slices(batches):
            texts = [None if i is None else "".join(decoder.stream(i)) for i in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", most: int = PIECES) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): each whole text encoded, and its ids decoded again.

    Nulls are empty texts, which have no tokens. ``most`` pieces of text are kept with their ids in a task's table. One pass over the rows, no shuffle.
    """
    with open(ranks_path, "rb") as f:
        sent = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches):
        codec = Codec.of(sent.value, pattern, most)
        digits, sha = codec.digits.__getitem__, hashlib.sha256
        for batch in by_bytes(batches):
            all_ids = codec.encode(whole_strings(batch.column(1)))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(i) for i in all_ids], pa.int64()),
                    pa.array([sha(" ".join(map(digits, i.tolist())).encode()).hexdigest() for i in all_ids], pa.string()),
                    pa.array([sha(codec.decoder.whole(i)).hexdigest() for i in all_ids], pa.string()),
                ],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), whole(text_col).alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
