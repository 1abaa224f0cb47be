"""Byte-level BPE: encoding by a lazily determinised transducer, streaming decoding.

A rank file defines the merges. A token sequence is the BPE encoding of its bytes exactly when
each pair of neighbours, merged on its own, stays the same pair. So encoding is a
nondeterministic transducer: it walks the trie of all tokens and may end a token wherever the
pair with the token before is stable. Determinised, its state is the set of live guesses, each
with the tokens it has not yet handed out; what all guesses agree on is emitted. A guess that is
still open reaches back at most the longest token, which bounds the lookahead and the state.
States and transitions are made when text first needs them and are dropped when there are many.

Decoding joins token bytes and feeds them to an incremental UTF-8 machine that holds back an
unfinished character (at most three bytes) until its last byte arrives.

Defined results: a null text is an empty one: no tokens, digests of nothing; null ids and
repeated rows give a row each; texts of any length are encoded whole; other columns are not read.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import struct
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenure.llm.common import text_slices

#: Entries after which a worker's caches start anew, and the longest cached piece.
MAX_STATES = 250_000
MAX_PAIRS = 1_000_000
MAX_PIECES = 250_000
LONG_PIECE = 64
#: Tokens decoded, and documents handed on, at a time.
DECODE_BLOCK, SLICE = 65_536, 1_000


def parse_ranks(data: bytes) -> list[bytes]:
    """Token bytes by id, from the lines ``base64 rank`` of a rank file."""
    pairs = [line.split() for line in data.splitlines() if line.strip()]
    tokens: list[bytes] = [b""] * (max(int(r) for _, r in pairs) + 1)
    for token, rank in pairs:
        tokens[int(rank)] = base64.b64decode(token)
    return tokens


class Transducer:
    """Maps bytes to token ids; one per worker process and vocabulary."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        self.ranks = {t: i for i, t in enumerate(tokens) if t}
        self.trie: dict[int, int] = {}
        self.ends = [-1]
        for token, rank in self.ranks.items():
            node = 0
            for byte in token:
                step = node << 8 | byte
                node = self.trie.setdefault(step, len(self.ends))
                if node == len(self.ends):
                    self.ends.append(-1)
            self.ends[node] = rank
        self.inner = bytearray(len(self.ends))
        for step in self.trie:
            self.inner[step >> 8] = 1
        self.packed = [struct.pack("<I", i) for i in range(len(tokens))]
        self.stable: dict[int, bool] = {}
        self.edges: tuple[dict, dict] = ({}, {})
        self._restart()

    def _restart(self) -> None:
        start = ((0, -1, ()),)
        self.states = [start]
        self.index = {start: 0}
        self.steps: dict[int, tuple[bytes, int]] = {}
        self.finals: dict[int, bytes] = {}
        if len(self.stable) > MAX_PAIRS:
            self.stable.clear()

    def _halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes a token; None for a byte or one that no merge makes."""
        data = self.tokens[token]
        parts = [data[i:i + 1] for i in range(len(data))]
        while len(parts) > 2:
            rank, at = min((self.ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank == 1 << 60:
                return None
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else None

    def _edge(self, token: int, right: bool) -> list[tuple[bytes, int, int]] | None:
        """What stands at one edge of a token while it is merged: (bytes, made at, taken up at).

        Merges go by rising rank, so ranks serve as time. None if merging never makes the token.
        """
        known = self.edges[right].get(token, 0)
        if known != 0:
            return known
        out = None
        data = self.tokens[token]
        if len(data) == 1:
            out = [(data, -1, 1 << 60)]
        else:
            halves = self._halves(token)
            inner = halves and self._edge(halves[right], right)
            if inner and self._edge(halves[not right], right):
                last = inner[-1]
                out = [*inner[:-1], (last[0], last[1], token), (data, token, 1 << 60)]
        self.edges[right][token] = out
        return out

    def _can_follow(self, last: int, token: int) -> bool:
        """Whether ``token`` may come after ``last`` (-1: nothing) in an encoding.

        It may unless some merge across the boundary comes before both sides are done with the
        parts it needs; at equal rank the merge further left goes first.
        """
        ok = self.stable.get(last << 32 | token)
        if ok is None:
            right = self._edge(token, False)
            if right is None:
                ok = False
            elif last < 0:
                ok = True
            else:
                ok, find = True, self.ranks.get
                for x, x_made, x_taken in self._edge(last, True):
                    for y, y_made, y_taken in right:
                        if x_made < y_taken and y_made < x_taken:
                            rank = find(x + y)
                            if rank is not None and rank < x_taken and rank <= y_taken:
                                ok = False
            self.stable[last << 32 | token] = ok
        return ok

    def _step(self, state: int, byte: int) -> tuple[bytes, int]:
        """Determinise one transition."""
        live, step, ends, inner, known = [], self.trie.get, self.ends, self.inner, self.stable
        for node, last, held in self.states[state]:
            child = step(node << 8 | byte)
            if child is not None:
                if inner[child]:  # a token that no longer one begins with must end here
                    live.append((child, last, held))
                token = ends[child]
                if token >= 0:
                    pair = last << 32 | token
                    if known[pair] if pair in known else self._can_follow(last, token):
                        live.append((0, token, (*held, token)))
        emitted = b""
        if len(live) == 1:
            first = final = live[0][2]
        else:
            held = [g[2] for g in live]
            first, final = min(held), max(held)
        if first:  # what the first and the last in order begin with, all begin with
            common, most = 0, min(len(first), len(final))
            while common < most and first[common] == final[common]:
                emitted += self.packed[first[common]]
                common += 1
            if common:
                live = [(n, last, held[common:]) for n, last, held in live]
        target = tuple(live)
        to = self.index.setdefault(target, len(self.states))
        if to == len(self.states):
            self.states.append(target)
        out = self.steps[state << 8 | byte] = (emitted, to)
        return out

    def encode(self, data: bytes) -> bytes:
        """Token ids as little-endian unsigned 32-bit integers."""
        if len(self.states) > MAX_STATES:
            self._restart()
        whole = self.ranks.get(data)
        if whole is not None:
            return self.packed[whole]
        state, out, known = 0, [], self.steps.get
        for byte in data:
            step = known(state << 8 | byte)
            if step is None:
                step = self._step(state, byte)
                if len(self.states) > 2 * MAX_STATES:  # inside one very long piece: keep only where we are
                    here = self.states[step[1]]
                    self._restart()
                    known = self.steps.get
                    to = self.index.setdefault(here, len(self.states))
                    if to == len(self.states):
                        self.states.append(here)
                    step = step[0], to
            emitted, state = step
            if emitted:
                out.append(emitted)
        last = self.finals.get(state)
        if last is None:
            held = next(h for node, _, h in self.states[state] if node == 0)
            last = self.finals[state] = b"".join([self.packed[t] for t in held])
        out.append(last)
        return b"".join(out)


class _Pieces(dict):
    """Packed ids of recent pieces: a full generation becomes the old one, which is then dropped."""

    def __init__(self, transducer: Transducer):
        super().__init__()
        self.transducer = transducer
        self.old: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            ids = self.transducer.encode(piece.encode())
        if len(piece) <= LONG_PIECE:
            if len(self) >= MAX_PIECES:
                self.old = dict(self)
                self.clear()
            self[piece] = ids
        return ids


class Encoder:
    """Splits text by the pattern and encodes every piece."""

    def __init__(self, tokens: list[bytes], pattern: str):
        self.tokens = tokens
        self.split = regex.compile(pattern)
        self.pieces = _Pieces(Transducer(tokens))

    def ids(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self.split.findall(text)))


class Utf8Stream:
    """Incremental UTF-8: text of the bytes so far, without an unfinished last character."""

    def __init__(self) -> None:
        self.pending = b""

    @staticmethod
    def unfinished(data: bytes) -> int:
        """How many bytes at the end begin a character that needs more."""
        for back in range(1, min(4, len(data) + 1)):
            byte = data[-back]
            if byte & 0xC0 == 0x80:
                continue
            need = 2 if 0xC2 <= byte <= 0xDF else 3 if 0xE0 <= byte <= 0xEF else 4 if 0xF0 <= byte <= 0xF4 else 1
            if need <= back:
                return 0
            if back > 1:  # the second byte of some leads has a narrower range
                low, high = {0xE0: (0xA0, 0xBF), 0xED: (0x80, 0x9F), 0xF0: (0x90, 0xBF), 0xF4: (0x80, 0x8F)}.get(byte, (0x80, 0xBF))
                if not low <= data[1 - back] <= high:
                    return 0
            return back
        return 0

    def feed(self, data: bytes) -> str:
        data = self.pending + data
        cut = len(data) - self.unfinished(data)
        self.pending = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def finish(self) -> str:
        rest, self.pending = self.pending, b""
        return rest.decode("utf-8", "replace")


def decode(tokens: list[bytes], ids: Iterable[int]) -> Iterator[str]:
    """Text of a stream of ids, in pieces that never split a character."""
    stream, ids = Utf8Stream(), iter(ids)
    while block := list(islice(ids, DECODE_BLOCK)):
        yield stream.feed(b"".join(map(tokens.__getitem__, block)))
    yield stream.finish()


def unpack(ids: bytes) -> memoryview:
    """Packed ids as numbers."""
    return memoryview(ids).cast("I")


_LOADED: dict[tuple[int, str], Encoder] = {}


def encoder(ranks: bytes, pattern: str) -> Encoder:
    """The worker's encoder for a rank file; compiled once, reused by later tasks."""
    key = (hash(ranks), pattern)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Encoder(parse_ranks(ranks), pattern)
        # the tables hold many small tuples and no cycles: the collector need not walk them often
        gc.freeze()
        gc.set_threshold(200_000, 50, 50)
    return _LOADED[key]


def read_ranks(path: str) -> bytes:
    """A rank file (about 1 MB, fixed by the vocabulary), to be broadcast."""
    with open(path, "rb") as f:
        return f.read()


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, with_ids: bool = False, with_text: bool = False,
                     id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row, its whole text encoded and decoded.

    ``with_ids`` adds the ids (array of int), ``with_text`` the decoded text.
    """
    shared = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    extra = ", ids array<int>" * with_ids + ", decoded string" * with_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(shared.value, pattern)
        for batch in batches:
            for part in text_slices(batch, SLICE):
                counts, digests, decoded, packed, texts = [], [], [], [], []
                for cell in part.column("text"):
                    ids = enc.ids(cell.as_py() or "")
                    digest, kept = hashlib.sha256(), []
                    for piece in decode(enc.tokens, unpack(ids)):
                        digest.update(piece.encode())
                        if with_text:
                            kept.append(piece)
                    counts.append(len(ids) // 4)
                    digests.append(hashlib.sha256(ids).hexdigest())
                    decoded.append(digest.hexdigest())
                    if with_ids:
                        packed.append(ids)
                    if with_text:
                        texts.append("".join(kept))
                columns = {"doc_id": part.column("doc_id"), "n_tokens": pa.array(counts, pa.int64()),
                           "ids_sha256": pa.array(digests, pa.string()), "decoded_sha256": pa.array(decoded, pa.string())}
                if with_ids:
                    offsets = np.append(0, np.cumsum(counts)).astype(np.int32)
                    columns["ids"] = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(packed), "<i4")))
                if with_text:
                    columns["decoded"] = pa.array(texts, pa.string())
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + extra)
