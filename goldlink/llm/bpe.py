"""Byte-level BPE by a lazily determinised finite-state transducer, and streaming decoding.

Encoding. A token sequence is the BPE encoding of its bytes exactly if each token encodes to itself and
each adjacent pair re-encodes to itself, so the merge table defines a nondeterministic transducer over
bytes: walk the vocabulary's trie, and wherever a token ends that is compatible with the one before,
start again at the root. Exactly one hypothesis survives at the end of a piece. The transducer is
determinised while it runs: a state is the set of live hypotheses (token before, tokens not yet
emitted, trie node), tokens that all hypotheses share are emitted at once, so output lags input by no
more than the hypotheses differ, which the longest token bounds. Transitions are kept in a table that
is dropped and regrown when it gets large.

Decoding joins token bytes; an incremental UTF-8 state machine releases text only at character
boundaries, so tokens can be fed in chunks of any size.

Defined results: a null text counts as empty and gives no tokens; repeated rows and other columns are kept;
text of any length is processed whole; ill-formed bytes at decoding give U+FFFD as Python's ``replace`` does.
"""

from __future__ import annotations

import base64
import gc
import hashlib
from collections.abc import Iterable, Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from goldlink.llm.common import release


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class Transducer:
    """bytes of one piece → token ids; the deterministic automaton grows with use."""

    def __init__(self, ranks: dict[bytes, int], most_states: int = 400_000):
        self.ranks, self.most_states = ranks, most_states
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.child: dict[int, int] = {}  # node << 8 | byte → node; the root is 0
        self.token_at: dict[int, int] = {}
        self.inner: set[int] = set()
        n = 1
        for token, rank in ranks.items():
            node = 0
            for byte in token:
                self.inner.add(node)
                key = node << 8 | byte
                nxt = self.child.get(key)
                if nxt is None:
                    nxt = self.child[key] = n
                    n += 1
                node = nxt
            self.token_at[node] = rank
        self.never = 1 << 31
        self.edges: tuple[dict, dict] = ({}, {})
        self.pairs: dict[int, bool] = {}
        self.alone: dict[int, bool] = {}
        self.reset()

    def reset(self) -> None:
        start = ((-1, (), 0),)
        self.number = {start: 0}
        self.states = [start]
        self.moves: list[dict[int, tuple[tuple[int, ...], int]]] = [{}]
        self.flush: list[tuple[int, ...] | None] = [()]

    def forget(self) -> None:
        """Drop the states, and what was found about tokens and pairs of them."""
        for known in (*self.edges, self.pairs, self.alone):
            known.clear()
        self.reset()

    def merges(self, data: bytes) -> list[bytes]:
        """The definition: merge the adjacent pair of lowest rank, leftmost first, until none is left."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                rank = self.ranks.get(parts[i] + parts[i + 1])
                if rank is not None and (best is None or rank < best):
                    best, at = rank, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def edge(self, token: int, left: bool) -> list[tuple[bytes, int]]:
        """The pieces that stand at one end of a token while it is merged, each with the rank that ends it."""
        known = self.edges[left].get(token)
        if known is None:
            known, data = [], self.bytes_of[token]
            parts = [data[i : i + 1] for i in range(len(data))]
            while len(parts) > 1:
                rank, at = min((self.ranks.get(parts[i] + parts[i + 1], self.never), i) for i in range(len(parts) - 1))
                if at == (0 if left else len(parts) - 2):
                    known.append((parts[0 if left else -1], rank))
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            known.append((data, self.never))
            self.edges[left][token] = known
        return known

    def meet(self, before: int, token: int) -> bool:
        """Whether no merge crosses the border of two tokens: at no time do the pieces that face each other
        there form a token of lower rank than what ends either of them (an equal rank goes to the left one)."""
        a, b = self.edge(before, False), self.edge(token, True)
        i = j = 0
        get = self.ranks.get
        while True:
            p, p_end = a[i]
            q, q_end = b[j]
            rank = get(p + q)
            if rank is not None and rank < p_end and rank <= q_end:
                return False
            if p_end <= q_end:
                if p_end == self.never:
                    return True
                i += 1
            else:
                j += 1

    def fits(self, before: int, token: int) -> bool:
        if before < 0:
            known = self.alone.get(token)
            if known is None:
                data = self.bytes_of[token]
                known = self.alone[token] = self.merges(data) == [data]
            return known
        key = before << 32 | token
        known = self.pairs.get(key)
        if known is None:
            known = self.pairs[key] = self.meet(before, token)
            if len(self.pairs) > 4 * self.most_states:
                self.pairs.clear()
        return known

    def step(self, state: int, byte: int) -> tuple[tuple[int, ...], int]:
        """Determinise one transition: what is emitted, and the next state."""
        live: list[tuple[int, tuple[int, ...], int]] = []
        child, inner, token_at, pairs = self.child, self.inner, self.token_at, self.pairs
        for before, waiting, node in self.states[state]:
            node = child.get(node << 8 | byte)
            if node is None:
                continue
            if node in inner:
                live.append((before, waiting, node))
            token = token_at.get(node)
            if token is not None:
                last = waiting[-1] if waiting else before
                fit = True if last < 0 else pairs.get(last << 32 | token)
                if fit is None:
                    fit = self.fits(last, token)
                if fit and self.fits(-1, token):
                    live.append((before, (*waiting, token), 0))
        first = live[0][1]
        shared = len(first)
        for _, w, _ in live:
            n = 0
            while n < shared and n < len(w) and w[n] == first[n]:
                n += 1
            shared = n
            if not n:
                break
        if shared:
            last = first[shared - 1]
            live = [(last, w[shared:], node) for _, w, node in live]
        if live[0][0] >= 0 and all(w for _, w, _ in live):  # the token before faces no open end: states merge without it
            live = [(-1, w, node) for _, w, node in live]
        live.sort()
        key = tuple(live)
        to = self.number.get(key)
        if to is None:
            to = self.number[key] = len(self.states)
            self.states.append(key)
            self.moves.append({})
            self.flush.append(next((w for _, w, node in key if node == 0), None))
        move = self.moves[state][byte] = (first[:shared], to)
        return move

    def encode(self, piece: bytes) -> tuple[int, ...]:
        if len(self.states) > self.most_states:
            self.reset()
        state, out = 0, []
        moves = self.moves
        for byte in piece:
            emitted, state = moves[state].get(byte) or self.step(state, byte)
            if emitted:
                out += emitted
        return (*out, *self.flush[state])


class _Pieces(dict):
    """piece → ids, filled by the transducer; two generations, so that frequent pieces outlive a change."""

    def __init__(self, transducer: Transducer, most: int):
        super().__init__()
        self.transducer, self.most, self.old = transducer, most, {}

    def __missing__(self, piece: str) -> tuple[int, ...]:
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        ids = self.old.get(piece)
        if ids is None:
            ids = self.transducer.encode(piece.encode("utf-8", "surrogatepass"))
        self[piece] = ids
        return ids


class Encoder:
    def __init__(self, ranks: dict[bytes, int], pattern: str, most_pieces: int = 500_000):
        self.find = regex.compile(pattern).findall
        self.transducer = Transducer(ranks)
        self.pieces = _Pieces(self.transducer, most_pieces)

    def forget(self) -> None:
        """Drop what was learnt from texts; the vocabulary stays."""
        self.pieces.old = {}
        self.pieces.clear()
        self.transducer.forget()
        gc.collect()  # idle workers would keep what hangs in cycles
        release()

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.pieces.__getitem__, self.find(text))))


class Utf8Machine:
    """Splits a byte stream at character boundaries, a chunk at a time."""

    def __init__(self):
        self.held = b""

    @staticmethod
    def unfinished(data: bytes) -> int:
        """How many last bytes are a character that has begun but may still be completed."""
        for back in range(1, min(3, len(data)) + 1):
            lead = data[-back]
            if lead & 0xC0 == 0x80:
                continue
            need = 2 if 0xC2 <= lead <= 0xDF else 3 if 0xE0 <= lead <= 0xEF else 4 if 0xF0 <= lead <= 0xF4 else 1
            if need <= back:
                return 0
            if back > 1:
                low, high = {0xE0: (0xA0, 0xBF), 0xED: (0x80, 0x9F), 0xF0: (0x90, 0xBF), 0xF4: (0x80, 0x8F)}.get(lead, (0x80, 0xBF))
                if not low <= data[-back + 1] <= high:
                    return 0
            return back
        return 0

    def feed(self, data: bytes) -> str:
        data = self.held + data
        cut = len(data) - self.unfinished(data)
        self.held = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def close(self) -> str:
        rest, self.held = self.held, b""
        return rest.decode("utf-8", "replace")


class Decoder:
    def __init__(self, ranks: dict[bytes, int]):
        self.table = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.table[i] = token

    def stream(self, chunks: Iterable[Iterable[int]]) -> Iterator[str]:
        machine = Utf8Machine()
        get = self.table.__getitem__
        for ids in chunks:
            text = machine.feed(b"".join(map(get, ids)))
            if text:
                yield text
        if rest := machine.close():
            yield rest

    def decode(self, ids: Sequence[int], chunk: int = 4096) -> str:
        return "".join(self.stream(ids[i : i + chunk] for i in range(0, len(ids), chunk)))


_LOADED: dict[tuple[str, str], tuple[Encoder, Decoder]] = {}


def codec(path: str, pattern: str) -> tuple[Encoder, Decoder]:
    """One encoder and decoder for each worker process and vocabulary."""
    if (path, pattern) not in _LOADED:
        ranks = load_ranks(path)
        _LOADED[path, pattern] = Encoder(ranks, pattern), Decoder(ranks)
    return _LOADED[path, pattern]


def _slices(batch: pa.RecordBatch, rows: int = 200) -> Iterator[pa.RecordBatch]:
    """A batch in parts, so that token ids of few documents are held at a time."""
    for low in range(0, batch.num_rows, rows):
        yield batch.slice(low, rows)


def _lists(ids: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids) if ids else np.zeros(0, dtype=np.int32)))


def encode_column(df: DataFrame, text: str = "text", ids: str = "ids", path: str | None = None, pattern: str | None = None, check: str | None = None) -> DataFrame:
    """``df`` with an array<int> column of token ids; ``check`` names a boolean column that tells whether they decode to the text.

    Input columns of these names are replaced. What a task has learnt is dropped at its end, as other stages need the memory.
    """
    path, pattern = path or default_vocabulary(), pattern or default_pattern()
    named = [check] if check else []
    body = df.drop(ids, *named)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = codec(path, pattern)
        for batch in batches:
            for part in _slices(batch):
                texts = [t.as_py() or "" for t in part.column(text)]
                found = [np.array(encoder.encode(t), dtype=np.int32) for t in texts]
                more = [pa.array([decoder.decode(i) == t for i, t in zip(found, texts, strict=True)], pa.bool_())] if check else []
                yield pa.RecordBatch.from_arrays([*part.columns, _lists(found), *more], names=[*part.schema.names, ids, *named])
        encoder.forget()

    extra = [T.StructField(ids, T.ArrayType(T.IntegerType())), *[T.StructField(n, T.BooleanType()) for n in named]]
    return body.mapInArrow(run, T.StructType([*body.schema.fields, *extra]))


def decode_column(df: DataFrame, ids: str = "ids", text: str = "text", path: str | None = None) -> DataFrame:
    """``df`` with a string column decoded from the ids; null ids give an empty text."""
    path, pattern = path or default_vocabulary(), default_pattern()
    body = df.drop(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, decoder = codec(path, pattern)
        for batch in batches:
            for part in _slices(batch):
                out = pa.array([decoder.decode(x.as_py() or []) for x in part.column(ids)], type=pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, out], names=[*part.schema.names, text])

    return body.mapInArrow(run, T.StructType([*body.schema.fields, T.StructField(text, T.StringType())]))


def op4_bpe(documents: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Digests of every document's ids and of the bytes that the ids decode to."""
    path, pattern = path or default_vocabulary(), pattern or default_pattern()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = codec(path, pattern)
        shown = [str(i) for i in range(len(decoder.table))].__getitem__
        for batch in batches:
            counts, id_hashes, text_hashes = [], [], []
            for value in batch.column("text"):
                ids = encoder.encode(value.as_py() or "")
                counts.append(len(ids))
                id_hashes.append(hashlib.sha256(" ".join(map(shown, ids)).encode()).hexdigest())
                text_hashes.append(hashlib.sha256(decoder.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(id_hashes, pa.string()), pa.array(text_hashes, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
