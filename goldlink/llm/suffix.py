"""Suffix-array deduplication with a logarithmic family of indexes: every later copy of a long match is removed.

A byte is removed if a string of ``length`` bytes that covers it also starts earlier: in a document of smaller id, or
earlier in the same document. Matches never cross documents; all strings are judged on the input.

Index. Suffixes matter here only up to ``length`` bytes. ``LogSuffixIndex`` takes batches of text in document order. A
batch gets a suffix array by prefix doubling: ranks by the first 5 bytes, then 10, 20, 40, 80 and last, by two
overlapping ranks, ``length`` bytes. Neighbours of equal rank have a common prefix of ``length`` bytes or more. The array
is merge-scanned against that of each level, byte by byte where prefixes meet, and what is new becomes a level of its own;
levels of like size are merged in the same way, so that their sizes stay geometric and each suffix is merged O(log n)
times. Every match is one of bytes: hashes only choose what is compared.

Distribution. Only strings whose content recurs need an index. Each string has a minimizer, the smallest hash among
the 32-byte substrings in it, at a place that depends on its content only; equal strings have equal minimizers.
  1. Every document's minimizers go by hash to parts; a part returns the places of those that occur twice or more. Those
     that recur among a task's documents are combined into one message first.
  2. Documents meet those places (co-grouped by document hash) and send the stretch of text under each such
     minimizer to the minimizer's part. Of equal stretches within a task (by 128-bit digests) only the earliest is sent,
     the others are removed at once: a passage or a document with thousands of copies is combined before it is shuffled.
  3. Each part runs an index over its stretches, in document order, and returns which strings occur earlier. A stretch
     that equals an earlier one, byte by byte, is answered at once; the index holds different stretches only.
  4. Documents meet the answers and drop the covered bytes.
A part is sized by ``part_bytes`` of corpus; no step holds more than one part or one group of documents. Only the minimizers at
the edges of a passage keep a stretch for each document that holds it, as what stands before or behind it differs.

Defined results: a null text counts as empty; texts shorter than ``length`` keep all bytes; texts are processed whole
and may have any length; a null id comes after all others; rows of equal id are ordered by a hash of the text, and rows
equal in id and text are one place and get the same result; an empty input gives an empty output.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from goldlink.llm.common import U64, mix64, prefix_hashes, ranges, release, runs, sorted_groups, span_hashes

GRAM = 32
_LAST = np.iinfo(np.int64).max
MARK = np.uint32(0xFFFFFFFF)


#: Bits of a place in a batch: three of them fit into a sort key.
PLACE = 21


def suffix_array(data: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices into ``starts`` (ascending) in the order of data[start : start + length], and which equal the one before.

    ``data`` has fewer than 2**21 bytes; equal strings are in the order of their starts.
    """
    n = len(data)
    place = np.arange(n, dtype=U64)
    mask = U64((1 << PLACE) - 1)
    padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
    rank = np.ndarray(n, dtype=">u8", buffer=padded, strides=(1,)).astype(U64) >> U64(24)
    depth = min(5, length)
    key = (rank >> U64(8 * (5 - depth))) << U64(PLACE) | place
    if depth == length:
        key = key[starts]
    while True:
        key.sort()
        at = (key & mask).astype(np.int64)
        value = key >> U64(PLACE)
        again = np.zeros(len(key), dtype=bool)
        np.equal(value[1:], value[:-1], out=again[1:])
        if depth == length:
            break
        ranks = np.zeros(2 * n, dtype=np.uint32)  # 0 behind the end of the text
        ranks[at] = np.cumsum(~again, dtype=np.uint32)
        step = min(depth, length - depth)  # the last step overlaps, so that ranks cover ``length`` bytes exactly
        depth += step
        if depth == length:
            key, behind, place = ranks[starts].astype(U64), ranks[starts + step], starts.astype(U64)
        else:
            key, behind = ranks[:n].astype(U64), ranks[step : n + step]
        key <<= U64(PLACE)
        key |= behind
        key <<= U64(PLACE)
        key |= place
    order = np.searchsorted(starts, at) if len(starts) < n else at
    return order, again


class LogSuffixIndex:
    """Suffix arrays (places in ``data`` in the order of their first ``length`` bytes) in levels of geometric size."""

    def __init__(self, data: np.ndarray, length: int):
        self.data, self.length = data, length
        padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
        self.lanes = np.ndarray(len(data) + 1, dtype=">u8", buffer=padded, strides=(1,))
        self.strings = np.lib.stride_tricks.as_strided(padded, shape=(len(data) + 1, length), strides=(1, 1))
        self.word = np.uint32 if length % 4 == 0 else np.uint8
        self.levels: list[np.ndarray] = []

    def add(self, places: np.ndarray, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Places in text order, given also as ``starts`` in a copy of their text → which strings occurred before."""
        order, again = suffix_array(data, starts, self.length)
        heads = np.flatnonzero(~again)
        fresh = places[order[heads]]
        met = np.zeros(len(fresh), dtype=bool)
        for level in self.levels:
            met |= self.scan(level, fresh)[1]
        out = np.empty(len(order), dtype=bool)
        again[heads] = met
        out[order] = again
        self.push(fresh[~met])
        return out

    def scan(self, level: np.ndarray, fresh: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge-scan of two arrays: before which entry of ``level`` each of ``fresh`` belongs, and whether it equals it."""
        theirs, mine = self.lanes[level].astype(U64), self.lanes[fresh].astype(U64)
        low = np.searchsorted(theirs, mine, side="left")
        high = np.searchsorted(theirs, mine, side="right")
        for at in range(8, self.length - 7, 8):  # among entries with one prefix the next eight bytes are in order
            row = np.flatnonzero(high - low > 1)
            if not len(row):
                break
            want = self.lanes[fresh[row] + at].astype(U64)
            begin, end = low[row], high[row]
            for last, bound in ((False, low), (True, high)):
                a, b = begin.copy(), end.copy()
                for _ in range(int((b - a).max()).bit_length()):
                    middle = np.minimum((a + b) >> 1, len(level) - 1)
                    seen = self.lanes[level[middle] + at].astype(U64)
                    right = (seen <= want if last else seen < want) & (a < b)
                    a, b = np.where(right, middle + 1, a), np.where(right, b, middle)
                bound[row] = a
        equal = np.zeros(len(fresh), dtype=bool)
        # one entry is left for most, or some whose last few bytes only may differ: compare whole strings
        row = np.flatnonzero(high > low)
        while len(row):
            after = []
            for part in np.array_split(row, max(1, len(row) >> 16)):
                a, b = self.strings[level[low[part]]], self.strings[fresh[part]]
                same = (a.view(self.word) == b.view(self.word)).all(axis=1)
                equal[part[same]] = True
                a, b, part = a[~same], b[~same], part[~same]
                first, one = (a != b).argmax(axis=1), np.arange(len(part))
                less = part[a[one, first] < b[one, first]]
                low[less] += 1
                after.append(less)
            row = np.concatenate(after)
            row = row[low[row] < high[row]]
        return low, equal

    def push(self, array: np.ndarray) -> None:
        if not len(array):
            return
        self.levels.append(array)
        while len(self.levels) > 1 and len(self.levels[-2]) < 2 * len(self.levels[-1]):
            last, before = self.levels.pop(), self.levels.pop()
            place = self.scan(before, last)[0] + np.arange(len(last))
            merged = np.empty(len(before) + len(last), dtype=before.dtype)
            old = np.ones(len(merged), dtype=bool)
            old[place] = False
            merged[place], merged[old] = last, before
            self.levels.append(merged)


def window_minimizers(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For every start of a ``length``-byte string, the place of its minimizer; and the hash at every place."""
    width = length - GRAM + 1
    n = len(data) - GRAM + 1
    prefix = prefix_hashes(data)
    starts = np.arange(n)
    hashes = span_hashes(prefix, starts, starts + GRAM)
    keys = (hashes >> U64(32)) << U64(32) | starts.astype(U64)
    rows = -(-n // width)
    padded = np.full(rows * width, np.iinfo(np.uint64).max, dtype=U64)
    padded[:n] = keys
    square = padded.reshape(rows, width)
    ahead = np.minimum.accumulate(square, axis=1).ravel()
    behind = np.minimum.accumulate(square[:, ::-1], axis=1)[:, ::-1].ravel()
    count = len(data) - length + 1
    least = np.minimum(behind[:count], ahead[width - 1 : width - 1 + count])
    return (least & U64(0xFFFFFFFF)).astype(np.int64), hashes


def different(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the stretches equal none before them, byte by byte, and the text of these."""
    whole, met = data.tobytes(), {}
    first = np.ones(len(begin), dtype=bool)
    for i, (a, n) in enumerate(zip(begin.tolist(), size.tolist(), strict=True)):
        first[i] = met.setdefault(whole[a : a + n], i) == i
    return first, np.frombuffer(b"".join(met), dtype=np.uint8)


def _bytes_of(value) -> np.ndarray:
    text = value.as_py()
    return np.frombuffer((text or "").encode("utf-8", "surrogatepass"), dtype=np.uint8)


def _part(hashes: np.ndarray, parts: int) -> np.ndarray:
    return (mix64(hashes ^ U64(0xABCDEF)) % U64(parts)).astype(np.int64)


def _split(keys: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(part, rows of it, in order) for each part that has rows."""
    order = np.argsort(keys, kind="stable")
    cuts = runs(keys[order])
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        if hi > lo:
            yield int(keys[order[lo]]), order[lo:hi]


def _messages(rows: list[tuple]) -> pa.RecordBatch:
    parts, kind, blobs = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(parts, pa.int64()), pa.array(kind, pa.int32()), pa.array(blobs, pa.binary())], names=["part", "kind", "blob"])


_MESSAGE = "part bigint, kind int, blob binary"


def _answers(documents: DataFrame, length: int, part_bytes: int, batch_bytes: int, flush_bytes: int = 12 << 20) -> tuple[DataFrame, DataFrame]:
    """Documents with their document part, and messages (document part, blob) of removed strings."""
    total = documents.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(8, math.ceil(total / part_bytes))
    uid = F.xxhash64("doc_id", "text")
    base = documents.withColumn("uid", uid).withColumn("part", F.pmod(F.col("uid"), F.lit(parts)))
    texts = base.select("part", "uid", "doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in documents.columns if c not in ("doc_id", "text")] or [F.lit(0).alias("none")]).alias("rest"))

    def minimizers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def flush():
            hashes, uids, places = (np.concatenate(x) for x in zip(*held, strict=True))
            # what recurs within the flush is known at once: its places go back, and one mark stands for all of them
            order = np.argsort(hashes, kind="stable")
            cuts = runs(hashes[order])
            sizes = np.diff(cuts)
            alone = np.repeat(sizes == 1, sizes)
            twice, marked = order[~alone], order[cuts[:-1][sizes > 1]]
            out = [(p, 1, places[twice[r]].tobytes() + uids[twice[r]].tobytes()) for p, r in _split(uids[twice] % parts)]
            rows = np.concatenate([order[alone], marked])
            places, uids = places[rows], uids[rows]
            places[alone.sum() :], uids[alone.sum() :] = MARK, 0
            short = (hashes[rows] & U64(0xFFFFFFFF)).astype(np.uint32)
            return _messages(out + [(p, 0, short[r].tobytes() + places[r].tobytes() + uids[r].tobytes()) for p, r in _split(_part(hashes[rows], parts))])

        for batch in batches:
            for key, value in zip(batch.column("uid"), batch.column("text"), strict=True):
                data = _bytes_of(value)
                size += len(data)
                if len(data) >= length:
                    at, hashes = window_minimizers(data, length)
                    at = at[np.r_[True, at[1:] != at[:-1]]]
                    held.append((hashes[at], np.full(len(at), key.as_py(), dtype=np.int64), at.astype(np.uint32)))
                if size >= flush_bytes and held:
                    yield flush()
                    held, size = [], 0
                    release()
        if held:
            yield flush()

    def recurring(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_groups(batches, "part"):
            shorts, places, uids = [], [], []
            kinds, blobs = group.column("kind").to_pylist(), group.column("blob").to_pylist()
            if through := [(group.column("part")[0].as_py(), 1, b) for b, k in zip(blobs, kinds, strict=True) if k == 1]:
                yield _messages(through)
            for blob in (b for b, k in zip(blobs, kinds, strict=True) if k == 0):
                n = len(blob) // 16
                shorts.append(np.frombuffer(blob, dtype=np.uint32, count=n))
                places.append(np.frombuffer(blob, dtype=np.uint32, count=n, offset=4 * n))
                uids.append(np.frombuffer(blob, dtype=np.int64, count=n, offset=8 * n))
            if not shorts:
                continue
            short, place, uid_ = np.concatenate(shorts), np.concatenate(places), np.concatenate(uids)
            order = np.argsort(short, kind="stable")
            same = short[order[1:]] == short[order[:-1]]
            twice = np.zeros(len(short), dtype=bool)
            twice[order[1:][same]] = True
            twice[order[:-1][same]] = True
            # a mark makes the places elsewhere recur; its own have gone back already
            twice &= place != MARK
            place, uid_ = place[twice], uid_[twice]
            release()
            if len(place):
                yield _messages([(p, 1, place[r].tobytes() + uid_[r].tobytes()) for p, r in _split(uid_ % parts)])

    def stretches(left: pa.Table, right: pa.Table) -> pa.Table:
        """Documents of a part and the places of their recurring minimizers → stretches for the index, and answers."""
        wanted: dict[int, list[np.ndarray]] = {}
        for blob in right.column("blob").to_pylist():
            n = len(blob) // 12
            place, owner = np.frombuffer(blob, dtype=np.uint32, count=n), np.frombuffer(blob, dtype=np.int64, count=n, offset=4 * n)
            order = np.argsort(owner, kind="stable")
            cuts = runs(owner[order])
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                wanted.setdefault(int(owner[order[lo]]), []).append(place[order[lo:hi]])
        rows = sorted({(_LAST if d is None else d, u): i for i, (d, u) in enumerate(zip(left.column("doc_id").to_pylist(), left.column("uid").to_pylist(), strict=True))}.items())
        seen: set[bytes] = set()
        done: list[tuple[int, int, int]] = []  # uid, start, strings: removed here
        to: list[int] = []
        heads: list[tuple[int, int, int, int]] = []
        bodies: list[bytes] = []
        for (doc, owner), i in rows:
            if owner not in wanted:
                continue
            data = _bytes_of(left.column("text")[i])
            at, hashes = window_minimizers(data, length)
            recurs = np.zeros(len(hashes), dtype=bool)
            recurs[np.concatenate(wanted[owner])] = True
            cuts = runs(at)
            first, last = cuts[:-1], cuts[1:]
            use = recurs[at[first]]
            first, last = first[use], last[use]
            raw = data.tobytes()
            for part, lo, hi in zip(_part(hashes[at[first]], parts).tolist(), first.tolist(), last.tolist(), strict=True):
                body = raw[lo : hi + length - 1]
                content = hashlib.blake2b(body, digest_size=16).digest()
                if content in seen:
                    done.append((owner, lo, hi - lo))
                    continue
                seen.add(content)
                to.append(part)
                heads.append((doc, owner, lo, hi - lo))
                bodies.append(body)
        out: list[tuple] = []
        pack = zstandard.ZstdCompressor(level=1)
        if to:
            table = np.array(heads, dtype=np.int64)
            for part, r in _split(np.array(to)):
                out.append((part, 2, pack.compress(np.array([len(r)], dtype=np.int64).tobytes() + table[r].tobytes() + b"".join(bodies[j] for j in r.tolist()))))
        if done:
            table = np.array(done, dtype=np.int64)
            own = int(left.column("part")[0].as_py())
            out.append((own, 3, _pack_answers(table[:, 0], table[:, 1], table[:, 2], np.ones(int(table[:, 2].sum()), dtype=bool))))
        release()
        return pa.Table.from_batches([_messages(out)])

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for group in sorted_groups(batches, "part"):
            kinds = group.column("kind").to_pylist()
            blobs = group.column("blob").to_pylist()
            if through := [(group.column("part")[0].as_py(), 3, b) for b, k in zip(blobs, kinds, strict=True) if k == 3]:
                yield _messages(through)
            tables, texts_ = [], []
            for blob, kind in zip(blobs, kinds, strict=True):
                if kind == 2:
                    raw = unpack.decompress(blob)
                    n = int(np.frombuffer(raw, dtype=np.int64, count=1)[0])
                    tables.append(np.frombuffer(raw, dtype=np.int64, count=4 * n, offset=8).reshape(n, 4))
                    texts_.append(np.frombuffer(raw, dtype=np.uint8, offset=8 + 32 * n))
            release()
            if not tables:
                continue
            table, data = np.concatenate(tables), np.concatenate(texts_)
            tables, texts_, blobs, order = [], [], [], np.lexsort((table[:, 2], table[:, 1], table[:, 0]))
            table = table[order]
            size = table[:, 3] + length - 1
            begin = (np.cumsum(np.r_[0, size[np.argsort(order)]])[:-1])[order]
            # in document order; all strings of a stretch that is equal to an earlier one occur earlier
            first, data = different(data, begin, size)
            copies, table, size = table[~first], table[first], size[first]
            for part, r in _split(copies[:, 1] % parts):
                yield _messages([(part, 3, _pack_answers(copies[r, 1], copies[r, 2], copies[r, 3], np.ones(int(copies[r, 3].sum()), dtype=bool)))])
            begin = np.r_[0, np.cumsum(size)]
            family = LogSuffixIndex(data, length)
            lo = 0
            while lo < len(table):
                hi = max(lo + 1, int(np.searchsorted(begin, begin[lo] + batch_bytes, side="right")) - 1)
                sizes = table[lo:hi, 3]
                starts = ranges(begin[lo:hi], begin[lo:hi] + sizes)
                again = family.add(starts, data[begin[lo] : begin[hi]], starts - begin[lo])
                hit = np.add.reduceat(again, np.r_[0, np.cumsum(sizes)[:-1]]) > 0
                if hit.any():
                    found_, keep = table[lo:hi][hit], again[np.repeat(hit, sizes)]
                    places = np.r_[0, np.cumsum(found_[:, 3])]
                    for part, r in _split(found_[:, 1] % parts):
                        yield _messages([(part, 3, _pack_answers(found_[r, 1], found_[r, 2], found_[r, 3], keep[ranges(places[:-1][r], places[1:][r])]))])
                lo = hi

    found = texts.select("uid", "text").mapInArrow(minimizers, _MESSAGE)
    # partitions from the input's size, so that tasks do not grow with it
    texts = texts.repartition(parts, "part")
    places = found.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(recurring, _MESSAGE)
    sent = texts.groupBy("part").cogroup(places.repartition(parts, "part").groupBy("part")).applyInArrow(stretches, _MESSAGE)
    answers = sent.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(index, _MESSAGE)
    return texts, answers.repartition(parts, "part")


def _pack_answers(owner: np.ndarray, start: np.ndarray, size: np.ndarray, flags: np.ndarray) -> bytes:
    head = np.stack([owner, start, size], axis=1).astype(np.int64)
    return np.array([len(head)], dtype=np.int64).tobytes() + head.tobytes() + np.packbits(flags).tobytes()


def _covered(n: int, starts: np.ndarray, length: int) -> np.ndarray:
    """Which of n bytes lie under a string that starts at one of the places."""
    steps = np.zeros(n + 1, dtype=np.int32)
    np.add.at(steps, starts, 1)
    np.add.at(steps, starts + length, -1)
    return np.cumsum(steps[:-1]) > 0


def _removal(documents: DataFrame, length: int, part_bytes: int, batch_bytes: int, finish, fields: list[tuple[str, str]]) -> DataFrame:
    """doc_id, the other columns as a struct ``rest``, and what ``finish`` makes of each text and its covered bytes."""
    texts, answers = _answers(documents, length, part_bytes, batch_bytes)
    types = {"bigint": pa.int64(), "string": pa.string()}

    def apply(left: pa.Table, right: pa.Table) -> pa.Table:
        starts: dict[int, list[np.ndarray]] = {}
        for blob in right.column("blob").to_pylist():
            n = int(np.frombuffer(blob, dtype=np.int64, count=1)[0])
            head = np.frombuffer(blob, dtype=np.int64, count=3 * n, offset=8).reshape(n, 3)
            flags = np.unpackbits(np.frombuffer(blob, dtype=np.uint8, offset=8 + 24 * n), count=int(head[:, 2].sum())).astype(bool)
            place = ranges(head[:, 1], head[:, 1] + head[:, 2])[flags]
            owner = np.repeat(head[:, 0], head[:, 2])[flags]
            order = np.argsort(owner, kind="stable")
            cuts = runs(owner[order])
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if hi > lo:
                    starts.setdefault(int(owner[order[lo]]), []).append(place[order[lo:hi]])
        out = []
        for uid, value in zip(left.column("uid").to_pylist(), left.column("text"), strict=True):
            data = _bytes_of(value)
            out.append(finish(data, _covered(len(data), np.concatenate(starts[uid]), length) if uid in starts else None))
        release()
        made = list(zip(*out, strict=True)) or [()] * len(fields)
        return pa.table([left.column("doc_id"), left.column("rest"), *[pa.array(c, types[t]) for c, (_, t) in zip(made, fields, strict=True)]], names=["doc_id", "rest", *[name for name, _ in fields]])

    schema = T.StructType([texts.schema["doc_id"], texts.schema["rest"], *[T.StructField(name, T.LongType() if t == "bigint" else T.StringType()) for name, t in fields]])
    return texts.groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(apply, schema)


def remove_repeats(documents: DataFrame, length: int = 100, part_bytes: int = 4 << 20, batch_bytes: int = 1 << 19) -> DataFrame:
    """The rows of ``documents`` with what is left of their texts, and n_bytes, n_removed and spans (replacing such columns).

    Text is cut at character boundaries: a character goes only if all its bytes are covered. ``spans`` lists the covered
    byte runs as ``start-end`` (end excluded), comma-joined. A null text becomes an empty one.
    """

    def finish(data: np.ndarray, gone: np.ndarray | None):
        if gone is None:
            return data.tobytes().decode("utf-8", "replace"), len(data), 0, ""
        edges = np.flatnonzero(np.diff(np.r_[False, gone, False]))
        lead = np.flatnonzero((data & 0xC0) != 0x80)
        whole = np.repeat(np.logical_and.reduceat(gone, lead), np.diff(np.r_[lead, len(data)]))
        return data[~whole].tobytes().decode("utf-8", "replace"), len(data), int(gone.sum()), ",".join(f"{a}-{b}" for a, b in edges.reshape(-1, 2).tolist())

    made = ("n_bytes", "n_removed", "spans")
    body = documents.drop(*made)
    out = _removal(body, length, part_bytes, batch_bytes, finish, [("text", "string"), ("n_bytes", "bigint"), ("n_removed", "bigint"), ("spans", "string")])
    kept = [F.col(c) if c in ("doc_id", "text") else F.col(f"rest.`{c}`").alias(c) for c in body.columns]
    return out.select(*kept, *made)


def op3_suffix(documents: DataFrame, length: int = 100, part_bytes: int = 4 << 20, batch_bytes: int = 1 << 19) -> DataFrame:
    """Digests of what is left of every document when repeated strings of 100 bytes are removed."""

    def finish(data: np.ndarray, gone: np.ndarray | None):
        if gone is None:
            return len(data), 0, 0, hashlib.sha256(data.tobytes()).hexdigest()
        spans = int(np.count_nonzero(np.diff(np.r_[False, gone].astype(np.int8)) == 1))
        return len(data), int(gone.sum()), spans, hashlib.sha256(data[~gone].tobytes()).hexdigest()

    fields = [("n_bytes", "bigint"), ("n_removed", "bigint"), ("n_spans", "bigint"), ("kept_sha256", "string")]
    return _removal(documents.select("doc_id", "text"), length, part_bytes, batch_bytes, finish, fields).drop("rest")
