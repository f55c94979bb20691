"""Helpers that several corpus operators share: hashing of words in numpy, sorted streams, union-find."""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
try:
    _TRIM = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError):  # not glibc
    _TRIM = None
_BASE = 0x9E3779B97F4A7C15 | 1
_WHITE = np.zeros(256, dtype=bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words (the splitmix64 finaliser)."""
    x = np.asarray(x, dtype=U64)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


class Powers:
    """Powers of an odd base modulo 2**64 and of its inverse, grown as needed."""

    def __init__(self, base: int = _BASE):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, dtype=U64)

    def grow(self, n: int) -> None:
        if len(self.up) < n:
            n = 1 << (n - 1).bit_length()
            with np.errstate(over="ignore"):
                self.up = np.cumprod(np.r_[U64(1), np.full(n - 1, self.base, dtype=U64)], dtype=U64)
                self.down = np.cumprod(np.r_[U64(1), np.full(n - 1, self.inverse, dtype=U64)], dtype=U64)


_POWERS = Powers()


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """P with P[j] - P[i] = sum of (byte + 1) * base**k over k in [i, j)."""
    _POWERS.grow(len(data) + 1)
    out = np.zeros(len(data) + 1, dtype=U64)
    with np.errstate(over="ignore"):
        np.cumsum((data.astype(U64) + U64(1)) * _POWERS.up[: len(data)], out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end] that depend on the content only."""
    with np.errstate(over="ignore"):
        return mix64((prefix[ends] - prefix[starts]) * _POWERS.down[starts] + (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93))


#: Masks of the first n bytes of a little-endian lane.
_LANE = np.array([(1 << (8 * n)) - 1 for n in range(9)], dtype=U64)
#: Words beyond this many bytes are hashed by BLAKE2.
_LONG = 64


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+`` in bytes."""
    white = np.ones(len(data) + 2, dtype=bool)
    white[1:-1] = _WHITE[data]
    edges = np.flatnonzero(white[1:] != white[:-1])
    return edges[::2], edges[1::2]


def content_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each data[start:end], by a mixing step for every eight bytes.

    Unlike sums of powers modulo 2**64 they have no structure that texts can hit by chance (such as Thue-Morse words).
    """
    size = ends - starts
    padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
    lanes = np.ndarray(len(data) + 1, dtype=U64, buffer=padded, strides=(1,))  # eight bytes from each place on
    with np.errstate(over="ignore"):
        first = mix64((lanes[starts] & _LANE[np.minimum(size, 8)]) * U64(0x9E3779B97F4A7C15) + size.astype(U64))
        second = mix64(first ^ U64(0x5851F42D4C957F2D))  # words of eight bytes at most: one to one
        row = np.flatnonzero((size > 8) & (size <= _LONG))
        at = 8
        while len(row):
            lane = lanes[starts[row] + at] & _LANE[np.minimum(size[row] - at, 8)]
            first[row] = mix64((first[row] ^ lane) * U64(0xA0761D6478BD642F))
            second[row] = mix64((second[row] + lane) * U64(0xE7037ED1A0B428DB))
            at += 8
            row = row[size[row] > at]
    for i in np.flatnonzero(size > _LONG).tolist():
        digest = hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=16).digest()
        first[i], second[i] = np.frombuffer(digest, dtype=U64)
    return first, second


def shingle_sets(texts: Iterable[str | None], n: int, at_once: int = 1 << 20) -> Iterator[np.ndarray]:
    """For each text its distinct n-word shingles (all words as one where there are fewer), A-Z lower-cased.

    A set is two rows of hashes, sorted by the first. A column is a digest of 128 bits: sets are compared by both rows.
    Texts are hashed together, about ``at_once`` bytes at a time.
    """
    held: list[bytes] = []
    size = 0
    for text in texts:
        held.append((text or "").encode("utf-8", "surrogatepass").lower())
        size += len(held[-1]) + 1
        if size >= at_once:
            yield from _sets_of(held, n)
            held, size = [], 0
    yield from _sets_of(held, n)


def _sets_of(texts: list[bytes], n: int) -> list[np.ndarray]:
    out = []
    data = np.frombuffer(b" ".join(texts), dtype=np.uint8)
    starts, ends = word_spans(data)
    words, others = content_hashes(data, starts, ends)
    bounds = np.searchsorted(starts, np.cumsum([0] + [len(t) + 1 for t in texts]))
    many = np.diff(bounds)
    with np.errstate(over="ignore"):
        m = max(0, len(words) - n + 1)
        first, second = np.full(m, 0x632BE59BD9B4E019 + n, dtype=U64), np.full(m, n, dtype=U64)
        for i in range(n):
            first = mix64(first * U64(0x9E3779B97F4A7C15) + words[i : m + i])
            second = second * U64(0xC2B2AE3D27D4EB4F) + others[i : m + i]
        for lo, count in zip(bounds.tolist(), many.tolist(), strict=False):
            if count >= n:
                a, b = first[lo : lo + count - n + 1], second[lo : lo + count - n + 1]
                order = np.argsort(a)
                a, b = a[order], b[order]
                if len(a) > 1 and (same := a[1:] == a[:-1]).any():
                    keep = np.r_[True, ~same]
                    a, b = a[keep], b[keep]
                out.append(np.stack([a, b]))
            elif count:
                a = np.full(1, 0x632BE59BD9B4E019 + count, dtype=U64)
                b = np.full(1, count, dtype=U64)
                for i in range(lo, lo + count):
                    a = mix64(a * U64(0x9E3779B97F4A7C15) + words[i])
                    b = b * U64(0xC2B2AE3D27D4EB4F) + others[i]
                out.append(np.stack([a, b]))
            else:
                out.append(np.zeros((2, 0), dtype=U64))
    return out


def shingle_set(text: str | None, n: int) -> np.ndarray:
    """The set of one text; see :func:`shingle_sets`."""
    return next(shingle_sets([text], n))


def shared_shingles(a: np.ndarray, b: np.ndarray) -> int:
    """How many digests two sets have in common."""
    if a.shape[1] > b.shape[1]:
        a, b = b, a
    at = np.minimum(np.searchsorted(b[0], a[0]), b.shape[1] - 1)
    return int(((b[0][at] == a[0]) & (b[1][at] == a[1])).sum()) if b.shape[1] else 0


def runs(keys: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal values, and the length at the end."""
    if not len(keys):
        return np.zeros(1, dtype=np.int64)
    return np.r_[0, np.flatnonzero(keys[1:] != keys[:-1]) + 1, len(keys)]


def ranges(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The concatenation of arange(start, end) for each pair."""
    sizes = ends - starts
    total = int(sizes.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    offsets = np.repeat(starts - np.r_[0, np.cumsum(sizes)[:-1]], sizes)
    return np.arange(total, dtype=np.int64) + offsets


def release() -> None:
    """Hand freed memory back to the system: Python workers live on between tasks, and executors count what they hold."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def sorted_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of equal key from batches that are sorted by it; a group is complete when it is yielded."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cuts = runs(batch.column(key).to_numpy(zero_copy_only=False))
        if held and held[-1].column(key)[-1].as_py() != batch.column(key)[0].as_py():
            yield pa.Table.from_batches(held)
            held = []
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            held.append(batch.slice(lo, hi - lo))
            if hi < batch.num_rows:
                yield pa.Table.from_batches(held)
                held = []
    if held:
        yield pa.Table.from_batches(held)
