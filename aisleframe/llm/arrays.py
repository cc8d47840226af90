"""Words, hashes and windows of a batch of texts as numpy arrays.

Texts are handled as UTF-8 bytes. A word is a run of bytes other than space and 0x09-0x0D; those six
bytes never occur inside a multi-byte character, so byte words are the words of the decoded text.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: One odd 64-bit number per byte value, drawn from a fixed generator.
BYTE_CODES = np.random.default_rng(20).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)
#: Words whose bytes are spread out at a time.
CHUNK = 1 << 16


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over all output bits (a one-to-one map of 64-bit numbers)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and where each row begins; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, ends, data = column.buffers()
    at = np.frombuffer(ends, np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[at[0]:at[-1]], at - at[0]


def settle() -> None:
    """Give freed memory back to the system, now and whenever a large array goes.

    Workers serve one task after the other; without this each holds on to the most that any task took.
    A task's functions arrive with the tables they use (weights, vocabularies) and refer to each other in
    circles, so that what the tasks before left is only freed by the collector.
    """
    import ctypes
    import gc

    gc.collect()

    libc = ctypes.CDLL(None)
    if hasattr(libc, "mallopt"):
        libc.mallopt(-3, 2 << 20)  # arrays from this size on are mapped on their own
        libc.malloc_trim(0)
    pa.default_memory_pool().release_unused()


def slices(batches: Iterable[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the column holds at most so many bytes in each, or a single row."""
    settle()
    for batch in batches:
        if not batch.num_rows:
            continue
        _, at = utf8(batch.column(column))
        start = 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(at, at[start] + most, "right")) - 1)
            yield batch.slice(start, stop - start)
            start = stop
    settle()


def blocks(batches: Iterable[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Gather small batches into blocks of about so many bytes of the column; cut large ones."""
    held, size = [], 0
    for piece in slices(batches, column, most):
        _, at = utf8(piece.column(column))
        if held and size + at[-1] > most:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
        held.append(piece)
        size += int(at[-1])
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


class Words:
    """Words of a batch: starts and ends in the bytes, first word of each row, 64-bit hash of each."""

    def __init__(self, data: np.ndarray, at: np.ndarray, lower: bool = False):
        self.data = LOWER[data] if lower else data
        inside = ~WHITE[self.data]
        edge = np.zeros(len(data) + 1, bool)
        edge[at] = True
        before = np.zeros(len(data), bool)
        before[1:] = inside[:-1]
        after = np.zeros(len(data), bool)
        after[:-1] = inside[1:]
        self.starts = np.flatnonzero(inside & (~before | edge[:-1]))
        self.ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
        self.first = np.searchsorted(self.starts, at)
        self.inside = inside

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def rows(self) -> np.ndarray:
        """Row number of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def hashes(self) -> np.ndarray:
        size = self.ends - self.starts
        if not len(size):
            return np.zeros(0, np.uint64)
        begin = np.cumsum(size) - size
        letters = self.data[self.inside]
        powers = np.full(int(size.max()), BASE, np.uint64)
        powers[0] = 1
        powers = np.cumprod(powers)
        out = np.empty(len(size), np.uint64)
        for a in range(0, len(size), CHUNK):  # a bounded number of words at a time
            own, at = size[a:a + CHUNK], begin[a:a + CHUNK] - begin[a]
            part = letters[begin[a]:begin[a] + int(own.sum())]
            place = np.arange(len(part)) - np.repeat(at, own)
            out[a:a + CHUNK] = np.add.reduceat(BYTE_CODES[part] * powers[place], at)
        return mix(out + size.astype(np.uint64))

    def windows(self, hashes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Rabin-Karp hash of each k consecutive words of one row, and the number of its first word."""
        n = len(hashes) - k + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        rolled = hashes[:n].copy()
        for j in range(1, k):
            rolled *= BASE
            rolled += hashes[j:n + j]
        room = np.repeat(self.first[1:], self.counts)[:n] - np.arange(n)
        where = np.flatnonzero(room >= k)
        return mix(rolled[where]), where

    def joined(self, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Kept words of each row joined by one space: bytes (a space follows each), row starts."""
        size = (self.ends - self.starts)[keep]
        stop = np.cumsum(size + 1)
        out = np.full(int(stop[-1]) if len(stop) else 0, 32, np.uint8)
        letters = np.ones(len(out), bool)
        letters[stop - 1] = False
        chosen = np.repeat(keep, self.ends - self.starts)
        out[letters] = self.data[self.inside][chosen]
        kept_before = np.concatenate([[0], np.cumsum(keep)])[self.first]
        return out, np.concatenate([[0], stop])[kept_before]


def covered(starts: np.ndarray, stops: np.ndarray, n: int) -> np.ndarray:
    """Which of n places lie in one of the half-open ranges."""
    steps = np.bincount(starts, minlength=n + 1) - np.bincount(stops, minlength=n + 1)
    return np.cumsum(steps)[:n] > 0


def runs(mask: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of true places; a run ends where a row ends (edges: row starts and the end)."""
    cut = np.zeros(len(mask) + 1, bool)
    cut[edges] = True
    before = np.zeros(len(mask), bool)
    before[1:] = mask[:-1]
    after = np.zeros(len(mask), bool)
    after[:-1] = mask[1:]
    return (np.flatnonzero(mask & (~before | cut[:-1])),
            np.flatnonzero(mask & (~after | cut[1:])) + 1)
