"""Packed shuffles: many 64-bit hashes travel as a few binary cells per block and part.

A hash goes to the part its top bits name, so that a part holds every occurrence of the hashes in it and
parts are even. Blocks send each hash once for their smallest document, so that a hash that a third of
the documents share reaches its part once per block and not once per document.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def input_bytes(df: DataFrame) -> int:
    """Size of the frame as the optimizer estimates it; for files, their size on disk."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def part_bits(df: DataFrame, bytes_each: int = 2 << 20) -> int:
    """Bits of the part number, from the size of the input; at least 8, so that one byte is implied."""
    return min(24, max(8, math.ceil(math.log2(max(1, input_bytes(df)) / bytes_each))))


def planes(values: np.ndarray) -> bytes:
    """Differences of 64-bit numbers, byte plane by byte plane: near-constant planes compress away."""
    steps = np.diff(values.astype(np.int64), prepend=np.int64(0))
    return steps.view(np.uint8).reshape(-1, 8).T.tobytes()


def unplanes(cell: bytes) -> np.ndarray:
    steps = np.frombuffer(cell, np.uint8).reshape(8, -1).T.copy().view(np.int64).ravel()
    return np.cumsum(steps)


def short_planes(values: np.ndarray) -> bytes:
    """Numbers below 2**32, byte plane by byte plane."""
    return values.astype(np.uint32).view(np.uint8).reshape(-1, 4).T.tobytes()


def unshort_planes(cell: bytes) -> np.ndarray:
    return np.frombuffer(cell, np.uint8).reshape(4, -1).T.copy().view(np.uint32).ravel().astype(np.int64)


def packed(values: np.ndarray) -> bytes:
    """Rising numbers from 0 on: how many byte planes their differences need, and those planes."""
    steps = np.diff(values.astype(np.int64), prepend=np.int64(0))
    used = max(1, (int(steps.max(initial=0)).bit_length() + 7) // 8)
    return bytes([used]) + steps.view(np.uint8).reshape(-1, 8)[:, :used].T.tobytes()


def unpacked(cell: bytes) -> np.ndarray:
    used = cell[0]
    steps = np.zeros(((len(cell) - 1) // used, 8), np.uint8)
    steps[:, :used] = np.frombuffer(cell, np.uint8, offset=1).reshape(used, -1).T
    return np.cumsum(steps.view(np.int64).ravel())


def low7(hashes: np.ndarray) -> bytes:
    """Hashes without their top byte, which the part number implies."""
    return hashes.view(np.uint8).reshape(-1, 8)[:, :7].tobytes()


def unlow7(cell: bytes, part: int, bits: int) -> np.ndarray:
    low = np.frombuffer(cell, np.uint8).reshape(-1, 7)
    out = np.empty((len(low), 8), np.uint8)
    out[:, :7] = low
    out[:, 7] = part >> (bits - 8)
    return out.view(np.uint64).ravel()


def by_part(hashes: np.ndarray, bits: int):
    """Yield (part, row numbers in their order) for the parts that occur."""
    part = (hashes >> np.uint64(64 - bits)).astype(np.uint32)
    order = np.argsort(part, kind="stable")
    cuts = np.flatnonzero(np.diff(part[order], prepend=-1))
    for start, stop in zip(cuts, [*cuts[1:], len(order)], strict=True):
        rows = order[start:stop]
        yield int(part[rows[0]]), rows


def bucket_count(bits: int) -> int:
    """Buckets of documents for so many part bits; odd, so that even steps between ids do no harm."""
    return (1 << (bits - 1)) + 1


def doc_bucket(docs: np.ndarray, n: int) -> np.ndarray:
    """Bucket of each document id; pmod(doc_id, n) in SQL."""
    return np.mod(docs, np.int64(n)).astype(np.int32)


def one_row_per_id(texts: DataFrame) -> DataFrame:
    """Of rows with one id, that with the greatest text; the table itself where ids are unique."""
    repeated = texts.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    if repeated.isEmpty():
        return texts
    single = texts.join(repeated, "doc_id", "left_anti")
    return single.unionByName(texts.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(
        F.max("text").alias("text")))
