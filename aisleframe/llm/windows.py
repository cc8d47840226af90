"""Substring removal by hashed word windows.

Every window of 13 consecutive words gets a Rabin-Karp hash. Spark brings equal hashes together and takes
the smallest document of each; windows of other documents merge into maximal removal intervals.

Two windows count as equal when their 64-bit hashes are; for n distinct windows a false pair is expected
n * n / 2**65 times.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aisleframe.llm.arrays import Words, blocks, covered, slices, utf8
from aisleframe.llm.spread import (
    bucket_count,
    by_part,
    doc_bucket,
    low7,
    part_bits,
    planes,
    unlow7,
    unplanes,
)

#: Text bytes that one task hashes at a time.
BLOCK = 8 << 20


def distinct_rows(hashes: np.ndarray, docs: np.ndarray):
    """Order by hash, then document; and which ordered rows open a hash, which a (hash, document)."""
    order = np.lexsort((docs, hashes))
    h, d = hashes[order], docs[order]
    first = np.ones(len(h), bool)
    first[1:] = h[1:] != h[:-1]
    fresh = first.copy()
    fresh[1:] |= d[1:] != d[:-1]
    return order, first, fresh


def window_rows(batch: pa.RecordBatch, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and document of each window of a block."""
    data, at = utf8(batch.column("text"))
    words = Words(data, at)
    hashes, where = words.windows(words.hashes(), size)
    docs = batch.column("doc_id").to_numpy(zero_copy_only=False)
    return hashes, docs[words.rows()[where]]


def pack_replies(docs: np.ndarray, hashes: np.ndarray, buckets: int) -> Iterator[dict]:
    """Cells with (document, hash) pairs for each bucket of documents."""
    if not len(docs):
        return
    order = np.argsort(docs, kind="stable")
    docs, hashes = docs[order], hashes[order]
    bucket = doc_bucket(docs, buckets)
    order = np.argsort(bucket, kind="stable")
    bucket, docs, hashes = bucket[order], docs[order], hashes[order]
    cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
    for start, stop in zip(cuts, [*cuts[1:], len(docs)], strict=True):
        yield {"bucket": int(bucket[start]), "docs": planes(docs[start:stop]),
               "hashes": hashes[start:stop].tobytes()}


def _scatter(size: int, bits: int, buckets: int):
    """Tasks over the texts: repeats inside the block are settled, the rest goes to its part."""
    schema = pa.schema([("part", pa.int32()), ("settled", pa.bool_()), ("bucket", pa.int32()),
                        ("docs", pa.binary()), ("hashes", pa.binary())])

    def run(batches):
        for block in blocks(batches, "text", BLOCK):
            hashes, docs = window_rows(block, size)
            order, first, fresh = distinct_rows(hashes, docs)
            later = order[fresh & ~first]
            out = [{"part": c["bucket"] % (1 << bits), "settled": True, **c}
                   for c in pack_replies(docs[later], hashes[later], buckets)]
            sent = np.sort(order[first])
            hashes, docs = hashes[sent], docs[sent]
            out += [{"part": part, "settled": False, "docs": planes(docs[rows]),
                     "hashes": low7(hashes[rows])} for part, rows in by_part(hashes, bits)]
            yield pa.RecordBatch.from_pylist(out, schema)

    return run


def _judge(bits: int, buckets: int):
    """One part: documents that are not the smallest of their hash, with the hash."""
    schema = pa.schema([("bucket", pa.int32()), ("docs", pa.binary()), ("hashes", pa.binary())])

    def run(key, table):
        part = key[0].as_py()
        rows = table.to_pylist()
        out = [{k: r[k] for k in schema.names} for r in rows if r["settled"]]
        cells = [r for r in rows if not r["settled"]]
        if cells:
            hashes = np.concatenate([unlow7(r["hashes"], part, bits) for r in cells])
            docs = np.concatenate([unplanes(r["docs"]) for r in cells])
            order, first, fresh = distinct_rows(hashes, docs)
            later = order[fresh & ~first]
            out += pack_replies(docs[later], hashes[later], buckets)
        return pa.Table.from_pylist(out, schema)

    return run


def member(hashes: np.ndarray, docs: np.ndarray, in_hashes: np.ndarray, in_docs: np.ndarray) -> np.ndarray:
    """Which (hash, document) pairs are among the given ones."""
    if not len(in_hashes) or not len(hashes):
        return np.zeros(len(hashes), bool)
    known_h, known_d = np.unique(in_hashes), np.unique(in_docs)

    def code(h, d):
        i, j = np.searchsorted(known_h, h), np.searchsorted(known_d, d)
        i, j = np.minimum(i, len(known_h) - 1), np.minimum(j, len(known_d) - 1)
        return np.where((known_h[i] == h) & (known_d[j] == d), i * len(known_d) + j, -1)

    return np.isin(code(hashes, docs), np.unique(code(in_hashes, in_docs)))


def _remove(size: int):
    """One bucket: the texts without the words that settled windows cover."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()),
                        ("kept", pa.string())])

    def run(texts, replies):
        found_h = [np.frombuffer(c, np.uint64) for c in replies.column("hashes").to_pylist()]
        found_d = [unplanes(c) for c in replies.column("docs").to_pylist()]
        found_h = np.concatenate(found_h) if found_h else np.zeros(0, np.uint64)
        found_d = np.concatenate(found_d) if found_d else np.zeros(0, np.int64)
        out = []
        for batch in slices(texts.to_batches(), "text", BLOCK // 2):
            data, at = utf8(batch.column("text"))
            words = Words(data, at)
            hashes, where = words.windows(words.hashes(), size)
            docs = batch.column("doc_id").fill_null(0).to_numpy()
            known = batch.column("doc_id").is_valid().to_numpy(zero_copy_only=False)
            rows = words.rows()[where]
            hit = where[member(hashes, docs[rows], found_h, found_d) & known[rows]]
            gone = covered(hit, hit + size, len(words.starts))
            text, start = words.joined(~gone)
            kept = [text[a:max(a, b - 1)].tobytes() for a, b in zip(start[:-1], start[1:], strict=True)]
            before = np.concatenate([[0], np.cumsum(gone)])
            out.append(pa.record_batch([
                batch.column("doc_id"), pa.array(words.counts),
                pa.array(before[words.first[1:]] - before[words.first[:-1]]),
                pa.array(kept, pa.binary()).cast(pa.string()),
            ], schema=schema))
        return pa.Table.from_batches(out, schema)

    return run


def remove_repeated_windows(docs: DataFrame, size: int = 13, id_col: str = "doc_id",
                            text_col: str = "text") -> DataFrame:
    """Texts without the words of any window that also starts in a document with a smaller id.

    Returns doc_id, n_words, n_removed and kept (the remaining words, one space between them), one row
    for each input row. Windows are judged on the input and never leave a document. A null text has no
    words. A row without an id keeps its words and takes none from others; rows with one id count as one
    document, in which a window does not repeat itself. Texts shorter than a window, empty tables and
    further columns are fine.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    bits = part_bits(texts)
    buckets = bucket_count(bits)
    packed = texts.where("doc_id is not null").mapInArrow(
        _scatter(size, bits, buckets),
        "part int, settled boolean, bucket int, docs binary, hashes binary")
    replies = packed.groupBy("part").applyInArrow(
        _judge(bits, buckets), "bucket int, docs binary, hashes binary")
    dealt = texts.withColumn("bucket", F.expr(f"coalesce(pmod(doc_id, {buckets}), 0)").cast("int"))
    return dealt.groupBy("bucket").cogroup(replies.groupBy("bucket")).applyInArrow(
        _remove(size), "doc_id long, n_words long, n_removed long, kept string")
