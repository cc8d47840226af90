"""Sequence packing by lexical retrieval.

Documents are taken in shards of a bounded size, in the order of their files. Whole windows of a document
become sequences of their own; what is left of it is an item. Each shard has an inverted BM25 index of its
items. The longest unused item seeds a window, and the unused items that score best against it fill the
window; the last one is cut to fit, and its rest stays unused.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aisleframe.llm.arrays import blocks, slices
from aisleframe.llm.tokens import Encoder, default_path

#: Text bytes in a shard, and in a call of the encoder; the id that ends each document; terms of a seed that are looked up.
SHARD, PIECE = 8 << 20, 1 << 20
END = 0
QUERY_TERMS = 24
K1, B = 1.2, 0.75


class Index:
    """Inverted BM25 index of a shard's items over their token ids."""

    def __init__(self, item: np.ndarray, term: np.ndarray, n: int):
        code, tf = np.unique(item.astype(np.int64) << 32 | term, return_counts=True)
        rows, self.term = (code >> 32).astype(np.int32), (code & 0xFFFFFFFF).astype(np.int32)
        del code
        length = np.bincount(item, minlength=n)
        df = np.bincount(self.term)
        idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
        norm = K1 * (1 - B + B * length / max(1.0, float(length.mean())))
        self.weight = idf[self.term] * tf * (K1 + 1) / (tf + norm[rows])
        self.begin = np.searchsorted(rows, np.arange(n + 1, dtype=np.int32))
        order = np.argsort(self.term, kind="stable")
        self.post_item, self.post_weight = rows[order], self.weight[order]
        self.post_begin = np.concatenate([[0], np.cumsum(df)])
        self.n = n

    def scores(self, seed: int) -> np.ndarray:
        """Score of every item for the seed's most telling terms."""
        mine = slice(self.begin[seed], self.begin[seed + 1])
        terms, weight = self.term[mine], self.weight[mine]
        if len(terms) > QUERY_TERMS:
            terms = terms[np.argpartition(-weight, QUERY_TERMS)[:QUERY_TERMS]]
        spans = [slice(self.post_begin[t], self.post_begin[t + 1]) for t in terms]
        if not spans:
            return np.zeros(self.n)
        return np.bincount(np.concatenate([self.post_item[s] for s in spans]),
                           weights=np.concatenate([self.post_weight[s] for s in spans]), minlength=self.n)


def fill(lengths: np.ndarray, index: Index, window: int):
    """Yield windows as lists of (item, from, length); every token of every item falls in one window."""
    left = lengths.copy()
    for seed in np.argsort(-lengths, kind="stable"):
        while left[seed]:
            size = min(int(left[seed]), window)
            out, room = [(int(seed), int(lengths[seed] - left[seed]), size)], window - size
            left[seed] -= size
            if room and left.any():
                score = np.where(left > 0, index.scores(seed), -1.0)
                looked = 16
                order = np.argsort(-score, kind="stable") if len(score) <= looked else None
                at = 0
                while room:
                    if order is None or at == len(order) < len(score):
                        looked *= 4 if order is not None else 1
                        best = np.argpartition(-score, min(looked, len(score) - 1))[:looked]
                        order = best[np.lexsort((best, -score[best]))]
                        at = 0
                    if at == len(order):
                        break
                    other = int(order[at])
                    at += 1
                    size = min(int(left[other]), room)
                    if score[other] < 0:
                        break
                    if size:
                        out.append((other, int(lengths[other] - left[other]), size))
                        left[other] -= size
                        room -= size
            yield out


def _pack(path: str, window: int):
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()),
                        ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def run(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 40
        encoder = Encoder.of(path)
        for block in blocks(batches, "text", SHARD):
            parts = [encoder([t or "" for t in piece.column("text").to_pylist()])
                     for piece in slices([block], "text", PIECE)]
            ids = np.concatenate([ids for ids, _ in parts])
            size = np.concatenate([np.diff(at) for _, at in parts]) + 1
            begin = np.cumsum(size) - size
            tokens = np.full(int(size.sum()), END, "<u4")
            inner = np.ones(len(tokens), bool)
            inner[begin + size - 1] = False
            tokens[inner] = ids
            del parts, ids, inner
            pieces = []  # document, start, length, sequence, offset
            whole = size // window
            for doc in np.flatnonzero(whole):
                for i in range(whole[doc]):
                    pieces.append((doc, i * window, window, number, 0))
                    number += 1
            rest = size - whole * window
            items = np.flatnonzero(rest)
            if len(items):
                length = rest[items]
                head = begin[items] + whole[items] * window
                item = np.repeat(np.arange(len(items), dtype=np.int32), length)
                first = np.cumsum(length) - length
                term = tokens[np.repeat(head - first, length) + np.arange(len(item))]
                index = Index(item, term, len(items))
                del item, term
                for found in fill(length, index, window):
                    offset = 0
                    for i, start, count in found:
                        pieces.append((items[i], whole[items[i]] * window + start, count, number, offset))
                        offset += count
                    number += 1
            doc, start, length, sequence, offset = (np.array(c, np.int64) for c in zip(*pieces, strict=True))
            cells = [tokens[a:a + k].tobytes() for a, k in zip((begin[doc] + start).tolist(), length.tolist(), strict=True)]
            batch = pa.record_batch([
                block.column("doc_id").take(pa.array(doc)), pa.array(start), pa.array(length),
                pa.array(cells, pa.binary()), pa.array(size[doc]), pa.array(sequence), pa.array(offset)], schema=schema)
            for a in range(0, batch.num_rows, 2000):
                yield batch.slice(a, 2000)

    return run


def pack(docs: DataFrame, window: int = 1024, path: str | None = None, id_col: str = "doc_id",
         text_col: str = "text") -> DataFrame:
    """Every token of every document in exactly one piece, pieces in sequences of at most `window` tokens.

    Returns doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset, one
    row for each piece. Only the last sequence of a shard can fall short of the window. A null or empty text
    is its end id alone; repeated rows and rows without an id are packed like any other.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return texts.mapInArrow(
        _pack(path or default_path(), window),
        "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
