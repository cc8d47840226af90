"""Substring removal with a logarithmic family of suffix arrays.

A byte goes when a 200-byte string that covers it also starts anywhere else. Suffixes are truncated at 200
bytes, because no longer match is asked for.

Not every suffix needs an index entry. Each 200-byte string is assigned to its anchor: the smallest hash
among the 100-byte strings that start in its first 101 places. Strings with one anchor that follow each
other form a run, about 50 of them; equal strings have equal anchors at the same distance. So:

1. Runs go to the part their anchor's hash names. A run whose bytes occur twice is removed whole. An
   anchor that occurs once rules its run out. What is left - equal anchors in unequal bytes, the ends of
   copied passages - goes on.
2. The bytes of those runs go to shards by anchor. In a shard they arrive in batches: a batch gets its
   suffix array, and arrays of equal size are merged, so that there are never more than log2(batches) of
   them. In the end they all are merged. Equal suffixes are found where arrays meet.
3. Matches become byte ranges, and ranges unite into maximal removed runs of each document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aisleframe.llm.arrays import BASE, BYTE_CODES, covered, mix, runs, slices, utf8
from aisleframe.llm.spread import (
    bucket_count,
    by_part,
    doc_bucket,
    low7,
    one_row_per_id,
    part_bits,
    planes,
    unlow7,
    unplanes,
)
from aisleframe.llm.windows import member

PIECE = 2 << 20
#: Suffixes in a new batch of the index family, and keys of each array that are held at a time in a merge.
BATCH = 1 << 16
CHUNK = 1 << 14
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


class Level:
    """A suffix array: positions of a text ordered by the bytes that follow, without equal entries."""

    def __init__(self, text: np.ndarray, order: np.ndarray, where: np.ndarray, length: int):
        self.text, self.order, self.where, self.length = text, order, where, length

    def keys(self, start: int = 0, stop: int | None = None) -> np.ndarray:
        view = np.lib.stride_tricks.sliding_window_view(self.text, self.length)
        return np.ascontiguousarray(view[self.order[start:stop]]).view(f"S{self.length}").ravel()


class Family:
    """Suffix arrays of doubling size; seen[i] tells whether suffix number i has an equal one.

    Equal suffixes meet when their arrays are merged, at the latest when seen is read. A suffix takes part in
    about as many merges as there are arrays, however many batches came before or after its own.
    """

    def __init__(self, length: int, total: int):
        self.length, self._seen, self.levels = length, np.zeros(total, bool), []

    @property
    def seen(self) -> np.ndarray:
        while len(self.levels) > 1:
            self._merge()
        return self._seen

    def add(self, text: np.ndarray, positions: np.ndarray, first: int) -> None:
        """Index the suffixes of a batch at these positions, numbered from first on."""
        keys = np.ascontiguousarray(
            np.lib.stride_tricks.sliding_window_view(text, self.length)[positions]).view(f"S{self.length}").ravel()
        order = np.argsort(keys, kind="stable")
        keys, where = keys[order], first + order
        same = keys[1:] == keys[:-1]
        self._seen[where[1:][same]] = True
        self._seen[where[:-1][same]] = True
        fresh = np.concatenate([[True], ~same])
        self.levels.append(Level(text, positions[order][fresh], where[fresh], self.length))
        while len(self.levels) > 1 and len(self.levels[-2].order) < 2 * len(self.levels[-1].order):
            self._merge()

    def _places(self, level: Level, other: Level):
        """Chunk by chunk: where a level's suffixes fall among those of another, and which equal one."""
        low = 0
        held = other.keys(0, CHUNK)
        for start in range(0, len(level.order), CHUNK):
            own = level.keys(start, start + CHUNK)
            at = np.empty(len(own), np.int64)
            equal = np.zeros(len(own), bool)
            done = 0
            while True:
                # Those up to the last suffix held fall among them; the others are beyond.
                stop = len(own)
                if low + len(held) < len(other.order):
                    stop = int(np.searchsorted(own, held[-1], "right"))
                found = np.searchsorted(held, own[done:stop])
                at[done:stop] = low + found
                equal[done:stop] = held[np.minimum(found, len(held) - 1)] == own[done:stop]
                done = stop
                if done == len(own):
                    break
                low += len(held)
                held = other.keys(low, low + CHUNK)
            yield at, equal

    def _merge(self) -> None:
        """Merge the two smallest arrays; an equal entry stays once."""
        b, a = self.levels.pop(), self.levels.pop()
        at, equal = (np.concatenate(part) for part in zip(*self._places(b, a), strict=True))
        self._seen[b.where[equal]] = True
        self._seen[a.where[at[equal]]] = True
        text = np.concatenate([a.text, b.text])
        order = np.insert(a.order, at[~equal], b.order[~equal] + len(a.text))
        where = np.insert(a.where, at[~equal], b.where[~equal])
        self.levels.append(Level(text, order, where, self.length))


class Runs:
    """Runs of strings of a length with one anchor, in each row of a batch."""

    def __init__(self, data: np.ndarray, at: np.ndarray, length: int):
        n, k = len(data), length // 2
        span = length - k + 1
        empty = np.zeros(0, np.int64)
        self.first = self.last = self.anchor = self.rows = empty
        self.key = self.content = np.zeros(0, np.uint64)
        room = np.repeat(at[1:], np.diff(at)) - np.arange(n)
        strings = np.flatnonzero(room >= length)
        if not len(strings):
            return
        up, down = np.full(n, BASE, np.uint64), np.full(n, INVERSE, np.uint64)
        up[0] = down[0] = 1
        up, down = np.cumprod(up), np.cumprod(down)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(BYTE_CODES[data] * up)])
        v = mix((sums[k:] - sums[:n - k + 1]) * down[:n - k + 1])
        mask = np.uint64((1 << int(n).bit_length()) - 1)
        low = (v & ~mask) | np.arange(len(v), dtype=np.uint64)
        wide = 1
        while wide * 2 <= span:
            low = np.minimum(low[:-wide], low[wide:])
            wide *= 2
        if wide < span:
            low = np.minimum(low[:len(low) - (span - wide)], low[span - wide:])
        anchor = (low[strings] & mask).astype(np.int64)
        begin = np.ones(len(strings), bool)
        begin[1:] = (anchor[1:] != anchor[:-1]) | (np.diff(strings) != 1)
        opens = np.flatnonzero(begin)
        self.first = strings[opens]
        self.last = strings[np.concatenate([opens[1:], [len(strings)]]) - 1]
        self.anchor = anchor[opens]
        self.rows = np.searchsorted(at, self.first, "right") - 1
        self.key = mix(v[self.anchor])  # anchors are least hashes, so that their top bits are nearly all zero
        whole = (sums[self.last + length] - sums[self.first]) * down[self.first]
        shape = ((self.last - self.first) << 32) + (self.anchor - self.first)
        self.content = mix(whole ^ mix(shape.astype(np.uint64)))


def groups(*keys: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Order by the keys, first key first; for each key, where a new value of it and those before opens."""
    order = np.lexsort(keys[::-1])
    opens, new = [], np.zeros(len(order), bool)
    if len(order):
        new[0] = True
    for key in keys:
        ordered = key[order]
        new = new.copy()
        new[1:] |= ordered[1:] != ordered[:-1]
        opens.append(new)
    return order, opens


def _cells(docs, values, buckets, **extra):
    """Rows of (bucket, docs, values) sorted by document."""
    if not len(docs):
        return
    bucket = doc_bucket(docs, buckets)
    order = np.lexsort((docs, bucket))
    bucket, docs = bucket[order], docs[order]
    cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
    for a, b in zip(cuts, [*cuts[1:], len(docs)], strict=True):
        yield {"bucket": int(bucket[a]), "docs": planes(docs[a:b]),
               **{k: v[order[a:b]].tobytes() for k, v in values.items()}, **extra}


REPLY = pa.schema([("part", pa.int32()), ("bucket", pa.int32()), ("docs", pa.binary()), ("keys", pa.binary()),
                   ("contents", pa.binary()), ("twice", pa.binary())])


def _scatter(length: int, bits: int, buckets: int):
    """Runs of each block; a run that occurs twice in the block is settled and sent once."""

    def run(batches):
        for batch in slices(batches, "text", PIECE):
            found = Runs(*utf8(batch.column("text")), length)
            docs = batch.column("doc_id").to_numpy(zero_copy_only=False)[found.rows]
            order, (_, new) = groups(found.key, found.content)
            begin = np.flatnonzero(new)
            size = np.diff([*begin, len(order)])
            twice = np.repeat(size > 1, size)
            settled = order[twice]
            out = [{"part": c["bucket"] % (1 << bits), **c} for c in
                   _cells(docs[settled], {"contents": found.content[settled]}, buckets)]
            keep = np.argsort(order[begin])
            sent, many = order[begin][keep], (size > 1)[keep]
            key = found.key[sent]
            out += [{"part": part, "docs": planes(docs[sent[rows]]), "keys": low7(key[rows]),
                     "contents": found.content[sent[rows]].tobytes(), "twice": many[rows].tobytes()}
                    for part, rows in by_part(key, bits)]
            yield pa.RecordBatch.from_pylist(out, REPLY)

    return run


def _judge(bits: int, buckets: int):
    """One part: runs that occur twice, and those whose bytes must be compared."""
    schema = pa.schema([("bucket", pa.int32()), ("docs", pa.binary()), ("contents", pa.binary()),
                        ("compare", pa.bool_())])

    def run(key, table):
        part = key[0].as_py()
        rows = table.to_pylist()
        out = [{"bucket": r["bucket"], "docs": r["docs"], "contents": r["contents"], "compare": False}
               for r in rows if r["keys"] is None]
        cells = [r for r in rows if r["keys"] is not None]
        if cells:
            keys = np.concatenate([unlow7(r["keys"], part, bits) for r in cells])
            docs = np.concatenate([unplanes(r["docs"]) for r in cells])
            contents = np.concatenate([np.frombuffer(r["contents"], np.uint64) for r in cells])
            twice = np.concatenate([np.frombuffer(r["twice"], bool) for r in cells])
            order, (outer, inner, _) = groups(keys, contents, docs)
            docs, contents, twice = docs[order], contents[order], twice[order]
            begin = np.flatnonzero(inner)
            size = np.diff([*begin, len(docs)])
            again = np.repeat(size > 1, size)
            kinds = np.add.reduceat(inner.astype(np.int64), np.flatnonzero(outer))
            mixed = np.repeat(kinds > 1, np.diff([*np.flatnonzero(outer), len(docs)]))
            out += _cells(docs[again & ~twice], {"contents": contents[again & ~twice]}, buckets, compare=False)
            send = mixed & inner
            out += _cells(docs[send], {"contents": contents[send]}, buckets, compare=True)
        return pa.Table.from_pylist(out, schema)

    return run


PIECES = pa.schema([("shard", pa.int32()), ("bucket", pa.int32()), ("docs", pa.binary()), ("starts", pa.binary()),
                    ("stops", pa.binary()), ("bytes", pa.binary()), ("settled", pa.binary())])


def _resolve(length: int, bits: int, buckets: int):
    """One bucket of texts: ranges of settled runs, and the bytes of those to be compared, by shard."""

    def run(texts, replies):
        cells = replies.to_pylist()
        none = [np.zeros(0, np.int64)]
        sides = []
        for compare in (False, True):
            mine = [c for c in cells if c["compare"] == compare]
            d = np.concatenate([unplanes(c["docs"]) for c in mine] or none)
            c = np.concatenate([np.frombuffer(c["contents"], np.uint64) for c in mine] or [np.zeros(0, np.uint64)])
            order = np.lexsort((c, d))
            sides.append(set(zip(d[order].tolist(), c[order].tolist(), strict=True)) if compare else (d, c))
        out, asked = [], sides[1]
        for batch in slices(texts.to_batches(), "text", PIECE):
            data, at = utf8(batch.column("text"))
            found = Runs(data, at, length)
            docs = batch.column("doc_id").to_numpy(zero_copy_only=False)
            own = docs[found.rows]
            done = member(found.content, own, sides[0][1], sides[0][0])
            first, last = found.first[done], found.last[done]
            gone_from, gone_to = runs(covered(first, last + length, len(data)), at)
            rows = np.searchsorted(at, gone_from, "right") - 1
            out += [{"shard": c["bucket"] % (1 << bits), **c} for c in _cells(
                docs[rows], {"starts": gone_from - at[rows], "stops": gone_to - at[rows]}, buckets)]
            if not asked:
                continue
            picked = []
            for i in np.flatnonzero(np.isin(found.content, np.array([c for _, c in asked], np.uint64))).tolist():
                pair = (int(own[i]), int(found.content[i]))
                if pair in asked:  # the first of several
                    asked.discard(pair)
                    picked.append(i)
            picked = np.array(picked, np.int64)
            for part, rows in by_part(found.key[picked], bits):
                mine = picked[rows]
                mine = mine[np.argsort(own[mine], kind="stable")]
                text = np.concatenate([data[found.first[i]:found.last[i] + length] for i in mine])
                begin = found.first[mine] - at[found.rows[mine]]
                out.append({"shard": part, "docs": planes(own[mine]), "starts": begin.tobytes(),
                            "stops": (begin + found.last[mine] - found.first[mine] + length).tobytes(),
                            "bytes": text.tobytes(), "settled": done[mine].tobytes()})
        return pa.Table.from_pylist(out, PIECES)

    return run


def _match(length: int, buckets: int):
    """One shard: index its runs batch by batch; ranges of the strings that were found twice."""
    schema = pa.schema([("bucket", pa.int32()), ("docs", pa.binary()), ("starts", pa.binary()), ("stops", pa.binary())])

    def run(table):
        rows = table.to_pylist()
        out = [{k: r[k] for k in schema.names} for r in rows if r["bytes"] is None]
        cells = [r for r in rows if r["bytes"] is not None]
        if cells:
            docs = np.concatenate([unplanes(r["docs"]) for r in cells])
            starts, stops = (np.concatenate([np.frombuffer(r[k], np.int64) for r in cells]) for k in ("starts", "stops"))
            settled = np.concatenate([np.frombuffer(r["settled"], bool) for r in cells])
            text = np.frombuffer(b"".join(r["bytes"] for r in cells), np.uint8)
            del rows, cells
            size = stops - starts
            begin = np.cumsum(size) - size
            strings = size - length + 1
            number = np.cumsum(strings) - strings
            family = Family(length, int(strings.sum()))
            cut = 0
            while cut < len(docs):
                end = max(cut + 1, int(np.searchsorted(number, number[cut] + BATCH, "right")) - 1)
                places = np.arange(int(strings[cut:end].sum())) + np.repeat(
                    begin[cut:end] - begin[cut] - (number[cut:end] - number[cut]), strings[cut:end])
                family.add(text[begin[cut]:begin[end - 1] + size[end - 1]], places, int(number[cut]))
                cut = end
            owner = np.repeat(np.arange(len(docs)), strings)
            hit = family.seen & ~settled[owner]
            a, b = runs(hit, np.concatenate([number, [len(hit)]]))
            run_no = owner[a]
            low = starts[run_no] + a - number[run_no]
            out += _cells(docs[run_no], {"starts": low, "stops": low + (b - a) + length - 1}, buckets)
        return pa.Table.from_pylist(out, schema)

    return run


def _cut(texts, replies):
    """One bucket: the texts without the ranges."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()),
                        ("n_spans", pa.int64()), ("kept", pa.binary())])
    cells = replies.to_pylist()
    none = [np.zeros(0, np.int64)]
    d = np.concatenate([unplanes(c["docs"]) for c in cells] or none)
    order = np.argsort(d, kind="stable")
    d = d[order]
    starts, stops = (np.concatenate([np.frombuffer(c[k], np.int64) for c in cells] or none)[order] for k in ("starts", "stops"))
    out = []
    for batch in slices(texts.to_batches(), "text", 2 * PIECE):
        data, at = utf8(batch.column("text"))
        docs = batch.column("doc_id").fill_null(0).to_numpy()
        known = batch.column("doc_id").is_valid().to_numpy(zero_copy_only=False)
        low, high = np.searchsorted(d, docs), np.searchsorted(d, docs, "right")
        n = np.where(known, high - low, 0)
        pick = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        base = np.repeat(at[:-1], n)
        gone = covered(base + starts[pick], base + stops[pick], len(data))
        opened, _ = runs(gone, at)
        left, before = data[~gone], np.concatenate([[0], np.cumsum(~gone)])[at]
        out.append(pa.record_batch([
            batch.column("doc_id"), pa.array(np.diff(at)), pa.array(np.diff(at) - np.diff(before)),
            pa.array(np.bincount(np.searchsorted(at, opened, "right") - 1, minlength=len(docs))),
            pa.array([left[a:b].tobytes() for a, b in zip(before[:-1], before[1:], strict=True)], pa.binary()),
        ], schema=schema))
    return pa.Table.from_batches(out, schema)


def remove_repeated_bytes(docs: DataFrame, length: int = 200, id_col: str = "doc_id",
                          text_col: str = "text") -> DataFrame:
    """Texts without the bytes of any string of this many bytes that also starts elsewhere.

    Returns doc_id, n_bytes, n_removed, n_spans (maximal removed runs) and kept (the remaining bytes, which
    may cut a character), one row for each input row. Matches never cross documents, may overlap, and are
    judged on the input. A null text is empty; shorter texts keep everything. Rows without an id keep their
    bytes and take none from others. Ids must be unique for exact byte ranges: of rows that share an id the
    greatest text counts and is returned once. Empty tables and further columns are fine.
    """
    texts = one_row_per_id(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")))
    bits = part_bits(texts)
    buckets = bucket_count(bits)
    known = texts.where("doc_id is not null")
    dealt = texts.withColumn("bucket", F.expr(f"coalesce(pmod(doc_id, {buckets}), 0)").cast("int"))
    packed = known.mapInArrow(_scatter(length, bits, buckets),
                              "part int, bucket int, docs binary, keys binary, contents binary, twice binary")
    verdicts = packed.groupBy("part").applyInArrow(
        _judge(bits, buckets), "bucket int, docs binary, contents binary, compare boolean")
    pieces = dealt.where("doc_id is not null").groupBy("bucket").cogroup(verdicts.groupBy("bucket")).applyInArrow(
        _resolve(length, bits, buckets),
        "shard int, bucket int, docs binary, starts binary, stops binary, bytes binary, settled binary")
    ranges = pieces.groupBy("shard").applyInArrow(
        _match(length, buckets), "bucket int, docs binary, starts binary, stops binary")
    return dealt.groupBy("bucket").cogroup(ranges.groupBy("bucket")).applyInArrow(
        _cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
