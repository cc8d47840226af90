"""Grouped prefix join: documents whose word 5-gram sets have a Jaccard similarity of 0.75 or more.

1. Distinct shingle hashes go to the part their top bits name; parts count in how many documents each
   occurs and send back those with two or more. A shingle of one document only can be in no
   intersection, so a document with over a quarter of such shingles has no link and leaves.
2. Equal sets are one class. Shingles are ordered by document count; the prefix of a class holds
   n - ceil(0.75 n) + 1 of them, of which those that occur nowhere else need no look-up.
3. Classes with equal size and prefix form a group. Groups that share a prefix shingle, and whose sizes
   and counts of shared shingles allow the similarity, are expanded into members and verified.

A shared shingle is numbered within its part, so that it travels as a short number that is its own, and the
numbers of a class as one packed cell.

Inside a cluster of near copies not all pairs are compared: groups are first held against one hub for
each prefix shingle (the group with the fewest own shingles, then one drawn by hash), and only pairs
whose components still differ are expanded. No link between two components is left out. A shingle whose
groups are all in one component, or that one group alone has, leaves the rounds for good.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aisleframe.llm.arrays import Words, blocks, mix, settle, slices, utf8
from aisleframe.llm.components import components
from aisleframe.llm.spread import (
    bucket_count,
    by_part,
    doc_bucket,
    low7,
    one_row_per_id,
    packed,
    part_bits,
    planes,
    short_planes,
    unlow7,
    unpacked,
    unplanes,
    unshort_planes,
)
from aisleframe.sources.stages import stage_table

#: Text bytes whose copies are looked for together, and whose shingles are made at a time.
BLOCK, PIECE = 8 << 20, 1 << 20
#: Rounds in which groups are held against one hub for each prefix shingle, before pairs are expanded.
STARS = 2
SHINGLE = 5


def shingles(data: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, hash) of the k-word shingles; a shorter text is one shingle of all its words."""
    words = Words(data, at, lower=True)
    hashes, rows = words.hashes(), words.rows()
    counts = words.counts
    found = []
    for size in range(1, k + 1):
        h, where = words.windows(hashes, size)
        r = rows[where]
        chosen = counts[r] == size if size < k else counts[r] >= k
        found.append((r[chosen], mix(h[chosen] + np.uint64(size))))
    r = np.concatenate([x[0] for x in found])
    h = np.concatenate([x[1] for x in found])
    order = np.lexsort((h, r))
    r, h = r[order], h[order]
    fresh = np.ones(len(r), bool)
    fresh[1:] = (r[1:] != r[:-1]) | (h[1:] != h[:-1])
    return r[fresh], h[fresh]


def set_digests(rows: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    """Per row: size of the set and two order-free digests of it, as signed numbers."""
    size = np.bincount(rows, minlength=n)
    out = np.zeros((n, 3), np.int64)
    out[:, 0] = size
    begin = (np.cumsum(size) - size)[size > 0]
    for column, salt in ((1, 0x51ED270B), (2, 0x2545F491)):
        if len(begin):
            out[size > 0, column] = np.add.reduceat(mix(hashes ^ np.uint64(salt)), begin).view(np.int64)
    return out


def _scatter(k: int, bits: int, buckets: int):
    schema = pa.schema([("part", pa.int32()), ("bucket", pa.int32()), ("docs", pa.binary()),
                        ("hashes", pa.binary()), ("sets", pa.binary())])

    def run(batches):
        for block in blocks(batches, "text", BLOCK):
            ids = block.column("doc_id").to_numpy(zero_copy_only=False)
            rows, hashes, before = [], [], 0
            for piece in slices([block], "text", PIECE):
                r, h = shingles(*utf8(piece.column("text")), k)
                rows.append(r + before)
                hashes.append(h)
                before += piece.num_rows
            rows, hashes = np.concatenate(rows), np.concatenate(hashes)
            sets = set_digests(rows, hashes, len(ids))
            order = np.lexsort((ids, sets[:, 2], sets[:, 1], sets[:, 0]))
            first = np.ones(len(order), bool)
            first[1:] = (sets[order[1:]] != sets[order[:-1]]).any(axis=1)
            stands = np.zeros(len(ids), bool)
            stands[order[first]] = True  # one copy in the block speaks for the others
            chosen = stands[rows]
            docs, hashes = ids[rows[chosen]], hashes[chosen]
            out = [{"part": part, "docs": planes(docs[at]), "hashes": low7(hashes[at])}
                   for part, at in by_part(hashes, bits)]
            bucket = doc_bucket(ids, buckets)
            for b in np.unique(bucket):
                here = bucket == b
                out.append({"part": int(b) % (1 << bits), "bucket": int(b), "docs": planes(ids[here]),
                            "sets": sets[here].tobytes()})
            yield pa.RecordBatch.from_pylist(out, schema)

    return run


def _count(bits: int, buckets: int):
    """One part: shingles of two or more documents, by their rank in the part, with their number of documents."""
    schema = pa.schema([("bucket", pa.int32()), ("part", pa.int32()), ("docs", pa.binary()), ("ranks", pa.binary()),
                        ("counts", pa.binary()), ("sets", pa.binary())])

    def run(key, table):
        settle()
        part = key[0].as_py()
        rows = table.to_pylist()
        out = [{"bucket": r["bucket"], "docs": r["docs"], "sets": r["sets"]} for r in rows if r["sets"] is not None]
        cells = [r for r in rows if r["hashes"] is not None]
        if cells:
            hashes = np.concatenate([unlow7(r["hashes"], part, bits) for r in cells])
            docs = np.concatenate([unplanes(r["docs"]) for r in cells])
            order = np.argsort(hashes, kind="stable")
            hashes, docs = hashes[order], docs[order]
            begin = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
            each = np.diff([*begin, len(hashes)])
            counts, ranks = np.repeat(each, each), np.repeat(np.cumsum(each > 1) - 1, each)
            shared = counts > 1
            ranks, docs, counts = ranks[shared], docs[shared], counts[shared]
            bucket = doc_bucket(docs, buckets)
            order = np.lexsort((docs, bucket))
            bucket, docs, ranks, counts = (x[order] for x in (bucket, docs, ranks, counts))
            cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
            stops = np.append(cuts[1:], len(docs))[:len(cuts)]
            out += [{"bucket": int(bucket[a]), "part": part, "docs": planes(docs[a:b]),
                     "ranks": short_planes(ranks[a:b]), "counts": short_planes(counts[a:b])}
                    for a, b in zip(cuts, stops, strict=True)]
        return pa.Table.from_pylist(out, schema)

    return run


def _sets(bits: int):
    """One bucket: per document its digests and, if it can have a link, its shared shingles and the prefix of these."""

    def run(table):
        settle()
        rows = table.to_pylist()
        info = [r for r in rows if r["sets"] is not None]
        ids = np.concatenate([unplanes(r["docs"]) for r in info])
        sets = np.concatenate([np.frombuffer(r["sets"], np.int64).reshape(-1, 3) for r in info])
        order = np.argsort(ids)
        ids, sets = ids[order], sets[order]
        cells = [r for r in rows if r["ranks"] is not None]
        none = [np.zeros(0, np.int64)]
        docs = np.concatenate([unplanes(r["docs"]) for r in cells] or none)
        tokens = np.concatenate([unshort_planes(r["ranks"]) << bits | r["part"] for r in cells] or none)
        counts = np.concatenate([unshort_planes(r["counts"]) for r in cells] or none)
        order = np.lexsort((tokens, counts, docs))
        docs, tokens = docs[order], tokens[order]
        begin = np.searchsorted(docs, ids)
        shared = np.searchsorted(docs, ids, "right") - begin
        able = (100 * shared >= 75 * sets[:, 0]) & (shared > 0)
        cells = [packed(np.sort(tokens[a:a + k])) if can else None
                 for a, k, can in zip(begin.tolist(), shared.tolist(), able.tolist(), strict=True)]
        # Rarest first: those before the last ceil(0.75 n) - 1.
        size = np.where(able, shared - (3 * sets[:, 0] + 3) // 4 + 1, 0)
        ends = np.concatenate([[0], np.cumsum(size)])
        chosen = np.repeat(begin - ends[:-1], size) + np.arange(int(ends[-1]))
        prefix = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(tokens[chosen]), mask=pa.array(~able))
        return pa.table({"doc_id": ids, "n": sets[:, 0], "d1": sets[:, 1], "d2": sets[:, 2], "shared": shared,
                         "tokens": pa.array(cells, pa.binary()), "prefix": prefix})

    return run


def _alike(batches):
    """Pairs of packed sets whose similarity is 0.75 or more."""
    settle()
    for batch in batches:
        keep = []
        for na, nb, ta, tb in zip(*(batch.column(name) for name in ("na", "nb", "ta", "tb")), strict=True):
            both = np.intersect1d(unpacked(ta.as_py()), unpacked(tb.as_py()), assume_unique=True)
            keep.append(175 * len(both) >= 75 * (na.as_py() + nb.as_py()))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) of classes whose similarity is 0.75 or more."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("tokens").alias("ta"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("tokens").alias("tb"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "na", "nb", "ta", "tb")
    return both.mapInArrow(_alike, "a long, b long")


def similar_sets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Components of documents linked by a 5-gram Jaccard similarity of 0.75 or more.

    Returns doc_id, n_shingles, component_id and class_id (smallest document with the same set), one row
    for each distinct id. Texts without words have no shingles and no links; a text under five words is
    one shingle. Of rows that share an id, the greatest text counts. Rows without an id are returned with
    their set size and no component, and link with nothing.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    bits = part_bits(texts)
    buckets = bucket_count(bits)
    known = one_row_per_id(texts).where("doc_id is not null")
    dealt = known.mapInArrow(_scatter(SHINGLE, bits, buckets),
                             "part int, bucket int, docs binary, hashes binary, sets binary")
    counted = dealt.groupBy("part").applyInArrow(
        _count(bits, buckets), "bucket int, part int, docs binary, ranks binary, counts binary, sets binary")
    nodes = stage_table(counted.groupBy("bucket").applyInArrow(
        _sets(bits), "doc_id long, n long, d1 long, d2 long, shared long, tokens binary, prefix array<long>"), "sets")
    classes = stage_table(nodes.where("n > 0").groupBy("n", "d1", "d2").agg(
        F.min("doc_id").alias("class_id"), F.max(F.col("tokens").isNotNull()).alias("able")), "classes")
    stands = classes.where("able").select(F.col("class_id").alias("doc_id"))
    sets = stage_table(nodes.where("tokens is not null").select("doc_id", "n", "shared", "tokens", "prefix").join(
        stands, "doc_id", "left_semi"), "reps")

    keyed = sets.select("doc_id", "n", "shared", F.xxhash64("prefix").alias("p1"), F.hash("prefix").alias("p2"))
    heads = keyed.groupBy("n", "p1", "p2").agg(F.min("doc_id").alias("g"))
    members = stage_table(keyed.join(heads, ["n", "p1", "p2"]).select("g", "n", "doc_id", "shared"), "members")
    tops = members.groupBy("g", "n").agg(F.max("shared").alias("shared"))
    posts = stage_table(tops.join(sets.select(F.col("doc_id").alias("g"), F.posexplode("prefix").alias("place", "token")), "g"),
                        "postings")

    near = "175 * least(shared, s2) >= 75 * (n + n2)"
    # At the first shingle two groups share, the overlap is at most what follows it in either.
    first = "175 * least(shared - place, s2 - place2) >= 75 * (n + n2)"
    edges = None
    for turn in range(STARS + 1):
        if edges is None:  # the first round holds each group for one component, and its members against its head
            open_posts = posts.withColumns({"c1": F.col("g"), "c2": F.col("g")})
        else:
            labels = stage_table(members.join(reach, members["doc_id"] == reach["node"], "left").select(
                "g", "doc_id", "n", "shared", F.coalesce("component", "doc_id").alias("component")), "labels")
            span = labels.groupBy("g").agg(F.min("component").alias("c1"), F.max("component").alias("c2"))
            open_posts = posts.join(span, "g")
        live = open_posts.groupBy("token").agg(
            F.min("c1").alias("low"), F.max("c2").alias("high"),
            F.min(F.struct((F.col("n") - F.col("shared") if turn == 0 else F.xxhash64("g")).alias("rank"),
                           F.col("g").alias("g2"), F.col("n").alias("n2"), F.col("shared").alias("s2"),
                           F.col("place").alias("place2"), F.col("c1").alias("c3"), F.col("c2").alias("c4"))).alias("hub"))
        live = stage_table(live.where("low <> high").select("token", "hub.*"), "live")
        if edges is not None and live.isEmpty() and span.where("c1 <> c2").isEmpty():
            break
        kept = stage_table(open_posts.join(live, "token"), "open")
        posts = kept.select(*posts.columns)
        if turn < STARS:
            star = kept.where(f"g <> g2 and not (c1 = c2 and c3 = c4 and c1 = c3) and {first}")
            pairs = star.select(F.least("g", "g2").alias("a"), F.greatest("g", "g2").alias("b"))
            if edges is None:
                pairs = pairs.unionByName(members.where("doc_id <> g").select(F.col("g").alias("a"), F.col("doc_id").alias("b")))
        else:
            mine = kept.select("token", "g", "n", "shared", "place", "c1", "c2")
            other = mine.select("token", *[F.col(x).alias(y) for x, y in (
                ("g", "g2"), ("n", "n2"), ("shared", "s2"), ("place", "place2"), ("c1", "c3"), ("c2", "c4"))])
            groups = mine.join(other, "token").where(
                f"g < g2 and not (c1 = c2 and c3 = c4 and c1 = c3) and {first}").select("g", "g2").distinct()
            groups = groups.unionByName(span.where("c1 <> c2").select("g", F.col("g").alias("g2")))
            mine = labels.select("g", F.col("doc_id").alias("a"), "n", "shared", "component")
            theirs = labels.select(F.col("g").alias("g2"), F.col("doc_id").alias("b"), F.col("n").alias("n2"),
                                   F.col("shared").alias("s2"), F.col("component").alias("c2"))
            pairs = groups.join(mine, "g").join(theirs, "g2").where(
                f"component <> c2 and (g <> g2 or a < b) and {near}").select("a", "b")
        more = _verified(stage_table(pairs.distinct(), "pairs"), sets)
        edges = stage_table(more if edges is None else edges.unionByName(more), "edges")
        reach = components(edges)

    whole = nodes.join(classes.select("n", "d1", "d2", "class_id"), ["n", "d1", "d2"], "left")
    found = whole.join(reach, whole["class_id"] == reach["node"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.coalesce("component", "class_id", "doc_id").alias("component_id"),
        F.coalesce("class_id", "doc_id").alias("class_id"))
    nameless = texts.where("doc_id is null").mapInArrow(_sizes, "n_shingles long").select(
        F.lit(None).cast("long").alias("doc_id"), "n_shingles",
        F.lit(None).cast("long").alias("component_id"), F.lit(None).cast("long").alias("class_id"))
    return found.unionByName(nameless)


def _sizes(batches):
    for block in blocks(batches, "text", BLOCK):
        rows, _ = shingles(*utf8(block.column("text")), SHINGLE)
        yield pa.record_batch({"n_shingles": np.bincount(rows, minlength=block.num_rows).astype(np.int64)})
