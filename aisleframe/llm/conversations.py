"""Repair of conversation structure by the cheapest edits.

The rows of a conversation and the roles given so far span a lattice whose edges are edits. A search from its
start and one from its end, each with its own heap, meet in the middle; all crossings of the least cost are
finished, and the least audit of edits among them counts. Rows travel without their texts until the edits are
known. A long conversation is cut into segments that are searched apart, once for each role state before and
after, and then chained, so that no task needs all its rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from heapq import heappop, heappush
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
WHITE = " \t\n\x0b\x0c\r"
#: States of the roles given so far: none, system, user, assistant; and where an initial leads from each.
START, SYSTEM, USER, ASSISTANT = range(4)
STEPS = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
BACK = tuple({x: [p for p in range(4) if STEPS[p].get(x) == q] for x in "sua"} for q in range(4))
ENDS = (START, ASSISTANT)
ROLES = {USER: "user", ASSISTANT: "assistant"}
LEGAL = {"su", "ua", "au"}
#: Rows of a segment; rows of one whose ways a task remembers, and how many such it remembers.
SEGMENT, SHORT, REMEMBERED = 1024, 32, 1 << 14

Items = tuple[tuple[str, int], ...]


def _edits(item: tuple[str, int], states: dict) -> Iterator[tuple[int, int, str]]:
    """Edits of one row as (state on the other side, cost, letters); states: initial to states there."""
    kind, times = item
    yield None, DELETE * times, "D" * times
    if kind != "D":
        extra = TRUNCATED if kind.isupper() else 0
        for q in states.get(kind.lower(), ()):
            yield q, KEEP + extra, "K"
        for x in "ua":
            for q in states.get(x, ()):
                yield q, REROLE + extra, "R"


_AHEAD = tuple({x: [q] for x, q in step.items()} for step in STEPS)


def _out(items: Items, node: tuple[int, int]) -> Iterator[tuple[tuple[int, int], int, str]]:
    i, q = node
    if i < len(items):
        for to, cost, letters in _edits(items[i], _AHEAD[q]):
            yield (i + 1, q if to is None else to), cost, letters
    for x in "ua":
        if x in STEPS[q]:
            yield (i, STEPS[q][x]), INSERT, "I"


def _in(items: Items, node: tuple[int, int]) -> Iterator[tuple[tuple[int, int], int, str]]:
    i, q = node
    if i:
        for source, cost, letters in _edits(items[i - 1], BACK[q]):
            yield (i - 1, q if source is None else source), cost, letters
    for x in "ua":
        for p in BACK[q][x]:
            yield (i, p), INSERT, "I"


def cheapest(items: Items, entry: int = START, exits: tuple[int, ...] = ENDS) -> tuple[int, str] | None:
    """Least cost and, among its edit sequences, the least audit; None if no exit can be reached.

    items: one (kind, times) for each row. s, u, a, o: initial of the role (o: any other), upper case if
    truncated; D: rows that must go. Two prefixes of equal cost at one node are never a prefix of one another
    (only insertions could lengthen one, and they cost), so the least parts make the least whole. Nodes of
    equal cost are settled along the direction of search, as keeping costs nothing.
    """
    labels = ({(0, entry): (0, "")}, {(len(items), q): (0, "") for q in exits})
    heaps = ([(0, 0, entry)], [(0, -len(items), q) for q in exits])
    done = (set(), set())
    best = (0, "") if not items and entry in exits else None
    while heaps[0] or heaps[1]:
        tops = [h[0][0] if h else 0 for h in heaps]
        if best and sum(tops) > best[0]:
            break
        side = 0 if heaps[0] and (not heaps[1] or tops[0] <= tops[1]) else 1
        _, place, q = heappop(heaps[side])
        node = (abs(place), q)
        if node in done[side]:
            continue
        done[side].add(node)
        cost, audit = labels[side][node]
        for other, step, letters in (_in if side else _out)(items, node):
            if other in done[1 - side]:
                beyond = labels[1 - side][other]
                whole = beyond[1] + letters + audit if side else audit + letters + beyond[1]
                found = (cost + step + beyond[0], whole)
                best = found if best is None else min(best, found)
            label = (cost + step, letters + audit if side else audit + letters)
            known = labels[side].get(other)
            if other not in done[side] and (known is None or label < known):
                labels[side][other] = label
                if known is None or label[0] < known[0]:
                    heappush(heaps[side], (label[0], -other[0] if side else other[0], other[1]))
    return best


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows after damage: conv_id, turn, role, text, copies. A checksum of `conv_id:turn` picks the damage."""
    def plain(name):
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    pick = (F.crc32(F.concat(plain("conv_id"), F.lit(":"), plain("turn")).cast("binary")) % 20).cast("int")
    rows = conversations.select("conv_id", "turn", plain("role").alias("role"), plain("text").alias("text"),
                                pick.alias("pick")).where("pick <> 0")
    text = F.when(F.col("pick") == 1, "").when(F.col("pick") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", F.when(F.col("pick") == 4, "user").otherwise(F.col("role")).alias("role"),
                       text.alias("text"), F.when(F.col("pick") == 3, 2).otherwise(1).alias("copies"))


def _faults(rows: DataFrame) -> DataFrame:
    """One row for each distinct row, without its text: conv_id, turn, role, digest, n, first, kind.

    first: no earlier row has its role and text. kind: initial of the role, upper case if truncated, D if blank.
    """
    ended = F.rtrim("text", F.lit(WHITE))
    initial = F.substring("role", 1, 1)
    kind = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    kind = F.when(ended == "", "D").when(F.substring(ended, -1, 1).isin(".", "!", "?"), kind).otherwise(F.upper(kind))
    own = ["conv_id", "role", "digest"]
    distinct = rows.select("conv_id", "turn", "role", "digest", "copies", kind.alias("kind")).groupBy(
        *own, "turn", "kind").agg(F.sum("copies").alias("n"))
    least = distinct.groupBy(*own).agg(F.max(F.col("turn").isNull()).alias("blank"), F.min("turn").alias("turn"))
    least = least.select(*[F.col(c).alias(f"first_{c}") for c in own],
                         F.when(~F.col("blank"), F.col("turn")).alias("first_turn"))
    same = [F.col(c).eqNullSafe(F.col(f"first_{c}")) for c in [*own, "turn"]]
    return distinct.join(least, same, "left").select(
        "conv_id", "turn", "role", "digest", "n", "kind", F.col("first_role").isNotNull().alias("first"))


_ORDER = ["turn", "role", "digest"]
_COUNTS = "blank long, duplicate long, truncated long, illegal long"
_SEGMENT_COUNTS = ("blank", "duplicate", "truncated", "illegal", "turns")


def _segment(rows: list[dict], known: dict) -> dict:
    """Counts and cheapest ways through some rows in order, for each state before and after.

    known: ways of short segments that were met before.
    """
    items, shown = [], []
    out = dict.fromkeys(_SEGMENT_COUNTS, 0)
    for r in rows:
        n, kind = r["n"], r["kind"]
        spare = n
        if kind == "D":
            out["blank"] += n
        elif r["first"]:
            items.append((kind, 1))
            out["truncated"] += kind.isupper()
            out["duplicate"] += n - 1
            spare = n - 1
        else:
            out["duplicate"] += n
        if spare:
            items.append(("D", spare))
        out["illegal"] += n - 1
        shown.append(r["role"][:1])
    out["illegal"] += sum(a + b not in LEGAL for a, b in zip(shown, shown[1:], strict=False))
    turns = [r["turn"] for r in rows if r["turn"] is not None]
    out["turns"] = len(set(turns))
    key = tuple(items)
    ways = known.get(key)
    if ways is None:
        ways = [(p, q, cheapest(key, p, (q,))) for p in range(4) for q in range(4)]
        if len(key) <= SHORT and len(known) < REMEMBERED:
            known[key] = ways
    return {**out, "low": turns[0] if turns else None, "high": turns[-1] if turns else None,
            "opens": shown[0], "closes": shown[-1],
            "ways": [{"before": p, "after": q, "cost": way[0], "audit": way[1]} for p, q, way in ways if way],
            **{c: rows[0][c] for c in ("conv_id", "turn", "role", "digest")}}


def _segments(schema: pa.Schema):
    """Tasks over sorted rows: consecutive rows of one conversation, at most SEGMENT, make a segment."""
    def run(batches):
        held, out, known = [], [], {}
        for batch in batches:
            for r in batch.to_pylist():
                if held and (r["conv_id"] != held[0]["conv_id"] or len(held) == SEGMENT):
                    out.append(_segment(held, known))
                    held = []
                held.append(r)
            yield pa.RecordBatch.from_pylist(out, schema)
            out = []
        if held:
            yield pa.RecordBatch.from_pylist([_segment(held, known)], schema)

    return run


class _Chain:
    """Segments of one conversation put together in order."""

    def __init__(self, conv_id):
        self.conv_id = conv_id
        self.labels = {START: (0, "")}
        self.settled: list[str] = []
        self.counts = dict.fromkeys(_SEGMENT_COUNTS, 0)
        self.low = self.high = self.closes = None

    def add(self, segment: dict) -> None:
        for name in _SEGMENT_COUNTS:
            self.counts[name] += segment[name]
        if self.closes is not None:
            self.counts["illegal"] += self.closes + segment["opens"] not in LEGAL
        self.closes = segment["closes"]
        if segment["low"] is not None:
            if self.low is None:
                self.low = segment["low"]
            elif self.high == segment["low"]:
                self.counts["turns"] -= 1
            self.high = segment["high"]
        after: dict[int, tuple[int, str]] = {}
        for way in segment["ways"]:
            if way["before"] in self.labels:
                cost, audit = self.labels[way["before"]]
                label = (cost + way["cost"], audit + way["audit"])
                after[way["after"]] = min(after.get(way["after"], label), label)
        shared = commonprefix([audit for _, audit in after.values()])
        self.settled.append(shared)
        self.labels = {q: (cost, audit[len(shared):]) for q, (cost, audit) in after.items()}

    def result(self) -> dict:
        cost, audit = min(self.labels[q] for q in ENDS if q in self.labels)
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.counts["turns"]
        return {"conv_id": self.conv_id, "gaps": gaps, **self.counts, "cost": cost,
                "audit": "".join([*self.settled, audit])}


def _chained(schema: pa.Schema):
    """Tasks over sorted segments: one row for each conversation."""
    def run(batches):
        chain, out = None, []
        for batch in batches:
            for segment in batch.to_pylist():
                if chain is None or chain.conv_id != segment["conv_id"]:
                    out += [chain.result()] if chain else []
                    chain = _Chain(segment["conv_id"])
                chain.add(segment)
            yield pa.RecordBatch.from_pylist(out, schema)
            out = []
        if chain:
            yield pa.RecordBatch.from_pylist([chain.result()], schema)

    return run


class _Writer:
    """Digest of a repaired conversation, fed row by row."""

    def __init__(self, solved: dict):
        self.solved, self.state, self.at = solved, START, 0
        self.digest, self.rows = hashlib.sha256(), 0

    def _put(self, role: str, text: str) -> None:
        self.digest.update((("\n" if self.rows else "") + f"{role}:{text}").encode())
        self.rows += 1

    def _given(self) -> str:
        """Role of an inserted row or of one that gets another role."""
        self.state = ASSISTANT if self.state == USER else USER
        return ROLES[self.state]

    def inserted(self) -> None:
        audit = self.solved["audit"]
        while audit[self.at:self.at + 1] == "I":
            self._put(self._given(), "")
            self.at += 1

    def add(self, role: str, text: str) -> None:
        self.inserted()
        letter = self.solved["audit"][self.at]
        self.at += 1
        if letter == "K":
            self.state = STEPS[self.state][role[0]]
            self._put(role, text)
        elif letter == "R":
            self._put(self._given(), text)

    def result(self) -> dict:
        self.inserted()
        return {**self.solved, "repaired_sha256": self.digest.hexdigest()}


def _written(schema: pa.Schema):
    """Tasks over sorted rows of whole conversations, the result of the search before the rows of each."""
    names = [n for n in schema.names if n != "repaired_sha256"]

    def run(batches):
        writer, out = None, []
        for batch in batches:
            for r in batch.to_pylist():
                if r["rank"] == 0:
                    out += [writer.result()] if writer else []
                    writer = _Writer({n: r[n] for n in names})
                elif r["rank"] == 1:
                    writer.solved |= {n: r[n] for n in names}
                else:
                    for _ in range(r["copies"]):
                        writer.add(r["role"], r["text"])
            yield pa.RecordBatch.from_pylist(out, schema)
            out = []
        if writer:
            yield pa.RecordBatch.from_pylist([writer.result()], schema)

    return run


def _arrow(spark, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(spark.createDataFrame([], ddl).schema)


def repair(conversations: DataFrame) -> DataFrame:
    """Damage a table of conversations in the fixed way and repair each by its cheapest edits.

    Returns conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256, one row for
    each conv_id of the table, null included. Rows of one conversation are taken by turn (nulls first), rows of
    equal turn by role and then by the SHA-256 of their text; repeated rows are duplicates. A null role or text
    is one space; a role that does not begin with s, u or a can only be replaced or deleted. A conversation that
    loses all its rows has zeros and the digest of nothing. Further columns are not looked at; an empty table
    gives no rows. The digest of a repaired conversation reads its rows one after the other, as any hash does,
    without holding them; everything else of a long conversation is spread over tasks.
    """
    spark = conversations.sparkSession
    key = f"conv_id {conversations.schema['conv_id'].dataType.simpleString()}"
    kinds = conversations.select(F.col("turn").cast("long").alias("turn"), "conv_id", "role", "text")
    rows = damaged(kinds).withColumn("digest", F.unhex(F.sha2("text", 256)))
    ordered = _faults(rows).repartitionByRange("conv_id", *_ORDER).sortWithinPartitions("conv_id", *_ORDER)
    segment = (f"{key}, turn long, role string, digest binary, {_COUNTS}, turns long, low long, high long, "
               "opens string, closes string, ways array<struct<before:int,after:int,cost:long,audit:string>>")
    segments = ordered.mapInArrow(_segments(_arrow(spark, segment)), segment)
    found = f"{key}, gaps long, {_COUNTS}, cost long, audit string"
    solved = segments.repartition("conv_id").sortWithinPartitions("conv_id", *_ORDER).mapInArrow(
        _chained(_arrow(spark, found)), found)
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    none = [F.lit(0).cast("long").alias(c) for c in numbers] + [F.lit("").alias("audit")]
    heads = kinds.select("conv_id").distinct().select("conv_id", F.lit(0).alias("rank"), *none)
    parts = heads.unionByName(solved.withColumn("rank", F.lit(1))).unionByName(
        rows.withColumn("rank", F.lit(2)), allowMissingColumns=True)
    whole = parts.repartition("conv_id").sortWithinPartitions("conv_id", "rank", *_ORDER)
    written = f"{found}, repaired_sha256 string"
    return whole.select(*[c for c in whole.columns if c != "digest"]).mapInArrow(
        _written(_arrow(spark, written)), written)
