"""Order MinHash against plain Python, with the same hash of words and elements."""

from __future__ import annotations

import hashlib
import re
import struct
from collections import Counter

import numpy as np
import pytest
import xxhash

from aisleframe.llm.fingerprints import HASHES, RUN, fingerprints, following

DRAW = np.random.default_rng(4)
VOCAB = ["".join(chr(97 + c) for c in DRAW.integers(0, 26, 5)) for _ in range(200)]


def prose(n):
    return " ".join(DRAW.choice(VOCAB, n))


def chain(*values):
    """Hash of several 64-bit numbers, each seeded with the one before; 32-bit numbers are hashed as such."""
    seed = 42
    for v, width in values:
        seed = xxhash.xxh64_intdigest(struct.pack("<q" if width == 8 else "<i", v), seed=seed)
    return seed - (1 << 64) if seed >> 63 else seed


def signature(text):
    words = [xxhash.xxh64_intdigest(w.encode(), seed=42) for w in re.findall(r"[^\x20\x09-\x0D]+", text)]
    words = [w - (1 << 64) if w >> 63 else w for w in words]
    runs = [chain(*[(w, 8) for w in words[i:i + RUN]]) for i in range(len(words) - RUN + 1)]
    if not runs and words:
        runs = [chain(*[(w, 8) for w in words])]
    seen, out = Counter(), []
    elements = []
    for place, r in enumerate(runs):
        seen[r] += 1
        elements.append((chain((r, 8), (seen[r], 8)), place))
    for j in range(HASHES if runs else 0):
        pair = []
        for half in (0, 1):
            ranked = [((chain((e, 8), (j, 4)) % (1 << 64)) >> 31, p) for e, p in elements if e & 1 == half]
            if ranked:
                pair.append(min(ranked))
        ordered = [h for h, _ in sorted(pair, key=lambda x: x[1])]
        out.append(chain(*[(h, 8) for h in ordered]) & 0xFFFFFFFF)
    return "".join(f"{x:08x}" for x in out)


def near(a, b):
    one, two = (re.findall("." * 8, x) for x in (a, b))
    if not one and not two:
        return 1.0
    return sum(x == y for x, y in zip(one, two, strict=False)) / max(len(one), len(two))


@pytest.fixture(scope="module")
def texts():
    base = prose(200)
    words = base.split()
    return {-5: base, 0: base, 3: " ".join([*words[100:], *words[:100]]), 7: None, 8: "", 9: " \n\t", 10: "one two three",
            70000: "a " * 300, 70001: "é" * 41, 1 << 40: prose(1500), (1 << 40) + 1: "x" * 30000, 1 << 62: prose(4)}


def test_fingerprints(spark, texts):
    rows = [(i, t, "p", 1) for i, t in texts.items()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, part string, run int").repartition(3)
    got = {r["doc_id"]: r for r in fingerprints(docs).collect()}
    ids = sorted(texts)
    assert sorted(got) == ids
    for i, after in zip(ids, [*ids[1:], ids[0]], strict=True):
        text, other = texts[i] or "", texts[after] or ""
        q = len(text) // 4
        edited = text[:len(text) - q] + other[:q]
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert (r["fingerprint"], r["edited_fingerprint"]) == (signature(text), signature(edited)), i
        assert r["near_edited"] == near(signature(text), signature(edited))
        assert r["near_next"] == near(signature(text), signature(other))
    assert got[-5]["near_next"] == 1.0
    assert got[-5]["near_edited"] > 0.2


def test_order_counts(spark):
    """A text with its halves swapped has nearly all elements of the original, in another order."""
    a, b = prose(100), prose(100)
    docs = spark.createDataFrame([(1, f"{a} {b}"), (2, f"{b} {a}"), (3, f"{a} {b}")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in fingerprints(docs).collect()}
    assert got[3]["near_next"] == 1.0
    assert 0.1 < got[1]["near_next"] < 0.85


def test_repeated_rows_null_ids_and_empty(spark, texts):
    long = texts[0]
    docs = spark.createDataFrame([(1, long), (1, long), (1, "other words"), (None, long), (2, None)], "doc_id long, text string")
    got = fingerprints(docs).collect()
    assert len(got) == 5
    assert len({r["fingerprint"] for r in got if r["n_chars"] == len(long)}) == 1
    alone = [r for r in got if r["doc_id"] is None][0]
    cut = long[:len(long) - len(long) // 4]
    assert alone["edited_sha256"] == hashlib.sha256(cut.encode()).hexdigest()
    assert alone["near_next"] == 0.0
    assert fingerprints(docs.where("doc_id = 9")).count() == 0


def test_following(spark):
    ids = sorted({int(x) for x in DRAW.integers(-2**62, 2**62, 50)} | set(range(65530, 65545)) | {-1, 0, 1})
    got = following(spark.createDataFrame([(i,) for i in ids], "doc_id long")).collect()
    assert dict(map(tuple, got)) == dict(zip(ids, [*ids[1:], ids[0]], strict=True))
