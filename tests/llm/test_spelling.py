"""Spelling variants against plain Python."""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np

from aisleframe.llm import spelling
from aisleframe.llm.spelling import near_words, one_edit, spelling_variants

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def apart(a, b):
    """Whether two words differ by one edit."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(a) + 1 == len(b) and any(b[:k] + b[k + 1:] == a for k in range(len(b)))


def expected(texts):
    count = Counter()
    for i, text in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{word}".encode())
            if h % 199 == 0:
                word = word[:h % len(word)] + word[h % len(word) + 1:]
            if len(word) >= 6:
                count[word] += 1
    n = {w: c for w, c in count.items() if c >= 5}
    near = {w: [v for v in n if v != w and apart(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 5 * n[w] else None

    def root(w):
        return root(form[w]) if form[w] else w

    return sorted((w, form[w], root(w), n[w], len(near[w]), n.get(form[w])) for w in n)


def variants(word, draw, n):
    out = []
    for _ in range(n):
        k = int(draw.integers(len(word)))
        kind = draw.integers(3)
        letter = "abcéÀß"[draw.integers(6)]
        out.append(word[:k] + word[k + 1:] if kind == 0 else word[:k] + letter + word[k + (kind == 1):])
    return out


def corpus():
    draw = np.random.default_rng(6)
    base = ["".join(chr(97 + c) for c in draw.integers(0, 26, draw.integers(6, 12))) for _ in range(30)]
    texts = [(i, " ".join([w] * int(draw.integers(1, 400)) + [v for v in variants(w, draw, 6) for _ in range(7)]))
             for i, w in enumerate(base)]
    texts += [(90, None), (91, ""), (None, "Straße " * 6 + "straßen " * 40), (93, "ÀÉÎÕÜß " * 5 + "àéîõüß " * 30),
              (94, " ".join(["z" * 3000] * 40 + ["z" * 2999] * 6)), (95, "12 _ !"), (96, "ab abc " * 50)]
    return texts + texts[:3]


def test_against_plain_python(spark, monkeypatch):
    texts = corpus()
    frame = spark.createDataFrame([(i, t, "n", 1) for i, t in texts], "doc_id long, text string, word string, n int")
    want = expected(texts)
    assert sum(w[1] is not None for w in want) > 20
    assert sorted(map(tuple, spelling_variants(frame.repartition(3)).collect()), key=lambda r: r[0]) == want
    monkeypatch.setattr(spelling, "BLOCK_LETTERS", 64)  # many blocks in a cell
    assert sorted(map(tuple, spelling_variants(frame).collect()), key=lambda r: r[0]) == want
    assert spelling_variants(frame.where("n = 2")).count() == 0


def test_near_words_of_random_letters(spark):
    draw = np.random.default_rng(2)
    words = sorted({"".join("abc"[c] for c in draw.integers(0, 3, draw.integers(6, 8))) for _ in range(400)})
    got = near_words(spark.createDataFrame([(w, 7) for w in words], "word string, n long")).collect()
    want = [(a, b) for a in words for b in words if a != b and apart(a, b)]
    assert sorted((r["word"], r["near"]) for r in got) == want


def test_one_edit():
    def rows(*words):
        return np.array([list(w.encode()) for w in words], np.uint8)

    assert one_edit(rows("abcd", "abcd", "abcd"), rows("abxd", "axxd", "abcd")).tolist() == [True, False, False]
    assert one_edit(rows("abcd", "aaaa", "abcd", "abcd"), rows("abcxd", "aaaaa", "xabcd", "axbdd")).tolist() == [True, True, True, False]
