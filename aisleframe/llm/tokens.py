"""Byte-pair ids of a batch of texts: every distinct piece of a block is encoded once, all new ones in one call.

The cut into pieces (contractions, letters, digits, other signs, white space) is done on code-point arrays;
a worker keeps the ids of pieces it has met. The ids are those of the `tokenizers` file given by path.
"""

from __future__ import annotations

import json
import re
import sys
import types

import numpy as np

from aisleframe.llm.arrays import BASE, CHUNK, mix

#: Pieces a worker remembers before it starts anew.
KNOWN = 200_000
LETTER, DIGIT, SPACE, OTHER = 1, 2, 3, 0


def worker_cache() -> dict:
    """Lives as long as the Python worker; functions shipped by value get fresh globals with each task."""
    name = "aisleframe_worker_cache"
    return sys.modules.setdefault(name, types.ModuleType(name)).__dict__


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _kinds() -> np.ndarray:
    """Letter, digit, white space or other for every code point."""
    import regex

    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    text = "".join(map(chr, points))
    at = np.array(points)
    kinds = np.zeros(0x110000, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (DIGIT, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(pattern, text):
            kinds[at[m.start():m.end()]] = kind
    return kinds


def piece_starts(points: np.ndarray, at: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Where pieces begin in the code points of texts laid end to end; at: text starts and the end."""
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    kind = kinds[points]
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    start = edge[:-1].copy()
    start[1:] |= kind[1:] != kind[:-1]
    # The last sign of white space before a word: a blank joins the word, another sign stands alone.
    last = np.zeros(n, bool)
    last[:-1] = (kind[:-1] == SPACE) & (kind[1:] != SPACE) & ~edge[1:-1]
    start |= last
    joined = np.flatnonzero(last & (points == 32)) + 1
    start[joined] = False
    # An apostrophe that begins a piece takes s, t, m, d, re, ve or ll with it.
    i = np.flatnonzero(points == 39)
    i = i[start[i] & ~edge[i + 1]]
    i = i[kind[i + 1] == LETTER]
    first = points[i + 1]
    second = np.where(edge[i + 2], 0, points[np.minimum(i + 2, n - 1)])
    size = np.zeros(len(i), np.int64)
    for a, b in ("re", "ve", "ll"):
        size[(first == ord(a)) & (second == ord(b))] = 3
    size[np.isin(first, [ord(c) for c in "stmd"])] = 2
    i, size = i[size > 0], size[size > 0]
    start[i + 1] = False
    after = i + size
    start[after[after < n]] = True
    return np.flatnonzero(start)


class Encoder:
    """Ids of texts; built once for each worker and file."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            given = json.load(f)
        vocab = given["model"]["vocab"]
        # The file writes byte b as one printable sign: itself if printable, else the next from 256 on.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        signs = {chr(b): b for b in plain}
        signs.update({chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))})
        ranks = {bytes(signs[c] for c in word): i for word, i in vocab.items() if all(c in signs for c in word)}
        top = max(ranks.values()) + 1
        ranks = {w: i for w, i in ranks.items() if i < top}
        # Added tokens of the file: their text is one id wherever it stands, and cuts the text around it.
        self.special = {t["content"]: t["id"] for t in given.get("added_tokens", ())}
        self.marks = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) or r"(?!)")
        for w in self.special:
            ranks.pop(w.encode(), None)
        # Many pieces are encoded in one call, with U+0000 between them; a piece that holds it goes alone.
        self.between = ranks[b"\0"]
        self.encode = tiktoken.Encoding("pieces", pat_str=r"[^\x00]+|\x00", mergeable_ranks=ranks,
                                        special_tokens={}).encode_ordinary
        self.encode_alone = tiktoken.Encoding("piece", pat_str=r"[\s\S]+", mergeable_ranks=ranks,
                                              special_tokens={}).encode_ordinary
        self.kinds = _kinds()
        self.clear()

    def clear(self) -> None:
        """Forget all pieces: their hashes in ascending order, the slot of each, and the slots' ids and ends."""
        self.known, self.slots = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.ids, self.ends = np.zeros(0, np.int32), np.zeros(1, np.int64)

    @classmethod
    def of(cls, path: str) -> Encoder:
        cache = worker_cache()
        if path not in cache:
            cache[path] = cls(path)
        return cache[path]

    def _marked(self, texts: list[str], whole: str, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where added tokens begin and end in the texts laid end to end; none lies across two texts."""
        found = []
        if any(w in whole for w in self.special):
            found = [(a + m.start(), a + m.end()) for t, a in zip(texts, at.tolist(), strict=False) for m in self.marks.finditer(t)]
        begin, end = np.array(found, np.int64).reshape(-1, 2).T
        return begin, end

    def _learn(self, whole: str, points: np.ndarray, start: np.ndarray, size: np.ndarray,
               marked: np.ndarray) -> np.ndarray:
        """Add ids of pieces, some of them marked as added tokens; returns the pieces in the order of their slots."""
        total = int(size.sum())
        begin = np.cumsum(size) - size
        spelled = points[np.repeat(start - begin, size) + np.arange(total)]
        alone = marked | np.logical_or.reduceat(spelled == 0, begin)
        chosen = np.flatnonzero(~alone)
        own = size[chosen]
        joined = np.zeros(int(own.sum()) + len(own), np.uint32)
        letters = np.ones(len(joined), bool)
        letters[np.cumsum(own + 1) - 1] = False
        joined[letters] = spelled[np.repeat(~alone, size)]
        ids = np.array(self.encode(joined.tobytes().decode("utf-32-le")), np.int32)
        between = ids == self.between
        count = np.diff(np.flatnonzero(between), prepend=-1) - 1
        parts, counts = [self.ids, ids[~between]], [count]
        for i in np.flatnonzero(alone):
            piece = whole[start[i]:start[i] + size[i]]
            found = [self.special[piece]] if marked[i] else self.encode_alone(piece)
            parts.append(np.array(found, np.int32))
            counts.append(np.array([len(found)]))
        self.ids = np.concatenate(parts)
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(np.concatenate(counts))])
        return np.concatenate([chosen, np.flatnonzero(alone)])

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and where each text begins."""
        whole = "".join(texts)
        at = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        points = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        begin, end = self._marked(texts, whole, at)
        start = piece_starts(points, np.concatenate([at, begin, end]), self.kinds)
        if len(begin):
            before = np.searchsorted(begin, start) - 1  # the last marked text that begins earlier
            start = start[(before < 0) | (start >= end[before])]
        if not len(start):
            return np.zeros(0, np.int32), np.zeros(len(at), np.int64)
        size = np.diff(start, append=len(points))
        powers = np.full(int(size.max()), BASE, np.uint64)
        powers[0] = 1
        powers = np.cumprod(powers)
        hashes = np.empty(len(start), np.uint64)
        for a in range(0, len(start), CHUNK):  # a bounded number of pieces at a time
            first, own = start[a], size[a:a + CHUNK]
            at_piece = start[a:a + CHUNK] - first
            part = points[first:first + int(own.sum())].astype(np.uint64) + np.uint64(1)
            hashes[a:a + CHUNK] = np.add.reduceat(part * powers[np.arange(len(part)) - np.repeat(at_piece, own)], at_piece)
        hashes = mix(hashes + size.astype(np.uint64))
        order = np.argsort(hashes)  # any of equal pieces will do
        hashes = hashes[order]
        opens = np.ones(len(hashes), bool)
        opens[1:] = hashes[1:] != hashes[:-1]
        distinct, first = hashes[opens], order[opens]
        which = np.empty(len(order), np.int64)
        which[order] = np.cumsum(opens) - 1
        if len(self.known) > KNOWN:
            self.clear()
        place = np.searchsorted(self.known, distinct)
        new = np.ones(len(distinct), bool)
        if len(self.known):
            new = self.known[np.minimum(place, len(self.known) - 1)] != distinct
        if new.any():
            fresh = first[new]
            order = self._learn(whole, points, start[fresh], size[fresh], np.isin(start[fresh], begin))
            slots = np.empty(len(order), np.int64)
            slots[order] = len(self.known) + np.arange(len(order))
            self.known = np.insert(self.known, place[new], distinct[new])
            self.slots = np.insert(self.slots, place[new], slots)
            place = np.searchsorted(self.known, distinct)
        found = self.slots[place]
        begin, count = self.ends[found][which], (self.ends[found + 1] - self.ends[found])[which]
        stop = np.cumsum(count)
        out = self.ids[np.repeat(begin - (stop - count), count) + np.arange(int(stop[-1]))]
        pieces_before = np.searchsorted(start, at)
        return out, np.concatenate([[0], stop])[pieces_before]
