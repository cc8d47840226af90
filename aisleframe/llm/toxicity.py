"""Toxicity by a subsequence string kernel with Nystroem landmarks.

The kernel compares words by their gapped letter triples (any gap; a triple over more places weighs less), so
that an insult with other characters between its letters stays close to the plain one. Neighbouring words of
one or two letters are read as one word too, so that white space counts as a gap there. A support vector machine
over the Nystroem map of word kernels tells insulting words: those that labelled toxic texts hold far more
often than chance, against words of clean texts, the hardest of which are added in rounds. A text is scored by its strongest words and their share.

Training sees a bounded sample of labelled rows (`SAMPLE` of each class); every text is scored whole. The
machine is linear in the triples, so its landmarks fold into one weight for each triple.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from aisleframe.llm.arrays import LOWER, Words, runs, slices, utf8

PIECE = 2 << 20
#: Labelled texts of each class to train on; landmarks (spread by pivoted Cholesky); decay of a triple for each letter it skips.
SAMPLE = 1500
LANDMARKS = 900
#: Insulting words to train on; other words are up to ten times as many.
MOST = 1500
DECAY = 0.6
ROUNDS = 5
#: Score of a word up to which it is no sign of toxicity at all.
FLOOR = -2.0
#: Triples, and words, whose dense vectors are held at a time; words of the vocabulary whose triples are.
COLUMNS, ROWS = 4096, 250
SCORED = 1 << 13
#: Letters: a-z, and the last byte of other characters; any other byte is a gap. START opens a word.
SIGNS = np.zeros(256, np.int64)
SIGNS[97:123] = np.arange(1, 27)
SIGNS[128:192] = 27 + (np.arange(64) & 31)
START, SIZE = 59, 60
#: Letters up to which a unit's triples are listed; those of longer units are summed by recursion.
LISTED = 24
#: Neighbouring words of so few letters are also read as one, in windows of so many words and all together.
SHORT, JOINED = 2, 12
#: Joined windows that are spelled at a time.
SPELLED = 1 << 11


def triples(signs: np.ndarray, begin: np.ndarray, size: np.ndarray):
    """Yield (word, triple, weight, summed squares) arrays; words lie end to end in signs.

    A triple is any three letters of a word in their order; it weighs DECAY for each place it skips, gaps
    included.
    """
    place = np.flatnonzero(signs > 0)
    letters, word = signs[place], np.repeat(np.arange(len(begin)), size)[place]
    count = np.bincount(word, minlength=len(begin))
    few = count[word] <= LISTED
    x, w, at = letters[few], word[few], place[few]
    for b in range(2, int(count[count <= LISTED].max(initial=0))):
        i = np.flatnonzero(w[:-b] == w[b:])
        weight = DECAY ** (at[i + b] - at[i] - 2.0)
        for a in range(1, b):
            yield w[i], (x[i] * SIZE + x[i + a]) * SIZE + x[i + b], weight, weight ** 2
    first = np.cumsum(count) - count
    for k in np.flatnonzero(count > LISTED):
        code, weight, squares = _summed(letters[first[k]:first[k] + count[k]], place[first[k]:first[k] + count[k]])
        yield np.full(len(code), k), code, weight, np.where(np.arange(len(code)) == 0, squares, 0.0)


def _summed(letters: np.ndarray, place: np.ndarray):
    """Triples of one long unit with their summed weights, and the sum of squared weights of all triples."""
    one, two, three = np.zeros(SIZE), np.zeros((SIZE, SIZE)), np.zeros((SIZE,) * 3)
    sums = [0.0, 0.0, 0.0]  # the same for squares, whatever the letters
    steps = np.diff(place, prepend=place[0]).tolist()
    for z, step in zip(letters.tolist(), steps, strict=True):
        fade = DECAY ** step
        one *= fade
        two *= fade
        three[z] += two
        two[:, z] += one
        one[z] += 1
        sums[2] += sums[1] * fade ** 2
        sums[1] = (sums[1] + sums[0]) * fade ** 2
        sums[0] = sums[0] * fade ** 2 + 1
    # three has the last letter first
    x, y, z = np.nonzero(three.transpose(1, 2, 0))
    return (x * SIZE + y) * SIZE + z, three[z, x, y] / DECAY ** 2, sums[2] / DECAY ** 4


def spelled(words: Words, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signs of the chosen words, START before each."""
    size = (words.ends - words.starts)[chosen] + 1
    begin = np.cumsum(size) - size
    place = np.repeat(words.starts[chosen] - 1 - begin, size) + np.arange(int(size.sum()))
    signs = SIGNS[LOWER[words.data[np.maximum(place, 0)]]]
    signs[begin] = START
    return signs, begin, size


def folded(table: np.ndarray, signs, begin, size) -> np.ndarray:
    """Per word: its triples' weights in the table, over the norm of its triples."""
    total, norm = np.zeros(len(begin)), np.zeros(len(begin))
    for word, code, weight, square in triples(signs, begin, size):
        total += np.bincount(word, weights=table[code] * weight, minlength=len(begin))
        norm += np.bincount(word, weights=square, minlength=len(begin))
    return total / np.sqrt(np.where(norm > 0, norm, 1))


def folded_exactly(table: np.ndarray, signs, begin, size) -> np.ndarray:
    """The same with equal triples of a word summed before the norm, as short words often repeat."""
    found = [(word, code, weight) for word, code, weight, _ in triples(signs, begin, size)]
    if not found:
        return np.zeros(len(begin))
    word, code, weight = (np.concatenate(x) for x in zip(*found, strict=True))
    key, which = np.unique(word * SIZE ** 3 + code, return_inverse=True)
    weight = np.bincount(which, weights=weight)
    word, code = np.divmod(key, SIZE ** 3)
    total = np.bincount(word, weights=table[code] * weight, minlength=len(begin))
    norm = np.bincount(word, weights=weight ** 2, minlength=len(begin))
    return total / np.sqrt(np.where(norm > 0, norm, 1))


def matrix(spelling, codes: np.ndarray) -> np.ndarray:
    """Normalised triple vectors of words, in the columns that codes (sorted) name."""
    signs, begin, size = spelling
    out, norm = np.zeros((len(begin), len(codes)), np.float32), np.zeros(len(begin))
    for word, code, weight, square in triples(signs, begin, size):
        norm += np.bincount(word, weights=square, minlength=len(begin))
        at = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
        known = codes[at] == code
        np.add.at(out, (word[known], at[known]), weight[known].astype(np.float32))
    out /= np.sqrt(np.where(norm > 0, norm, 1))[:, None].astype(np.float32)
    return out


def kernel_of(spelling) -> np.ndarray:
    """Kernel of all pairs of the words, summed over blocks of triples."""
    codes = np.unique(np.concatenate([code for _, code, _, _ in triples(*spelling)]))
    total = np.zeros((len(spelling[1]),) * 2)
    for a in range(0, len(codes), COLUMNS):
        block = matrix(spelling, codes[a:a + COLUMNS])
        total += block @ block.T
    return total


def spread_out(kernel: np.ndarray, n: int) -> np.ndarray:
    """Pivoted Cholesky: up to n rows, each the one that those before explain least."""
    rest, factor, chosen = np.diag(kernel).copy(), np.zeros((len(kernel), n)), []
    while len(chosen) < n and rest.max() > 1e-3:
        pivot = int(rest.argmax())
        column = (kernel[:, pivot] - factor[:, :len(chosen)] @ factor[pivot, :len(chosen)]) / np.sqrt(rest[pivot])
        factor[:, len(chosen)] = column
        rest = np.maximum(rest - column ** 2, 0)
        rest[pivot] = 0
        chosen.append(pivot)
    return np.array(chosen)


def hinge(x: np.ndarray, y: np.ndarray, weight: np.ndarray, cost: float, steps: int = 60) -> np.ndarray:
    """Weights (the last is the bias) of a squared-hinge machine, by Newton steps on its active rows.

    The last column of x is ones. Rows are summed in blocks, so that x is never copied.
    """
    w = np.zeros(x.shape[1])
    balance = weight / np.where(y > 0, weight[y > 0].sum(), weight[y < 0].sum()) * len(y) / 2
    for _ in range(steps):
        gram, side = np.eye(len(w)) / cost, np.zeros(len(w))
        for a in range(0, len(x), 4 * ROWS):
            xa, ya = x[a:a + 4 * ROWS].astype(float), y[a:a + 4 * ROWS]
            on = ya * (xa @ w) < 1
            xa, ya, ba = xa[on], ya[on], balance[a:a + 4 * ROWS][on]
            gram += xa.T @ (xa * ba[:, None])
            side += xa.T @ (ya * ba)
        new = np.linalg.solve(gram, side)
        if np.abs(new - w).max() < 1e-7:
            return new
        w = (w + new) / 2 if _ > 20 else new
    return w


def rising(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic weights of which none but the bias is negative: a column that gets one is left out."""
    used = np.arange(x.shape[1])
    while True:
        w = logistic(x[:, used], y)
        if not len(used) or w[:-1].min() >= 0:
            out = np.zeros(x.shape[1] + 1)
            out[used], out[-1] = w[:-1], w[-1]
            return out
        used = np.delete(used, w[:-1].argmin())


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Ridge logistic weights, the last is the bias; classes weigh alike."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    balance = np.where(y > 0, len(y) / max(1, (y > 0).sum()), len(y) / max(1, (y <= 0).sum())) / 2
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (balance * (p - y)) + ridge * w
        step = np.linalg.solve(x.T @ (x * (balance * p * (1 - p))[:, None]) + ridge * np.eye(len(w)), grad)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


def joined(table: np.ndarray, words: Words, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, score) of each run of neighbouring short words: its best window, or all of it, read as one word."""
    letters = np.concatenate([[0], np.cumsum(SIGNS[words.data] > 0)])
    start, stop = runs(letters[words.ends] - letters[words.starts] <= SHORT, words.first)
    wide = (stop - start > 1) & (letters[words.ends[stop - 1]] - letters[words.starts[start]] > 2)
    start, stop = start[wide], stop[wide]
    best = np.full(len(start), -np.inf)
    if not len(start):
        return np.zeros(0, np.int64), best
    row = np.searchsorted(words.first, start, "right") - 1
    for n in range(2, min(JOINED, int((stop - start).max())) + 1):
        some = np.flatnonzero(stop - start >= n)
        run = np.repeat(some, (stop - start)[some] - n + 1)
        from_ = _counted(start[some], (stop - start)[some] - n + 1)
        code, where = words.windows(hashes, n)
        code = code[np.searchsorted(where, from_)]
        _, first, which = np.unique(code, return_index=True, return_inverse=True)
        got = _joined(table, words, from_[first], np.full(len(first), n))
        np.maximum.at(best, run, got[which])
    more = np.flatnonzero(stop - start > JOINED)
    best[more] = np.maximum(best[more], _joined(table, words, start[more], (stop - start)[more]))
    return row, best


def _counted(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each, count numbers long."""
    return np.repeat(start - np.cumsum(count) + count, count) + np.arange(int(count.sum()))


def _joined(table: np.ndarray, words: Words, start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Scores of count words from start on, read as one word with a gap between them."""
    out = np.zeros(len(start))
    for a in range(0, len(start), SPELLED):
        own = count[a:a + SPELLED]
        signs, begin, size = spelled(words, _counted(start[a:a + SPELLED], own))
        head = np.cumsum(own) - own
        signs[np.delete(begin, head)] = 0
        out[a:a + SPELLED] = folded_exactly(table, signs, begin[head], np.add.reduceat(size, head))
    return out


def features(n: int, row: np.ndarray, score: np.ndarray) -> np.ndarray:
    """Per text: strongest word, sum of what exceeds zero, numbers of words above 0 and 0.5.

    The strongest word counts from FLOOR on, the others from zero on. A text without words has zeros, and another
    word never lowers a value.
    """
    out = np.zeros((n, 4))
    np.maximum.at(out[:, 0], row, score - FLOOR)
    out[:, 0] = np.minimum(out[:, 0], 3 - FLOOR)
    out[:, 1] = np.minimum(np.bincount(row, weights=np.maximum(score, 0), minlength=n), 20) / 10
    out[:, 2] = np.log1p(np.bincount(row[score > 0], minlength=n))
    out[:, 3] = np.log1p(np.bincount(row[score > 0.5], minlength=n))
    return out


def read(table: np.ndarray, bias: float, words: Words, score: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Features of the texts, given the scores of their words; runs of short words count as words too."""
    row, more = joined(table, words, hashes)
    return features(len(words.first) - 1, np.concatenate([words.rows(), row]), np.concatenate([score, more + bias]))


def worded(texts: pa.Array | pa.ChunkedArray):
    """Words of the texts, a bounded number of bytes at a time."""
    for batch in slices(pa.table({"text": texts}).to_batches(), "text", PIECE):
        yield Words(*utf8(batch.column("text")), lower=True)


def vocabulary(texts: pa.Array | pa.ChunkedArray, y: np.ndarray):
    """Distinct words of the texts as words of one row, and, ordered by hash, the number of each in that row, its
    hash, and the numbers of toxic and of clean texts that hold it."""
    spelling, keys, toxic, clean = [], [], [], []
    row = 0
    for words in worded(texts):
        n = len(words.first) - 1
        hashes = words.hashes()
        _, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        seen = np.unique(which * np.int64(n) + words.rows())
        in_all = np.bincount(seen // n, minlength=len(first))
        in_toxic = np.bincount(seen // n, weights=y[row:row + n][seen % n], minlength=len(first))
        keep = np.zeros(len(hashes), bool)
        keep[first] = True
        order = np.argsort(first)
        spelling.append(words.joined(keep)[0])
        keys.append(hashes[keep])
        toxic.append(in_toxic[order])
        clean.append((in_all - in_toxic)[order])
        row += n
    data = np.concatenate(spelling)
    kind, first, which = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
    in_toxic, in_clean = (np.bincount(which, weights=np.concatenate(x), minlength=len(kind)) for x in (toxic, clean))
    return Words(data, np.array([0, len(data)])), first, kind, in_toxic, in_clean


def train(texts: pa.Array | pa.ChunkedArray, toxic: list[int]) -> tuple[np.ndarray, float, np.ndarray]:
    """(triple weights, word bias, text weights) from labelled texts; without both classes, all scores are 0."""
    y = np.array(toxic)
    table, bias = np.zeros(SIZE ** 3), 0.0
    if not 0 < y.sum() < len(y):
        return table, bias, np.array([0, 0, 0, 0, -40.0])
    words, first, kind, in_toxic, in_clean = vocabulary(texts, y)
    n1, n0 = int(y.sum()), int((1 - y).sum())
    odds = np.log((in_toxic + 0.5) / (n1 + 1)) - np.log((in_clean + 0.5) / (n0 + 1))
    expected = (in_toxic + in_clean) * n1 / len(y)
    surprise = in_toxic * np.log(np.maximum(in_toxic, 1e-9) / np.maximum(expected, 1e-9))
    draw = np.random.default_rng(8)
    order = np.argsort(-surprise, kind="stable")
    positive = order[(odds[order] > 1.5) & (surprise[order] > 9) & (in_toxic[order] > 3)][:MOST]
    if not len(positive):
        positive = order[:20]
    clean = np.flatnonzero((in_clean > 0) & ((odds < 0.7) | (in_clean > in_toxic)))
    clean = np.setdiff1d(clean if len(clean) else np.arange(len(kind)), positive)
    if not len(clean):
        return table, bias, np.array([0, 0, 0, 0, -40.0])
    usual = clean[np.argsort(-in_clean[clean], kind="stable")[:2 * MOST]]
    negative = np.union1d(usual, draw.choice(clean, min(3 * MOST, len(clean)), replace=False))

    def part(chosen):
        return spelled(words, first[chosen])

    pool = np.concatenate([positive[:LANDMARKS], usual[:LANDMARKS // 2],
                           draw.choice(negative, min(LANDMARKS // 2, len(negative)), replace=False)])
    chosen = pool[spread_out(kernel_of(part(pool)), LANDMARKS)]
    codes = np.unique(np.concatenate([code for _, code, _, _ in triples(*part(chosen))]))
    marks = matrix(part(chosen), codes)
    values, turned = np.linalg.eigh((marks @ marks.T).astype(float))
    root = turned / np.sqrt(np.maximum(values, 1e-6)) @ turned.T

    def mapped(chosen):
        out = np.ones((len(chosen), len(root) + 1), np.float32)
        for a in range(0, len(chosen), ROWS):
            out[a:a + ROWS, :-1] = (matrix(part(chosen[a:a + ROWS]), codes) @ marks.T) @ root
        return out

    for turn in range(ROUNDS):
        chosen = np.concatenate([positive, negative])
        sign = np.where(np.arange(len(chosen)) < len(positive), 1.0, -1.0)
        weight = np.sqrt(np.where(sign > 0, in_toxic[chosen], in_clean[chosen]))
        w = hinge(mapped(chosen), sign, weight, 200.0)
        table = np.zeros(SIZE ** 3)
        for a in range(0, len(codes), COLUMNS):
            table[codes[a:a + COLUMNS]] = (root @ w[:-1]) @ marks[:, a:a + COLUMNS]
        bias = float(w[-1])
        score = np.concatenate([folded(table, *part(np.arange(a, min(a + SCORED, len(kind)))))
                                for a in range(0, len(kind), SCORED)]) + bias
        if turn < ROUNDS - 1:  # words of clean texts that look insulting become examples against it
            negative = np.union1d(negative, clean[np.argsort(-score[clean], kind="stable")[:MOST]])
    x = []
    for words in worded(texts):
        hashes = words.hashes()
        x.append(read(table, bias, words, score[np.searchsorted(kind, hashes)], hashes))
    return table, bias, rising(np.concatenate(x), y)


def _scored(model, column: str, schema):
    table, bias, weights = model.value

    def run(batches):
        for batch in slices(batches, column, PIECE):
            words = Words(*utf8(batch.column(column)), lower=True)
            hashes = words.hashes()
            _, first, which = np.unique(hashes, return_index=True, return_inverse=True)
            score = folded(table, *spelled(words, first))[which] + bias if len(which) else np.zeros(0)
            x = read(table, bias, words, score, hashes)
            p = 1 / (1 + np.exp(-np.clip(x @ weights[:-1] + weights[-1], -40, 40)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p)], names=schema)

    return run


def held_out(id_col: str = "doc_id"):
    """Rows that training never sees."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "toxic"):
    """Train on at most `sample` labelled texts of each class, drawn by a hash of their id; held-out ids never."""
    usable = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("toxic")).where(
        "id is not null and toxic is not null").where(~held_out("id"))
    sides = [usable.where(F.col("toxic") == k).orderBy(F.xxhash64("id"), "id").limit(sample) for k in (1, 0)]
    few = F.broadcast(sides[0].unionByName(sides[1]).groupBy("id").agg(F.max("toxic").alias("toxic")))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(few, "id")
    rows = rows.groupBy("id").agg(F.max("text").alias("text"), F.max("toxic").alias("toxic")).sort("id").toArrow()
    return train(rows.column("text"), rows.column("toxic").to_pylist())


def score(docs: DataFrame, model, text_col: str = "text", into: str = "toxicity_score") -> DataFrame:
    """The rows with one more column: a score from 0 to 1.

    Null and empty texts score what a text without words scores. The name of the new column must be free.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = StructType([*docs.schema.fields, StructField(into, DoubleType())])
    return docs.mapInArrow(_scored(shared, text_col, schema.names), schema)
