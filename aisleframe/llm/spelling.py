"""Spelling variants of frequent words by blocked Gram matrices.

One inserted, deleted or replaced letter changes the letter counts of a word by a vector of squared length
one or two. Words are packed into blocks of one length; the product of two blocks' letter-count matrices
gives all squared distances at once, and only pairs at most two apart are compared letter by letter. Blocks
are also cut by how many letters of two classes a word has, which an edit moves by one at most, so that
a block meets seven kinds of neighbour instead of every word of about its length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aisleframe.sources.stages import stage_table

#: Letters of a word; all lie in Latin-1, so that a word is one byte a letter there.
LETTERS = "[A-Za-zÀ-ÿ]"
#: Two letter classes; every other letter belongs to neither.
CLASSES = ("aeiou", "lnrst")
#: What one edit does to length and class counts. Of a move and its reverse, one is listed.
MOVES = ((0, 0, 0), (0, 1, 0), (0, 0, 1), (0, 1, -1), (1, 0, 0), (1, 1, 0), (1, 0, 1))
#: Letters of a block: 2048 words of 16.
BLOCK_LETTERS = 1 << 15
#: Products of two words that a task computes.
TASK_PAIRS = 1 << 28
#: Letters that are compared at a time.
CHUNK = 1 << 22
_CELL = ("size", "first", "second")


def noised_words(docs: DataFrame, every: int = 199, least: int = 6, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """Words of at least so many letters, one row for each occurrence; A-Z are lower-cased.

    A run of letters whose checksum with the document's id `every` divides loses one letter. A null id counts
    as an empty one, a null text has no words.
    """
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(
        F.regexp_extract_all(text_col, F.lit(f"{LETTERS}{{{least},}}"), F.lit(0))).alias("run"))
    lower = F.translate("run", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    runs = runs.select("id", F.when(F.lower("run") == F.col("run"), F.col("run")).otherwise(lower).alias("run"))
    runs = runs.select("run", F.crc32(F.concat_ws(":", "id", "run").cast("binary")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = runs.select(F.when(F.col("h") % every == 0, cut).otherwise(F.col("run")).alias("word"))
    return words.where(F.length("word") >= least)


def _blocks(words: DataFrame) -> DataFrame:
    """Blocks of words of one cell: the cell, sub (number of the block in it), subs, n_words, letters, counts."""
    of_class = [(F.length("word") - F.length(F.translate("word", letters, ""))).alias(name)
                for letters, name in zip(CLASSES, _CELL[1:], strict=True)]
    placed = words.select("word", "n", F.length("word").alias("size"), *of_class)
    cells = stage_table(placed.groupBy(*_CELL).agg(F.ceil(
        F.count("*") * F.greatest("size", F.lit(16)) / BLOCK_LETTERS).cast("int").alias("subs")), "cells")
    dealt = placed.join(cells, list(_CELL)).withColumn("sub", F.pmod(F.xxhash64("word"), "subs").cast("int"))
    packed = dealt.groupBy(*_CELL, "sub", "subs").agg(F.sort_array(F.collect_list(F.struct("word", "n"))).alias("w"))
    return packed.select(*_CELL, "sub", "subs", F.size("w").alias("n_words"),
                         F.encode(F.array_join("w.word", ""), "ISO-8859-1").alias("letters"),
                         F.col("w.n").alias("counts"))


def _block_pairs(blocks: DataFrame) -> DataFrame:
    """Pairs of blocks that may hold near words, each once, with the content of both."""
    moves = F.array(*[F.struct(*[F.lit(x).alias(c) for x, c in zip(m, _CELL, strict=True)]) for m in MOVES])
    left = blocks.select(*[F.col(c).alias(f"l_{c}") for c in blocks.columns if c != "subs"], F.explode(moves).alias("m"))
    left = left.select("*", *[(F.col(f"l_{c}") + F.col(f"m.{c}")).alias(c) for c in _CELL])
    subs = blocks.select(*_CELL, "subs").distinct()
    met = left.join(subs, list(_CELL)).select("*", F.explode(F.sequence(F.lit(0), F.col("subs") - 1)).alias("sub"))
    own = (F.col("m.size") == 0) & (F.col("m.first") == 0) & (F.col("m.second") == 0)
    met = met.where(~own | (F.col("l_sub") <= F.col("sub")))
    return met.select(*[c for c in left.columns if c.startswith("l_")], *_CELL, "sub", own.alias("own")).join(
        blocks.drop("subs"), [*_CELL, "sub"])


def _counts(codes: np.ndarray) -> np.ndarray:
    """How often each of the 90 letters occurs in each word; single precision is exact for short words."""
    n, size = codes.shape
    letter = np.where(codes < 128, codes.astype(np.int64) - 97, codes.astype(np.int64) - 166)
    flat = np.bincount((np.arange(n)[:, None] * 90 + letter).ravel(), minlength=n * 90)
    return flat.reshape(n, 90).astype(np.float32 if size < 2000 else np.float64)


def one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which rows of two letter matrices differ by one edit; b's words are as long as a's or one letter longer."""
    if a.shape[1] == b.shape[1]:
        return (a != b).sum(axis=1) == 1
    size = a.shape[1]
    ahead, behind = a != b[:, :-1], a != b[:, 1:]
    first = np.where(ahead.any(axis=1), ahead.argmax(axis=1), size)
    last = np.where(behind.any(axis=1), size - 1 - behind[:, ::-1].argmax(axis=1), -1)
    return last < first


def near_rows(a: np.ndarray, b: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of near words of two blocks; same: the blocks are one, each pair counts once."""
    x, y = _counts(a), _counts(b)
    apart = x @ y.T
    apart *= -2
    apart += (x * x).sum(axis=1)[:, None]
    apart += (y * y).sum(axis=1)[None, :]
    i, j = np.nonzero(apart <= 2)
    if same:
        i, j = i[i < j], j[i < j]
    step = max(1, CHUNK // max(1, a.shape[1]))
    hits = [one_edit(a[i[s:s + step]], b[j[s:s + step]]) for s in range(0, len(i), step)]
    hit = np.concatenate(hits) if hits else np.zeros(0, bool)
    return i[hit], j[hit]


def _near(batches):
    """Tasks over pairs of blocks: both directions of every near pair."""
    schema = pa.schema([("word", pa.string()), ("near", pa.string()), ("near_n", pa.int64())])
    for batch in batches:
        for row in range(batch.num_rows):
            one = {name: batch.column(name)[row] for name in batch.schema.names}
            sides = []
            for side in ("l_", ""):
                letters = np.frombuffer(one[side + "letters"].as_buffer(), np.uint8)
                sides.append((letters.reshape(one[side + "n_words"].as_py(), -1),
                              one[side + "counts"].values.to_numpy()))
            (a, n), (b, m) = sides
            i, j = near_rows(a, b, one["own"].as_py() and one["l_sub"].as_py() == one["sub"].as_py())
            if len(i):
                u = [x.tobytes().decode("latin-1") for x in a[i]]
                v = [x.tobytes().decode("latin-1") for x in b[j]]
                yield pa.record_batch([pa.array(u + v), pa.array(v + u), pa.array(np.concatenate([m[j], n[i]]))],
                                      schema=schema)


def near_words(words: DataFrame) -> DataFrame:
    """Near words of a table (word, n) of distinct words: word, near, near_n, each pair in both directions."""
    blocks = stage_table(_blocks(words), "blocks")
    pairs = _block_pairs(blocks)
    work = pairs.agg(F.sum(F.col("l_n_words").cast("long") * F.col("n_words"))).first()[0] or 0
    tasks = max(words.sparkSession.sparkContext.defaultParallelism, work // TASK_PAIRS)
    keys = [f"l_{c}" for c in (*_CELL, "sub")] + [*_CELL, "sub"]
    return pairs.repartition(int(tasks), *keys).mapInArrow(_near, "word string, near string, near_n long")


def _roots(forms: DataFrame) -> DataFrame:
    """Last form of each word that has one: word, root. Each round doubles the steps followed.

    A form is at least `factor` times as frequent as its word, so that paths are short and have no circles.
    """
    roots = stage_table(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = stage_table(roots.join(ahead, "root", "left").select("word", "root", "further"), "roots")
        roots = step.select("word", F.coalesce("further", "root").alias("root"))
        if step.where("further is not null").isEmpty():
            return roots


def spelling_variants(docs: DataFrame, least_letters: int = 6, least_n: int = 5, factor: int = 5,
                      every: int = 199, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Frequent words with the frequent word that each is a variant of.

    Returns word, form, root, n, n_near, form_n, one row for each word (see `noised_words`) of at least
    least_letters letters that occurs least_n times in the whole table. Two words are near if one inserted,
    deleted or replaced letter turns one into the other. form is the most frequent near word (of equals, the
    first by code point) if it is at least `factor` times as frequent as the word, else null; root is the end
    of the chain of forms, the word itself if it has none. Null texts, texts without letters and empty tables
    give no words; repeated rows count once for each; further columns are not looked at.
    """
    counted = noised_words(docs, every, least_letters, id_col, text_col).groupBy("word").agg(F.count("*").alias("n"))
    words = stage_table(counted.where(F.col("n") >= least_n), "words")
    near = near_words(words).groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("n"), "near")).alias("best"))
    found = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(-F.col("best.n") >= factor * F.col("n"), F.col("best")).alias("best"))
    found = stage_table(found.select("word", F.col("best.near").alias("form"), "n", "n_near",
                                     (-F.col("best.n")).alias("form_n")), "variants")
    roots = _roots(found.where("form is not null"))
    return found.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
