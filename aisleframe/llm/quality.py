"""Quality rules with cross-document line frequency.

Each document is measured on its own, and its normalised lines are hashed. Spark counts in how many
documents of a host each line occurs; lines above the limit count as removed, and documents that
keep too little are rejected.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aisleframe.llm.arrays import BASE, BYTE_CODES, LOWER, Words, covered, mix, slices, utf8
from aisleframe.sources.stages import stage_table

PIECE = 2 << 20
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
#: Lines are compared in lower case, with every digit as 0 and one space between words.
FOLD = LOWER.copy()
FOLD[48:58] = 48


def _sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sum of the values of each row."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[at[1:]] - total[at[:-1]]


def _ordered_sum(hashes: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Hash of each stretch of hashes, in order; stretches follow each other without a gap."""
    if not len(begin):
        return np.zeros(0, np.uint64)
    place = np.arange(int(size.sum()), dtype=np.int64) - np.repeat(begin, size)
    powers = np.full(int(size.max()), BASE, np.uint64)
    powers[0] = 1
    return mix(np.add.reduceat(hashes * np.cumprod(powers)[place], begin) + size.astype(np.uint64))


def repeated_words(words: Words, k: int = 3) -> np.ndarray:
    """Per row: words in k-word windows that occur twice or more in the row."""
    hashes, where = words.windows(words.hashes(), k)
    rows = words.rows()[where]
    order = np.lexsort((hashes, rows))
    same = (hashes[order][1:] == hashes[order][:-1]) & (rows[order][1:] == rows[order][:-1])
    twice = np.zeros(len(order), bool)
    twice[1:] |= same
    twice[:-1] |= same
    hit = where[order[twice]]
    return _sums(covered(hit, hit + k, len(words.starts)), words.first)


def lines_of(data: np.ndarray, at: np.ndarray, words: Words):
    """Lines with a word: row, bytes from and to, and the number of the first word of each."""
    breaks = np.flatnonzero(data == 10)
    full = at[:-1][np.diff(at) > 0]
    opens = np.unique(np.concatenate([full, breaks + 1]))
    opens = opens[opens < len(data)]
    row_end = at[np.searchsorted(at, opens, "right")] if len(opens) else opens
    next_break = np.concatenate([breaks, [len(data)]])[np.searchsorted(breaks, opens)]
    closes = np.minimum(next_break, row_end)
    first, after = np.searchsorted(words.starts, opens), np.searchsorted(words.starts, closes)
    some = after > first
    rows = np.searchsorted(at, opens[some], "right") - 1
    return rows, opens[some], closes[some], first[some], after[some]


def _measure(batches):
    for batch in slices(batches, "text", PIECE):
        data, at = utf8(batch.column("text"))
        words = Words(data, at)
        rows, opens, closes, first, after = lines_of(data, at, words)
        size = closes - opens
        begin = np.cumsum(size) - size
        raw = data[np.repeat(opens - begin, size) + np.arange(int(size.sum()))]
        exact = _ordered_sum(BYTE_CODES[raw], begin, size)
        order = np.lexsort((exact, rows))
        again = (exact[order][1:] == exact[order][:-1]) & (rows[order][1:] == rows[order][:-1])
        n = batch.num_rows
        folded = Words(FOLD[data], at).hashes()
        count = after - first
        normal = _ordered_sum(folded, first, count).view(np.int64)
        per_row = np.bincount(rows, minlength=n)
        ends = pa.array(np.concatenate([[0], np.cumsum(per_row)]).astype(np.int32))
        lines = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(
            [pa.array(normal), pa.array(count.astype(np.int64))], ["line", "words"]))
        yield pa.record_batch({
            "doc_id": batch.column("doc_id"), "host": batch.column("host"),
            "n_words": words.counts, "word_chars": _sums(words.inside & ((data & 0xC0) != 0x80), at),
            "n_symbols": _sums(SYMBOLS[data], at),
            "n_dup_lines": np.bincount(rows[order[1:][again]], minlength=n),
            "n_repeat_words": repeated_words(words), "lines": lines})


def quality(docs: DataFrame, limit: int = 100, least_left: int = 50, least_words: int = 50,
            id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """Measures and verdict of each document, one row for each input row.

    A line is removed where more than `limit` distinct documents of one host have it: copies of a text are
    documents of their own, rows that repeat an id are one, and each row without an id is one. A document is rejected that fails the base rules, or
    keeps less than `least_left` per cent of its words. Returns doc_id, n_words, word_chars, n_symbols,
    n_dup_lines, n_repeat_words, n_line_words (words in removed lines), base_failed, kept. A null text has
    no words and fails; null hosts are one host; repeated rows and rows without an id are judged like any
    other.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"),
                        F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("host"))
    measured = texts.mapInArrow(
        _measure, "doc_id long, host string, n_words long, word_chars long, n_symbols long, "
        "n_dup_lines long, n_repeat_words long, lines array<struct<line long, words long>>")
    measured = stage_table(measured.withColumn("row", F.monotonically_increasing_id()), "measures")
    nameless = F.when(F.col("doc_id").isNull(), F.col("row")).otherwise(-1)
    lines = measured.select("row", "host", F.coalesce("doc_id", F.lit(0)).alias("id"), nameless.alias("nameless"),
                            F.inline("lines"))
    common = lines.groupBy("host", "line").agg(F.countDistinct("id", "nameless").alias("documents")).where(
        F.col("documents") > limit).select("host", "line")
    removed = lines.join(common, ["host", "line"], "left_semi").groupBy("row").agg(
        F.sum("words").alias("n_line_words"))
    whole = measured.drop("lines", "host").join(removed, "row", "left").withColumn(
        "n_line_words", F.coalesce("n_line_words", F.lit(0)))
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    left = F.col("n_words") - F.col("n_line_words")
    return whole.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_line_words",
        failed.alias("base_failed"), (~failed & (100 * left >= least_left * F.col("n_words"))).alias("kept"))
