"""Benchmark decontamination by spaced seeds.

Fixed masks over 12 words ignore some positions, so that a substituted word does not hide a passage. The
hashes of benchmark and training text under the same mask are joined; around each hit the two texts are laid
side by side, and enough equal words confirm it. Items too short for a mask are looked up whole. Only SQL
functions are used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Positions that count under each mask of 12 words, from 0; words compared before and from the hit on.
#: Every mask counts its first and last word.
MASKS = ((0, 1, 2, 4, 5, 8, 10, 11), (0, 2, 3, 5, 6, 7, 9, 11), (0, 1, 3, 4, 6, 8, 9, 11))
SPAN, BEFORE, AFTER = 12, 8, 20
#: Places of a text that are handled together.
PART = 64
#: Equal words of the 28 compared that confirm a hit; an item under 14 words allows one in six to differ.
LEAST_EQUAL = 12
#: Seeds of a benchmark block; each block is broadcast (about 300 bytes a seed).
BLOCK_SEEDS = 200_000


def _hashed(text_col: str):
    text = F.translate(F.coalesce(F.col(text_col), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
                       "abcdefghijklmnopqrstuvwxyz")
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def _places(rows: DataFrame, key: str) -> DataFrame:
    """One row for each place with 12 words: key, n (words of the text), place, part and at (words around: part from at on), ends.

    Texts are first cut into parts of PART places with the words around them, so that a place carries a
    short array however long its text is. ends hashes the first and last of the 12 words, which every mask
    counts: a place whose ends no benchmark place has needs no seeds.
    """
    null = F.lit(None).cast("long")
    padded = rows.select(key, F.size("h").alias("n"), F.concat(F.array_repeat(null, BEFORE), "h").alias("h"))
    cut = F.transform(F.sequence(F.lit(0), F.greatest(F.col("n") - SPAN, F.lit(0)), F.lit(PART)),
                      lambda s: F.slice("h", s + 1, PART + BEFORE + AFTER))
    parts = padded.select(key, "n", F.posexplode(cut).alias("k", "part"))
    last = F.least(F.lit(PART - 1), F.col("n") - SPAN - F.col("k") * PART)
    at = F.when(last >= 0, F.sequence(F.lit(0), last))
    places = parts.select(key, "n", "k", "part", F.explode(at).alias("at"))
    return places.select(key, "n", (F.col("k") * PART + F.col("at")).alias("place"), "part", "at", F.xxhash64(
        F.get("part", F.col("at") + BEFORE), F.get("part", F.col("at") + (BEFORE + SPAN - 1))).alias("ends"))


def _seeded(places: DataFrame, key: str) -> DataFrame:
    """One row for each place and mask: key, n, place, seed and the 28 words around."""
    around = F.slice("part", F.col("at") + 1, BEFORE + AFTER).alias("around")
    masks = F.array(*[F.array(*map(F.lit, mask)) for mask in MASKS])
    seeds = F.transform(masks, lambda m: F.xxhash64(m, F.transform(m, lambda p: F.get("around", p + BEFORE))))
    return places.select(key, "n", "place", around).select(
        key, "n", "place", "around", F.explode(seeds).alias("seed"))


def _whole(texts: DataFrame, short: DataFrame, lengths: list[int]) -> DataFrame:
    """Places of texts where an item of under 12 words begins that follows there word for word.

    Only places whose word begins an item are hashed over the lengths that items have.
    """
    wanted = short.select("item_id", F.size("h").alias("equal"), F.xxhash64("h").alias("run"))
    firsts = short.select(F.get("h", F.lit(0)).alias("first")).distinct()
    cut = F.transform(F.sequence(F.lit(0), F.size("h") - 1, F.lit(PART)), lambda s: F.slice("h", s + 1, PART + SPAN))
    parts = texts.where(F.size("h") > 0).select("doc_id", F.size("h").alias("n"), F.posexplode(cut).alias("k", "part"))
    at = F.sequence(F.lit(0), F.least(F.lit(PART - 1), F.col("n") - F.col("k") * PART - 1))
    places = parts.select("doc_id", "n", "k", "part", F.explode(at).alias("at"))
    places = places.select("doc_id", "n", (F.col("k") * PART + F.col("at")).alias("place"), "part", "at",
                           F.get("part", "at").alias("first")).join(F.broadcast(firsts), "first", "left_semi")
    runs = places.select("doc_id", "n", "place", "part", "at", F.explode(F.array(*map(F.lit, lengths))).alias("equal"))
    runs = runs.where(F.col("place") + F.col("equal") <= F.col("n")).select(
        "doc_id", "place", "equal", F.xxhash64(F.slice("part", F.col("at") + 1, F.col("equal"))).alias("run"))
    return runs.join(F.broadcast(wanted), ["equal", "run"]).select("doc_id", "item_id", "place", "equal")


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Documents that hold a passage of a benchmark item: doc_id, item_id, n_hits, n_equal.

    One row for each document and item with a confirmed hit; n_hits counts the places of the document that
    were confirmed, n_equal is the most equal words of a hit. Items with equal words count as the smallest of
    them. An item of 12 or 13 words may differ in two words, an item under 12 words must occur whole; null
    and empty texts and items and empty tables give no rows; rows with a null id are reported
    under null; repeated rows count once for each. The benchmark is broadcast in blocks of a fixed size.
    """
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), _hashed(item_text_col).alias("h"))
    items = items.groupBy("h").agg(F.min("item_id").alias("item_id"))
    n = F.size("h")
    short = n.between(1, SPAN - 1)
    size, lengths = items.agg(
        F.sum(F.greatest(n - (SPAN - 1), F.lit(0)) * len(MASKS) + short.cast("int")),
        F.collect_set(F.when(short, n))).first()
    blocks = -(-(size or 1) // BLOCK_SEEDS)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), _hashed(text_col).alias("h"))
    found = None
    for block in range(blocks):
        part = items.where(F.pmod(F.xxhash64("h"), F.lit(blocks)) == block)
        theirs = _places(part, "item_id")
        places = _places(texts, "doc_id").join(F.broadcast(theirs.select("ends").distinct()), "ends", "left_semi")
        needed = F.least(F.lit(LEAST_EQUAL), F.col("n") - F.floor(F.col("n") / 6)).alias("needed")
        wanted = _seeded(theirs, "item_id").select("item_id", needed, "seed", F.col("around").alias("item")).distinct()
        hits = _seeded(places, "doc_id").join(F.broadcast(wanted), "seed")
        same = F.size(F.filter(F.zip_with("around", "item", lambda x, y: x == y), lambda e: e))
        hits = hits.withColumn("equal", same).where(F.col("equal") >= F.col("needed")).select(
            "doc_id", "item_id", "place", "equal")
        if lengths:
            hits = hits.unionByName(_whole(texts, part.where(short), lengths))
        found = hits if found is None else found.unionByName(hits)
    return found.groupBy("doc_id", "item_id").agg(
        F.countDistinct("place").alias("n_hits"), F.max("equal").cast("long").alias("n_equal"))
