"""Document fingerprints by order MinHash.

Every run of five words of a text is numbered among its equals, so that a repeated run stays a different
element each time. Elements are dealt into two halves by a hash; each of several hash functions picks the
smallest of each half, puts the two back in the order of the text and hashes them together. Two texts agree on
a component if they share both elements in the same order, so that moved passages lower the likeness, as they
raise the edit distance. Only SQL functions are used: texts are dealt out by document once, and numbering,
selection and sums run inside that partitioning.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aisleframe.sources.stages import stage_table

#: Words of an element, and hash functions.
RUN, HASHES = 5, 32
#: Bits of a place in the text; the other 33 bits of a positive number hold the hash.
PLACE_BITS = 30
WHITE = " \t\n\x0b\x0c\r"
#: Characters of a task.
PART_CHARS = 4 << 20
#: Ids are followed 16 bits at a time.
GROUP_BITS = 16


def following(ids: DataFrame) -> DataFrame:
    """The next larger id of each distinct id: doc_id, next_id; the smallest follows the largest.

    Ids are ordered inside groups that share all but their last 16 bits, groups inside larger groups, and so
    on, so that no task orders more than 65536 of them. The first id of the next group follows a group's last.
    """
    heads = ids.select(F.col("doc_id").alias("group"), F.col("doc_id").alias("first"))

    def ahead(heads: DataFrame, bits: int) -> DataFrame:
        if bits == 64:
            return heads.select("group", F.lead("first").over(Window.partitionBy(F.lit(0)).orderBy("group")).alias("next_id"))
        placed = heads.withColumn("above", F.shiftright("group", GROUP_BITS))
        inside = placed.select("group", "above", F.lead("first").over(
            Window.partitionBy("above").orderBy("group")).alias("inside"))
        groups = placed.groupBy(F.col("above").alias("group")).agg(F.min("first").alias("first"))
        beyond = ahead(groups, bits + GROUP_BITS).withColumnRenamed("group", "above")
        return inside.join(beyond, "above", "left").select("group", F.coalesce("inside", "next_id").alias("next_id"))

    least = ids.agg(F.min("doc_id")).first()[0]
    return ahead(heads, GROUP_BITS).select(F.col("group").alias("doc_id"),
                                           F.coalesce("next_id", F.lit(least)).cast("long").alias("next_id"))


def _words(text):
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def _hashes(words):
    return F.transform(words, lambda w: F.xxhash64(w))


def _runs(words, whole: bool):
    """Hash of each run of five words of a list of hashes; of fewer, if whole, one of all of them."""
    n = F.size(words)

    def run(first, i):
        return F.xxhash64(first, *[F.get(words, i + j) for j in range(1, RUN)])

    runs = F.when(n >= RUN, F.transform(F.slice(words, F.lit(1), n - (RUN - 1)), run))
    if whole:
        runs = runs.when(n > 0, F.array(F.xxhash64(words)))
    return runs.otherwise(F.array().cast("array<bigint>"))


def _signed(parts: DataFrame, keys: list[str], about: str) -> DataFrame:
    """Signatures of pairs of texts: keys, about, signature and edited_signature.

    parts: keys, about and an array parts of (part, first, runs): runs of both texts (part 0), of the first alone
    (1) or of the second alone (2), and the place of the first of them. No exchange is needed if the table is
    partitioned by one of the keys.
    """
    every = parts.select(*keys, about, F.explode_outer("parts").alias("p")).select(*keys, about, "p.*")
    runs = every.select(*keys, "part", "first", F.when(F.col("part") == 0, F.col(about)).alias(about),
                        F.posexplode_outer("runs").alias("at", "run"))
    runs = runs.select(*keys, "part", F.when(F.coalesce("at", F.lit(0)) == 0, F.col(about)).alias(about), "run",
                       (F.col("first") + F.col("at")).alias("place"))
    same = Window.partitionBy(*keys, "run").orderBy("place", "part")
    number = F.when(F.col("part") == 2, F.count(F.when(F.col("part") != 1, 1)).over(same)).otherwise(
        F.count(F.when(F.col("part") != 2, 1)).over(same))
    element = F.when(F.col("run").isNotNull(), F.xxhash64("run", number))
    numbered = runs.select(*keys, "part", about, "place", element.alias("element"))

    def ranked(j):
        high = F.shiftrightunsigned(F.xxhash64("element", F.lit(j)), 64 - 63 + PLACE_BITS)
        low = F.least(F.col("place"), F.lit((1 << PLACE_BITS) - 1)).cast("long")
        return F.when(F.col("element").isNotNull(), F.shiftleft(high, PLACE_BITS).bitwiseOR(low))

    half = F.col("element").bitwiseAND(F.lit(1)).alias("half")
    least = numbered.groupBy(*keys, "part", half).agg(
        *[F.min(ranked(j)).alias(f"v{j}") for j in range(HASHES)], F.max(about).alias(about))
    gathered = least.select(*keys, about, F.struct(
        "part", "half", F.array(*[f"v{j}" for j in range(HASHES)]).alias("least")).alias("one")).groupBy(*keys).agg(
        F.max(about).alias(about), F.collect_list("one").alias("all"))

    def signature(other):
        def least(half):
            mine = F.filter("all", lambda p: (p["part"] != other) & (p["half"] == half))
            return F.transform(F.sequence(F.lit(0), F.lit(HASHES - 1)),
                               lambda j: F.array_min(F.transform(mine, lambda p: F.get(p["least"], j))))

        def place(x):
            return x.bitwiseAND(F.lit((1 << PLACE_BITS) - 1))

        def component(x, y):
            one, two = (F.shiftright(v, PLACE_BITS) for v in (x, y))
            pair = F.when(place(x) > place(y), F.xxhash64(two, one)).otherwise(F.xxhash64(one, two))
            return pair.bitwiseAND(F.lit(0xFFFFFFFF))

        known = F.exists("all", lambda p: (p["part"] != other) & p["half"].isNotNull())
        return F.when(known, F.zip_with(least(0), least(1), component)).otherwise(F.array().cast("array<bigint>"))

    return gathered.select(*keys, about, signature(2).alias("signature"), signature(1).alias("edited_signature"))


def likeness(one: str, two: str):
    """Share of components on which two signatures agree; two empty ones are alike, an empty and another not."""
    equal = F.size(F.filter(F.zip_with(one, two, lambda x, y: x == y), lambda e: e))
    most = F.greatest(F.size(one), F.size(two))
    return F.when(most == 0, 1.0).otherwise(equal / most)


def _text(signature: str):
    return F.array_join(F.transform(signature, lambda x: F.lower(F.lpad(F.hex(x), 8, "0"))), "")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint of each text, of an edited copy, and how alike they and the next document's are.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next, one
    row for each input row. The edited text has the last quarter of the text's code points (rounded down)
    replaced by as many from the beginning of the next document by id, or all it has; the first follows the
    last. Of rows with one id but different texts, the one with the least hash of its text is the next
    document of others. A row without an id has no next document, which counts as an empty one. Null texts
    count as empty, a text without words has an empty fingerprint; repeated rows are repeated in the result;
    an empty table gives no rows; further columns are not looked at.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"))
    texts = texts.select("doc_id", "text", F.xxhash64("text").alias("own"))
    sizes = stage_table(texts.groupBy("doc_id").agg(
        F.sum(F.length("text").cast("long")).alias("chars"), F.max(F.floor(F.length("text") / 4)).alias("quarter"),
        F.min("own").alias("chief")), "sizes")
    chars = sizes.agg(F.sum("chars")).first()[0] or 0
    known = sizes.where("doc_id is not null")
    nexts = known.select(F.col("doc_id").alias("next_id"), F.col("chief").alias("next_chief"))
    links = stage_table(following(known).join(nexts, "next_id").join(known.select("doc_id", "quarter"), "doc_id"), "nexts")

    parts = int(max(docs.sparkSession.sparkContext.defaultParallelism, chars // PART_CHARS))
    key = F.xxhash64("doc_id", F.when(F.col("doc_id").isNull(), F.col("text")))
    dealt = texts.withColumn("key", key).repartition(parts, "key")
    # Filters stay above the joins, so that both read one exchange of the texts.
    wanted = links.select(F.xxhash64("next_id").alias("key"), F.xxhash64("doc_id").alias("previous"), "quarter", "next_chief")
    chief = F.col("doc_id").isNotNull() & (F.col("own") == F.col("next_chief"))
    ahead = dealt.join(wanted, "key").select(F.col("previous").alias("key"), F.when(chief, F.substring(
        "text", F.lit(1), F.col("quarter").cast("int"))).alias("ahead"))
    ahead = ahead.repartition(parts, "key").groupBy("key").agg(F.max("ahead").alias("ahead"))
    rows = dealt.join(ahead, "key", "left").groupBy("key", "own", "doc_id", "text", "ahead").agg(
        F.count("*").cast("int").alias("copies"))
    n = F.length("text")
    quarter = F.floor(n / 4).cast("int")
    end = F.when(F.col("doc_id").isNotNull(), F.coalesce("ahead", F.lit(""))).otherwise("")
    rows = rows.select("key", "own", "doc_id", "copies", n.cast("long").alias("n_chars"),
                       F.substring("text", F.lit(1), n - quarter).alias("head"),
                       F.substring("text", n - quarter + 1, quarter).alias("tail"),
                       F.substring(end, F.lit(1), quarter).alias("other"))
    about = F.struct("doc_id", "copies", "n_chars", F.sha2(F.concat("head", "other"), 256).alias("edited_sha256"))
    rows = rows.select("key", "own", about.alias("about"), "head", "tail", "other", _words("head").alias("words"))
    # Both texts begin with the words of head but its last, which the cut may have split.
    n = F.size("words")
    last = F.concat(F.coalesce(F.get("words", n - 1), F.lit("")),
                    F.when(F.substring("head", -1, 1).isin(*WHITE), " ").otherwise(""))
    rows = rows.select("key", "own", "about", _hashes(F.slice("words", F.lit(1), F.greatest(n - 1, F.lit(0)))).alias("both"),
                       _hashes(_words(F.concat(last, "tail"))).alias("tail"),
                       _hashes(_words(F.concat(last, "other"))).alias("other"))
    n = F.size("both")
    before = F.slice("both", F.greatest(n - (RUN - 2), F.lit(1)), RUN - 1)
    rows = rows.select("key", "own", "about", "both", F.concat(before, "tail").alias("tail"),
                       F.concat(before, "other").alias("other"))
    first = F.greatest(n - (RUN - 1), F.lit(0))

    # Generators are outer: others make the optimizer copy the whole expression into a filter.
    def part(number, at, runs):
        return F.struct(F.lit(number).alias("part"), at.alias("first"), runs.alias("runs"))

    parts = rows.select("key", "own", "about", F.array(part(0, F.lit(0), _runs("both", False)), part(
        1, first, _runs("tail", True)), part(2, first, _runs("other", True))).alias("parts"))
    prints = _signed(parts, ["key", "own"], "about")
    prints = stage_table(prints.select("own", "about.*", "signature", "edited_signature"), "prints")

    theirs = prints.select(F.col("doc_id").alias("next_id"), F.col("own").alias("next_chief"),
                           F.col("signature").alias("next_signature"))
    beside = links.join(theirs, ["next_id", "next_chief"]).select("doc_id", "next_signature")
    found = prints.join(beside, "doc_id", "left").withColumn(
        "next_signature", F.coalesce("next_signature", F.array().cast("array<bigint>")))
    return found.select(
        "doc_id", "n_chars", "edited_sha256", _text("signature").alias("fingerprint"),
        _text("edited_signature").alias("edited_fingerprint"), likeness("signature", "edited_signature").alias("near_edited"),
        likeness("signature", "next_signature").alias("near_next"),
        F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).drop("copy")
