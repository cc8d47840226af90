"""Queries over the whole tables, one for each operator, and the pipeline."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aisleframe.llm import archive, personal, pipeline, toxicity
from aisleframe.llm.conversations import repair
from aisleframe.llm.decontamination import contaminated
from aisleframe.llm.fingerprints import fingerprints
from aisleframe.llm.jaccard import similar_sets
from aisleframe.llm.packing import pack
from aisleframe.llm.pages import extract
from aisleframe.llm.quality import quality
from aisleframe.llm.spelling import spelling_variants
from aisleframe.llm.suffixes import remove_repeated_bytes
from aisleframe.llm.windows import remove_repeated_windows
from aisleframe.sources.stages import shared_dir


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op2_grouped_prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_sets(_table(spark, sf_dir, "documents"))


def op3_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(_table(spark, sf_dir, "documents"))


def op4_minimum_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(_table(spark, sf_dir, "pages"))


def op5_suffix_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeated_bytes(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op6_lexical_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(pack(_table(spark, sf_dir, "documents")))


def digests(pieces: DataFrame) -> DataFrame:
    """Pieces with the checksum of their ids instead of the ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
                         "sequence_id", "offset")


def op7_random_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal.find(_table(spark, sf_dir, "documents"))

    def count(kind):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def joined(column):
        return F.array_join(F.transform(column, lambda s: F.concat_ws(
            ":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")

    return found.select("doc_id", *[count(k) for k in ("email", "ip", "card", "phone")],
                        F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))


def op8_string_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs.select("doc_id", "text"), model, into="score")
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_repeated_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeated_windows(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op10_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/aisleframe/{spark.sparkContext.applicationId}/warc-{uuid.uuid4().hex}"
    archive.write_archive(_table(spark, sf_dir, "pages"), folder)
    return archive.read_index(spark, folder)


def op11_edit_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(_table(spark, sf_dir, "conversations"))


def op12_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(_table(spark, sf_dir, "documents"))


def op13_gram_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_spaced_seeds, op2_grouped_prefix_join, op3_line_frequency, op4_minimum_cut, op5_suffix_arrays,
    op6_lexical_packing, op7_random_field, op8_string_kernel,
    op9_repeated_windows, op10_archive, op11_edit_lattice, op12_order_minhash,
    op13_gram_blocks)}
QUERIES["pipeline"] = pipeline.run
