"""Corpus pipeline: toxicity, near duplicates, benchmark passages, personal data, packing.

Each stage takes what its predecessor kept, and its decisions take effect; all but the last return the
columns of `documents`. Stages are written as Parquet to the shared folder and read back. A row without an id
cannot be named as a copy or as contaminated, so that it stays unless it is toxic; null texts count as empty.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aisleframe.llm import personal, toxicity
from aisleframe.llm.decontamination import contaminated
from aisleframe.llm.jaccard import similar_sets
from aisleframe.llm.packing import pack
from aisleframe.sources.stages import stage_table


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """Documents whose id is not listed. The list is written first, so that its size is known to the join."""
    return docs.join(stage_table(gone.select("doc_id").distinct(), "removed"), "doc_id", "left_anti").select(*docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.5; trained on the labelled documents among them."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = f"score-{uuid.uuid4().hex}"
    return toxicity.score(docs, model, into=score).where(F.col(score) < 0.5).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each component of near duplicates."""
    return _without(docs, similar_sets(docs).where("component_id <> doc_id"))


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return _without(docs, contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind and n_chars that of the new text."""
    return personal.mask(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 1024 ids."""
    pieces = pack(docs)
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark_passages),
    ("personal_data", mask_personal_data),
    ("packing", pack_sequences),
]

#: Trained scores and the field's labels have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stage_table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
