"""A training corpus from raw documents: five operators in a row, each over all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailprism.llm import decontamination, packing, secrets, simhash, toxicity
from mailprism.llm.common import Scratch, remainder

SHINGLE = 5  # words
LANES, RADIUS = 4, 64  # bits of 256 that proposed pairs may differ in: shingle sets that are 0.8 alike differ in 39 on average
ORACLE_SQL = None  # trained stages cannot be said in SQL; tests compare them with plain loops


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject; it learns from four fifths of the labelled ones."""
    return toxicity.clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), remainder("doc_id", 5) != 0)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: their sets of shingles are 0.8 alike."""
    return simhash.one_of_each(docs, SHINGLE, RADIUS, LANES)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark."""
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in place of each secret; ``n_chars`` follows the text."""
    cleaned = secrets.redact(docs, secrets.findings(docs, path="source"))
    return cleaned.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences: pieces with their ids, checksum and place."""
    pieces = packing.token_pieces(docs).withColumn("ids_crc32", F.crc32("ids"))
    return packing.assign(pieces, docs.count())


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark),
    ("secrets", hide_secrets),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; between two stages the rows are written to the shared folder and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
