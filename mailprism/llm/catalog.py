"""The operators as named queries over the given tables, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailprism.llm import decontamination, embeddings, language, neighbours, oracles, packing, ppm, quality, repair, secrets, simhash, spelling, tokencount, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable) -> Callable:
    """Register ``fn(spark, sf_dir)`` by its name."""
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_digest(table(spark, sf_dir, "documents"))


@query
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.query(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(table(spark, sf_dir, "documents"))


@query
def op4_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.query(table(spark, sf_dir, "documents"))


@query
def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_id")


ORACLES["op5_decontamination"] = decontamination.ORACLE


@query
def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), F.col("component").alias("component_id"))


@query
def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.query(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op8_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings")).withColumnRenamed("component", "component_id")


@query
def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.findings(table(spark, sf_dir, "documents"), path="source").drop("text_id")


@query
def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.query(table(spark, sf_dir, "documents"))


@query
def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.query(table(spark, sf_dir, "documents"))


ORACLES["op11_spelling"] = oracles.SPELLING


@query
def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.query(table(spark, sf_dir, "conversations"))


ORACLES["op12_repair"] = oracles.REPAIR


@query
def op13_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.query(table(spark, sf_dir, "embeddings"))


ORACLES["op13_neighbours"] = oracles.NEIGHBOURS
