"""Keyed tables: append unseen rows, insert-if-absent, label upsert, insight store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mailprism.functions.scalars import week_label
from mailprism.operators.ranking import top_n_per


# --- keyed ingest -----------------------------------------------------------


def unseen(existing: DataFrame, batch: DataFrame, key: str, order=None) -> DataFrame:
    """Batch rows with a new key, one per key (the first in ``order`` when given).

    The stored keys are first reduced to those of the batch: a batch that is small enough is
    broadcast by Spark, and the large table is only scanned, never shuffled.
    """
    known = existing.select(key).join(batch.select(key), key, "left_semi")
    fresh = batch.join(known, key, "left_anti")
    if order is None:
        return fresh.dropDuplicates([key])
    return top_n_per(fresh, key, order, 1, "_first").drop("_first")


def append_new(existing: DataFrame, batch: DataFrame, key: str = "gmail_id", order=None) -> tuple[DataFrame, DataFrame]:
    """(rows to append, one-row report created / skipped)."""
    new = unseen(existing, batch, key, order)
    seen = batch.agg(F.count(F.lit(1)).alias("n"))
    created = new.agg(F.count(F.lit(1)).alias("created")).select("created").scalar()
    report = seen.select(created.alias("created"), (F.col("n") - created).alias("skipped"))
    return new, report


def skip_listed(batch: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """Batch rows whose key is not in a list of processed ids."""
    return batch.join(ids.select(F.trim("value").alias(key)).where(F.col(key) != ""), key, "left_anti")


def read_id_list(spark: SparkSession, path: str) -> DataFrame:
    """Processed ids, one per line."""
    return spark.read.text(path)


def insert_absent(existing: DataFrame, new: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose normalised key (trimmed, lower case) is new, and a seeded / skipped report."""
    def keyed(df):
        return df.withColumn("_key", F.lower(F.trim(F.col(key))))

    fresh = keyed(new).dropDuplicates(["_key"]).join(keyed(existing).select("_key"), "_key", "left_anti").drop("_key")
    seeded = fresh.agg(F.count(F.lit(1)).alias("n")).scalar()
    report = new.agg(F.count(F.lit(1)).alias("n")).select(seeded.alias("seeded"), (F.col("n") - seeded).alias("skipped"))
    return fresh, report


def drop_keys(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose key (any case) is not listed."""
    gone = keys.select(F.lower(F.col(key)).alias("_key")).distinct()
    return df.withColumn("_key", F.lower(F.col(key))).join(gone, "_key", "left_anti").drop("_key")


# --- label cache ------------------------------------------------------------

LABEL_COLUMNS = ["brand_name", "industry", "confidence", "classified_by"]


def merge_classifications(cache: DataFrame, new: DataFrame) -> DataFrame:
    """Label cache after an upsert: new brands are inserted, an existing row is replaced only by
    an 'ai' label when it is not 'manual'."""
    old = cache.select(F.lower("brand_name").alias("_key"), F.struct(*LABEL_COLUMNS).alias("o"))
    fresh = new.dropDuplicates(["brand_name"]).select(F.lower("brand_name").alias("_key"), F.struct(*LABEL_COLUMNS).alias("n"))
    both = old.join(fresh, "_key", "full_outer")
    replace = (F.col("n.classified_by") == "ai") & (F.col("o.classified_by") != "manual")
    kept = F.when(F.col("o").isNull(), F.col("n")).when(replace, F.struct(
        F.col("o.brand_name").alias("brand_name"), F.col("n.industry").alias("industry"),
        F.col("n.confidence").alias("confidence"), F.col("n.classified_by").alias("classified_by"))).otherwise(F.col("o"))
    return both.select(kept.alias("k")).select("k.*")


def set_manual(cache: DataFrame, new: DataFrame) -> DataFrame:
    """Manual labels (brand_name, industry) override any cached row, confidence 1."""
    manual = new.select("brand_name", "industry", F.lit(1.0).alias("confidence"), F.lit("manual").alias("classified_by"))
    return drop_keys(cache.select(*LABEL_COLUMNS), manual, "brand_name").unionByName(manual)


# --- insights ---------------------------------------------------------------


def insight_rows(df: DataFrame, kind: str, t, computed_at=None) -> DataFrame:
    """Store rows of one insight: one JSON document per result row."""
    ts = F.lit(t).cast("timestamp")
    stamp = F.lit(computed_at).cast("timestamp") if computed_at else F.current_timestamp()
    return df.select(
        F.to_json(F.struct(*df.columns)).alias("data"), stamp.alias("computed_at"),
        F.lit(kind).alias("insight_type"), week_label(ts).alias("week_label"))


def write_insight(df: DataFrame, kind: str, t, path: str, computed_at=None) -> None:
    """Replace the (insight, week) partition of the store; other partitions stay."""
    rows = insight_rows(df, kind, t, computed_at)
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("insight_type", "week_label").parquet(path)


def latest_insight(store: DataFrame, kind: str | None = None) -> DataFrame:
    """All documents of the most recently computed week of each insight."""
    rows = store if kind is None else store.where(F.col("insight_type") == kind)
    last = rows.groupBy("insight_type").agg(F.max(F.struct("computed_at", "week_label")).alias("_m"))
    last = last.select("insight_type", F.col("_m.week_label").alias("week_label"))
    return rows.join(last, ["insight_type", "week_label"], "left_semi")


def insight_summary(store: DataFrame, kinds: list[str]) -> DataFrame:
    """Every insight with its latest week and time; null when never computed."""
    last = store.groupBy("insight_type").agg(F.max(F.struct("computed_at", "week_label")).alias("_m"))
    listed = store.sparkSession.range(1).select(F.explode(F.array(*[F.lit(k) for k in kinds])).alias("insight_type"))
    return listed.join(last, "insight_type", "left").select(
        "insight_type", F.col("_m.week_label").alias("week"), F.col("_m.computed_at").alias("computed_at"))
