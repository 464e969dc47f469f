"""Structured Streaming forms of ingest, counters, weekly metrics and activity windows."""

from __future__ import annotations

import hashlib
import os
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailprism.functions.subjects import has_emoji, is_discount, subject_formula
from mailprism.operators.accounts import USAGE_EVENTS
from mailprism.plans import registry
from mailprism.sources import files, mail
from mailprism.sources.keyed import KeyedTable

REACH = 4  # weeks that an insight looks back
MONDAY_OFFSET = "4 days"  # 1970-01-01 was a Thursday: weeks that start on Monday


def read_table_stream(spark: SparkSession, sf_dir: str, name: str, files_per_trigger: int | None = None) -> DataFrame:
    """A Parquet table as a file stream; naive timestamps become instants."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", f"{name}*.parquet")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    out = reader.parquet(sf_dir)
    naive = [f.name for f in schema.fields if f.dataType.simpleString() == "timestamp_ntz"]
    return out.withColumns({c: F.col(c).cast("timestamp") for c in naive})


# --- running and reading back -----------------------------------------------


def run_available(stream: DataFrame, path: str, mode: str = "update", checkpoint: str | None = None) -> None:
    """Process everything that is available; each micro-batch replaces its own folder below ``path``.

    A batch that is retried after a failure overwrites the same folder, so no row is doubled. In complete mode a
    batch is the whole result: once it is written, the folders of the batches before it are removed.
    """
    def write(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{path}/data/batch={batch_id}")
        if mode == "complete":
            files.keep_only(batch.sparkSession, f"{path}/data", f"batch={batch_id}")

    query = (
        stream.writeStream.outputMode(mode).foreachBatch(write)
        .option("checkpointLocation", checkpoint or f"{path}/checkpoint").trigger(availableNow=True).start())
    query.awaitTermination()


def whole_result(spark: SparkSession, path: str) -> DataFrame:
    """Result of a complete-mode stream after its last batch."""
    return spark.read.option("basePath", f"{path}/data").parquet(f"{path}/data").drop("batch")


def newest_state(spark: SparkSession, path: str, keys) -> DataFrame:
    """Latest emitted row of every key of an update-mode stream."""
    rows = spark.read.option("basePath", f"{path}/data").parquet(f"{path}/data")
    values = [c for c in rows.columns if c not in keys and c != "batch"]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("_v"))
    return last.select(*keys, "_v.*")


def run_current(stream: DataFrame, path: str, keys: list[str], period: str) -> None:
    """Process everything that is available of an update-mode stream and keep one version of every period (a day, a week).

    A micro-batch opens the periods of its own rows, puts its rows in place of those with the same ``keys`` and writes a new
    version of these periods; then the old ones are removed. A batch that is retried finds one or both versions and
    comes to the same rows. Closed periods are never opened again.
    """
    def write(batch, batch_id):
        spark = batch.sparkSession
        version = f"{batch_id:012d}-{os.urandom(4).hex()}"
        batch = batch.withColumn("period", F.date_format(period, "yyyy-MM-dd"))
        touched = [f"period={r[0]}" for r in batch.select("period").distinct().collect()]
        old = {t: files.names(spark, f"{path}/data/{t}") for t in touched}
        folders = [f"{path}/data/{t}" for t in touched if old[t]]
        rows = batch.withColumn("version", F.lit(version))
        if folders:
            before = spark.read.schema(rows.schema).option("basePath", f"{path}/data").parquet(*folders)
            rows = rows.unionByName(before)
        values = [c for c in rows.columns if c not in keys]
        newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "version").alias("v")).select(*keys, "v.*").withColumn("version", F.lit(version))
        newest.write.mode("append").partitionBy("period", "version").parquet(f"{path}/data")
        for t in touched:
            for name in old[t]:
                files.remove(spark, f"{path}/data/{t}/{name}")

    query = (
        stream.writeStream.outputMode("update").foreachBatch(write)
        .option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start())
    query.awaitTermination()


def current_state(spark: SparkSession, path: str) -> DataFrame:
    """The rows that ``run_current`` keeps. Where a batch was lost before it removed an old version, the newest one counts."""
    data = f"{path}/data"
    newest = [f"{data}/{p}/{max(v)}" for p in files.names(spark, data) if p.startswith("period=") and (v := [n for n in files.names(spark, f"{data}/{p}") if n.startswith("version=")])]
    return spark.read.option("basePath", data).parquet(*newest).drop("period", "version")


def refresh_insights(spark: SparkSession, source: str, schema, path: str, checkpoint: str, names=None, files_per_trigger: int = 64) -> None:
    """Recompute the stored insights of the weeks that new files of the mail table ``source`` touch, up to the newest week.

    The file stream's offsets know which files are new. A mail counts in its week and in those that look back on it
    (``REACH``); only these (insight, week) partitions of the store at ``path`` are replaced, each from its own months. Without new
    files there is no micro-batch and nothing is written.
    """
    def refresh(batch, batch_id):
        session = batch.sparkSession
        found = [r[0] for r in batch.where("received_at IS NOT NULL").select(F.date_trunc("week", "received_at")).distinct().collect()]
        mails = session.read.schema(schema).parquet(source)
        last = mails.agg(F.max(F.date_trunc("week", "received_at"))).first()[0]
        weeks = sorted({w + timedelta(weeks=k) for w in found for k in range(REACH + 1)})
        for week in weeks:
            if week <= last:
                end = str(week + timedelta(days=7, seconds=-1))
                for name in names or registry.INSIGHTS:
                    registry.compute_and_store(name, mails, end, path, end)

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(source)
    stream.writeStream.foreachBatch(refresh).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


# --- streams ----------------------------------------------------------------


def dedup_stream(stream: DataFrame, key: str = "gmail_id", ts: str = "received_at", delay: str = "2 days") -> DataFrame:
    """One row per key within the watermark delay (older repeats are caught by the keyed append)."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def weekly_metrics_stream(stream: DataFrame, delay: str = "14 days") -> DataFrame:
    """Per Monday week and formula: mails, subject characters, discounts, emoji, weekend mails."""
    rows = stream.where(F.col("subject").isNotNull()).withWatermark("received_at", delay)
    week = F.window("received_at", "7 days", "7 days", MONDAY_OFFSET)
    out = rows.groupBy(week, subject_formula("subject").alias("formula")).agg(
        F.count(F.lit(1)).alias("emails"), F.sum(F.length("subject")).alias("chars"),
        F.count_if(is_discount("subject")).alias("discounts"), F.count_if(has_emoji("subject", "insights")).alias("emoji"),
        F.count_if(F.weekday("received_at") >= 5).alias("weekend"))
    return out.withColumn("week_start", F.col("window.start")).drop("window")


def usage_stream(events: DataFrame, delay: str = "2 days", kind: str = "event_type", ts: str = "ts") -> DataFrame:
    """Daily usage counters per user."""
    rows = events.withWatermark(ts, delay)
    out = rows.groupBy("user_id", F.window(ts, "1 day")).agg(
        *[F.count_if(F.col(kind) == k).alias(name) for k, name in USAGE_EVENTS.items()])
    return out.withColumn("usage_date", F.to_date("window.start")).drop("window")


def activity_windows(stream: DataFrame, kind: str = "sliding", delay: str = "7 days") -> DataFrame:
    """Mails per brand in sliding weeks or 48-hour sessions (views beside the anchored sequences)."""
    rows = stream.where(F.col("brand").isNotNull()).withWatermark("received_at", delay)
    if kind == "sliding":
        window = F.window("received_at", "7 days", "1 day")
    elif kind == "session":
        window = F.session_window("received_at", "48 hours")
    else:
        raise ValueError("kind is 'sliding' or 'session'")
    out = rows.groupBy("brand", window.alias("w")).agg(F.count(F.lit(1)).alias("emails"))
    return out.select("brand", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "emails")


def start_ingest(spark: SparkSession, source: str, target: str, checkpoint: str, t, rules=None, files_per_trigger: int = 16,
                 available_now: bool = True):
    """Message files → e-mail table, batch by batch, appending unseen ids only (see ``KeyedTable``).

    A batch is one run of the table, named by the checkpoint and its number, so a retried one replaces what it left.
    """
    name = hashlib.md5(checkpoint.encode()).hexdigest()[:12]
    messages = (
        spark.readStream.schema(mail.message_schema()).option("maxFilesPerTrigger", files_per_trigger).json(source))

    def append(batch, batch_id):
        run = f"{name}-{batch_id}"
        table = KeyedTable(batch.sparkSession, target, "gmail_id")
        new = table.fresh(batch.withColumn("gmail_id", F.col("id")), run=run).drop("gmail_id")  # known mails are not parsed again
        rows = mail.ingest(mail.with_headers(new), t, rules, staging=f"{checkpoint}-staging/batch={batch_id}")
        table.append(rows, run=run, checked=True)
        files.keep_only(batch.sparkSession, f"{checkpoint}-staging", "")

    writer = messages.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()
