"""A Parquet table that takes each key once: keys in hash-bucket folders, with a Bloom filter per bucket and append.

Below ``path``: the rows by month and run, and two hidden folders, ``_keys`` (bucket, run: the keys) and ``_filters`` (bucket, run: the
words of the filter). An append knows its buckets from its keys, opens the filters of these buckets, and opens the keys
of those buckets only where a filter says that a key may be there. The rows of the archive are never read.

A run is one append. It ignores and overwrites what an earlier try of the same run has left, so a retried micro-batch
neither doubles nor loses rows. ``compact`` joins the keys of all runs when there are many.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mailprism.operators.ranking import top_n_per
from mailprism.sources import files

BUCKETS = 32
BITS = 10  # of a filter per key
PROBES = 5
RUNS = 32  # of keys before they are joined


def bucket_of(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit(-1)), F.lit(buckets)).cast("int")


def probe(key: str, words: Column, n: int) -> Column:
    """Bit that the ``n``-th hash of a key takes in a filter of ``words`` longs."""
    return F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit(n)), words.cast("long") * 64)


def filters_of(keys: DataFrame) -> DataFrame:
    """bucket, words: a Bloom filter over the keys (bucket, key) of each bucket."""
    sizes = keys.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) * BITS / 64).cast("int").alias("words"))
    bits = keys.join(sizes, "bucket").select("bucket", F.explode(F.array(*[probe("key", F.col("words"), n) for n in range(PROBES)])).alias("bit"))
    one = F.lit(1).cast("long")
    taken = bits.select("bucket", F.floor(F.col("bit") / 64).alias("at"), F.expr("shiftleft(1L, CAST(bit % 64 AS INT))").alias("word"))
    blank = sizes.select("bucket", F.explode(F.sequence(F.lit(0).cast("long"), F.col("words").cast("long") - one)).alias("at"), F.lit(0).cast("long").alias("word"))
    words = taken.unionByName(blank).groupBy("bucket", "at").agg(F.bit_or("word").alias("word"))
    ordered = F.sort_array(F.collect_list(F.struct("at", "word")))
    return words.groupBy("bucket").agg(F.transform(ordered, lambda x: x["word"]).alias("words"))


def may_hold(key: str, words: str = "words") -> Column:
    """Whether a filter may have seen the key; never false for one that it has."""
    size = F.size(words)
    hit = F.lit(True)
    for n in range(PROBES):
        bit = probe(key, size, n)
        word = F.get(F.col(words), F.floor(bit / 64).cast("int"))
        hit = hit & (F.getbit(word, (bit % 64).cast("int")) == 1)
    return hit


def replace_partitions(rows: DataFrame, path: str, *by: str) -> None:
    """Write partitions; those that ``rows`` has none of stay as they are."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


class KeyedTable:
    """``path`` as a table that takes each ``key`` once. ``buckets`` holds for a new table; an old one keeps its own."""

    def __init__(self, spark: SparkSession, path: str, key: str = "gmail_id", buckets: int = BUCKETS):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key
        known = [int(n.split("-")[1]) for n in files.names(spark, self.path) if n.startswith("_buckets-")]
        self.buckets = known[0] if known else buckets
        if not known:
            files.make(spark, f"{self.path}/_buckets-{buckets}")
        self.keys_path, self.filters_path = f"{self.path}/_keys", f"{self.path}/_filters"

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(self.path).drop("run")

    def _kept(self, path: str, schema: str, buckets: list[int], run: str) -> DataFrame | None:
        """What other runs have in some buckets: only the folders of these are opened."""
        have = set(files.names(self.spark, path))
        parts = [f"{path}/bucket={b}" for b in buckets if f"bucket={b}" in have]
        if not parts:
            return None
        rows = self.spark.read.schema(f"{schema}, bucket int, run string").option("basePath", path).parquet(*parts)
        return rows.where(F.col("run") != run)

    def fresh(self, batch: DataFrame, order=None, run: str = "") -> DataFrame:
        """Rows of ``batch`` with a key that the table doesn't have, one per key (the first in ``order`` if given). A null key is none."""
        rows = batch.where(F.col(self.key).isNotNull())
        rows = rows.dropDuplicates([self.key]) if order is None else top_n_per(rows, self.key, order, 1, "_first").drop("_first")
        keys = rows.select(self.key).select(F.col(self.key).alias("key"), bucket_of(self.key, self.buckets).alias("bucket"))
        touched = [r[0] for r in keys.select("bucket").distinct().collect()]  # at most one number per bucket
        filters = self._kept(self.filters_path, "words array<bigint>", touched, run)
        if filters is None:
            return rows
        suspects = keys.join(filters.select("bucket", "words"), "bucket").where(may_hold("key")).select("key", "bucket").distinct()
        opened = [r[0] for r in suspects.select("bucket").distinct().collect()]
        kept = self._kept(self.keys_path, "key string", opened, run)
        if kept is None:
            return rows
        known = kept.select("bucket", "key").join(suspects.select(F.col("bucket").alias("b"), F.col("key").cast("string").alias("k")), (F.col("bucket") == F.col("b")) & (F.col("key") == F.col("k")), "left_semi")
        return rows.join(known.select(F.col("key").alias("_known")), F.col(self.key).cast("string") == F.col("_known"), "left_anti")

    def append(self, batch: DataFrame, month: Column | None = None, order=None, run: str | None = None, checked: bool = False) -> DataFrame:
        """Append the new rows of ``batch`` and return them. ``run`` names the append, so that the same one can be tried again;
        ``checked``: the rows come from ``fresh`` already."""
        run = run or os.urandom(8).hex()
        month = month if month is not None else F.date_format("received_at", "yyyy-MM")
        rows = (batch if checked else self.fresh(batch, order, run)).withColumns({"month": month, "run": F.lit(run)})
        replace_partitions(rows, self.path, "month", "run")
        mine = self._of_run(run, rows)
        if mine is None:
            return rows.limit(0).drop("run")
        keys = mine.select(F.col(self.key).cast("string").alias("key"), bucket_of(self.key, self.buckets).alias("bucket"), "run")
        self._write_keys(keys, run)
        if len(self.runs()) > RUNS:
            self.compact()
        return mine.drop("run")

    def _of_run(self, run: str, like: DataFrame) -> DataFrame | None:
        """The rows of one run: only its folders are listed, one per month."""
        months = [n for n in files.names(self.spark, self.path) if n.startswith("month=")]
        parts = [p for m in months if files.exists(self.spark, p := f"{self.path}/{m}/run={run}")]
        return self.spark.read.schema(like.schema).option("basePath", self.path).parquet(*parts) if parts else None

    def _write_keys(self, keys: DataFrame, run: str) -> None:
        # filters first: a key without its filter would be missed, a filter without its keys only costs a look
        found = filters_of(keys.select("bucket", "key")).withColumn("run", F.lit(run))
        replace_partitions(found.repartition("bucket"), self.filters_path, "bucket", "run")
        replace_partitions(keys.select("key", "bucket", "run").repartition("bucket"), self.keys_path, "bucket", "run")

    def runs(self) -> set[str]:
        return {r for b in files.names(self.spark, self.keys_path) if b.startswith("bucket=") for r in files.names(self.spark, f"{self.keys_path}/{b}")}

    def compact(self) -> None:
        """Join the keys of all runs. The new run is written before the old ones are removed: a key that stands in both does no harm."""
        old = self.runs()
        name = f"joined-{os.urandom(6).hex()}"
        keys = self.spark.read.schema("key string, bucket int, run string").parquet(self.keys_path).select("key", "bucket").distinct()
        self._write_keys(keys.withColumn("run", F.lit(name)), name)
        for path in (self.keys_path, self.filters_path):
            for bucket in files.names(self.spark, path):
                for run in old & set(files.names(self.spark, f"{path}/{bucket}")) if bucket.startswith("bucket=") else ():
                    files.remove(self.spark, f"{path}/{bucket}/{run}")
