"""The keyed table: each key once, few buckets opened, retried and joined runs."""

import re

import pytest
from pyspark.sql import functions as F

from mailprism.sources import files, keyed
from mailprism.sources.keyed import KeyedTable


def rows_of(spark, low, high, kind="string"):
    return spark.range(low, high).select(F.col("id").cast(kind).alias("gmail_id"), F.timestamp_seconds(F.col("id") * 86_400 * 9).alias("received_at"), "id")


def ids(df):
    return sorted(r["id"] for r in df.select("id").collect())


@pytest.mark.parametrize("kind", ["string", "long"])
def test_each_key_once(spark, tmp_path, kind):
    for low, high in [(0, 40), (20, 60), (20, 60), (60, 61)]:
        table = KeyedTable(spark, str(tmp_path / "t"), buckets=4)
        batch = rows_of(spark, low, high, kind)
        table.append(batch.unionByName(batch).unionByName(batch.limit(1).withColumn("gmail_id", F.lit(None).cast(kind))))
    assert ids(table.rows()) == list(range(61))
    assert ids(spark.read.parquet(str(tmp_path / "t"))) == list(range(61))  # hidden folders stay hidden
    assert ids(table.append(rows_of(spark, 0, 0, kind))) == []


def test_first_in_order_and_other_buckets_number(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), buckets=4)
    batch = rows_of(spark, 0, 10).withColumn("n", F.explode(F.array(F.lit(3), F.lit(1), F.lit(2))))
    assert {r["n"] for r in table.append(batch, order=["n"]).collect()} == {1}
    assert KeyedTable(spark, str(tmp_path / "t"), buckets=99).buckets == 4


def opened(df):
    return set(re.findall(r"bucket=(\d+)", " ".join(df.inputFiles())))


def test_a_batch_opens_its_buckets_only(spark, tmp_path, monkeypatch):
    table = KeyedTable(spark, str(tmp_path / "t"), buckets=16)
    table.append(rows_of(spark, 0, 2000))
    read = {}
    kept = KeyedTable._kept
    monkeypatch.setattr(KeyedTable, "_kept", lambda self, path, schema, buckets, run: read.setdefault(path, kept(self, path, schema, buckets, run)))
    few = rows_of(spark, 1999, 2001)
    want = {str(r[0]) for r in few.select(keyed.bucket_of("gmail_id", 16)).collect()}
    assert ids(table.fresh(few)) == [2000]
    assert opened(read[table.filters_path]) == want
    assert opened(read[table.keys_path]) <= want and str(rows_of(spark, 1999, 2000).select(keyed.bucket_of("gmail_id", 16)).first()[0]) in opened(read[table.keys_path])
    read.clear()
    unknown = rows_of(spark, 5000, 5003)
    assert ids(table.fresh(unknown)) == [5000, 5001, 5002]
    assert str(tmp_path / "t" / "month") not in " ".join(f for df in read.values() if df is not None for f in df.inputFiles())  # no rows of the archive


def test_filters_have_no_false_negatives_and_few_hits(spark):
    keys = spark.range(3000).select(F.col("id").cast("string").alias("key"), (F.col("id") % 3).cast("int").alias("bucket"))
    filters = keyed.filters_of(keys)
    met = keys.join(filters, "bucket")
    assert met.where(~keyed.may_hold("key")).count() == 0
    others = spark.range(10_000, 13_000).select(F.col("id").cast("string").alias("key"), (F.col("id") % 3).cast("int").alias("bucket"))
    assert others.join(filters, "bucket").where(keyed.may_hold("key")).count() < 90


def test_a_retried_run_replaces_what_it_left(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), buckets=4)
    table.append(rows_of(spark, 0, 10), run="a")
    table.append(rows_of(spark, 5, 15), run="b")
    table.append(rows_of(spark, 5, 15), run="b")
    assert ids(table.rows()) == list(range(15))
    for bucket in files.names(spark, table.keys_path):  # rows were written, then the job was lost before its keys
        if bucket.startswith("bucket="):
            files.remove(spark, f"{table.keys_path}/{bucket}/run=b")
            files.remove(spark, f"{table.filters_path}/{bucket}/run=b")
    table.append(rows_of(spark, 5, 15), run="b")
    assert ids(table.rows()) == list(range(15)) and ids(table.fresh(rows_of(spark, 0, 20))) == list(range(15, 20))


def test_joined_runs(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(keyed, "RUNS", 3)
    table = KeyedTable(spark, str(tmp_path / "t"), buckets=2)
    for k in range(5):
        table.append(rows_of(spark, 10 * k, 10 * k + 15))
    assert len(table.runs()) <= 3 and any(r.startswith("run=joined-") for r in table.runs())
    assert ids(table.rows()) == list(range(55)) and ids(table.fresh(rows_of(spark, 0, 60))) == list(range(55, 60))
