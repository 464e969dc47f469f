"""Helpers shared by the operators: splits, scratch tables, text batches, connected components."""

from __future__ import annotations

import ctypes
import os
import sys
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mailprism.session import checkpoint_dir

BATCH_BYTES = 4 << 20  # text that one step of a task holds as numpy arrays


def spark_of(df: DataFrame) -> SparkSession:
    return df.sparkSession


def remainder(key: str | Column, parts: int) -> Column:
    """crc32 of the key as text, modulo ``parts`` (a null key counts as the empty text)."""
    key = F.col(key) if isinstance(key, str) else key
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % parts


class Scratch:
    """Tables of one operator run in the folder that ``spark.checkpoint.dir`` names (shared by all machines)."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.folder = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{os.urandom(6).hex()}"
        self.count = 0

    def save(self, df: DataFrame, *by: str, codec: str | None = None) -> DataFrame:
        """Write ``df`` as Parquet and read it back: cuts the lineage and survives lost executors.

        ``codec``: another compression than the session's. Zstandard keeps native memory per column and task, so it
        is for long tables of few columns.
        """
        self.count += 1
        path = f"{self.folder}/{self.count}"
        df.write.parquet(path, partitionBy=list(by) or None, compression=codec)
        saved = self.spark.read.schema(df.schema).parquet(path)
        saved.scratch_path = path
        return saved

    def drop(self, *saved: DataFrame) -> None:
        """Delete tables that nothing will read again."""
        jvm = self.spark._jvm
        for df in saved:
            path = jvm.org.apache.hadoop.fs.Path(df.scratch_path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def fresh(name: str, df: DataFrame) -> str:
    """A column name that ``df`` does not use yet."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def give_back() -> None:
    """Return freed memory to the system: a worker that lives on would keep it beside the next task's."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux" and hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def pieces(sizes, limit: int = BATCH_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose sizes add up to about ``limit`` (one large row stands alone)."""
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Connected components of ``edges`` (a, b): one row (node, root) per node that has an edge.

    Each round hooks every node to the neighbour of least hash and contracts the graph, so that the
    number of nodes shrinks by a constant factor whatever the shape (chains, stars, cliques). Loops,
    repeated edges and null ends do not matter. Nothing is collected: only emptiness is asked for.
    """
    pair = lambda a, b: (F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    left = scratch.save(edges.where("a <> b").select(*pair(F.col("a"), F.col("b"))).distinct())
    nodes = left
    hooks = []
    step = 0
    while True:
        order = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(step)).alias("h"), F.col(c).alias("v"))  # noqa: B023, E731
        ends = left.select(F.col("a").alias("node"), order("b").alias("o"), order("a").alias("own")).unionByName(
            left.select(F.col("b").alias("node"), order("a").alias("o"), order("b").alias("own")))
        hook = scratch.save(ends.groupBy("node").agg(F.min(F.least("o", "own")).alias("m")).select("node", F.col("m.v").alias("root")))
        hooks.append(hook)
        ra, rb = (hook.select(F.col("node").alias(c), F.col("root").alias(f"r{c}")) for c in "ab")
        after = left.join(ra, "a").join(rb, "b").where("ra <> rb").select(*pair(F.col("ra"), F.col("rb"))).distinct()
        after = scratch.save(after)
        if left is not nodes:
            scratch.drop(left)
        left, step = after, step + 1
        if left.isEmpty():
            break

    def follow(later: DataFrame, earlier: DataFrame) -> DataFrame:
        step_on = later.select(F.col("node").alias("root"), F.col("root").alias("final"))
        return earlier.join(step_on, "root", "left").select("node", F.coalesce("final", "root").alias("root"))

    return reduce(follow, reversed(hooks))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """At most ``rows`` labelled documents (text, label 0/1) in a fixed pseudo-random order.

    Repeated label rows of a key are averaged (a half counts as 1); null labels are left out. Keys are drawn
    before texts are touched; keys that repeat in ``docs`` cannot take the sample beyond ``rows``.
    """
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("k"))
    known = known.agg((F.avg(label) >= 0.5).cast("int").alias("label"))
    drawn = known.orderBy(F.xxhash64("k"), "k").limit(rows)
    texts = docs.select(F.col(key).alias("k"), F.col(text).alias("text")).join(drawn, "k")
    return texts.select("text", "label", F.xxhash64("k", "text").alias("h")).orderBy("h", "text").limit(rows).drop("h")


def fit_in_task(sample: DataFrame, fit, schema: str):
    """Run ``fit(pandas frame)`` -> dict of one row over a bounded sample in one task; the row.

    Spark leaves out tasks over tables that it knows to be empty; an empty frame is fitted here.
    """
    import pandas as pd

    def run(batches):
        parts = list(batches)
        whole = pd.concat(parts, ignore_index=True) if parts else pd.DataFrame({c: [] for c in names})
        yield pd.DataFrame([fit(whole)])

    names = sample.columns
    return sample.repartition(1).mapInPandas(run, schema).first() or fit(pd.DataFrame({c: [] for c in names}))
