"""Embedding near-duplicates: collisions in windows of many sorted one-dimensional projections."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import erf, lgamma, log, log1p, exp, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailprism.llm.common import Scratch, components, spark_of

LINK = 0.93
PROJECTIONS = 64
WIDTH = 0.35  # half a window
RECALL = 0.9995  # expected share of the pairs exactly at ``LINK`` that reach the count
TILE = 4096
STEP = 64  # queries that are counted at once


def needed(link: float, projections: int, width: float, recall: float) -> int:
    """Largest number of collisions that a pair of unit vectors at cosine ``link`` reaches with probability ``recall``.

    Their distance is sqrt(2 - 2 link), and on a Gaussian direction their gap is normal with that deviation; so
    collisions are binomial. Closer pairs collide more often.
    """
    gap = sqrt(max(2 - 2 * link, 1e-12))
    p = min(erf(width / gap / sqrt(2)), 1 - 1e-12)
    below = 0.0
    for k in range(projections + 1):
        below += exp(lgamma(projections + 1) - lgamma(k + 1) - lgamma(projections - k + 1) + k * log(p) + (projections - k) * log1p(-p))
        if below > 1 - recall:
            return k
    return projections


@lru_cache(maxsize=4)
def directions(size: int, projections: int) -> np.ndarray:
    return np.random.default_rng(size * 1009 + projections).normal(size=(size, projections))


def candidates(one: np.ndarray, other: np.ndarray, width: float, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row of ``one``, row of ``other``) that collide in at least ``count`` projections (columns).

    Each projection of ``other`` is sorted; a query's window is a run of ranks there, so that a pair collides
    if the row's rank lies in the run.
    """
    order = np.argsort(other, axis=0, kind="stable")
    rank = np.empty(order.shape, np.uint16)
    low, span = (np.empty(one.shape, np.uint16) for _ in range(2))
    for k in range(one.shape[1]):
        rank[order[:, k], k] = np.arange(len(other))
        line = other[order[:, k], k]
        low[:, k] = np.searchsorted(line, one[:, k] - width, "left")
        span[:, k] = np.searchsorted(line, one[:, k] + width, "right") - low[:, k]
    if (span.max(axis=0) > 0).sum() < count:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    ranks = np.ascontiguousarray(rank.T)
    rows, columns = [], []
    for a in range(0, len(one), STEP):
        hits = np.zeros((len(one[a:a + STEP]), len(other)), np.uint8)
        for k in range(one.shape[1]):
            hits += (ranks[k][None, :] - low[a:a + STEP, k:k + 1]) < span[a:a + STEP, k:k + 1]
        i, j = np.nonzero(hits >= count)
        rows.append(i + a)
        columns.append(j)
    return np.concatenate(rows), np.concatenate(columns)


def compare_tiles(a: int, b: int, one, other, link: float, projections: int, width: float, recall: float, tile: int) -> pd.DataFrame:
    """Links between two tiles (arrays of (place, copies, embedding)): rows (a, b, links).

    ``b`` names a node of the same group as ``a`` (a forest, at most one row per node); rows without it carry the
    number of vectors that link with ``a``.
    """
    place = [np.array([r["place"] for r in x], np.int64) for x in (one, other)]
    copies = [np.array([r["copies"] for r in x], np.int64) for x in (one, other)]
    unit = [np.stack([r["embedding"] for r in x]).astype(np.float64) for x in (one, other)]
    unit = [x / np.abs(x).max(axis=1, keepdims=True) for x in unit]  # so that squares cannot overflow
    unit = [x / np.sqrt((x * x).sum(axis=1, keepdims=True)) for x in unit]
    line = directions(unit[0].shape[1], projections)
    i, j = candidates(unit[0] @ line, unit[1] @ line, width, needed(link, projections, width, recall))
    if a == b:
        i, j = i[i < j], j[i < j]
    near = [np.einsum("ij,ij->i", unit[0][i[s:s + 65536]], unit[1][j[s:s + 65536]]) >= link for s in range(0, len(i), 65536)]
    near = np.concatenate(near) if near else np.zeros(0, bool)
    i, j = i[near], j[near]
    shift = 0 if a == b else len(unit[0])
    nodes = place[0] + a * tile if a == b else np.concatenate([place[0] + a * tile, place[1] + b * tile])
    size = copies[0] if a == b else np.concatenate(copies)
    j = j + shift
    links = np.bincount(i, size[j], len(nodes)) + np.bincount(j, size[i], len(nodes))
    parent = np.arange(len(nodes))

    def root(x: np.ndarray) -> np.ndarray:
        x = parent[x]
        while not np.array_equal(parent[x], x):
            x = parent[x]
        return x

    while len(i):
        ri, rj = root(i), root(j)
        apart = ri != rj
        i, j, ri, rj = i[apart], j[apart], ri[apart], rj[apart]
        np.minimum.at(parent, np.maximum(ri, rj), np.minimum(ri, rj))
    top = root(np.arange(len(nodes)))
    child, counted = np.flatnonzero(top != np.arange(len(nodes))), np.flatnonzero(links)
    return pd.DataFrame({"a": np.concatenate([nodes[child], nodes[counted]]), "b": np.concatenate([nodes[top[child]], np.full(len(counted), -1)]),
                         "links": np.concatenate([np.zeros(len(child)), links[counted]]).astype(np.int64)})


def usable(vector: Column, label: Column) -> Column:
    finite = F.forall(vector, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)) & ~F.isnan(x))
    return F.coalesce(label.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def near_duplicates(vectors: DataFrame, link: float = LINK, projections: int = PROJECTIONS, width: float = WIDTH,
                    recall: float = RECALL, key: str = "vec_id", vector: str = "embedding", label: str = "label",
                    tile: int = TILE) -> DataFrame:
    """Link vectors of equal labels whose cosine is at least ``link`` and group what links reach.

    One row per input row: key, ``n_links`` (other rows linked directly), ``component`` (smallest key reachable,
    itself included), ``kept`` (whether that is its own). Vectors that are null, empty, zero or hold null or
    non-finite components, and rows without a label, link with nothing; so do vectors of different sizes. Repeated
    rows and equal vectors link with each other; they are one vector while pairs are sought, so a large group of
    copies costs nothing. An empty table gives no rows; other columns are not looked at.

    A label's vectors are dealt to tiles of ``tile``; every pair of tiles of a label is one unit of work, whose
    result (a forest and counts) is no larger than the tiles. A link is found with probability ``recall`` or more.
    """
    scratch = Scratch(spark_of(vectors), "embeddings")
    rows = vectors.select(F.col(key).alias("key"), F.col(vector).alias("embedding"), F.col(label).alias("label"))
    good = rows.where(usable(F.col("embedding"), F.col("label")))
    distinct = scratch.save(good.groupBy("label", "embedding").agg(F.min("key").alias("least"), F.count(F.lit(1)).alias("copies"))
                            .withColumn("size", F.size("embedding")))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, number, count = None, (TaskContext.get().partitionId() << 24) - 1, 0
        for batch in batches:
            tiles, places = [], []
            for group in zip(batch.column("label").to_pylist(), batch.column("size").to_pylist()):
                if group != last or count == tile:
                    last, number, count = group, number + 1, 0
                tiles.append(number)
                places.append(count)
                count += 1
            yield batch.append_column("tile", pa.array(tiles, pa.int64())).append_column("place", pa.array(places, pa.int64()))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in distinct.schema) + ", tile long, place long"
    spread = distinct.repartitionByRange(max(1, -(-distinct.count() // tile)), "label", "size", F.xxhash64("embedding"))
    nodes = scratch.save(spread.sortWithinPartitions("label", "size").mapInArrow(place, schema))
    tiles = scratch.save(nodes.groupBy("tile").agg(F.first("label").alias("label"), F.first("size").alias("size"),
                                                   F.collect_list(F.struct("place", "copies", "embedding")).alias("rows")))
    ids = tiles.select("label", "size", "tile")
    pairs = scratch.save(ids.withColumnRenamed("tile", "a").join(ids.withColumnRenamed("tile", "b"), ["label", "size"]).where("a <= b").select("a", "b"))
    many = pairs.count()
    one, other = (tiles.select(F.col("tile").alias(c), F.col("rows").alias(f"rows_{c}")) for c in "ab")
    tasks = max(1, min(many, 4 * spark_of(vectors).sparkContext.defaultParallelism), -(-many // 16))

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for a, b, x, y in zip(batch["a"], batch["b"], batch["rows_a"], batch["rows_b"]):
                yield compare_tiles(a, b, x, y, link, projections, width, recall, tile)

    work = pairs.join(one, "a").join(other, "b").repartition(tasks, "a", "b")
    found = scratch.save(work.mapInPandas(compare, "a long, b long, links long"))
    roots = components(found.where("b >= 0").select("a", "b"), scratch)
    counted = found.where("b < 0").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    named = nodes.select((F.col("tile") * tile + F.col("place")).alias("node"), "label", "embedding", "least", "copies")
    named = scratch.save(named.join(counted, "node", "left").join(roots, "node", "left").select(
        "label", "embedding", "least", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "node").alias("root")))
    groups = named.groupBy("root").agg(F.min("least").alias("component"))
    answers = named.join(groups, "root").select("label", "embedding", "n_links", "component")
    linked = good.join(answers, ["label", "embedding"]).select("key", "n_links", "component")
    alone = rows.where(~usable(F.col("embedding"), F.col("label"))).select("key", F.lit(0).cast("long").alias("n_links"), F.col("key").alias("component"))
    every = linked.unionByName(alone).withColumn("kept", F.col("key").eqNullSafe(F.col("component")))
    return every.withColumnRenamed("key", key)
