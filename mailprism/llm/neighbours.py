"""Nearest neighbours by cosine: vantage-point trees per shard, pruned by a relaxed triangle inequality.

On unit vectors the largest cosine is the smallest straight distance, which is a metric. A node of a tree holds a vantage
point and two halves of its rows, the nearer and the farther ones, with their least and greatest distance from it. A query
at distance d from the vantage point skips a half when ``factor`` times the gap between d and the half's distances
exceeds the distance of its k-th neighbour so far. Factor 1 is the triangle inequality itself, so nothing is lost;
larger ones skip more and may miss neighbours.

Shards: a tree over a bounded sample splits the space into regions; every row goes to its region, and a region that
holds more rows than a shard may is dealt into several by hash. Each query first searches one shard of its own region, then, with the
distance found there, those of all regions that the same rule does not skip.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailprism.llm.common import Scratch, give_back

K = 5
FACTOR = 1.0
SAMPLE = 8192  # rows that the regions are fitted on, at most
REGION_SAMPLE = 16  # of these rows, at least so many in a region
SHARD = 8192  # rows of a shard, about
BLOCK = 1 << 16  # queries of a shard's task, about
LEAF = 128
STEP = 2048  # queries that are searched at once
SLACK = 1e-6  # added to distances before a half is skipped, against rounding
TIE = 1e-9  # scores of matrix products closer than this are taken anew


def unit(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows scaled by powers of two, which changes no cosine but keeps squares in range, and these over their lengths."""
    scaled = np.ldexp(rows, -np.frexp(np.abs(rows).max(axis=1))[1][:, None])
    return scaled, scaled / np.sqrt((scaled * scaled).sum(axis=1))[:, None]


def cosine(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Row by row, each in one order of sums, so that equal vectors have equal scores."""
    return (x * y).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((y * y).sum(axis=1)))


def distance(product: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * product, 0))


class Tree:
    """A vantage-point tree over unit vectors. ``nodes``: vantage vector, (least, greatest) distance of the near and the far
    half, and the two halves: numbers of nodes, or ``~number`` of a leaf. ``leaves``: rows of each leaf."""

    def __init__(self, units: np.ndarray, leaf: int):
        self.nodes, self.leaves = [], []
        self.root = self.grow(units, np.arange(len(units)), leaf)

    def grow(self, units: np.ndarray, rows: np.ndarray, leaf: int) -> int:
        if len(rows) <= leaf:
            self.leaves.append(np.sort(rows))
            return ~(len(self.leaves) - 1)
        far = units[rows] @ units[rows[0]]
        vantage = units[rows[far.argmin()]].copy()  # an outlying point: distances from it differ most
        away = distance(units[rows] @ vantage)
        half = len(rows) // 2
        order = np.argpartition(away, half)
        parts = order[:half], order[half:]
        at = len(self.nodes)
        self.nodes.append(None)
        bounds = [(away[p].min(), away[p].max()) for p in parts]
        self.nodes[at] = (vantage, bounds, [self.grow(units, rows[p], leaf) for p in parts])
        return at

    def home(self, queries: np.ndarray) -> np.ndarray:
        """The leaf whose halves are nearest, per query."""
        found = np.zeros(len(queries), np.int64)
        stack = [(self.root, np.arange(len(queries)))]
        while stack:
            node, rows = stack.pop()
            if node < 0:
                found[rows] = ~node
            elif len(rows):
                vantage, bounds, halves = self.nodes[node]
                away = distance(queries[rows] @ vantage)
                near = away * 2 <= bounds[0][1] + bounds[1][0]
                stack += [(halves[0], rows[near]), (halves[1], rows[~near])]
        return found

    def reached(self, queries: np.ndarray, limit, factor: float) -> Iterator[tuple[int, np.ndarray]]:
        """Leaves and the queries that do not skip them. ``limit(rows)``: distance of the k-th neighbour so far."""
        stack = [(self.root, np.arange(len(queries)))]
        while stack:
            node, rows = stack.pop()
            if not len(rows):
                continue
            if node < 0:
                yield ~node, rows
                continue
            vantage, bounds, halves = self.nodes[node]
            away, far = distance(queries[rows] @ vantage), limit(rows) + SLACK
            for (low, high), half in zip(bounds, halves):
                stack.append((half, rows[factor * np.maximum(low - away, away - high) <= far]))


class Best:
    """The k best rows of each query so far: largest score, then smallest id (null last), never the query's own id."""

    def __init__(self, ids: np.ndarray, has: np.ndarray, floor: np.ndarray, k: int):
        self.ids, self.has, self.k, n = ids, has, k, len(ids)
        self.score, self.kth = np.full((n, k), -np.inf), floor.copy()
        self.id, self.some, self.used = np.zeros((n, k), np.int64), np.zeros((n, k), bool), np.zeros((n, k), bool)

    def limit(self, rows: np.ndarray) -> np.ndarray:
        return np.where(np.isfinite(self.kth[rows]), distance(self.kth[rows]), 3.0)

    def add(self, q: np.ndarray, score: np.ndarray, ids: np.ndarray, some: np.ndarray) -> None:
        other = ~(some & self.has[q] & (ids == self.ids[q]))
        q, score, ids, some = q[other], score[other], ids[other], some[other]
        rows = np.unique(q)
        i, j = np.nonzero(self.used[rows])
        q, score = np.concatenate([q, rows[i]]), np.concatenate([score, self.score[rows[i], j]])
        ids, some = np.concatenate([ids, self.id[rows[i], j]]), np.concatenate([some, self.some[rows[i], j]])
        order = np.lexsort((ids, ~some, -score, q))
        q, score, ids, some = q[order], score[order], ids[order], some[order]
        first = np.searchsorted(q, q, "left")
        rank = np.arange(len(q)) - first
        keep = rank < self.k
        q, rank = q[keep], rank[keep]
        self.score[q, rank], self.id[q, rank], self.some[q, rank], self.used[q, rank] = score[keep], ids[keep], some[keep], True
        self.kth[rows] = np.maximum(self.kth[rows], self.score[rows, self.k - 1])


class Shard:
    """The rows of one shard and their tree."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, has: np.ndarray):
        self.scaled, self.units = unit(rows)
        self.ids, self.has = ids, has
        self.tree = Tree(self.units, LEAF)

    def search(self, rows: np.ndarray, ids: np.ndarray, has: np.ndarray, floor: np.ndarray, k: int, factor: float) -> Best:
        """``floor``: scores that a neighbour has to reach. The home leaf of each query comes first."""
        best, (scaled, units) = Best(ids, has, floor, k), unit(rows)
        home = self.tree.home(units)
        order = np.argsort(home, kind="stable")
        starts = np.flatnonzero(np.diff(home[order], prepend=-1))
        for part in np.split(order, starts[1:]):
            self.compare(home[part[0]], part, scaled, units, best)
        for leaf, active in self.tree.reached(units, best.limit, factor):
            active = active[home[active] != leaf]
            if len(active):
                self.compare(leaf, active, scaled, units, best)
        return best

    def compare(self, leaf: int, active: np.ndarray, scaled: np.ndarray, units: np.ndarray, best: Best) -> None:
        rows = self.tree.leaves[leaf]
        product = units[active] @ self.units[rows].T
        i, j = np.nonzero(product >= best.kth[active][:, None] - TIE)
        if len(i):
            q, r = active[i], rows[j]
            best.add(q, cosine(scaled[q], self.scaled[r]), self.ids[r], self.has[r])


def longs(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and presence of a column of longs."""
    return column.fill_null(0).to_numpy(zero_copy_only=False), column.is_valid().to_numpy(zero_copy_only=False)


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def segments(batch: pa.RecordBatch, by: list[str]) -> Iterator[pa.RecordBatch]:
    """Runs of rows that agree in ``by``."""
    keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in by])
    cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


PLACE = ["dim", "region", "sub", "block"]
FOUND = "id long, h long, dim int, v array<double>, kth double, ids array<long>, scores array<double>"


def search(k: int, factor: float):
    """Rows in order of (shard, kind): a shard's own (kind 0) are gathered to a tree, its queries (kind 1) stream past it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, shard = None, [], None
        for batch in batches:
            for part in segments(batch, [*PLACE, "kind"]):
                place = [part.column(c)[0].as_py() for c in PLACE]
                if place != at:
                    at, held, shard = place, [], None
                if part.column("kind")[0].as_py() == 0:
                    held.append((matrix(part.column("v")), *longs(part.column("id"))))
                    continue
                if shard is None and held:
                    shard, held = Shard(*(np.concatenate(x) for x in zip(*held))), []
                for a in range(0, part.num_rows, STEP):
                    some = part.slice(a, STEP)
                    floor = some.column("kth").to_numpy(zero_copy_only=False)
                    if shard is None:
                        n = some.num_rows
                        ids, scores, kth = pa.array([[]] * n, pa.list_(pa.int64())), pa.array([[]] * n, pa.list_(pa.float64())), floor
                    else:
                        best = shard.search(matrix(some.column("v")), *longs(some.column("id")), floor, k, factor)
                        offsets = pa.array(np.concatenate([[0], best.used.sum(axis=1).cumsum()]), pa.int32())
                        ids = pa.ListArray.from_arrays(offsets, pa.array(best.id[best.used], mask=~best.some[best.used]))
                        scores, kth = pa.ListArray.from_arrays(offsets, pa.array(best.score[best.used])), best.kth
                    columns = [some.column("id"), some.column("h"), some.column("dim"), some.column("v"), pa.array(kth), ids, scores]
                    yield pa.RecordBatch.from_arrays(columns, ["id", "h", "dim", "v", "kth", "ids", "scores"])
        give_back()

    return run


def regions(trees: dict[int, Tree], reach: float | None):
    """Rows with their region (``reach`` is None), or queries with each region that they do not skip by that factor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in segments(batch, ["dim"]):
                tree = trees.get(part.column("dim")[0].as_py())
                every = np.arange(part.num_rows)
                if tree is None:
                    found = [(every, np.zeros(len(every), np.int64))]
                else:
                    units = unit(matrix(part.column("v")))[1]
                    if reach is None:
                        found = [(every, tree.home(units))]
                    else:
                        kth = part.column("kth").to_numpy(zero_copy_only=False)
                        far = np.where(np.isfinite(kth), distance(np.where(np.isfinite(kth), kth, 0)), 3.0)
                        found = [(rows, np.full(len(rows), leaf)) for leaf, rows in tree.reached(units, lambda rows: far[rows], reach)]
                for rows, region in found:  # noqa: B007
                    taken = part.take(pa.array(rows))
                    yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(region.astype(np.int32))], [*part.schema.names, "region"])

    return run


def usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v, dim, h) of the rows whose vector has a direction."""
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    odd = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where(~odd & F.exists("v", lambda x: x != 0))
    return rows.select("id", "v", F.size("v").alias("dim"), F.xxhash64("v").alias("h")).distinct()


def nearest(base: DataFrame, queries: DataFrame, k: int = K, factor: float = FACTOR, key: str = "vec_id", vector: str = "embedding",
            shard: int = SHARD, sample: int = SAMPLE, block: int = BLOCK) -> DataFrame:
    """The ``k`` rows of ``base`` of largest cosine to each row of ``queries``: query_id, rank (from 1), vec_id, score.

    A query's own id is no neighbour of it. Ties go to the smaller id, null ids last. Vectors that are null, empty, zero
    or hold null or non-finite components take no part on either side; vectors of different sizes never meet. Rows that
    repeat an id and a vector are one; an id with two vectors is two rows and two queries. Fewer rows than ``k`` are all
    returned; empty tables give no rows. Other columns are not looked at.

    Of rows with the same vector, the ``k`` + 1 smallest ids stand for all: no query has another among its neighbours. A task
    holds one shard, queries stream past it in blocks; only a sample of at most ``sample`` rows comes to the driver.
    """
    spark = base.sparkSession
    scratch = Scratch(spark, "neighbours")
    rows, asked = usable(base, key, vector), usable(queries, key, vector)
    rows = rows.withColumn("copy", F.expr("row_number() OVER (PARTITION BY h, v ORDER BY id NULLS LAST)")).where(F.col("copy") <= k + 1).drop("copy")
    rows = scratch.save(rows)
    n, many = rows.count(), asked.count()
    drawn: dict[int, list] = {}
    for v in rows.orderBy(F.xxhash64("h", "id"), "id").limit(sample).select("v").toLocalIterator():
        drawn.setdefault(len(v["v"]), []).append(v["v"])
    trees = {}
    for dim, vectors in drawn.items():
        part = -(-len(vectors) * shard // max(n, 1))  # rows of the sample that stand for one shard
        trees[dim] = Tree(unit(np.array(vectors, np.float64))[1], max(part, REGION_SAMPLE))

    schema = "id long, v array<double>, dim int, h long, region int"
    placed = scratch.save(rows.mapInArrow(regions(trees, None), schema))
    sizes = placed.groupBy("dim", "region").agg(F.ceil(F.count(F.lit(1)) / shard).cast("int").alias("subs"))
    sizes = scratch.save(sizes)
    shards, blocks = sizes.agg(F.coalesce(F.sum("subs"), F.lit(0))).first()[0], max(1, -(-many // block))
    own = F.pmod(F.col("h"), F.col("subs")).cast("int").alias("sub")
    points = placed.join(sizes, ["dim", "region"]).select("dim", "region", own, F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"),
                                                          F.lit(0).alias("kind"), "id", "h", "v", F.lit(None).cast("double").alias("kth"))
    tasks = max(1, min(2 * shards * blocks, 10_000))
    where = F.pmod(F.xxhash64("id", "h"), F.lit(blocks)).cast("int").alias("block")

    def searched(visits: DataFrame) -> DataFrame:
        work = points.unionByName(visits.select("dim", "region", "sub", where, F.lit(1).alias("kind"), "id", "h", "v", "kth"))
        return scratch.save(work.repartition(tasks, *PLACE).sortWithinPartitions(*PLACE, "kind").mapInArrow(search(k, factor), FOUND))

    homes = asked.mapInArrow(regions(trees, None), schema).join(sizes, ["dim", "region"])
    first = searched(homes.select("dim", "region", own, "id", "h", "v", F.lit(float("-inf")).alias("kth")))
    known = first.select("id", "h", "dim", "v", "kth")
    further = known.mapInArrow(regions(trees, factor), "id long, h long, dim int, v array<double>, kth double, region int").join(sizes, ["dim", "region"])
    further = further.select("dim", "region", F.explode(F.sequence(F.lit(0), F.col("subs") - 1)).alias("sub"), "id", "h", "v", "kth")
    seen = homes.select("dim", "region", own, "id", "h")
    rest = searched(further.join(seen, further["id"].eqNullSafe(seen["id"]) & (further["h"] == seen["h"]) & (further["region"] == seen["region"])
                                 & (further["sub"] == seen["sub"]) & (further["dim"] == seen["dim"]), "left_anti"))
    found = first.unionByName(rest).select("id", "h", F.explode(F.arrays_zip("ids", "scores")).alias("x"))
    found = found.select(F.col("id").alias("query_id"), "h", F.col("x.ids").alias("vec_id"), F.col("x.scores").alias("score"))
    ranked = found.withColumn("rank", F.expr("row_number() OVER (PARTITION BY query_id, h ORDER BY score DESC, vec_id NULLS LAST)"))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(vectors: DataFrame) -> DataFrame:
    """The nearest rows of every row whose id 50 divides, against all rows."""
    return nearest(vectors, vectors.where("vec_id % 50 = 0"))
