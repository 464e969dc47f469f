"""Near-duplicate groups by SimHash: tiled exact comparison of all distinct fingerprints."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailprism.llm.common import Scratch, components, fresh, pieces, spark_of

SEED = 42
TILE = 1 << 15  # distinct fingerprints in a tile
BLOCK = 255  # rows whose bits are added in one byte
RATIO = 1.26  # step of the size classes: sizes of sets that are 0.8 alike differ by 1.25 at most, so by one class
HELD = 1 << 20  # bytes of shingle sets in a block
ONES = np.uint64(0x0101010101010101)


def shingle_hashes(text: str | None, words: int) -> list[int]:
    """XXH64 of every run of ``words`` words (A-Z lowered, split at ASCII white space, joined by a space)."""
    found = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if len(found) <= words:
        return [xxhash.xxh64_intdigest(b" ".join(found), SEED)] if found else []
    joined = b" ".join(found)
    ends = list(accumulate(map(len, found)))
    starts = [0, *(e + k for k, e in enumerate(ends, 1))]
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:e + k], SEED) for k, (a, e) in enumerate(zip(starts, ends[words - 1:]), words - 1)]


def lane(hashes: np.ndarray, number: int) -> np.ndarray:
    """64 further bits per shingle; lane 0 is the hash itself, the others mix it anew."""
    if not number:
        return hashes
    x = hashes + np.uint64((number * 0x9E3779B97F4A7C15) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def majority(hashes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Per document the 64 bits that over half of its hashes have set; rows of 8 bytes, most significant first.

    Eight shifted byte-wise sums count all bits: 255 rows fit in a byte.
    """
    counts = np.zeros((len(lengths), 64), np.int64)
    has = np.flatnonzero(lengths)
    if len(has):
        n = lengths[has]
        starts = np.cumsum(n) - n
        blocks = -(-n // BLOCK)
        first = np.cumsum(blocks) - blocks
        at = np.repeat(starts - first * BLOCK, blocks) + np.arange(blocks.sum()) * BLOCK
        for i in range(8):
            sums = np.add.reduceat((hashes >> np.uint64(i)) & ONES, at).astype("<u8").view(np.uint8).reshape(-1, 8)
            counts[has, i::8] = np.add.reduceat(sums, first, axis=0, dtype=np.int64)
    bits = 2 * counts > lengths[:, None]
    return np.packbits(bits[:, ::-1], axis=1)


def fingerprint(words: int, lanes: int):
    """Column function: ``fp`` (64 × ``lanes`` bits as bytes) and ``pop`` (bits set) of whole texts.

    A text of fewer words than a shingle is one shingle; a null, empty or blank text has fingerprint zero.
    """
    @F.pandas_udf("fp binary, pop int")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch.tolist()
            parts = [np.zeros((0, 8 * lanes), np.uint8)]
            for a, b in pieces([len(x) if x else 0 for x in texts]):
                hashed = [shingle_hashes(x, words) for x in texts[a:b]]
                lengths = np.array([len(x) for x in hashed], np.int64)
                flat = np.fromiter((h for x in hashed for h in x), np.uint64, lengths.sum())
                parts.append(np.hstack([majority(lane(flat, k), lengths) for k in range(lanes)]))
            fp = np.ascontiguousarray(np.vstack(parts))
            yield pd.DataFrame({"fp": [x.tobytes() for x in fp], "pop": np.bitwise_count(fp).sum(axis=1, dtype=np.int32)})

    return run


def shingle_sets(words: int, lanes: int):
    """Column function: ``fp`` (64 × ``lanes`` bits) over the distinct shingles of whole texts, ``set_id`` and ``size``."""
    @F.pandas_udf("fp binary, set_id binary, size int")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch.tolist()
            parts, ids, sizes = [np.zeros((0, 8 * lanes), np.uint8)], [], []
            for a, b in pieces([len(x) if x else 0 for x in texts]):
                sets = [np.unique(np.array(shingle_hashes(x, words), np.uint64)) for x in texts[a:b]]
                lengths = np.array([len(x) for x in sets], np.int64)
                flat = np.concatenate(sets)
                parts.append(np.hstack([majority(lane(flat, k), lengths) for k in range(lanes)]))
                ids += [xxhash.xxh3_128_digest(x.tobytes()) for x in sets]
                sizes += lengths.tolist()
            fp = np.ascontiguousarray(np.vstack(parts))
            yield pd.DataFrame({"fp": [x.tobytes() for x in fp], "set_id": ids, "size": np.array(sizes, np.int32)})

    return run


def hashes_of(words: int):
    """Column function: the distinct shingle hashes of whole texts, in order, as bytes."""
    @F.pandas_udf("binary")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([np.unique(np.array(shingle_hashes(x, words), "<u8")).tobytes() for x in batch], dtype=object)

    return run


def tiles(distinct: DataFrame, n: int, tile: int = TILE) -> DataFrame:
    """Distinct fingerprints (fp, pop) in order of pop, packed into rows of at most ``tile``: tile, low, high, fps, pops."""
    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size, number = [], 0, 0

        def row(part: pd.DataFrame, number: int) -> pd.DataFrame:
            from pyspark import TaskContext

            return pd.DataFrame({"tile": [(TaskContext.get().partitionId() << 32) + number], "low": [part["pop"].iloc[0]],
                                 "high": [part["pop"].iloc[-1]], "fps": [b"".join(part["fp"])],
                                 "pops": [part["pop"].to_numpy("<i4").tobytes()]})

        for batch in batches:
            held.append(batch)
            size += len(batch)
            while size >= tile:
                joined = pd.concat(held, ignore_index=True)
                yield row(joined.iloc[:tile], number)
                number, held, size = number + 1, [joined.iloc[tile:]], size - tile
        if size:
            yield row(pd.concat(held, ignore_index=True), number)

    parts = max(1, -(-n // tile))
    spread = distinct.repartitionByRange(parts, "pop", "fp").sortWithinPartitions("pop", "fp")
    return spread.mapInPandas(pack, "tile long, low int, high int, fps binary, pops binary")


class Forest:
    """Rows of two tables (``n`` above ``m``; the same rows twice if ``same``), joined to the least row of their group."""

    def __init__(self, n: int, m: int, same: bool):
        self.n, self.same = n, same
        self.parent = np.arange(n + m)
        if same:
            self.parent[n:] = np.arange(n)

    def root(self, x: np.ndarray) -> np.ndarray:
        x = self.parent[x]
        while True:
            up = self.parent[x]
            if np.array_equal(up, x):
                return x
            x = up

    def link(self, i: np.ndarray, j: np.ndarray) -> None:
        while len(i):
            ri, rj = self.root(i), self.root(j)
            apart = ri != rj
            if not apart.any():
                break
            i, j, ri, rj = i[apart], j[apart], ri[apart], rj[apart]
            np.minimum.at(self.parent, np.maximum(ri, rj), np.minimum(ri, rj))

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        every = np.arange(len(self.parent))
        top = self.root(every)
        linked = np.flatnonzero(top != every)
        if self.same:
            linked = linked[linked < self.n]
        return linked, top[linked]


def forest(one: np.ndarray, other: np.ndarray, same: bool, radius: int,
           sizes: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Rows (of ``one`` above ``other``) joined to the least row of their group by links of at most ``radius`` bits.

    Both are (rows, lanes) of uint64 in order of population count. Every pair within reach of the counts is
    compared; a chunk of rows skips the stretch of the other tile whose counts differ by more than ``radius``.
    With ``sizes`` the rows are in order of these, and pairs whose sizes differ by more than a quarter are skipped.
    """
    lanes = one.shape[1]
    count_one, count_other = sizes or (np.bitwise_count(x).sum(axis=1, dtype=np.int64) for x in (one, other))
    least, most = (lambda n: -(-4 * n // 5), lambda n: 5 * n // 4) if sizes else (lambda n: n - radius, lambda n: n + radius)
    columns = [np.ascontiguousarray(other[:, k]) for k in range(lanes)]
    joined = Forest(len(one), len(other), same)
    enough = next(k for k in range(1, lanes + 1) if k == lanes or 32 * k - radius >= 12 * k**0.5)  # these lanes rule out nearly all pairs
    step = 16
    for a in range(0, len(one), step):
        rows = one[a:a + step]
        low = np.searchsorted(count_other, least(count_one[a]), "left")
        low = max(low, a + 1) if same else low
        high = np.searchsorted(count_other, most(count_one[min(a + step, len(one)) - 1]), "right")
        if low >= high:
            continue
        near = np.bitwise_count(rows[:, :1] ^ columns[0][None, low:high])
        for k in range(1, enough):
            near += np.bitwise_count(rows[:, k:k + 1] ^ columns[k][None, low:high])
        i, j = np.nonzero(near <= radius)
        if lanes > enough and len(i):
            i, j = (x[np.bitwise_count(rows[i] ^ other[j + low]).sum(axis=1, dtype=np.int64) <= radius] for x in (i, j))
        joined.link(i + a, j + low + len(one))
    return joined.edges()


def size_class(size: str | Column) -> Column:
    return F.floor(F.log(size) / F.log(F.lit(RATIO))).cast("int")


def links(distinct: DataFrame, scratch: Scratch, radius: int, lanes: int, tile: int = TILE, sized: bool = False) -> DataFrame:
    """Edges (a, b) that join all fingerprints within ``radius`` bits, directly or through others.

    ``sized``: ``pop`` is the size (1 or more) of a fingerprint's set, and sizes that differ by more than a quarter are no pair.
    """
    n = distinct.count()
    packed = scratch.save(tiles(distinct, n, tile))
    low, high, wide = (size_class("low"), size_class("high"), 1) if sized else (F.col("low"), F.col("high"), radius)
    reach = packed.select("tile", F.explode(F.sequence(low - wide, high + wide)).alias("pop"))
    own = packed.select(F.col("tile").alias("b"), F.explode(F.sequence(low, high)).alias("pop"))
    pairs = scratch.save(reach.withColumnRenamed("tile", "a").join(own, "pop").where("a <= b").select("a", "b").distinct())
    many = pairs.count()
    cores = spark_of(distinct).sparkContext.defaultParallelism
    tasks = max(1, min(many, 4 * cores), -(-many // 16))
    one, other = (packed.select(F.col("tile").alias(c), F.col("fps").alias(f"fps_{c}"), F.col("pops").alias(f"pops_{c}")) for c in "ab")
    work = pairs.join(one, "a").join(other, "b").repartition(tasks, "a", "b")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for a, b, x, y, p, q in zip(batch["a"], batch["b"], batch["fps_a"], batch["fps_b"], batch["pops_a"], batch["pops_b"]):
                x, y = (np.frombuffer(v, ">u8").astype(np.uint64).reshape(-1, lanes) for v in (x, y))
                rows = np.vstack([x, y])
                sizes = tuple(np.frombuffer(v, "<i4").astype(np.int64) for v in (p, q)) if sized else None
                node, top = forest(x, y, a == b, radius, sizes)
                if len(node):
                    raw = rows.astype(">u8")
                    yield pd.DataFrame({"a": [raw[k].tobytes() for k in node], "b": [raw[k].tobytes() for k in top]})

    return work.mapInPandas(compare, "a binary, b binary")


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = 3, lanes: int = 1, key: str = "doc_id",
                    text: str = "text", tile: int = TILE) -> DataFrame:
    """Group documents whose SimHash fingerprints differ in at most ``radius`` bits, directly or through others.

    Returns per input row: key, ``text_id`` (hash of the row's text), ``fp`` (bytes), ``group`` (bytes, equal within
    a group), ``component`` (the smallest key of the group; null keys are passed over, a group of null keys only
    has null). Repeated rows stay repeated and share a group; rows without words share fingerprint zero, which
    links like any other; an empty table gives no rows. Other columns of ``docs`` are not looked at, so they may
    have any names.

    All pairs of distinct fingerprints are compared exactly, tile against tile; equal ones meet beforehand
    in a grouping, so a large group of copies is one fingerprint. A tile pair returns a forest (at most one
    edge per fingerprint), never its links one by one.
    """
    scratch = Scratch(spark_of(docs), "simhash")
    shown = docs.select(F.col(key).alias("key"), F.xxhash64(F.col(text)).alias("text_id"), fingerprint(words, lanes)(F.col(text)).alias("f"))
    prints = scratch.save(shown.select("key", "text_id", "f.fp", "f.pop"))
    distinct = scratch.save(prints.groupBy("fp", "pop").agg(F.min("key").alias("least")))
    edges = links(distinct.select("fp", "pop"), scratch, radius, lanes, tile)
    roots = components(edges, scratch).withColumnRenamed("node", "fp")
    rooted = scratch.save(distinct.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("group")))
    least = rooted.groupBy("group").agg(F.min("least").alias("component"))
    named = rooted.join(least, "group").select("fp", "group", "component")
    return prints.join(named, "fp").select(F.col("key").alias(key), "text_id", "fp", "group", "component")


def verified(one: list[np.ndarray], other: list[np.ndarray], same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Like ``forest``, over sets (sorted arrays): links are the pairs that share 0.8 of their union or more."""
    sizes = np.array([len(x) for x in other])
    flat = np.concatenate(other)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], np.repeat(np.arange(len(other)), sizes)[order]
    joined = Forest(len(one), len(other), same)
    for i, own in enumerate(one):
        first, last = np.searchsorted(flat, own, "left"), np.searchsorted(flat, own, "right")
        n = last - first
        at = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
        shared = np.bincount(owner[at], minlength=len(other))
        j = np.flatnonzero(9 * shared >= 4 * (len(own) + sizes))  # shared / (a + b - shared) >= 4 / 5
        joined.link(np.full(len(j), i), j + len(one))
    return joined.edges()


def verified_links(members: DataFrame, scratch: Scratch) -> DataFrame:
    """Edges (a, b) of set ids that join all sets of a cluster that are 0.8 alike, directly or through others.

    ``members``: set_id, cluster, size, hashes. A cluster's sets are dealt into blocks inside a class of sizes;
    every two blocks of the same or the next class are compared. A pair of blocks returns a forest.
    """
    members = members.withColumn("class", size_class("size"))
    counts = members.groupBy("cluster", "class").agg(F.ceil(F.sum(F.col("size").cast("long") * 8) / HELD).alias("blocks"))
    counts = scratch.save(counts)
    dealt = members.join(counts, ["cluster", "class"]).withColumn("block", F.pmod(F.xxhash64("set_id"), F.col("blocks")))
    held = dealt.groupBy("cluster", "class", "block").agg(F.collect_list(F.struct("set_id", "hashes")).alias("s"))
    held = scratch.save(held.select("cluster", "class", "block", F.col("s.set_id").alias("ids"), F.col("s.hashes").alias("sets")))
    numbers = counts.select("cluster", "class", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
    one, other = (numbers.select("cluster", F.col("class").alias(f"class_{c}"), F.col("block").alias(f"block_{c}")) for c in "ab")
    pairs = one.join(other, "cluster").where("class_b = class_a + 1 OR class_b = class_a AND block_b >= block_a")
    for c in "ab":
        named = held.select("cluster", F.col("class").alias(f"class_{c}"), F.col("block").alias(f"block_{c}"), F.col("ids").alias(f"ids_{c}"), F.col("sets").alias(f"sets_{c}"))
        pairs = pairs.join(named, ["cluster", f"class_{c}", f"block_{c}"])
    same = (F.col("class_a") == F.col("class_b")) & (F.col("block_a") == F.col("block_b"))

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for same, p, q, x, y in zip(batch["same"], batch["ids_a"], batch["ids_b"], batch["sets_a"], batch["sets_b"]):
                x, y = ([np.frombuffer(v, "<u8") for v in part] for part in (x, y))
                ids = [*p, *q]
                node, top = verified(x, y, same)
                if len(node):
                    yield pd.DataFrame({"a": [ids[k] for k in node], "b": [ids[k] for k in top]})

    total = counts.agg(F.coalesce(F.sum("blocks"), F.lit(0))).first()[0]
    cores = spark_of(members).sparkContext.defaultParallelism
    work = pairs.select(same.alias("same"), "ids_a", "ids_b", "sets_a", "sets_b", "cluster", "class_a", "class_b", "block_a", "block_b")
    work = work.repartition(max(cores, -(-total // 64)), "cluster", "class_a", "class_b", "block_a", "block_b")
    return work.select("same", "ids_a", "ids_b", "sets_a", "sets_b").mapInPandas(compare, "a binary, b binary")


def alike(docs: DataFrame, words: int, radius: int, lanes: int, key: str = "doc_id", text: str = "text", tile: int = TILE) -> DataFrame:
    """Group documents whose sets of shingles share 0.8 of their union or more, directly or through others.

    Returns per input row: key, ``text_id`` and ``group`` (bytes, equal within a group). Fingerprints over the
    distinct shingles, compared as in ``near_duplicates``, only propose clusters of sets within ``radius`` bits; a
    link counts if the sets themselves are 0.8 alike. Sets of fewer than four shingles are alike only if equal. One
    set of four inside one of five differs in more bits than any other pair that is 0.8 alike and is found by its id.
    """
    scratch = Scratch(spark_of(docs), "alike")
    shown = docs.select(F.col(key).alias("key"), F.xxhash64(F.col(text)).alias("text_id"), shingle_sets(words, lanes)(F.col(text)).alias("f"))
    prints = scratch.save(shown.select("key", "text_id", "f.*"))
    first = F.min(F.struct(F.col("key").isNull().alias("none"), "key", "text_id")).alias("first")
    sets = scratch.save(prints.where("size >= 4").groupBy("set_id", "fp", "size").agg(first))
    edges = links(sets.select("fp", F.col("size").alias("pop")).distinct(), scratch, radius, lanes, tile, sized=True)
    roots = components(edges, scratch).withColumnRenamed("node", "fp")
    placed = sets.join(roots, "fp", "left").withColumn("cluster", F.coalesce("root", "fp"))
    shared = placed.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("cluster")
    small = F.col("size").isin(4, 5)
    wanted = scratch.save(placed.join(shared.withColumn("many", F.lit(True)), "cluster", "left").where(F.col("many") | small)
                          .select("set_id", "cluster", "size", "first.key", "first.text_id", F.coalesce("many", F.lit(False)).alias("many")))
    marked = docs.select(F.col(key).alias("k"), F.xxhash64(F.col(text)).alias("t"), F.col(text).alias("text"))
    found = marked.join(wanted, F.col("k").eqNullSafe(F.col("key")) & (F.col("t") == F.col("text_id")))
    found = found.select("set_id", "cluster", "size", "many", hashes_of(words)(F.col("text")).alias("hashes"))
    members = scratch.save(found.dropDuplicates(["set_id"]))

    @F.pandas_udf("array<binary>")
    def without_one(batch: pd.Series) -> pd.Series:
        return pd.Series([[xxhash.xxh3_128_digest(x[:8 * k] + x[8 * k + 8:]) for k in range(len(x) // 8)] for x in batch], dtype=object)

    inside = members.where("size = 5").select(F.col("set_id").alias("a"), F.explode(without_one(F.col("hashes"))).alias("b"))
    inside = inside.join(members.where("size = 4").select(F.col("set_id").alias("b")), "b", "left_semi").select("a", "b")
    proved = verified_links(members.where("many").drop("many"), scratch).unionByName(inside)
    named = components(proved, scratch).select(F.col("node").alias("set_id"), "root")
    return prints.join(named, "set_id", "left").select(F.col("key").alias(key), "text_id", F.coalesce("root", "set_id").alias("group"))


def one_of_each(docs: DataFrame, words: int, radius: int, lanes: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each group the one with the smallest key (then text hash) stays.

    Groups as in ``alike``. Rows that repeat a key and a text are one document; a null key stands last.
    """
    groups = alike(docs, words, radius, lanes, key, text)
    first = groups.groupBy("group").agg(F.min(F.struct(F.col(key).isNull(), F.col(key).alias("key"), "text_id")).alias("first"))
    first = Scratch(spark_of(docs), "kept").save(first.select("first.key", "first.text_id"))
    marked = docs.withColumn(mark := fresh("text_id", docs), F.xxhash64(F.col(text)))
    kept = marked.join(first, marked[key].eqNullSafe(first["key"]) & (marked[mark] == first["text_id"]), "left_semi")
    return kept.dropDuplicates([key, mark]).select(*docs.columns)
