"""Language-model scores by prediction by partial matching over bytes.

A text is its words (A-Z lowered, split at ASCII white space) joined by a space, and an end mark. Contexts are
the last ``order`` bytes. In the longest context that was seen in training, a byte that followed it c times among
n has probability (c - 1/2) / n, and with d different followers d / 2n is left for an escape to the context that is
one byte shorter; there, all followers of the longer context are excluded from both counts.
Below the empty context every byte that training never had is equally likely.

The trie is a set of tables, one per depth, keyed by the bytes of context and follower in one long. They are
built from counts over the whole training side and are joined, never broadcast (but for the first two depths,
which cannot exceed 65,536 rows). Documents are read in blocks; a block asks for the byte strings and words that
occur in it and gets the log probability of each, so a task holds one block and its part of the model.
"""

from __future__ import annotations

import pickle
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from mailprism.llm.common import Scratch, give_back, pieces, remainder, spark_of

ORDER = 5  # bytes of context; at most 6, so that context and follower fit in a positive long
BLOCK = 32 << 20  # bytes of text that are scored together
END = 0xFF  # never a byte of UTF-8
ALPHABET = 256
STEP = 1 << 20  # bytes of text that are numbered at once
DENSE = 1 << 23  # entries of a table of possible strings; a larger one is replaced by sorting


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def strings(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted keys of the strings (context and follower) in a block of texts, and for each byte its string and document.

    Each text stands behind ``order`` spaces and before the end mark; every later byte is a follower. The key is put
    together from the oldest byte on, and the strings found so far are numbered anew after each, so that a small
    table replaces sorting.
    """
    pad = b" " * order
    data = np.frombuffer(b"".join(pad + x + bytes([END]) for x in texts), np.uint8)
    sizes = np.array([len(x) + 1 for x in texts], np.int64)
    begin = np.cumsum(sizes + order) - (sizes + order)
    inside = np.ones(len(data), bool)
    for k in range(order):
        inside[begin + k] = False
    at = np.flatnonzero(inside)
    own = np.flatnonzero(np.bincount(data, minlength=ALPHABET))
    letter = np.zeros(ALPHABET, np.int32)
    letter[own] = np.arange(len(own))
    last = letter[data]
    keys, number = np.zeros(1, np.int64), np.zeros(len(at), np.int32)
    for back in range(order, -1, -1):
        wide = len(keys) * len(own)
        code = number.astype(np.int32 if wide < 2**31 else np.int64) * len(own)
        code += last[at - back]
        if wide <= DENSE:
            seen = np.zeros(wide, bool)
            seen[code] = True
            found = np.flatnonzero(seen)
            place = np.zeros(wide, np.int32)
            place[found] = np.arange(len(found), dtype=np.int32)
            number = place[code]
        else:
            found, number = np.unique(code, return_inverse=True)
            number = number.astype(np.int32)
        keys = keys[found // len(own)] << 8 | own[found % len(own)]
    return keys, number, np.repeat(np.arange(len(texts)), sizes)


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys of (keys, counts) and their summed counts."""
    keys, counts = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[first], np.add.reduceat(counts, first)


ROWS = pa.schema([("kind", pa.int32()), ("block", pa.int64()), ("string", pa.int64()), ("seen", pa.int64()), ("word", pa.binary()), ("texts", pa.binary())])


class Block:
    """Documents that are scored together, and what they hold."""

    def __init__(self, order: int):
        self.order, self.size = order, 0
        self.names, self.texts = [], []
        self.words: list[pa.Table] = []
        self.found: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, names: list, learn: list[bool], lists: list[list[bytes]]) -> None:
        texts = [b" ".join(x) for x in lists]
        keys, number, owner = strings(texts, self.order)
        self.found.append((keys, np.bincount(number[np.array(learn, bool)[owner]], minlength=len(keys))))
        if len(self.found) > 2:
            self.found = [merged(self.found)]
        counts = Counter()
        for x, use in zip(lists, learn):
            if use:
                counts.update(x)
            else:
                for w in x:
                    counts.setdefault(w, 0)
        self.words.append(pa.table({"word": pa.array(counts.keys(), pa.binary()), "seen": pa.array(counts.values(), pa.int64())}))
        self.names += names
        self.texts += texts
        self.size += sum(map(len, texts))

    def rows(self, number: int) -> Iterator[pa.RecordBatch]:
        """kind 1: distinct strings, kind 2: words, both with their count in training; kind 0: the texts."""
        def batch(kind: int, n: int, **given) -> pa.RecordBatch:
            same = {"kind": kind, "block": number, "string": 0, "seen": 0, "word": None, "texts": None}
            return pa.RecordBatch.from_arrays([given[f.name] if f.name in given else pa.repeat(pa.scalar(same[f.name], f.type), n) for f in ROWS], schema=ROWS)

        packed = zstandard.compress(pickle.dumps((self.names, self.texts)), 3)
        self.names, self.texts = [], []
        yield batch(0, 1, texts=pa.array([packed], pa.binary()))
        keys, seen = merged(self.found)
        self.found = []
        yield batch(1, len(keys), string=pa.array(keys), seen=pa.array(seen, pa.int64()))
        words = pa.concat_tables(self.words).group_by("word", use_threads=False).aggregate([("seen", "sum")]).combine_chunks()
        self.words = []
        if len(words):
            yield batch(2, len(words), word=words["word"].chunk(0), seen=words["seen_sum"].chunk(0))


def extract(docs: DataFrame, order: int, key: str) -> DataFrame:
    """Documents (key, text, learn) as blocks: see ``Block.rows``. A block's number is its task and its place there."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, number = Block(order), TaskContext.get().partitionId() << 32
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_pylist()
            for a, b in pieces(sizes, STEP):
                names, learn, texts = (batch.column(c).slice(a, b - a).to_pylist() for c in (key, "learn", "text"))
                block.add(names, learn, [words_of(x) for x in texts])
                give_back()
                if block.size >= BLOCK:
                    yield from block.rows(number)
                    block, number = Block(order), number + 1
        if block.names:
            yield from block.rows(number)
        block = None
        give_back()

    return docs.mapInArrow(run, "kind int, block long, string long, seen long, word binary, texts binary")


def follow(counts: DataFrame, order: int, scratch: Scratch) -> DataFrame:
    """log10 probability of every string (string, seen): string, lp."""
    low = lambda column, size: F.col(column).bitwiseAND(F.lit((1 << 8 * size) - 1))
    levels = {order: scratch.save(counts.where("seen > 0").select("string", "seen"))}
    for k in range(order - 1, -1, -1):
        shorter = levels[k + 1].groupBy(low("string", k + 1).alias("string")).agg(F.sum("seen").alias("seen"))
        levels[k] = scratch.save(shorter)

    contexts = {}  # depth: context, n, d and, for the context one byte shorter, n and d without the followers of this one
    for k in range(order + 1):
        own = levels[k].withColumn("context", F.shiftright("string", 8))
        if k:
            less = levels[k - 1].select(F.col("string").alias("tail"), F.col("seen").alias("tail_seen"))
            own = own.withColumn("tail", low("string", k)).join(F.broadcast(less) if k <= 2 else less, "tail")
        own = own.groupBy("context").agg(F.sum("seen").alias("n"), F.count(F.lit(1)).alias("d"),
                                         *([F.sum("tail_seen").alias("x")] if k else []))
        if k:
            less = contexts[k - 1].select(F.col("context").alias("after"), F.col("n").alias("n_less"), F.col("d").alias("d_less"))
            own = own.withColumn("after", low("context", k - 1)).join(F.broadcast(less) if k <= 2 else less, "after").select(
                "context", "n", "d", (F.col("n_less") - F.col("x")).alias("left_n"), (F.col("d_less") - F.col("d")).alias("left_d"))
        contexts[k] = scratch.save(own)

    pending = counts.select("string", F.lit(0.0).alias("lp"))
    done = []
    for k in range(order, -1, -1):
        seen = levels[k].select(F.col("string").alias("s"), "seen")
        here = contexts[k].select(F.col("context").alias("c"), "n", "d")
        pending = pending.withColumn("s", low("string", k + 1)).withColumn("c", F.shiftright("s", 8))
        pending = pending.join(F.broadcast(seen) if k <= 1 else seen, "s", "left").join(F.broadcast(here) if k <= 1 else here, "c", "left")
        if k < order:
            longer = contexts[k + 1].select(F.col("context").alias("c1"), "left_n", "left_d")
            pending = pending.withColumn("c1", F.shiftright(low("string", k + 2), 8))
            pending = pending.join(F.broadcast(longer) if k == 0 else longer, "c1", "left")
            n, d = F.coalesce("left_n", "n", F.lit(0)), F.coalesce("left_d", "d", F.lit(0))
        else:
            n, d = F.coalesce("n", F.lit(0)), F.coalesce("d", F.lit(0))
        share = F.when(F.col("seen").isNotNull(), F.col("seen") - 0.5).when(d > 0, d * 0.5)
        step = F.when(share.isNotNull(), F.log10(share / n)).otherwise(0.0)
        after = scratch.save(pending.select("string", (F.col("lp") + step).alias("lp"), F.col("seen").isNotNull().alias("found")))
        done.append(after.where("found").select("string", "lp"))
        pending = after.where("NOT found").select("string", "lp")
    known = contexts[0].agg(F.max("d")).first()[0] or 0
    done.append(pending.select("string", (F.col("lp") - F.log10(F.lit(max(1, ALPHABET - known)))).alias("lp")))
    whole = done[0]
    for part in done[1:]:
        whole = whole.unionByName(part)
    return whole


def scores(docs: DataFrame, learn_from: Column | None = None, order: int = ORDER, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Learn from rows where ``learn_from`` holds (all, if not given) and score every row.

    Per row: key, ``n_tokens`` (words and one end), ``n_known`` (tokens that training has), ``train_tokens``,
    ``base_score`` (log10 probability by counts of single tokens plus one), ``score`` (log10 probability of the whole
    text by the model). Null and empty texts are an end only; repeated rows count and are scored each; a null
    condition counts as false; with nothing to learn from, every byte is equally likely; an empty table gives no
    rows; other columns are not looked at.
    """
    scratch = Scratch(spark_of(docs), "ppm")
    learn = F.lit(True) if learn_from is None else F.coalesce(learn_from, F.lit(False))
    own = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), learn.alias("learn"))
    found = scratch.save(extract(own, order, "key"), codec="zstd")
    asked = found.where("kind = 1").select("block", "string", "seen")
    model = scratch.save(follow(asked.groupBy("string").agg(F.sum("seen").alias("seen")), order, scratch))

    by_word = Window.partitionBy("word")
    in_block = found.where("kind = 2").select("block", "word", F.sum("seen").over(by_word).alias("seen"),
                                              (F.min("block").over(by_word) == F.col("block")).alias("first"))
    in_block = scratch.save(in_block, codec="zstd")
    ends = own.where("learn").count()
    sums = in_block.where("first").agg(F.coalesce(F.sum("seen"), F.lit(0)), F.count(F.when(F.col("seen") > 0, 1))).first()
    tokens, kinds = sums[0] + ends, sums[1] + (ends > 0)

    zero = F.lit(0).cast("long")  # no nulls among numbers: pandas would make them floats
    part = asked.select("block", "string").join(model, "string").select(
        F.col("block").alias("of"), "string", F.col("lp").cast("float").alias("lp"), F.lit(None).cast("binary").alias("word"), zero.alias("seen"))
    part = part.unionByName(in_block.select(F.col("block").alias("of"), zero.alias("string"), F.lit(0).cast("float").alias("lp"), "word", "seen"))

    def score(texts: pa.Table, known: pa.Table) -> pa.Table:
        names, raw = pickle.loads(zstandard.decompress(texts["texts"][0].as_py()))
        of_string = pc.is_null(known["word"])
        given = known.filter(of_string)
        order_of = np.argsort(given["string"].to_numpy())
        every, lp = given["string"].to_numpy()[order_of], given["lp"].to_numpy()[order_of].astype(np.float64)
        total = np.zeros(len(raw))
        for a, b in pieces([len(x) for x in raw], STEP):
            keys, number, owner = strings(raw[a:b], order)
            total[a:b] = np.bincount(owner, lp[np.searchsorted(every, keys)][number], b - a)
        del every, lp, given
        give_back()
        given = known.filter(pc.invert(of_string))
        seen = dict(zip(given["word"].to_pylist(), given["seen"].to_pylist()))
        base, size, hits = [], [], []
        for x in raw:
            counts = np.fromiter(map(seen.__getitem__, x.split()), np.int64)
            counts = np.append(counts, ends)
            base.append(np.log10(counts + 1.0).sum() - len(counts) * np.log10(tokens + kinds + 1))
            size.append(len(counts))
            hits.append((counts > 0).sum())
        del seen
        give_back()
        return pa.table({"key": pa.array(names, named), "n_tokens": pa.array(size, pa.int64()), "n_known": pa.array(hits, pa.int64()),
                         "train_tokens": pa.array([tokens] * len(names), pa.int64()), "base_score": base, "score": total})

    named = to_arrow_type(docs.schema[key].dataType)
    kind = docs.schema[key].dataType.simpleString()
    schema = f"key {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    texts = found.where("kind = 0").select("block", "texts")
    return texts.groupBy("block").cogroup(part.groupBy("of")).applyInArrow(score, schema).withColumnRenamed("key", key)


def query(docs: DataFrame) -> DataFrame:
    part = remainder("doc_id", 7)
    found = scores(docs, part != 2)
    return found.select("doc_id", (part == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
