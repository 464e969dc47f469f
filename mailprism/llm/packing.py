"""Packing: token sequences of documents cut into windows and put together best-fit decreasing."""

from __future__ import annotations

import base64
import json
import os
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailprism.llm.common import give_back, pieces as stretches

VOCABULARY = "byte_bpe_50k"  # the same tokens as .json (ids by merges) and .tiktoken (ids by ranks)
END = 0  # id after every document
WINDOW = 1024
HELD = 20_000  # pieces that are packed against each other
COPIED = 2_000  # packed pieces that are put in order at a time


def added_tokens(path: str) -> tuple[tuple[str, int], ...]:
    """Texts and ids of the added tokens in the .json file beside a ranks file; none if there is no such file."""
    place = f"{os.path.splitext(path)[0]}.json"
    if not os.path.exists(place):
        return ()
    with open(place, encoding="utf-8") as file:
        return tuple((x["content"], x["id"]) for x in json.load(file)["added_tokens"])


@lru_cache(maxsize=2)
def encoder(path: str, added: tuple[tuple[str, int], ...] = ()) -> tiktoken.Encoding:
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=dict(added))


class Words:
    """Ids (little-endian 32 bit) of whole texts, each in one call: looking runs up one by one costs more than it saves where words are new.

    ``added``: tokens that a text is cut at before all else.
    """

    def __init__(self, path: str, added: tuple[tuple[str, int], ...] = ()):
        self.encode = partial(encoder(path, added).encode_to_numpy, allowed_special="all", disallowed_special=())

    def text(self, text: str) -> bytes:
        return self.encode(text).astype("<u4").tobytes() if text else b""


@lru_cache(maxsize=2)
def words_of(path: str, added: tuple[tuple[str, int], ...]) -> Words:
    return Words(path, added)


def token_pieces(docs: DataFrame, window: int = WINDOW, key: str = "doc_id", text: str = "text",
                 path: str | None = None) -> DataFrame:
    """Tokenise and cut: per piece of at most ``window`` ids key, start, length, doc_tokens, ids (little-endian 32 bit).

    A document's ids end with one id 0. It is cut from its start into full windows; what is left is its last
    piece. A null or empty text has the end id only. ``path``: the ranks file of the tokenizer. The literal text of
    an added token gets that token's id, as the tokenizer's own call gives it.
    """
    place = path or public_tokenizers.path(f"{VOCABULARY}.tiktoken")
    added = added_tokens(place)

    @F.pandas_udf("binary")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        give_back()  # what earlier tasks of this worker have freed
        words = words_of(place, added)
        for batch in batches:
            for a, b in stretches([len(x or "") for x in batch]):
                yield pd.Series([words.text(x) + END.to_bytes(4, "little") for x in batch.iloc[a:b]])
                give_back()

    ids = docs.select(F.col(key).alias("key"), encode(F.col(text)).alias("all")).withColumn("doc_tokens", (F.length("all") / 4).cast("long"))
    starts = F.sequence(F.lit(0).cast("long"), F.col("doc_tokens") - 1, F.lit(window).cast("long"))
    cut = ids.select("key", "doc_tokens", "all", F.explode(starts).alias("start"))
    part = F.substring(F.col("all"), (4 * F.col("start") + 1).cast("int"), F.lit(4 * window))
    return cut.select(F.col("key").alias(key), "start", F.least(F.lit(window).cast("long"), F.col("doc_tokens") - F.col("start")).alias("length"),
                      "doc_tokens", part.alias("ids"))


class Capacity:
    """Segment tree over remaining capacities: which open window fits a length most tightly."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.open = [[] for _ in range(window + 1)]
        self.filled = bytearray(2 * self.leaves)  # 1: some window of this range of capacities is open

    def put(self, capacity: int, number: int) -> None:
        self.open[capacity].append(number)
        at = capacity + self.leaves
        while at and not self.filled[at]:
            self.filled[at] = 1
            at >>= 1

    def take(self, length: int) -> tuple[int, int] | None:
        """(capacity, window) of the open window with the least capacity of at least ``length``."""
        at = length + self.leaves
        if not self.filled[at]:
            while at > 1 and (at & 1 or not self.filled[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.leaves:
                at = 2 * at if self.filled[2 * at] else 2 * at + 1
        capacity = at - self.leaves
        number = self.open[capacity].pop()
        if not self.open[capacity]:
            while at and not (at < self.leaves and (self.filled[2 * at] or self.filled[2 * at + 1])):
                self.filled[at] = 0
                at >>= 1
        return capacity, number


def best_fit(lengths: list[int], window: int) -> list[tuple[int, int]]:
    """(window number, offset) of lengths given in decreasing order."""
    tree, out, opened = Capacity(window), [], 0
    for length in lengths:
        found = tree.take(length)
        if found is None:
            found, opened = (window, opened), opened + 1
        capacity, number = found
        out.append((number, window - capacity))
        if capacity > length:
            tree.put(capacity - length, number)
    return out


def assign(pieces: DataFrame, documents: int, window: int = WINDOW) -> DataFrame:
    """Add sequence_id and offset to pieces (any columns with a ``length`` of 1 to ``window``).

    Full windows are sequences by themselves and pass at once. The others are spread round robin, so that no
    key can gather in one task, and packed best-fit decreasing in runs of ``HELD``: enough of them that hardly
    any room is left. Sequence ids are unique over all tasks. Offsets have no gaps; equal lengths keep the
    order of arrival, any order being as good.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 36
        give_back()

        def placed(part: pa.Table, sequences: list[int], offsets: list[int]) -> list[pa.RecordBatch]:
            added = part.append_column("sequence_id", pa.array(sequences, pa.int64())).append_column("offset", pa.array(offsets, pa.int64()))
            return added.to_batches()

        def packed(held: list[pa.Table]) -> Iterator[pa.RecordBatch]:
            nonlocal number
            part = pa.concat_tables(held)
            held.clear()
            lengths = part["length"].to_numpy()
            order = np.argsort(-lengths, kind="stable")
            where = best_fit(lengths[order].tolist(), window)
            first, number = number, number + max(a for a, _ in where) + 1
            for at in range(0, len(order), COPIED):
                some = where[at:at + COPIED]
                yield from placed(part.take(order[at:at + COPIED]), [first + a for a, _ in some], [b for _, b in some])

        held: list[pa.Table] = []
        for batch in batches:
            whole = pa.Table.from_batches([batch])
            full = pc.equal(whole["length"], window)
            alone = whole.filter(full)
            yield from placed(alone, list(range(number, number + len(alone))), [0] * len(alone))
            number += len(alone)
            held.append(whole.filter(pc.invert(full)))
            if sum(map(len, held)) >= HELD:
                yield from packed(held)
                give_back()
        if any(map(len, held)):
            yield from packed(held)
        give_back()

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"
    return pieces.repartition(max(1, -(-documents // HELD))).mapInArrow(run, schema)


def pack(docs: DataFrame, window: int = WINDOW, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """Sequences of at most ``window`` tokens from whole documents, with little padding.

    Per piece: key, start, length, doc_tokens, ids, sequence_id, offset. Each id lies in exactly one piece.
    Null and empty texts give one piece of one id, repeated rows are packed each, an empty table gives no
    rows, other columns are not looked at, so they may have any names; a null key stays null.
    """
    return assign(token_pieces(docs, window, key, text, path), docs.count(), window)


def packed_digest(docs: DataFrame) -> DataFrame:
    """``pack`` with a checksum in place of the ids."""
    cut = token_pieces(docs).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return assign(cut, docs.count()).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
