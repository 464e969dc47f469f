"""Spelling variant grouping: one-edit neighbourhoods of words over a reduced alphabet, verified on the words themselves.

Each letter is hashed to one of ``SYMBOLS`` symbols. Words that differ by one inserted, deleted or replaced letter have
reduced words that are equal or differ by one such edit, so the full one-edit neighbourhood of a reduced word (its
deletions, replacements, insertions and itself), joined with the reduced vocabulary, misses no pair; pairs that only their
reduced words bring together fall away when the words are compared. The small alphabet keeps a neighbourhood at about
``2 SYMBOLS`` entries per letter, where the words' own alphabet would need nearly 200.

A reduced word stands for itself as the 64-bit value of a polynomial: an edit changes it by sums of its first and last
letters, so whole neighbourhoods are numpy sums. Two reduced words of one value only add pairs to verify.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailprism.llm.common import Scratch, give_back

RUN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")  # a-z and U+00C0 to U+00FF in UTF-8
SYMBOLS = 8
BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2 ** 64
HELD_WORDS = 500_000  # distinct words that a task counts before it sends them on
CELLS = 1 << 20  # neighbours that a task holds at once
LENGTH, TIMES, GROWTH = 6, 5, 5  # letters and occurrences of a word; its form occurs GROWTH times as often
DAMAGE = 199


def letters(word: bytes) -> int:
    return len(word) - word.count(b"\xc3")


def without(word: bytes, at: int) -> bytes:
    """``word`` without its letter number ``at``."""
    text = word.decode()
    return (text[:at] + text[at + 1:]).encode()


def counted(shortest: int, damage: int | None, held: int):
    """Words of whole texts (key, bytes) and their numbers of occurrences, added up per task.

    ``damage``: if it divides the crc32 of ``<key>:<run>``, the run loses the letter that the crc32 names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[bytes, int] = {}

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([w.decode() for w in total], pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])
            total.clear()
            return out

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if not text.is_valid:
                    continue
                own: dict[bytes, int] = {}
                for found in RUN.finditer(text.as_buffer().to_pybytes().lower()):
                    word = found.group()
                    if len(word) >= shortest:
                        own[word] = own.get(word, 0) + 1
                start = zlib.crc32(f"{'' if key is None else key}:".encode())
                for word, n in own.items():
                    if damage and (h := zlib.crc32(word, start)) % damage == 0:
                        word = without(word, h % letters(word))
                    if letters(word) >= shortest:
                        total[word] = total.get(word, 0) + n
                if len(total) >= held:
                    yield flush()
        if total:
            yield flush()
        give_back()

    return run


def words(docs: DataFrame, key: str = "doc_id", text: str = "text", shortest: int = LENGTH, times: int = TIMES,
          damage: int | None = None, held: int = HELD_WORDS) -> DataFrame:
    """Maximal runs of the letters A-Z (lowered), a-z and U+00C0 to U+00FF with ``shortest`` letters and ``times``
    occurrences or more in whole texts: word, n. Null texts have none; a null key counts as the empty text."""
    texts = docs.select(F.col(key).cast("string").alias("key"), F.col(text).cast("binary").alias("text"))
    found = texts.mapInArrow(counted(shortest, damage, held), "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= times)


def symbols(word: np.ndarray, count: int) -> np.ndarray:
    """Symbols 1 to ``count`` of code points, by a multiplicative hash."""
    return (((word.astype(np.uint64) * np.uint64(0x9E3779B1)) >> np.uint64(7)) % np.uint64(count) + np.uint64(1)).astype(np.uint64)


def powers(base: int, n: int) -> np.ndarray:
    """1, base, base ** 2, ... modulo 2 ** 64."""
    return np.cumprod(np.array([1, *[base] * n], np.uint64), dtype=np.uint64)


def neighbourhood(s: np.ndarray, count: int, lo: int = 0, hi: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Values of all words one edit or none away from each row of ``s`` (words of one length, symbols 1 to ``count``); edits
    at positions from ``lo`` to ``hi`` only. Second result: which values count (edits that repeat another's result do not)."""
    n, size = s.shape
    hi = size if hi is None else hi
    power = powers(BASE, size + 1)
    back = np.uint64(pow(BASE, -1, 1 << 64))
    terms = s * power[:size]
    ahead = np.concatenate([np.zeros((n, 1), np.uint64), np.cumsum(terms, axis=1, dtype=np.uint64)], axis=1)
    whole = ahead[:, -1:]
    at = np.arange(lo, min(hi, size))
    same = np.zeros((n, size + 1), bool)
    same[:, 1:size] = s[:, 1:] == s[:, :-1]
    parts, use = [], []
    if lo == 0:
        parts.append(whole)
        use.append(np.ones((n, 1), bool))
    parts.append(ahead[:, at] + (whole - ahead[:, at + 1]) * back)  # deletions
    use.append(~same[:, at])
    gaps = np.arange(lo, size + 1 if hi >= size else hi)
    for c in range(1, count + 1):
        c64 = np.uint64(c)
        parts.append(whole + (c64 - s[:, at]) * power[at])  # replacements
        use.append(s[:, at] != c64)
        parts.append(ahead[:, gaps] + c64 * power[gaps] + (whole - ahead[:, gaps]) * np.uint64(BASE))  # insertions
        before = np.concatenate([np.zeros((n, 1), np.uint64), s], axis=1)[:, gaps]
        use.append(before != c64)
    return np.concatenate(parts, axis=1), np.concatenate(use, axis=1)


def values(count: int):
    """Words to their reduced words' values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            reduced = np.zeros(batch.num_rows, np.uint64)
            for rows, s in by_length(batch.column("word").to_pylist(), count):
                reduced[rows] = (s * powers(BASE, s.shape[1])[:s.shape[1]]).sum(axis=1, dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(reduced.view(np.int64))], [*batch.schema.names, "reduced"])

    return run


def by_length(found: list[str], count: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and symbols of the words of each length."""
    sizes = np.array([len(w) for w in found])
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        for part in np.array_split(rows, -(-len(rows) * size // CELLS)):
            points = np.frombuffer("".join(found[k] for k in part).encode("utf-32-le"), np.uint32).reshape(len(part), size)
            yield part, symbols(points, count)


def neighbours(count: int, cells: int):
    """One word of each reduced word to the values of its neighbourhood, in pieces of about ``cells``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column("reduced").to_numpy().view(np.uint64)
            for rows, s in by_length(batch.column("word").to_pylist(), count):
                size = s.shape[1]
                wide = max(1, cells // (2 * count + 2))  # positions of one row that fit
                step = max(1, cells // (min(size, wide) * (2 * count + 2)))
                for a in range(0, len(rows), step):
                    for lo in range(0, size, wide):
                        near, use = neighbourhood(s[a:a + step], count, lo, lo + wide)
                        owner = np.broadcast_to(own[rows[a:a + step], None], near.shape)
                        yield pa.RecordBatch.from_arrays([pa.array(owner[use].view(np.int64)), pa.array(near[use].view(np.int64))], ["reduced", "near"])

    return run


def near_words(vocabulary: DataFrame, scratch: Scratch, count: int = SYMBOLS, cells: int = CELLS) -> DataFrame:
    """All ordered pairs of words one edit apart: word, n, near, near_n. ``vocabulary``: distinct word, n."""
    reduced = scratch.save(vocabulary.mapInArrow(values(count), "word string, n long, reduced long"))
    distinct = scratch.save(reduced.groupBy("reduced").agg(F.min("word").alias("word")))
    around = distinct.mapInArrow(neighbours(count, cells), "reduced long, near long")
    known = distinct.select(F.col("reduced").alias("near"))
    pairs = scratch.save(around.join(known, "near", "left_semi").distinct())
    other = reduced.select(F.col("word").alias("near_word"), F.col("n").alias("near_n"), F.col("reduced").alias("near"))
    met = pairs.join(reduced, "reduced").join(other, "near")
    met = met.where("word <> near_word")
    return met.where(F.levenshtein("word", "near_word", 1) == 1).select("word", "n", F.col("near_word").alias("near"), "near_n")


def roots(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """``forms`` (word, form) followed to the last: word, root. A form occurs more often than its word, so chains end;
    each round doubles the steps."""
    ways = scratch.save(forms.select("word", F.col("form").alias("root"), F.lit(False).alias("still")))
    while True:
        on = ways.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = ways.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("still"))
        ways = scratch.save(moved)
        if ways.where("still").isEmpty():
            return ways.select("word", "root")


def variants(vocabulary: DataFrame, growth: int = GROWTH, count: int = SYMBOLS) -> DataFrame:
    """Each word's form: of its near words (one inserted, deleted or replaced letter) the one of largest n, ties to the
    smallest, if that n is ``growth`` times the word's or more.

    ``vocabulary``: distinct word, n. Returns per word: word, n, n_near (number of near words), form, form_n (null if
    there is none), root (forms followed to the last; the word itself if it has none). Other columns are not looked at;
    an empty table gives no rows. Null words must not occur, as they have no letters.
    """
    scratch = Scratch(vocabulary.sparkSession, "spelling")
    vocabulary = scratch.save(vocabulary.select("word", "n"))
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near"))).alias("best")
    near = near_words(vocabulary, scratch, count).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best)
    joined = vocabulary.join(near, "word", "left").withColumn("formed", -F.col("best.less") >= growth * F.col("n"))
    judged = scratch.save(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                                        F.when(F.col("formed"), F.col("best.near")).alias("form"), F.when(F.col("formed"), -F.col("best.less")).alias("form_n")))
    ends = roots(judged.where("form IS NOT NULL").select("word", "form"), scratch)
    return judged.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def query(docs: DataFrame) -> DataFrame:
    """Variants among the words of whole texts, some damaged by their crc32. Null texts have no words, a null id counts as the
    empty text, repeated rows count as often as they stand there."""
    return variants(words(docs, damage=DAMAGE))
