"""Conversation structure repair: weighted interval parsing with a grammar of edits, combined bottom-up by span length.

A repaired conversation has the role initials ``(s?(ua)+)?``. The grammar is in Chomsky normal form over the states of
that pattern (0 start, 1 after s, 2 after u, 3 after a): ``N[p,q]`` stands for all edits of a span that lead from state
p to state q, with ``N[p,q] -> N[p,r] N[r,q]`` for every r and one terminal rule per edit of a row. A cell of the chart
holds the least (cost, audit) of its span; rows' cells are closed under insertions on both sides. As the binary rules
hold for every state, any cut of a span gives the same cell, so the chart needs the spans of halves only: n rows take
n - 1 combinations, and spans of different tasks combine like those of one.

Order of rows: turn (null first), then role, then the text's hash. Rows equal in all of these are copies.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from mailprism.llm.common import Scratch, remainder

KEEP, REROLE, DELETE, INSERT, CUT = 0, 3, 4, 3, 3  # costs; CUT: of a truncated row that stays
CHUNK = 4096  # rows of a conversation that a task holds at once
CHUNK_CHARS = 8 << 20  # and their characters
FAN = 64  # spans that become one in a round
BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"
STATES = {"s": ((0, 1),), "u": ((0, 2), (1, 2), (3, 2)), "a": ((2, 3),)}
PAIRS = ((0, 0), (0, 1), (0, 2), (0, 3), (1, 1), (1, 2), (1, 3), (2, 2), (2, 3), (3, 2), (3, 3))
RULES = tuple((PAIRS.index((p, q)), tuple((PAIRS.index((p, r)), PAIRS.index((r, q))) for r in range(4) if (p, r) in PAIRS and (r, q) in PAIRS)) for p, q in PAIRS)
NAMES = {"u": "user", "a": "assistant"}

Cells = tuple  # per entry of PAIRS: (cost, audit) or None


def least(found):
    """The cheapest cell; of equal costs the audit that is least in ASCII order."""
    return min((x for x in found if x is not None), default=None)


def combine(left: Cells, right: Cells) -> Cells:
    """Binary rules: the cells of two adjacent spans as those of the whole."""
    out = []
    for _, ways in RULES:
        best = None
        for i, j in ways:
            x, y = left[i], right[j]
            if x is not None and y is not None:
                both = (x[0] + y[0], x[1] + y[1])
                if best is None or both < best:
                    best = both
        out.append(best)
    return tuple(out)


def closure() -> Cells:
    """Cells of the empty span: insertions of user and assistant rows alone."""
    step = [(0, "") if p == q else None for p, q in PAIRS]
    for role in "ua":
        for pair in STATES[role]:
            step[PAIRS.index(pair)] = (INSERT, "I")
    cells = tuple(step)
    while (further := combine(cells, cells)) != cells:
        cells = further
    return cells


EMPTY = closure()


@lru_cache(maxsize=64)
def leaf(code: str) -> Cells:
    """Cells of a row. Code: its role's initial (``x``: none of the pattern's), upper case if truncated, ``d`` if it must go."""
    cells = [(DELETE, "D") if p == q else None for p, q in PAIRS]
    if code != "d":
        extra = CUT if code.isupper() else 0
        for role, moves in STATES.items():
            for pair in moves:
                at = PAIRS.index(pair)
                keep = (KEEP + extra, "K") if role == code.lower() else None
                other = (REROLE + extra, "R") if role in NAMES else None
                cells[at] = least((cells[at], keep, other))
    return combine(combine(EMPTY, tuple(cells)), EMPTY)


def chart(codes: str) -> Cells:
    """Cells of a span of rows, from spans of one row upwards."""
    return short_chart(codes) if len(codes) <= 32 else combined([short_chart(codes[i:i + 32]) for i in range(0, len(codes), 32)])


@lru_cache(maxsize=1 << 16)
def short_chart(codes: str) -> Cells:
    return combined([leaf(c) for c in codes])


def combined(spans: list[Cells]) -> Cells:
    """Adjacent spans joined two by two, level by level."""
    while len(spans) > 1:
        spans = [combine(*spans[i:i + 2]) if i + 1 < len(spans) else spans[i] for i in range(0, len(spans), 2)]
    return spans[0] if spans else EMPTY


def solution(cells: Cells) -> tuple[int, str]:
    """Cheapest edits of a whole conversation: from the start to the start (nothing is left) or to after an assistant."""
    return least((cells[PAIRS.index((0, 0))], cells[PAIRS.index((0, 3))]))


def applied(edits: str, rows: Iterator[tuple[str, str]], at: int, odd: bool) -> Iterator[tuple[int, str, str]]:
    """Repaired (position, role, text) of a span: its edits, its rows, the position of its first line; ``odd``: the whole has an odd number of lines, so that it begins with s."""
    for e in edits:
        role, text = next(rows) if e != "I" else ("", "")
        if e == "D":
            continue
        if e != "K":
            role = NAMES["ua"[(at - odd) % 2]]
        yield at, role, text
        at += 1


class Span:
    """Facts of adjacent rows that add up with those of the next span."""

    FIELDS = "n long, blank long, duplicate long, truncated long, illegal long, first string, last string, low long, high long, turns long"

    def __init__(self, n=0, blank=0, duplicate=0, truncated=0, illegal=0, first=None, last=None, low=None, high=None, turns=0):
        self.n, self.blank, self.duplicate, self.truncated, self.illegal = n, blank, duplicate, truncated, illegal
        self.first, self.last, self.low, self.high, self.turns = first, last, low, high, turns

    def add(self, other: Span) -> None:
        if other.n == 0:
            return
        if self.n:
            self.illegal += self.last + other.first not in ("su", "ua", "au")
        else:
            self.first = other.first
        self.last = other.last
        if other.low is not None:
            self.turns += other.turns - (self.high is not None and self.high == other.low)
            self.low = other.low if self.low is None else self.low
            self.high = other.high
        for k in ("n", "blank", "duplicate", "truncated", "illegal"):
            setattr(self, k, getattr(self, k) + getattr(other, k))


FACTS = ["n", "blank", "duplicate", "truncated", "illegal", "first", "last", "low", "high", "turns"]
CELLS = "cells array<struct<cost:long,audit:string>>"
SPANS = f"conv_id long, part long, {Span.FIELDS}, {CELLS}"
PARSED = f"{SPANS}, whole boolean, at long, role string, text string, code string, sha string"
SLICES = "conv_id long, part long, at long, role string, text string, code string"
LINES = "conv_id long, position long, role string, text string"


def pack(cells: Cells) -> list:
    return [None if c is None else {"cost": c[0], "audit": c[1]} for c in cells]


def unpack(cells) -> Cells:
    return tuple(None if c is None else (c["cost"], c["audit"]) for c in cells)


def facts_of(span: Span) -> dict:
    return {k: getattr(span, k) for k in FACTS}


def map_rows(df: DataFrame, step: Callable[[Iterator[dict]], Iterator[dict]], schema: str) -> DataFrame:
    """``step`` over the rows of each task as dicts, in their order; results leave in batches of bounded size."""
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for row in step(row for batch in batches for row in batch.to_pylist()):
            held.append(row)
            size += 100 + len(row.get("text") or "")
            if size > 1 << 20:
                yield pa.RecordBatch.from_pylist(held, schema=arrow)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=arrow)

    return df.mapInArrow(run, schema)


def parse(chunk: int, chars: int) -> Callable:
    """Sorted rows to spans. A conversation that begins and ends inside the task and fits one chunk is settled here: one
    row with ``whole`` set, and its lines. Of the others come spans with cells (``part`` orders them) and their rows."""

    def run(rows: Iterator[dict]) -> Iterator[dict]:
        part = TaskContext.get().partitionId() << 40
        conv, begun, any_row = None, True, False  # begun: rows of this conversation may stand before this span
        span, codes, held, size = Span(), [], [], 0
        seen = None  # key, truncation and text of the last first row

        def flush(ended: bool) -> Iterator[dict]:
            nonlocal part, span, codes, held, size, begun
            cells = chart("".join(codes))
            whole = ended and not begun
            head = {"conv_id": conv, "part": part, "whole": whole}
            if whole:
                cost, audit = solution(cells)
                odd = (len(audit) - audit.count("D")) % 2 == 1
                lines = list(applied(audit, iter(held), 0, odd))
                sha = hashlib.sha256("\n".join(f"{r}:{t}" for _, r, t in lines).encode("utf-8", "surrogatepass")).hexdigest()
                yield head | facts_of(span) | {"cells": pack([(cost, audit)]), "sha": sha}
                for k, role, text in lines:
                    yield head | {"at": k, "role": role, "text": text}
            else:
                yield head | facts_of(span) | {"cells": pack(cells)}
                for k, (role, text) in enumerate(held):
                    yield head | {"at": k, "role": role, "text": text, "code": codes[k]}
            part, begun = part + 1, True
            span, codes, held, size = Span(), [], [], 0

        for row in rows:
            if not any_row:
                conv, any_row = row["conv_id"], True
            elif row["conv_id"] != conv:
                yield from flush(True)
                conv, begun = row["conv_id"], False
            key = (conv, row["turn"], row["role"], row["digest"])
            if row["kind"] == 0:  # the first row of its role and text; the row itself follows
                seen = (key, row["cut"], row["text"])
                continue
            known = seen is not None and seen[0] == key
            for copy in range(row["n"]):
                fault = "blank" if row["blank"] else "duplicate" if copy or not known else "truncated" if seen[1] else None
                first = row["role"][:1]
                span.add(Span(1, *(int(fault == k) for k in ("blank", "duplicate", "truncated")), 0, first, first, row["turn"], row["turn"], int(row["turn"] is not None)))
                code = first if first and first in "sua" else "x"
                codes.append("d" if fault in ("blank", "duplicate") else code.upper() if fault else code)
                held.append((row["role"], "" if codes[-1] == "d" else seen[2]))
                size += len(held[-1][1])
                if len(held) >= chunk or size >= chars:
                    yield from flush(False)
        if any_row:
            yield from flush(False)

    return run


def merge(rows: Iterator[dict]) -> Iterator[dict]:
    """Adjacent spans of one conversation and rank, sorted by ``part``, to one span."""
    for (conv, rank), group in groupby(rows, key=lambda row: (row["conv_id"], row["rank"])):
        span, held, part = Span(), [], None
        for row in group:
            part = row["part"] if part is None else part
            span.add(Span(*(row[k] for k in FACTS)))
            held.append(unpack(row["cells"]))
            if len(held) >= FAN:
                held = [combined(held)]
        yield {"conv_id": conv, "rank": rank, "part": part, **facts_of(span), "cells": pack(combined(held))}


def solve(rows: Iterator[dict]) -> Iterator[dict]:
    for row in rows:
        yield row | {"cells": pack([solution(unpack(row["cells"]))])}


def slices(rows: Iterator[dict]) -> Iterator[dict]:
    """The edits of each span, cut from those of its conversation by the spans' numbers of rows."""
    for row in rows:
        audit, start, line = row["audit"], 0, 0
        odd = (len(audit) - audit.count("D")) % 2 == 1
        for k, p in enumerate(row["parts"]):
            end, left = start, p["n"]
            while left:
                left -= audit[end] != "I"
                end += 1
            if k == len(row["parts"]) - 1:
                end = len(audit)
            edits = audit[start:end]
            yield {"conv_id": row["conv_id"], "part": p["part"], "at": -1, "role": edits, "text": str(line), "code": "odd" if odd else "even"}
            start, line = end, line + len(edits) - edits.count("D")


def edited(rows: Iterator[dict]) -> Iterator[dict]:
    """Rows of spans, each span headed by its edits (at -1), to repaired lines."""
    for head in rows:
        left = ((row["role"], row["text"]) for row in rows)
        for k, role, text in applied(head["role"], left, int(head["text"]), head["code"] == "odd"):
            yield {"conv_id": head["conv_id"], "position": k, "role": role, "text": text}


def hashed(rows: Iterator[dict]) -> Iterator[dict]:
    """SHA-256 of each conversation's lines, which come in order; one line is held at a time."""
    for conv, lines in groupby(rows, key=lambda row: row["conv_id"]):
        sha, mark = hashlib.sha256(), ""
        for row in lines:
            sha.update(f"{mark}{row['role']}:{row['text']}".encode("utf-8", "surrogatepass"))
            mark = "\n"
        yield {"conv_id": conv, "sha": sha.hexdigest()}


def damaged(turns: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text, n) after the damage that crc32(``conv_id:turn``) % 20 names: 0 drops a row (n is 0),
    1 empties its text, 2 removes ``[.!?]``, 3 repeats it, 4 makes it the user's. Null roles, texts, and null ids and
    turns in that key count as one space."""
    blank = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                        F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"), remainder(key, 20).alias("h"))
    text = F.when(F.col("h") == 1, "").when(F.col("h") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("h") == 4, "user").otherwise(F.col("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(F.col("h") == 0, 0).when(F.col("h") == 3, 2).otherwise(1).alias("n"))


def trimmed(text: str) -> Column:
    return F.rtrim(F.col(text), F.lit(BLANKS))


class Repair:
    """Repaired conversations of a table (conv_id, turn, role, text, and n, the number of copies of a row).

    A row's first fault counts: blank (no character besides ASCII white space), duplicate (role and text seen earlier in the
    conversation), truncated (its last such character is none of ``.!?``). Blank and duplicate rows are deleted. A row of
    n 0 only names its conversation. Null ids are one conversation, null turns stand first and do not count as gaps.

    ``summary``: conv_id, gaps, blank, duplicate, truncated, illegal (adjacent role initials other than su, ua, au), cost,
    audit, repaired_sha256; a conversation without rows has zeros, an empty audit and the hash of the empty text.
    ``lines``: conv_id, position, role, text of the repaired rows. Repeated rows are copies; an empty table gives empty tables.

    No conversation is gathered in one task: rows are spread by ranges of (conv_id, turn, role, hash), so a long one lies
    in many tasks, which return spans; these are combined in rounds of ``FAN``, and each span gets back its part of the edits.
    Only the hash of a conversation longer than a chunk is taken in one task, line by line, as SHA-256 reads its input in order.
    """

    def __init__(self, rows: DataFrame, chunk: int = CHUNK, chars: int = CHUNK_CHARS):
        spark = rows.sparkSession
        self.scratch = scratch = Scratch(spark, "repair")
        rest = trimmed("text")
        cut = ~F.substring(rest, -1, 1).isin(".", "!", "?")
        known = rows.select("conv_id", "turn", "role", F.unhex(F.sha2("text", 256)).alias("digest"), "n", (rest == "").alias("blank"), cut.alias("cut"), "text")
        keys = ["conv_id", "turn", "role", "digest"]
        none = F.lit(None)
        present = known.select("conv_id", *[F.when(F.col("n") > 0, F.col(k)).alias(k) for k in ("turn", "role", "digest")], "n", "blank")
        light = present.groupBy(keys).agg(F.sum("n").cast("long").alias("n"), F.max("blank").alias("blank"))
        light = light.select(*keys, F.lit(1).alias("kind"), "n", "blank", none.cast("boolean").alias("cut"), none.cast("string").alias("text"))
        order = F.struct(F.col("turn").isNotNull().alias("some"), "turn")
        fresh = known.where("n > 0 AND NOT blank").groupBy("conv_id", "role", "digest", "text", "cut").agg(F.min(order).alias("o"))
        fresh = fresh.select("conv_id", F.col("o.turn").alias("turn"), "role", "digest", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("n"), F.lit(False).alias("blank"), "cut", "text")
        rows = light.unionByName(fresh)
        placed = rows.repartitionByRange(*keys).sortWithinPartitions(*keys, "kind")
        self.parsed = scratch.save(map_rows(placed, parse(chunk, chars), PARSED))
        self.parts = self.parsed.where("NOT whole AND cells IS NOT NULL").select("conv_id", "part", *FACTS, "cells")
        self.settled = self.combined_parts()

    def combined_parts(self) -> DataFrame:
        """Spans of open conversations to one each: in every round, up to ``FAN`` neighbours to one. Only (conversation, part) is numbered
        in a window; spans are large, numbers are not."""
        ranks = self.parts.select(F.col("part").alias("p"), F.expr("row_number() OVER (PARTITION BY conv_id ORDER BY part) - 1").cast("long").alias("rank"))
        ranks = self.scratch.save(ranks)
        last = ranks.agg(F.coalesce(F.max("rank"), F.lit(0))).first()[0]
        spans = self.parts.join(ranks, F.col("part") == F.col("p")).drop("p")
        while True:
            spans = spans.withColumn("rank", F.floor(F.col("rank") / FAN))
            met = spans.repartition("conv_id", "rank").sortWithinPartitions("conv_id", "rank", "part")
            spans, last = self.scratch.save(map_rows(met, merge, f"{SPANS}, rank long")), last // FAN
            if last == 0:
                return spans.drop("rank")

    def open_audits(self) -> DataFrame:
        cell = F.col("cells")[0]
        return map_rows(self.settled, solve, SPANS).select("conv_id", *FACTS, cell["cost"].alias("cost"), cell["audit"].alias("audit"))

    def open_lines(self) -> DataFrame:
        parts = self.parts.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("part", "n"))).alias("parts"))
        edits = self.open_audits().select("conv_id", "audit").join(parts.withColumnRenamed("conv_id", "c"), F.col("conv_id").eqNullSafe(F.col("c")))
        cut = map_rows(edits.select("conv_id", "audit", "parts"), slices, SLICES)
        rows = self.parsed.where("NOT whole AND cells IS NULL").select("conv_id", "part", "at", "role", "text", "code")
        spread = rows.unionByName(cut).repartition("conv_id", "part").sortWithinPartitions("conv_id", "part", "at")
        return map_rows(spread, edited, LINES)

    def lines(self) -> DataFrame:
        closed = self.parsed.where("whole AND cells IS NULL").select("conv_id", F.col("at").alias("position"), "role", "text")
        return closed.unionByName(self.open_lines())

    def summary(self) -> DataFrame:
        gaps = F.when(F.col("low").isNull(), 0).otherwise(F.col("high") - F.col("low") + 1 - F.col("turns")).alias("gaps")
        facts = ["conv_id", gaps, "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
        cell = F.col("cells")[0]
        closed = self.parsed.where("whole AND cells IS NOT NULL").withColumns({"cost": cell["cost"], "audit": cell["audit"]}).select(*facts, F.col("sha").alias("repaired_sha256"))
        ordered = self.open_lines().repartition("conv_id").sortWithinPartitions("conv_id", "position")
        shas = map_rows(ordered, hashed, "conv_id long, sha string").withColumnRenamed("conv_id", "c")
        found = self.open_audits().join(shas, F.col("conv_id").eqNullSafe(F.col("c")), "left")
        opened = found.select(*facts, F.coalesce("sha", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))
        return closed.unionByName(opened)


def query(turns: DataFrame) -> DataFrame:
    """Damaged conversations, repaired: the summary of every conversation of ``turns``."""
    return Repair(damaged(turns)).summary()
