"""Spelling variants, conversation repair and nearest neighbours against plain versions."""

import random
import re
import zlib
from collections import Counter, defaultdict
from hashlib import sha256
from itertools import product

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from llm_data import docs_of, edges, frame, nothing  # noqa: F401
from mailprism.llm import neighbours, repair, spelling


def plain_words(rows):
    total = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{word}".encode())
            if h % 199 == 0:
                word = word[:h % len(word)] + word[h % len(word) + 1:]
            total[word] += 1
    return {w: n for w, n in total.items() if len(w) >= 6 and n >= 5}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a != b and (a[k + 1:] == b[k + 1:] if len(a) == len(b) else len(b) - len(a) == 1 and a[k:] == b[k + 1:])


def plain_variants(words):
    near = {w: [x for x in words if one_edit(w, x)] for w in words}
    form = {}
    for w, others in near.items():
        top = min(others, key=lambda x: (-words[x], x), default=None)
        if top is not None and words[top] >= 5 * words[w]:
            form[w] = top
    out = set()
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n, len(near[w]), words.get(form.get(w))))
    return out


def texts_of(counts):
    return [" ".join(w for w, n in counts.items() for _ in range(n))]


WORDS = {"letters": 900, "leters": 130, "leterz": 9, "letter": 20, "lettter": 25, "lettrs": 5, "Letters": 3, "écoles": 60, "écolés": 12, "ecoles": 6, "aaaaaa": 40, "aaaaaaa": 8, "aaaaa": 99,
         "ab×cdef": 9, "abcdef": 50, "abcdefg": 10, "abcdegf": 10, "x" * 70: 30, "x" * 69 + "y": 6, "x" * 71: 6}


def test_spelling_against_plain_loops(docs_of):
    rng = random.Random(1)
    bag = [w for w, n in WORDS.items() for _ in range(n)]
    for _ in range(1500):  # short words over three letters: many share their reduced word and many are near
        word = "".join(rng.choice("abc") for _ in range(rng.choice([6, 6, 7])))
        bag += [word] * rng.choice([1, 3, 8, 60])
    rng.shuffle(bag)
    rows = [(k, "1 ".join(bag[k::40])) for k in range(40)] + [(None, "letters " * 9), (50, None), (51, "")]
    got = {tuple(r) for r in spelling.query(docs_of(rows)).select("word", "form", "root", "n", "n_near", "form_n").collect()}
    want = plain_variants(plain_words(rows))
    assert got == want and len(want) > 300
    assert any(r[1] and r[1] != r[2] for r in want)  # a chain of forms


def test_spelling_in_small_pieces(frame):
    from mailprism.llm.common import Scratch

    words = {"".join(p): 5 for p in product("ab", repeat=7)} | {"a" * 300: 5, "a" * 150 + "b" + "a" * 149: 5}
    vocabulary = frame(list(words.items()), "word string, n long")
    pairs = spelling.near_words(vocabulary, Scratch(vocabulary.sparkSession, "t"), count=2, cells=64).collect()
    assert sorted((r["word"], r["near"]) for r in pairs) == sorted((a, b) for a in words for b in words if one_edit(a, b))


def test_spelling_edges(edges, nothing, docs_of):
    assert spelling.query(nothing).collect() == []
    assert spelling.variants(spelling.words(edges)).select("word", "n", "root").collect() == []  # no word of six letters occurs five times
    again = docs_of([(1, "Repeat repeat")] * 3)
    assert [tuple(r) for r in spelling.words(again).collect()] == [("repeat", 6)]
    long = docs_of([(1, "y" * 20_000 + " ")] * 5)
    assert [(len(r["word"]), r["n_near"]) for r in spelling.variants(spelling.words(long)).collect()] == [(20_000, 0)]


def plain_repair(rows):
    """Least cost and audit by steps along the rows; lists of lines ride along."""
    moves = [(0, 1, "s"), (0, 2, "u"), (1, 2, "u"), (3, 2, "u"), (2, 3, "a")]
    name = {"u": "user", "a": "assistant"}

    def insert(paths):
        while True:
            more = dict(paths)
            for p, q, role in moves:
                if role in name and p in paths:
                    cost, audit, lines = paths[p]
                    more[q] = min(more.get(q, (10**9,)), (cost + 3, audit + "I", [*lines, f"{name[role]}:"]))
            if more == paths:
                return paths
            paths = more

    seen, faults, paths = set(), Counter(), insert({0: (0, "", [])})
    for role, text in rows:
        letters = text.strip(" \t\n\v\f\r")
        fault = "blank" if not letters else "duplicate" if (role, text) in seen else "truncated" if letters[-1] not in ".!?" else ""
        seen.add((role, text))
        faults[fault] += 1
        after = {p: (cost + 4, audit + "D", lines) for p, (cost, audit, lines) in paths.items()}
        if fault not in ("blank", "duplicate"):
            for p, q, mark in moves:
                if p in paths:
                    cost, audit, lines = paths[p]
                    cost += 3 * (fault == "truncated")
                    ways = [(cost, audit + "K", [*lines, f"{role}:{text}"])] if role[:1] == mark else []
                    ways += [(cost + 3, audit + "R", [*lines, f"{name[mark]}:{text}"])] if mark in name else []
                    if ways:
                        after[q] = min([after.get(q, (10**9,)), *ways])
        paths = insert(after)
    cost, audit, lines = min(paths[p] for p in (0, 3) if p in paths)
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, sha256("\n".join(lines).encode()).hexdigest(), lines


def damaged(rows):
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        out[conv] += [(turn, "user" if h == 4 else role, text)] * (0 if h == 0 else 2 if h == 3 else 1)
    return out


def plain_summary(rows):
    want = {}
    for conv, turns in damaged(rows).items():
        turns.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], sha256(r[2].encode()).digest()))
        known = {t for t, _, _ in turns if t is not None}
        gaps = max(known) - min(known) + 1 - len(known) if known else 0
        want[conv] = (gaps, *plain_repair([r[1:] for r in turns])[:7])
    return want


TURNS = "conv_id long, turn long, role string, text string, n int, cells string, part long"
SUMMARY = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def conversations(seed, convs=60):
    rng = random.Random(seed)
    rows = []
    for conv in [None, *range(convs - 2), 2**60 + 1]:
        for k in range(rng.choice([0, 1, 1, 2, 4, 7, 12])):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", None, "", "tool"])
            text = rng.choice(["One.", "Two!", "three", "Four? \n", "", " \t", None, "é .", f"{k}."])
            rows.append((conv, rng.choice([k, k, k, k + 2, None, 2**60 + k]), role, text))
    rows += [(7777, k, ("user", "assistant")[k % 2], "Same." if k % 3 else f"turn {k}.") for k in range(300)]
    rows += [(7778, 5, "user", "A copy.")] * 50
    return rows


@pytest.mark.parametrize("chunk", [1, 3, 1000])
def test_repair_against_plain_steps(frame, chunk, monkeypatch):
    if chunk == 1:
        monkeypatch.setattr(repair, "FAN", 3)  # several rounds
    rows = conversations(chunk)
    turns = frame([(*r, 9, "x", 1) for r in rows], TURNS)
    done = repair.Repair(repair.damaged(turns), chunk=chunk)
    want = plain_summary(rows)
    got = {r["conv_id"]: tuple(r[c] for c in SUMMARY) for r in done.summary().collect()}
    assert got == want
    lines = defaultdict(list)
    for r in sorted(done.lines().collect(), key=lambda r: r["position"]):
        assert r["position"] == len(lines[r["conv_id"]])
        lines[r["conv_id"]].append(f"{r['role']}:{r['text']}")
    for conv, row in want.items():
        assert sha256("\n".join(lines[conv]).encode()).hexdigest() == row[-1]


def test_repair_edges(frame):
    none = frame([], TURNS)
    done = repair.Repair(repair.damaged(none))
    assert done.summary().collect() == [] and done.lines().collect() == []
    dropped = next(k for k in range(100) if zlib.crc32(f"{k}:1".encode()) % 20 == 0)
    rows = repair.query(frame([(dropped, 1, "user", "Gone.", 9, "x", 1)], TURNS)).collect()
    assert [tuple(r) for r in rows] == [(dropped, 0, 0, 0, 0, 0, 0, "", sha256(b"").hexdigest())]
    long = repair.damaged(frame([(1, 1, "user", "long " * 100_000 + ".", 9, "x", 1)], TURNS)).withColumn("n", repair.F.lit(1))
    assert [r["audit"] for r in repair.Repair(long).summary().collect()] == ["KI"]


def cells_of(codes):
    """The whole chart: every span from every cut of it."""
    cells = {(i, i + 1): repair.leaf(c) for i, c in enumerate(codes)}
    for size in range(2, len(codes) + 1):
        for i in range(len(codes) - size + 1):
            ways = [repair.combine(cells[i, k], cells[k, i + size]) for k in range(i + 1, i + size)]
            assert len(set(ways)) == 1  # any cut gives the same cell
            cells[i, i + size] = ways[0]
    return cells[0, len(codes)]


@given(st.text("suaxSUAXd", min_size=1, max_size=9))
@settings(max_examples=40, deadline=None)
def test_halves_are_enough(codes):
    assert repair.chart(codes) == cells_of(codes)


def plain_nearest(rows, asked, k):
    out = []
    for q, x in asked:
        found = sorted((-neighbours.cosine(np.array([x]), np.array([y]))[0], i is None, i, tuple(y)) for i, y in {(i, tuple(y)) for i, y in rows}
                       if len(y) == len(x) and not (i is not None and i == q))
        out += [(q, r + 1, i, -s) for r, (s, _, i, _) in enumerate(found[:k])]
    return sorted(out, key=str)


VECTORS = "vec_id long, embedding array<double>, label int, h string, dim string, region string, kth string"


@pytest.mark.parametrize("size", [dict(), dict(shard=64, sample=400, block=4)])
def test_neighbours_against_brute_force(frame, size):
    rng = np.random.default_rng(5)
    middle = rng.normal(size=(8, 12))
    rows = [(k, (middle[k % 8] + 0.2 * rng.normal(size=12)).tolist()) for k in range(700)]
    rows += [(1000 + k, rows[3][1]) for k in range(300)]  # one vector many times
    rows += [(2000 + k, [1.0, float(k % 3), 2.0]) for k in range(10)]
    rows += [(None, rows[5][1]), (2**60 + 1, rows[5][1]), (rows[6][0], rows[6][1])]
    df = frame([(*r, 1, "x", "y", "z", "w") for r in rows], VECTORS)
    asked = df.where("vec_id % 50 = 0")
    got = sorted((tuple(r) for r in neighbours.nearest(df, asked, **size).collect()), key=str)
    assert got == plain_nearest(rows, [r for r in rows if r[0] is not None and r[0] % 50 == 0], 5)


def test_a_larger_factor_keeps_most(frame):
    rng = np.random.default_rng(6)
    rows = [(k, rng.normal(size=24).tolist()) for k in range(2000)]
    df = frame([(*r, 1, "x", "y", "z", "w") for r in rows], VECTORS)
    asked = df.where("vec_id % 50 = 0")
    want = {r[:1] + r[2:3] for r in plain_nearest(rows, [r for r in rows if r[0] % 50 == 0], 5)}
    found = lambda factor: {(r["query_id"], r["vec_id"]) for r in neighbours.nearest(df, asked, factor=factor, shard=400).collect()}
    assert found(1.0) == want
    assert 0.9 <= len(found(3.0) & want) / len(want)


def test_a_tree_skips_what_is_far():
    rng = np.random.default_rng(7)
    middle = rng.normal(size=(40, 16)) * 5
    rows = np.concatenate([m + 0.05 * rng.normal(size=(200, 16)) for m in middle])
    shard = neighbours.Shard(rows, np.arange(len(rows)), np.ones(len(rows), bool))
    asked = rows[::400]
    best = shard.search(asked, np.arange(0, len(rows), 400), np.ones(len(asked), bool), np.full(len(asked), -np.inf), 5, 1.0)
    units = neighbours.unit(asked)[1]
    visits = sum(len(active) * len(shard.tree.leaves[leaf]) for leaf, active in shard.tree.reached(units, best.limit, 1.0))
    assert visits < len(asked) * len(rows) / 4


def test_neighbours_edges(frame):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (50, None), (100, [0.0, 0.0]), (150, [nan, 1.0]), (200, [inf, 1.0]), (250, [None, 1.0]), (300, []), (350, [1.0, 0.0, 0.0]), (1, [0.0, 1e-200]), (2, [-1e200, 0.0])]
    df = frame([(*r, 1, "x", "y", "z", "w") for r in rows], VECTORS)
    assert sorted(tuple(r) for r in neighbours.query(df).collect()) == [(0, 1, 1, 0.0), (0, 2, 2, -1.0)]
    assert neighbours.query(df.where("false")).collect() == []
    assert neighbours.query(df.where("vec_id = 1")).collect() == []
