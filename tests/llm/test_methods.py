"""Each operator against a brute-force version, an exact round trip or held-out accuracy."""

import collections
import itertools
import math
import random
import re
import zlib

import numpy as np
import pandas as pd
import pytest
import public_tokenizers
import xxhash
from tokenizers import Tokenizer

import corpus_pipeline
from llm_data import SMALL, docs_of, frame  # noqa: F401
from mailprism.llm import catalog, decontamination, embeddings, language, packing, ppm, quality, secrets, simhash, tokencount
from mailprism.llm.common import Scratch, components

MIDDLE = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}


def groups_of(nodes, pairs):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark, frame):
    rng = random.Random(1)
    pairs = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(501, 560)] + list(itertools.combinations(range(900, 912), 2))
    pairs += [(rng.randrange(2000, 2200), rng.randrange(2000, 2200)) for _ in range(120)] + [(7, 7)]
    got = components(frame([*pairs, (None, 3)], "a long, b long"), Scratch(spark, "t")).collect()
    nodes = {n for a, b in pairs if a != b for n in (a, b)}
    want = groups_of(nodes, [p for p in pairs if p[0] != p[1]])
    assert {r["node"] for r in got} == nodes
    assert len({(r["root"], want[r["node"]]) for r in got}) == len(set(want.values())) == len({r["root"] for r in got})


def test_packing_gives_rows_in_small_batches(spark, monkeypatch):
    """What a worker copies at a time does not grow with the rows of a run or of an Arrow batch."""
    monkeypatch.setattr(packing, "COPIED", 50)
    monkeypatch.setattr(packing.TaskContext, "get", lambda: type("T", (), {"partitionId": lambda self: 0})())
    made = {}
    frame = type("F", (), {"schema": [], "repartition": lambda self, n: self, "mapInArrow": lambda self, run, schema: made.setdefault("run", run)})()
    packing.assign(frame, 1)
    batch = packing.pa.record_batch({"length": packing.pa.array([1 + n % 1023 for n in range(400)], packing.pa.int64())})
    out = list(made["run"](iter([batch])))
    assert max(b.num_rows for b in out) <= 50
    assert sorted(x for b in out for x in b["length"].to_pylist()) == sorted(batch["length"].to_pylist())


def test_packing_round_trip(spark, texts):
    model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    model.encode_special_tokens = True
    rows = packing.pack(spark.read.parquet(f"{SMALL}/documents.parquet")).toPandas()
    for doc, part in rows.groupby("doc_id"):
        part = part.sort_values("start")
        ids = [x for piece in part["ids"] for x in np.frombuffer(piece, "<u4").tolist()]
        assert ids == [*model.encode(texts[doc], add_special_tokens=False).ids, 0]
        assert part["start"].tolist() == (part["length"].cumsum() - part["length"]).tolist()
    for _, part in rows.groupby("sequence_id"):
        part = part.sort_values("offset")
        assert part["offset"].tolist() == (part["length"].cumsum() - part["length"]).tolist()
        assert part["length"].sum() <= 1024
    assert rows["length"].sum() / (1024 * rows["sequence_id"].nunique()) > 0.98


@pytest.mark.parametrize("text", ["a  b", "a   b", " \n b\n\n  c", "", "  ", "x  y", "<|endoftext|> a", "a\t b", "\n", "it's 12a b!!! ?  d", "a  b  c"])
def test_word_ids(text):
    model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    model.encode_special_tokens = True
    got = packing.Words(public_tokenizers.path("byte_bpe_50k.tiktoken")).text(text)
    assert np.frombuffer(got, "<u4").tolist() == model.encode(text, add_special_tokens=False).ids


def test_packing_reads_a_text_in_one_call(monkeypatch):
    path, calls = public_tokenizers.path("byte_bpe_50k.tiktoken"), []
    model = packing.encoder(path)

    class Counted:
        def __getattr__(self, name):
            return lambda *args, **options: calls.append(name) or getattr(model, name)(*args, **options)

    monkeypatch.setattr(packing, "encoder", lambda *given: Counted())
    text = " ".join(f"w{n:x}ord" for n in range(2000))
    assert np.frombuffer(packing.Words(path).text(text), "<u4").tolist() == model.encode_ordinary(text)
    assert len(calls) == 1


def test_added_tokens_as_the_tokenizer_gives_them(docs_of):
    model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["<|endoftext|>", "a <|endoftext|> b", "a  <|endoftext|>  b\n<|endoftext|><|endoftext|>c", "x<|endoftext|>y <|endoftext", "<|endoftext |> plain  "]
    rows = {r["doc_id"]: r["ids"] for r in packing.pack(docs_of(list(enumerate(texts)))).collect()}
    for i, text in enumerate(texts):
        assert np.frombuffer(rows[i], "<u4").tolist() == [*model.encode(text, add_special_tokens=False).ids, 0]


def test_best_fit_is_tightest():
    rng = random.Random(2)
    lengths = sorted((rng.randrange(1, 65) for _ in range(3000)), reverse=True)
    got, rooms, want = packing.best_fit(lengths, 64), [], []
    for n in lengths:
        fits = [r for r in rooms if r >= n]
        if fits:
            rooms.remove(min(fits))
        rooms.append((min(fits) if fits else 64) - n)
        want.append(64 - (min(fits) if fits else 64))
    assert [b for _, b in got] == want


def test_token_counts():
    path = public_tokenizers.path(tokencount.MODEL)
    pieces = set(tokencount.vocabulary(path))
    longest = max(map(len, pieces))
    automaton = tokencount.Automaton(sorted(pieces))

    def greedy(word):
        at = n = 0
        while at < len(word):
            for end in range(min(len(word), at + longest), at, -1):
                if word[at:end] in pieces:
                    at, n = end, n + 1
                    break
            else:
                n, at = n + len(word[at].encode()), at + 1
        return n

    rng = random.Random(3)
    words = ["".join(rng.choice("abthestion▁éß一\U0001f600xqz.,") for _ in range(rng.randint(0, 14))) for _ in range(4000)]
    assert [automaton.count(w) for w in words] == [greedy(w) for w in words]


def test_toxicity_held_out(spark):
    rows = catalog.QUERIES["op2_toxicity"](spark, MIDDLE).toPandas()
    assert (rows["held_out"] == [zlib.crc32(str(i).encode()) % 5 == 0 for i in rows["doc_id"]]).all()
    known = rows.merge(pd.read_parquet(f"{MIDDLE}/labels.parquet"), on="doc_id")
    known = known[known["held_out"]]
    assert (known["predicted"] == known["toxic"]).mean() > 0.95


def test_quality_held_out(spark):
    rows = catalog.QUERIES["op7_quality"](spark, MIDDLE).toPandas()
    assert (rows["held_out"] == [zlib.crc32(str(i).encode()) % 3 == 1 for i in rows["doc_id"]]).all()
    known = rows.merge(pd.read_parquet(f"{MIDDLE}/labels.parquet"), on="doc_id")
    known = known[known["held_out"]]
    assert (known["predicted"] == known["quality"]).mean() > 0.95


def test_language_held_out(spark):
    rows = catalog.QUERIES["op10_language"](spark, MIDDLE).toPandas()
    known = rows.merge(pd.read_parquet(f"{MIDDLE}/documents.parquet"), on="doc_id")
    known = known[known["held_out"] & known["lang"].notna()]
    assert (known["lang_pred"] == known["lang"]).mean() > 0.97


def test_network_gradient():
    rng = np.random.default_rng(0)
    net = language.Network(3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    data, size, label = rng.integers(97, 105, (5, language.SPAN)).astype(np.uint8), np.array([64, 64, 30, 5, 64]), np.array([0, 1, 2, 1, 0])

    def loss():
        p = net.probabilities(data).astype(float)[:, np.arange(5), label]
        return -(np.log(p) * (np.arange(language.SPAN)[:, None] < size)).sum() / size.sum()

    slopes = net.gradient(data, size, label)
    for name, value in net.p.items():
        at = (100, 3) if name[0] == "x" else tuple(n // 2 for n in value.shape)
        value[at] += 1e-2
        up = loss()
        value[at] -= 2e-2
        down = loss()
        value[at] += 1e-2
        assert (up - down) / 2e-2 == pytest.approx(slopes[name][at], rel=2e-3, abs=2e-6)


def test_bags_gradient():
    rng = np.random.default_rng(1)
    bags = quality.Bags()
    bags.p = {k: v.astype(np.float64) for k, v in bags.p.items()}
    x, owner, first, label = rng.normal(size=(6, quality.WIDTH)), np.array([0, 0, 0, 1, 1, 2]), np.array([0, 3, 5]), np.array([1.0, 0.0, 1.0])

    def loss():
        s = bags.forward(x, first, owner)[-1]
        return -(label * np.log(s) + (1 - label) * np.log(1 - s)).mean()

    slopes = bags.gradient(x, first, owner, label)
    for name, value in bags.p.items():
        at = tuple(n // 2 for n in value.shape)
        value[at] += 1e-4
        up = loss()
        value[at] -= 2e-4
        down = loss()
        value[at] += 1e-4
        assert (up - down) / 2e-4 == pytest.approx(slopes[name][at], rel=1e-3, abs=1e-7)


def test_ppm(spark, texts):
    order = ppm.ORDER
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}
    trie, words, ends = [collections.defaultdict(collections.Counter) for _ in range(order + 1)], collections.Counter(), 0
    raw = {i: b" " * order + b" ".join(ppm.words_of(t)) + b"\xff" for i, t in texts.items()}
    for i, b in raw.items():
        if not held[i]:
            for p in range(order, len(b)):
                for k in range(order + 1):
                    trie[k][b[p - k:p]][b[p]] += 1
            words.update(ppm.words_of(texts[i]))
            ends += 1
    total, kinds = sum(words.values()) + ends, len(words) + 1

    def chance(context, symbol):
        p, excluded = 1.0, set()
        for k in range(order, -1, -1):
            after = trie[k].get(context[order - k:])
            if after:
                left = {s: c for s, c in after.items() if s not in excluded}
                n = sum(left.values())
                if symbol in left:
                    return math.log10(p * (left[symbol] - 0.5) / n)
                if left:
                    p *= len(left) / 2 / n
                excluded = set(after)
        return math.log10(p / (256 - len(trie[0][b""])))

    rows = {r["doc_id"]: r for r in catalog.QUERIES["op4_ppm"](spark, SMALL).collect()}
    assert set(rows) == set(texts)
    for i in sorted(texts, key=lambda i: len(texts[i]))[::4]:
        b, r, tokens = raw[i], rows[i], ppm.words_of(texts[i])
        assert r["score"] == pytest.approx(sum(chance(b[p - order:p], b[p]) for p in range(order, len(b))), rel=1e-5)
        base = [words[w] for w in tokens] + [ends]
        assert r["base_score"] == pytest.approx(sum(math.log10((c + 1) / (total + kinds + 1)) for c in base), rel=1e-9)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(base), sum(c > 0 for c in base), total)


def test_decontamination_finds_all_substitutions(docs_of, frame):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    item = [word() for _ in range(12)]
    pairs = list(itertools.combinations(range(12), 2))
    rows = [(n, " ".join([word(), *(word() if k in pair else w for k, w in enumerate(item)), word()])) for n, pair in enumerate(pairs)]
    threes = [(1000 + n, " ".join(word() if k in (1, 5, 9) else w for k, w in enumerate(item))) for n in range(5)]
    found = decontamination.overlaps(docs_of(rows + threes), frame([(1, " ".join(item).title() + ".")], "item_id long, text string"))
    assert sorted((r["doc_id"], r["doc_start"], r["matching"]) for r in found.collect()) == [(n, 1, 10) for n in range(len(pairs))]


def test_decontamination_without_broadcast(spark):
    docs, items = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/benchmark.parquet")
    one, other = (decontamination.overlaps(docs, items, broadcast_rows=n).collect() for n in (0, 10**6))
    assert sorted(one) == sorted(other) and one


@pytest.mark.parametrize("tile", [simhash.TILE, 64])
def test_simhash(spark, texts, tile):
    prints = {}
    for i, t in texts.items():
        w = t.encode().lower().split()
        hashes = [xxhash.xxh64_intdigest(b" ".join(w[k:k + 3]), 42) for k in range(max(1, len(w) - 2))] if w else []
        prints[i] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    pairs = [(a, b) for a, b in itertools.combinations(sorted(texts), 2) if (prints[a] ^ prints[b]).bit_count() <= 3]
    rows = simhash.near_duplicates(spark.read.parquet(f"{SMALL}/documents.parquet"), tile=tile).collect()
    assert {r["doc_id"]: int.from_bytes(r["fp"], "big") for r in rows} == prints
    assert {r["doc_id"]: r["component"] for r in rows} == groups_of(texts, pairs)


def test_simhash_wide_finds_alike(docs_of):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    rows, want = [], {}
    for n in range(40):
        text = [word() for _ in range(150)]
        for k, changed in enumerate((0, 1, 2)):
            copy = list(text)
            for c in rng.sample(range(150), changed):
                copy[c] = word()
            rows.append((10 * n + k, " ".join(copy)))
            want[10 * n + k] = 10 * n
    got = simhash.near_duplicates(docs_of(rows), corpus_pipeline.SHINGLE, corpus_pipeline.RADIUS, corpus_pipeline.LANES).collect()
    assert {r["doc_id"]: r["component"] for r in got} == want


def test_near_copies_on_both_sides_of_the_threshold(docs_of):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    shingles = lambda t: {tuple(w[k:k + 5]) for w in [t.split()] for k in range(max(1, len(w) - 4))}
    rows = []
    for n in range(160):
        size = (8, 9, 13, 40, 120, 300)[n % 6]
        text = [word() for _ in range(size)]
        shingle_count = size - 4
        rows.append((2 * n, " ".join(text)))
        kind = n // 6 % 3  # words appended or cut so that the sets are 0.8 alike, or a little less, or twice the first text
        more = shingle_count // 4 + (kind == 1)
        other = text + [word() for _ in range(more)] if kind < 2 else text + text
        rows.append((2 * n + 1, " ".join(other)))
    sets = {i: shingles(t) for i, t in rows}
    pairs = [(a, b) for a, b in itertools.combinations(sets, 2) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    assert 40 < len(pairs) < 120
    want = groups_of(sets, pairs)
    kept = simhash.one_of_each(docs_of(rows), corpus_pipeline.SHINGLE, corpus_pipeline.RADIUS, corpus_pipeline.LANES).collect()
    assert sorted(r["doc_id"] for r in kept) == sorted(set(want.values()))


@pytest.mark.parametrize("tile", [4096, 32])
def test_embeddings(frame, tile):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(25, 32))
    vectors = np.concatenate([centres.repeat(8, axis=0) + rng.normal(size=(200, 32)) * rng.choice([0.05, 0.2, 0.3], (200, 1)), rng.normal(size=(40, 32))])
    vectors = vectors.astype(np.float32)
    vectors[60:70] = vectors[60]
    label = (np.arange(len(vectors)) % 3).tolist()
    unit = vectors.astype(float) / np.linalg.norm(vectors.astype(float), axis=1, keepdims=True)
    near = (unit @ unit.T >= 0.93) & (np.array(label)[:, None] == np.array(label)) & ~np.eye(len(unit), dtype=bool)
    rows = embeddings.near_duplicates(frame(list(zip(range(len(unit)), vectors.tolist(), label)), "vec_id long, embedding array<float>, label int"), tile=tile).collect()
    want = groups_of(range(len(unit)), [(a, b) for a, b in zip(*np.nonzero(near)) if a < b])
    assert {r["vec_id"]: r["n_links"] for r in rows} == {i: int(n) for i, n in enumerate(near.sum(axis=1))}
    assert {r["vec_id"]: r["component"] for r in rows} == want


def test_needed_count_is_calibrated():
    rng = np.random.default_rng(7)
    a = rng.normal(size=(4000, 48))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    side = rng.normal(size=a.shape)
    side -= (side * a).sum(axis=1, keepdims=True) * a
    b = 0.93 * a + math.sqrt(1 - 0.93**2) * side / np.linalg.norm(side, axis=1, keepdims=True)
    line = embeddings.directions(48, embeddings.PROJECTIONS)
    hits = (np.abs(a @ line - b @ line) <= embeddings.WIDTH).sum(axis=1)
    count = embeddings.needed(0.93, embeddings.PROJECTIONS, embeddings.WIDTH, embeddings.RECALL)
    assert (hits >= count).mean() > 0.995


def test_secrets(docs_of):
    rng = random.Random(8)
    key = lambda n, chars: "".join(rng.choice(chars) for _ in range(n))
    prose = lambda n: " ".join(key(rng.randint(2, 9), "etaoinshrdlu") for _ in range(n))
    rows, secret = [], {}
    for i in range(120):
        kind = i % 4
        found = ["AKIA" + key(16, "ABCDEFGHIJKLMNOP234567"), key(40, "0123456789abcdef"), "ghp_" + key(36, "abcdefABCDEF0123456789"), None][kind]
        put = {0: f"{found}", 1: f'token = "{found}"', 2: f"use {found}", 3: key(22, "etaoinshrdlu") + " " + "under_scored-and/slashed_words"}[kind]
        rows.append((i, f"{prose(20)} {put} {prose(20)}"))
        secret[i] = found
    docs = docs_of(rows)
    found = secrets.findings(docs, path="source")
    got = {r["doc_id"]: r["value"] for r in found.collect()}
    assert got == {i: s for i, s in secret.items() if s}
    cleaned = {r["doc_id"]: r["text"] for r in secrets.redact(docs, found).collect()}
    for i, text in rows:
        assert cleaned[i] == (text.replace(secret[i], "[SECRET]") if secret[i] else text)


def test_assigned_secrets_of_any_length_and_marks(docs_of):
    rng = random.Random(10)
    key = lambda n, chars="etaoinshrdlu": "".join(rng.choice(chars) for _ in range(n))
    lexicon = [key(rng.randint(4, 8)) for _ in range(60)]
    prose = lambda: " ".join(rng.choice(lexicon) for _ in range(20))
    forms = ["password=Tr0ub4dor{}x", "PASSWORD: P@ssw0rd!{}", 'api_key = "a{}#b$c"', "pwd :=q7!w{}e.", "secret 'x{}-Y?z'", "https://joe:p4ss!{}w@host/x?a=b",
             '{{"user":"x","password":"K!{}z-9","b":1}}', "x?token=zz9{}q&user=joe", "password {}word"]
    values = ["Tr0ub4dor{}x", "P@ssw0rd!{}", "a{}#b$c", "q7!w{}e", None, "p4ss!{}w", "K!{}z-9", "zz9{}q", None]
    rows, want = [], {}
    for i in range(180):
        n = 100 + i
        form, value = forms[i % 9].format(n), values[i % 9]
        rows.append((i, f"{prose()} {form} {prose()} {key(20)} password: {rng.choice([x for x in lexicon if len(x) > 6])} {prose()}"))
        want[i] = value and value.format(n)
    docs = docs_of(rows)
    found = secrets.findings(docs, path="source")
    got = {r["doc_id"]: r["value"] for r in found.collect()}
    assert got == {i: v for i, v in want.items() if v}
    cleaned = {r["doc_id"]: r["text"] for r in secrets.redact(docs, found).collect()}
    for i, text in rows:
        assert cleaned[i] == (text.replace(want[i], "[SECRET]") if want[i] else text)


def test_secrets_learn_from_reviewed_labels(docs_of):
    from pyspark.sql import functions as F

    rng = random.Random(9)
    rows = [(i, f"id {''.join(rng.choice('0123456789abcdef') for _ in range(32 if i % 2 else 40))} seen") for i in range(80)]
    reviewed = lambda found: found.withColumn("label", F.when(F.col("key") < 60, (F.length("value") == 40).cast("double")))
    got = {r["doc_id"] for r in secrets.findings(docs_of(rows), labels=reviewed).collect()}
    assert got == {i for i in range(80) if not i % 2}


def test_pipeline_stages(spark, texts):
    """Every stage against a plain loop over the rows it was given."""
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet")
    scratch = Scratch(spark, "stages")
    rows = lambda df: {r["doc_id"]: r["text"] for r in df.collect()}

    before, docs = rows(docs), scratch.save(stages["toxicity"](spark, docs, MIDDLE))
    rejected = {r["doc_id"] for r in catalog.QUERIES["op2_toxicity"](spark, MIDDLE).where("predicted = 1").collect()}
    after = rows(docs)
    assert set(after) == set(before) - rejected

    before, docs = after, scratch.save(stages["near_duplicates"](spark, docs, MIDDLE))
    after = rows(docs)
    shingles = lambda t: {tuple(w[k:k + 5]) for w in [t.lower().split()] for k in range(max(1, len(w) - 4))}
    kept = [(i, shingles(t)) for i, t in after.items()]
    alike = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    assert not [(i, j) for (i, a), (j, b) in itertools.combinations(kept, 2) if alike(a, b) >= 0.85]
    for i in set(before) - set(after):  # what went has a like among the rest
        one = shingles(before[i])
        assert max(alike(one, shingles(t)) for j, t in before.items() if j != i) >= 0.55

    before, docs = after, scratch.save(stages["decontamination"](spark, docs, MIDDLE))
    after = rows(docs)
    flat = lambda t: " " + " ".join(re.findall(r"[^\W_]+", t.lower())) + " "
    items = [flat(r["text"]) for r in spark.read.parquet(f"{MIDDLE}/benchmark.parquet").collect()]
    assert set(after) == {i for i, t in before.items() if not any(x in flat(t) for x in items)}

    before, docs = after, scratch.save(stages["secrets"](spark, docs, MIDDLE))
    after = rows(docs)
    assert after == {i: re.sub(r'(?<=token = ")[0-9a-f]{40}|(?<=password=)[0-9a-f]{18}', "[SECRET]", t) for i, t in before.items()}

    pieces = stages["packing"](spark, docs, MIDDLE).toPandas()
    model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for doc, part in list(pieces.groupby("doc_id"))[::10]:
        ids = b"".join(part.sort_values("start")["ids"])
        assert np.frombuffer(ids, "<u4").tolist() == [*model.encode(after[doc], add_special_tokens=False).ids, 0]
        assert [zlib.crc32(x) for x in part["ids"]] == part["ids_crc32"].tolist()


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
def test_secrets_equal_a_plain_scan(spark, folder):
    """The planted secrets of these tables are assigned hexadecimal values; sf0.001 has none."""
    docs = spark.read.parquet(f"/root/testdata/{folder}/documents.parquet")
    want = {(r["doc_id"], m.group(1)) for r in docs.select("doc_id", "text").collect() for m in re.finditer(r"\btoken\s*=\s*\"([0-9a-f]{40})\"", r["text"] or "")}
    got = {(r["doc_id"], r["value"]) for r in secrets.findings(docs, path="source").collect()}
    assert got == want and (len(want) > 0) == (folder == "sf0.01")


def test_every_language_is_learnt(docs_of):
    rows = [(k, f"text {k}", f"l{k % 300}") for k in range(900)] + [(1000 + k, "text", "hot") for k in range(3000)] + [(5000, "text", None), (5001, "12", "digits")]
    docs = docs_of(rows)
    drawn = collections.Counter(r["lang"] for r in language.training_rows(docs, None, 5, "doc_id", "text", "lang").collect())
    assert drawn == {**{f"l{k}": 3 for k in range(300)}, "hot": 5}
    few = collections.Counter(r["lang"] for r in language.training_rows(docs, None, 5, "doc_id", "text", "lang", sample=200).collect())
    assert set(few.values()) == {1} and len(few) == 301


def test_short_items_and_scripts_without_spaces(docs_of, frame):
    items = frame([(1, "Three short words"), (2, "one"), (3, "今日は天気がいいですね散歩しましょう"), (4, "five tokens in an item"), (5, "สวัสดีครับผมชื่อ")], "item_id long, text string")
    texts = [(1, "here are three, short words again"), (2, "three short other words"), (3, "昨日。今日は天気がいいですね散歩しましょう。明日"), (4, "今日は雨です"), (5, "one"), (6, "four five tokens in an item"),
             (7, "five tokens in an"), (8, "xสวัสดีครับผมชื่อy"), (9, "今日は天気がとても悪いですね散歩")]
    found = {(r["doc_id"], r["item_id"]) for r in decontamination.overlaps(docs_of(texts), items).collect()}
    assert found == {(1, 1), (3, 3), (5, 2), (6, 4), (8, 5)}
    assert {r["doc_id"] for r in decontamination.clean(docs_of(texts), items).collect()} == {2, 4, 5, 7, 9}


def plain_features(text):
    """Buckets of all character n-grams of a text between spaces, by plain loops."""
    from mailprism.llm import toxicity

    widest = max(toxicity.ORDERS)
    points, found = [ord(c) for c in " " * widest + text.lower() + " " * widest], set()
    for number, width in enumerate(toxicity.ORDERS):
        for at in range(len(points) - widest):
            value = 0
            for p in points[at:at + width]:
                value = (value * 16777619 + p + 1) % 2**32
            mixed = (value ^ value >> 15) * 0x85EBCA6B % 2**32
            found.add((mixed >> 32 - toxicity.BITS) + (number << toxicity.BITS))
    return found


def test_toxicity_equals_plain_loops(spark, texts):
    from mailprism.llm import toxicity

    chosen = [t or "" for _, t in sorted(texts.items())[:60]] + ["", "ÉÀß 漢字 😀 İ"]
    chosen = [t[:400] + (" Awful ÉÀ!" if k % 3 == 0 else "") for k, t in enumerate(chosen)]
    model = toxicity.fit(pd.DataFrame({"text": chosen, "label": [k % 3 == 0 for k in range(len(chosen))]}).astype({"label": float}))
    weights = dict(zip(np.frombuffer(model["features"], "<i4").tolist(), np.frombuffer(model["weights"], "<f4").tolist()))
    assert weights
    docs = spark.createDataFrame(list(enumerate(chosen)), "doc_id long, text string")
    got = {r["doc_id"]: r["s"] for r in docs.select("doc_id", toxicity.scorer(spark, model)("text").alias("s")).collect()}
    for k, text in enumerate(chosen):
        margin = model["bias"] + sum(weights.get(f, 0.0) for f in plain_features(text))
        assert abs(got[k] - 1 / (1 + math.exp(-margin))) < 1e-5
