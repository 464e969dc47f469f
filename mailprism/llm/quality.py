"""Quality: attention-based multiple-instance learning over the passages of a document."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailprism.llm.common import fit_in_task, labelled_sample, pieces, remainder, spark_of

PASSAGE = 384  # bytes
SAMPLE = 6_000  # labelled documents to fit on, at most
CODE, GATE = 24, 12  # units of a passage's code and of the attention
EPOCHS, BATCH = 30, 64
GRAM_BITS = 9  # hashed four-byte grams whose variety is measured

# Byte classes: small letters, capitals, digits, blanks, line ends, bytes of other letters, then marks.
MARKS = [b".", b",", b"!?", b"|", b"*", b"#", b"%$&@", b"\"'", b"()[]{}<>", b"-_=+~", b";:/\\"]
CLASSES = 7 + len(MARKS)


def class_table() -> np.ndarray:
    table = np.full(256, 6, np.uint8)
    for number, group in enumerate((range(97, 123), range(65, 91), range(48, 58), b" \t", b"\n\r\v\f", range(128, 256))):
        table[list(group)] = number
    for number, group in enumerate(MARKS, 7):
        table[list(group)] = number
    return table


TABLE = class_table()
WIDTH = CLASSES + CLASSES * CLASSES + 2


def features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(passages, WIDTH) and the document of each: shares of byte classes and of class pairs, variety, size.

    Whole texts are cut into passages; a text without bytes is one empty passage.
    """
    raw = [(x or "").encode("utf-8", "surrogatepass") for x in texts]
    sizes = np.array([len(x) for x in raw], np.int64)
    counts = np.maximum(1, -(-sizes // PASSAGE))
    owner = np.repeat(np.arange(len(raw)), counts)
    first = np.cumsum(counts) - counts
    data = np.frombuffer(b"".join(raw), np.uint8)
    begin = np.cumsum(sizes) - sizes
    place = np.repeat(first * PASSAGE - begin, sizes) + np.arange(len(data))
    passage = place // PASSAGE
    n = len(owner)
    kind = TABLE[data].astype(np.int64)
    out = np.zeros((n, WIDTH), np.float32)
    size = np.bincount(passage, minlength=n)
    some = np.maximum(size, 1)[:, None]
    out[:, :CLASSES] = np.bincount(passage * CLASSES + kind, minlength=n * CLASSES).reshape(n, -1) / some
    inside = np.flatnonzero(passage[1:] == passage[:-1])
    pair = passage[inside] * (CLASSES * CLASSES) + kind[inside] * CLASSES + kind[inside + 1]
    out[:, CLASSES:-2] = np.bincount(pair, minlength=n * CLASSES * CLASSES).reshape(n, -1) / some
    if len(data) > 4:
        wide = data.astype(np.uint32)
        gram = ((wide[:-3] * np.uint32(31) + wide[1:-2]) * np.uint32(31) + wide[2:-1]) * np.uint32(31) + wide[3:]
        bucket = (gram * np.uint32(0x9E3779B1)) >> np.uint32(32 - GRAM_BITS)
        inside = passage[3:] == passage[:-3]
        seen = np.zeros(n << GRAM_BITS, bool)
        seen[(passage[:-3][inside] << GRAM_BITS) + bucket[inside]] = True
        out[:, -2] = seen.reshape(n, -1).sum(axis=1) / np.maximum(size, 16)
    out[:, -1] = size / PASSAGE
    return out, owner


class Bags:
    """Passages coded by one layer, weighed by gated attention, and the weighted code scored.

    code e = tanh(W x + b); attention a = softmax over the document of w (tanh(V e) * sigmoid(U e));
    score = sigmoid(c sum(a e) + d).
    """

    SHAPES = {"w": (WIDTH, CODE), "b": (CODE,), "v": (CODE, GATE), "u": (CODE, GATE), "a": (GATE,), "c": (CODE,), "d": (1,)}

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.p = {k: (rng.normal(0, 1 / np.sqrt(s[0]), s) if len(s) > 1 else np.zeros(s)).astype(np.float32) for k, s in self.SHAPES.items()}
        self.p["a"] = rng.normal(0, 0.3, GATE).astype(np.float32)
        self.p["c"] = rng.normal(0, 0.3, CODE).astype(np.float32)
        self.mean, self.scale = np.zeros(WIDTH, np.float32), np.ones(WIDTH, np.float32)

    def forward(self, x: np.ndarray, first: np.ndarray, owner: np.ndarray) -> tuple:
        """``first``: first passage of each document; ``owner``: document of each passage."""
        p = self.p
        code = np.tanh(x @ p["w"] + p["b"])
        tone, gate = np.tanh(code @ p["v"]), 1 / (1 + np.exp(-(code @ p["u"])))
        weight = (tone * gate) @ p["a"]
        weight = np.exp(weight - np.maximum.reduceat(weight, first)[owner])
        weight /= np.add.reduceat(weight, first)[owner]
        pooled = np.add.reduceat(weight[:, None] * code, first, axis=0)
        score = 1 / (1 + np.exp(-np.clip(pooled @ p["c"] + p["d"], -30, 30)))
        return code, tone, gate, weight, pooled, score

    def gradient(self, x: np.ndarray, first: np.ndarray, owner: np.ndarray, label: np.ndarray) -> dict[str, np.ndarray]:
        p = self.p
        code, tone, gate, weight, pooled, score = self.forward(x, first, owner)
        slope = (score - label) / len(label)
        d_pool = (slope[:, None] * p["c"])[owner]
        d_weight = (code * d_pool).sum(axis=1)
        d_raw = weight * (d_weight - np.add.reduceat(weight * d_weight, first)[owner])
        d_tone = d_raw[:, None] * p["a"] * gate * (1 - tone * tone)
        d_gate = d_raw[:, None] * p["a"] * tone * gate * (1 - gate)
        d_code = (weight[:, None] * d_pool + d_tone @ p["v"].T + d_gate @ p["u"].T) * (1 - code * code)
        return {"w": x.T @ d_code, "b": d_code.sum(axis=0), "v": code.T @ d_tone, "u": code.T @ d_gate,
                "a": (tone * gate).T @ d_raw, "c": pooled.T @ slope, "d": slope.sum(keepdims=True)}

    def score(self, x: np.ndarray, owner: np.ndarray) -> np.ndarray:
        first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        return self.forward((x - self.mean) * self.scale, first, owner)[-1]


def fit(sample: pd.DataFrame) -> dict:
    """Parameters of a model trained over the sample; with one class only every score is that class."""
    label = sample["label"].to_numpy(np.float32)
    if not len(label) or label.min() == label.max():
        return {"parameters": [], "constant": float(label.mean()) if len(label) else 0.5}
    found = [(features(sample["text"].iloc[a:b].tolist()), a) for a, b in pieces([len(x or "") for x in sample["text"]])]
    x = np.concatenate([f for (f, _), _ in found])
    owner = np.concatenate([o + a for (_, o), a in found])
    model = Bags()
    model.mean, model.scale = x.mean(axis=0), 1 / (x.std(axis=0) + 0.02)
    x = (x - model.mean) * model.scale
    begin = np.searchsorted(owner, np.arange(len(label) + 1))
    rng = np.random.default_rng(3)
    moment = {k: np.zeros_like(v) for k, v in model.p.items()}
    spread = {k: np.zeros_like(v) for k, v in model.p.items()}
    step, steps = 0, EPOCHS * -(-len(label) // BATCH)
    for _ in range(EPOCHS):
        order = rng.permutation(len(label))
        for at in range(0, len(order), BATCH):
            docs = order[at:at + BATCH]
            counts = begin[docs + 1] - begin[docs]
            first = np.cumsum(counts) - counts
            rows = np.arange(counts.sum()) + np.repeat(begin[docs] - first, counts)
            step += 1
            rate = 0.01 * (1 - step / (steps + 1))
            for k, g in model.gradient(x[rows], first, np.repeat(np.arange(len(docs)), counts), label[docs]).items():
                g = g + (3e-4 * model.p[k] if k in "wvu" else 0)
                moment[k] = 0.9 * moment[k] + 0.1 * g
                spread[k] = 0.99 * spread[k] + 0.01 * g * g
                model.p[k] = (model.p[k] - rate * (moment[k] / (1 - 0.9**step)) / (np.sqrt(spread[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    arrays = [model.mean, model.scale, *(model.p[k] for k in Bags.SHAPES)]
    return {"parameters": [v.astype("<f4").tobytes() for v in arrays], "constant": None}


def scorer(spark: SparkSession, model):
    """Column function: score (0 to 1) of whole texts by a fitted model."""
    shared = spark.sparkContext.broadcast(([bytes(x) for x in model["parameters"]], model["constant"]))

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        arrays, constant = shared.value
        bags = Bags()
        if arrays:
            bags.mean, bags.scale = (np.frombuffer(v, "<f4") for v in arrays[:2])
            bags.p = {k: np.frombuffer(v, "<f4").reshape(s) for (k, s), v in zip(Bags.SHAPES.items(), arrays[2:])}
        for batch in batches:
            texts = batch.tolist()
            scores = np.full(len(texts), constant if constant is not None else 0.0)
            for a, b in pieces([len(x or "") for x in texts]) if arrays else ():
                scores[a:b] = bags.score(*features(texts[a:b]))
            yield pd.Series(scores)

    return score


def quality(docs: DataFrame, labels: DataFrame, learn_from=None, label: str = "quality", sample: int = SAMPLE,
            key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fit on labelled rows and score every row: key, ``score``, ``predicted`` (score of at least a half).

    ``learn_from``: condition on the key for rows that may be learnt from (all, if not given). At most
    ``sample`` of them are used. Only the text enters a score. Null and empty texts are one empty passage;
    repeated rows are scored each; with labels of one class every score is that class, without labels a half;
    empty tables give no rows; other columns are not looked at.
    """
    known = labels if learn_from is None else labels.where(learn_from)
    model = fit_in_task(labelled_sample(docs, known, label, sample, key, text), fit, "parameters array<binary>, constant double")
    score = scorer(spark_of(docs), model)
    return docs.select(F.col(key), score(F.col(text)).alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    part = remainder("doc_id", 3)
    return quality(docs, labels, part != 1).select("doc_id", (part == 1).alias("held_out"), "score", "predicted")
