"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailprism.llm.common import fit_in_task, fresh, labelled_sample, pieces, remainder, spark_of

ORDERS = (3, 4, 5, 6)  # characters of an n-gram
BITS = 18  # buckets of an order: 2 ** BITS
SAMPLE = 12_000  # labelled documents to fit on, at most
SMOOTH = 1.0  # added to each count
SURE = 4.0  # standard errors between the classes that an n-gram's document frequency needs
DECAY = 1e-4  # weight decay of the linear model
STEPS = 200


def grams(texts: list[str | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Per order: number of the order, document of each n-gram of characters (lowered), its bucket.

    Documents stand between runs of spaces longer than any n-gram, so none spans two documents.
    """
    pad = " " * max(ORDERS)
    low = [(x or "").lower() for x in texts]
    data = np.frombuffer("".join([pad + x for x in low] + [pad]).encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(low), dtype=np.uint32), [len(x) + len(pad) for x in low])
    n = len(data) - max(ORDERS)
    value = np.zeros(n, np.uint32)
    for width in range(1, max(ORDERS) + 1):
        value = value * np.uint32(16777619) + data[width - 1:width - 1 + n] + np.uint32(1)
        if width in ORDERS:
            mixed = (value ^ (value >> np.uint32(15))) * np.uint32(0x85EBCA6B)
            yield ORDERS.index(width), owner[:n], mixed >> np.uint32(32 - BITS)


def present(texts: list[str | None], wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(document, feature) of each distinct feature of each document, by document; ``wanted``: which features count."""
    found = []
    for order, owner, bucket in grams(texts):
        feature = bucket + np.uint32(order << BITS)
        if wanted is not None:
            keep = np.flatnonzero(wanted[feature])
            owner, feature = owner[keep], feature[keep]
        found.append(np.unique(owner.astype(np.uint64) << np.uint64(32) | feature))
    key = np.concatenate(found) if found else np.zeros(0, np.uint64)
    return (key >> np.uint64(32)).astype(np.int64), (key & np.uint64(0xFFFFFFFF)).astype(np.int64)


def fit(sample: pd.DataFrame) -> dict:
    """Features (int32), weights (float32) and bias of the model; without positive rows every score is 0."""
    texts, label = sample["text"].tolist(), sample["label"].to_numpy(np.float64)
    positive, negative = label.sum(), len(label) - label.sum()
    if not positive:
        return {"features": b"", "weights": b"", "bias": -np.inf}
    size = len(ORDERS) << BITS
    spans = list(pieces([len(x or "") for x in texts], 1 << 20))
    count = np.zeros((2, size))
    for a, b in spans:
        doc, feature = present(texts[a:b])
        is_on = label[a:b][doc] > 0
        count[1] += np.bincount(feature[is_on], minlength=size)
        count[0] += np.bincount(feature[~is_on], minlength=size)
    on, off = count[1] / positive, count[0] / max(negative, 1)
    both = count.sum(axis=0) / len(label)
    error = np.sqrt(both * (1 - both) * (1 / positive + 1 / max(negative, 1))) + 1e-12
    ratio = np.log((count[1] + SMOOTH) / (positive + SMOOTH)) - np.log((count[0] + SMOOTH) / (negative + SMOOTH))
    wanted = (np.abs(on - off) / error >= SURE) & (count.sum(axis=0) >= 3)
    chosen = np.flatnonzero(wanted)
    number = np.full(size, -1)
    number[chosen] = np.arange(len(chosen))
    rows, columns = [], []
    for a, b in spans:
        doc, feature = present(texts[a:b], wanted)
        rows.append(doc + a)
        columns.append(number[feature])
    row, column = np.concatenate(rows), np.concatenate(columns)
    scaled = ratio[chosen]
    value = scaled[column]

    weight, bias = np.zeros(len(chosen)), np.log((positive + 1) / (negative + 1))
    moment, spread = np.zeros(len(chosen) + 1), np.zeros(len(chosen) + 1)
    for step in range(1, STEPS + 1):  # Adam on the logistic loss
        margin = np.bincount(row, value * weight[column], len(label)) + bias
        slope = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - label) / len(label)
        gradient = np.append(np.bincount(column, value * slope[row], len(chosen)) + DECAY * weight, slope.sum())
        moment = 0.9 * moment + 0.1 * gradient
        spread = 0.99 * spread + 0.01 * gradient**2
        move = 0.05 * moment / (1 - 0.9**step) / (np.sqrt(spread / (1 - 0.99**step)) + 1e-10)
        weight, bias = weight - move[:-1], bias - move[-1]
    return {"features": chosen.astype("<i4").tobytes(), "weights": (weight * scaled).astype("<f4").tobytes(), "bias": float(bias)}


def scorer(spark: SparkSession, model):
    """Column function: score (0 to 1) of whole texts by a fitted model."""
    size = len(ORDERS) << BITS
    shared = spark.sparkContext.broadcast((bytes(model["features"]), bytes(model["weights"]), model["bias"]))

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        features, weights, bias = shared.value
        weight = np.zeros(size, np.float32)
        weight[np.frombuffer(features, "<i4")] = np.frombuffer(weights, "<f4")
        wanted = weight != 0
        for batch in batches:
            texts = batch.tolist()
            margins = np.zeros(len(texts))
            for a, b in pieces([len(x or "") for x in texts]):
                doc, feature = present(texts[a:b], wanted)
                margins[a:b] = np.bincount(doc, weight[feature], b - a)
            with np.errstate(over="ignore"):
                yield pd.Series(1 / (1 + np.exp(-(margins + bias))))

    return score


def trained(docs: DataFrame, labels: DataFrame, learn_from=None, label: str = "toxic", sample: int = SAMPLE,
            key: str = "doc_id", text: str = "text"):
    """Column function that scores texts, fitted on labelled rows (see ``toxicity``)."""
    known = labels if learn_from is None else labels.where(learn_from)
    model = fit_in_task(labelled_sample(docs, known, label, sample, key, text), fit, "features binary, weights binary, bias double")
    return scorer(spark_of(docs), model)


def toxicity(docs: DataFrame, labels: DataFrame, learn_from=None, label: str = "toxic", sample: int = SAMPLE,
             key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fit on labelled rows and score every row: key, ``score``, ``predicted`` (score of at least a half).

    ``learn_from``: condition on the key for rows that may be learnt from (all, if not given). At most
    ``sample`` of them are used. Only the text enters a score. Null, empty and blank texts get the score of
    a text without features; repeated rows are scored each; with no positive label every score is 0; empty
    tables give no rows; other columns are not looked at.
    """
    score = trained(docs, labels, learn_from, label, sample, key, text)
    return docs.select(F.col(key), score(F.col(text)).alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def clean(docs: DataFrame, labels: DataFrame, learn_from=None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with their columns."""
    name = fresh("toxicity", docs)
    scored = docs.withColumn(name, trained(docs, labels, learn_from, key=key, text=text)(F.col(text)))
    return scored.where(F.col(name) < 0.5).select(*docs.columns)


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    part = remainder("doc_id", 5)
    found = toxicity(docs, labels, part != 0)
    return found.select("doc_id", (part == 0).alias("held_out"), "score", "predicted")
