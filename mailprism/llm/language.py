"""Language identification: a bidirectional gated recurrent network over bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mailprism.llm.common import Scratch, fit_in_task, pieces, remainder, spark_of

HIDDEN = 8  # units of a direction
SPAN = 64  # bytes that a state is carried over
ROWS = 2048  # spans that run side by side, at most
CELLS = 1 << 25  # probabilities that they have, about
PER_LANGUAGE = 800  # documents of a language to fit on, at most
SAMPLE = 204_800  # documents to fit on: with more languages each has fewer, but at least one
SPANS = 6  # of a document to fit on, evenly over its text
EPOCHS = 8
UNKNOWN = "und"


def spans_of(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whole texts cut into spans: bytes (spans, SPAN) padded by zero, lengths, document of each span."""
    sizes = np.array([len(x) for x in raw], np.int64)
    counts = -(-sizes // SPAN)
    owner = np.repeat(np.arange(len(raw)), counts)
    data = np.frombuffer(b"".join(x + b"\0" * (-len(x) % SPAN) for x in raw), np.uint8).reshape(-1, SPAN)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    return data, np.minimum(sizes[owner] - within * SPAN, SPAN), owner


class Network:
    """Two recurrent layers, forwards and backwards, and a softmax over languages at every byte.

    A step: z, r = sigmoid(x + h U); n = tanh(x + r * (h U)); h = n + z * (h - n). The input of a step is a
    row of a table with one entry per byte value.
    """

    def __init__(self, languages: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        h = HIDDEN
        self.p = {f"{name}{d}": (rng.normal(0, scale, shape)).astype(np.float32) for d in "fb" for name, shape, scale in
                  (("x", (256, 3 * h), 0.3), ("u", (h, 3 * h), 1 / np.sqrt(h)), ("o", (h, languages), 1 / np.sqrt(h)))}
        self.p["bias"] = np.zeros(languages, np.float32)

    def direction(self, data: np.ndarray, d: str, keep: bool) -> list:
        """States after each byte (in reading order of the direction); with ``keep`` all that the gradient needs."""
        h, x, u = HIDDEN, self.p["x" + d], self.p["u" + d]
        state = np.zeros((len(data), h), np.float32)
        out = []
        for t in range(SPAN) if d == "f" else range(SPAN - 1, -1, -1):
            given, own = x[data[:, t]], state @ u
            gates = given[:, :2 * h] + own[:, :2 * h]
            gates *= 0.5
            np.tanh(gates, out=gates)
            gates *= 0.5
            gates += 0.5
            z, r = gates[:, :h], gates[:, h:]
            new = own[:, 2 * h:] * r
            new += given[:, 2 * h:]
            np.tanh(new, out=new)
            before, state = state, state - new
            state *= z
            state += new
            out.append((t, state, before, z, r, new, own[:, 2 * h:]) if keep else (t, state))
        return out

    def probabilities(self, data: np.ndarray) -> np.ndarray:
        """(bytes of a span, spans, languages)."""
        out = np.empty((SPAN, len(data), len(self.p["bias"])), np.float32)
        for t, state in self.direction(data, "f", False):
            np.matmul(state, self.p["of"], out=out[t])
        for t, state in self.direction(data, "b", False):
            out[t] += state @ self.p["ob"]
        out += self.p["bias"]
        out -= out.max(axis=2, keepdims=True)
        np.exp(out, out=out)
        out /= out.sum(axis=2, keepdims=True)
        return out

    def gradient(self, data: np.ndarray, lengths: np.ndarray, label: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean log loss over all bytes, each labelled with its document's language."""
        h = HIDDEN
        kept = {d: self.direction(data, d, True) for d in "fb"}
        logits = np.zeros((SPAN, len(data), len(self.p["bias"])), np.float32) + self.p["bias"]
        for d in "fb":
            for step in kept[d]:
                logits[step[0]] += step[1] @ self.p["o" + d]
        logits -= logits.max(axis=2, keepdims=True)
        slope = np.exp(logits)
        slope /= slope.sum(axis=2, keepdims=True)
        slope[:, np.arange(len(data)), label] -= 1
        slope *= (np.arange(SPAN)[:, None] < lengths)[:, :, None] / np.float32(lengths.sum())
        grad = {k: np.zeros_like(v) for k, v in self.p.items()}
        grad["bias"] = slope.sum(axis=(0, 1))
        for d in "fb":
            u, o = self.p["u" + d], self.p["o" + d]
            back = np.zeros((len(data), h), np.float32)
            inputs, values = [], []
            for t, state, before, z, r, new, own in reversed(kept[d]):
                grad["o" + d] += state.T @ slope[t]
                back = back + slope[t] @ o.T
                d_new = back * (1 - z) * (1 - new * new)
                d_gate = np.concatenate([back * (before - new) * z * (1 - z), d_new * own * r * (1 - r), d_new], axis=1)
                values.append(d_gate)
                inputs.append(data[:, t])
                through = d_gate.copy()
                through[:, 2 * h:] *= r
                grad["u" + d] += before.T @ through
                back = back * z + through @ u.T
            at, value = np.concatenate(inputs), np.concatenate(values)
            grad["x" + d] = np.stack([np.bincount(at, value[:, k], 256) for k in range(3 * h)], axis=1).astype(np.float32)
        return grad


def fit(sample: pd.DataFrame) -> dict:
    """Languages and parameters of a network trained by backpropagation through time over the sample."""
    names = sorted(sample["lang"].unique())
    raw = [x.encode("utf-8", "surrogatepass") for x in sample["text"]]
    if not any(raw):
        return {"languages": [], "parameters": []}
    network = Network(len(names))
    data, lengths, owner = spans_of(raw)
    counts = np.bincount(owner, minlength=len(raw))
    first = np.cumsum(counts) - counts
    number = np.arange(len(owner)) - first[owner]
    chosen = np.flatnonzero((number * SPANS) // counts[owner] != ((number - 1) * SPANS) // counts[owner])
    data, lengths = data[chosen], lengths[chosen]
    label = np.searchsorted(names, sample["lang"].to_numpy())[owner[chosen]]
    rng = np.random.default_rng(11)
    share = np.bincount(label, minlength=len(names))
    weight = 1 / share[label]
    moment, spread, step = ({k: np.zeros_like(v) for k, v in network.p.items()} for _ in range(2)), None, 0
    moment, spread = moment
    rounds = EPOCHS * max(12, len(data) // 256)
    for step in range(1, rounds + 1):  # Adam; every language is drawn equally often
        batch = rng.choice(len(data), min(256, 8 * len(data)), p=weight / weight.sum())
        rate = 0.02 * (1 - step / (rounds + 1)) + 0.0005
        for k, g in network.gradient(data[batch], lengths[batch], label[batch]).items():
            g = np.clip(g, -1, 1)
            moment[k] = 0.9 * moment[k] + 0.1 * g
            spread[k] = 0.99 * spread[k] + 0.01 * g * g
            network.p[k] -= np.float32(rate) * (moment[k] / (1 - 0.9**step)) / (np.sqrt(spread[k] / (1 - 0.99**step)) + np.float32(1e-8))
    return {"languages": names, "parameters": [network.p[k].astype("<f4").tobytes() for k in sorted(network.p)]}


def training_rows(docs: DataFrame, learn_from: Column | None, per_language: int, key: str, text: str, lang: str, sample: int = SAMPLE) -> DataFrame:
    """Rows (text, lang) of every language, in a pseudo-random order of their keys: at most ``per_language`` of each, and
    ``sample`` shared evenly among the languages, but one of each at least.

    Before a language's keys are ranked they are cut by a hash threshold that its count sets, so that its task sees few
    more than it keeps, however many files there are.
    """
    known = docs.where(F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}"))
    known = (known if learn_from is None else known.where(learn_from)).select(
        F.col(key).alias("k"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    scratch = Scratch(spark_of(docs), "languages")
    often = scratch.save(known.groupBy("lang").agg(F.count(F.lit(1)).alias("rows")))
    each = max(1, min(per_language, sample // max(1, often.count())))

    def first(df: DataFrame, *order: str) -> DataFrame:
        window = Window.partitionBy("lang").orderBy(*order)
        return df.withColumn("n", F.row_number().over(window)).where(F.col("n") <= each).drop("n")

    place = F.col("h") / F.lit(2.0**64) + 0.5  # of a hash among all, from 0 to 1
    keys = known.select("k", "lang").withColumn("h", F.xxhash64("k")).join(often, "lang").where(place <= (4 * each + 200) / F.col("rows"))
    drawn = scratch.save(first(keys.select("k", "lang", "h").distinct(), "h", "k"))
    texts = known.alias("t").join(drawn.alias("d"), F.col("t.k").eqNullSafe(F.col("d.k")) & (F.col("t.lang") == F.col("d.lang")))
    rows = texts.select("t.lang", "t.text", F.xxhash64("t.k", "t.text").alias("h"))
    return first(rows, "h", "text").orderBy("h", "text", "lang").select("text", "lang")


def languages(docs: DataFrame, learn_from: Column | None = None, per_language: int = PER_LANGUAGE, key: str = "doc_id",
              text: str = "text", lang: str = "lang") -> DataFrame:
    """Learn from rows with a language and predict every whole text: key, ``lang_pred``, ``score`` (0 to 1).

    Each byte gets a probability per language; their mean over the text is the document's. Null texts, texts
    without a letter, and all texts when no language is known, get ``und`` and score 0. ``learn_from``: condition
    on rows that may be learnt from; every language is learnt, from at most ``per_language`` of its rows. Ties go to the first language by name; repeated rows are
    predicted each; empty tables give no rows; other columns are not looked at.
    """
    sample = training_rows(docs, learn_from, per_language, key, text, lang)
    model = fit_in_task(sample, fit, "languages array<string>, parameters array<binary>")
    shared = spark_of(docs).sparkContext.broadcast((list(model["languages"]), [bytes(x) for x in model["parameters"]]))

    @F.pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        names, parameters = shared.value
        network = Network(len(names))
        for k, v in zip(sorted(network.p), parameters):
            network.p[k] = np.frombuffer(v, "<f4").reshape(network.p[k].shape)
        for texts, letters in batches:
            raw = [x.encode("utf-8", "surrogatepass") if some else b"" for x, some in zip(texts, letters)]
            best, score = [], []
            for a, b in pieces([len(x) for x in raw]):
                data, lengths, owner = spans_of(raw[a:b])
                total = np.zeros((b - a, max(1, len(names))))
                step = max(16, min(ROWS, CELLS // (SPAN * max(1, len(names)))))
                for at in range(0, len(data) if names else 0, step):
                    part = slice(at, at + step)
                    sums = (network.probabilities(data[part]) * (np.arange(SPAN)[:, None] < lengths[part])[:, :, None]).sum(axis=0)
                    for k in range(len(names)):
                        total[:, k] += np.bincount(owner[part], sums[:, k], b - a)
                sizes = np.array([len(x) for x in raw[a:b]])
                mean = total / np.maximum(sizes, 1)[:, None]
                best += [names[k] if n and names else UNKNOWN for k, n in zip(mean.argmax(axis=1), sizes)]
                score.append(np.clip(mean.max(axis=1), 0, 1))
            yield pd.DataFrame({"lang_pred": best, "score": np.concatenate(score) if score else []})

    letters = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    found = docs.select(F.col(key).alias("key"), predict(F.col(text), letters).alias("found"))
    return found.select(F.col("key").alias(key), "found.lang_pred", "found.score")


def query(docs: DataFrame) -> DataFrame:
    part = remainder("doc_id", 4)
    return languages(docs, part != 2).select("doc_id", (part == 2).alias("held_out"), "lang_pred", "score")
