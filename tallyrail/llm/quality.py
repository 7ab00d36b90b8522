"""Quality classifier: supervised subword embeddings averaged per document.

A word's vector is the mean of the learned vectors of its hashed name and
character n-grams; each pair of neighbouring words has a hashed bigram too, of
their first letters, since bigrams of whole words are mostly new in a new text. A
document's vector is the mean of its words' and bigrams'. A softmax over two
classes follows. Trained by stochastic gradient descent in numpy on a bounded
sample. As all is linear before the softmax, a word contributes one number to a
document's logit, which a memo keeps while whole texts are scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyrail.llm.common import TwoGenerations, parts
from tallyrail.llm.training import Ragged, bucket, fold, sample

BITS, DIM, EPOCHS, BATCH, RATE = 17, 8, 6, 32, 0.6
#: Steps that training takes at least, in more epochs over a small sample.
STEPS = 270
#: Letters of each word in a bigram.
HEAD = 2
#: Labelled documents of each class that training may use.
ROWS_PER_CLASS = (1000, 1000)
#: Documents scoring below this are rejected.
THRESHOLD = 0.3
FOLDS, HELD_OUT = 5, 0


def names(unit: str) -> list[str]:
    """A word's name and its character 3- and 4-grams, borders marked; a bigram, which has a space, is its name alone."""
    if " " in unit:
        return [unit]
    w = f"<{unit}>"
    return [w, *[w[i : i + 3] for i in range(len(w) - 2)], *[w[i : i + 4] for i in range(len(w) - 3)]]


def features(unit: str) -> list[int]:
    """Buckets of a unit's names."""
    return [bucket(n, BITS) for n in names(unit)]


def units(text: str | None) -> list[str]:
    """The words of a text, and the bigrams of neighbours by their first letters."""
    words = (text or "").split()
    heads = [w[:HEAD] for w in words]
    return words + list(map("{} {}".format, heads, heads[1:]))


@dataclass
class QualityModel:
    """``logits``: a bucket's contribution to log-odds of class 1 before averaging; ``bias`` of the same."""

    logits: np.ndarray
    bias: float

    def memo(self, cap: int = 300_000) -> TwoGenerations:
        """A word's contribution by word; n-grams are few and are kept likewise."""
        logits = self.logits.tolist()
        gram = TwoGenerations(lambda name: logits[bucket(name, BITS)], cap).__getitem__

        def value(word: str) -> float:
            whole, *grams = names(word)
            return (logits[bucket(whole, BITS)] + sum(map(gram, grams))) / (1 + len(grams))

        return TwoGenerations(value, cap)

    def score(self, text: str | None, memo: TwoGenerations) -> float:
        """Probability of class 1 of a whole text; a text without words has the bias's."""
        words = units(text)
        z = self.bias + (sum(map(memo.__getitem__, words)) / len(words) if words else 0.0)
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


def train(texts: list[str], y: np.ndarray, weight: np.ndarray, seed: int = 5) -> QualityModel:
    """Fit the embeddings; with rows of one class only, or none, the model is a constant."""
    positive = float((weight * y).sum() + 1) / float(weight.sum() + 2)
    prior = float(np.log(positive / (1 - positive)))
    if len(set(y.tolist())) < 2:
        return QualityModel(np.zeros(1 << BITS, np.float32), prior)
    ragged, rows = Ragged(features), []
    for text in texts:
        rows.append(np.array([ragged.word(w) for w in units(text)], np.int64))
    flat, owner = ragged.arrays()
    per_word = np.bincount(owner)
    starts = np.concatenate(([0], np.cumsum(per_word)[:-1]))
    rng = np.random.default_rng(seed)
    table = rng.uniform(-1 / DIM, 1 / DIM, (1 << BITS, DIM)).astype(np.float32)
    out, bias = np.zeros((DIM, 2), np.float32), np.zeros(2, np.float32)
    # The classes count alike.
    balance = 0.5 / np.array([max(1e-9, (y == c).mean()) for c in (0, 1)])

    def bag(i: int) -> tuple[np.ndarray, np.ndarray]:
        words, count = np.unique(rows[i], return_counts=True)
        n = per_word[words]
        at = np.repeat(starts[words] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(int(n.sum()))
        return flat[at], np.repeat(count / (len(rows[i]) * n), n).astype(np.float32)

    bags = [bag(i) if len(rows[i]) else (np.empty(0, np.int64), np.empty(0, np.float32)) for i in range(len(rows))]
    batches = -(-len(rows) // BATCH)
    epochs = max(EPOCHS, -(-STEPS // batches))
    steps, step = epochs * batches, 0
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), BATCH):
            part = order[at : at + BATCH]
            idx = np.concatenate([bags[i][0] for i in part])
            w = np.concatenate([bags[i][1] for i in part])
            doc = np.repeat(np.arange(len(part)), [len(bags[i][0]) for i in part])
            vec = np.stack([np.bincount(doc, w * table[idx, d], len(part)) for d in range(DIM)], 1)
            z = vec @ out + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(part)), y[part]] -= 1
            p *= balance[y[part]][:, None]
            rate = RATE * (1 - step / steps)
            grad = (p @ out.T)[doc] * w[:, None]
            out -= (rate * vec.T @ p / len(part)).astype(np.float32)
            bias -= (rate * p.mean(0)).astype(np.float32)
            hit, inverse = np.unique(idx, return_inverse=True)
            # An embedding moves by its documents' own gradients, not by their mean over the batch.
            table[hit] -= (rate * np.stack([np.bincount(inverse, grad[:, d], len(hit)) for d in range(DIM)], 1)).astype(np.float32)
            step += 1
    side = out[:, 1] - out[:, 0]
    model = QualityModel((table @ side).astype(np.float32), float(bias[1] - bias[0]))
    return calibrated(model, texts, y)


def calibrated(model: QualityModel, texts: list[str], y: np.ndarray) -> QualityModel:
    """Scale and shift the logits by a logistic fit in Newton steps, the classes counting alike."""
    memo = model.memo()
    z = np.array([model.bias + (np.mean([memo[w] for w in units(t)]) if t.split() else 0.0) for t in texts])
    weight = 0.5 / np.array([(y == c).mean() for c in (0, 1)])[y]
    x = np.stack((z, np.ones_like(z)), 1)
    a = np.array([1.0, 0.0])
    for _ in range(15):
        p = 1 / (1 + np.exp(-np.clip(x @ a, -30, 30)))
        g = x.T @ (weight * (p - y)) + 1e-4 * weight.sum() * np.array([a[0] - 1, 0])
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag([1e-4 * weight.sum(), 1e-6 * weight.sum()])
        a = a - np.linalg.solve(h, g)
    scale = max(0.1, float(a[0]))
    return QualityModel(model.logits * np.float32(scale), model.bias * scale + float(a[1]))


def fit(docs: DataFrame, labels: DataFrame, rows_per_class: tuple[int, int] = ROWS_PER_CLASS) -> QualityModel:
    """Train on the labelled rows outside the held-out fold, at most ``rows_per_class`` of the classes."""
    rows = sample(docs, labels, "quality", FOLDS, HELD_OUT, rows_per_class)
    return train(rows["text"].tolist(), rows["y"].to_numpy(np.int64), rows["weight"].to_numpy(float))


def score(docs: DataFrame, model: QualityModel) -> DataFrame:
    """doc_id, score of every row's whole text. Null and empty texts score the model's constant."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        memo = model.memo()
        for pdf in parts(batches):
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "score": [model.score(t, memo) for t in pdf["text"]]})
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, "doc_id long, score double")


def accepted(docs: DataFrame, model: QualityModel, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose text scores ``threshold`` or more."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = [c.lower() for c in docs.columns].index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        memo = model.memo()
        for batch in batches:
            yield batch.filter(pa.array([model.score(t, memo) >= threshold for t in batch.column(at).to_pylist()], pa.bool_()))
    return docs.mapInArrow(run, docs.schema)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted per row of ``docs``; a null doc_id is in no fold (held_out false)."""
    scored = score(docs, fit(docs, labels))
    return scored.select("doc_id", F.coalesce(fold(folds=FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
