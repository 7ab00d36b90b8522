"""Toxic spans by a linear-chain conditional random field with two tags.

Training tokens are labelled from the documents' labels: in a toxic document, the
tokens whose name or beginning is found in many toxic and next to no other
documents. The field's token scores are sums of learned weights of hashed
features (name, beginnings, endings), its transitions are learned too; numpy
stochastic gradient descent maximises the likelihood of the tags. Marginals by
forward-backward give the offending offsets, and the largest marginal and their
sum give the document's score by a logistic fit.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyrail.llm.common import TwoGenerations, parts
from tallyrail.llm.training import Ragged, bucket, fold, sample

BITS, STEPS, RATE = 18, 120, 0.5
#: Labelled documents of each class that training may use.
ROWS_PER_CLASS = (2400, 800)
THRESHOLD, SPAN = 0.3, 0.5
FOLDS, HELD_OUT = 4, 2
#: A clue is in at least so many toxic documents, and at most that share of those with it is not toxic.
CLUE_DOCS, CLUE_SHARE = 4, 0.1
_CORE = re.compile(r"^[\W\d_]+|[\W\d_]+$")


def names(token: str) -> list[str]:
    """Names of a token's features: its lower-case core, beginnings and endings."""
    core = token.lower()
    if not core.isalpha():
        core = _CORE.sub("", core)
    size = len(core)
    return [f"={core}", *[f"^{core[:n]}" for n in range(3, min(9, size + 1))], *[f"{core[-n:]}$" for n in (3, 4) if size >= n]]


def features(token: str) -> list[int]:
    """Buckets of a token's features."""
    return [bucket(n, BITS) for n in names(token)]


def messages(score: np.ndarray, first: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward and backward messages of many chains laid end to end, a normalised pair for each token, and its emissions.

    ``score`` is a token's log-odds of tag 1, ``first`` marks the first token of
    each chain, ``trans`` the transition scores (from, to). A pass goes over a
    square grid: maps of whole rows are composed side by side, then applied row
    by row, so that no step is longer than the square root of the input.
    """
    n = len(score)
    move = np.exp(trans)
    odds = np.exp(np.clip(score, -30, 30))
    width = int(np.ceil(np.sqrt(n)))
    pad = width * -(-n // width) - n

    def scan(steps: np.ndarray) -> np.ndarray:
        """Normalised row vectors v[t] with v[t] = v[t-1] @ steps[t], from v[-1] = (1, 1)."""
        grid = np.concatenate((steps, np.broadcast_to(np.eye(2), (pad, 2, 2)))).reshape(-1, width, 2, 2)
        whole = np.broadcast_to(np.eye(2), (len(grid), 2, 2))
        for c in range(width):
            whole = whole @ grid[:, c]
            whole = whole / whole.sum((1, 2), keepdims=True)
        enter, v = np.empty((len(grid), 2)), np.array([0.5, 0.5])
        for r in range(len(grid)):
            enter[r] = v
            v = v @ whole[r]
            v = v / v.sum()
        out = np.empty((len(grid), width, 2))
        for c in range(width):
            enter = np.einsum("ri,rij->rj", enter, grid[:, c])
            enter /= enter.sum(1, keepdims=True)
            out[:, c] = enter
        return out.reshape(-1, 2)[:n]

    emit = np.stack((1 / (1 + odds), odds / (1 + odds)), 1)
    step = move[None] * emit[:, None, :]
    step[first] = emit[first][:, None, :]  # a chain's first token forgets what came before
    ahead = scan(step)
    # Backward: b[t] = move @ (emit[t+1] * b[t+1]), and (1, 1) at a chain's last token.
    last = np.append(first[1:], True)
    back = np.empty((n, 2, 2))
    back[:-1] = (move[None] * emit[1:, None, :]).transpose(0, 2, 1)
    back[last] = 1.0
    return ahead, scan(back[::-1])[::-1], emit


def chain(score: np.ndarray, first: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Probability of tag 1 at every token of many chains laid end to end."""
    if not len(score):
        return score
    ahead, behind, _ = messages(score, first, trans)
    both = ahead * behind
    return both[:, 1] / both.sum(1)


def gradient(score: np.ndarray, first: np.ndarray, trans: np.ndarray, tag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the tags' negative log-likelihood by the tokens' scores and by the transitions, from exact marginals."""
    ahead, behind, emit = messages(score, first, trans)
    both = ahead * behind
    p = both[:, 1] / both.sum(1)
    i = np.flatnonzero(~first[1:])
    pair = ahead[i, :, None] * np.exp(trans)[None] * (emit[i + 1] * behind[i + 1])[:, None, :]
    pair /= pair.sum((1, 2), keepdims=True)
    seen = np.bincount(2 * tag[i].astype(int) + tag[i + 1], minlength=4).reshape(2, 2)
    return p - tag, pair.sum(0) - seen


@dataclass
class ToxicModel:
    """Weights by bucket, transitions, and the logistic fit of (bias, largest log-odds, log of the sum)."""

    weights: np.ndarray
    bias: float
    trans: np.ndarray
    fit: np.ndarray

    def memo(self, cap: int = 300_000) -> TwoGenerations:
        """A token's log-odds by token; beginnings and endings are few and are kept likewise."""
        weights = self.weights.tolist()
        part = TwoGenerations(lambda name: weights[bucket(name, BITS)], cap).__getitem__

        def value(token: str) -> float:
            core, *parts = names(token)
            return self.bias + weights[bucket(core, BITS)] + sum(map(part, parts))

        return TwoGenerations(value, cap)

    def marginals(self, texts: list[list[str]], memo: TwoGenerations) -> list[np.ndarray]:
        """Probabilities of the toxic tag for the tokens of each text."""
        ends = np.cumsum([len(t) for t in texts])
        score = np.fromiter((memo[w] for t in texts for w in t), float, int(ends[-1]) if len(ends) else 0)
        first = np.zeros(len(score), bool)
        starts = np.concatenate(([0], ends[:-1])).astype(np.int64) if len(ends) else np.empty(0, np.int64)
        first[starts[[len(t) > 0 for t in texts]] if len(texts) else starts] = True
        return np.split(chain(score, first, self.trans), ends[:-1]) if len(texts) else []

    def document(self, p: np.ndarray) -> float:
        """A document's score from its tokens' marginals; without tokens, that of the least one."""
        z = float(self.fit @ summary(p))
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


def summary(p: np.ndarray) -> np.ndarray:
    """Bias, log-odds of the largest marginal, and log of one plus the sum of those over a half."""
    top = min(max(float(p.max()) if len(p) else 0.0, 1e-6), 1 - 1e-6)
    return np.array([1.0, np.log(top / (1 - top)), np.log1p(float(p[p > 0.5].sum()) if len(p) else 0.0)])


def clues(texts: list[list[str]], y: np.ndarray) -> set[str]:
    """Feature names that mark toxic tokens: frequent in toxic, next to absent in other documents."""
    seen = (Counter(), Counter())
    known: dict[str, list[str]] = {}
    for words, label in zip(texts, y, strict=True):
        found: set[str] = set()
        for w in set(words):
            if w not in known:
                known[w] = [n for n in names(w) if n[0] == "=" or n[0] == "^"]
            found.update(known[w])
        seen[label].update(found)
    share = max(1e-9, float(np.mean(y)))
    # Chance alone: a name of n documents, none but toxic, has probability share^n; e^-15 clears millions of names.
    least = max(CLUE_DOCS, int(np.ceil(15 / -np.log(min(share, 0.99)))))
    return {n for n, a in seen[1].items() if a >= least and n not in ("=", "^") and seen[0][n] <= CLUE_SHARE * (a + seen[0][n])}


def train(texts: list[str], y: np.ndarray, weight: np.ndarray) -> ToxicModel:
    """Fit the field and the document fit; without both classes the model is a constant."""
    words = [t.split() for t in texts]
    positive = float((weight * y).sum() + 1) / float(weight.sum() + 2) if len(y) else 0.5
    constant = np.array([np.log(positive / (1 - positive)), 0, 0])
    marks = clues(words, y) if len(set(y.tolist())) == 2 else set()
    if not marks:
        return ToxicModel(np.zeros(1 << BITS, np.float32), -8.0, np.zeros((2, 2)), constant)
    ragged = Ragged(features)
    rows = [np.array([ragged.word(w) for w in t], np.int32) for t in words]
    flat, owner = ragged.arrays()
    marked = np.array([any(n in marks for n in names(w)) for w in ragged.at], bool)
    token = np.concatenate(rows)
    tags = np.concatenate([marked[r] & (label == 1) for r, label in zip(rows, y, strict=True)])
    first = np.zeros(len(token), bool)
    first[np.concatenate(([0], np.cumsum([len(r) for r in rows])[:-1]))[[len(r) > 0 for r in rows]]] = True
    w, trans, bias = np.zeros(1 << BITS), np.zeros((2, 2)), -2.0
    g2w, g2t, g2b = np.full(1 << BITS, 1e-6), np.full((2, 2), 1e-6), 1e-6
    rng = np.random.default_rng(3)
    ends = np.flatnonzero(first)
    for _ in range(STEPS):
        # A step takes a window of whole documents.
        a = int(rng.integers(len(ends)))
        lo = ends[a]
        hi = int(np.append(ends, len(token))[min(a + 160, len(ends))])
        tok, tag, f = token[lo:hi], tags[lo:hi], first[lo:hi]
        by_word = np.bincount(owner, w[flat], len(ragged.at)) + bias
        residual, gt = gradient(by_word[tok], f, trans, tag)
        g = np.bincount(flat, np.bincount(tok, residual, len(ragged.at))[owner], 1 << BITS) / max(1, tag.sum()) + 1e-5 * w
        gt = gt / max(1, tag.sum()) + 1e-4 * trans
        gb = residual.sum() / max(1, tag.sum())
        g2w += g * g
        g2t += gt * gt
        g2b += gb * gb
        w -= RATE * g / np.sqrt(g2w)
        trans -= 0.05 * gt / np.sqrt(g2t)
        bias -= RATE * gb / np.sqrt(g2b)
    model = ToxicModel(w.astype(np.float32), bias, trans, constant)
    memo = model.memo()
    x = np.concatenate([[summary(p) for p in model.marginals(words[i : i + 200], memo)] for i in range(0, len(words), 200)])
    # The classes count by their true shares; a small ridge keeps the fit finite where they are apart.
    a, share = np.zeros(3), weight * len(weight) / weight.sum()
    for _ in range(20):
        p = 1 / (1 + np.exp(-np.clip(x @ a, -30, 30)))
        h = (x * (share * p * (1 - p))[:, None]).T @ x + 1e-5 * len(x) * np.diag([0.01, 1, 1])
        a -= np.linalg.solve(h, x.T @ (share * (p - y)) + 1e-5 * len(x) * np.array([0.01, 1, 1]) * a)
    model.fit = a
    return model


def fit(docs: DataFrame, labels: DataFrame, rows_per_class: tuple[int, int] = ROWS_PER_CLASS) -> ToxicModel:
    """Train on the labelled rows outside the held-out fold, at most ``rows_per_class`` of the classes."""
    rows = sample(docs, labels, "toxic", FOLDS, HELD_OUT, rows_per_class)
    return train(rows["text"].tolist(), rows["y"].to_numpy(np.int64), rows["weight"].to_numpy(float))


def tag(docs: DataFrame, model: ToxicModel) -> DataFrame:
    """doc_id, score, spans (start, end in code points, p) of every row's whole text.

    Null and empty texts have no span and the score of a text without toxic tokens.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        memo = model.memo()
        for pdf in parts(batches):
            texts = [t or "" for t in pdf["text"]]
            for at in range(0, len(texts), 100):
                part = texts[at : at + 100]
                marginals = model.marginals([t.split() for t in part], memo)
                spans = [spans_of(t, p) for t, p in zip(part, marginals, strict=True)]
                yield pd.DataFrame({"doc_id": pdf["doc_id"].iloc[at : at + 100].astype("Int64").array, "score": [model.document(p) for p in marginals], "spans": spans})
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, "doc_id long, score double, spans array<struct<start:int,end:int,p:double>>")


def spans_of(text: str, p: np.ndarray) -> list[dict]:
    """Runs of tokens with a marginal over a half, as offsets; the run's largest marginal."""
    out: list[dict] = []
    if not len(p) or p.max() <= SPAN:
        return out
    before = -2
    for i, m in enumerate(re.finditer(r"\S+", text)):
        if p[i] > SPAN:
            if before == i - 1:
                out[-1]["end"], out[-1]["p"] = m.end(), max(out[-1]["p"], float(p[i]))
            else:
                out.append({"start": m.start(), "end": m.end(), "p": float(p[i])})
            before = i
    return out


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, spans per row of ``docs``; a null doc_id is in no fold (held_out false)."""
    tagged = tag(docs, fit(docs, labels))
    return tagged.select("doc_id", F.coalesce(fold(folds=FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "spans")
