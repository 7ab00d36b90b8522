"""Language of documents and of their words by a linear-chain conditional random field.

The tags are the languages of the training documents. A word's scores are sums of
learned weights of its affixes, its character n-grams and its place in a lexicon
learned from the same documents; the scores of going from one language to another
are learned too. Training chains are spliced from runs of words of documents of
several languages, so that the field sees text that switches; numpy stochastic
gradient descent raises the likelihood of their tags. Forward-backward gives every
word's marginals; a document's language is that of the largest sum of them.

Words are runs of letters. Null texts and texts without a letter are `und` with
score 0 and no runs, as are all texts where nothing can be learned. Rows of one
doc_id have a row each; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyrail.llm.common import mix
from tallyrail.llm.training import bucket, fold

FOLDS, HELD_OUT = 5, 0
#: Training documents of each language, and languages, at most.
ROWS_PER_LANG, LANGS = 400, 64
#: Rows that are ranked for each that is taken.
SPARE = 8
BITS, STEPS, CHAIN, RATE = 16, 200, 4096, 0.2
#: Mean length of the runs of words that training chains are spliced from.
RUN = 30
#: Documents of a language that a lexicon's word is in at least.
LEXICON_DOCS = 3
#: Words whose scores a task keeps, words of texts that it turns over at a time: memory bounds.
KEPT_WORDS, WORDS_IN_HAND = 300_000, 100_000
#: Tokens of a step of the passes over many chains.
SEGMENT = 64
UNKNOWN = "und"
_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    """Runs of letters of a text, in lower case; none if it has no letter."""
    words = _WORD.findall((text or "").lower())
    return words if any(map(str.isalpha, words)) else []


def _bucket(key: np.ndarray, kind: int) -> np.ndarray:
    """Buckets of features from up to three code points packed in 21 bits each, and their kind."""
    return (mix(key + np.uint64(kind * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) >> np.uint64(64 - BITS)).astype(np.int64)


def features(words: list[str], lexicon: dict[str, tuple[int, ...]]) -> tuple[np.ndarray, np.ndarray]:
    """(owner, bucket) of the features of lower-case words, in no order.

    Prefixes and suffixes of up to three letters, 2- and 3-grams, and what the
    lexicon says of the word, or that it says nothing.
    """
    size = np.fromiter(map(len, words), np.int64, len(words))
    code = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    number, start = np.arange(len(words)), np.cumsum(size) - size
    end, shift = start + size, np.uint64(21)
    # packed[n][i]: the n letters from i on; those that go over a word's end are left out below.
    packed = [code]
    for n in (1, 2):
        packed.append((packed[-1][:-1] << shift) | code[n:])
    owners, buckets = [], []
    for n, keys in enumerate(packed, 1):
        long = size >= n
        owners += [number[long]] * 2
        buckets += [_bucket(keys[start[long]], n), _bucket(keys[end[long] - n], 3 + n)]
        if n > 1:
            owner = np.repeat(number, size)[: len(keys)]
            inside = np.arange(len(keys)) + n <= end[owner]
            owners.append(owner[inside])
            buckets.append(_bucket(keys[inside], 5 + n))
    said = [lexicon.get(w, NO_WORD) for w in words]
    owners.append(np.repeat(number, [len(x) for x in said]))
    buckets.append(np.fromiter((b for x in said for b in x), np.int64, len(owners[-1])))
    return np.concatenate(owners), np.concatenate(buckets)


#: The bucket of words that the lexicon has not.
NO_WORD = (bucket("no word", BITS),)


def lexicon_of(texts: list[list[str]], langs: list[str]) -> dict[str, tuple[int, ...]]:
    """For words of LEXICON_DOCS documents of a language: buckets of that language with the part, in tenths, of the word's documents that are of it."""
    seen: dict[str, Counter] = {}
    for words, lang in zip(texts, langs, strict=True):
        for w in set(words):
            seen.setdefault(w, Counter())[lang] += 1
    out = {}
    for w, by in seen.items():
        total = sum(by.values())
        found = tuple(bucket(f"lexicon {lang} {10 * n // total}", BITS) for lang, n in sorted(by.items()) if n >= LEXICON_DOCS)
        if found:
            out[w] = found
    return out


def passes(emit: np.ndarray, lengths: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward messages of chains laid end to end, normalised, ``emit`` of the token itself in the forward one only.

    ``emit`` (tokens, tags) are factors of the tokens, ``lengths`` the chains' lengths, none 0, and
    ``move`` (from, to) the factors of transitions. Chains are cut into segments of
    a fixed number of tokens. All segments go ahead side by side: first as
    matrices, which give each segment's entering message, chain by chain; then
    with that message. The same is done backward.
    """
    tags = len(move)
    per = -(-lengths // SEGMENT)
    first = np.cumsum(per) - per
    last = first + per - 1
    segments = int(per.sum())
    # Place of every token in the grid of segments.
    inside = np.arange(len(emit)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    row, col = np.repeat(first, lengths) + inside // SEGMENT, inside % SEGMENT
    grid = np.ones((segments, SEGMENT, tags))
    grid[row, col] = emit
    ends = (lengths - 1) % SEGMENT
    by_count = np.argsort(-per, kind="stable")
    active = np.array([int((per > j).sum()) for j in range(int(per.max()))])
    uniform = np.full(tags, 1 / tags)

    def scaled(x: np.ndarray) -> np.ndarray:
        return x / x.sum(-1, keepdims=True)

    # Forward. ``whole`` and ``step`` are written over and over.
    whole, step = np.tile(np.eye(tags), (segments, 1, 1)), np.empty((segments, tags, tags))
    for c in range(SEGMENT):
        np.matmul(whole.reshape(-1, tags), move, out=step.reshape(-1, tags))
        if c == 0:
            step[first] = 1.0  # a chain's first token has nothing before it
        np.multiply(step, grid[:, c, None, :], out=whole)
        if c % 4 == 3:
            whole /= whole.max((1, 2), keepdims=True)
    enter = np.tile(uniform, (segments, 1))
    for j in range(len(active) - 1):
        own = first[by_count[: active[j + 1]]] + j
        enter[own + 1] = scaled(np.einsum("si,sij->sj", enter[own], whole[own]))
    ahead = np.empty_like(grid)
    v = enter
    for c in range(SEGMENT):
        v = v @ move
        if c == 0:
            v[first] = 1.0
        v *= grid[:, c]
        v /= v.sum(1, keepdims=True)
        ahead[:, c] = v

    # Backward: at a chain's last token 1, before a token what follows times its factor.
    back = move.T.copy()
    at_end = [last[ends == c] for c in range(SEGMENT)]
    whole[:] = np.eye(tags)
    for c in range(SEGMENT - 1, -1, -1):
        whole[at_end[c]] = 1.0
        np.multiply(whole, grid[:, c, None, :], out=step)
        np.matmul(step.reshape(-1, tags), back, out=whole.reshape(-1, tags))
        if c % 4 == 0:
            whole /= whole.max((1, 2), keepdims=True)
    enter = np.tile(uniform, (segments, 1))
    for j in range(len(active) - 1):
        own = last[by_count[: active[j + 1]]] - j
        enter[own - 1] = scaled(np.einsum("si,sij->sj", enter[own], whole[own]))
    behind = np.empty_like(grid)
    v = enter
    for c in range(SEGMENT - 1, -1, -1):
        v[at_end[c]] = uniform
        behind[:, c] = v
        v = (v * grid[:, c]) @ back
        v /= v.sum(1, keepdims=True)
    return ahead[row, col], behind[row, col]


def factors(score: np.ndarray) -> np.ndarray:
    """Factors of tokens from their scores, the largest of each 1; no tag is impossible."""
    return np.exp(np.maximum(score - score.max(1, keepdims=True), -30.0)).astype(float)


def marginals(score: np.ndarray, lengths: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Every token's probabilities of the tags, chains laid end to end."""
    ahead, behind = passes(factors(score), lengths, np.exp(trans))
    both = ahead * behind
    return both / both.sum(1, keepdims=True)


def gradient(score: np.ndarray, lengths: np.ndarray, trans: np.ndarray, tag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the tags' negative log-likelihood by the scores and by the transitions, from exact marginals."""
    emit, move = factors(score), np.exp(trans)
    ahead, behind = passes(emit, lengths, move)
    both = ahead * behind
    p = both / both.sum(1, keepdims=True)
    p[np.arange(len(tag)), tag] -= 1
    before = np.ones(len(tag), bool)
    before[np.cumsum(lengths) - 1] = False
    i = np.flatnonzero(before)
    pair = ahead[i, :, None] * move[None] * (emit[i + 1] * behind[i + 1])[:, None, :]
    pair /= pair.sum((1, 2), keepdims=True)
    tags = len(trans)
    return p, pair.sum(0) - np.bincount(tags * tag[i] + tag[i + 1], minlength=tags * tags).reshape(tags, tags)


@dataclass
class LangModel:
    """Languages in order, weights (bucket, language), transitions, lexicon."""

    langs: list[str]
    weights: np.ndarray
    trans: np.ndarray
    lexicon: dict[str, tuple[int, ...]]


@dataclass
class Scores:
    """Scores of words under a model; those of at most ``cap`` words are kept."""

    model: LangModel
    cap: int = KEPT_WORDS
    at: dict[str, int] = field(default_factory=dict)
    table: np.ndarray | None = None

    def of(self, words: list[str]) -> np.ndarray:
        """A row of scores for each lower-case word."""
        new = list({w for w in words if w not in self.at})
        if len(self.at) + len(new) > self.cap:
            self.at, self.table, new = {}, None, list(set(words))
        if new:
            owner, flat = features(new, self.model.lexicon)
            rows = np.stack([np.bincount(owner, w[flat], len(new)) for w in self.model.weights.T], 1)
            self.at.update(zip(new, range(len(self.at), len(self.at) + len(new)), strict=True))
            self.table = rows if self.table is None else np.concatenate((self.table, rows))
        return self.table[np.fromiter(map(self.at.__getitem__, words), np.int64, len(words))]


def train(texts: list[str], langs: list[str], seed: int = 11) -> LangModel:
    """Fit the field to texts of known languages; without a text that has words it has no languages."""
    found = [(words, lang) for t, lang in zip(texts, langs, strict=True) if (words := words_of(t))]
    every = sorted({lang for _, lang in found})
    tags = len(every)
    lexicon = lexicon_of([w for w, _ in found], [lang for _, lang in found])
    weights, trans = np.zeros((1 << BITS, tags), np.float32), np.zeros((tags, tags))
    model = LangModel(every, weights, trans, lexicon)
    if tags < 2:
        return model
    number: dict[str, int] = {}
    docs = [(np.array([number.setdefault(w, len(number)) for w in words], np.int64), every.index(lang)) for words, lang in found]
    owner, flat = features(list(number), lexicon)
    flat = flat[np.argsort(owner, kind="stable")]
    sizes = np.bincount(owner)
    starts = np.cumsum(sizes) - sizes
    by_tag = [[ids for ids, tag in docs if tag == t] for t in range(tags)]
    rng = np.random.default_rng(seed)
    g2, g2t = np.full(weights.shape, 1e-4, np.float32), np.full(trans.shape, 1e-4)
    for step in range(STEPS):
        # Runs of documents of languages drawn alike.
        token, tag, size = [], [], 0
        while size < CHAIN:
            t = int(rng.integers(tags))
            ids = by_tag[t][int(rng.integers(len(by_tag[t])))]
            a, n = int(rng.integers(len(ids))), int(rng.geometric(1 / RUN))
            part = ids[a : a + n]
            token.append(part)
            tag.append(np.full(len(part), t))
            size += len(part)
        token, tag = np.concatenate(token), np.concatenate(tag)
        seen, place = np.unique(token, return_inverse=True)
        n = sizes[seen]
        cut = np.cumsum(n) - n
        own = flat[np.repeat(starts[seen] - cut, n) + np.arange(int(n.sum()))]
        score = np.add.reduceat(weights[own], cut, axis=0).astype(float)
        p, gt = gradient(score[place], np.array([len(token)]), trans, tag)
        by_word = np.stack([np.bincount(place, p[:, k], len(seen)) for k in range(tags)], 1)
        hit, at = np.unique(own, return_inverse=True)
        each = np.repeat(by_word, n, axis=0)
        g = np.stack([np.bincount(at, each[:, k], len(hit)) for k in range(tags)], 1).astype(np.float32) / RUN
        g2[hit] += g * g
        rate = RATE * (1 - step / STEPS)
        weights[hit] -= rate * (g / np.sqrt(g2[hit]) + 1e-3 * weights[hit])
        gt = gt / RUN
        g2t += gt * gt
        trans -= rate * (gt / np.sqrt(g2t) + 1e-3 * trans)
    return model


def sample(docs: DataFrame, rows_per_lang: int = ROWS_PER_LANG, langs: int = LANGS) -> pd.DataFrame:
    """text, lang of at most ``rows_per_lang`` documents, outside the held-out fold, of each of the ``langs`` most frequent languages.

    The documents of least hash of their id are taken; of rows of one id and
    language that of the smallest text. Null ids, texts and languages are no examples.
    """
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), "text").where("doc_id IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL")
    known = known.where(fold(folds=FOLDS) != HELD_OUT)
    often = {r["lang"]: r["count"] for r in known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(langs).collect()}
    if not often:
        return pd.DataFrame({"doc_id": [], "lang": [], "text": []})
    # Of a frequent language only hashes that can be among the least are ranked: SPARE times as many rows as are taken.
    below = F.create_map(*(F.lit(x) for lang, n in often.items() for x in (lang, int(min(1.0, SPARE * rows_per_lang / n) * (2**64 - 2**11) - 2**63))))
    number = F.xxhash64("doc_id", F.lit(23))
    first = Window.partitionBy("lang").orderBy("h", "doc_id")
    ids = known.where(F.col("lang").isin(list(often))).select("doc_id", "lang", number.alias("h")).where(F.col("h") <= below[F.col("lang")])
    ids = ids.withColumn("r", F.row_number().over(first)).where(F.col("r") <= rows_per_lang)
    got = known.join(F.broadcast(ids.select("doc_id", "lang").distinct()), ["doc_id", "lang"]).groupBy("doc_id", "lang").agg(F.min("text").alias("text")).toPandas()
    return got.sort_values(["doc_id", "lang"]).reset_index(drop=True)


def fit(docs: DataFrame) -> LangModel:
    """Train on the documents outside the held-out fold, a bounded sample of each language."""
    rows = sample(docs)
    return train(rows["text"].tolist(), rows["lang"].tolist())


def runs_of(words: list[str], tag: np.ndarray, langs: list[str]) -> list[dict]:
    """The runs of words of one language: first word, word after the last, language."""
    cuts = np.flatnonzero(np.diff(tag)) + 1
    return [{"start": int(a), "end": int(b), "lang": langs[int(tag[a])]} for a, b in zip([0, *cuts], [*cuts, len(words)], strict=True)]


def label(docs: DataFrame, model: LangModel) -> DataFrame:
    """doc_id, lang_pred, score (the language's part of the marginals), runs (of words of one language: number of the first, of that after the last, lang) of every row's whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = "doc_id long, lang_pred string, score double, runs array<struct<start:int,end:int,lang:string>>"
    run_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))

    def judged(texts: list[str | None], words: list[list[str]], scores: Scores) -> tuple[list, list, list]:
        langs = scores.model.langs
        lengths = np.array([len(w) for w in words], np.int64)
        best, score, runs = [UNKNOWN] * len(texts), [0.0] * len(texts), [[] for _ in texts]
        kept = np.flatnonzero(lengths)
        if not langs or not len(kept):
            return best, score, runs
        p = marginals(scores.of([w for ws in words for w in ws]), lengths[kept], scores.model.trans)
        ends = np.cumsum(lengths[kept])
        sums = np.add.reduceat(p, ends - lengths[kept], axis=0) / lengths[kept, None]
        tag = p.argmax(1)
        for i, a, b, own in zip(kept.tolist(), (ends - lengths[kept]).tolist(), ends.tolist(), sums, strict=True):
            t = int(own.argmax())
            best[i], score[i] = langs[t], min(1.0, float(own[t]))
            runs[i] = runs_of(words[i], tag[a:b], langs)
        return best, score, runs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = Scores(shared.value)
        for batch in batches:
            ids, column, at = batch.column(0), batch.column(1), 0
            while at < len(ids):
                texts, words, held = [], [], 0
                while at + len(texts) < len(ids) and held < WORDS_IN_HAND:
                    texts.append(column[at + len(texts)].as_py())
                    words.append(words_of(texts[-1]))
                    held += len(words[-1])
                best, score, runs = judged(texts, words, scores)
                yield pa.RecordBatch.from_arrays([ids.slice(at, len(texts)), pa.array(best, pa.string()), pa.array(score, pa.float64()), pa.array(runs, run_type)], ["doc_id", "lang_pred", "score", "runs"])
                at += len(texts)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, runs per row of ``docs``; a null doc_id is in no fold (held_out false)."""
    labelled = label(docs, fit(docs))
    return labelled.select("doc_id", F.coalesce(fold(folds=FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), "lang_pred", "score", "runs")
