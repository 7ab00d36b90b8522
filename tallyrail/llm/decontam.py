"""Benchmark decontamination by latent semantic retrieval and a subsequence check.

Texts are read as words; those of the benchmark are its vocabulary, bounded by
the benchmark and not by the corpus. All documents are read once and written as
vocabulary numbers. Passages are windows of 16 words in steps of eight, of
documents and of items (items in steps of four). Three passes over the numbers:

1. in how many passages each vocabulary word occurs, over all passages;
2. a randomised singular value decomposition of the passages' TF-IDF matrix A: the
   tasks add up ``Y = A' A G`` for a random ``G``, and the driver gets singular
   values and right singular vectors from ``Y`` and the small matrix ``G' Y``;
3. passages are projected to the latent space and compared with all item passages
   by cosine, in blocks; near ones are checked in their document by the longest
   common subsequence of the item and the words where it would lie, and by its
   answer.

A passage's vector has a length for its words outside the vocabulary too; passages
with too little of their length inside have no place in the latent space. What the
latent search finds depends on where the passages fall; README has its recall. So
the last pass also looks at every place that can hold a leak by its definition: a
leak of the larger part has one of the item's rarest words, a lesser one the
answer, and both have enough of the item's words within the length it may take.
Only documents and items that the latent search has not settled are looked at so.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyrail.llm.common import parts, shared_dir, written

WINDOW, STEP, ITEM_STEP = 16, 8, 4
#: Latent dimensions, random directions beyond them, least cosine of two passages there.
RANK, MORE, COSINE = 96, 16, 0.6
#: Least part of a passage's length that lies in the vocabulary.
INSIDE = 0.55
#: Words of the items that are searched for at once; a larger benchmark is searched for in blocks.
ITEM_WORDS = 200_000
#: Characters of a benchmark that the driver takes in.
BENCHMARK_CHARS = 200_000_000
#: Part of an item's words, in order, that makes a leak; a lesser one does with the item's answer, its last words.
LEAK, LEAK_WITH_ANSWER, ANSWER = 0.7, 0.5, 4
_PLAIN = bytes(32 if chr(b) in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" else b for b in range(256))


def words(text: str | None) -> list[bytes]:
    """Lower-case words of a text, ASCII punctuation being space."""
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(_PLAIN).split()


def lcs(masks: dict[int, int], length: int, other: list[int]) -> int:
    """Length of the longest common subsequence; ``masks`` has the bits of each word's places in the first text."""
    full = (1 << length) - 1
    v = full
    for word in other:
        u = v & masks.get(word, 0)
        v = ((v + u) | (v - u)) & full
    return length - v.bit_count()


def place_masks(ids: list[int]) -> dict[int, int]:
    """Bit masks of the places of each id."""
    out: dict[int, int] = {}
    for i, x in enumerate(ids):
        out[x] = out.get(x, 0) | 1 << i
    return out


@dataclass
class Items:
    """The benchmark: vocabulary, item ids, their words as vocabulary numbers, and their passages."""

    vocabulary: dict[bytes, int]
    item_ids: list[int]
    ids: list[list[int]]
    owner: np.ndarray
    offset: np.ndarray

    @classmethod
    def of(cls, rows: list[tuple[int, str | None]]) -> Items:
        """Items with an id and at least one word, in order of id."""
        vocabulary: dict[bytes, int] = {}
        kept = [(i, w) for i, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]) if (w := words(t))]
        ids = [[vocabulary.setdefault(x, len(vocabulary)) for x in w] for _, w in kept]
        owner, offset = [], []
        for n, own in enumerate(ids):
            last = max(0, len(own) - WINDOW)
            for at in sorted({*range(0, last + 1, ITEM_STEP), last}):
                owner.append(n)
                offset.append(at)
        return cls(vocabulary, [i for i, _ in kept], ids, np.array(owner, np.int64), np.array(offset, np.int64))

    def numbers(self, text: str | None) -> np.ndarray:
        """A text's words as vocabulary numbers, -1 for others."""
        w = words(text)
        get = self.vocabulary.get
        return np.fromiter((get(x, -1) for x in w), np.int32, len(w))

    def passages(self) -> np.ndarray:
        """The items' passages, a row each, -1 after the end of a short one."""
        out = np.full((len(self.owner), WINDOW), -1, np.int32)
        for i, (o, a) in enumerate(zip(self.owner, self.offset, strict=True)):
            part = self.ids[o][a : a + WINDOW]
            out[i, : len(part)] = part
        return out

    @property
    def kind(self) -> str:
        """How vocabulary numbers are stored."""
        return "<i2" if len(self.vocabulary) < 1 << 15 else "<i4"


def windows(ids: np.ndarray) -> np.ndarray:
    """Starts of a text's passages; a shorter text is one passage."""
    n = len(ids)
    return np.minimum(np.arange(0, max(1, n - WINDOW + STEP), STEP), max(0, n - WINDOW)) if n else np.empty(0, np.int64)


def grid(ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The passages' vocabulary numbers, a row each, -1 where there is none."""
    at = starts[:, None] + np.arange(WINDOW)
    return np.where(at < len(ids), ids[np.minimum(at, len(ids) - 1)], -1)


def project(rows: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Sum of the table's rows over each passage's words; the table's last row is zero, for -1."""
    out = np.zeros((len(rows), table.shape[1]), np.float32)
    for j in range(rows.shape[1]):
        out += table[rows[:, j]]
    return out


ENCODED = "doc_id long, n_words int, ids binary"


def encoded(docs: DataFrame, items: Items) -> DataFrame:
    """doc_id, n_words and the words as vocabulary numbers (null where none is of the vocabulary) of each row of ``docs``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts(batches):
            ids = [items.numbers(t) for t in pdf["text"]]
            held = [x.astype(items.kind).tobytes() if len(x) and x.max() >= 0 else None for x in ids]
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "n_words": [len(x) for x in ids], "ids": held})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, ENCODED)


def frequencies(rows: DataFrame, items: Items) -> tuple[np.ndarray, int]:
    """Passages of all documents that hold each vocabulary word, and the number of passages."""
    size, kind = len(items.vocabulary), items.kind

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = np.zeros(size, np.int64)
        for pdf in parts(batches):
            for raw in pdf["ids"]:
                ids = np.frombuffer(raw, kind)
                # A word is counted once a passage: in sorted rows, where it first stands.
                held = np.sort(grid(ids, windows(ids)), axis=1)
                new = held >= 0
                new[:, 1:] &= held[:, 1:] != held[:, :-1]
                found += np.bincount(held[new], minlength=size)
        hit = np.flatnonzero(found)
        yield pd.DataFrame({"word": hit, "n": found[hit]})

    n = F.col("n_words")
    of_text = F.when(n > WINDOW, F.ceil((n - WINDOW + STEP) / STEP)).otherwise(F.when(n > 0, 1).otherwise(0))
    total = rows.agg(F.sum(of_text)).first()[0] or 0
    out = np.zeros(size, np.int64)
    for r in rows.where("ids IS NOT NULL").select("ids").mapInPandas(count, "word int, n long").groupBy("word").agg(F.sum("n").alias("n")).collect():
        out[r["word"]] = r["n"]
    return out, total


@dataclass
class Weights:
    """TF-IDF weights of the vocabulary's words, their squares with a zero for -1, and the square of a word outside."""

    idf: np.ndarray
    squares: np.ndarray
    outside: float

    @classmethod
    def of(cls, found: np.ndarray, total: int) -> Weights:
        """A word outside the vocabulary weighs as one inside does on average."""
        idf = np.log((1 + total) / (1 + found)) + 0.1
        return cls(idf, np.append(idf**2, 0), float(idf.mean()) ** 2)

    def lengths(self, rows: np.ndarray, words: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
        """Squared lengths of passages of so many words: inside the vocabulary, and in all."""
        inside = self.squares[rows].sum(1)
        return inside, inside + (words - (rows >= 0).sum(1)) * self.outside

    def passages(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, rows and squared lengths of a text's passages that lie in the vocabulary far enough."""
        starts = windows(ids)
        rows = grid(ids, starts)
        inside, length = self.lengths(rows, min(len(ids), WINDOW))
        keep = np.flatnonzero(inside >= INSIDE**2 * length)
        return starts[keep], rows[keep], length[keep]


def add_up(rows: np.ndarray, length: np.ndarray, idf: np.ndarray, table: np.ndarray, out: np.ndarray) -> None:
    """Add ``A' (A G)`` of passages to ``out``, the rows of A being their TF-IDF vectors at unit length."""
    part = project(rows, table)
    part /= length[:, None]
    keep = rows.ravel() >= 0
    word, doc = rows.ravel()[keep], np.repeat(np.arange(len(rows)), rows.shape[1])[keep]
    order = np.argsort(word, kind="stable")
    word, doc = word[order], doc[order]
    if len(word):
        first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
        out[word[first]] += np.add.reduceat(part[doc], first, axis=0) * idf[word[first]][:, None]


def needed(length: int, part: float) -> int:
    """The least number of words that is ``part`` of ``length``."""
    n = math.ceil(part * length)
    return n - 1 if (n - 1) / length >= part else n


def room(length: int) -> int:
    """Words of a document that a leak of an item of ``length`` words may take."""
    return length + 2 * max(4, length // 4)


class Places:
    """Every place of a document that can hold a leak, by bounds that no leak fails.

    Of an item's words ``needed(LEAK)`` are matched, hence one of the rarest of
    all but that many less one; a lesser leak has the answer. A hit stays if some
    stretch of ``room`` words around it has enough words of the item, in any order.
    """

    def __init__(self, items: Items, found: np.ndarray) -> None:
        size = len(items.vocabulary) + 1
        rare: list[list[int]] = [[] for _ in range(size)]
        self.ids, self.answers = items.ids, {}
        self.first, self.last = {}, {}
        for n, own in enumerate(items.ids):
            for w in set(sorted(own, key=lambda w: (found[w], w))[: len(own) - needed(len(own), LEAK) + 1]):
                rare[w].append(n)
            answer = tuple(own[-ANSWER:])
            self.answers.setdefault(answer, []).append(n)
            for flags, w in ((self.first, answer[0]), (self.last, answer[-1])):
                flags.setdefault(len(answer), np.zeros(size, bool))[w] = True
        self.counts = np.array([len(r) for r in rare])
        self.begin = np.cumsum(self.counts) - self.counts
        self.owner = np.array([n for r in rare for n in r], np.int64)
        self.pad = max(room(len(i)) for i in items.ids)

    def hits(self, flat: np.ndarray) -> Iterator[tuple[int, np.ndarray, int]]:
        """(item, places of its rare words or answer, words needed)."""
        n = self.counts[flat]
        at, total = np.repeat(np.arange(len(flat)), n), int(n.sum())
        owner = self.owner[np.repeat(self.begin[flat] - (np.cumsum(n) - n), n) + np.arange(total)]
        order = np.argsort(owner, kind="stable")
        at, owner = at[order], owner[order]
        cut = np.flatnonzero(owner[1:] != owner[:-1]) + 1
        for part in np.split(np.arange(total), cut) if total else []:
            item = int(owner[part[0]])
            yield item, at[part], needed(len(self.ids[item]), LEAK)
        answered: dict[int, list[int]] = {}
        for length, first in self.first.items():
            end = max(0, len(flat) - length + 1)
            for p in np.flatnonzero(first[flat[:end]] & self.last[length][flat[length - 1 :]]).tolist():
                for item in self.answers.get(tuple(flat[p : p + length].tolist()), ()):
                    answered.setdefault(item, []).append(p)
        for item, places in answered.items():
            yield item, np.array(places), needed(len(self.ids[item]), LEAK_WITH_ANSWER)

    def padded(self, flat: np.ndarray) -> np.ndarray:
        """Numbers of documents, one after the other, with room before and after."""
        return np.concatenate((np.full(self.pad, -1), flat, np.full(self.pad, -1)))

    def most(self, padded: np.ndarray, item: int, start: np.ndarray) -> np.ndarray:
        """Words of the item, in any order, where it would lie with a beginning at ``start``: no less than its subsequence there."""
        holds = np.zeros(len(self.counts), np.int8)
        holds[self.ids[item]] = 1
        length = len(self.ids[item])
        slack = (room(length) - length) // 2
        at = self.pad + start - slack
        return np.concatenate([holds[padded[at[lo : lo + 4096, None] + np.arange(room(length))]].sum(1, dtype=np.int64) for lo in range(0, len(at), 4096)])

    def of(self, padded: np.ndarray) -> Iterator[tuple[int, np.ndarray, int]]:
        """The hits that stay."""
        flat = padded[self.pad : len(padded) - self.pad]
        holds = np.zeros(len(self.counts), np.int8)
        for item, at, least in self.hits(flat):
            wide = room(len(self.ids[item]))
            holds[self.ids[item]] = 1
            for lo in range(0, len(at), 4096):
                part = at[lo : lo + 4096]
                held = holds[padded[part[:, None] + np.arange(self.pad - wide + 1, self.pad + wide)]]
                total = np.zeros((len(part), 2 * wide), np.int32)
                np.cumsum(held, axis=1, out=total[:, 1:])
                stay = part[(total[:, wide:] - total[:, :wide]).max(1) >= least]
                if len(stay):
                    yield item, stay, least
            holds[self.ids[item]] = 0


def decompose(y: np.ndarray, g: np.ndarray, rank: int) -> tuple[np.ndarray, np.ndarray]:
    """Right singular vectors (words x rank) and singular values of A from ``y = A' A g``.

    ``A' A`` is approximated by ``y (g' y)^-1 y'``, whose eigenvectors are the left
    singular vectors of ``y P L^(-1/2)`` with the eigenvectors P and eigenvalues L
    of ``g' y``; those that are as good as zero are left out.
    """
    core = g.T @ y
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    good = values > 1e-9 * max(float(values[-1]), 1e-300)
    left, found, _ = np.linalg.svd(y @ (vectors[:, good] / np.sqrt(values[good])), full_matrices=False)
    return left[:, :rank], found[:rank]


def latent(rows: DataFrame, items: Items, weights: Weights, rank: int = RANK, more: int = MORE, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Right singular vectors (words x rank) and singular values of the passages' TF-IDF matrix.

    The matrix has a row for each passage, of documents and of items, that lies in
    the vocabulary far enough; the words of a task's passages are added up there,
    and the tasks' sums by word in an aggregation.
    """
    idf, kind = weights.idf, items.kind
    size = len(idf)
    rank = min(rank, size)
    wide = min(rank + more, size)
    g = np.random.default_rng(seed).standard_normal((size, wide))
    table = np.vstack((g * idf[:, None], np.zeros((1, wide)))).astype(np.float32)
    shared = rows.sparkSession.sparkContext.broadcast(table)

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table, out = shared.value, np.zeros((size, wide))
        held: list[tuple[np.ndarray, np.ndarray]] = []
        n = 0

        def done() -> None:
            if held:
                add_up(np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held]), idf, table, out)

        for pdf in parts(batches):
            for raw in pdf["ids"]:
                _, found, length = weights.passages(np.frombuffer(raw, kind))
                if len(found):
                    held.append((found, length))
                    n += len(found)
                if n > 4096:
                    done()
                    held, n = [], 0
        done()
        hit = np.flatnonzero(out.any(1))
        yield pd.DataFrame({"word": hit, **{f"y{i}": out[hit, i] for i in range(wide)}})

    schema = "word int, " + ", ".join(f"y{i} double" for i in range(wide))
    summed = rows.where("ids IS NOT NULL").select("ids").mapInPandas(sums, schema).groupBy("word").agg(*(F.sum(f"y{i}").alias(f"y{i}") for i in range(wide)))
    y = np.zeros((size, wide))
    got = summed.toPandas()
    y[got["word"].to_numpy(int)] = got[[f"y{i}" for i in range(wide)]].to_numpy(float)
    own = items.passages()
    # The items' own part counts like the corpus's, however large that is.
    part = np.zeros((size, wide))
    add_up(own, weights.lengths(own, (own >= 0).sum(1))[1], idf, table, part)
    scale = np.linalg.norm(y) / max(1e-9, np.linalg.norm(part))
    return decompose(y + part * max(1.0, scale), g, rank)


def leaks(docs: DataFrame, benchmark: DataFrame, path: str | None = None, places: bool = True) -> DataFrame:
    """(doc_id, item_id, overlap, answer, start, end, origin) of each item found in each document.

    A leak is LEAK of the item's words in order within ``room`` words of the
    document, or LEAK_WITH_ANSWER with the answer among them; none is missed.
    Without ``places`` the latent search stands alone, for measuring it.

    ``overlap`` is the part of the item's words found in order, ``answer``
    whether its last words are there too, ``start`` and ``end`` the words looked
    at, ``origin`` the search that found it: ``latent``, or ``places`` where the
    latent search gave no leak. A pair counts once, with the best place of its origin. Null and empty texts and items
    hold nothing; repeated rows of documents give repeated rows, and rows without
    doc_id are reported with none. An empty benchmark or table gives no rows.
    The benchmark is the query set; the driver reads it and searches for it in
    blocks of ITEM_WORDS words.
    """
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id IS NOT NULL AND text IS NOT NULL")
    size = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    if size > BENCHMARK_CHARS:
        raise ValueError(f"a benchmark of {size} characters is more than the {BENCHMARK_CHARS} that one search takes; search for it in parts")
    blocks: list[list[tuple[int, str]]] = [[]]
    size = 0
    for r in sorted(rows.collect()):
        n = len(words(r["text"]))
        if blocks[-1] and size + n > ITEM_WORDS:
            blocks.append([])
            size = 0
        if n:
            blocks[-1].append((r["item_id"], r["text"]))
            size += n
    if not blocks[0]:
        return docs.sparkSession.createDataFrame([], LEAKS)
    path = path or shared_dir(docs.sparkSession)
    return reduce(DataFrame.unionByName, [_leaks(docs, Items.of(block), f"{path}/{i}", places) for i, block in enumerate(blocks)])


LEAKS = "doc_id long, item_id long, overlap double, answer boolean, start int, end int, origin string"


def _leaks(docs: DataFrame, items: Items, path: str, with_places: bool) -> DataFrame:
    rows = written(encoded(docs, items), f"{path}/words")
    found, total = frequencies(rows, items)
    weights = Weights.of(found, total)
    vectors, _ = latent(rows, items, weights)
    table = np.vstack((vectors * weights.idf[:, None], np.zeros((1, vectors.shape[1])))).astype(np.float32)
    unit = lambda x: x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    targets = unit(project(items.passages(), table)).T.copy()
    masks = [place_masks(i) for i in items.ids]
    answers = [i[-ANSWER:] for i in items.ids]
    model = docs.sparkSession.sparkContext.broadcast((items, weights, table, targets, masks, answers, Places(items, found)))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        items, weights, table, targets, masks, answers, places = model.value

        def judge(ids: list[int], n: int, a: int, b: int) -> tuple[float, bool, int, int] | None:
            length, part = len(items.ids[n]), ids[a:b]
            overlap = lcs(masks[n], length, part) / length
            if overlap < LEAK_WITH_ANSWER:
                return None
            want = answers[n]
            has = any(part[i : i + len(want)] == want for i in range(len(part) - len(want) + 1))
            return (overlap, has, a, b) if overlap >= LEAK or has else None

        def retrieved(held: list[tuple], begin: np.ndarray, padded: np.ndarray, seen: dict[tuple, tuple]) -> None:
            """Add the leaks where a passage is near one of an item's in the latent space."""
            near = [weights.passages(ids) for _, ids in held]
            sizes = [len(x[0]) for x in near]
            if not sum(sizes):
                return
            passages, start = np.concatenate([x[1] for x in near]), np.concatenate([x[0] for x in near])
            of = np.repeat(np.arange(len(held)), sizes)
            pairs = []
            for lo in range(0, len(passages), 1024):
                near_enough = unit(project(passages[lo : lo + 1024], table)) @ targets >= COSINE
                i, j = np.divmod(np.flatnonzero(near_enough), near_enough.shape[1])
                # One check for each item, document and place to within two words.
                pairs.append(np.stack((items.owner[j], of[lo + i], (start[lo + i] - items.offset[j]) // 3 * 3 + 1), 1))
            pairs = np.unique(np.concatenate(pairs), axis=0)
            for part in np.split(pairs, np.flatnonzero(np.diff(pairs[:, 0])) + 1) if len(pairs) else ():
                n = int(part[0, 0])
                length = len(items.ids[n])
                slack = (room(length) - length) // 2
                part = part[places.most(padded, n, begin[part[:, 1]] + part[:, 2]) >= needed(length, LEAK_WITH_ANSWER)]
                for d, p in part[:, 1:].tolist():
                    if seen.get((d, n), (0,))[0] == 1.0:
                        continue
                    ids = lists(held, d)
                    got = judge(ids, n, max(0, p - slack), min(len(ids), p + length + slack))
                    if got and got > seen.get((d, n), (0.0,)):
                        seen[d, n] = got

        listed: dict[int, list[int]] = {}

        def lists(held: list[tuple], d: int) -> list[int]:
            if d not in listed:
                listed[d] = held[d][1].tolist()
            return listed[d]

        def everywhere(held: list[tuple], begin: np.ndarray, padded: np.ndarray, seen: dict[tuple, tuple]) -> None:
            """Add the leaks of all places that can hold one, for documents and items that the latent search has not settled."""
            spans: dict[tuple, list[tuple[int, int, int]]] = {}
            for n, at, least in places.of(padded):
                doc, wide = np.searchsorted(begin, at, "right") - 1, room(len(items.ids[n]))
                for d, p in zip(doc.tolist(), (at - begin[doc]).tolist(), strict=True):
                    if (d, n) not in seen:
                        spans.setdefault((d, n), []).append((max(0, p - wide + 1), p, least))
            for (d, n), span in spans.items():
                merged: list[list[int]] = []
                for a, b, least in sorted(span):
                    if merged and a <= merged[-1][1] + 1:
                        merged[-1][1:] = max(merged[-1][1], b), min(merged[-1][2], least)
                    else:
                        merged.append([a, b, least])
                ids, length, has = lists(held, d), len(items.ids[n]), masks[n]
                wide, best = room(length), None
                # Ranges of starts, those that may hold most first: what a range's words hold in all bounds every start in it.
                queue = [(-lcs(has, length, ids[a : b + wide]), a, b, least) for a, b, least in merged]
                heapq.heapify(queue)
                while queue:
                    most, a, b, least = heapq.heappop(queue)
                    if -most < least or best and -most / length <= best[0]:
                        continue
                    if a == b:
                        best = max(filter(None, (best, judge(ids, n, a, min(len(ids), a + wide)))), default=None)
                        continue
                    for lo, hi in ((a, (a + b) // 2), ((a + b) // 2 + 1, b)):
                        heapq.heappush(queue, (-lcs(has, length, ids[lo : hi + wide]), lo, hi, least))
                if best:
                    seen[d, n] = best

        def flush(held: list[tuple]) -> pd.DataFrame:
            begin = np.cumsum([0] + [len(ids) for _, ids in held])
            padded = places.padded(np.concatenate([ids for _, ids in held]))
            seen: dict[tuple, tuple] = {}
            listed.clear()
            retrieved(held, begin, padded, seen)
            latent = len(seen)
            if with_places:
                everywhere(held, begin, padded, seen)
            out = [(held[d][0], items.item_ids[n], *v, "latent" if i < latent else "places") for i, ((d, n), v) in enumerate(seen.items())]
            pdf = pd.DataFrame(out, columns=[c.split()[0] for c in LEAKS.split(", ")])
            pdf["doc_id"] = pdf["doc_id"].astype("Int64")
            return pdf

        held: list[tuple] = []
        size = 0
        for pdf in parts(batches):
            for doc_id, raw in zip(pdf["doc_id"].astype("Int64"), pdf["ids"], strict=True):
                held.append((None if doc_id is pd.NA else int(doc_id), np.frombuffer(raw, items.kind).astype(np.int32)))
                size += len(held[-1][1])
                if size >= 1 << 17:
                    yield flush(held)
                    held, size = [], 0
        if held:
            yield flush(held)

    return rows.where("ids IS NOT NULL").select("doc_id", "ids").mapInPandas(search, LEAKS)
