"""Ranked lexical search by TPUT (three-phase uniform threshold) over term-partitioned postings.

The benchmark's items are the queries, in blocks of a bounded number of characters.
Documents are read once a block and written with the terms they share with it; from
these come the corpus' counts and the postings: for every term its documents and
their parts of the score, in segments of descending parts.

1. The head of every list, its best ``k`` postings, gives partial sums; an item's
   k-th largest is a lower bound of its k-th score.
2. From that follows one threshold for all lists of an item: a document that is
   below it in all lists, and below each list's largest part, cannot reach the bound.
   Postings from the threshold on are fetched, gathered by chunks of documents and
   summed; with the most that unseen lists may add, the sums bound the scores from
   above, and the k-th largest sum is a better lower bound.
3. Documents whose upper bound reaches it are looked up and scored exactly.

Null texts and texts without terms are no documents; rows of one doc_id are documents
of their own, a null doc_id comes last among equal scores. Items of one id are one
item with the terms of all; items without an id or without terms have no results. An
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyrail.llm.common import shared_dir, written

TOP = 50
#: Characters of the items that are searched for in one pass; a larger benchmark is searched for in blocks.
BLOCK_CHARS = 4_000_000
#: Documents and postings of a chunk, postings of a segment: memory bounds.
CHUNK_ROWS, CHUNK_POSTINGS, SEGMENT = 10_000, 1 << 20, 4096
#: Parts that a term's list is dealt over.
WAYS = 8
#: Candidates that are few enough to be handed to all tasks.
FEW = 200_000

#: ASCII letters lower-cased, digits kept, other ASCII characters blank; bytes of longer characters stay.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(text: bytes | None) -> list[bytes]:
    """The terms of a UTF-8 text: runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased."""
    return (text or b"").translate(_FOLD).split()


@dataclass
class Queries:
    """Items of a block: their ids, the vocabulary, and each item's terms as numbers, in order."""

    ids: list[int]
    vocabulary: dict[bytes, int]
    terms: list[np.ndarray]

    @classmethod
    def of(cls, rows: list[tuple[int, bytes | None]]) -> Queries:
        """Items by id, with the terms of all rows of the id."""
        vocabulary, found = {}, {}
        for item, text in rows:
            found.setdefault(item, set()).update(vocabulary.setdefault(t, len(vocabulary)) for t in terms_of(text))
        ids = sorted(i for i, t in found.items() if t)
        return cls(ids, vocabulary, [np.array(sorted(found[i]), np.int64) for i in ids])


@dataclass
class Statistics:
    """Documents, their terms with repeats, and the weight of every vocabulary term."""

    documents: int
    length: int
    weight: np.ndarray

    def part(self, term: np.ndarray, tf: np.ndarray, n: np.ndarray) -> np.ndarray:
        """What postings add to a score; ``n`` is their document's number of terms."""
        m = 50 + 50 * n * self.documents // self.length
        return self.weight[term] * (1_000_000_000 * tf // (1000 * tf + 20 * m))


def lists(*columns: tuple[np.ndarray, np.ndarray, pa.DataType]) -> list[pa.Array]:
    """Arrow lists from pairs of ends and values."""
    return [pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(values, kind)) for ends, values, kind in columns]


def forward(docs: DataFrame, queries: Queries) -> DataFrame:
    """chunk, at, doc_id, n, terms, tfs of every document that has terms: its terms of the vocabulary and how often it has them."""
    shared = docs.sparkSession.sparkContext.broadcast(queries.vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, first = shared.value, TaskContext.get().partitionId() << 33
        size, chunk, at, held = max(1, len(vocabulary)), 0, 0, 0
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for lo in range(0, len(ids), 1000):
                keys, lengths, kept = [], [], []
                for i, text in enumerate(texts[lo : lo + 1000].to_pylist()):
                    words = terms_of(text)
                    if words:
                        number = np.array([x for x in map(vocabulary.get, words) if x is not None], np.int64)
                        keys.append(number + len(kept) * size)
                        kept.append(ids[lo + i])
                        lengths.append(len(words))
                if not kept:
                    continue
                key, tf = np.unique(np.concatenate(keys), return_counts=True)
                ends = np.cumsum(np.bincount(key // size, minlength=len(kept)))
                places, chunks = [], []
                for own in np.diff(ends, prepend=0).tolist():
                    if at == CHUNK_ROWS or held + own > CHUNK_POSTINGS and at:
                        chunk, at, held = chunk + 1, 0, 0
                    places.append(at)
                    chunks.append(first + chunk)
                    at, held = at + 1, held + own
                yield pa.RecordBatch.from_arrays(
                    [pa.array(chunks, pa.int64()), pa.array(places, pa.int32()), pa.array(kept, pa.int64()), pa.array(lengths, pa.int64()), *lists((ends, key % size, pa.int32()), (ends, tf, pa.int32()))],
                    ["chunk", "at", "doc_id", "n", "terms", "tfs"],
                )

    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    return named.mapInArrow(run, "chunk long, at int, doc_id long, n long, terms array<int>, tfs array<int>")


def statistics(index: DataFrame, queries: Queries) -> Statistics:
    """Counts over all documents of the written ``forward`` table; a row per vocabulary term comes to the driver."""
    size = len(queries.vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(size, np.int64)
        for batch in batches:
            seen += np.bincount(batch.column(0).flatten().to_numpy(), minlength=size)
        term = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(term, pa.int64()), pa.array(seen[term], pa.int64())], ["term", "df"])

    total = index.agg(F.count("*").alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("l")).first()
    df = np.zeros(size, np.int64)
    for row in index.select("terms").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
        df[row["term"]] = row["df"]
    n = total["n"]
    weight = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)
    return Statistics(n, total["l"], weight)


def postings(index: DataFrame, known: Statistics) -> DataFrame:
    """term, chunk, best, ats, parts: every term's list in segments of descending parts of the score; terms without weight have none."""
    shared = index.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            terms = batch.column(3)
            own = terms.value_lengths().to_numpy()
            chunk, at, n = (np.repeat(batch.column(i).to_numpy(), own) for i in range(3))
            term, tf = terms.flatten().to_numpy().astype(np.int64), batch.column(4).flatten().to_numpy().astype(np.int64)
            part = known.part(term, tf, n)
            order = np.lexsort((-part, chunk, term))
            order = order[part[order] > 0]
            if not len(order):
                continue
            term, chunk, at, part = term[order], chunk[order], at[order], part[order]
            new = np.concatenate(([True], (term[1:] != term[:-1]) | (chunk[1:] != chunk[:-1])))
            starts = np.flatnonzero(new)
            inside = np.arange(len(term)) - np.repeat(starts, np.diff(np.append(starts, len(term))))
            starts = np.flatnonzero(inside % SEGMENT == 0)
            ends = np.append(starts[1:], len(term))
            yield pa.RecordBatch.from_arrays([pa.array(term[starts], pa.int32()), pa.array(chunk[starts], pa.int64()), pa.array(part[starts], pa.int64()), *lists((ends, at, pa.int32()), (ends, part, pa.int64()))], ["term", "chunk", "best", "ats", "parts"])

    segments = index.select("chunk", "at", "n", "terms", "tfs").mapInArrow(run, "term int, chunk long, best long, ats array<int>, parts array<long>")
    # A list of many segments is dealt over several tasks.
    return segments.repartition(F.col("term"), F.pmod(F.xxhash64("chunk"), F.lit(WAYS))).sortWithinPartitions("term", F.desc("best"))


def heads(table: DataFrame, k: int) -> DataFrame:
    """term, chunk, at, part: the best ``k`` postings of every list, taken from its ``k`` segments of largest parts."""
    by_best = Window.partitionBy("term").orderBy(F.desc("best"))
    few = table.withColumn("r", F.row_number().over(by_best)).where(F.col("r") <= k)
    each = few.select("term", "chunk", F.explode(F.arrays_zip(F.slice("ats", 1, k).alias("at"), F.slice("parts", 1, k).alias("part"))).alias("p"))
    each = each.select("term", "chunk", F.col("p.at").alias("at"), F.col("p.part").alias("part"))
    return each.withColumn("r", F.row_number().over(Window.partitionBy("term").orderBy(F.desc("part")))).where(F.col("r") <= k).drop("r")


@dataclass
class Thresholds:
    """For every item: the bound of its k-th score, the threshold of its lists, and the most that a list adds below it."""

    bound: np.ndarray
    threshold: np.ndarray
    below: list[np.ndarray]
    least: np.ndarray

    @classmethod
    def of(cls, queries: Queries, largest: np.ndarray, bound: np.ndarray) -> Thresholds:
        """``largest`` part of each term's list; ``least`` is a term's smallest threshold over all items that have it."""
        threshold, below = np.ones(len(queries.ids), np.int64), []
        least = np.full(len(queries.vocabulary), np.iinfo(np.int64).max)
        for i, terms in enumerate(queries.terms):
            most = largest[terms]
            low, high = 1, int(most.max()) + 1  # the greatest threshold below which all lists together stay under the bound
            while low < high:
                mid = (low + high + 1) // 2
                low, high = (mid, high) if int(np.minimum(mid - 1, most).sum()) < bound[i] else (low, mid - 1)
            threshold[i] = low
            below.append(np.minimum(low - 1, most))
            least[terms] = np.minimum(least[terms], low)
        return cls(bound, threshold, below, least)


def fetched(table: DataFrame, limits: Thresholds) -> DataFrame:
    """chunk, term, ats, parts: of each segment the postings that reach the least threshold of its term."""
    shared = table.sparkSession.sparkContext.broadcast(limits.least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = shared.value
        for batch in batches:
            term, lists_ = batch.column(1).to_numpy(), batch.column(3)
            own = lists_.value_lengths().to_numpy()
            part, at = lists_.flatten().to_numpy(), batch.column(2).flatten().to_numpy()
            stays = part >= np.repeat(least[term], own)
            left = np.bincount(np.repeat(np.arange(len(term)), own)[stays], minlength=len(term))
            rows = np.flatnonzero(left)
            ends = np.cumsum(left[rows])
            if len(rows):
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(term[rows], pa.int32()), *lists((ends, at[stays], pa.int32()), (ends, part[stays], pa.int64()))], ["chunk", "term", "ats", "parts"])

    return table.select("chunk", "term", "ats", "parts").mapInArrow(run, "chunk long, term int, ats array<int>, parts array<long>")


def bounded(rows: DataFrame, queries: Queries, limits: Thresholds, k: int) -> DataFrame:
    """item, chunk, at, seen, most: partial sums and upper bounds of the documents of each chunk that may be among an item's best.

    A document stays if its upper bound reaches the item's lower bound and the
    k-th largest sum of its chunk; both are at most the k-th score.
    """
    shared = rows.sparkSession.sparkContext.broadcast((queries.terms, limits))
    schema = pa.schema([("item", pa.int32()), ("chunk", pa.int64()), ("at", pa.int32()), ("seen", pa.int64()), ("most", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        items, limits = shared.value
        table = table.combine_chunks()
        chunk, term = table["chunk"][0].as_py(), table["term"].to_numpy()
        order = np.argsort(term, kind="stable")
        by_term = {}
        ats, parts = table["ats"].combine_chunks(), table["parts"].combine_chunks()
        ends = np.cumsum(ats.value_lengths().to_numpy())
        at, part = ats.flatten().to_numpy(), parts.flatten().to_numpy()
        for i in order.tolist():
            by_term.setdefault(int(term[i]), []).append(slice(int(ends[i - 1]) if i else 0, int(ends[i])))
        of = {t: (np.concatenate([at[s] for s in cuts]), np.concatenate([part[s] for s in cuts])) for t, cuts in by_term.items()}
        size = int(at.max()) + 1
        out = []
        for i, terms in enumerate(items):
            found = [(*of[t], b) for t, b in zip(terms.tolist(), limits.below[i].tolist(), strict=True) if t in of]
            if not found:
                continue
            places, values = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
            unseen = np.repeat([f[2] for f in found], [len(f[0]) for f in found])
            reach = values >= limits.threshold[i]
            places, values, unseen = places[reach], values[reach], unseen[reach]
            # Sums of whole numbers far below 2^53: exact in doubles.
            seen = np.bincount(places, values, size).astype(np.int64)
            most = seen - np.bincount(places, unseen, size).astype(np.int64) + int(limits.below[i].sum())
            there = np.flatnonzero(seen)
            least = limits.bound[i]
            if len(there) > k:
                least = max(least, np.partition(seen[there], len(there) - k)[len(there) - k])
            there = there[most[there] >= least]
            out.append((np.full(len(there), i), there, seen[there], most[there]))
        columns = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.empty(0, np.int64)] * 4
        return pa.Table.from_arrays([pa.array(x, t.type) for x, t in zip([columns[0], np.full(len(columns[0]), chunk), *columns[1:]], schema, strict=True)], schema=schema)

    return rows.groupBy("chunk").applyInArrow(run, "item int, chunk long, at int, seen long, most long")


def looked_up(index: DataFrame, candidates: DataFrame, queries: Queries, known: Statistics) -> DataFrame:
    """item, chunk, at, doc_id, score: the exact scores of the candidates (item, chunk, at)."""
    shared = index.sparkSession.sparkContext.broadcast((queries.terms, known))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, known = shared.value
        for batch in batches:
            item, n, scores = batch.column(0).to_numpy(), batch.column(4).to_numpy(), []
            terms, tfs = batch.column(5), batch.column(6)
            for i in range(len(item)):
                term, tf = terms[i].values.to_numpy().astype(np.int64), tfs[i].values.to_numpy().astype(np.int64)
                mine = np.isin(term, items[item[i]], assume_unique=True)
                scores.append(int(known.part(term[mine], tf[mine], n[i]).sum()))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), pa.array(scores, pa.int64())], ["item", "chunk", "at", "doc_id", "score"])

    few = F.broadcast(candidates) if candidates.count() <= FEW else candidates
    return index.join(few, ["chunk", "at"]).select("item", "chunk", "at", "doc_id", "n", "terms", "tfs").mapInArrow(run, "item int, chunk long, at int, doc_id long, score long")


def kth(rows: DataFrame, value: str, k: int) -> DataFrame:
    """item, bound: the k-th largest ``value`` of each item that has ``k`` rows."""
    order = Window.partitionBy("item").orderBy(F.desc(value))
    return rows.select("item", value, F.row_number().over(order).alias("r")).where(F.col("r") <= k).groupBy("item").agg(F.min(value).alias("bound"), F.count("*").alias("n")).where(F.col("n") == k).select("item", "bound")


def _block(docs: DataFrame, queries: Queries, k: int, path: str) -> DataFrame | None:
    """item_id, rank, doc_id, score for the items of a block."""
    spark = docs.sparkSession
    index = written(forward(docs, queries), f"{path}/forward")
    known = statistics(index, queries)
    if not known.length:
        return None
    table = written(postings(index, known), f"{path}/postings")

    # Phase one. A block's items and their terms are as many as its characters at most.
    first = written(heads(table, k), f"{path}/heads")
    pairs = F.broadcast(spark.createDataFrame([(i, t) for i, terms in enumerate(queries.terms) for t in terms.tolist()], "item int, term int"))
    sums = first.join(pairs, "term").groupBy("item", "chunk", "at").agg(F.sum("part").alias("seen"))
    bound, largest = np.zeros(len(queries.ids), np.int64), np.zeros(len(queries.vocabulary), np.int64)
    for row in kth(sums, "seen", k).collect():
        bound[row["item"]] = row["bound"]
    for row in first.groupBy("term").agg(F.max("part").alias("largest")).collect():
        largest[row["term"]] = row["largest"]

    # Phase two.
    limits = Thresholds.of(queries, largest, bound)
    near = written(bounded(fetched(table, limits), queries, limits, k), f"{path}/near")
    better = F.broadcast(kth(near, "seen", k))  # a row per item of the block
    candidates = near.join(better, "item", "left").where(F.col("most") >= F.coalesce("bound", F.lit(0))).select("item", "chunk", "at")

    # Phase three.
    scored = looked_up(index, written(candidates, f"{path}/candidates"), queries, known).where(F.col("score") > 0)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "chunk", "at")
    best = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    names = F.broadcast(spark.createDataFrame(list(enumerate(queries.ids)), "item int, item_id long"))
    return written(best.join(names, "item").select("item_id", "rank", "doc_id", "score"), f"{path}/best")


def blocks(spark: SparkSession, benchmark: DataFrame, chars: int = BLOCK_CHARS) -> Iterator[Queries]:
    """The items with an id in blocks of about ``chars`` characters; the rows of an id are in one block."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id IS NOT NULL AND text IS NOT NULL")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    ways = -(-total // chars)
    for i in range(ways):
        queries = Queries.of([(r["item_id"], bytes(r["text"])) for r in items.where(F.pmod(F.xxhash64("item_id"), F.lit(ways)) == i).select("item_id", F.col("text").cast("binary").alias("text")).collect()])
        if queries.ids:
            yield queries


def search(docs: DataFrame, benchmark: DataFrame, k: int = TOP, chars: int = BLOCK_CHARS) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` documents of highest score for each item."""
    spark = docs.sparkSession
    path = shared_dir(spark)
    found = [b for i, queries in enumerate(blocks(spark, benchmark, chars)) if (b := _block(docs, queries, k, f"{path}/{i}")) is not None]
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for part in found:
        out = out.unionByName(part)
    return out


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS words
           FROM documents WHERE text IS NOT NULL),
n AS (SELECT row_number() OVER () AS r, doc_id, words, len(words)::BIGINT AS n FROM d WHERE len(words) > 0),
s AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS total FROM n),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                         '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
      FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
p AS (SELECT r, doc_id, n, term, count(*)::BIGINT AS tf FROM (SELECT r, doc_id, n, unnest(words) AS term FROM n) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * any_value(s.docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM p, s GROUP BY term),
f AS (SELECT item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * s.docs) // s.total))))::BIGINT AS score
      FROM q JOIN p USING (term) JOIN w USING (term), s GROUP BY item_id, r, doc_id),
k AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST, r)::INTEGER AS rank, doc_id, score FROM f WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 50
"""
