"""Nearest-neighbour retrieval of a stated query set against a base of vectors."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Numbers in the queries of a block: a block goes to every task, and a batch is compared with QUERIES of it at a time.
BLOCK_NUMBERS, QUERIES, ROWS = 8_000_000, 512, 2048
NEAREST = "query long, neighbour long, distance double"


def nearest(base: DataFrame, queries: DataFrame, metric: str = "l2", k: int = 1, digits: int | None = None, itself: bool = True) -> DataFrame:
    """(query, neighbour, distance, rank): the ``k`` nearest base vectors of each query, ties by id.

    Both tables have (id, vector). The queries are read in blocks of a bounded
    size; a block is handed to every task, which keeps its ``k`` best of its
    rows; those are ranked at the end, so a query has at most k rows per task.
    Without ``itself`` a row of the query's own id is no neighbour. A zero vector
    has cosine distance 1. ``digits`` rounds distances before ranking. Vectors of
    another length are an error, and null vectors are left out.
    """
    spark = base.sparkSession
    rows = queries.select(F.col("id").cast("long").alias("id"), "vector").where("vector IS NOT NULL")
    size = rows.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("wide")).first()
    blocks = -(-size["n"] * (size["wide"] or 1) // BLOCK_NUMBERS)
    if not blocks:
        return spark.createDataFrame([], NEAREST + ", rank int")
    base = base.select(F.col("id").cast("long").alias("id"), "vector").where("vector IS NOT NULL")
    found = []
    for block in range(blocks):
        part = rows.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == block).toPandas().sort_values("id")
        if len(part):
            held = spark.sparkContext.broadcast((part["id"].to_numpy(np.int64), np.stack(part["vector"].map(lambda v: np.asarray(v, np.float64)))))
            found.append(base.mapInPandas(_search(held, metric, k, digits, itself), NEAREST))
    rank = F.row_number().over(Window.partitionBy("query").orderBy("distance", "neighbour"))
    return reduce(DataFrame.unionByName, found).withColumn("rank", rank).where(F.col("rank") <= k)


def distances(metric: str, queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Distances of all rows from all queries, a line per query."""
    if metric == "l2":
        return np.stack([((rows - v) ** 2).sum(1) for v in queries])
    norms = np.linalg.norm(queries, axis=1)[:, None] * np.linalg.norm(rows, axis=1)
    return np.where(norms == 0, 1.0, 1 - (queries @ rows.T) / np.where(norms == 0, 1, norms))


def _search(held, metric: str, k: int, digits: int | None, itself: bool):
    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, vectors = held.value
        best_d, best_i = np.full((len(ids), k), np.inf), np.full((len(ids), k), np.iinfo(np.int64).max)
        for pdf in batches:
            for at in range(0, len(pdf), ROWS):
                part = pdf.iloc[at : at + ROWS]
                own, x = part["id"].to_numpy(np.int64), np.stack(part["vector"].map(lambda v: np.asarray(v, np.float64)))
                if x.shape[1] != vectors.shape[1]:
                    raise ValueError("vectors of different dimension")
                for lo in range(0, len(ids), QUERIES):
                    q = slice(lo, lo + QUERIES)
                    d = distances(metric, vectors[q], x)
                    d = d if digits is None else np.round(d, digits)
                    if not itself:
                        d[ids[q, None] == own] = np.inf
                    all_d = np.concatenate((best_d[q], d), 1)
                    all_i = np.concatenate((best_i[q], np.broadcast_to(own, d.shape)), 1)
                    order = np.lexsort((all_i, all_d), axis=1)[:, :k]
                    best_d[q], best_i[q] = np.take_along_axis(all_d, order, 1), np.take_along_axis(all_i, order, 1)
        keep = np.isfinite(best_d)
        yield pd.DataFrame({"query": np.broadcast_to(ids[:, None], keep.shape)[keep], "neighbour": best_i[keep], "distance": best_d[keep]})

    return search


def retrieved_documents(found: DataFrame, base: DataFrame, text: str) -> DataFrame:
    """The distinct documents that queries found, in order of the first query that did."""
    hits = found.where("rank = 1").groupBy("neighbour").agg(F.min("query").alias("query"))
    return hits.join(base.select(F.col("id").alias("neighbour"), text), "neighbour").select("query", "neighbour", text).orderBy("query")


#: Rows that centroids are learned from, rounds of learning, and vectors of an inverted list on average.
SAMPLE, ROUNDS, LIST = 20_000, 12, 256


def centroids(base: DataFrame, lists: int, seed: int = 7) -> np.ndarray:
    """``lists`` centroids by k-means over a bounded sample: the SAMPLE vectors of least hash of their id."""
    rows = base.where("vector IS NOT NULL").orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(SAMPLE).toPandas()
    x = np.stack(rows["vector"].map(lambda v: np.asarray(v, np.float64)))
    rng = np.random.default_rng(seed)
    found = x[rng.choice(len(x), min(lists, len(x)), replace=False)]
    for _ in range(ROUNDS):
        near = closest(x, found, 1)[:, 0]
        for i in range(len(found)):
            if (near == i).any():
                found[i] = x[near == i].mean(0)
    return found


def closest(rows: np.ndarray, found: np.ndarray, n: int) -> np.ndarray:
    """Numbers of the ``n`` nearest centroids of each row, nearest first."""
    d = (found**2).sum(1)[None] - 2 * rows @ found.T
    return np.argsort(d, axis=1, kind="stable")[:, :n]


def build_index(base: DataFrame, path: str, lists: int | None = None) -> np.ndarray:
    """Write all base vectors (id, vector) to ``path`` in inverted lists, a folder per list, and return the centroids.

    Every vector is in the list of its nearest centroid; only the centroids are
    learned from a sample. A list is written by several tasks if it is long.
    """
    base = base.select(F.col("id").cast("long").alias("id"), "vector").where("vector IS NOT NULL")
    n = base.count()
    if not n:
        raise ValueError("no vectors to index")
    found = centroids(base, lists or max(1, n // LIST))
    held = base.sparkSession.sparkContext.broadcast(found)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), ROWS):
                part = pdf.iloc[at : at + ROWS]
                yield part.assign(list=closest(np.stack(part["vector"].map(lambda v: np.asarray(v, np.float64))), held.value, 1)[:, 0].astype(np.int32))

    kind = dict(base.dtypes)["vector"]
    listed = base.mapInPandas(assign, f"id long, vector {kind}, list int")
    listed.repartition("list", F.pmod(F.xxhash64("id"), F.lit(4))).write.mode("overwrite").partitionBy("list").parquet(path)
    return found


def nearest_indexed(base: DataFrame, found: np.ndarray, queries: DataFrame, k: int = 1, probes: int = 8, itself: bool = True) -> DataFrame:
    """(query, neighbour, distance, rank) by squared distance among the ``probes`` nearest lists of each query.

    ``base`` is the written index. The queries are read in blocks of a bounded size;
    of the index only the lists that a block asks for are read. What lies in other
    lists is missed: ``nearest`` is the exact way, and ``recall`` compares the two.
    """
    spark = base.sparkSession
    rows = queries.select(F.col("id").cast("long").alias("id"), "vector").where("vector IS NOT NULL")
    size = rows.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("wide")).first()
    blocks, parts = -(-size["n"] * (size["wide"] or 1) // BLOCK_NUMBERS), []
    for block in range(blocks):
        part = rows.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == block).toPandas().sort_values("id")
        if not len(part):
            continue
        x = np.stack(part["vector"].map(lambda v: np.asarray(v, np.float64)))
        lists = closest(x, found, probes)
        asked = {int(i): np.flatnonzero((lists == i).any(1)) for i in np.unique(lists)}
        held = spark.sparkContext.broadcast((part["id"].to_numpy(np.int64), x, asked))
        parts.append(base.where(F.col("list").isin(list(asked))).select("list", F.col("id").cast("long").alias("id"), "vector").mapInPandas(_probe(held, k, itself), NEAREST))
    if not parts:
        return spark.createDataFrame([], NEAREST + ", rank int")
    rank = F.row_number().over(Window.partitionBy("query").orderBy("distance", "neighbour"))
    return reduce(DataFrame.unionByName, parts).withColumn("rank", rank).where(F.col("rank") <= k)


def _probe(held, k: int, itself: bool):
    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, vectors, asked = held.value
        best_d, best_i = np.full((len(ids), k), np.inf), np.full((len(ids), k), np.iinfo(np.int64).max)
        for pdf in batches:
            for name, part in pdf.groupby("list"):
                own, x, who = part["id"].to_numpy(np.int64), np.stack(part["vector"].map(lambda v: np.asarray(v, np.float64))), asked[int(name)]
                for lo in range(0, len(who), QUERIES):
                    q = who[lo : lo + QUERIES]
                    d = distances("l2", vectors[q], x)
                    if not itself:
                        d[ids[q, None] == own] = np.inf
                    all_d, all_i = np.concatenate((best_d[q], d), 1), np.concatenate((best_i[q], np.broadcast_to(own, d.shape)), 1)
                    order = np.lexsort((all_i, all_d), axis=1)[:, :k]
                    best_d[q], best_i[q] = np.take_along_axis(all_d, order, 1), np.take_along_axis(all_i, order, 1)
        keep = np.isfinite(best_d)
        yield pd.DataFrame({"query": np.broadcast_to(ids[:, None], keep.shape)[keep], "neighbour": best_i[keep], "distance": best_d[keep]})

    return probe


def recall(found: DataFrame, exact: DataFrame) -> float:
    """The part of the exact (query, neighbour) pairs that was found; 1 if there are none."""
    hit = found.select("query", "neighbour").distinct().withColumn("_h", F.lit(1))
    row = exact.select("query", "neighbour").distinct().join(hit, ["query", "neighbour"], "left").agg(F.count("*").alias("n"), F.count("_h").alias("h")).first()
    return row["h"] / row["n"] if row["n"] else 1.0
