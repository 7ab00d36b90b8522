"""Bounded training samples of labelled documents, and word features as ragged arrays."""

from __future__ import annotations

from array import array

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fold(doc_id: str = "doc_id", folds: int = 5):
    """Column: CRC-32 of the id's decimal text modulo ``folds``."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds


def sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, rows_per_class: tuple[int, int]) -> pd.DataFrame:
    """At most ``rows_per_class`` (of class 0, of class 1) labelled documents outside the held-out fold: doc_id, text, y, weight.

    The rows of least hash of their id are taken; ``weight`` is the share of a
    class's rows that one row of the sample stands for. Ids with several labels
    take the largest, ids with several texts the smallest; null ids, labels and
    texts are no examples.
    """
    y = F.col(label).cast("int").alias("y")
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), y).where("doc_id IS NOT NULL AND y IS NOT NULL")
    known = known.where(fold(folds=folds) != held_out).groupBy("doc_id").agg(F.max("y").alias("y")).withColumn("h", F.xxhash64("doc_id", F.lit(17)))
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    chosen = [known.where(F.col("y") == c).orderBy("h").limit(rows_per_class[c]) for c in (0, 1)]
    ids = chosen[0].union(chosen[1]).select("doc_id", "y")
    got = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text IS NOT NULL").join(F.broadcast(ids), "doc_id")
    got = got.groupBy("doc_id", "y").agg(F.min("text").alias("text")).toPandas()
    got = got.sort_values(["doc_id", "text"]).reset_index(drop=True)
    got["weight"] = [counts.get(c, 0) for c in got["y"]]
    got["weight"] /= got.groupby("y")["y"].transform("size") if len(got) else 1
    return got


def bucket(text: str, bits: int) -> int:
    """The bucket of a feature's name among 2^bits."""
    return xxhash.xxh3_64_intdigest(text) >> (64 - bits)


class Ragged:
    """Distinct words with their feature buckets, in order of first use."""

    def __init__(self, features):
        self.features, self.at, self.flat, self.ends = features, {}, array("i"), array("q", [0])

    def word(self, word: str) -> int:
        i = self.at.get(word)
        if i is None:
            i = self.at[word] = len(self.at)
            self.flat.extend(self.features(word))
            self.ends.append(len(self.flat))
        return i

    def arrays(self) -> tuple[np.ndarray, np.ndarray]:
        """(buckets, word of each bucket)."""
        ends = np.array(self.ends)
        return np.array(self.flat, np.int32), np.repeat(np.arange(len(ends) - 1, dtype=np.int32), np.diff(ends))
