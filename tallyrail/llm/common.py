"""What the operators share: the shared folder, written tables, batch sizes, words."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of documents that a Python worker turns over at a time; a memory bound, not a cap on work.
ROWS_IN_HAND = 1000


def parts(batches: Iterator[pd.DataFrame], rows: int = ROWS_IN_HAND) -> Iterator[pd.DataFrame]:
    """The batches' rows, at most ``rows`` at a time. Spark bounds a batch's bytes (64 MB unless the session says otherwise)."""
    for pdf in batches:
        for at in range(0, len(pdf), rows):
            yield pdf.iloc[at : at + rows]


#: On one machine without ``spark.checkpoint.dir``: the temporary folder of each application.
_TEMPORARY: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``; only where that is unset, on one machine, below a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("a cluster needs spark.checkpoint.dir, a folder that all its machines share")
        own = spark.sparkContext.applicationId
        base = _TEMPORARY[own] = _TEMPORARY.get(own) or f"file://{tempfile.mkdtemp(prefix='tallyrail-')}"
    return f"{base.rstrip('/')}/tallyrail-{uuid.uuid4().hex}"


def written(df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` as Parquet to ``path`` and read it back: a lineage cut that outlives executors."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of one key that a joining task takes at least, and the most keys that are split over several tasks.
KEY_ROWS, HOT_KEYS = 256, 10_000


def join_spread(left: DataFrame, right: DataFrame, key: str, counts: DataFrame, by: str, how: str = "inner") -> DataFrame:
    """``left`` joined with ``right`` on ``key``, where a key may hold a large share of ``left``'s rows.

    ``counts`` has (key, n): a key's rows in ``left``; ``right`` has a row per key.
    Keys of many rows are split by the hash of ``by`` and their row of ``right`` is
    repeated for each part. These keys are handed to all tasks: as each has more
    than the HOT_KEYS-th part of all rows, there are HOT_KEYS of them at most.
    """
    total = counts.agg(F.sum("n")).first()[0] or 0
    most = max(KEY_ROWS, -(-total // HOT_KEYS))
    hot = F.broadcast(counts.where(F.col("n") > most).select(key, F.ceil(F.col("n") / most).cast("int").alias("_parts")))
    ways = F.coalesce("_parts", F.lit(1))
    left = left.join(hot, key, "left").withColumn("_part", F.pmod(F.xxhash64(by), ways).cast("int")).drop("_parts")
    right = right.join(hot, key, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), ways - 1))).drop("_parts")
    return left.join(right, [key, "_part"], how).drop("_part")


def unused(columns: list[str], name: str) -> str:
    """``name`` with as many underscores before it as it takes to be none of ``columns``."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def latest_number(spark: SparkSession, path: str, prefix: str) -> int:
    """The largest n with a wholly written table ``prefix``-n below ``path``; -1 if there is none."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{prefix}-*/_SUCCESS")
    found = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(hadoop)
    return max((int(f.getPath().getParent().getName().rsplit("-", 1)[1]) for f in found or ()), default=-1)


def words_of(text: str | None) -> list[bytes]:
    """Words of a text: A-Z lower-cased, split at the six ASCII white-space characters, UTF-8 bytes.

    ``bytes.lower`` and ``bytes.split`` touch ASCII only, which is the definition wanted.
    """
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


class TwoGenerations(dict):
    """A memo of bounded size: a full young generation becomes the old one, hits there move up."""

    __slots__ = ("compute", "cap", "old")

    def __init__(self, compute, cap: int):
        super().__init__()
        self.compute, self.cap, self.old = compute, cap, {}

    def __missing__(self, key):
        value = self.old.pop(key, None)
        if value is None:
            value = self.compute(key)
        if len(self) >= self.cap:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


def hashed(words: list[bytes]) -> np.ndarray:
    """The words' 64-bit hashes; hashing a word costs less than looking it up in a memo of millions."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of uint64 values (the finaliser of a splittable generator)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
