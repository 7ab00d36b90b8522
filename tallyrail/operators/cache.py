"""Content-addressed caches as tables: lookups with hit flags, write-once saves with conflict detection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyrail.operators.selection import fail_if_any

#: Columns whose change is no conflict.
VOLATILE = ("elapsed_seconds", "log", "elapsed_us")


def lookup(wanted: DataFrame, cache: DataFrame, key: str, name: str) -> DataFrame:
    """``wanted`` with the cached columns, null where there is none, and ``<name>_hit``."""
    return wanted.join(cache.withColumn(f"{name}_hit", F.lit(True)), key, "left").withColumn(f"{name}_hit", F.coalesce(f"{name}_hit", F.lit(False)))


def classify(new: DataFrame, cache: DataFrame, key: str, volatile=VOLATILE) -> DataFrame:
    """``new`` with ``state``: new, same, or conflict where a semantic column differs from the cached row."""
    cols = [c for c in new.columns if c != key and c not in volatile]
    old = cache.select(key, F.struct(*cols).alias("_old"))
    state = F.when(F.col("_old").isNull(), "new").when(F.col("_old").eqNullSafe(F.struct(*cols)), "same").otherwise("conflict")
    return new.join(old, key, "left").withColumn("state", state).drop("_old")


def save(new: DataFrame, path: str, key: str, volatile=VOLATILE) -> int:
    """Append the rows that the cache at ``path`` lacks; fails on a conflict, also within ``new``. Returns how many were new."""
    spark = new.sparkSession
    cols = [c for c in new.columns if c != key and c not in volatile]
    fail_if_any(new.groupBy(key).agg(F.count_distinct(F.to_json(F.struct(*cols))).alias("n")).where("n > 1"), "conflicting rows of one key")
    new = new.dropDuplicates([key])
    if exists(spark, path):
        rows = classify(new, spark.read.schema(new.schema).parquet(path), key, volatile).persist()
        fail_if_any(rows.where("state = 'conflict'").select(key), "cached rows differ")
        fresh = rows.where("state = 'new'").drop("state")
    else:
        rows = fresh = new.persist()
    n = fresh.count()
    if n:
        fresh.write.mode("append").parquet(path)
    rows.unpersist()
    return n


def exists(spark, path: str) -> bool:
    """Whether a path exists in the store that Spark's readers would use for it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)
