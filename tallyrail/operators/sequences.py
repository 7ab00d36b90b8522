"""Operators over ordered rows: transitions, islands, chunks, overlap merges, first mentions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def transitions(df: DataFrame, key: list[str], order: list[str], state: str) -> DataFrame:
    """Counts of (source, target) over consecutive rows of each key."""
    w = Window.partitionBy(*key).orderBy(*order)
    steps = df.select(F.col(state).alias("source"), F.lead(state).over(w).alias("target"))
    return steps.where("target IS NOT NULL").groupBy("source", "target").agg(F.count("*").alias("n"))


def path_transitions(df: DataFrame, path: str) -> DataFrame:
    """Counts of (source, target) over consecutive elements of an array column."""
    pairs = F.transform(F.sequence(F.lit(1), F.size(path) - 1), lambda i: F.struct(F.element_at(path, i.cast("int")).alias("source"), F.element_at(path, (i + 1).cast("int")).alias("target")))
    return df.where(F.size(path) > 1).select(F.inline(pairs)).groupBy("source", "target").agg(F.count("*").alias("n"))


def islands(df: DataFrame, key: list[str], order: list[str], value: str) -> DataFrame:
    """Maximal runs of one value: key, run number from 0, value, length, first and last of the first order column."""
    w = Window.partitionBy(*key).orderBy(*order)
    before = F.lag(value).over(w)
    starts = F.when((F.row_number().over(w) > 1) & before.eqNullSafe(F.col(value)), 0).otherwise(1)
    runs = df.withColumn("_start", starts).withColumn("run", F.sum("_start").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    return runs.groupBy(*key, "run").agg(F.first(value).alias(value), F.count("*").alias("n"), F.min(order[0]).alias("first"), F.max(order[0]).alias("last"))


def stagnant(df: DataFrame, key: list[str], order: list[str], value: str, k: int) -> DataFrame:
    """Keys with ``k`` or more identical outputs in a row."""
    return islands(df, key, order, value).where(F.col("n") >= k).select(*key).distinct()


def chunk_bounds(n: Column, size: int, overlap: int) -> Column:
    """array<struct<start, end>>: overlapping chunks of ``n`` lines; the first that reaches the end is the last."""
    step = size - overlap
    if step <= 0:
        raise ValueError("the overlap must be smaller than the chunk")
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), n - F.lit(overlap) - 1).cast("int"), F.lit(step))
    return F.when(n > 0, F.transform(starts, lambda s: F.struct(s.alias("start"), F.least(s + size, n.cast("int")).alias("end")))).otherwise(F.array().cast("array<struct<start:int,end:int>>"))


def merge_labels(df: DataFrame, key: list[str], chunk: str, labels: str, policy: str = "keep_first") -> DataFrame:
    """Labels of lines that several chunks hold: of the first chunk, their union, or a failure on conflict.

    ``conflict`` tells whether the chunks disagree.
    """
    out = df.groupBy(*key).agg(F.min_by(labels, chunk).alias("_first"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(labels)))).alias("_all"), (F.count_distinct(F.array_sort(labels)) > 1).alias("conflict"))
    if policy == "fail":
        picked = F.when(F.col("conflict"), F.raise_error(F.lit("chunks disagree on a line's labels"))).otherwise(F.col("_first"))
    else:
        picked = F.col("_all" if policy == "union" else "_first")
    return out.select(*key, picked.alias(labels), "conflict")


def align(chunk: Column, response: Column) -> Column:
    """Start of the first place where ``chunk``'s lines occur in ``response``'s, white space aside; -1 if there is none."""
    bare = lambda a: F.transform(a, lambda x: F.regexp_replace(x, r"(?U)\s+", ""))
    last = F.size(response) - F.size(chunk)
    hits = F.filter(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.slice(bare(response), i + 1, F.greatest(F.size(chunk), F.lit(1))) == bare(chunk))
    return F.when((last >= 0) & (F.size(chunk) > 0), F.coalesce(F.try_element_at(hits, F.lit(1)), F.lit(-1))).otherwise(-1)


def first_mention(df: DataFrame, key: list[str], order: str, value: str) -> DataFrame:
    """The value of the first row of each key."""
    return df.groupBy(*key).agg(F.min_by(value, order).alias(value))


def first_of(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key, whole: evidence kept once."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def round_robin_budget(df: DataFrame, key: list[str], slot: str, index: str, budget: int) -> DataFrame:
    """The first ``budget`` rows of each key when its slots take turns."""
    w = Window.partitionBy(*key).orderBy(index, slot)
    return df.withColumn("turn", F.row_number().over(w)).where(F.col("turn") <= budget)


def best_so_far(df: DataFrame, key: list[str], rank: list[str], iteration: str, value: str) -> DataFrame:
    """The value of the best rank of each key, the earliest on a tie."""
    return df.groupBy(*key).agg(F.max_by(value, F.struct(*rank, (-F.col(iteration)).alias("_"))).alias(value))


def net_change(df: DataFrame, key: list[str], order: list[str], passed: Column) -> DataFrame:
    """Per key whether it passed first and last; ``change`` is repaired, regressed or same."""
    at = F.struct(*order)
    out = df.withColumn("_p", passed).groupBy(*key).agg(F.min_by("_p", at).alias("before"), F.max_by("_p", at).alias("after"))
    return out.withColumn("change", F.when(~F.col("before") & F.col("after"), "repaired").when(F.col("before") & ~F.col("after"), "regressed").otherwise("same"))
