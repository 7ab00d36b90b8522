"""Joins with a residual: ranges, positional alignment, first matches and label lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def in_range(points: DataFrame, ranges: DataFrame, key: list[str], at: str, start: str, end: str) -> DataFrame:
    """Points in half-open ranges of the same key: an equi-join with the range as its residual condition."""
    return points.join(ranges, key).where((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end)))


def relocations_for_symbol(relocations: DataFrame, symbols: DataFrame) -> DataFrame:
    """Relocations (section, offset) that lie in a symbol (section, start, size); size 0 takes the whole section."""
    inside = (F.col("size") == 0) | ((F.col("offset") >= F.col("start")) & (F.col("offset") < F.col("start") + F.col("size")))
    return relocations.join(symbols, "section").where(inside)


def zip_rows(left: DataFrame, right: DataFrame, key: list[str], position: str) -> DataFrame:
    """Positional join of two ordered lists per key; a row without its partner is an error."""
    l, r = left.withColumn("_l", F.lit(True)), right.withColumn("_r", F.lit(True))
    both = l.join(r, [*key, position], "full")
    lone = F.col("_l").isNull() | F.col("_r").isNull()
    checked = F.when(lone, F.raise_error(F.lit("the two sides have different lengths"))).otherwise(True)
    return both.withColumn("_ok", checked).where("_ok").drop("_l", "_r", "_ok")


def first_match(left: DataFrame, right: DataFrame, key: list[str], order: str) -> DataFrame:
    """Left join with the first matching row only."""
    others = [c for c in right.columns if c not in key]
    first = right.groupBy(*key).agg(F.min_by(F.struct(*others), order).alias("_m"))
    return left.join(first, key, "left").select(*left.columns, *(F.col(f"_m.{c}").alias(c) for c in others))


def keep_last(manifest: DataFrame, key: list[str], order: str) -> DataFrame:
    """The last row of each key: duplicates in a manifest are overridden."""
    return manifest.groupBy(*key).agg(F.max_by(F.struct(*manifest.columns), order).alias("_m")).select("_m.*")


def set_difference(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """Keys that only one side has, with ``side``; empty when the sets are equal."""
    l, r = left.select(*key).distinct().withColumn("_l", F.lit(True)), right.select(*key).distinct().withColumn("_r", F.lit(True))
    side = F.when(F.col("_r").isNull(), "left").when(F.col("_l").isNull(), "right")
    return l.join(r, key, "full").withColumn("side", side).where("side IS NOT NULL").drop("_l", "_r")


def classify_dependencies(undefined: DataFrame, direct: DataFrame, lists: dict[str, list[str]]) -> DataFrame:
    """Undefined symbols with ``direct`` (referenced by the target) and ``kind``: the first list that names them, else unknown."""
    kind = F.coalesce(*(F.when(F.col("name").isin(*names), F.lit(k)) for k, names in lists.items() if names), F.lit("unknown"))
    flag = direct.select("name").distinct().withColumn("direct", F.lit(True))
    return undefined.join(flag, "name", "left").withColumn("direct", F.coalesce("direct", F.lit(False))).withColumn("kind", kind)


def unsupported_direct(dependencies: DataFrame, supported: list[str]) -> DataFrame:
    """Names of the dependencies that the target refers to itself and whose kind is none of ``supported``."""
    return dependencies.where(F.col("direct") & ~F.col("kind").isin(*supported)).select("name")
