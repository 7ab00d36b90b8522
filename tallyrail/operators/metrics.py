"""Metric registry, capability gating, aggregates and the grouped reports."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyrail.functions.numbers import rate, wilson


@dataclass(frozen=True)
class Metric:
    """A metric: its value per row, the capabilities that a row needs for one, and its aggregates."""

    name: str
    value: Callable[[], Column]
    requires: tuple[str, ...] = ()
    kind: str = "bool"
    aggregates: Callable[[str], dict[str, Column]] | None = field(default=None)

    def column(self, capabilities: str | None = "capabilities") -> Column:
        """The value, null where a required capability is missing."""
        if not self.requires or capabilities is None:
            return self.value().alias(self.name)
        need = F.array(*(F.lit(c) for c in self.requires))
        return F.when(F.size(F.array_except(need, capabilities)) == 0, self.value()).alias(self.name)

    def aggs(self) -> list[Column]:
        return [c.alias(f"{self.name}_{k}") for k, c in (self.aggregates or KINDS[self.kind])(self.name).items()]


def bool_aggregates(name: str) -> dict[str, Column]:
    """eligible, passed and rate; rate 0.0 when nothing is eligible."""
    c = F.col(name).cast("int")
    return {"eligible": F.count(c), "passed": F.coalesce(F.sum(c), F.lit(0)).cast("long"), "rate": rate(F.coalesce(F.sum(c), F.lit(0)), F.count(c))}


def number_aggregates(name: str) -> dict[str, Column]:
    """eligible and mean; no mean when nothing is eligible."""
    return {"eligible": F.count(name), "mean": F.avg(F.col(name).cast("double"))}


def metadata_aggregates(name: str) -> dict[str, Column]:
    """eligible, sum, mean, min and max; sum and mean 0.0 when nothing is eligible."""
    c = F.col(name).cast("double")
    return {"eligible": F.count(c), "sum": F.coalesce(F.sum(c), F.lit(0.0)), "mean": F.coalesce(F.avg(c), F.lit(0.0)), "min": F.min(c), "max": F.max(c)}


KINDS = {"bool": bool_aggregates, "number": number_aggregates, "metadata": metadata_aggregates}
CORE = (
    Metric("decompile_success", lambda: F.col("decompile_success")),
    Metric("recompilable", lambda: F.col("recompilable"), ("candidate_compile", "fixture_link")),
    Metric("behavioral_pass", lambda: F.col("behavioral_pass"), ("behavior",)),
)
#: Metrics over a contract run's metadata file; a row without one has no value.
METADATA = tuple(
    Metric(n, lambda n=n: F.col(f"metadata.{n}"), kind="metadata")
    for n in ("generated_tests", "executions", "counterexamples", "repair_iterations")
) + tuple(
    Metric(n, lambda n=n: F.when(F.col("metadata").isNotNull(), F.when(F.col(f"metadata.{n}").eqNullSafe(F.lit(True)), 1.0).otherwise(0.0)), kind="metadata")
    for n in ("harness_frozen", "candidate_compile", "candidate_link", "differential_pass")
)
#: Dimensions of the three reports; a missing protocol is ``unknown`` in all of them.
BY_DIMENSIONS = ("dataset_id", "backend_id", "protocol_id", "protocol_version", "split", "language", "optimization")
BY_LEVEL = ("dataset_id", "backend_id", "protocol_id", "protocol_version", "optimization")
OVERALL = ("dataset_id", "backend_id", "protocol_id", "protocol_version")


def reason_or_pass(c: Column) -> Column:
    """Failure reason, with null and the empty text meaning a pass."""
    return F.when(c.isNull() | (c == ""), "pass").otherwise(c)


def with_metrics(results: DataFrame, metrics=CORE, capabilities: str | None = "capabilities") -> DataFrame:
    """Results with their metric columns gated by capabilities; protocol columns coerced to ``unknown``."""
    out = results
    for c in ("protocol_id", "protocol_version"):
        if c in results.columns:
            out = out.withColumn(c, F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit("unknown")))
    return out.withColumns({m.name: m.column(capabilities) for m in metrics})


def summarize(results: DataFrame, dimensions, metrics=CORE) -> DataFrame:
    """One row per group, sorted by its key: total, every registered metric's aggregates, reasons as a sorted map."""
    reasons = results.groupBy(*dimensions, reason_or_pass(F.col("reason")).alias("_reason")).agg(F.count("*").alias("_n"))
    reasons = reasons.groupBy(*dimensions).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("_reason", "_n")))).alias("failure_reasons"))
    total = results.groupBy(*dimensions).agg(F.count("*").alias("total"), *(a for m in metrics for a in m.aggs()))
    same = [total[d].eqNullSafe(reasons[d]) for d in dimensions]
    on = same[0]
    for s in same[1:]:
        on = on & s
    return total.join(reasons, on).select(*(total[c] for c in total.columns), "failure_reasons").orderBy(*dimensions)


def grouping_sets(df: DataFrame, sets: list[list[str]], aggregates: list[Column]) -> DataFrame:
    """Aggregates over explicit grouping sets in one pass, with ``grouping`` naming each row's set."""
    names = list(dict.fromkeys(c for s in sets for c in s))
    gone = {c: F.grouping(F.col(c)) for c in names}
    label = F.lit(None).cast("string")
    for s in sets:
        hit = F.lit(True)
        for c in names:
            hit = hit & (gone[c] == (0 if c in s else 1))
        label = F.coalesce(label, F.when(hit, F.lit("+".join(s) or "overall")))
    return df.groupingSets([[F.col(c) for c in s] for s in sets], *(F.col(c) for c in names)).agg(label.alias("grouping"), *aggregates)


def histogram(df: DataFrame, dimensions: list[str], value: Column, name: str = "reason") -> DataFrame:
    """Rows of (dimensions, value, n), null and empty values counted as ``pass``."""
    return df.groupBy(*dimensions, reason_or_pass(value).alias(name)).agg(F.count("*").alias("n"))


def rate_with_interval(k: Column, n: Column, name: str) -> list[Column]:
    """A rate that is null when nothing is eligible, with its Wilson interval in two columns."""
    ci = wilson(k, n)
    return [rate(k, n, None).alias(f"{name}_rate"), ci["low"].alias(f"{name}_low"), ci["high"].alias(f"{name}_high")]


def fixed_and_frozen(df: DataFrame, dimensions: list[str], frozen: Column, passed: Column) -> DataFrame:
    """Passes over all rows and over frozen rows side by side; rates are null for an empty denominator."""
    k, f = F.count_if(passed), F.count_if(frozen)
    return df.groupBy(*dimensions).agg(F.count("*").alias("total"), f.alias("frozen"), k.alias("passed"), rate(k, F.count("*"), None).alias("fixed_rate"), rate(F.count_if(passed & frozen), f, None).alias("frozen_rate"))


def _slot_counts(slots: DataFrame, dimensions: list[str], positive: str) -> DataFrame:
    f, t = F.coalesce("f", F.lit("missing")) == positive, F.coalesce("t", F.lit("missing")) == positive
    out = slots.groupBy(*dimensions).agg(F.count_if(f & t).alias("tp"), F.count_if(f & ~t).alias("fp"), F.count_if(~f & t).alias("fn"))
    p, r = rate(F.col("tp"), F.col("tp") + F.col("fp"), None), rate(F.col("tp"), F.col("tp") + F.col("fn"), None)
    f1 = F.when(2 * F.col("tp") + F.col("fp") + F.col("fn") > 0, 2.0 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn")))
    return out.select("*", p.alias("precision"), r.alias("recall"), f1.alias("f1"))


def slot_scores(df: DataFrame, dimensions: list[str], found: str, truth: str, positive: str) -> DataFrame:
    """Precision, recall and F1 of ``positive`` over slots of two arrays, the shorter padded with ``missing``."""
    return _slot_counts(df.select(*dimensions, F.inline(F.arrays_zip(F.col(found).alias("f"), F.col(truth).alias("t")))), dimensions, positive)


def slot_scores_of_rows(found: DataFrame, truth: DataFrame, dimensions: list[str], order: list[str], value: str, positive: str, blocks: int = 64) -> DataFrame:
    """``slot_scores`` of two ordered tables: rows meet by their position in the group, and no group is held in one row.

    Positions come from counts of ranges of the first order column, so that a large group is sorted in parts.
    """

    def numbered(df: DataFrame, name: str) -> DataFrame:
        rows = df.select(*dimensions, *order, F.col(value).alias(name))
        time = rows.schema[order[0]].dataType.typeName().startswith(("timestamp", "date"))
        first = (F.col(order[0]).cast("timestamp") if time else F.col(order[0])).cast("double")
        ends = rows.groupBy(*dimensions).agg(F.min(first).alias("_low"), F.max(first).alias("_high"))
        block = F.least(F.floor((first - F.col("_low")) / F.greatest(F.col("_high") - F.col("_low"), F.lit(1e-9)) * blocks), F.lit(blocks - 1)).cast("int")
        rows = rows.join(ends, dimensions).withColumn("_block", F.coalesce(block, F.lit(-1))).drop("_low", "_high")
        sizes = rows.groupBy(*dimensions, "_block").agg(F.count("*").alias("_size"))
        ahead = F.coalesce(F.sum("_size").over(Window.partitionBy(*dimensions).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        before = sizes.select(*dimensions, "_block", ahead.alias("_ahead"))
        rank = F.row_number().over(Window.partitionBy(*dimensions, "_block").orderBy(*order))
        return rows.withColumn("_rank", rank).join(before, [*dimensions, "_block"]).select(*dimensions, (F.col("_ahead") + F.col("_rank")).alias("_at"), name)

    return _slot_counts(numbered(found, "f").join(numbered(truth, "t"), [*dimensions, "_at"], "full"), dimensions, positive)
