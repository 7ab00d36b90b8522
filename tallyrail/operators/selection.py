"""Exact selection, resume, completeness, matrices, limits and stratified samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fail_if_any(bad: DataFrame, what: str, shown: int = 5) -> None:
    """Raise with the number and the first rows of ``bad``; nothing if it is empty."""
    rows = bad.limit(shown).collect()
    if rows:
        raise ValueError(f"{what}: {bad.count()} rows, such as {[r.asDict() for r in rows]}")


def select_exact(samples: DataFrame, manifest: DataFrame, key: list[str], fields: list[str]) -> DataFrame:
    """Manifest rows with ``mismatched``, the fields that differ from the sample's, or ['missing']."""
    theirs = samples.select(*key, F.lit(True).alias("_here"), *(F.col(f).alias(f"_{f}") for f in fields))
    differs = [F.when(~F.col(f).eqNullSafe(F.col(f"_{f}")), F.lit(f)) for f in fields]
    mismatched = F.when(F.col("_here").isNull(), F.array(F.lit("missing"))).otherwise(F.array_compact(F.array(*differs)))
    return manifest.join(theirs, key, "left").withColumn("mismatched", mismatched).drop("_here", *(f"_{f}" for f in fields))


def selected(samples: DataFrame, manifest: DataFrame, key: list[str], fields: list[str]) -> DataFrame:
    """Samples in the manifest; fails unless every manifest row is unique, present and equal in ``fields``."""
    fail_if_any(manifest.groupBy(*key).count().where("count > 1"), "duplicate manifest entries")
    fail_if_any(select_exact(samples, manifest, key, fields).where(F.size("mismatched") > 0), "selection does not match")
    return samples.join(manifest.select(*key), key, "left_semi")


def pending(expected: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    """Expected rows that are not done yet."""
    return expected.join(done.select(*key).distinct(), key, "left_anti")


def matrix(samples: DataFrame, backends: DataFrame) -> DataFrame:
    """Every sample with every backend. Backends come from a configuration and are few; their number is checked."""
    if backends.limit(1001).count() > 1000:
        raise ValueError("more backends than a configuration holds")
    return samples.crossJoin(F.broadcast(backends))


def missing_pairs(results: DataFrame, selection: DataFrame, dataset: str, sample: str, backend: str) -> DataFrame:
    """Selected samples times the backends that their dataset has results of, less the results there are."""
    backends = results.select(dataset, backend).distinct()
    return pending(selection.select(dataset, sample).distinct().join(backends, dataset), results, [dataset, sample, backend])


def first_rows(df: DataFrame, n: int, order: list[Column], within: list[str] | None = None) -> DataFrame:
    """The first ``n`` rows in order, or of each group: the ordered limit of a scan."""
    if not within:
        return df.orderBy(*order).limit(n)
    w = Window.partitionBy(*within).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def round_robin(df: DataFrame, group: str, stratum: list[str], n: int, seed: int) -> DataFrame:
    """``n`` groups taken in turn from the strata, in each by SHA-256 of seed, NUL and group; with ``turn``."""
    mix = F.sha2(F.concat(F.lit(f"{seed}\0"), F.col(group).cast("string")), 256)
    turn = F.row_number().over(Window.partitionBy(*stratum).orderBy(mix, F.col(group)))
    # No stratum gives more than n groups, so Spark keeps n of each before it sorts.
    return df.withColumn("turn", turn).where(F.col("turn") <= n).orderBy("turn", *stratum).limit(n)


def complete_groups(df: DataFrame, group: str, member: str, required: list[str]) -> DataFrame:
    """Per group: members seen, how many rows, and sorted reasons to leave it out (empty when it is complete)."""
    need = F.array(*(F.lit(r) for r in required))
    return (
        df.groupBy(group)
        .agg(F.count("*").alias("n_rows"), F.array_sort(F.collect_set(F.when(F.col(member).isin(*required), F.col(member)))).alias("members"), F.count(F.when(F.col(member).isin(*required), 1)).alias("_n"))
        .withColumn("reasons", F.array_compact(F.array(F.when(F.size(F.array_except(need, "members")) > 0, F.lit("missing_level")), F.when(F.col("_n") > F.size("members"), F.lit("duplicate_level")))))
        .drop("_n")
    )


def reconcile(records: DataFrame, results: DataFrame, key: list[str]) -> DataFrame:
    """Records, and the results that no record has, on the full key; columns of either side only become null."""
    return records.unionByName(pending(results, records, key), allowMissingColumns=True)


def missing_input(present: dict[str, Column]) -> Column:
    """Reason code of the first required input that is missing, in the order given; null if none is."""
    return F.coalesce(*(F.when(c.isNull() | (F.trim(c.cast("string")) == ""), F.lit(f"{name}_missing")) for name, c in present.items()))


def public_request(samples: DataFrame, allowed: list[str], inputs=("assembly", "binary", "pseudocode")) -> DataFrame:
    """Samples with the inputs that a backend may not see masked: empty assembly text, null others; private columns out."""
    out = samples.drop("private_payload")
    for name in inputs:
        if name in out.columns and name not in allowed:
            masked = F.col(name).withField("text", F.lit("")) if name == "assembly" else F.lit(None).cast(out.schema[name].dataType)
            out = out.withColumn(name, masked)
    return out
