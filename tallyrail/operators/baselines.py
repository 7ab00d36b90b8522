"""Baselines of frozen harnesses: every frozen artifact compared with what its manifest says of it."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyrail.functions.keys import canonical, content_hash

#: States of a selection that froze a harness.
ACCEPTED = ("audit_accepted_frozen", "audit_accepted_holdout_frozen")
HARNESS = (
    "schema_version string, status string, mutation_after_freeze_allowed boolean, contract_id string, contract_hash string, content_hash string, probe_plan_hash string, holdout_probe_plan_hash string, "
    "observation_policy_hash string, exploration_probe_count int, holdout_probe_count int, probe_count int"
)
#: Texts of a frozen sample's files; lines are JSON lines, null where a file is missing.
ARTIFACTS = ("harness", "metadata", "selected", "policy", "exploration_probes", "holdout_probes", "exploration_observations", "holdout_observations")


@F.pandas_udf(T.BooleanType())
def own_hash_holds(manifest: pd.Series) -> pd.Series:
    """Whether a manifest's ``content_hash`` is that of everything else in it."""
    import hashlib

    def holds(text: str | None) -> bool:
        if text is None:
            return False
        value = json.loads(text)
        rest = {k: v for k, v in value.items() if k != "content_hash"}
        return value.get("content_hash") == hashlib.sha256(canonical(rest).encode()).hexdigest()

    return manifest.map(holds)


def lines_of(text: Column) -> Column:
    """The lines of a JSON lines text that are not empty; none of a missing file."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x != "")


def list_hash(text: Column) -> Column:
    """Digest of the canonical JSON list of a JSON lines text."""
    return content_hash(F.concat(F.lit("["), F.array_join(lines_of(text), ","), F.lit("]")))


def entries(artifacts: DataFrame, schema: str) -> DataFrame:
    """Baseline entries of the samples that have a harness manifest: digests, counts, ``checks`` by name, ``failure_reasons``, ``valid``.

    ``artifacts`` has ``sample_id``, the texts ARTIFACTS, ``selected_hash``, the hash
    of the selected contract (null if it is none), and ``runner_sha256``, null where
    the runner is missing. ``schema`` is the manifest's version that counts. A check
    that cannot be made does not hold.
    """
    rows = artifacts.where("harness IS NOT NULL").select("*", F.from_json("harness", HARNESS).alias("h"))
    rows = rows.withColumns({"_explored": F.size(lines_of(F.col("exploration_probes"))), "_held": F.size(lines_of(F.col("holdout_probes")))})
    field = lambda c, name: F.get_json_object(c, f"$.{name}")
    checks = {
        "manifest_content_hash": own_hash_holds("harness"),
        "manifest_v2": F.col("h.schema_version") == schema,
        "status_frozen": F.col("h.status") == "frozen",
        "mutation_forbidden": ~F.col("h.mutation_after_freeze_allowed"),
        "metadata_frozen": field("metadata", "harness_frozen") == "true",
        "metadata_accepted": field("metadata", "contract_selection_status").isin(*ACCEPTED),
        "selected_contract_id": field("selected", "contract_id") == F.coalesce("h.contract_id", F.lit("")),
        "selected_contract_hash": F.col("selected_hash").eqNullSafe(F.col("h.contract_hash")),
        "exploration_probe_plan_hash": list_hash(F.col("exploration_probes")) == F.col("h.probe_plan_hash"),
        "holdout_probe_plan_hash": list_hash(F.col("holdout_probes")) == F.col("h.holdout_probe_plan_hash"),
        "observation_policy_hash": content_hash(F.coalesce("policy", F.lit("{}"))) == F.col("h.observation_policy_hash"),
        "exploration_probe_count": F.col("_explored") == F.col("h.exploration_probe_count"),
        "holdout_probe_count": F.col("_held") == F.col("h.holdout_probe_count"),
        "probe_count": F.col("_explored") + F.col("_held") == F.col("h.probe_count"),
        "exploration_observation_count": F.size(lines_of(F.col("exploration_observations"))) == F.col("_explored"),
        "holdout_observation_count": F.size(lines_of(F.col("holdout_observations"))) == F.col("_held"),
        "original_runner_present": F.col("runner_sha256").isNotNull(),
    }
    made = F.create_map(*(x for k, ok in checks.items() for x in (F.lit(k), F.coalesce(ok, F.lit(False)))))
    rows = rows.withColumn("checks", made)
    failed = F.filter(F.array(*(F.lit(k) for k in checks)), lambda k: ~F.col("checks")[k])
    text = lambda c: F.sha2(F.col(c), 256).alias(f"{c}_sha256")
    out = rows.withColumn("failure_reasons", failed).select(
        "sample_id", "h.contract_id", "h.contract_hash", F.col("h.content_hash").alias("harness_hash"), "h.probe_plan_hash", "h.holdout_probe_plan_hash", "h.observation_policy_hash", text("exploration_observations"), text("holdout_observations"),
        "runner_sha256", F.col("_explored").alias("exploration_probe_count"), F.col("_held").alias("holdout_probe_count"), (F.col("_explored") + F.col("_held")).alias("probe_count"), "checks", "failure_reasons",
    )
    return out.withColumn("valid", F.size("failure_reasons") == 0)


def summary(found: DataFrame) -> DataFrame:
    """One row: frozen, valid and invalid harnesses, and how often each reason occurs, sorted by name."""
    counts = found.select(F.explode("failure_reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))
    reasons = counts.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("reason", "n")))).alias("failure_reason_counts"))
    return found.agg(F.count("*").alias("frozen_harnesses"), F.count_if("valid").alias("valid_frozen_harnesses"), F.count_if(~F.col("valid")).alias("invalid_frozen_harnesses")).join(F.broadcast(reasons))


def plan_checks(found: DataFrame) -> DataFrame:
    """The five checks of a report: the manifest's version, both plans by hash and count, both lists of observations by count."""
    holds = lambda *names: F.forall(F.array(*(F.col("checks")[n] for n in names)), lambda ok: ok)
    return found.select(
        "sample_id", holds("manifest_v2").alias("manifest_v2"), holds("exploration_probe_plan_hash", "exploration_probe_count").alias("exploration_plan"), holds("holdout_probe_plan_hash", "holdout_probe_count").alias("holdout_plan"),
        holds("exploration_observation_count").alias("exploration_observations"), holds("holdout_observation_count").alias("holdout_observations"),
    )
