"""What a finished run is handed over with: reports, records, an inventory of all files, and a manifest over them."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyrail.functions.numbers import rate, wilson
from tallyrail.operators import sequences
from tallyrail.operators.audit import TERMINAL
from tallyrail.operators.metrics import grouping_sets
from tallyrail.sources import readers, writers

SCHEMA = "tallyrail-delivery-v1"
#: What a record has: the states that a sample went through, whether its harness was frozen, and what it cost.
RECORD = "sample_id string, source_group_id string, optimization string, states array<string>, harness_frozen boolean, executions long, model_calls long, seconds double, stop_reason string"


def transitions(records: DataFrame) -> DataFrame:
    """source_status, target_status, count over the records' states."""
    return sequences.path_transitions(records, "states").select(F.col("source").alias("source_status"), F.col("target").alias("target_status"), F.col("n").alias("count"))


def stratified(records: DataFrame) -> DataFrame:
    """Per stratum (overall, each level, each group): totals, frozen harnesses, their rate over all records with its interval in two columns, ended samples, executions."""
    rows = records.select(F.coalesce("optimization", F.lit("unknown")).alias("optimization"), F.coalesce("source_group_id", F.lit("unknown")).alias("source_group"), "harness_frozen", "executions", F.element_at("states", -1).isin(*TERMINAL).alias("ended"))
    frozen = F.count_if(F.coalesce("harness_frozen", F.lit(False)))
    ci = wilson(frozen, F.count("*"))
    out = grouping_sets(rows, [[], ["optimization"], ["source_group"]], [
        F.count("*").alias("total"), frozen.alias("frozen_harnesses"), rate(frozen, F.count("*"), None).alias("freeze_rate"), ci["low"].alias("freeze_rate_low"), ci["high"].alias("freeze_rate_high"),
        F.count_if("ended").alias("terminal_states"), F.coalesce(F.sum("executions"), F.lit(0)).alias("executions"),
    ])
    name = F.when(F.col("optimization").isNotNull(), F.concat(F.lit("optimization="), "optimization")).when(F.col("source_group").isNotNull(), F.concat(F.lit("source_group="), "source_group")).otherwise("overall")
    return out.select(name.alias("stratum"), "total", "frozen_harnesses", "freeze_rate", "freeze_rate_low", "freeze_rate_high", "terminal_states", "executions")


def cost(records: DataFrame, numbers: list[str]) -> DataFrame:
    """Samples, and the total, mean and largest of each number per sample; missing numbers count as 0."""
    each: list[Column] = [F.count("*").alias("samples")]
    for c in numbers:
        v = F.coalesce(F.col(c), F.lit(0))
        each += [F.coalesce(F.sum(v), F.lit(0)).alias(f"{c}_total"), rate(F.sum(v), F.count("*")).alias(f"{c}_mean"), F.coalesce(F.max(v), F.lit(0)).alias(f"{c}_max")]
    return records.agg(*each)


def failures(records: DataFrame) -> DataFrame:
    """Samples whose harness was not frozen: last state, reason to stop, how many, and the first by name."""
    rows = records.where(~F.coalesce("harness_frozen", F.lit(False))).select(F.element_at("states", -1).alias("status"), F.coalesce(F.nullif("stop_reason", F.lit("")), F.lit("unknown")).alias("stop_reason"), "sample_id")
    return rows.groupBy("status", "stop_reason").agg(F.count("*").alias("count"), F.min("sample_id").alias("example"))


def deliver(records: DataFrame, run_dir: str, experiment: str, commitment: dict, selection: dict | None = None) -> dict:
    """Write a run's reports below ``run_dir``/reports and return its manifest, which is written beside them.

    The manifest has the inventory of every file of the run but itself and a hash of
    everything in it; the same records and files give the same hashes. Reports are
    small; records and inventory are written by as many tasks as they take.
    """
    reports = f"{run_dir.rstrip('/')}/reports"
    writers.write_report({"state_transitions": transitions(records).orderBy("source_status", "target_status"), "stratified": stratified(records).orderBy(F.col("stratum") != "overall", "stratum"), "cost": cost(records, ["executions", "model_calls", "seconds"])}, reports)
    writers.failure_catalog(failures(records), ["status", "stop_reason", "count", "example"]).coalesce(1).write.mode("overwrite").text(f"{reports}/failure_catalog.md")
    writers.append_results(records.repartitionByRange("sample_id").sortWithinPartitions("sample_id"), f"{reports}/records.jsonl", resume=False)
    spark = records.sparkSession
    files = readers.binary_files(spark, run_dir, "*").where(~F.col("path").rlike(r"/(_SUCCESS|[^/]*\.crc|delivery_manifest\.json/[^/]*)$"))
    # Names that Spark's writers make up differ from run to run; a report's place and content do not.
    place = F.regexp_replace(F.regexp_replace("path", "^.*?" + _plain(run_dir) + "/", ""), r"part-(\d+)-[^/]*$", "part-$1")
    inventory = readers.inventory(files.withColumn("path", place))
    core = writers.frozen_manifest(inventory, SCHEMA) | {"experiment": experiment, "algorithm_commitment": commitment, "selection_manifest": selection, "sample_count": records.count()}
    manifest = core | {"content_hash": writers.manifest_hash(core)}
    spark.createDataFrame([(json.dumps(manifest, ensure_ascii=False, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{run_dir.rstrip('/')}/delivery_manifest.json")
    return manifest


def _plain(run_dir: str) -> str:
    """The last part of a folder's path as a regular expression."""
    import re

    return re.escape(run_dir.rstrip("/").rsplit("/", 1)[-1])
