"""The life of a run: samples of the configured datasets, generations of each backend, evidence, results and reports.

Backends and evaluators are plugins (``module:object`` of an allowed module) behind
the interface of ``sources.providers``; they work on the executors, a batch at a
time. Every step reads what the step before it has written, so that a run can be
taken up again: what is recorded is not asked for a second time.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyrail.functions import text
from tallyrail.operators import cache, metrics, records, selection
from tallyrail.session import scratch, stored
from tallyrail.sources import arrays, providers, readers, writers

KEY = ["dataset_id", "backend_id", "sample_id"]
GENERATIONS = "dataset_id string, backend_id string, sample_id string, optimization string, language string, success boolean, code string, reason string, detail string, evaluated boolean"
CACHED = "cache_key string, success boolean, code string, reason string, detail string"


def samples(spark: SparkSession, settings: dict) -> DataFrame:
    """Samples of all datasets: ids, level, language, the public inputs, and the private payload; a manifest selects exactly."""
    parts = []
    for d in settings["datasets"]:
        if d["type"] != "flat":
            raise ValueError(f"unknown dataset type {d['type']!r}")
        rows = readers.flat_dataset(spark, d["path"], d.get("assembly_view", "objdump_intel_instruction_only"), d.get("pseudocode_view"), d.get("optimizations"), d.get("limit"))
        rows = rows.select(F.lit(d["id"]).alias("dataset_id"), "sample_id", "source_group_id", "function_name", "optimization", "language", "assembly", F.col("pseudocode.code").alias("pseudocode"), "binary", "content_hash", "private_payload")
        if d.get("selection_manifest"):
            entries = arrays.read_array(spark, d["selection_manifest"], "dataset_id string, sample_id string, content_hash string", "entries").select("e.*").where(F.col("dataset_id") == d["id"])
            rows = selection.selected(rows, entries, ["dataset_id", "sample_id"], ["content_hash"])
        parts.append(rows)
    return reduce(DataFrame.unionByName, parts)


def _provider(plugin: str, allowed: tuple[str, ...]):
    """A function that makes the provider in a task."""
    return lambda: providers.load(plugin, allowed)()


def generate(spark: SparkSession, settings: dict, run_dir: str, resume: bool = False) -> DataFrame:
    """Generations of every sample by every backend, written to the run; cached ones are taken, failures are not cached.

    A backend gets its ``required_inputs`` only; a sample without one of them is a
    failure with the input's name, and the backend is not asked.
    """
    path, allowed = f"{run_dir}/generations.jsonl", tuple(settings.get("allowed_modules", ()))
    every, folder = stored(samples(spark, settings), f"{scratch(spark)}/samples"), settings["output"]["cache"]
    kept = f"{folder}/generations"
    if not resume:
        writers.append_results(spark.createDataFrame([], GENERATIONS), path, resume=False)
    done = readers.json_lines(spark, path, GENERATIONS)
    for b in settings["decompilers"]:  # a backend is an entry of the settings
        needed = b.get("required_inputs", ["assembly"])
        key = F.sha2(F.concat_ws("\n", F.lit("generation"), F.col("content_hash"), F.lit(b["id"]), F.lit(b["plugin"]), F.lit(b.get("version", "")), F.array_join(F.array(*(F.lit(x) for x in needed)), ",")), 256)
        wanted = every.withColumn("backend_id", F.lit(b["id"])).withColumn("cache_key", key)
        wanted = selection.pending(wanted, done.select(*KEY), KEY)
        present = {n: F.col("assembly.text") if n == "assembly" else F.col("binary.path") if n == "binary" else F.col(n) for n in needed}
        wanted = wanted.withColumn("missing", selection.missing_input(present))
        known = spark.read.schema(CACHED).parquet(kept) if cache.exists(spark, kept) else spark.createDataFrame([], CACHED)
        wanted = stored(cache.lookup(wanted, known, "cache_key", "generation"), f"{scratch(spark)}/wanted")
        ids = ["dataset_id", "backend_id", "sample_id", "optimization", "language"]
        gone = wanted.where("missing IS NOT NULL").select(*ids, F.lit(False).alias("success"), F.lit(None).cast("string").alias("code"), F.col("missing").alias("reason"), F.lit(None).cast("string").alias("detail"))
        old = wanted.where("missing IS NULL AND generation_hit").select(*ids, "success", "code", "reason", "detail")
        todo = wanted.where("missing IS NULL AND NOT generation_hit").drop("success", "code", "reason", "detail")
        # The plugin answers under a name of its own: samples of two datasets may have one id.
        asked = selection.public_request(todo, needed).withColumn("sample_id", F.col("cache_key"))
        new = stored(providers.generate(asked, _provider(b["plugin"], allowed)), f"{scratch(spark)}/new").withColumnRenamed("sample_id", "cache_key")
        cache.save(new.where("success").select("cache_key", "success", "code", "reason", "detail"), kept, "cache_key", volatile=("detail",))
        fresh = todo.join(new.dropDuplicates(["cache_key"]), "cache_key").select(*ids, "success", "code", "reason", "detail")
        rows = gone.unionByName(old).unionByName(fresh).withColumn("evaluated", F.lit(False))
        writers.append_results(rows.select([c.split()[0] for c in GENERATIONS.split(", ")]), path, resume=True)
    return readers.json_lines(spark, path, GENERATIONS)


def evaluate(spark: SparkSession, settings: dict, run_dir: str) -> DataFrame:
    """Results of the run's generations, written to it: cleaned code, evidence of the datasets' evaluators, reasons."""
    rows = readers.json_lines(spark, f"{run_dir}/generations.jsonl", GENERATIONS)
    every, allowed = samples(spark, settings).select("dataset_id", "sample_id", "function_name", "private_payload"), tuple(settings.get("allowed_modules", ()))
    cleaned = text.postprocess(rows.where("success").join(every, ["dataset_id", "sample_id"]), "code", "function_name", settings["postprocessors"])
    found = []
    for d in settings["datasets"]:
        mine = cleaned.where(F.col("dataset_id") == d["id"]).withColumn("request_id", F.sha2(F.concat_ws("\n", *KEY), 256))
        if d.get("evaluator"):
            asked = mine.select(F.col("request_id").alias("sample_id"), "code", "function_name", "optimization", "private_payload")
            evidence = stored(providers.evaluate(asked, _provider(d["evaluator"], allowed)), f"{scratch(spark)}/evidence").withColumnRenamed("sample_id", "request_id").withColumnRenamed("reason", "why")
            found.append(mine.select(*KEY, "request_id").join(evidence, "request_id").select(*KEY, "compile_pass", "link_pass", "behavioral_pass", "why"))
    none = spark.createDataFrame([], "dataset_id string, backend_id string, sample_id string, compile_pass boolean, link_pass boolean, behavioral_pass boolean, why string")
    evidence = reduce(DataFrame.unionByName, found, none)
    protocols = F.create_map(*(F.lit(x) for d in settings["datasets"] for x in (d["id"], str(d.get("evaluation_protocol") or "unknown"))))
    judged = {d["id"]: bool(d.get("evaluator")) for d in settings["datasets"]}
    able = F.create_map(*(F.lit(x) for pair in judged.items() for x in pair))[F.col("dataset_id")]
    out = rows.join(evidence, KEY, "left").select(
        *KEY, protocols[F.col("dataset_id")].alias("protocol_id"), F.lit("1").alias("protocol_version"), F.lit("benchmark").alias("split"), "language", "optimization", F.col("success").alias("decompile_success"),
        F.when(able, F.coalesce(F.col("compile_pass") & F.col("link_pass"), F.lit(False))).alias("recompilable"), F.when(able, F.coalesce("behavioral_pass", F.lit(False))).alias("behavioral_pass"),
        F.coalesce("reason", "why").alias("reason"), F.when(able, F.array(*(F.lit(c) for c in ("candidate_compile", "fixture_link", "behavior")))).otherwise(F.array().cast("array<string>")).alias("capabilities"),
        F.create_map().cast("map<string,double>").alias("metrics"),
    )
    writers.append_results(out, f"{run_dir}/results.jsonl", resume=False)
    return readers.json_lines(spark, f"{run_dir}/results.jsonl", readers.RESULTS)


def validate(spark: SparkSession, settings: dict) -> DataFrame:
    """Per dataset and level: samples, and how many of their own sources pass the dataset's evaluator."""
    every, allowed, parts = samples(spark, settings), tuple(settings.get("allowed_modules", ())), []
    for d in settings["datasets"]:
        if not d.get("evaluator"):
            raise ValueError(f"dataset {d['id']!r} has no evaluator to validate it with")
        mine = every.where(F.col("dataset_id") == d["id"])
        asked = mine.select("sample_id", F.col("private_payload.code").alias("code"), "function_name", "optimization", "private_payload")
        evidence = stored(providers.evaluate(asked, _provider(d["evaluator"], allowed)), f"{scratch(spark)}/evidence")
        parts.append(mine.select("dataset_id", "sample_id", "optimization").join(evidence.select("sample_id", "behavioral_pass"), "sample_id"))
    return records.preflight_totals(reduce(DataFrame.unionByName, parts), ["dataset_id", "optimization"], F.col("behavioral_pass"))


def report(spark: SparkSession, run_dir: str) -> dict:
    """Write a run's grouped reports beside its records; returns the totals."""
    rows = metrics.with_metrics(readers.run_results(spark, run_dir))
    groups = {"by_dataset": ["dataset_id"], "by_backend": ["backend_id"], "by_level": ["backend_id", "optimization"]}
    writers.write_report({n: metrics.summarize(rows, dims) for n, dims in groups.items()}, f"{run_dir}/report")
    return {"run_dir": run_dir, "records": rows.count(), "reports": sorted(groups)}


def import_run(spark: SparkSession, run_dir: str, cache_dir: str, backends: list[str] | None = None) -> dict:
    """Take a run's successful generations into the cache of imported ones; returns how many were imported or skipped, by reason.

    A generation is known by dataset, backend and sample. One that the cache holds
    with another candidate is skipped and the cached one kept; ``backends`` are those
    that the settings have, by default all of the run.
    """
    path = f"{cache_dir}/imported"
    rows = readers.json_lines(spark, f"{run_dir}/generations.jsonl", GENERATIONS)
    schema = "cache_key string, dataset_id string, backend_id string, sample_id string, candidate string"
    held = spark.read.schema(schema).parquet(path) if cache.exists(spark, path) else spark.createDataFrame([], schema)
    known = rows.select("backend_id").distinct() if backends is None else spark.createDataFrame([(b,) for b in backends], "backend_id string")
    artifacts = rows.select(*KEY, F.when(F.col("success"), F.col("code")).alias("candidate"), "evaluated")
    done = stored(records.import_records(rows.select(*KEY, F.col("code").alias("candidate")), known, artifacts, rows.select("sample_id"), held.select(*KEY, "candidate"), KEY), f"{scratch(spark)}/import")
    new = done.where("status = 'imported'").select(F.sha2(F.concat_ws("\n", *KEY), 256).alias("cache_key"), *KEY, "candidate")
    cache.save(new, path, "cache_key")
    counts = done.groupBy("status", "reason").agg(F.count("*").alias("n")).collect()  # a row per reason
    return {"imported": sum(r["n"] for r in counts if r["status"] == "imported"), "skipped": {r["reason"]: r["n"] for r in counts if r["status"] == "skipped"}}
