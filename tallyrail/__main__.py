"""Command line: runs and their steps, settings, selections, imports, subsets, reports and the inventory of plugins."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import functions as F

from tallyrail import runs
from tallyrail.functions import settings, text
from tallyrail.operators import audit, baselines, metrics, selection
from tallyrail.session import get_session
from tallyrail.sources import arrays, readers, writers


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tallyrail", description=__doc__)
    commands = p.add_subparsers(dest="command", required=True)
    commands.add_parser("validate-config").add_argument("--config", required=True)
    commands.add_parser("report").add_argument("--run-dir", required=True)
    commands.add_parser("validate-dataset", help="pass the datasets' own sources through their evaluators").add_argument("--config", required=True)
    for name, what in (("generate", "generations of all samples and backends"), ("evaluate", "results of a run's generations"), ("run", "generations, results and reports")):
        step = commands.add_parser(name, help=what)
        step.add_argument("--config", required=True)
        step.add_argument("--run-dir", required=True)
        step.add_argument("--resume", action="store_true")
    frozen = commands.add_parser("create-baseline", help="a manifest of a run's frozen samples with their checks")
    frozen.add_argument("--run-dir", required=True)
    frozen.add_argument("--output", required=True)
    again = commands.add_parser("replay-baseline", help="compare a run's frozen samples with a baseline")
    again.add_argument("--run-dir", required=True)
    again.add_argument("--baseline", required=True)
    taken = commands.add_parser("import-run", help="take a run's generations into a cache")
    taken.add_argument("--run-dir", required=True)
    taken.add_argument("--cache-dir")
    taken.add_argument("--config")
    commands.add_parser("list-plugins")
    freeze = commands.add_parser("create-selection-manifest", help="freeze the samples of a flat dataset into a manifest")
    for name in ("--dataset", "--view", "--output"):
        freeze.add_argument(name, required=True)
    freeze.add_argument("--levels", nargs="*")
    freeze.add_argument("--limit", type=int)
    subset = commands.add_parser("derive-subset", help="a report-only subset of a finished run")
    for name in ("--source-run", "--selection-manifest", "--output-run"):
        subset.add_argument(name, required=True)
    return p


def steps(spark, given: dict, command: str, run_dir: str, resume: bool) -> dict:
    """Run the steps of a command; returns how many records they made."""
    done = {"run_dir": run_dir}
    if command != "evaluate":
        done["generations"] = runs.generate(spark, given, run_dir, resume).count()
    if command != "generate":
        done["results"] = runs.evaluate(spark, given, run_dir).count()
    return done | (runs.report(spark, run_dir) if command == "run" else {})


HARNESS_VERSION, BASELINE = "v2", "tallyrail-baseline-v1"


def baseline(spark, run_dir: str, output: str) -> dict:
    """Write the manifest of a run's frozen samples: entries, how many are valid, reasons of those that are not."""
    found = baselines.entries(readers.frozen_artifacts(spark, f"{run_dir}/artifacts"), HARNESS_VERSION)
    total = baselines.summary(found).first().asDict()
    core = writers.frozen_manifest(found, BASELINE) | total
    manifest = core | {"content_hash": writers.manifest_hash(core)}
    spark.createDataFrame([(json.dumps(manifest, ensure_ascii=False, sort_keys=True),)], "value string").coalesce(1).write.mode("error").text(output)
    return {"output": output, **total, "content_hash": manifest["content_hash"]}


def replay(spark, run_dir: str, path: str) -> dict:
    """Compare a run's frozen samples with a baseline's entries; a baseline that was changed is an error."""
    manifest = json.loads(spark.read.text(path, wholetext=True).first()["value"])
    if wrong := writers.verify_manifest(manifest, BASELINE):
        raise ValueError(f"the baseline does not hold: {', '.join(wrong)}")
    now = baselines.entries(readers.frozen_artifacts(spark, f"{run_dir}/artifacts"), HARNESS_VERSION)
    # Both sides as text: the manifest is JSON, whose mappings have no order.
    lines = lambda rows: rows.withColumn("checks", F.array_sort(F.map_entries("checks"))).select("sample_id", F.to_json(F.struct(*(c for c in now.columns if c != "sample_id")), {"ignoreNullFields": "false"}).alias("entry"))
    then = spark.createDataFrame([(json.dumps(e, ensure_ascii=False),) for e in manifest["entries"]] or [("{}",)], "value string").select(F.from_json("value", now.schema).alias("e")).select("e.*").where("sample_id IS NOT NULL")
    states = audit.replay(lines(then), lines(now), ["sample_id"], [])
    counts = {r["state"]: r["n"] for r in states.groupBy("state").agg(F.count("*").alias("n")).collect()}  # four states at most
    return {"states": counts, "equal": set(counts) <= {"match"}}


def subset(spark, source: str, manifest_path: str, target: str) -> dict:
    """Copy the results that a manifest selects; a selected sample that some backend lacks is an error."""
    results = readers.run_results(spark, source)
    entries = arrays.read_array(spark, manifest_path, "dataset_id string, sample_id string", "entries").select("e.dataset_id", "e.sample_id").distinct()
    selection.fail_if_any(selection.missing_pairs(results, entries, "dataset_id", "sample_id", "backend_id"), "selected samples without a result")
    kept = results.join(entries, ["dataset_id", "sample_id"], "left_semi").drop("record_source")
    writers.append_results(kept, f"{target}/results.jsonl", resume=False)
    return {"output_run": target, "records": spark.read.json(f"{target}/results.jsonl").count()}


def freeze(spark, dataset: str, view: str, output: str, levels: list[str] | None, limit: int | None) -> dict:
    """Write the manifest of the samples that the options select."""
    samples = readers.flat_dataset(spark, dataset, view, levels=levels, limit=limit).select(F.lit(dataset).alias("dataset_id"), "sample_id", "source_group_id", "optimization", "content_hash")
    manifest = writers.frozen_manifest(samples, "tallyrail-selection-v1")
    spark.createDataFrame([(json.dumps(manifest, ensure_ascii=False, sort_keys=True),)], "value string").coalesce(1).write.mode("error").text(output)
    return {"output": output, "count": manifest["count"], "content_hash": manifest["content_hash"]}


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    try:
        if a.command == "validate-config":
            done = {"valid": True, "config_hash": settings.read(a.config)["_config_hash"]}
        elif a.command == "list-plugins":
            done = {"postprocessors": sorted(text.PROCESSORS), "metrics": sorted(m.name for m in metrics.CORE)}
        else:
            spark = get_session(app=f"tallyrail {a.command}")
            if a.command == "report":
                done = runs.report(spark, a.run_dir)
            elif a.command == "create-baseline":
                done = baseline(spark, a.run_dir, a.output)
            elif a.command == "replay-baseline":
                done = replay(spark, a.run_dir, a.baseline)
            elif a.command == "import-run":
                given = settings.read(a.config) if a.config else None
                if not (a.cache_dir or given):
                    raise ValueError("import-run needs --cache-dir or --config")
                done = runs.import_run(spark, a.run_dir, a.cache_dir or given["output"]["cache"], given and [b["id"] for b in given["decompilers"]])
            elif a.command == "validate-dataset":
                done = {"datasets": [r.asDict() for r in runs.validate(spark, settings.read(a.config)).orderBy("dataset_id", "optimization").collect()]}
            elif a.command in ("generate", "evaluate", "run"):
                done = steps(spark, settings.read(a.config), a.command, a.run_dir, a.resume)
            elif a.command == "derive-subset":
                done = subset(spark, a.source_run, a.selection_manifest, a.output_run)
            else:
                done = freeze(spark, a.dataset, a.view, a.output, a.levels, a.limit)
    except (ValueError, OSError) as why:
        print(json.dumps({"error": str(why)}, ensure_ascii=False), file=sys.stderr)
        return 2
    print(json.dumps(done, ensure_ascii=False, indent=2))
    return 0


if __name__ == "__main__":
    sys.exit(main())
