"""Sinks: result lines, reports, frozen manifests."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyrail.functions.keys import canonical


def append_results(results: DataFrame, path: str, resume: bool) -> None:
    """Write result rows as JSON lines; a resumed run appends, a new one replaces."""
    results.write.mode("append" if resume else "overwrite").option("ignoreNullFields", "false").json(path)


def write_report(summary: dict[str, DataFrame], path: str) -> None:
    """Grouped reports as JSON and, without the reason maps, as CSV with one fixed set of columns; reports are small."""
    for name, df in summary.items():
        df.coalesce(1).write.mode("overwrite").option("ignoreNullFields", "false").json(f"{path}/{name}.json")
        flat = [c for c, kind in df.dtypes if not kind.startswith(("map", "array", "struct"))]
        df.select(*flat).coalesce(1).write.mode("overwrite").option("header", "true").csv(f"{path}/{name}.csv")


def frozen_manifest(entries: DataFrame, schema: str, limit: int = 1_000_000) -> dict:
    """Entries in canonical order with the hash of everything but that hash. A manifest is a document; its size is checked."""
    n = entries.count()
    if n > limit:
        raise ValueError(f"{n} entries are more than a manifest holds")
    rows = sorted((json.loads(r) for r in entries.toJSON().collect()), key=canonical)
    core = {"schema": schema, "count": n, "entries": rows}
    return core | {"content_hash": manifest_hash(core)}


def manifest_hash(manifest: dict) -> str:
    """SHA-256 of a manifest without its content hash."""
    import hashlib

    return hashlib.sha256(canonical({k: v for k, v in manifest.items() if k != "content_hash"}).encode()).hexdigest()


def verify_manifest(manifest: dict, schema: str) -> list[str]:
    """What is wrong with a frozen manifest; empty if nothing is."""
    checks = {"schema": manifest.get("schema") == schema, "content_hash": manifest.get("content_hash") == manifest_hash(manifest), "count": manifest.get("count") == len(manifest.get("entries", []))}
    return sorted(k for k, ok in checks.items() if not ok)


def failure_catalog(failures: DataFrame, columns: list[str]) -> DataFrame:
    """Lines of a Markdown table, headed and in order."""
    cells = F.concat(F.lit("| "), F.concat_ws(" | ", *(F.coalesce(F.replace(F.col(c).cast("string"), F.lit("|"), F.lit("\\|")), F.lit("")) for c in columns)), F.lit(" |"))
    head = failures.sparkSession.createDataFrame([(0, "| " + " | ".join(columns) + " |"), (1, "|" + " --- |" * len(columns))], "o int, line string")
    return head.union(failures.select(F.lit(2).alias("o"), cells.alias("line"))).orderBy("o", "line").select("line")


def phase_report(records: DataFrame, summary: DataFrame, path: str, level: str = "optimization") -> None:
    """A phase's report: records as JSON lines by sample, the summary as JSON, and as CSV with all levels (null) before each of them."""
    append_results(records.repartitionByRange("sample_id").sortWithinPartitions("sample_id"), f"{path}/records.jsonl", resume=False)
    ordered = summary.orderBy(F.col(level).isNotNull(), level)
    ordered.coalesce(1).write.mode("overwrite").option("ignoreNullFields", "false").json(f"{path}/summary.json")
    flat = [c for c, kind in summary.dtypes if not kind.startswith(("map", "array", "struct")) and c != level]
    ordered.select(F.coalesce(F.concat(F.lit(f"{level}="), level), F.lit("overall")).alias("stratum"), *flat).coalesce(1).write.mode("overwrite").option("header", "true").csv(f"{path}/summary.csv")
