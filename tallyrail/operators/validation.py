"""Constraint tables: rules over rows and groups that give a list of errors instead of a first failure."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyrail.functions.keys import content_hash


def row_errors(df: DataFrame, key: list[str], rules: dict[str, Column]) -> DataFrame:
    """(key, error) for every rule that a row breaks; a null verdict is a break."""
    broken = F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items())))
    return df.select(*key, F.explode(broken).alias("error"))


def group_errors(df: DataFrame, group: str, level: str, levels: list[str], same: list[str]) -> DataFrame:
    """(group, error): groups that lack or repeat a level, or whose members differ in a column that must be the same."""
    need = F.array(*(F.lit(x) for x in levels))
    g = df.groupBy(group).agg(F.collect_set(F.when(F.col(level).isin(*levels), F.col(level))).alias("_l"), F.count(level).alias("_n"), *(F.count_distinct(F.coalesce(F.col(c).cast("string"), F.lit("\0"))).alias(f"_{c}") for c in same))
    rules = {"missing_level": F.size(F.array_except(need, "_l")) == 0, "repeated_level": F.col("_n") <= F.size("_l"), **{f"differs:{c}": F.col(f"_{c}") == 1 for c in same}}
    return row_errors(g, [group], rules)


def dataset_errors(df: DataFrame, group: str, level: str, rows: int, groups: int, per_level: dict[str, int]) -> list[str]:
    """Errors of the exact counts of a fixed dataset."""
    got = df.agg(F.count("*").alias("rows"), F.count_distinct(group).alias("groups"), *(F.count_if(F.col(level) == x).alias(f"n_{x}") for x in per_level)).first()
    wanted = {"rows": rows, "groups": groups, **{f"n_{x}": n for x, n in per_level.items()}}
    return [f"{k}: {got[k]} instead of {n}" for k, n in wanted.items() if got[k] != n]


def flat_dataset_rules() -> dict[str, Column]:
    """Row rules of a flat dataset read by ``readers.flat_dataset``."""
    filled = lambda c: F.trim(F.col(c)) != ""
    return {
        "sample_id": filled("sample_id") & F.col("sample_id").startswith(F.concat("source_group_id", F.lit(":"))),
        "function_name": F.col("function_name").rlike(r"^[A-Za-z_]\w*$"),
        "optimization": F.col("optimization").isin("O0", "O1", "O2", "O3"),
        "assembly": filled("assembly.text"),
        "source": filled("private_payload.code"),
        "function_in_source": F.col("private_payload.code").contains(F.col("function_name")),
        "content_hash": F.col("content_hash").rlike("^[0-9a-f]{64}$"),
    }


#: What the validator reads of a flat dataset's samples; other fields are left alone.
CHECKED = (
    "sample_id string, legacy_name string, source_group_id string, function_name string, optimization string, source struct<code:string,code_sha256:string>, "
    "evaluation struct<dependencies:string,dependencies_sha256:string,executable_wrapper:string,executable_wrapper_sha256:string,io_pairs:string,io_pair_count:int,io_pairs_sha256:string,"
    "method:string,passed:boolean,uses_reference_assembly:boolean,compiler_flags:array<string>>, "
    "assembly struct<gcc_target_assembly:string,gcc_target_assembly_sha256:string,full_translation_unit_assembly:string,full_translation_unit_assembly_sha256:string,"
    "objdump_intel_with_relocations:string,objdump_intel_sha256:string,objdump_intel_instruction_only:string,objdump_intel_instruction_only_sha256:string,objdump_intel_instruction_only_syntax:string,"
    "objdump_att_instruction_only:string,objdump_att_instruction_only_sha256:string,objdump_att_instruction_only_syntax:string>, "
    "assembly_validation struct<assembled:boolean,linked:boolean,behavioral_pass:boolean,tests_total:int,tests_passed:int,validated_full_assembly_sha256:string>, "
    "decompilation struct<ghidra:struct<code:string,sha256:string,producer:string,version:string,function_name:string,input_kind:string,input_binary_sha256:string>>, "
    "binary struct<path:string,sha256:string>"
)
LEVELS = ("O0", "O1", "O2", "O3")


def stored_dataset_rules(pseudocode: bool, files: bool) -> dict[str, Column]:
    """Row rules of stored samples (schema CHECKED): every text with its digest, the views' forms, and that all passed.

    ``pseudocode`` asks for a decompiler's view too. With ``files`` the column
    ``file_sha256`` has the digest of the stored binary, null where there is none.
    """
    text = lambda c, digest: (F.col(c) != "") & (F.sha2(c, 256) == F.col(digest))
    view, att, full = "assembly.objdump_intel_instruction_only", "assembly.objdump_att_instruction_only", "assembly.full_translation_unit_assembly"
    label = F.concat("function_name", F.lit(":\n"))
    v, p = "assembly_validation", "decompilation.ghidra"
    rules = {
        "source": text("source.code", "source.code_sha256"),
        "dependencies": F.sha2(F.coalesce("evaluation.dependencies", F.lit("")), 256) == F.col("evaluation.dependencies_sha256"),
        "wrapper": text("evaluation.executable_wrapper", "evaluation.executable_wrapper_sha256"),
        "io_pair_count": (F.json_array_length("evaluation.io_pairs") > 0) & (F.json_array_length("evaluation.io_pairs") == F.col("evaluation.io_pair_count")),
        "io_pairs": content_hash(F.col("evaluation.io_pairs")) == F.col("evaluation.io_pairs_sha256"),
        "evaluation_passed": (F.col("evaluation.method") == "ground_truth_c_source") & F.col("evaluation.passed"),
        "reference_assembly_unused": ~F.col("evaluation.uses_reference_assembly"),
        "compiler_flag": F.array_contains("evaluation.compiler_flags", F.concat(F.lit("-"), F.col("optimization"))),
        "full_assembly": text(full, f"{full}_sha256"),
        "target_assembly": text("assembly.gcc_target_assembly", "assembly.gcc_target_assembly_sha256"),
        "disassembly": text("assembly.objdump_intel_with_relocations", "assembly.objdump_intel_sha256"),
        "symbol_in_disassembly": F.col("assembly.objdump_intel_with_relocations").contains(F.concat(F.lit("<"), F.col("function_name"), F.lit(">:"))),
        "instruction_view": text(view, f"{view}_sha256"),
        "instruction_view_label": F.startswith(view, label),
        "instruction_view_addresses": ~F.col(view).rlike(r"(?m)^\s*[0-9a-fA-F]+:\s"),
        "instruction_view_relocations": ~F.col(view).contains("R_X86_64_"),
        "instruction_view_directives": ~F.col(view).rlike(r"(?m)^\s*\.(?:file|text|section|globl|type|size|cfi|ident)"),
        "instruction_view_syntax": F.col(f"{view}_syntax") == "Intel",
        "att_view": text(att, f"{att}_sha256"),
        "att_view_label": F.startswith(att, label),
        "att_view_addresses": ~F.col(att).rlike(r"(?m)^\s*[0-9a-fA-F]+:\s"),
        "att_view_syntax": F.col(f"{att}_syntax") == "AT&T",
        "assembly_passed": F.col(f"{v}.assembled") & F.col(f"{v}.linked") & F.col(f"{v}.behavioral_pass") & (F.col(f"{v}.tests_total") == F.col(f"{v}.tests_passed")) & (F.col(f"{v}.tests_total") == F.json_array_length("evaluation.io_pairs")),
        "validated_assembly": F.col(f"{v}.validated_full_assembly_sha256") == F.col(f"{full}_sha256"),
    }
    if pseudocode:
        rules |= {
            "pseudocode": text(f"{p}.code", f"{p}.sha256"),
            "pseudocode_producer": (F.col(f"{p}.producer") == "ghidra") & (F.col(f"{p}.version") != ""),
            "pseudocode_function": F.col(f"{p}.function_name") == F.col("function_name"),
            "pseudocode_input": F.col(f"{p}.input_kind") == "target-object",
            "pseudocode_input_hash": F.col(f"{p}.input_binary_sha256").rlike("^[0-9a-f]{64}$"),
        }
    return rules | ({"binary": F.col("file_sha256") == F.col("binary.sha256")} if files else {})


def view_counts(samples: DataFrame) -> DataFrame:
    """What the stored counts of a dataset's views must be: samples, instructions, merged relocations, made labels, pseudocode."""
    lines = lambda c, ok: F.coalesce(F.size(F.filter(F.split(c, "\r\n|\n|\r"), ok)), F.lit(0))
    view = "assembly.objdump_intel_instruction_only"
    return samples.agg(
        F.count("*").alias("samples"),
        F.coalesce(F.sum(lines(view, lambda x: x.startswith("    "))), F.lit(0)).alias("instructions"),
        F.coalesce(F.sum(lines("assembly.objdump_intel_with_relocations", lambda x: x.contains("R_X86_64_"))), F.lit(0)).alias("relocations_merged"),
        F.coalesce(F.sum(lines(view, lambda x: x.startswith(".L_"))), F.lit(0)).alias("internal_labels_generated"),
        F.count_if(F.col("decompilation.ghidra.code") != "").alias("samples_available"),
    )


def count_errors(samples: DataFrame, stored: dict[str, int]) -> list[str]:
    """Where the counts that a dataset's manifest has stored differ from those of its samples; a count that is not stored is an error."""
    got = view_counts(samples).first().asDict()
    return [f"{name}: {stored[name]} stored, {n} found" if name in stored else f"{name}: not stored, {n} found" for name, n in got.items() if stored.get(name) != n]


def stored_dataset_errors(samples: DataFrame, rows: int, groups: int, pseudocode: bool = False, files: bool = False, passed: DataFrame | None = None, stored: dict[str, int] | None = None) -> DataFrame:
    """(subject, error) of stored samples: rules of rows, of groups, exact counts, ``stored`` counts of views, unique names, and ``passed`` ids that differ."""
    out = row_errors(samples, ["sample_id"], stored_dataset_rules(pseudocode, files)).select(F.col("sample_id").alias("subject"), "error")
    out = out.unionByName(group_errors(samples, "source_group_id", "optimization", list(LEVELS), []).select(F.col("source_group_id").alias("subject"), "error"))
    for name in ("sample_id", "legacy_name"):
        twice = samples.groupBy(name).agg(F.count("*").alias("n")).where("n > 1")
        out = out.unionByName(twice.select(F.col(name).alias("subject"), F.lit(f"{name}_not_unique").alias("error")))
    counts = dataset_errors(samples, "source_group_id", "optimization", rows, groups, {x: rows // len(LEVELS) for x in LEVELS})
    counts += [] if stored is None else count_errors(samples, stored)
    if counts:
        out = out.unionByName(samples.sparkSession.createDataFrame([("dataset", c) for c in counts], "subject string, error string"))
    if passed is not None:
        ids = samples.select("sample_id").distinct()
        other = passed.select("sample_id").distinct()
        for a, b, name in ((ids, other, "not_passed_in_report"), (other, ids, "passed_but_not_stored")):
            out = out.unionByName(a.join(b, "sample_id", "left_anti").select(F.col("sample_id").alias("subject"), F.lit(name).alias("error")))
    return out


def prompt(template: str, fields: dict[str, Column]) -> Column:
    """A template with ``{name}`` placeholders filled in; an unknown placeholder is an error."""
    import string

    parts = []
    for text, name, _, _ in string.Formatter().parse(template):
        parts.append(F.lit(text))
        if name is not None:
            if name not in fields:
                raise ValueError(f"unknown placeholder {name!r}")
            parts.append(F.coalesce(fields[name].cast("string"), F.lit("")))
    return F.concat(*parts)


def resolution_path(status: Column, audit: Column, holdout: Column, probed: Column, ambiguity: Column) -> Column:
    """States that a sample went through, derived from its audit, holdout, active probes and ambiguity outcome."""
    lit = lambda *names: F.array(*(F.lit(n) for n in names))
    final = lambda ok, other: F.when(status.isin(*ok), status).otherwise(other)
    frozen = holdout == "accepted"
    ambiguous = F.when(ambiguity == "discriminated", F.when(frozen, lit("ambiguous", "probed", "frozen")).otherwise(lit("ambiguous", "probed", "retryable_rejected")))
    ambiguous = ambiguous.otherwise(F.array(F.lit("ambiguous"), F.when(status != "probed", status).otherwise("behavioral_equivalence_class")))
    accepted = F.when(frozen | holdout.isNull() | (holdout == ""), lit("frozen")).otherwise(F.array(F.lit("retryable_rejected"), final(["unverified", "budget_exhausted"], "unverified")))
    ending = final(["frozen", "unverified", "budget_exhausted"], "unverified")
    rejected = F.when(probed, F.array(F.lit("retryable_rejected"), F.lit("probed"), ending)).otherwise(F.array(F.lit("retryable_rejected"), ending))
    tail = F.when(audit == "ambiguous", ambiguous).when(audit == "accepted", accepted).when(audit == "rejected", rejected).otherwise(F.array(status))
    path = F.concat(lit("initial", "static_inferred", "capability_checked", "probed"), tail)
    return F.when(F.element_at(path, -1) == status, path).otherwise(F.array_append(path, status))


def stop_probing(budget_left: Column, risk_bound: Column, risk_limit: Column, rounds_without_news: Column) -> Column:
    """Why active probing stops, first reason first; null while it may go on. A null bound or limit is no risk."""
    return F.when(budget_left <= 0, "budget_exhausted").when(risk_bound > risk_limit, "risk_limit_exceeded").when(rounds_without_news >= 2, "no_new_information")


#: Fields that a proposal may not have at any depth, and the strategies of a probe intent.
FORBIDDEN_FIELDS = ("source", "source_truth", "official_signature", "wrapper", "hidden_test", "evaluator_output", "ground_truth")
STRATEGIES = ("effect_boundary", "boundary_pair", "stability_replay", "safe_neighborhood")


@F.pandas_udf(T.ArrayType(T.StringType()))
def forbidden_fields(proposal: pd.Series) -> pd.Series:
    """Sorted names of FORBIDDEN_FIELDS that JSON text has at any depth."""

    def found(text: str | None) -> list[str]:
        hit, todo = set(), [] if text is None else [json.loads(text)]
        while todo:
            value = todo.pop()
            if isinstance(value, dict):
                hit.update(k for k in value if k in FORBIDDEN_FIELDS)
                todo += value.values()
            elif isinstance(value, list):
                todo += value
        return sorted(hit)

    return proposal.map(found)


def proposal_errors(proposal: Column, known: Column, intent: bool = False) -> Column:
    """array<string>: what is wrong with a proposal given as JSON text, in order; empty if it can be used.

    ``known`` has the evidence ids that there are. A contract proposal must have
    ``proposed_contract``; a probe intent a known ``strategy`` and a ``rationale``.
    Both need evidence, all of it known, and a ``confidence`` from 0 to 1, 0 where it is missing.
    """
    field = lambda name: F.get_json_object(proposal, f"$.{name}")
    evidence = F.coalesce(F.from_json(field("evidence_ids"), "array<string>"), F.array().cast("array<string>"))
    unknown = F.array_sort(F.array_distinct(F.array_except(evidence, known)))
    confidence = F.coalesce(field("confidence").try_cast("double"), F.lit(0.0))
    own = (
        [F.when(~F.coalesce(field("strategy"), F.lit("")).isin(*STRATEGIES), "unknown_strategy"), F.when(F.coalesce(field("rationale"), F.lit("")) == "", "no_rationale")]
        if intent
        else [F.when(F.coalesce(field("proposed_contract"), F.lit("{}")).isin("{}", "null", "[]", ""), "no_proposed_contract")]
    )
    return F.concat(
        F.transform(forbidden_fields(proposal), lambda n: F.concat(F.lit("forbidden_field:"), n)),
        F.array_compact(F.array(*own, F.when(~confidence.between(0.0, 1.0), "confidence_out_of_range"), F.when(F.size(evidence) == 0, "no_evidence"))),
        F.transform(unknown, lambda n: F.concat(F.lit("unknown_evidence:"), n)),
    )


def proposal_ok(evidence: Column, known: Column, confidence: Column) -> Column:
    """Whether a proposal names known evidence only, at least one, and a confidence in [0, 1]."""
    return (F.size(evidence) > 0) & (F.size(F.array_except(evidence, known)) == 0) & confidence.between(0.0, 1.0)
