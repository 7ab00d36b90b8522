"""Evaluation protocols as data: evidence of candidates from the outcomes of their stages and cases, and the gate of a backend."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyrail.functions.keys import find_private

#: Stages of the JSON protocol in order, and the reasons of a stage that did not pass.
STAGES = ("candidate_compile", "fixture_prepare", "fixture_link")
STAGE_REASONS = {
    "candidate_compile": {"timeout": "compile_timeout", "error": "compile_error"},
    "fixture_prepare": {"error": "wrapper_rewrite_failed"},
    "fixture_link": {"timeout": "link_timeout", "error": "link_error"},
}
#: Outcomes of a test case, the reason that each gives, and the count that it belongs to.
CASE_OUTCOMES = {
    "timeout": ("test_timeout", "timed_out"),
    "runtime_error": ("runtime_error", "crashed"),
    "output_mismatch": ("output_mismatch", "mismatched"),
    "invalid_output": ("invalid_output", "mismatched"),
}
#: Fixed pattern: the declarations in a wrapper that the candidate's own take the place of.
WRAPPED = r'(?s)extern\s*"C"\s*\{\s.*?\s*\}'


def rewritten_wrapper(wrapper: Column, path: Column) -> Column:
    """struct<code, reason>: a wrapper that includes ``path`` instead of its first block of C declarations; without a block, a reason."""
    there = F.regexp_like(F.coalesce(wrapper, F.lit("")), F.lit(WRAPPED))
    block = F.concat(F.lit('extern "C"\n{\n#include "'), path, F.lit('"\n}'))
    first = F.regexp_instr(wrapper, F.lit(WRAPPED))
    after = first + F.length(F.regexp_substr(wrapper, F.lit(WRAPPED)))
    code = F.concat(F.substr(wrapper, F.lit(1), first - 1), block, F.substr(wrapper, after))
    return F.struct(F.when(there, code).alias("code"), F.when(~there, "wrapper_rewrite_failed").alias("reason"))


def json_evidence(candidates: DataFrame, stages: DataFrame, cases: DataFrame, key: list[str]) -> DataFrame:
    """Evidence of every candidate under the protocol of JSON inputs and outputs.

    ``stages`` has the key, ``name`` (STAGES) and ``outcome`` (passed, timeout,
    error); ``cases`` the key, ``index`` and ``outcome`` (pass or one of
    CASE_OUTCOMES). A stage that did not pass, or was not reached, ends it; then
    cases count for nothing. All cases must pass and there must be one. The reason
    is that of the first stage, or of the first case, that did not pass.
    """
    known = F.col("name").isin(*STAGES)
    held = stages.where(known).groupBy(*key).agg(*(F.max(F.when(F.col("name") == s, F.col("outcome"))).alias(f"_{s}") for s in STAGES))
    reasons = F.create_map(*(F.lit(x) for k, (reason, _) in CASE_OUTCOMES.items() for x in (k, reason)))
    counted = cases.groupBy(*key).agg(
        F.count("*").alias("_total"),
        F.count_if(F.col("outcome") == "pass").alias("_passed"),
        *(F.count_if(F.col("outcome").isin(*(k for k, (_, c) in CASE_OUTCOMES.items() if c == name))).alias(f"_{name}") for name in ("timed_out", "crashed", "mismatched")),
        F.min_by("outcome", F.when(F.col("outcome") != "pass", F.col("index"))).alias("_first"),
    )
    rows = candidates.join(held, key, "left").join(counted, key, "left")
    reached, stage_reason, passed = F.lit(True), F.lit(None).cast("string"), {}
    for s in STAGES:
        outcome = F.coalesce(f"_{s}", F.lit("error"))
        said = F.lit(None).cast("string")
        for name, reason in STAGE_REASONS[s].items():
            said = F.when(outcome == name, reason).otherwise(said)
        stage_reason = F.coalesce(stage_reason, F.when(reached & (outcome != "passed"), F.coalesce(said, F.lit(STAGE_REASONS[s]["error"]))))
        reached = reached & (outcome == "passed")
        passed[s] = reached
    total, good = F.coalesce("_total", F.lit(0)), F.coalesce("_passed", F.lit(0))
    behaves = reached & (total > 0) & (good == total)
    case_reason = F.when(total == 0, "no_tests").when(good < total, F.try_element_at(reasons, F.col("_first")))
    count = lambda c: F.when(reached, c).otherwise(0)
    return rows.select(
        *candidates.columns, passed["candidate_compile"].alias("compile_pass"), passed["fixture_link"].alias("link_pass"), behaves.alias("behavioral_pass"), F.coalesce(stage_reason, case_reason).alias("reason"),
        count(total).alias("tests_total"), count(good).alias("tests_passed"), *(count(F.coalesce(f"_{c}", F.lit(0))).alias(c) for c in ("timed_out", "crashed", "mismatched")),
    )


def exit_code_evidence(compiled: Column, timed_out: Column, exit_code: Column) -> Column:
    """struct<compile_pass, behavioral_pass, reason>: evidence of a program whose exit code is the verdict; null codes are no run."""
    ran = compiled & ~F.coalesce(timed_out, F.lit(False))
    good = F.coalesce(ran & (exit_code == 0), F.lit(False))
    reason = F.when(~compiled, "compile_error").when(F.coalesce(timed_out, F.lit(False)), "test_timeout").when(exit_code.isNull(), "runtime_error").when(exit_code != 0, "test_failed")
    return F.struct(compiled.alias("compile_pass"), good.alias("behavioral_pass"), reason.alias("reason"))


def object_evidence(outcome: Column) -> Column:
    """struct<compile_pass, link_pass, behavioral_pass, reason, capabilities>: evidence of a protocol that only compiles a shared object.

    ``outcome`` is passed, timeout or error. Nothing is linked or run, so that link
    and behaviour are null and the capabilities leave the core metrics that need them out.
    """
    none = F.lit(None).cast("boolean")
    reason = F.when(outcome == "timeout", "compile_timeout").when(~F.coalesce(outcome == "passed", F.lit(False)), "compile_error")
    return F.struct(reason.isNull().alias("compile_pass"), none.alias("link_pass"), none.alias("behavioral_pass"), reason.alias("reason"), F.array(F.lit("candidate_compile")).alias("capabilities"))


def gate(requests: DataFrame, strict: bool = True) -> DataFrame:
    """Requests with ``reason``, why a backend must not take one (null where it may), and ``detail``.

    A request has ``binary`` (a struct with path), ``pseudocode`` and ``assembly``
    (structs with text), and must not have ``oracle_context`` or ``compile_context``;
    with ``strict`` its ``metadata``, JSON text, must not have private fields.
    """
    blank = lambda c: F.coalesce(F.trim(F.col(c)) == "", F.lit(True))
    private = F.array_sort(find_private("metadata")) if strict else F.array().cast("array<string>")
    rows = requests.withColumn("_private", private)
    leaks = F.size("_private") > 0
    rules = (
        (F.col("binary").isNull(), "missing_binary", F.lit("the binary is a required input")),
        (blank("pseudocode.text"), "missing_pseudocode", F.lit("the pseudocode is a required input")),
        (blank("assembly.text"), "missing_assembly", F.lit("the assembly is a required input")),
        (F.col("oracle_context").isNotNull(), "private_oracle_exposed", F.lit("the oracle's context is not for a backend")),
        (F.col("compile_context").isNotNull(), "private_compile_context_exposed", F.lit("the compile context is not for a backend")),
        (leaks, "private_metadata_exposed", F.concat(F.lit("private metadata: "), F.array_join("_private", ", "))),
    )
    reason = F.coalesce(*(F.when(rule, F.lit(code)) for rule, code, _ in rules))
    detail = F.coalesce(*(F.when(rule, text) for rule, _, text in rules))
    return rows.withColumns({"reason": reason, "detail": detail}).drop("_private")


def audited_request() -> Column:
    """What is kept of a public request: who asks for what, the views, and the names of the metadata, not their values."""
    keys = F.coalesce(F.array_sort(F.json_object_keys("metadata")), F.array().cast("array<string>"))
    return F.struct(
        "dataset_id", "sample_id", "source_group_id", "function_name", "optimization", F.col("binary.path").alias("binary"), F.col("assembly.view").alias("assembly_view"),
        F.col("pseudocode.view").alias("pseudocode_view"), keys.alias("metadata_keys"),
    )


def failure_metadata(reason: Column, detail: Column, prefix: str = "") -> Column:
    """The metadata of a request that was refused or failed: its reason twice, as reason and as the cause to stop, and no work done."""
    code = F.concat(F.lit(prefix), reason)
    zeros = (F.lit(0).alias(n) for n in ("executions", "generated_tests", "counterexamples", "repair_iterations"))
    return F.struct(F.lit(1).alias("schema_version"), code.alias("unsupported_reason"), detail.alias("error"), *zeros, code.alias("stop_reason"))


def backend_version(name: Column, implementation: Column, contract: Column) -> Column:
    """A backend's version: its name and the first twelve digits of the digests of its implementation and its contract."""
    return F.concat(name, F.lit(":impl-"), F.left(implementation, F.lit(12)), F.lit(":contract-"), F.left(F.sha2(contract, 256), F.lit(12)))


def gated_levels(levels: list[tuple[str, Column, Column]], shown: int = 2) -> Column:
    """struct<passed, failed_level, feedback, score>: levels of a check in order, each asked only if those before it hold.

    A level is (name, failures, total): an array of what failed at it, null if it was
    not asked, and how many things it looked at. Feedback has the first ``shown``
    failures of the first level that has some; the score is the part of all levels'
    shares that holds, each level counting alike.
    """
    reached, failed, feedback, score = F.lit(True), F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(0.0)
    for name, failures, total in levels:
        bad = F.size(F.coalesce(failures, F.array(F.lit(f"{name} was not checked"))))
        asked = reached
        held = F.coalesce(F.try_divide(F.greatest(total - bad, F.lit(0)).cast("double"), total.cast("double")), F.when(bad == 0, 1.0).otherwise(0.0))
        score = score + F.when(asked, held).otherwise(0.0)
        here = asked & (bad > 0)
        more = F.when(bad > shown, F.concat(F.lit(" and "), (bad - shown).cast("string"), F.lit(" more"))).otherwise("")
        said = F.concat(F.lit(f"{name}: "), F.array_join(F.slice(F.coalesce(failures, F.array(F.lit("not checked"))), 1, shown), "; "), more)
        failed, feedback = F.coalesce(failed, F.when(here, name)), F.coalesce(feedback, F.when(here, said))
        reached = asked & (bad == 0)
    return F.struct(reached.alias("passed"), failed.alias("failed_level"), feedback.alias("feedback"), (score / len(levels)).alias("score"))
