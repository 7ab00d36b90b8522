"""Repairs of candidates: diagnostics matched to declarations, and the first repairer that does not abstain."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyrail.functions.text import public_declaration, undeclared

#: Lines of a bin: a declaration's lines are held in bins, so that a file's lines meet by bin and not all with all.
BIN = 64
ANSWER = "struct<revised_source:string,rationale_codes:array<string>,evidence_ids:array<string>,changed_regions:array<string>,abstain:boolean>"
#: Legal states of a repair after each state.
MOVES = {
    "initial": ("compile", "unsupported"),
    "compile": ("link", "repair", "failed"),
    "link": ("differential", "repair", "failed"),
    "differential": ("minimize", "full_regression", "repair", "failed"),
    "minimize": ("repair", "failed"),
    "repair": ("compile", "budget_exhausted", "failed"),
    "full_regression": ("accepted", "repair", "failed"),
}


def declared_at(diagnostics: DataFrame, declarations: DataFrame, key: list[str]) -> DataFrame:
    """Diagnostics (key, file, line) with the innermost declaration (key, file, first_line, last_line) that holds their line, if any.

    Declarations go into bins of BIN lines, and a diagnostic meets those of its
    line's bin only. Innermost is the shortest, then the one that starts last.
    """
    place = [*key, "file", "line"]
    bins = F.sequence(F.floor(F.col("first_line") / BIN), F.floor(F.greatest("first_line", "last_line") / BIN))
    held = declarations.withColumn("_bin", F.explode(bins))
    lines = diagnostics.select(*place).distinct().withColumn("_bin", F.floor(F.col("line") / BIN))
    others = [c for c in declarations.columns if c not in (*key, "file")]
    best = F.min_by(F.struct(*others), F.struct(F.col("last_line") - F.col("first_line"), -F.col("first_line")))
    near = lines.join(held, [*key, "file", "_bin"]).where(F.col("line").between(F.col("first_line"), F.col("last_line"))).groupBy(*place).agg(best.alias("_d"))
    return diagnostics.join(near, place, "left").select(*diagnostics.columns, *(F.col(f"_d.{c}").alias(c) for c in others))


def abstained(reason: str) -> Column:
    """A repairer's answer (ANSWER) that changes nothing, and why."""
    none = F.array().cast("array<string>")
    return F.struct(F.lit("").alias("revised_source"), F.array(F.lit(reason)).alias("rationale_codes"), none.alias("evidence_ids"), none.alias("changed_regions"), F.lit(True).alias("abstain")).cast(ANSWER)


def declaring(source: Column, diagnostics: Column, facts: Column) -> Column:
    """The answer of the repairer that puts published declarations before a source.

    ``facts`` is array<struct<name, public_c_declaration>>, a name's last entry
    counting. It takes those that a compiler calls undeclared, whose declaration is
    one external declaration of the name and not in the source yet; without one it abstains.
    """
    declaration = lambda n: F.element_at(F.filter(facts, lambda f: f["name"] == n), F.lit(-1))["public_c_declaration"]
    named = F.filter(undeclared(diagnostics), lambda n: F.exists(facts, lambda f: f["name"] == n))
    lines = F.filter(F.transform(named, lambda n: public_declaration(declaration(n), n)), lambda d: d.isNotNull() & ~F.contains(source, d))
    evidence = F.transform(lines, lambda d: F.concat(F.lit("compile:undefined_global:"), F.regexp_extract(d, r"(\S+);$", 1)))
    done = F.struct(
        F.concat(F.array_join(lines, "\n"), F.lit("\n"), F.regexp_replace(source, r"\A\s+", "")).alias("revised_source"), F.array(F.lit("declare_binary_global_object")).alias("rationale_codes"),
        evidence.alias("evidence_ids"), F.array(F.lit("public_declarations")).alias("changed_regions"), F.lit(False).alias("abstain"),
    )
    return F.when(F.size(lines) > 0, done.cast(ANSWER)).otherwise(abstained("insufficient_public_evidence"))


def problems(answer: Column) -> Column:
    """array<string>: what is wrong with an answer: edits of one that abstains, or a repair without text, reasons, evidence or regions."""
    some = lambda c: F.size(F.coalesce(answer[c], F.array())) > 0
    text, gives_up = F.coalesce(answer["revised_source"], F.lit("")), F.coalesce(answer["abstain"], F.lit(False))
    return F.array_compact(F.array(
        F.when(answer["abstain"].isNull(), "abstain_missing"),
        F.when(gives_up & ((text != "") | some("changed_regions")), "edits_of_one_that_abstains"),
        F.when(~gives_up & (F.trim(text) == ""), "no_source"),
        *(F.when(~gives_up & ~some(c), f"no_{c}") for c in ("rationale_codes", "evidence_ids", "changed_regions")),
    ))


def first_answer(*answers: Column) -> Column:
    """struct<repairer, answer>: the first answer that does not abstain and its number from 0, or the last one."""
    numbered = [F.struct(F.lit(i).alias("repairer"), a.alias("answer")) for i, a in enumerate(answers)]
    return reduce(lambda later, now: F.when(~now["answer"]["abstain"], now).otherwise(later), reversed(numbered[:-1]), numbered[-1])


def fresh(answers: DataFrame, tried: DataFrame, key: list[str]) -> DataFrame:
    """Answers (key, ``answer``) with ``revision``, the digest of the revised source, and ``state``.

    ``state`` is abstained, invalid, duplicate where ``tried`` (key, revision) or an
    answer of the same key with a smaller ``repairer`` has that digest, or new.
    """
    rows = answers.withColumn("revision", F.when(~F.col("answer.abstain"), F.sha2("answer.revised_source", 256)))
    firsts = rows.where("revision IS NOT NULL").groupBy(*key, "revision").agg(F.min("repairer").alias("_first"))
    old = tried.select(*key, "revision").distinct().withColumn("_old", F.lit(True))
    out = rows.join(firsts, [*key, "revision"], "left").join(old, [*key, "revision"], "left")
    state = F.when(F.size(problems(F.col("answer"))) > 0, "invalid").when(F.col("answer.abstain"), "abstained").when(F.coalesce("_old", F.lit(False)) | (F.col("repairer") > F.col("_first")), "duplicate").otherwise("new")
    return out.withColumn("state", state).drop("_first", "_old")
