"""Contracts as structs: truth from signatures, validation, capability, matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyrail.functions.text import type_kind

MAX_OBJECT, MAX_OBJECTS, MAX_ARGUMENTS = 16 * 1024, 3, 3
#: Argument registers of the runner, relation kinds, sections that hold global objects.
SLOTS = ("RDI", "RSI", "RDX", "RCX", "R8", "R9")
RELATIONS = ("no_alias", "must_alias", "fixed_offset_alias", "length_within")
SECTIONS = (".data", ".bss", ".rodata", ".data.rel.local", "COMMON")


def _reasons(*rules: tuple[Column, str]) -> Column:
    return F.array_compact(F.array(*(F.when(c, F.lit(r)) for c, r in rules)))


def truth(signature: Column) -> Column:
    """struct<argument_kinds, return_kind, unsupported>: what a signature (return type first) asks of the runner; null without one."""
    arguments = F.transform(F.slice(signature, 2, F.greatest(F.size(signature) - 1, F.lit(0))), lambda t: type_kind(t))
    returned = type_kind(F.try_element_at(signature, F.lit(1)), is_return=True)
    unsupported = _reasons(
        (F.size(arguments) > MAX_ARGUMENTS, "more_than_three_arguments"),
        (F.size(F.filter(arguments, lambda k: k == "pointer")) > 1, "multiple_independent_pointer_objects"),
        (F.exists(arguments, lambda k: k.startswith("unsupported_")), "unsupported_argument_abi_class"),
        (returned.startswith("unsupported_"), "unsupported_return_abi_class"),
    )
    return F.when(F.size(signature) > 0, F.struct(arguments.alias("argument_kinds"), returned.alias("return_kind"), unsupported.alias("unsupported")))


def matches(candidate: Column, truth: Column) -> Column:
    """Whether a candidate's kinds are the truth's: the same arguments and return."""
    return candidate["argument_kinds"].eqNullSafe(truth["argument_kinds"]) & candidate["return_kind"].eqNullSafe(truth["return_kind"])


def hit_ranks(candidates: DataFrame, truths: DataFrame, sample: str, rank: str) -> DataFrame:
    """Per sample of ``truths``: the first rank whose kinds match, null if none does; top-1 and argument-only hits."""
    cols = F.struct("argument_kinds", "return_kind")
    both = truths.select(sample, cols.alias("t")).join(candidates.select(sample, rank, cols.alias("c")), sample, "left")
    hit = matches(F.col("c"), F.col("t"))
    return both.groupBy(sample).agg(
        F.min(F.when(hit, F.col(rank))).alias("hit_rank"),
        F.count("c").alias("candidates"),
        F.coalesce(F.bool_or(hit & (F.col(rank) == 0)), F.lit(False)).alias("top1"),
        F.coalesce(F.bool_or((F.col("c.argument_kinds") == F.col("t.argument_kinds")) & ~hit & (F.col(rank) == 0)), F.lit(False)).alias("return_only_error"),
    )


def violations(contract: Column) -> Column:
    """What is wrong with a contract of arguments (slot, register, object_ref, confidence), objects (object_id, argument_slot, min_size) and relations (kind, offset)."""
    slots = F.transform(contract["arguments"], lambda a: a["slot"])
    ids = F.transform(contract["objects"], lambda o: o["object_id"])
    refs = F.filter(F.transform(contract["arguments"], lambda a: a["object_ref"]), lambda r: r.isNotNull())
    return _reasons(
        (F.size(F.array_distinct(slots)) < F.size(slots), "duplicate_slot"),
        (~slots.eqNullSafe(F.array_sort(slots)), "slots_not_ascending"),
        (F.size(contract["objects"]) > MAX_OBJECTS, "too_many_objects"),
        (F.size(F.array_distinct(ids)) < F.size(ids), "duplicate_object"),
        (F.size(F.array_except(refs, ids)) > 0, "unknown_object_reference"),
        (F.exists(contract["objects"], lambda o: ~F.exists(contract["arguments"], lambda a: a["register"] == o["argument_slot"])), "object_without_register"),
        (F.exists(contract["relations"], lambda r: ~r["kind"].isin(*RELATIONS)), "unknown_relation"),
        (F.exists(contract["relations"], lambda r: (r["kind"] == "fixed_offset_alias") & (r["offset"] != 0)), "nonzero_alias_offset"),
        (F.exists(contract["arguments"], lambda a: ~a["confidence"].between(0.0, 1.0)), "confidence_out_of_range"),
    )


def capability(contract: Column, known: list[str], stubbed: list[str]) -> Column:
    """struct<status, reasons>: supported, supported_with_stub or unsupported, by slots, objects, relations and dependencies."""
    unknown = F.filter(contract["dependencies"], lambda d: ~d.isin(*known, *stubbed))
    rules = _reasons(
        (F.exists(contract["arguments"], lambda a: ~a["register"].isin(*SLOTS)), "unsupported_argument_slot"),
        (F.size(contract["objects"]) > MAX_OBJECTS, "object_count_exceeds_v2_limit"),
        (F.exists(contract["objects"], lambda o: o["min_size"] > MAX_OBJECT), "object_size_exceeds_limit"),
    )
    relations = F.transform(F.filter(contract["relations"], lambda r: ~r["kind"].isin(*RELATIONS)), lambda r: F.concat(F.lit("unsupported_relation:"), F.coalesce(r["kind"], F.lit("missing"))))
    outside = F.transform(unknown, lambda d: F.concat(F.lit("unsupported_unknown_external_dependency:"), d))
    reasons = F.array_sort(F.array_distinct(F.concat(rules, relations, outside)))
    stub = F.exists(contract["dependencies"], lambda d: d.isin(*stubbed)) if stubbed else F.lit(False)
    return F.struct(F.when(F.size(reasons) > 0, "unsupported").when(stub, "supported_with_stub").otherwise("supported").alias("status"), reasons.alias("reasons"))


def target_symbol(symbols: DataFrame, names: DataFrame, key: str) -> DataFrame:
    """The symbol of each key's target name: defined, functions before others, global before local, largest; the first on a tie."""
    found = symbols.join(names, [key, "name"]).where("section IS NOT NULL AND type IN ('FUNC', 'NOTYPE')")
    w = Window.partitionBy(key).orderBy(F.desc(F.col("type") == "FUNC"), F.desc(F.col("bind") == "GLOBAL"), F.desc("size"), "position")
    return found.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def global_objects(symbols: DataFrame, referenced: DataFrame, key: str) -> DataFrame:
    """Defined data objects that are visible outside or referenced, by section and name."""
    mark = referenced.select(key, "name").distinct().withColumn("_r", F.lit(True))
    rows = symbols.where(F.col("section").isin(*SECTIONS) & (F.col("type") == "OBJECT")).join(mark, [key, "name"], "left")
    return rows.where(F.col("bind").isin("GLOBAL", "WEAK") | F.col("_r")).drop("_r").orderBy(key, "section", "name")
