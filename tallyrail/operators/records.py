"""Records of runs: import, assembly from parts, nested denominators, totals, provenance, plans and holdouts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyrail.functions.numbers import rate, seed64


def import_records(records: DataFrame, backends: DataFrame, artifacts: DataFrame, samples: DataFrame, cached: DataFrame, key: list[str], backend: str = "backend_id") -> DataFrame:
    """A run's records with what an import makes of each: ``status``, ``reason`` and ``with_evaluation``.

    ``artifacts`` has the key and ``candidate`` (null where there is none) and
    ``evaluated``; ``cached`` the key and the candidate that the cache holds. A
    record without its backend's settings or artifacts is skipped, and so is one
    whose cached candidate differs, which is kept; evidence comes along where the
    sample is known.
    """
    known = backends.select(backend).distinct().withColumn("_backend", F.lit(True))
    parts = artifacts.select(*key, F.col("candidate").alias("_candidate"), F.col("evaluated").alias("_evaluated"))
    held = cached.select(*key, F.col("candidate").alias("_held"), F.lit(True).alias("_cached"))
    own = samples.distinct().withColumn("_sample", F.lit(True))
    rows = records.join(known, backend, "left").join(parts, key, "left").join(held, key, "left").join(own, samples.columns, "left")
    missing = F.col("_backend").isNull() | F.col("_candidate").isNull()
    conflict = F.col("_cached").isNotNull() & ~F.col("_held").eqNullSafe(F.col("_candidate"))
    reason = F.when(missing, "backend_config_or_artifact_missing").when(conflict, "cache_conflict_preserved_existing")
    out = rows.withColumn("reason", reason).withColumn("status", F.when(F.col("reason").isNull(), "imported").otherwise("skipped"))
    evaluated = F.col("reason").isNull() & F.coalesce("_sample", F.lit(False)) & F.coalesce("_evaluated", F.lit(False))
    return out.withColumn("with_evaluation", evaluated).drop("_backend", "_candidate", "_evaluated", "_held", "_cached", "_sample")


def assemble(public: DataFrame, parts: dict[str, DataFrame], key: list[str]) -> DataFrame:
    """``public`` with a struct column per part, null where the part has no row of the key; a part has a row per key."""
    out = public
    for name, part in parts.items():
        columns = [c for c in part.columns if c not in key]
        out = out.join(part.select(*key, F.struct(*columns).alias(name)), key, "left")
    return out


def failure_stage(stages: dict[str, Column]) -> Column:
    """The first stage, in order, whose condition does not hold; ``none`` if all do."""
    return F.coalesce(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in stages.items()), F.lit("none"))


def contract_summary(records: DataFrame, dimensions: list[str] = ()) -> DataFrame:
    """Counts and rates over nested denominators: all records, those with truth, supported ones, identifiable ones.

    ``records`` has the booleans truth, supported, identifiable, top1, topk,
    leading, arguments (of the leading contract), accepted and frozen, and the
    numbers chance, valid_rate and executions. Rates are null for an empty
    denominator; null chances and valid rates do not count.
    """
    yes = lambda *names: F.count_if(F.coalesce(_all(names), F.lit(False)))
    inner = ("truth", "supported", "identifiable")
    supported, identifiable, accepted = yes("truth", "supported"), yes(*inner), yes("accepted")
    at = lambda c, *names: F.avg(F.when(_all(names), F.col(c)))
    columns = {
        "total": F.count("*"),
        "truth_available": yes("truth"),
        "supported": supported,
        "identifiable": identifiable,
        "accepted_rate": rate(accepted, F.count("*"), None),
        "source_top1_rate": rate(yes("truth", "supported", "top1"), supported, None),
        "source_topk_rate": rate(yes("truth", "supported", "topk"), supported, None),
        "top1_hits": yes(*inner, "top1"),
        "top1_rate": rate(yes(*inner, "top1"), identifiable, None),
        "topk_hits": yes(*inner, "topk"),
        "topk_rate": rate(yes(*inner, "topk"), identifiable, None),
        "leading_hits": yes(*inner, "leading"),
        "leading_rate": rate(yes(*inner, "leading"), identifiable, None),
        "argument_hits": yes(*inner, "arguments"),
        "return_only_mismatches": F.count_if(F.coalesce(_all((*inner, "arguments")) & ~F.coalesce("leading", F.lit(False)), F.lit(False))),
        "chance_rate": at("chance", *inner),
        "valid_rate_mean": at("valid_rate", "accepted"),
        "frozen_verified": yes("accepted", "frozen"),
        "frozen_rate": rate(yes("accepted", "frozen"), accepted, None),
        "executions": F.coalesce(F.sum("executions"), F.lit(0)),
    }
    return records.groupBy(*dimensions).agg(*(c.alias(n) for n, c in columns.items()))


def _all(names) -> Column:
    out = F.lit(True)
    for n in names:
        out = out & F.col(n)
    return out


def generation_totals(rows: DataFrame, dimensions: list[str], success: Column, cached: Column) -> DataFrame:
    """Expected, generated anew, taken from the cache, and failed generations."""
    ok = F.coalesce(success, F.lit(False))
    return rows.groupBy(*dimensions).agg(F.count("*").alias("expected"), F.count_if(ok & ~cached).alias("generated"), F.count_if(ok & cached).alias("cached"), F.count_if(~ok).alias("failed"))


def preflight_totals(rows: DataFrame, dimensions: list[str], valid: Column) -> DataFrame:
    """Total, valid and invalid samples."""
    ok = F.coalesce(valid, F.lit(False))
    return rows.groupBy(*dimensions).agg(F.count("*").alias("total"), F.count_if(ok).alias("valid"), F.count_if(~ok).alias("invalid"))


def instruction_totals(rows: DataFrame, level: str, counts: list[str]) -> DataFrame:
    """Sums of the counts by level and over all levels (level ``all``)."""
    sums = [F.sum(c).alias(c) for c in counts]
    per_level = rows.groupBy(F.coalesce(F.col(level).cast("string"), F.lit("unknown")).alias("level")).agg(*sums)
    return per_level.unionByName(per_level.agg(*sums).withColumn("level", F.lit("all")))


def provenance(entries: DataFrame, dataset: str, path: str, content_hash: str) -> DataFrame:
    """Per dataset the manifest that selected it (path, hash) and how many of its entries are the dataset's."""
    return entries.groupBy(dataset).agg(F.lit(path).alias("path"), F.lit(content_hash).alias("content_hash"), F.count("*").alias("entries"))


def single_request(samples: DataFrame, level: str, index: int, order: list[str]) -> DataFrame:
    """The sample at ``index`` (from 0) among those of one level, in order; no row beyond the end."""
    return samples.where(F.col("optimization") == level).orderBy(*order).offset(index).limit(1)


def concat_plans(probes: DataFrame, order: list[str], most: int, within: list[str]) -> DataFrame:
    """The first ``most`` probes of the plans of each group, one plan after the other; a single plan stays whole.

    The rank within a plan bounds what a group sorts: no plan gives more than ``most``.
    """
    plans = probes.select(*within, order[0]).distinct().groupBy(*within).agg(F.count("*").alias("_plans"))
    first = Window.partitionBy(*within, order[0]).orderBy(*order[1:])
    rows = probes.withColumn("_in_plan", F.row_number().over(first)).join(plans, within).where((F.col("_in_plan") <= most) | (F.col("_plans") == 1))
    place = F.row_number().over(Window.partitionBy(*within).orderBy(*order))
    return rows.withColumn("position", place).where((F.col("position") <= most) | (F.col("_plans") == 1)).drop("_in_plan", "_plans")


def discriminate(observations: DataFrame, sample: list[str], contract: str, probe: str, signature: str) -> DataFrame:
    """Per sample whether its contracts can be told apart: contracts, probes, and probes on which they differ.

    ``behavioral_equivalence_class`` if no probe that all contracts have shows a
    difference; its representative is the smallest contract.
    """
    contracts = observations.select(*sample, contract).distinct().groupBy(*sample).agg(F.count("*").alias("contracts"), F.min(contract).alias("representative"))
    per_probe = observations.groupBy(*sample, probe).agg(F.count_distinct(contract).alias("_c"), F.count_distinct(signature).alias("_s"))
    rows = per_probe.join(contracts, sample).where(F.col("_c") == F.col("contracts"))
    counted = rows.groupBy(*sample).agg(F.count("*").alias("shared_probes"), F.count_if(F.col("_s") > 1).alias("differing_probes"))
    out = contracts.join(counted, sample, "left").na.fill(0, ["shared_probes", "differing_probes"])
    verdict = F.when(F.col("contracts") < 2, "single_contract").when(F.col("differing_probes") > 0, "distinguishable").when(F.col("shared_probes") == 0, "no_shared_probe").otherwise("behavioral_equivalence_class")
    return out.withColumn("verdict", verdict).withColumn("representative", F.when(verdict == "behavioral_equivalence_class", F.col("representative")))


def holdout(content_hash: Column, seed: Column, domain: str = "holdout-v1") -> Column:
    """struct<seed, commitment>: a holdout's own seed, and the digest that commits to it before anything is run.

    ``domain`` keeps its seeds apart from those of other purposes; records of another system need that system's.
    """
    own = seed64(F.concat(F.lit(f"{domain}:"), content_hash, F.lit(":"), seed.cast("string")))
    return F.struct(own.alias("seed"), F.sha2(F.concat_ws(":", content_hash, own.cast("string")), 256).alias("commitment"))


def probe_strategy(reasons: Column) -> Column:
    """How the next probes are chosen, by the audit's reasons (their last part after a colon)."""
    short = F.transform(reasons, lambda r: F.element_at(F.split(r, ":"), -1))
    has = lambda name: F.array_contains(short, F.lit(name))
    return F.when(has("effect_below_threshold"), "effect_boundary").when(has("boundary_below_threshold"), "boundary_pair").when(has("stable_below_threshold"), "stability_replay").otherwise("safe_neighborhood")


def merged_objects(objects: Column, relations: Column) -> Column:
    """struct<objects, errors>: objects (object_id, min_size, alignment) with those merged that relations make one.

    ``must_alias`` and a fixed offset of zero make two objects one, of the larger
    size and alignment, named by the first of the group; another fixed offset is
    an error, and so is ``no_alias`` within a group. A contract has three objects
    at most, so that two passes over the relations settle the groups.
    """
    zero = lambda r: (r["kind"] == "must_alias") | ((r["kind"] == "fixed_offset_alias") & (r["offset"] == 0))
    joined = F.filter(relations, zero)
    place = lambda name: F.array_position(F.transform(objects, lambda o: o["object_id"]), name).cast("int")
    pairs = F.transform(joined, lambda r: F.struct(place(r["left"]).alias("a"), place(r["right"]).alias("b")))
    start = F.transform(objects, lambda o, i: (i + 1).cast("int"))

    def step(groups: Column, p: Column) -> Column:
        a, b = F.element_at(groups, p["a"]), F.element_at(groups, p["b"])
        return F.transform(groups, lambda g: F.when(g == F.greatest(a, b), F.least(a, b)).otherwise(g))

    groups = F.aggregate(pairs, start, step)
    named = F.zip_with(objects, groups, lambda o, g: F.struct(o["object_id"].alias("object_id"), g.alias("g"), o["min_size"].alias("min_size"), o["alignment"].alias("alignment")))
    heads = F.filter(named, lambda o: F.array_position(groups, o["g"]) == place(o["object_id"]))
    members = lambda g: F.filter(named, lambda o: o["g"] == g)
    merged = F.transform(heads, lambda h: F.struct(h["object_id"].alias("object_id"), F.array_max(F.transform(members(h["g"]), lambda o: o["min_size"])).alias("min_size"), F.array_max(F.transform(members(h["g"]), lambda o: o["alignment"])).alias("alignment")))
    group_of = lambda name: F.element_at(groups, place(name))
    offset = F.exists(relations, lambda r: (r["kind"] == "fixed_offset_alias") & (r["offset"] != 0))
    conflict = F.exists(relations, lambda r: (r["kind"] == "no_alias") & (group_of(r["left"]) == group_of(r["right"])))
    errors = F.array_compact(F.array(F.when(F.size(objects) > 3, F.lit("more_than_three_objects")), F.when(offset, F.lit("nonzero_fixed_offset_alias")), F.when(conflict, F.lit("no_alias_conflict"))))
    return F.struct(merged.alias("objects"), errors.alias("errors"))


def normalized_observation(status: Column, return_kind: Column, rax: Column, pointer: Column, offset: Column) -> Column:
    """struct<valid, kind, value, object, reason>: a return value that can be compared, or why it cannot.

    ``return_kind`` is null where the contract's return is not observable.
    """
    seen = (status == "returned") & return_kind.isNotNull()
    inside = pointer.isNotNull() & (pointer != "")
    points = return_kind == "pointer"
    valid = F.coalesce(seen & (~points | inside), F.lit(False))
    return F.struct(
        valid.alias("valid"),
        F.when(~F.coalesce(seen, F.lit(False)), F.lit(None).cast("string")).when(points & inside, "object_pointer").when(points, "not_comparable").otherwise("integer").alias("kind"),
        F.when(valid, F.when(points, F.coalesce(offset, F.lit(0))).otherwise(F.coalesce(rax, F.lit(0)))).cast("long").alias("value"),
        F.when(valid & points, pointer).alias("object"),
        F.when(~F.coalesce(seen, F.lit(False)), "void_or_unknown").when(points & ~inside, "pointer_outside_known_object").alias("reason"),
    )


def equivalence_classes(found: DataFrame, observations: DataFrame, sample: list[str], contract: str) -> DataFrame:
    """Records of the samples whose contracts no probe can tell apart: status, the contract that stands for them, all alternatives.

    ``found`` is what ``discriminate`` gives. A sample has few contracts, and its
    alternatives are one sorted list.
    """
    same = found.where(F.col("verdict") == "behavioral_equivalence_class").select(*sample, F.col("representative").alias("behavioral_contract"), F.col("shared_probes").alias("safe_probe_count"))
    others = observations.select(*sample, contract).distinct().groupBy(*sample).agg(F.array_sort(F.collect_list(contract)).alias("source_level_alternatives"))
    out = same.join(others, sample)
    return out.withColumns({"status": F.lit("unidentifiable_from_binary"), "distinguishing_probe_found": F.lit(False), "reason": F.lit("all alternatives show the same machine behaviour")})


def audited_holdouts(explored: DataFrame, held_out: DataFrame, commitments: DataFrame, sample: list[str]) -> DataFrame:
    """Whether a sample's holdout bears out what exploration accepted: ``holdout`` and ``reason``.

    ``explored`` and ``held_out`` are audits (decision, selected); ``commitments``
    has ``committed``, the digest written before the holdout ran, and ``replayed``,
    that of what ran. Only an accepted exploration has a holdout; it is accepted if
    the digests are equal and the same audit accepts the same contract.
    """
    now = held_out.select(*sample, F.col("decision").alias("_d"), F.col("selected").alias("_s"))
    rows = explored.where("decision = 'accepted'").select(*sample, "selected").join(now, sample, "left").join(commitments, sample, "left")
    reason = (
        F.when(F.col("committed").isNull(), "holdout_not_committed")
        .when(~F.col("committed").eqNullSafe(F.col("replayed")), "holdout_changed_after_commitment")
        .when(F.col("_d").isNull(), "holdout_not_run")
        .when(F.col("_d") != "accepted", F.concat(F.lit("holdout_"), F.col("_d")))
        .when(~F.col("_s").eqNullSafe(F.col("selected")), "holdout_selected_another_contract")
    )
    return rows.withColumn("reason", reason).select(*sample, "selected", F.when(F.col("reason").isNull(), "accepted").otherwise("rejected").alias("holdout"), "reason")


def assembled_from_json(artifacts: DataFrame, schemas: dict[str, str], key: list[str]) -> DataFrame:
    """A record per key from its artifacts (key, ``name``, ``text``): a struct per name of ``schemas``, null where it is missing.

    Texts are JSON under the name's schema; one that is not becomes null too and is
    named in ``broken``. Of several artifacts of one name the last in order of their text counts.
    """
    bad = "_corrupt_record"
    parts = [F.max(F.when(F.col("name") == name, F.col("text"))).alias(f"_{name}") for name in schemas]
    rows = artifacts.groupBy(*key).agg(*parts)
    for name, schema in schemas.items():
        rows = rows.withColumn(name, F.from_json(f"_{name}", f"{schema}, {bad} string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": bad}))
    broken = F.array_compact(F.array(*(F.when(F.col(f"{name}.{bad}").isNotNull(), F.lit(name)) for name in schemas)))
    whole = [F.when(F.col(name).isNotNull() & F.col(f"{name}.{bad}").isNull(), F.col(name).dropFields(bad)).alias(name) for name in schemas]
    return rows.select(*key, *whole, broken.alias("broken"))


def cost_report(rows: DataFrame, dimensions: list[str], numbers: list[str]) -> DataFrame:
    """Samples, and per number its total and its mean per sample (0.0 without samples); missing numbers count as 0."""
    out = [F.count("*").alias("samples")]
    for c in numbers:
        v = F.coalesce(F.col(c), F.lit(0))
        out += [F.coalesce(F.sum(v), F.lit(0)).alias(c), rate(F.sum(v), F.count("*")).alias(f"mean_{c}")]
    return rows.groupBy(*dimensions).agg(*out)


def static_evidence(contract: Column) -> Column:
    """Sorted distinct evidence ids of a contract, its return, its arguments and its objects."""
    nested = lambda c: F.flatten(F.transform(F.coalesce(contract[c], F.array()), lambda x: F.coalesce(x["evidence_ids"], F.array().cast("array<string>"))))
    own = lambda ids: F.coalesce(ids, F.array().cast("array<string>"))
    return F.array_sort(F.array_distinct(F.concat(own(contract["evidence_ids"]), own(contract["return_spec"]["evidence_ids"]), nested("arguments"), nested("objects"))))


def after_images(things: Column) -> Column:
    """A map from each object's or global's name to the bytes that it ended with; a missing map is empty."""
    return F.transform_values(F.coalesce(things, F.create_map().cast("map<string,struct<after_bytes_hex:string>>")), lambda _, t: t["after_bytes_hex"])


def behaviour_rows(samples: DataFrame, report: DataFrame, key: str) -> DataFrame:
    """A row of full shape per sample: what the report says of it, or a failure ``not_reported``.

    ``report`` has the key, assembled, linked, behavioral_pass, tests_total,
    tests_passed and reason; reported samples that are not in ``samples`` come too, ``unexpected``.
    """
    theirs = report.select(key, F.struct("assembled", "linked", "behavioral_pass", "tests_total", "tests_passed", "reason").alias("_r"))
    rows = samples.withColumn("_s", F.lit(True)).join(theirs, key, "full")
    state = F.when(F.col("_s").isNull(), "unexpected").when(F.col("_r").isNull(), "not_reported").otherwise("reported")
    flag = lambda c: F.coalesce(F.col(f"_r.{c}"), F.lit(False)).alias(c)
    count = lambda c: F.coalesce(F.col(f"_r.{c}"), F.lit(0)).alias(c)
    reason = F.when(state == "reported", F.col("_r.reason")).otherwise(state)
    return rows.select(*samples.columns, state.alias("state"), flag("assembled"), flag("linked"), flag("behavioral_pass"), count("tests_total"), count("tests_passed"), reason.alias("reason"))


def behaviour_report(rows: DataFrame, level: str, group: str) -> DataFrame:
    """Per level, and over all (``all``): samples, how many assemble, link and pass, tests, groups, and groups of which every sample passes."""
    counts = [F.count("*").alias("samples"), *(F.count_if(c).alias(c) for c in ("assembled", "linked", "behavioral_pass")), *(F.sum(c).alias(c) for c in ("tests_total", "tests_passed"))]
    per = rows.select(F.col(level).alias("level"), group, "assembled", "linked", "behavioral_pass", "tests_total", "tests_passed").withColumn("level", F.explode(F.array("level", F.lit("all"))))
    whole = per.groupBy("level", group).agg(F.bool_and("behavioral_pass").alias("_all")).groupBy("level").agg(F.count("*").alias("groups"), F.count_if("_all").alias("passing_groups"))
    return per.groupBy("level").agg(*counts).join(whole, "level")
