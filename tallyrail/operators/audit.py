"""Contract scores, threshold gaps, audit decisions, state machines, frozen manifests and differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyrail.functions.numbers import rate

#: Weights of a score's components, and the gate's thresholds.
WEIGHTS = {"valid": 0.30, "stable": 0.25, "effect": 0.20, "boundary": 0.15, "simple": 0.10}
THRESHOLDS = {"valid": 0.90, "stable": 1.0, "effect": 0.05, "boundary": 0.90}
MIN_SAFE, MARGIN = 4, 0.05


def score(observations: DataFrame, contract: str = "contract_id", safe: str = "expected_safe", group: str = "stability_group") -> DataFrame:
    """Scores per contract from rows (contract, expected_safe, stability_group, returned, observation, return_value, state_effect, boundary, complexity).

    Stability compares the observations of groups with two rows or more; diverse
    return values count as an effect of every returned row; without boundary
    probes the boundary score is the valid one. Empty denominators give 0.0.
    """
    rows = observations.where(safe)
    groups = rows.groupBy(contract, group).agg(F.count("*").alias("n"), F.count_distinct(F.sha2("observation", 256)).alias("kinds")).where("n >= 2")
    stable = groups.groupBy(contract).agg(rate(F.count_if(F.col("kinds") == 1), F.count("*")).alias("stable"))
    ok, edge = F.col("returned"), F.col("boundary")
    one = rows.groupBy(contract).agg(
        F.count("*").alias("safe_observations"),
        rate(F.count_if(ok), F.count("*")).alias("valid"),
        F.count_if(ok).alias("_returned"),
        F.count_if(ok & F.col("state_effect")).alias("_effects"),
        F.count_distinct(F.when(ok, F.col("return_value"))).alias("_values"),
        F.count_if(edge).alias("_edges"),
        F.count_if(edge & ok).alias("_edge_ok"),
    )
    every = observations.groupBy(contract).agg(F.count("*").alias("observations"), F.max("complexity").alias("complexity"))
    out = every.join(one, contract, "left").join(stable, contract, "left").na.fill(0, ["safe_observations"]).na.fill(0.0, ["valid", "stable"])
    effect = F.when(F.coalesce("_returned", F.lit(0)) == 0, 0.0).when(F.col("_values") > 1, 1.0).otherwise(F.col("_effects") / F.col("_returned"))
    boundary = F.when(F.coalesce("_edges", F.lit(0)) > 0, F.col("_edge_ok") / F.col("_edges")).otherwise(F.col("valid"))
    out = out.withColumns({"effect": effect, "boundary": boundary, "simple": 1.0 / (1.0 + F.col("complexity"))})
    total = sum((F.lit(w) * F.col(c) for c, w in WEIGHTS.items()), F.lit(0.0))
    return out.select(contract, "observations", "safe_observations", *WEIGHTS, total.alias("total"))


def gaps(min_safe: int = MIN_SAFE, thresholds=THRESHOLDS) -> dict[str, Column]:
    """How far each component is below its threshold."""
    return {"safe_observations": F.greatest(F.lit(0), F.lit(min_safe) - F.col("safe_observations")).cast("double"), **{c: F.greatest(F.lit(0.0), F.lit(t) - F.col(c)) for c, t in thresholds.items()}}


def audit(scores: DataFrame, sample: list[str], contract: str = "contract_id", margin: float = MARGIN, **options) -> DataFrame:
    """One decision per sample: accepted, ambiguous (another passing contract within the margin) or rejected."""
    gap = gaps(**options)
    failed = F.array_compact(F.array(*(F.when(g > 0, F.lit("insufficient_safe_observations" if c == "safe_observations" else f"{c}_below_threshold")) for c, g in gap.items())))
    rows = scores.withColumn("failures", failed)
    w = Window.partitionBy(*sample).orderBy(F.desc("_ok"), F.desc("total"), F.col(contract))
    rows = rows.withColumn("_ok", F.size("failures") == 0).withColumn("_rank", F.row_number().over(w)).withColumn("_best", F.first("total").over(w))
    near = F.col("_ok") & (F.col("_best") - F.col("total") < margin)
    out = rows.groupBy(*sample).agg(
        F.count_if("_ok").alias("passing"),
        F.count_if(near).alias("near"),
        F.min_by(contract, "_rank").alias("best"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("failures")))).alias("failures"),
    )
    decision = F.when(F.col("passing") == 0, "rejected").when(F.col("near") > 1, "ambiguous").otherwise("accepted")
    reasons = F.when(decision == "rejected", F.col("failures")).when(decision == "ambiguous", F.array(F.lit("score_margin_below_threshold"))).otherwise(F.array(F.lit("all_audit_thresholds_satisfied")))
    return out.select(*sample, decision.alias("decision"), F.when(decision == "accepted", F.col("best")).alias("selected"), F.when(decision == "ambiguous", F.col("near")).otherwise(0).alias("competitors"), reasons.alias("reasons"))


#: Legal moves of a harness's resolution, and its terminal states.
EDGES = {
    "initial": ("static_inferred", "failed"),
    "static_inferred": ("capability_checked", "failed"),
    "capability_checked": ("probed", "retryable_unsupported", "unverified", "failed"),
    "probed": ("frozen", "retryable_rejected", "ambiguous", "budget_exhausted", "unidentifiable_from_binary", "failed"),
    "retryable_rejected": ("capability_checked", "probed", "budget_exhausted", "unverified", "failed"),
    "retryable_unsupported": ("capability_checked", "unverified", "failed"),
    "ambiguous": ("probed", "behavioral_equivalence_class", "unidentifiable_from_binary", "budget_exhausted", "unverified", "failed"),
}
TERMINAL = ("frozen", "behavioral_equivalence_class", "unidentifiable_from_binary", "unverified", "budget_exhausted", "failed")
#: Moves that are legal here besides, since the stop and the ambiguity rules ask for them.
ADDED = {"probed": ("unverified", "behavioral_equivalence_class")}


def edge_table(spark, *tables: dict[str, tuple[str, ...]]) -> DataFrame:
    """Legal (source, target) pairs; those of EDGES and ADDED where no table is given."""
    pairs = [(s, t) for table in tables or (EDGES, ADDED) for s, ts in table.items() for t in ts]
    return spark.createDataFrame(pairs, "source string, target string")


def illegal_moves(moves: DataFrame, edges: DataFrame) -> DataFrame:
    """Moves that are in no edge."""
    return moves.join(F.broadcast(edges), ["source", "target"], "left_anti")


def difference_kinds(pairs: dict[str, tuple[Column, Column]]) -> Column:
    """Names of the aspects in which two observations differ, in order; nulls are equal."""
    return F.array_compact(F.array(*(F.when(~a.eqNullSafe(b), F.lit(k)) for k, (a, b) in pairs.items())))


def compare_observations(a: str, b: str, compare_return: Column, compare_globals: Column) -> Column:
    """Difference kinds of two observation structs; a signal's details count only where both ended by one."""
    x, y = F.col(a), F.col(b)
    same_status = x["status"].eqNullSafe(y["status"])
    fault = lambda o: F.struct(o["signal"], o["fault_address_class"], o["relative_offset"])
    kinds = [
        F.when(~same_status, "process_status"),
        F.when(same_status & (x["status"] == "signal") & ~fault(x).eqNullSafe(fault(y)), "signal"),
        F.when(compare_return & ~x["return_value"].eqNullSafe(y["return_value"]), "return"),
        F.when(~F.map_entries(x["objects"]).eqNullSafe(F.map_entries(y["objects"])), "memory"),
        F.when(compare_globals & ~F.map_entries(x["globals"]).eqNullSafe(F.map_entries(y["globals"])), "global"),
        F.when(~x["external_events"].eqNullSafe(y["external_events"]), "external_event"),
    ]
    return F.array_compact(F.array(*kinds))


def frozen_hash(core: Column) -> Column:
    """Content hash of a manifest's core, given as canonical text without the hash itself."""
    return F.sha2(core, 256)


def cross_checks(checks: dict[str, Column]) -> Column:
    """Names of the checks that do not hold, sorted; a null check does not hold."""
    return F.array_sort(F.array_compact(F.array(*(F.when(~F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in checks.items()))))


def replay(expected: DataFrame, actual: DataFrame, key: list[str], ignore: list[str]) -> DataFrame:
    """Per key whether a replay gave the frozen values; columns in ``ignore`` (timings) do not count."""
    cols = [c for c in expected.columns if c not in (*key, *ignore)]
    digest = lambda df, n: df.select(*key, F.sha2(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}), 256).alias(n))
    both = digest(expected, "_e").join(digest(actual, "_a"), key, "full")
    state = F.when(F.col("_e").isNull(), "unexpected").when(F.col("_a").isNull(), "missing").when(F.col("_e") == F.col("_a"), "match").otherwise("changed")
    return both.select(*key, state.alias("state"))
