"""Audit queries: scores, decisions, legal moves, differences and evidence."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyrail.operators import audit as a
from tallyrail.operators import sequences as s
from tallyrail.operators import validation
from tallyrail.plans.catalog import query
from tallyrail.plans.reports import state_transitions
from tallyrail.session import read_table


def order_observations(spark, sf_dir):
    """Orders as observations: a customer is a contract, a priority a stability group."""
    o = read_table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_custkey").alias("contract_id"),
        (F.col("o_orderkey") % 5 > 0).alias("expected_safe"),
        F.col("o_orderpriority").alias("stability_group"),
        (F.col("o_orderstatus") != "P").alias("returned"),
        F.col("o_orderstatus").alias("observation"),
        F.col("o_orderstatus").alias("return_value"),
        (F.col("o_totalprice") > 100000).alias("state_effect"),
        (F.col("o_orderkey") % 3 == 0).alias("boundary"),
        (F.col("o_custkey") % 4).cast("int").alias("complexity"),
    )


SCORE_SQL = """
    WITH o AS (SELECT o_custkey AS contract_id, o_orderkey % 5 > 0 AS safe, o_orderpriority AS grp, o_orderstatus <> 'P' AS ok, o_orderstatus AS obs,
                      o_totalprice > 100000 AS eff, o_orderkey % 3 = 0 AS edge, o_custkey % 4 AS complexity FROM orders),
    e AS (SELECT contract_id, count(*) AS observations, max(complexity) AS complexity FROM o GROUP BY 1),
    g AS (SELECT contract_id, grp, count(DISTINCT obs) AS kinds FROM o WHERE safe GROUP BY 1, 2 HAVING count(*) >= 2),
    st AS (SELECT contract_id, (count(*) FILTER (WHERE kinds = 1))::DOUBLE / count(*) AS stable FROM g GROUP BY 1),
    v AS (SELECT contract_id, count(*) AS n, (count(*) FILTER (WHERE ok))::DOUBLE / count(*) AS valid, count(*) FILTER (WHERE ok) AS r, count(*) FILTER (WHERE ok AND eff) AS f,
                 count(DISTINCT obs) FILTER (WHERE ok) AS vals, count(*) FILTER (WHERE edge) AS b, count(*) FILTER (WHERE edge AND ok) AS bo FROM o WHERE safe GROUP BY 1),
    s AS (SELECT contract_id, observations, coalesce(n, 0) AS safe_observations, coalesce(valid, 0) AS valid, coalesce(stable, 0) AS stable,
                 CASE WHEN coalesce(r, 0) = 0 THEN 0 WHEN vals > 1 THEN 1 ELSE f::DOUBLE / r END AS effect,
                 CASE WHEN coalesce(b, 0) > 0 THEN bo::DOUBLE / b ELSE coalesce(valid, 0) END AS boundary, 1.0::DOUBLE / (1 + complexity) AS simple
          FROM e LEFT JOIN v USING (contract_id) LEFT JOIN st USING (contract_id)),
    scored AS (SELECT *, 0.30::DOUBLE * valid + 0.25::DOUBLE * stable + 0.20::DOUBLE * effect + 0.15::DOUBLE * boundary + 0.10::DOUBLE * simple AS total FROM s)
"""


@query(
    "q25_score",
    SCORE_SQL
    + """SELECT contract_id, observations, safe_observations, round(valid, 9) AS valid, round(stable, 9) AS stable, round(effect, 9) AS effect,
         round(boundary, 9) AS boundary, round(simple, 9) AS simple, round(total, 8) AS total FROM scored""",
)
def score(spark, sf_dir):
    """Score components of contracts from their observations."""
    out = a.score(order_observations(spark, sf_dir))
    return out.select("contract_id", "observations", "safe_observations", *(F.round(c, 9).alias(c) for c in a.WEIGHTS), F.round("total", 8).alias("total"))


@query(
    "q26_audit",
    SCORE_SQL
    + """, p AS (SELECT contract_id % 50 AS sample, contract_id, round(total, 6) AS total,
             list_filter([CASE WHEN safe_observations < 2 THEN 'insufficient_safe_observations' END, CASE WHEN 0.5 - round(valid, 9) > 0 THEN 'valid_below_threshold' END,
               CASE WHEN 0.3 - round(stable, 9) > 0 THEN 'stable_below_threshold' END, CASE WHEN 0.05 - round(effect, 9) > 0 THEN 'effect_below_threshold' END,
               CASE WHEN 0.5 - round(boundary, 9) > 0 THEN 'boundary_below_threshold' END], lambda x: x IS NOT NULL) AS failures FROM scored),
    k AS (SELECT *, len(failures) = 0 AS ok, max(CASE WHEN len(failures) = 0 THEN total END) OVER (PARTITION BY sample) AS best FROM p),
    d AS (SELECT sample, count(*) FILTER (WHERE ok) AS passing, count(*) FILTER (WHERE ok AND best - total < 0.05) AS near,
                 first(contract_id ORDER BY ok DESC, total DESC, contract_id) AS top FROM k GROUP BY 1)
    SELECT sample, CASE WHEN passing = 0 THEN 'rejected' WHEN near > 1 THEN 'ambiguous' ELSE 'accepted' END AS decision,
           CASE WHEN passing > 0 AND near <= 1 THEN top::VARCHAR END AS selected, CASE WHEN passing > 0 AND near > 1 THEN near ELSE 0 END AS competitors FROM d""",
)
def audit(spark, sf_dir):
    """Accepted, ambiguous or rejected, by thresholds and the margin to the runner-up."""
    scores = a.score(order_observations(spark, sf_dir)).withColumn("sample", F.col("contract_id") % 50).withColumn("total", F.round("total", 6))
    scores = scores.withColumns({c: F.round(c, 9) for c in a.WEIGHTS})
    out = a.audit(scores, ["sample"], min_safe=2, thresholds={"valid": 0.5, "stable": 0.3, "effect": 0.05, "boundary": 0.5})
    return out.select("sample", "decision", F.col("selected").cast("string").alias("selected"), F.col("competitors").cast("long").alias("competitors"))


@query(
    "q27_edge_check",
    """
    WITH t AS (SELECT event_type AS source, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS target FROM events),
    n AS (SELECT source, target, count(*) AS n FROM t WHERE target IS NOT NULL GROUP BY 1, 2)
    SELECT source, target, n FROM n WHERE NOT (source IN ('view', 'click') AND target IN ('click', 'purchase'))
    """,
)
def edge_check(spark, sf_dir):
    """Observed moves that the edge table does not allow."""
    edges = a.edge_table(spark, {"view": ("click", "purchase"), "click": ("click", "purchase")})
    return a.illegal_moves(state_transitions(spark, sf_dir), edges)


@query(
    "q28_diff_kinds",
    """
    WITH l AS (SELECT l_orderkey, round(sum(l_extendedprice), 2) AS price, max(l_linestatus) AS status, count(*) AS n FROM lineitem GROUP BY 1)
    SELECT o_orderkey, array_to_string(list_filter([CASE WHEN o_orderstatus IS DISTINCT FROM status THEN 'status' END,
      CASE WHEN round(o_totalprice, 2) IS DISTINCT FROM price THEN 'price' END, CASE WHEN n IS DISTINCT FROM 4 THEN 'lines' END], lambda x: x IS NOT NULL), ',') AS kinds
    FROM orders LEFT JOIN l ON o_orderkey = l_orderkey
    """,
)
def diff_kinds(spark, sf_dir):
    """In which aspects two observations of an order differ."""
    lines = read_table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.round(F.sum("l_extendedprice"), 2).alias("price"), F.max("l_linestatus").alias("status"), F.count("*").alias("n"))
    both = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    kinds = a.difference_kinds({"status": (F.col("o_orderstatus"), F.col("status")), "price": (F.round("o_totalprice", 2), F.col("price")), "lines": (F.col("n"), F.lit(4))})
    return both.select("o_orderkey", F.array_join(kinds, ",").alias("kinds"))


@query(
    "q29_evidence_dedupe",
    """
    SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1
    """,
)
def evidence_dedupe(spark, sf_dir):
    """The first piece of evidence of each group and kind."""
    e = read_table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value", "ts")
    return s.first_of(e, ["user_id", "event_type"], ["ts", "event_id"]).drop("ts")


@query(
    "q38_merge_labels",
    """
    WITH t AS (SELECT user_id AS line, event_id AS chunk, list_sort(CASE WHEN value > 50 THEN [event_type] ELSE [event_type, 'low'] END) AS labels FROM events)
    SELECT line, array_to_string(list_sort(list_distinct(flatten(list(labels)))), ',') AS labels, count(DISTINCT labels) > 1 AS conflict FROM t GROUP BY line
    """,
)
def merge_labels(spark, sf_dir):
    """Union of the labels that overlapping chunks give a line, with the conflicts."""
    e = read_table(spark, sf_dir, "events").where("event_type IS NOT NULL")
    labels = F.when(F.col("value") > 50, F.array("event_type")).otherwise(F.array(F.col("event_type"), F.lit("low")))
    rows = e.select(F.col("user_id").alias("line"), F.col("event_id").alias("chunk"), labels.alias("labels"))
    out = s.merge_labels(rows, ["line"], "chunk", "labels", "union")
    return out.withColumn("labels", F.array_join("labels", ","))


@query(
    "q39_round_robin_budget",
    """
    WITH t AS (SELECT user_id, event_type AS slot, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS i FROM events),
    r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY i, slot) AS turn FROM t)
    SELECT user_id, slot, event_id, i, turn FROM r WHERE turn <= 4
    """,
)
def round_robin_budget(spark, sf_dir):
    """A probe budget that the slots of a group share by turns."""
    e = read_table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("slot"), "event_id")
    numbered = e.withColumn("i", F.row_number().over(Window.partitionBy("user_id", "slot").orderBy("event_id")))
    return s.round_robin_budget(numbered, ["user_id"], "slot", "i", 4)


@query(
    "q40_best_so_far",
    "SELECT user_id, arg_max(event_id, (value, -event_id)) AS event_id FROM events WHERE value IS NOT NULL GROUP BY user_id",
)
def best_so_far(spark, sf_dir):
    """The best attempt of each refinement, the earliest on a tie."""
    e = read_table(spark, sf_dir, "events").select("user_id", "event_id", "value").where("value IS NOT NULL").withColumn("at", F.col("event_id"))
    return s.best_so_far(e, ["user_id"], ["value"], "at", "event_id")


@query(
    "q41_stagnation",
    """
    WITH t AS (SELECT user_id, ts, event_id, event_type, CASE WHEN lag(event_type) OVER w = event_type THEN 0 ELSE 1 END AS st FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    r AS (SELECT *, sum(st) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM t)
    SELECT DISTINCT user_id FROM (SELECT user_id, run FROM r GROUP BY 1, 2 HAVING count(*) >= 3)
    """,
)
def stagnation(spark, sf_dir):
    """Users with three or more equal outcomes in a row."""
    e = read_table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type")
    return s.stagnant(e, ["user_id"], ["ts", "event_id"], "event_type", 3)


@query(
    "q42_row_errors",
    """
    SELECT o_orderkey, unnest(list_filter([CASE WHEN NOT coalesce(o_totalprice > 1000, false) THEN 'price' END, CASE WHEN NOT coalesce(o_orderstatus IN ('F', 'O'), false) THEN 'status' END], lambda x: x IS NOT NULL)) AS error FROM orders
    """,
)
def row_errors(spark, sf_dir):
    """Broken row constraints, one row each."""
    return validation.row_errors(read_table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus"), ["o_orderkey"], {"price": F.col("o_totalprice") > 1000, "status": F.col("o_orderstatus").isin("F", "O")})
