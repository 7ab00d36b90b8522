"""Report queries: pass rates, grouping sets, histograms, intervals, denominators, transitions and costs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyrail.operators import metrics as m
from tallyrail.operators import records as r
from tallyrail.operators import sequences as s
from tallyrail.operators.selection import pending
from tallyrail.plans.catalog import query
from tallyrail.session import read_table


def labelled(spark, sf_dir):
    """Documents with their nullable quality label: the stand-in for results with evidence."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    return docs.join(read_table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic"), "doc_id", "left")


def round9(c, name):
    return F.round(c, 9).alias(name)


@query(
    "q01_pass_rate",
    """
    SELECT d.source, d.lang, count(*) AS total, count(l.quality) AS eligible,
           coalesce(sum(l.quality), 0)::BIGINT AS passed,
           CASE WHEN count(l.quality) = 0 THEN 0.0
                ELSE round(sum(l.quality)::DOUBLE / count(l.quality), 9) END AS rate
    FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY d.source, d.lang
    """,
)
def pass_rate(spark, sf_dir):
    """Total, eligible, passed and rate by source and language; no eligible row gives rate 0."""
    a = m.bool_aggregates("quality")
    return labelled(spark, sf_dir).groupBy("source", "lang").agg(F.count("*").alias("total"), a["eligible"].alias("eligible"), a["passed"].alias("passed"), round9(a["rate"], "rate"))


@query(
    "q02_grouping_sets",
    """
    SELECT CASE WHEN grouping(source) = 0 AND grouping(lang) = 0 THEN 'source+lang'
                WHEN grouping(source) = 0 THEN 'source' ELSE 'overall' END AS "grouping",
           source, lang, count(*) AS total, count(quality) AS eligible, coalesce(sum(quality), 0)::BIGINT AS passed,
           CASE WHEN count(quality) = 0 THEN 0.0 ELSE round(sum(quality)::DOUBLE / count(quality), 9) END AS rate
    FROM documents LEFT JOIN labels USING (doc_id) GROUP BY GROUPING SETS ((source, lang), (source), ())
    """,
)
def grouping_sets(spark, sf_dir):
    """The three groupings of the core report in one pass."""
    a = m.bool_aggregates("quality")
    aggs = [F.count("*").alias("total"), a["eligible"].alias("eligible"), a["passed"].alias("passed"), round9(a["rate"], "rate")]
    return m.grouping_sets(labelled(spark, sf_dir), [["source", "lang"], ["source"], []], aggs).select("grouping", "source", "lang", "total", "eligible", "passed", "rate")


@query(
    "q03_numeric_metric",
    """
    SELECT event_type, count(value) AS value_eligible, round(coalesce(sum(value), 0.0), 4) AS value_sum,
           round(coalesce(avg(value), 0.0), 6) AS value_mean, min(value) AS value_min, max(value) AS value_max
    FROM events GROUP BY event_type
    """,
)
def numeric_metric(spark, sf_dir):
    """Eligible, sum, mean, min and max of a numeric metric."""
    a = m.metadata_aggregates("value")
    return read_table(spark, sf_dir, "events").groupBy("event_type").agg(
        a["eligible"].alias("value_eligible"), F.round(a["sum"], 4).alias("value_sum"), F.round(a["mean"], 6).alias("value_mean"), a["min"].alias("value_min"), a["max"].alias("value_max")
    )


@query(
    "q04_reason_histogram",
    """
    SELECT user_id % 10 AS backend, coalesce(nullif(CASE WHEN event_type = 'view' THEN '' WHEN event_type = 'click' THEN NULL ELSE event_type END, ''), 'pass') AS reason,
           count(*) AS n FROM events GROUP BY 1, 2
    """,
)
def reason_histogram(spark, sf_dir):
    """Failure reasons by backend; null and the empty text are passes."""
    events = read_table(spark, sf_dir, "events").select((F.col("user_id") % 10).alias("backend"), "event_type")
    reason = F.when(F.col("event_type") == "view", "").when(F.col("event_type") == "click", F.lit(None)).otherwise(F.col("event_type"))
    return m.histogram(events, ["backend"], reason)


@query(
    "q18_wilson",
    """
    WITH t AS (SELECT event_type, count(*)::DOUBLE AS n, (count(*) FILTER (WHERE value > 50))::DOUBLE AS k FROM events GROUP BY 1),
    c AS (SELECT *, 1.959963984540054 AS z FROM t)
    SELECT event_type, k::BIGINT AS k, n::BIGINT AS n, round(k / n, 9) AS hit_rate,
      round(greatest(0, (k/n + z*z/(2*n) - z*sqrt(k/n*(1-k/n)/n + z*z/(4*n*n))) / (1 + z*z/n)), 9) AS hit_low,
      round(least(1, (k/n + z*z/(2*n) + z*sqrt(k/n*(1-k/n)/n + z*z/(4*n*n))) / (1 + z*z/n)), 9) AS hit_high FROM c
    """,
)
def wilson_interval(spark, sf_dir):
    """Rates with 95 % intervals."""
    t = read_table(spark, sf_dir, "events").groupBy("event_type").agg(F.count_if(F.col("value") > 50).alias("k"), F.count("*").alias("n"))
    t = t.select("event_type", "k", "n", *m.rate_with_interval(F.col("k"), F.col("n"), "hit"))
    return t.select("event_type", "k", "n", *(round9(c, c) for c in ("hit_rate", "hit_low", "hit_high")))


@query(
    "q19_fixed_vs_filtered",
    """
    SELECT source, count(*) AS total, count(quality) AS frozen, count(*) FILTER (WHERE quality = 1) AS passed,
           round((count(*) FILTER (WHERE quality = 1))::DOUBLE / count(*), 9) AS fixed_rate,
           CASE WHEN count(quality) > 0 THEN round((count(*) FILTER (WHERE quality = 1))::DOUBLE / count(quality), 9) END AS frozen_rate
    FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source
    """,
)
def fixed_vs_filtered(spark, sf_dir):
    """One numerator over all rows and over the rows that have evidence."""
    out = m.fixed_and_frozen(labelled(spark, sf_dir), ["source"], F.col("quality").isNotNull(), F.coalesce(F.col("quality") == 1, F.lit(False)))
    return out.select("source", "total", "frozen", "passed", round9(F.col("fixed_rate"), "fixed_rate"), round9(F.col("frozen_rate"), "frozen_rate"))


@query(
    "q20_slot_prf",
    """
    WITH a AS (SELECT user_id % 20 AS g, list(event_type ORDER BY ts, event_id) AS f FROM events GROUP BY 1),
    b AS (SELECT user_id % 20 AS g, list(event_type ORDER BY ts, event_id) AS t FROM events WHERE value > 20 GROUP BY 1),
    z AS (SELECT g, unnest(list_zip(f, t)) AS s FROM a JOIN b USING (g)),
    c AS (SELECT g, coalesce(s[1], 'missing') = 'purchase' AS f, coalesce(s[2], 'missing') = 'purchase' AS t FROM z),
    n AS (SELECT g, count(*) FILTER (WHERE f AND t) AS tp, count(*) FILTER (WHERE f AND NOT t) AS fp, count(*) FILTER (WHERE NOT f AND t) AS fn FROM c GROUP BY g)
    SELECT g, tp, fp, fn, round(CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) END, 9) AS "precision",
           round(CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) END, 9) AS recall,
           round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0 * tp / (2 * tp + fp + fn) END, 9) AS f1 FROM n
    """,
)
def slot_prf(spark, sf_dir):
    """Precision, recall and F1 over the slots of two sequences, the shorter one padded."""
    e = read_table(spark, sf_dir, "events").select((F.col("user_id") % 20).alias("g"), "event_type", "ts", "event_id", "value")
    some = e.where("value > 20")
    both = e.select("g").distinct().join(some.select("g").distinct(), "g")
    out = m.slot_scores_of_rows(e.join(F.broadcast(both), "g"), some.join(F.broadcast(both), "g"), ["g"], ["ts", "event_id"], "event_type", "purchase")
    return out.select("g", "tp", "fp", "fn", *(round9(F.col(c), c) for c in ("precision", "recall", "f1")))


@query(
    "q21_transitions",
    """
    WITH t AS (SELECT event_type AS source, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS target FROM events)
    SELECT source, target, count(*) AS n FROM t WHERE target IS NOT NULL GROUP BY 1, 2
    """,
)
def state_transitions(spark, sf_dir):
    """How often one state follows another."""
    return s.transitions(read_table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type"), ["user_id"], ["ts", "event_id"], "event_type")


@query(
    "q22_net_change",
    """
    WITH t AS (SELECT user_id, arg_min(value > 50, (ts, event_id)) AS b, arg_max(value > 50, (ts, event_id)) AS a FROM events WHERE value IS NOT NULL GROUP BY 1)
    SELECT CASE WHEN NOT b AND a THEN 'repaired' WHEN b AND NOT a THEN 'regressed' ELSE 'same' END AS change, count(*) AS n FROM t GROUP BY 1
    """,
)
def net_change(spark, sf_dir):
    """Repairs and regressions from first to last attempt."""
    e = read_table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value").where("value IS NOT NULL")
    return s.net_change(e, ["user_id"], ["ts", "event_id"], F.col("value") > 50).groupBy("change").agg(F.count("*").alias("n"))


@query(
    "q23_cost",
    """
    WITH u AS (SELECT user_id, count(*) AS calls, sum(value) AS tokens FROM events GROUP BY 1)
    SELECT count(*) AS samples, sum(calls)::BIGINT AS calls, round(sum(tokens), 2) AS tokens,
           round(sum(calls)::DOUBLE / count(*), 9) AS mean_calls, round(sum(tokens) / count(*), 6) AS mean_tokens FROM u
    """,
)
def cost(spark, sf_dir):
    """Totals of calls and tokens, and means per sample."""
    u = read_table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("calls"), F.sum("value").alias("tokens"))
    out = r.cost_report(u, [], ["calls", "tokens"])
    return out.select("samples", "calls", F.round("tokens", 2).alias("tokens"), round9(F.col("mean_calls"), "mean_calls"), F.round("mean_tokens", 6).alias("mean_tokens"))


@query(
    "q24_reconcile_union",
    """
    SELECT source, CASE WHEN l.doc_id IS NULL THEN 'unmatched' ELSE 'recorded' END AS status, count(*) AS n, count(l.quality) AS with_evidence
    FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1, 2
    """,
)
def reconcile_union(spark, sf_dir):
    """Recorded rows, and the expected ones that were never recorded, in one table."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source")
    labels = read_table(spark, sf_dir, "labels").select("doc_id", "quality")
    recorded = docs.join(labels, "doc_id").withColumn("status", F.lit("recorded"))
    missing = pending(docs, labels, ["doc_id"]).withColumn("status", F.lit("unmatched"))
    return recorded.unionByName(missing, allowMissingColumns=True).groupBy("source", "status").agg(F.count("*").alias("n"), F.count("quality").alias("with_evidence"))


@query(
    "q30_changed_ranges",
    """
    WITH t AS (SELECT user_id, event_id, event_type, ts, CASE WHEN lag(event_type) OVER w = event_type THEN 0 ELSE 1 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    r AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS run FROM t)
    SELECT user_id, run::BIGINT AS run, any_value(event_type) AS event_type, count(*) AS n, min(ts) AS "first", max(ts) AS "last" FROM r GROUP BY user_id, run
    """,
)
def event_islands(spark, sf_dir):
    """Maximal runs of one event type per user."""
    e = read_table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type")
    return s.islands(e, ["user_id"], ["ts", "event_id"], "event_type")
