"""Queries over records of runs: imports, assembly, nested denominators, totals, plans, holdouts and object merges."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyrail.functions import keys as k
from tallyrail.functions import numbers as n
from tallyrail.functions import text as t
from tallyrail.operators import audit as a
from tallyrail.operators import records as r
from tallyrail.operators import selection as sel
from tallyrail.operators import sequences
from tallyrail.plans.catalog import query
from tallyrail.plans.reports import round9
from tallyrail.session import read_table


@query(
    "q43_import_run",
    """
    WITH s AS (SELECT d.doc_id, CASE WHEN d.lang = 'fr' OR l.doc_id IS NULL THEN 'backend_config_or_artifact_missing'
        WHEN d.doc_id % 5 = 0 AND d.doc_id % 10 = 0 AND l.quality IS NOT NULL THEN 'cache_conflict_preserved_existing' END AS reason,
        coalesce(l.toxic = 1, false) AND d.doc_id % 2 = 0 AS evaluated FROM documents d LEFT JOIN labels l USING (doc_id))
    SELECT CASE WHEN reason IS NULL THEN 'imported' ELSE 'skipped' END AS status, reason, count(*) AS n,
           count(*) FILTER (WHERE reason IS NULL AND evaluated) AS with_evaluation FROM s GROUP BY 1, 2
    """,
)
def import_run(spark, sf_dir):
    """What an import makes of a run's records, by reason."""
    docs, labels = read_table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("backend_id")), read_table(spark, sf_dir, "labels")
    artifacts = labels.select("doc_id", F.concat(F.lit("code "), F.coalesce(F.col("quality").cast("string"), F.lit("-"))).alias("candidate"), F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("evaluated"))
    cached = artifacts.where("doc_id % 5 = 0").select("doc_id", F.when((F.col("doc_id") % 10 == 0) & (F.col("candidate") != "code -"), "other").otherwise(F.col("candidate")).alias("candidate"))
    out = r.import_records(docs, docs.select("backend_id").where("backend_id <> 'fr'"), artifacts, docs.where("doc_id % 2 = 0").select("doc_id"), cached, ["doc_id"])
    return out.groupBy("status", "reason").agg(F.count("*").alias("n"), F.count_if("with_evaluation").alias("with_evaluation"))


@query(
    "q44_record_assembly",
    """
    WITH p AS (SELECT c_custkey, c_nationkey, c_mktsegment FROM customer), o AS (SELECT o_custkey AS c_custkey, count(*) AS orders, max(o_orderdate) AS latest FROM orders GROUP BY 1),
    u AS (SELECT user_id AS c_custkey, count(*) AS events FROM events GROUP BY 1)
    SELECT c_custkey, c_mktsegment, n_name AS nation, o.orders, o.latest, u.events,
      CASE WHEN o.orders IS NULL THEN 'orders' WHEN u.events IS NULL THEN 'events' WHEN u.events < 5 THEN 'evidence' ELSE 'none' END AS failure_stage
    FROM p LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN o USING (c_custkey) LEFT JOIN u USING (c_custkey)
    """,
)
def record_assembly(spark, sf_dir):
    """Records with a struct per part, null where a part is missing, and the first stage that failed."""
    public = read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    nation = read_table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    orders = read_table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("orders"), F.max("o_orderdate").alias("latest"))
    events = read_table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("c_custkey")).agg(F.count("*").alias("events"))
    out = r.assemble(r.assemble(public, {"nation": nation}, ["c_nationkey"]), {"scores": orders, "taint": events}, ["c_custkey"])
    stage = r.failure_stage({"orders": F.col("scores").isNotNull(), "events": F.col("taint").isNotNull(), "evidence": F.col("taint.events") >= 5})
    return out.select("c_custkey", "c_mktsegment", F.col("nation.n_name").alias("nation"), "scores.orders", "scores.latest", "taint.events", stage.alias("failure_stage"))


@query(
    "q45_nested_denominators",
    """
    WITH x AS (SELECT source, l.doc_id IS NOT NULL AS truth, l.quality = 1 AS supported, l.toxic = 0 AS identifiable, d.doc_id % 3 = 0 AS top1, d.doc_id % 3 < 2 AS topk,
      d.doc_id % 4 = 0 AS leads, d.doc_id % 4 < 2 AS arguments, d.doc_id % 5 = 0 AS accepted, d.doc_id % 10 = 0 AS frozen, CASE WHEN d.doc_id % 7 > 0 THEN (d.doc_id % 7) / 8.0 END AS chance,
      CASE WHEN d.doc_id % 6 > 0 THEN (d.doc_id % 6) / 8.0 END AS valid_rate, d.doc_id % 9 AS executions FROM documents d LEFT JOIN labels l USING (doc_id)),
    n AS (SELECT source, count(*) AS total, count(*) FILTER (WHERE truth) AS truth_available, count(*) FILTER (WHERE truth AND supported) AS supported,
      count(*) FILTER (WHERE truth AND supported AND identifiable) AS identifiable, count(*) FILTER (WHERE accepted) AS acc, count(*) FILTER (WHERE truth AND supported AND top1) AS s1,
      count(*) FILTER (WHERE truth AND supported AND topk) AS sk, count(*) FILTER (WHERE truth AND supported AND identifiable AND top1) AS top1_hits,
      count(*) FILTER (WHERE truth AND supported AND identifiable AND topk) AS topk_hits, count(*) FILTER (WHERE truth AND supported AND identifiable AND leads) AS leading_hits,
      count(*) FILTER (WHERE truth AND supported AND identifiable AND arguments) AS argument_hits, count(*) FILTER (WHERE truth AND supported AND identifiable AND arguments AND NOT leads) AS return_only_mismatches,
      avg(chance::DOUBLE) FILTER (WHERE truth AND supported AND identifiable) AS chance_rate, avg(valid_rate::DOUBLE) FILTER (WHERE accepted) AS valid_rate_mean,
      count(*) FILTER (WHERE accepted AND frozen) AS frozen_verified, sum(executions)::BIGINT AS executions FROM x GROUP BY source)
    SELECT source, total, truth_available, supported, identifiable, round(acc / total::DOUBLE, 9) AS accepted_rate, round(s1 / nullif(supported, 0)::DOUBLE, 9) AS source_top1_rate,
      round(sk / nullif(supported, 0)::DOUBLE, 9) AS source_topk_rate, top1_hits, round(top1_hits / nullif(identifiable, 0)::DOUBLE, 9) AS top1_rate, topk_hits, round(topk_hits / nullif(identifiable, 0)::DOUBLE, 9) AS topk_rate,
      leading_hits, round(leading_hits / nullif(identifiable, 0)::DOUBLE, 9) AS leading_rate, argument_hits, return_only_mismatches, round(chance_rate, 9) AS chance_rate, round(valid_rate_mean, 9) AS valid_rate_mean,
      frozen_verified, round(frozen_verified / nullif(acc, 0)::DOUBLE, 9) AS frozen_rate, executions FROM n
    """,
)
def nested_denominators(spark, sf_dir):
    """Hits over all records with truth, over supported ones, and over identifiable ones."""
    labels = read_table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic", F.lit(True).alias("known"))
    d, i = read_table(spark, sf_dir, "documents").select("doc_id", "source").join(labels, "doc_id", "left"), F.col("doc_id")
    rows = d.select(
        "source", F.coalesce("known", F.lit(False)).alias("truth"), (F.col("quality") == 1).alias("supported"), (F.col("toxic") == 0).alias("identifiable"),
        (i % 3 == 0).alias("top1"), (i % 3 < 2).alias("topk"), (i % 4 == 0).alias("leading"), (i % 4 < 2).alias("arguments"), (i % 5 == 0).alias("accepted"), (i % 10 == 0).alias("frozen"),
        F.when(i % 7 > 0, (i % 7) / 8.0).alias("chance"), F.when(i % 6 > 0, (i % 6) / 8.0).alias("valid_rate"), (i % 9).alias("executions"),
    )
    out = r.contract_summary(rows, ["source"])
    return out.select(*(round9(F.col(c), c) if kind == "double" else F.col(c) for c, kind in out.dtypes))


@query(
    "q46_reference_key",
    "SELECT doc_id, sha256('reference' || chr(10) || sha256(text) || chr(10) || source || chr(10) || 'local' || chr(10) || lang || chr(10) || '') AS reference_key FROM documents",
)
def reference_key(spark, sf_dir):
    """Keys of the fourth cache layer: what a reference evaluation depends on."""
    d = read_table(spark, sf_dir, "documents")
    return d.select("doc_id", k.reference_key(F.sha2("text", 256), F.col("source"), F.lit("local"), F.col("lang"), F.lit(None).cast("string")).alias("reference_key"))


@query(
    "q47_discrimination",
    """
    WITH o AS (SELECT o_custkey % 200 AS sample, o_orderstatus AS contract, o_orderpriority AS probe, max(CASE WHEN o_totalprice > 150000 THEN 'h' ELSE 'l' END) AS sig FROM orders GROUP BY 1, 2, 3),
    c AS (SELECT sample, count(DISTINCT contract) AS contracts, min(contract) AS lead FROM o GROUP BY 1),
    p AS (SELECT sample, probe, count(DISTINCT contract) AS c, count(DISTINCT sig) AS s FROM o GROUP BY 1, 2),
    q AS (SELECT c.sample, c.contracts, c.lead, count(p.probe) FILTER (WHERE p.c = c.contracts) AS shared_probes, count(p.probe) FILTER (WHERE p.c = c.contracts AND p.s > 1) AS differing_probes
          FROM c LEFT JOIN p USING (sample) GROUP BY ALL),
    v AS (SELECT *, CASE WHEN contracts < 2 THEN 'single_contract' WHEN differing_probes > 0 THEN 'distinguishable' WHEN shared_probes = 0 THEN 'no_shared_probe' ELSE 'behavioral_equivalence_class' END AS verdict FROM q)
    SELECT sample, contracts, shared_probes, differing_probes, verdict, CASE WHEN verdict = 'behavioral_equivalence_class' THEN lead END AS representative FROM v
    """,
)
def discrimination(spark, sf_dir):
    """Whether the contracts of a sample can be told apart by the probes they share."""
    o = read_table(spark, sf_dir, "orders")
    rows = o.groupBy((F.col("o_custkey") % 200).alias("sample"), F.col("o_orderstatus").alias("contract"), F.col("o_orderpriority").alias("probe")).agg(F.max(F.when(F.col("o_totalprice") > 150000, "h").otherwise("l")).alias("sig"))
    return r.discriminate(rows, ["sample"], "contract", "probe", "sig").select("sample", "contracts", "shared_probes", "differing_probes", "verdict", "representative")


@query(
    "q48_plan_cut",
    """
    WITH p AS (SELECT l_suppkey, l_returnflag, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_returnflag, l_orderkey, l_linenumber) AS position,
      count(DISTINCT l_returnflag) OVER (PARTITION BY l_suppkey) AS plans FROM lineitem)
    SELECT l_suppkey, l_returnflag, l_orderkey, l_linenumber, position FROM p WHERE position <= 12 OR plans = 1
    """.replace("count(DISTINCT l_returnflag) OVER (PARTITION BY l_suppkey)", "max(dense) OVER (PARTITION BY l_suppkey)").replace("FROM lineitem)", "FROM (SELECT *, dense_rank() OVER (PARTITION BY l_suppkey ORDER BY l_returnflag) AS dense FROM lineitem))"),
)
def plan_cut(spark, sf_dir):
    """The probes of each group's plans, one plan after the other, cut at twelve."""
    rows = read_table(spark, sf_dir, "lineitem").select("l_suppkey", "l_returnflag", "l_orderkey", "l_linenumber")
    return r.concat_plans(rows, ["l_returnflag", "l_orderkey", "l_linenumber"], 12, ["l_suppkey"])


@query(
    "q49_holdout",
    """
    WITH h AS (SELECT doc_id, sha256(text) AS h FROM documents), s AS (SELECT *, sha256('holdout-v1:' || h || ':' || doc_id) AS m FROM h),
    b AS (SELECT *, ('0x' || substr(m, 1, 16))::UBIGINT AS seed FROM s)
    SELECT doc_id, seed::VARCHAR AS seed, sha256(h || ':' || seed) AS commitment FROM b
    """,
)
def holdout(spark, sf_dir):
    """Seeds of holdouts and the digests that commit to them."""
    d = read_table(spark, sf_dir, "documents")
    got = r.holdout(F.sha2("text", 256), F.col("doc_id"))
    return d.select("doc_id", got["seed"].cast("string").alias("seed"), got["commitment"].alias("commitment"))


@query(
    "q50_legal_moves",
    """
    WITH legal(source, target) AS (VALUES ('initial', 'static_inferred'), ('initial', 'failed'), ('static_inferred', 'capability_checked'), ('static_inferred', 'failed'), ('capability_checked', 'probed'),
    ('capability_checked', 'retryable_unsupported'), ('capability_checked', 'unverified'), ('capability_checked', 'failed'), ('probed', 'frozen'), ('probed', 'retryable_rejected'), ('probed', 'ambiguous'),
    ('probed', 'budget_exhausted'), ('probed', 'unidentifiable_from_binary'), ('probed', 'failed'), ('retryable_rejected', 'capability_checked'), ('retryable_rejected', 'probed'), ('retryable_rejected', 'budget_exhausted'),
    ('retryable_rejected', 'unverified'), ('retryable_rejected', 'failed'), ('retryable_unsupported', 'capability_checked'), ('retryable_unsupported', 'unverified'), ('retryable_unsupported', 'failed'), ('ambiguous', 'probed'),
    ('ambiguous', 'behavioral_equivalence_class'), ('ambiguous', 'unidentifiable_from_binary'), ('ambiguous', 'budget_exhausted'), ('ambiguous', 'unverified'), ('ambiguous', 'failed')),
    s AS (SELECT user_id, event_id, ['initial', 'static_inferred', 'capability_checked', 'probed', 'retryable_rejected', 'retryable_unsupported', 'ambiguous', 'frozen', 'failed', 'unverified'][1 + (event_id * 7 + floor(value)::INT) % 10] AS state FROM events),
    m AS (SELECT state AS source, lead(state) OVER (PARTITION BY user_id ORDER BY event_id) AS target FROM s)
    SELECT m.source, m.target, any_value(legal.source) IS NOT NULL AS legal, count(*) AS n FROM m LEFT JOIN legal ON m.source = legal.source AND m.target = legal.target WHERE m.target IS NOT NULL GROUP BY 1, 2
    """,
)
def legal_moves(spark, sf_dir):
    """The moves between the states that users' events stand for, and whether the table of legal moves has them."""
    states = F.array(*(F.lit(x) for x in ("initial", "static_inferred", "capability_checked", "probed", "retryable_rejected", "retryable_unsupported", "ambiguous", "frozen", "failed", "unverified")))
    state = F.element_at(states, (1 + (F.col("event_id") * 7 + F.floor("value")) % 10).cast("int"))
    rows = read_table(spark, sf_dir, "events").select("user_id", "event_id", state.alias("state"))
    moves = sequences.transitions(rows, ["user_id"], ["event_id"], "state")
    illegal = a.illegal_moves(moves, a.edge_table(spark, a.EDGES)).select("source", "target", F.lit(False).alias("_ok"))
    return moves.join(illegal, ["source", "target"], "left").select("source", "target", F.coalesce("_ok", F.lit(True)).alias("legal"), "n")


@query(
    "q51_totals",
    """
    WITH x AS (SELECT lang, CASE WHEN l.quality = 1 THEN true ELSE false END AS ok, d.doc_id % 3 = 0 AS hit FROM documents d LEFT JOIN labels l USING (doc_id))
    SELECT lang, count(*) AS expected, count(*) FILTER (WHERE ok AND NOT hit) AS generated, count(*) FILTER (WHERE ok AND hit) AS cached, count(*) FILTER (WHERE NOT ok) AS failed, count(*) FILTER (WHERE ok) AS valid, count(*) FILTER (WHERE NOT ok) AS invalid FROM x GROUP BY lang
    """,
)
def totals(spark, sf_dir):
    """Generation and preflight totals by language."""
    d = read_table(spark, sf_dir, "documents").select("doc_id", "lang").join(read_table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    ok = F.col("quality") == 1
    return r.generation_totals(d, ["lang"], ok, F.col("doc_id") % 3 == 0).join(r.preflight_totals(d, ["lang"], ok).drop("total"), "lang")


@query(
    "q52_instruction_totals",
    """
    SELECT coalesce(l_returnflag, 'all') AS level, sum(l_linenumber)::BIGINT AS instructions, count(*) AS relocations FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), ())
    """,
)
def instruction_totals(spark, sf_dir):
    """Sums by level and over all."""
    rows = read_table(spark, sf_dir, "lineitem").select("l_returnflag", F.col("l_linenumber").cast("long").alias("instructions"), F.lit(1).cast("long").alias("relocations"))
    return r.instruction_totals(rows, "l_returnflag", ["instructions", "relocations"])


@query(
    "q53_changed_bytes",
    """
    WITH p AS (SELECT c_custkey, hex(c_name) AS x, hex(lag(c_name) OVER (ORDER BY c_custkey)) AS y FROM customer), s AS (SELECT c_custkey, x, y FROM p WHERE length(x) = length(y)),
    b AS (SELECT c_custkey, unnest(range(0, (length(x) // 2)::BIGINT)) AS i, x, y FROM s), d AS (SELECT c_custkey, i FROM b WHERE substr(x, (2 * i + 1)::INTEGER, 2) <> substr(y, (2 * i + 1)::INTEGER, 2)),
    g AS (SELECT c_custkey, i, i - row_number() OVER (PARTITION BY c_custkey ORDER BY i) AS run FROM d)
    SELECT c_custkey, min(i)::BIGINT AS "start", max(i)::BIGINT + 1 AS "end" FROM g GROUP BY c_custkey, run
    """,
)
def changed_bytes(spark, sf_dir):
    """Runs of bytes in which a name differs from that of the customer before."""
    c = read_table(spark, sf_dir, "customer").select("c_custkey", F.lower(F.hex("c_name")).alias("x"))
    both = c.join(c.select((F.col("c_custkey") + 1).alias("c_custkey"), F.col("x").alias("y")), "c_custkey").where(F.length("x") == F.length("y"))
    rows = both.select("c_custkey", F.inline(n.changed_ranges(F.col("y"), F.col("x"))))
    return rows.select("c_custkey", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))


@query(
    "q54_target_assembly",
    """
    SELECT doc_id, sha256('.globl f1' || chr(10) || 'f1:' || chr(10) || '  ' || replace(text, chr(10), chr(10) || '  ') || chr(10) || '.size f1, .-f1' || chr(10)) AS code_hash FROM documents WHERE text IS NOT NULL
    """,
)
def target_assembly(spark, sf_dir):
    """A function's part of a listing with others before and after it."""
    d = read_table(spark, sf_dir, "documents").where("text IS NOT NULL")
    body = F.concat(F.lit("  "), F.replace("text", F.lit("\n"), F.lit("\n  ")), F.lit("\n"))
    made = F.concat(F.lit(".globl f1\n.globl f12\nf12:\n"), body, F.lit(".size f12, 1\nf1:\n"), body, F.lit(".size f1, .-f1\nf2:\n"), body)
    return d.select("doc_id", F.sha2(t.target_assembly(made, F.lit("f1")), 256).alias("code_hash"))


@query(
    "q55_reconciled",
    """
    SELECT source, CASE WHEN l.doc_id IS NULL THEN 'unmatched' ELSE 'recorded' END AS status, count(*) AS n, count(l.quality) AS with_evidence FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1, 2
    """,
)
def reconciled(spark, sf_dir):
    """Records and the results that no record has, reconciled on the key."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source")
    records = docs.join(read_table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id").withColumn("status", F.lit("recorded"))
    both = sel.reconcile(records, docs.withColumn("status", F.lit("unmatched")), ["doc_id"])
    return both.groupBy("source", "status").agg(F.count("*").alias("n"), F.count("quality").alias("with_evidence"))
