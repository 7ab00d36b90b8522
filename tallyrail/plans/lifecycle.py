"""Queries over protocols, the gate, holdouts, equivalence classes, deliveries and records from artifacts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyrail.functions.keys import content_hash
from tallyrail.operators import baselines, cases, joins
from tallyrail.operators import protocols as p
from tallyrail.operators import records as r
from tallyrail.plans.catalog import query
from tallyrail.operators.validation import proposal_errors
from tallyrail.plans.reports import round9
from tallyrail.session import read_table, scratch
from tallyrail.sources import delivery, readers


@query(
    "q89_json_evidence",
    """
    WITH l AS (SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS i,
        CASE WHEN l_quantity::INT % 9 = 0 THEN 'timeout' WHEN l_quantity::INT % 9 = 1 THEN 'runtime_error' WHEN l_quantity::INT % 9 = 2 THEN 'output_mismatch' WHEN l_quantity::INT % 9 = 3 THEN 'invalid_output' ELSE 'pass' END AS outcome FROM lineitem),
    c AS (SELECT k, count(*) AS total, count(*) FILTER (WHERE outcome = 'pass') AS good, count(*) FILTER (WHERE outcome = 'timeout') AS timed, count(*) FILTER (WHERE outcome = 'runtime_error') AS crashed,
        count(*) FILTER (WHERE outcome IN ('output_mismatch', 'invalid_output')) AS mis, arg_min(outcome, i) FILTER (WHERE outcome <> 'pass') AS first FROM l GROUP BY 1),
    s AS (SELECT o_orderkey AS k, CASE WHEN o_custkey % 10 = 0 THEN 'compile_timeout' WHEN o_custkey % 10 = 1 THEN 'compile_error' WHEN o_custkey % 10 = 2 THEN 'wrapper_rewrite_failed' WHEN o_custkey % 10 = 3 THEN 'link_timeout' WHEN o_custkey % 10 = 4 THEN 'link_error' END AS stop FROM orders)
    SELECT s.k AS o_orderkey, coalesce(stop NOT LIKE 'compile%', true) AS compile_pass, stop IS NULL AS link_pass, stop IS NULL AND coalesce(good = total, false) AS behavioral_pass,
        coalesce(stop, CASE WHEN total IS NULL THEN 'no_tests' WHEN good < total THEN CASE first WHEN 'timeout' THEN 'test_timeout' ELSE first END END, 'none') AS reason,
        CASE WHEN stop IS NULL THEN coalesce(total, 0) ELSE 0 END AS tests_total, CASE WHEN stop IS NULL THEN coalesce(good, 0) ELSE 0 END AS tests_passed, CASE WHEN stop IS NULL THEN coalesce(timed, 0) ELSE 0 END AS timed_out,
        CASE WHEN stop IS NULL THEN coalesce(crashed, 0) ELSE 0 END AS crashed, CASE WHEN stop IS NULL THEN coalesce(mis, 0) ELSE 0 END AS mismatched
    FROM s LEFT JOIN c ON c.k = s.k
    """,
)
def json_evidence(spark, sf_dir):
    """Evidence of orders as candidates: their stages by customer, their line items as test cases."""
    from pyspark.sql import Window

    o, i = read_table(spark, sf_dir, "orders"), F.col("o_custkey") % 10
    candidates = o.select("o_orderkey")
    stage = lambda name, outcome, when: o.where(when).select("o_orderkey", F.lit(name).alias("name"), outcome.alias("outcome"))
    stages = (
        stage("candidate_compile", F.when(i == 0, "timeout").when(i == 1, "error").otherwise("passed"), F.lit(True))
        .union(stage("fixture_prepare", F.when(i == 2, "error").otherwise("passed"), i > 1))
        .union(stage("fixture_link", F.when(i == 3, "timeout").when(i == 4, "error").otherwise("passed"), i > 2))
    )
    n = F.col("l_quantity").cast("int") % 9
    outcome = F.when(n == 0, "timeout").when(n == 1, "runtime_error").when(n == 2, "output_mismatch").when(n == 3, "invalid_output").otherwise("pass")
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity"))
    cases = read_table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), place.alias("index"), outcome.alias("outcome"))
    return p.json_evidence(candidates, stages, cases, ["o_orderkey"]).withColumn("reason", F.coalesce("reason", F.lit("none")))


@query(
    "q90_gate",
    """
    SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'missing_binary' WHEN length(trim(source)) = 0 OR doc_id % 7 = 0 THEN 'missing_pseudocode' WHEN doc_id % 13 = 0 THEN 'private_oracle_exposed' WHEN doc_id % 17 = 0 THEN 'private_metadata_exposed' ELSE 'none' END AS reason,
        CASE WHEN doc_id % 17 = 0 THEN ['ioPairs', 'lang'] ELSE ['lang'] END AS metadata_keys
    FROM documents
    """,
)
def gate(spark, sf_dir):
    """Why a backend must not take the requests that documents stand for, and what is kept of them."""
    i = F.col("doc_id")
    view = lambda text: F.struct(text.alias("text"), F.lit("v").alias("view"))
    metadata = F.concat(F.lit('{"lang": "'), "lang", F.when(i % 17 == 0, '", "ioPairs": "1"}').otherwise('"}'))
    rows = read_table(spark, sf_dir, "documents").select(
        "doc_id", F.lit("d").alias("dataset_id"), i.cast("string").alias("sample_id"), F.lit("g").alias("source_group_id"), F.lit("f").alias("function_name"), F.lit("O0").alias("optimization"),
        F.when(i % 11 != 0, F.struct(F.col("source").alias("path"))).alias("binary"), view(F.when(i % 7 == 0, " ").otherwise(F.col("source"))).alias("pseudocode"), view(F.lit("ret")).alias("assembly"),
        F.when(i % 13 == 0, "o").alias("oracle_context"), F.lit(None).cast("string").alias("compile_context"), metadata.alias("metadata"),
    )
    return p.gate(rows).select("doc_id", F.coalesce("reason", F.lit("none")).alias("reason"), p.audited_request()["metadata_keys"].alias("metadata_keys"))


@query(
    "q91_equivalence_classes",
    """
    WITH o AS (SELECT o_custkey % 400 AS sample, o_orderstatus AS contract, o_orderpriority AS probe, max(CASE WHEN o_totalprice > 30000 THEN 'h' ELSE 'l' END) AS sig FROM orders GROUP BY 1, 2, 3),
    c AS (SELECT sample, count(DISTINCT contract) AS contracts, list_sort(list(DISTINCT contract)) AS alternatives FROM o GROUP BY 1),
    x AS (SELECT sample, probe, count(DISTINCT contract) AS c, count(DISTINCT sig) AS s FROM o GROUP BY 1, 2),
    q AS (SELECT c.sample, contracts, alternatives, count(*) FILTER (WHERE x.c = contracts) AS shared, count(*) FILTER (WHERE x.c = contracts AND x.s > 1) AS differing FROM c JOIN x USING (sample) GROUP BY ALL)
    SELECT sample, alternatives[1] AS behavioral_contract, shared AS safe_probe_count, alternatives AS source_level_alternatives, 'unidentifiable_from_binary' AS status FROM q WHERE contracts > 1 AND shared > 0 AND differing = 0
    """,
)
def equivalence_classes(spark, sf_dir):
    """Records of the samples whose contracts no shared probe tells apart."""
    o = read_table(spark, sf_dir, "orders")
    rows = o.groupBy((F.col("o_custkey") % 400).alias("sample"), F.col("o_orderstatus").alias("contract"), F.col("o_orderpriority").alias("probe")).agg(F.max(F.when(F.col("o_totalprice") > 30000, "h").otherwise("l")).alias("sig"))
    found = r.equivalence_classes(r.discriminate(rows, ["sample"], "contract", "probe", "sig"), rows, ["sample"], "contract")
    return found.select("sample", "behavioral_contract", "safe_probe_count", "source_level_alternatives", "status")


@query(
    "q92_audited_holdouts",
    """
    WITH x AS (SELECT c_custkey, c_custkey % 5 AS k, c_nationkey AS n FROM customer)
    SELECT c_custkey, CASE WHEN n % 6 = 0 THEN 'holdout_not_committed' WHEN n % 6 = 1 THEN 'holdout_changed_after_commitment' WHEN n % 6 = 2 THEN 'holdout_not_run' WHEN n % 6 = 3 THEN 'holdout_ambiguous' WHEN n % 6 = 4 THEN 'holdout_selected_another_contract' ELSE 'none' END AS reason,
        CASE WHEN n % 6 = 5 THEN 'accepted' ELSE 'rejected' END AS holdout FROM x WHERE k > 0
    """,
)
def audited_holdouts(spark, sf_dir):
    """Whether the holdouts of customers as samples bear out what exploration accepted."""
    customers, n = read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), F.col("c_nationkey") % 6
    explored = customers.select("c_custkey", F.when(F.col("c_custkey") % 5 > 0, "accepted").otherwise("rejected").alias("decision"), F.lit("k1").alias("selected"))
    held = customers.where(n != 2).select("c_custkey", F.when(n == 3, "ambiguous").otherwise("accepted").alias("decision"), F.when(n == 4, "k2").otherwise("k1").alias("selected"))
    digest = F.sha2(F.col("c_custkey").cast("string"), 256)
    commitments = customers.where(n != 0).select("c_custkey", digest.alias("committed"), F.when(n == 1, F.lit("x")).otherwise(digest).alias("replayed"))
    return r.audited_holdouts(explored, held, commitments, ["c_custkey"]).select("c_custkey", F.coalesce("reason", F.lit("none")).alias("reason"), "holdout")


def _records(spark, sf_dir):
    """Users as samples: the states that their first events stand for, and what the events cost."""
    names = F.array(*(F.lit(x) for x in ("static_inferred", "capability_checked", "probed", "frozen", "failed")))
    state = F.element_at(names, (1 + (F.col("event_id") + F.floor("value")) % 5).cast("int"))
    e = read_table(spark, sf_dir, "events").select("user_id", "event_id", "value", state.alias("state"))
    rows = e.groupBy("user_id").agg(F.count("*").alias("executions"), F.count_if(F.col("value") > 50).alias("model_calls"), F.max_by("state", "event_id").alias("last"))
    frozen = F.col("last") == "frozen"
    return rows.select(
        F.concat(F.lit("u"), "user_id").alias("sample_id"), F.concat(F.lit("g"), F.col("user_id") % 5).alias("source_group_id"), F.concat(F.lit("O"), F.col("user_id") % 4).alias("optimization"), F.array(F.lit("initial"), F.col("last")).alias("states"),
        frozen.alias("harness_frozen"), "executions", "model_calls", F.lit(0.5).alias("seconds"), F.when(~frozen & (F.col("user_id") % 2 == 0), "budget").alias("stop_reason"),
    )


SAMPLES = """
    e AS (SELECT user_id, event_id, value, ['static_inferred', 'capability_checked', 'probed', 'frozen', 'failed'][1 + (event_id + floor(value)::BIGINT) % 5] AS state FROM events),
    s AS (SELECT user_id, 'u' || user_id AS sample_id, 'g' || (user_id % 5) AS grp, 'O' || (user_id % 4) AS lvl, count(*) AS executions, arg_max(state, event_id) AS last FROM e GROUP BY user_id)
"""


@query(
    "q93_strata",
    f"""
    WITH {SAMPLES}, t AS (SELECT 'overall' AS stratum, * FROM s UNION ALL SELECT 'optimization=' || lvl, * FROM s UNION ALL SELECT 'source_group=' || grp, * FROM s),
    a AS (SELECT stratum, count(*) AS n, count(*) FILTER (WHERE last = 'frozen') AS k, count(*) FILTER (WHERE last IN ('frozen', 'failed')) AS ended, sum(executions)::BIGINT AS executions FROM t GROUP BY 1),
    z AS (SELECT *, k / n::DOUBLE AS x, 1.959963984540054 * 1.959963984540054 AS z2 FROM a)
    SELECT stratum, n AS total, k AS frozen_harnesses, round(x, 9) AS freeze_rate, round(greatest(0, (x + z2 / (2 * n)) / (1 + z2 / n) - 1.959963984540054 * sqrt(x * (1 - x) / n + z2 / (4.0::DOUBLE * n * n)) / (1 + z2 / n)), 9) AS freeze_rate_low,
        round(least(1, (x + z2 / (2 * n)) / (1 + z2 / n) + 1.959963984540054 * sqrt(x * (1 - x) / n + z2 / (4.0::DOUBLE * n * n)) / (1 + z2 / n)), 9) AS freeze_rate_high, ended AS terminal_states, executions FROM z
    """,
)
def strata(spark, sf_dir):
    """Frozen harnesses over all samples, by level and by group, with their interval in two columns."""
    out = delivery.stratified(_records(spark, sf_dir))
    return out.select(*(round9(F.col(c), c) if kind == "double" else F.col(c) for c, kind in out.dtypes))


@query(
    "q94_failures",
    f"""
    WITH {SAMPLES}
    SELECT last AS status, CASE WHEN user_id % 2 = 0 THEN 'budget' ELSE 'unknown' END AS stop_reason, count(*) AS count, min(sample_id) AS example FROM s WHERE last <> 'frozen' GROUP BY 1, 2
    """,
)
def failures(spark, sf_dir):
    """Samples without a frozen harness by last state and reason to stop."""
    return delivery.failures(_records(spark, sf_dir))


@query(
    "q95_assembled_records",
    """
    WITH d AS (SELECT doc_id, lang, source, n_chars, text FROM documents)
    SELECT d.doc_id, d.lang, CASE WHEN d.doc_id % 9 = 0 THEN -1 ELSE n_chars END AS chars, coalesce(quality, -1) AS quality, coalesce(toxic, -1) AS toxic, CASE WHEN d.doc_id % 9 = 0 THEN ['shape'] ELSE [] END AS broken,
        CASE WHEN d.doc_id % 9 = 0 THEN 'shape' WHEN l.doc_id IS NULL THEN 'labels' ELSE 'none' END AS failure_stage
    FROM d LEFT JOIN labels l ON l.doc_id = d.doc_id
    """,
)
def assembled_records(spark, sf_dir):
    """Records put together from JSON artifacts of two kinds, some broken, some missing."""
    d, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    shape = F.when(F.col("doc_id") % 9 == 0, F.lit('{"lang": ')).otherwise(F.to_json(F.struct("lang", "n_chars", F.struct("source").alias("more"))))
    artifacts = d.select("doc_id", F.lit("shape").alias("name"), shape.alias("text")).union(labels.select("doc_id", F.lit("labels").alias("name"), F.to_json(F.struct("quality", "toxic")).alias("text")))
    got = r.assembled_from_json(artifacts, {"shape": "lang string, n_chars long, more struct<source:string>", "labels": "quality int, toxic int"}, ["doc_id"])
    rows = d.select("doc_id", "lang").join(got, "doc_id")
    stage = r.failure_stage({"shape": F.col("shape").isNotNull(), "labels": F.col("labels").isNotNull()})
    return rows.select("doc_id", "lang", F.coalesce("shape.n_chars", F.lit(-1)).alias("chars"), F.coalesce("labels.quality", F.lit(-1)).alias("quality"), F.coalesce("labels.toxic", F.lit(-1)).alias("toxic"), "broken", stage.alias("failure_stage"))


@query(
    "q96_wrappers_and_exits",
    """
    WITH x AS (SELECT p_partkey, p_size, replace(p_name, ' ', '_') AS f FROM part)
    SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN '' ELSE f || ' extern "C"' || chr(10) || '{' || chr(10) || '#include "/w/' || f || '.c"' || chr(10) || '} extern "C" { z }' END AS code, CASE WHEN p_size % 4 = 0 THEN 'wrapper_rewrite_failed' ELSE 'none' END AS wrapper_reason,
        CASE WHEN p_size % 5 = 0 THEN 'compile_error' WHEN p_size % 5 = 1 THEN 'test_timeout' WHEN p_size % 5 = 2 THEN 'test_failed' WHEN p_size % 5 = 3 THEN 'runtime_error' ELSE 'none' END AS exit_reason, p_size % 5 = 4 AS behavioral_pass
    FROM x
    """,
)
def wrappers_and_exits(spark, sf_dir):
    """Wrappers that include a candidate's declarations, and verdicts by exit code."""
    part, size, f = read_table(spark, sf_dir, "part"), F.col("p_size"), F.replace(F.col("p_name"), F.lit(" "), F.lit("_"))
    wrapper = F.when(size % 4 == 0, F.concat(f, F.lit(' extern "C" int x;'))).otherwise(F.concat(f, F.lit(' extern "C" {\n int '), f, F.lit('(int);\n} extern "C" { z }')))
    got, verdict = p.rewritten_wrapper(wrapper, F.concat(F.lit("/w/"), f, F.lit(".c"))), p.exit_code_evidence(size % 5 != 0, size % 5 == 1, F.when(size % 5 == 2, 3).when(size % 5 == 4, 0))
    return part.select("p_partkey", F.coalesce(got["code"], F.lit("")).alias("code"), F.coalesce(got["reason"], F.lit("none")).alias("wrapper_reason"), F.coalesce(verdict["reason"], F.lit("none")).alias("exit_reason"), verdict["behavioral_pass"].alias("behavioral_pass"))


def _frozen(spark, sf_dir):
    """Documents as frozen samples: their artifacts, some of which no longer fit the manifest."""
    i = F.col("doc_id")
    explored, held = F.concat(F.lit('{"p":'), i, F.lit('}\n{"p":1}\n')), F.concat(F.lit('{"h":'), i, F.lit("}"))
    policy = F.lit('{"compare": ["return", "memory"]}')
    rest = F.to_json(F.struct(
        F.lit("c1").alias("contract_id"), F.sha2(i.cast("string"), 256).alias("contract_hash"), F.when(i % 5 == 0, 3).otherwise(2).alias("exploration_probe_count"), F.lit(1).alias("holdout_probe_count"),
        baselines.list_hash(held).alias("holdout_probe_plan_hash"), (i % 7 == 0).alias("mutation_after_freeze_allowed"), content_hash(policy).alias("observation_policy_hash"), F.lit(3).alias("probe_count"),
        baselines.list_hash(explored).alias("probe_plan_hash"), F.lit("v2").alias("schema_version"), F.lit("frozen").alias("status"),
    ))
    # Keys in order, no white space: the canonical form that the manifest's own hash is of.
    keys = F.from_json(rest, "map<string,string>")
    d = read_table(spark, sf_dir, "documents").select("doc_id", rest.alias("rest"), keys.alias("keys"), explored.alias("explored"), held.alias("held"), policy.alias("policy"))
    ordered = F.regexp_replace("rest", '^\\{"contract_id":"c1","contract_hash":("[^"]*")', '{"contract_hash":$1,"contract_id":"c1"')
    own = F.sha2(ordered, 256)
    harness = F.concat(F.substr("rest", F.lit(1), F.length("rest") - 1), F.lit(',"content_hash":"'), F.when(i % 11 == 0, F.lit("x")).otherwise(own), F.lit('"}'))
    metadata = F.when(i % 13 == 0, F.lit('{"harness_frozen": false, "contract_selection_status": "audit_accepted_frozen"}')).otherwise('{"harness_frozen": true, "contract_selection_status": "audit_accepted_holdout_frozen"}')
    return d.select(
        i.cast("string").alias("sample_id"), F.when(i % 3 != 0, harness).alias("harness"), metadata.alias("metadata"), F.concat(F.lit('{"contract_id": "'), F.when(i % 17 == 0, "c2").otherwise("c1"), F.lit('"}')).alias("selected"), "policy",
        F.when(i % 19 == 0, F.concat("explored", F.lit('{"p":2}'))).otherwise(F.col("explored")).alias("exploration_probes"), F.col("held").alias("holdout_probes"), F.lit('{"o":1}\n\n{"o":2}').alias("exploration_observations"),
        F.when(i % 23 != 0, F.lit('{"o":3}\n')).alias("holdout_observations"), F.sha2(i.cast("string"), 256).alias("selected_hash"), F.when(i % 29 != 0, F.lit("r")).alias("runner_sha256"),
    )


@query(
    "q97_baseline_entries",
    """
    WITH x AS (SELECT doc_id AS i FROM documents WHERE doc_id % 3 <> 0)
    SELECT i::VARCHAR AS sample_id, CASE WHEN i % 19 = 0 THEN 3 ELSE 2 END AS exploration_probe_count, 1 AS holdout_probe_count, list_filter([CASE WHEN i % 11 = 0 THEN 'manifest_content_hash' END, CASE WHEN i % 7 = 0 THEN 'mutation_forbidden' END, CASE WHEN i % 13 = 0 THEN 'metadata_frozen' END,
        CASE WHEN i % 17 = 0 THEN 'selected_contract_id' END, CASE WHEN i % 19 = 0 THEN 'exploration_probe_plan_hash' END, CASE WHEN (i % 19 = 0) <> (i % 5 = 0) THEN 'exploration_probe_count' END, CASE WHEN i % 19 = 0 THEN 'probe_count' END,
        CASE WHEN i % 19 = 0 THEN 'exploration_observation_count' END, CASE WHEN i % 23 = 0 THEN 'holdout_observation_count' END, CASE WHEN i % 29 = 0 THEN 'original_runner_present' END], lambda z: z IS NOT NULL) AS failure_reasons,
        (i % 19 <> 0 AND i % 5 <> 0) AS exploration_plan
    FROM x
    """,
)
def baseline_entries(spark, sf_dir):
    """Frozen samples compared with their manifests by seventeen checks, and a report's check of the exploration plan."""
    found = baselines.entries(_frozen(spark, sf_dir), "v2")
    return found.join(baselines.plan_checks(found), "sample_id").select("sample_id", "exploration_probe_count", "holdout_probe_count", "failure_reasons", "exploration_plan")


@query("q98_knowledge_base", "SELECT row_number() OVER (ORDER BY doc_id) - 1 AS id, 'line ' || doc_id || ' ' || lang AS text FROM documents WHERE doc_id % 7 <> 0")
def knowledge_base(spark, sf_dir):
    """Documents' lines written as text files with blank ones among them, and read back numbered."""
    path = f"{scratch(spark)}/lines"
    d = read_table(spark, sf_dir, "documents").repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    d.select(F.when(F.col("doc_id") % 7 == 0, "  ").otherwise(F.concat(F.lit("line "), "doc_id", F.lit(" "), "lang")).alias("value")).write.text(path)
    return readers.knowledge_base(spark, path)


@query(
    "q99_resolved_contracts",
    """
    WITH x AS (SELECT p_partkey AS i, p_name, p_size FROM part)
    SELECT i AS p_partkey, CASE WHEN i % 5 = 0 THEN 's' || (p_size % 3) WHEN p_name LIKE 'red%' THEN 'f' ELSE 'none' END AS contract_id, CASE WHEN i % 5 = 0 THEN 2 WHEN p_name LIKE 'red%' THEN 1 ELSE 0 END AS inputs,
        CASE WHEN i % 5 = 0 AND p_size % 3 > 0 THEN 1 ELSE 0 END AS broken, CASE WHEN i % 5 = 0 OR p_name LIKE 'red%' THEN 'none' ELSE 'unsupported_missing_known_contract' END AS reason
    FROM x
    """,
)
def resolved_contracts(spark, sf_dir):
    """Contracts and inputs known for parts as samples, by their own entry, by that of their name, or by neither."""
    parts = read_table(spark, sf_dir, "part")
    samples = parts.select(F.col("p_partkey").cast("string").alias("sample_id"), F.col("p_name").alias("function_name"))
    contract = lambda name, least: F.struct(name.alias("contract_id"), F.array(F.struct(F.lit("RDI").alias("slot"), F.lit("pointer").alias("kind"), F.lit("o").alias("object_ref"))).alias("arguments"), F.array(F.struct(F.lit("o").alias("object_id"), least.cast("int").alias("min_size"))).alias("objects"), F.array().cast("array<struct<kind:string,left:string,right:string,offset:int,length_slot:string,object_ref:string>>").alias("relations")).cast(cases.CONTRACT)
    name = F.concat(F.lit("s"), F.col("p_size") % 3)

    def case(size):
        thing = F.struct(F.lit(size).alias("size"), F.lit("00" * size).alias("bytes_hex"), F.lit("left").alias("placement"))
        register = F.struct(F.lit(None).cast("long").alias("value"), F.lit("o").alias("object_ref"), F.lit(False).alias("is_null"))
        return F.struct(F.lit(1).alias("schema_version"), name.alias("contract_id"), F.create_map(F.lit("RDI"), register).alias("gpr"), F.create_map(F.lit("o"), thing).alias("objects"), F.create_map().cast("map<string,string>").alias("globals"), F.lit(0).cast("long").alias("seed"), F.lit("").alias("virtual_read_bytes")).cast(cases.CASE)

    own = parts.where("p_partkey % 5 = 0").select(F.lit("sample").alias("scope"), F.col("p_partkey").cast("string").alias("name"), contract(name, F.when(F.col("p_size") % 3 > 0, 2).otherwise(1)).alias("contract"), F.array(case(1), case(2)).alias("inputs"))
    shared = parts.where("p_name LIKE 'red%'").select(F.lit("function").alias("scope"), F.col("p_name").alias("name")).distinct().select("scope", "name", contract(F.lit("f"), F.lit(3)).alias("contract"), F.lit(None).cast(f"array<{cases.CASE}>").alias("inputs"))
    got = cases.resolved(samples, own.unionByName(shared))
    broken = F.size(F.filter(F.coalesce("errors", F.array().cast("array<array<string>>")), lambda e: F.size(e) > 0))
    return got.select(F.col("sample_id").cast("long").alias("p_partkey"), F.coalesce("contract.contract_id", F.lit("none")).alias("contract_id"), F.size(F.coalesce("inputs", F.array().cast(f"array<{cases.CASE}>"))).alias("inputs"), broken.alias("broken"), F.coalesce("reason", F.lit("none")).alias("reason"))


@query(
    "q100_precomputed",
    """
    SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'code ' || doc_id WHEN doc_id % 4 = 1 THEN 'shared' WHEN doc_id % 3 = 0 THEN '-' ELSE sha256(text) END AS code, CASE WHEN doc_id % 4 > 1 AND doc_id % 3 = 0 THEN 'precomputed_output_missing' ELSE 'none' END AS reason FROM documents
    """,
)
def precomputed(spark, sf_dir):
    """Stored outputs of documents as samples: by a manifest's code, by its path, by the pattern of their names, or none."""
    d, i = read_table(spark, sf_dir, "documents"), F.col("doc_id")
    requests = d.select("doc_id", F.concat(F.lit("a/"), i).alias("sample_id"), F.col("lang").alias("language"))
    entry = lambda code, path, order: F.struct(code.cast("string").alias("code"), path.cast("string").alias("path"), F.lit(order).alias("ordinal"))
    rows = F.when(i % 4 == 0, F.array(entry(F.lit("old"), F.lit(None), 1), entry(F.concat(F.lit("code "), i), F.lit(None), 2))).when(i % 4 == 1, F.array(entry(F.lit(None), F.lit("/s/x.c"), 1)))
    manifest = requests.select("sample_id", F.inline(rows))
    files = d.where("doc_id % 3 <> 0").select(F.concat(F.lit("root/"), "lang", F.lit("/a_"), i, F.lit(".c")).alias("path"), F.sha2("text", 256).alias("content")).union(spark.createDataFrame([("/s/x.c", "shared")], "path string, content string"))
    got = readers.precomputed(requests, manifest, files, "{language}/{sample_id}.c", "root")
    return got.select("doc_id", F.coalesce("code", F.lit("-")).alias("code"), F.coalesce("reason", F.lit("none")).alias("reason"))


@query(
    "q101_proposals",
    """
    SELECT event_id, list_filter(list_concat([CASE WHEN event_type = 'view' THEN 'forbidden_field:wrapper' END, CASE WHEN event_type = 'click' THEN 'no_proposed_contract' END, CASE WHEN value > 50 THEN 'confidence_out_of_range' END, CASE WHEN event_id % 5 = 0 THEN 'no_evidence' END],
        [CASE WHEN event_id % 5 = 1 THEN 'unknown_evidence:e9' END]), lambda z: z IS NOT NULL) AS errors,
        list_filter([CASE WHEN event_id % 3 = 0 THEN 'unknown_strategy' END, CASE WHEN event_id % 4 = 0 THEN 'no_rationale' END], lambda z: z IS NOT NULL) AS intent_errors FROM events
    """,
)
def proposals(spark, sf_dir):
    """What is wrong with the proposals and the probe intents that events stand for."""
    e, i = read_table(spark, sf_dir, "events"), F.col("event_id")
    known = F.array(F.lit("e1"), F.lit("e2"))
    evidence = F.when(i % 5 == 0, "[]").when(i % 5 == 1, '["e1", "e9", "e9"]').otherwise('["e2"]')
    contract = F.when(F.col("event_type") == "view", '{"a": [{"wrapper": 1}]}').when(F.col("event_type") == "click", "{}").otherwise('{"a": 1}')
    proposal = F.concat(F.lit('{"proposed_contract": '), contract, F.lit(', "confidence": '), F.when(F.col("value") > 50, "1.5").otherwise("0.5"), F.lit(', "evidence_ids": '), evidence, F.lit("}"))
    intent = F.concat(F.lit('{"strategy": "'), F.when(i % 3 == 0, "other").otherwise("boundary_pair"), F.lit('", "rationale": "'), F.when(i % 4 == 0, "").otherwise("r"), F.lit('", "confidence": 1, "evidence_ids": ["e1"]}'))
    return e.select("event_id", proposal_errors(proposal, known).alias("errors"), proposal_errors(intent, known, intent=True).alias("intent_errors"))


@query(
    "q102_gated_levels",
    """
    WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, (l_partkey % 3)::INT AS a, (l_suppkey % 4)::INT AS b, l_quantity::INT % 5 AS c FROM lineitem)
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, a = 0 AND b = 0 AND c = 0 AS passed, CASE WHEN a > 0 THEN 'syntax' WHEN b > 0 THEN 'compile' WHEN c > 0 THEN 'tests' ELSE 'none' END AS failed_level,
        CASE WHEN a > 0 THEN 'syntax: s1' || CASE WHEN a > 1 THEN '; s2' ELSE '' END WHEN b > 0 THEN 'compile: c1' || CASE WHEN b > 1 THEN '; c2' ELSE '' END || CASE WHEN b > 2 THEN ' and 1 more' ELSE '' END
             WHEN c > 0 THEN 'tests: t1' || CASE WHEN c > 1 THEN '; t2' ELSE '' END || CASE WHEN c > 2 THEN ' and ' || (c - 2) || ' more' ELSE '' END ELSE '-' END AS feedback,
        round(((2 - a) / 2.0::DOUBLE + CASE WHEN a = 0 THEN (3 - b) / 3.0::DOUBLE ELSE 0 END + CASE WHEN a = 0 AND b = 0 THEN (4 - c) / 4.0::DOUBLE ELSE 0 END) / 3, 9) AS score
    FROM x
    """,
)
def gated_levels(spark, sf_dir):
    """Levels of a check, each asked only where those before it hold, with the first failures as feedback."""
    rows = read_table(spark, sf_dir, "lineitem")
    failed = lambda name, n: F.slice(F.array(*(F.lit(f"{name}{i}") for i in range(1, 5))), 1, n.cast("int"))
    got = p.gated_levels([("syntax", failed("s", F.col("l_partkey") % 3), F.lit(2)), ("compile", failed("c", F.col("l_suppkey") % 4), F.lit(3)), ("tests", failed("t", F.col("l_quantity").cast("int") % 5), F.lit(4))])
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", got["passed"].alias("passed"), F.coalesce(got["failed_level"], F.lit("none")).alias("failed_level"), F.coalesce(got["feedback"], F.lit("-")).alias("feedback"), round9(got["score"], "score"))


@query(
    "q103_unsupported_direct",
    """
    WITH u AS (SELECT DISTINCT o_custkey % 300 AS k FROM orders), d AS (SELECT DISTINCT user_id % 300 AS k FROM events) SELECT 's' || u.k AS name FROM u JOIN d USING (k) WHERE u.k >= 20
    """,
)
def unsupported_direct(spark, sf_dir):
    """Undefined symbols that the target refers to itself and that nothing supplies."""
    name = lambda k: F.concat(F.lit("s"), F.col(k) % 300).alias("name")
    undefined, direct = read_table(spark, sf_dir, "orders").select(name("o_custkey")).distinct(), read_table(spark, sf_dir, "events").select(name("user_id"))
    return joins.unsupported_direct(joins.classify_dependencies(undefined, direct, {"runtime": [f"s{i}" for i in range(20)], "stub": [f"s{i}" for i in range(10, 40)]}), ["runtime"])


@query(
    "q104_behaviour_report",
    """
    WITH x AS (SELECT o_orderkey AS k, o_custkey AS grp, o_orderpriority AS lvl, o_orderkey % 9 = 0 AS gone, o_orderkey % 5 > 0 AS assembled, o_orderkey % 5 > 1 AS linked, o_orderkey % 5 > 1 AND o_orderkey % 11 > 0 AS passed FROM orders),
    r AS (SELECT k, grp, lvl, assembled AND NOT gone AS a, linked AND NOT gone AS l, passed AND NOT gone AS p, CASE WHEN gone THEN 0 ELSE 4 END AS t, CASE WHEN gone THEN 0 WHEN passed THEN 4 ELSE 1 END AS g FROM x),
    e AS (SELECT * FROM r UNION ALL SELECT k, grp, 'all', a, l, p, t, g FROM r), w AS (SELECT lvl, grp, bool_and(p) AS ok FROM e GROUP BY 1, 2)
    SELECT e.lvl AS level, count(*) AS samples, count(*) FILTER (WHERE a) AS assembled, count(*) FILTER (WHERE l) AS linked, count(*) FILTER (WHERE p) AS behavioral_pass, sum(t)::BIGINT AS tests_total, sum(g)::BIGINT AS tests_passed,
        any_value(groups) AS groups, any_value(passing) AS passing_groups FROM e JOIN (SELECT lvl, count(*) AS groups, count(*) FILTER (WHERE ok) AS passing FROM w GROUP BY 1) v ON v.lvl = e.lvl GROUP BY 1
    """,
)
def behaviour_report(spark, sf_dir):
    """What a report says of orders as samples, by priority and over all, with customers that pass as a whole."""
    i = F.col("o_orderkey")
    samples = read_table(spark, sf_dir, "orders").select(i, "o_custkey", "o_orderpriority")
    good = (i % 5 > 1) & (i % 11 > 0)
    report = samples.where(i % 9 != 0).select(i, (i % 5 > 0).alias("assembled"), (i % 5 > 1).alias("linked"), good.alias("behavioral_pass"), F.lit(4).alias("tests_total"), F.when(good, 4).otherwise(1).alias("tests_passed"), F.lit(None).cast("string").alias("reason"))
    return r.behaviour_report(r.behaviour_rows(samples, report, "o_orderkey"), "o_orderpriority", "o_custkey")


@query(
    "q105_postprocessed",
    """
    SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'typedef unsigned int undefined4;' || chr(10) || chr(10) ELSE '' END || CASE WHEN p_partkey % 3 = 0 THEN 'undefined4 ' ELSE 'int ' END || CASE WHEN p_partkey % 2 = 0 THEN 'target' ELSE 'own' END || '(void) { }' AS code,
        list_filter([CASE WHEN p_partkey % 5 > 0 THEN 'markdown_fence' END, CASE WHEN p_partkey % 2 = 0 THEN 'rename_target' END, CASE WHEN p_partkey % 3 = 0 THEN 'compat_types' END], lambda z: z IS NOT NULL) AS actions FROM part
    """,
)
def postprocessed(spark, sf_dir):
    """Answers for parts through the chain of postprocessors, and which of them changed something."""
    from tallyrail.functions.text import postprocess

    i = F.col("p_partkey")
    body = F.concat(F.when(i % 3 == 0, "undefined4 ").otherwise("int "), F.when(i % 2 == 0, "FUN_00401000").otherwise("own"), F.lit("(void) { }"))
    rows = read_table(spark, sf_dir, "part").select(i, F.when(i % 5 > 0, F.concat(F.lit("here:\n```c\n"), body, F.lit("\n```\nbye"))).otherwise(F.concat(body, F.lit("  \n"))).alias("code"), F.lit("target").alias("name"))
    return postprocess(rows, "code", "name", ["markdown_fence", "rename_target", "compat_types"]).select("p_partkey", "code", "actions")


@query(
    "q106_cached_generations",
    """
    SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'new' ELSE 'same' END AS state, o_orderpriority AS code, o_orderkey % 3 > 0 OR o_orderkey % 2 = 0 AS hit FROM orders
    """,
)
def cached_generations(spark, sf_dir):
    """Orders as generations saved to a cache in two goes, what the second one finds there, and a lookup."""
    from tallyrail.operators import cache

    path, i = f"{scratch(spark)}/cache", F.col("o_orderkey")
    rows = read_table(spark, sf_dir, "orders").select(F.sha2(i.cast("string"), 256).alias("cache_key"), i, F.col("o_orderpriority").alias("code"), F.lit(1.0).alias("elapsed_seconds"))
    cache.save(rows.where(i % 3 > 0), path, "cache_key")
    states = cache.classify(rows.withColumn("elapsed_seconds", F.lit(2.0)), spark.read.parquet(path), "cache_key").select("o_orderkey", "state")
    cache.save(rows.where((i % 3 > 0) | (i % 2 == 0)), path, "cache_key")
    found = cache.lookup(rows.select("cache_key", "o_orderkey", "code"), spark.read.parquet(path).select("cache_key"), "cache_key", "generation")
    return states.join(found, "o_orderkey").select("o_orderkey", "state", "code", F.col("generation_hit").alias("hit"))


@query(
    "q107_run_results",
    """
    SELECT 'd' AS dataset_id, 'b' || (o_custkey % 3) AS backend_id, count(*) AS total, count(*) FILTER (WHERE o_orderkey % 4 > 0) AS decompiled, 'results' AS record_source,
        count(*) FILTER (WHERE o_orderkey % 4 = 0) AS empty_output FROM orders GROUP BY 2
    """,
)
def run_results(spark, sf_dir):
    """Orders as the results of a run, written as JSON lines in two goes and read back for a report."""
    from tallyrail.operators import metrics
    from tallyrail.sources import writers

    path, i = scratch(spark), F.col("o_orderkey")
    rows = read_table(spark, sf_dir, "orders").select(F.lit("d").alias("dataset_id"), F.concat(F.lit("b"), F.col("o_custkey") % 3).alias("backend_id"), i.cast("string").alias("sample_id"), (i % 4 > 0).alias("decompile_success"), F.lit(None).cast("boolean").alias("recompilable"), F.lit(None).cast("boolean").alias("behavioral_pass"), F.when(i % 4 == 0, "empty_output").alias("reason"), F.array().cast("array<string>").alias("capabilities"))
    writers.append_results(rows.where(i % 2 == 0), f"{path}/results.jsonl", resume=False)
    writers.append_results(rows.where(i % 2 == 1), f"{path}/results.jsonl", resume=True)
    got = metrics.with_metrics(readers.run_results(spark, path))
    out = metrics.summarize(got, ["dataset_id", "backend_id"])
    source = got.select("record_source").distinct()
    return out.join(F.broadcast(source)).select("dataset_id", "backend_id", "total", F.col("decompile_success_passed").alias("decompiled"), "record_source", F.coalesce(F.try_element_at("failure_reasons", F.lit("empty_output")), F.lit(0)).alias("empty_output"))


@query(
    "q108_evidence_ids",
    """
    SELECT event_id, sha256('{"contract_hash":"' || sha256(event_type) || '","difference_kinds":[' || CASE event_id % 3 WHEN 0 THEN '' WHEN 1 THEN '"return"' ELSE '"return","memory"' END || '],"harness_hash":"' || sha256(props) || '","probe_id":"p' || event_id || '","sample_id":"u' || user_id || '"}') AS evidence_id,
        CASE WHEN event_id % 7 = 0 THEN 'compile_timeout' WHEN event_id % 7 = 1 THEN 'compile_error' ELSE 'none' END AS reason
    FROM events
    """,
)
def evidence_ids(spark, sf_dir):
    """Digests of what events as evidence are about, and the evidence of a protocol that only compiles."""
    from tallyrail.functions.keys import evidence_id

    e, i = read_table(spark, sf_dir, "events"), F.col("event_id")
    kinds = F.slice(F.array(F.lit("return"), F.lit("memory")), 1, (i % 3).cast("int"))
    compiled = p.object_evidence(F.when(i % 7 == 0, "timeout").when(i % 7 == 1, "error").otherwise("passed"))
    made = evidence_id(F.concat(F.lit("u"), "user_id"), F.sha2("event_type", 256), F.sha2("props", 256), F.concat(F.lit("p"), i), kinds)
    return e.select("event_id", made.alias("evidence_id"), F.coalesce(compiled["reason"], F.lit("none")).alias("reason"))
