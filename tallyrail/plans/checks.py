"""Queries over the kernels of texts, symbols, contracts and observations, each on columns made from whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyrail.functions import numbers as n
from tallyrail.functions import text as t
from tallyrail.operators import audit as a
from tallyrail.operators import contracts as c
from tallyrail.operators import joins as j
from tallyrail.operators import metrics as m
from tallyrail.operators import records as r
from tallyrail.operators import selection as sel
from tallyrail.operators import sequences as s
from tallyrail.plans.catalog import query
from tallyrail.session import read_table


@query(
    "q68_candidate_code",
    """
    WITH x AS (SELECT conv_id, turn, role, text, CASE turn % 3 WHEN 0 THEN 'Output: ' WHEN 1 THEN ' Helpful Answer:  ' ELSE '' END || 'n' || conv_id || chr(10)
        || CASE turn % 2 WHEN 0 THEN '```c' || chr(10) || 'int a;' || chr(10) || '```' || chr(10) || '```text' || chr(10) || replace(text, '`', '') || ' and more' || chr(10) || '```' ELSE '```text' || chr(10) || 'x' || chr(10) || '``` ' || replace(text, '`', '') END AS y FROM conversations),
    e AS (SELECT *, regexp_replace(text, '`', '', 'g') AS bare FROM x)
    SELECT conv_id, turn, CASE turn % 2 WHEN 0 THEN 'longest_c_fence' ELSE 'longest_fence' END AS policy, CASE turn % 2 WHEN 0 THEN 'int a;' ELSE 'x' END AS code,
        CASE turn % 2 WHEN 0 THEN 'int a;' ELSE NULL END AS last, CASE WHEN turn % 3 < 2 THEN 'n' || conv_id END AS head
    FROM e WHERE text IS NOT NULL
    """,
)
def candidate_code(spark, sf_dir):
    """Code of answers by policy, the last fenced block, and the first line without an answer's prefix."""
    rows = read_table(spark, sf_dir, "conversations").where("text IS NOT NULL")
    bare = F.replace(F.col("text"), F.lit("`"), F.lit(""))
    prefix = F.when(F.col("turn") % 3 == 0, "Output: ").when(F.col("turn") % 3 == 1, " Helpful Answer:  ").otherwise("")
    blocks = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("```c\nint a;\n```\n```text\n"), bare, F.lit(" and more\n```"))).otherwise(F.concat(F.lit("```text\nx\n``` "), bare))
    answer = F.concat(prefix, F.lit("n"), F.col("conv_id").cast("string"), F.lit("\n"), blocks)
    got = t.candidate_code(answer)
    first = F.substring_index(t.drop_answer_prefix(answer), "\n", 1)
    return rows.select("conv_id", "turn", got["policy"].alias("policy"), got["code"].alias("code"), F.when(F.col("turn") % 2 == 0, t.last_fence(F.substring_index(answer, "```text", 1))).alias("last"), F.when(F.col("turn") % 3 < 2, first).alias("head"))


@query(
    "q69_forbidden_source",
    """
    WITH x AS (SELECT doc_id, replace(text, '"', '') || chr(10) || CASE doc_id % 6 WHEN 0 THEN '#  include <x.h>' WHEN 1 THEN 'x = system (1);' WHEN 2 THEN '__asm__("nop");' WHEN 3 THEN 'p = "../a";' WHEN 4 THEN 'ecosystem(1); "a\\"b"' ELSE 'fork(); asm; #line 3' || chr(10) || '# line 4' END AS y FROM documents)
    SELECT doc_id, list_filter([CASE WHEN regexp_matches(y, '\\b(__asm__|__asm|asm|_Pragma)\\b') OR regexp_matches(y, '__attribute__\\s*\\(\\([^)]*(constructor|destructor|section|alias)') THEN 'forbidden_inline_assembly_or_attribute' END,
        CASE WHEN regexp_matches(y, '"(?:[^"\\\\]|\\\\.)*(?:/|\\.\\.)(?:[^"\\\\]|\\\\.)*"') THEN 'forbidden_path_literal' END,
        CASE WHEN regexp_matches(y, '(?m)^\\s*#\\s*(include|include_next|pragma|line|embed)\\b') THEN 'forbidden_preprocessor_directive' END,
        CASE WHEN regexp_matches(y, '\\b(system|popen|fork|vfork|clone|exec[a-zA-Z0-9_]*|open|openat|creat|fopen|freopen|socket|socketpair|connect|bind|listen|accept|send|sendto|recv|recvfrom|dlopen|dlsym|ptrace|mount|umount|unshare|setns|chroot|pivot_root|kill|syscall)\\s*\\(') THEN 'forbidden_system_or_process_call' END], lambda z: z IS NOT NULL) AS reasons
    FROM x
    """,
)
def forbidden_source(spark, sf_dir):
    """Reasons to refuse documents as sources, each with a line of its own."""
    i = F.col("doc_id") % 6
    line = F.when(i == 0, "#  include <x.h>").when(i == 1, "x = system (1);").when(i == 2, '__asm__("nop");').when(i == 3, 'p = "../a";').when(i == 4, 'ecosystem(1); "a\\"b"').otherwise("fork(); asm; #line 3\n# line 4")
    return read_table(spark, sf_dir, "documents").select("doc_id", t.security_reasons(F.concat(F.replace(F.col("text"), F.lit('"'), F.lit("")), F.lit("\n"), line)).alias("reasons"))


@query(
    "q70_wrappers",
    """
    WITH x AS (SELECT p_partkey, replace(p_name, ' ', '_') AS f, p_size FROM part)
    SELECT p_partkey, 'int ' || f || ';' || chr(10) || CASE WHEN p_size % 2 = 0 THEN '' ELSE 'typedef int bool; // ' || f || chr(10) END || chr(10) || ' x' AS plain,
        CASE WHEN p_size % 3 = 0 THEN ' ' ELSE 'extern ' END || ' int ' || f || ' (static int a) { return ' || f || '(inline); }' AS code
    FROM x
    """,
)
def wrappers(spark, sf_dir):
    """Declarations that clash with a wrapper, and linkage words before a target, taken out."""
    p = read_table(spark, sf_dir, "part")
    f = F.replace(F.col("p_name"), F.lit(" "), F.lit("_"))
    odd = F.col("p_size") % 2 == 1
    dependencies = F.concat(F.lit("int "), f, F.lit(";\n"), F.when(odd, F.concat(F.lit("typedef int bool; // "), f)).otherwise("int printf(const char *, ...);"), F.lit("\n#define true 1\n/*<<< orphan */ x"))
    plain = F.when(odd, F.regexp_replace(t.sanitize_dependencies(dependencies, False), "#define true 1", "")).otherwise(t.sanitize_dependencies(dependencies, True))
    code = F.concat(F.when(F.col("p_size") % 3 == 0, "static ").otherwise("extern "), F.lit("inline int "), f, F.lit(" (static int a) { return "), f, F.lit("(inline); }"))
    cut = F.when(F.col("p_size") % 3 == 0, t.externalize(code, f)).otherwise(t.externalize(code, f, keep_extern=True))
    return p.select("p_partkey", plain.alias("plain"), cut.alias("code"))


@query(
    "q71_generated_names",
    """
    WITH x AS (SELECT p_partkey, 'f' || p_partkey AS want, replace(p_name, ' ', '_') AS old, p_size FROM part)
    SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN '(a)' || old WHEN p_size % 4 = 1 THEN 'int *' || want || '(int ' || old || 'x) { ' || want || '(1); }' ELSE 'int ' || want || ' (void) { return ' || want || '(2); }' END AS code,
        CASE WHEN p_size % 4 = 0 THEN 0 ELSE 2 END AS renamed, CASE WHEN p_size % 4 = 1 THEN ['I1', 'I12'] WHEN p_size % 4 = 2 THEN ['I' || p_size] ELSE [] END AS labels, 'int' || old || '{}' AS squeezed,
        CASE WHEN p_size % 4 = 1 THEN 'other' ELSE old END AS name
    FROM x
    """,
)
def generated_names(spark, sf_dir):
    """The function that a text defines first renamed; labels of a comment, text without white space, the defined name."""
    p, size = read_table(spark, sf_dir, "part"), F.col("p_size") % 4
    old, want = F.replace(F.col("p_name"), F.lit(" "), F.lit("_")), F.concat(F.lit("f"), F.col("p_partkey"))
    code = F.when(size == 0, F.concat(F.lit("(a)"), old)).when(size == 1, F.concat(F.lit("int *"), old, F.lit("(int "), old, F.lit("x) { "), old, F.lit("(1); }"))).otherwise(F.concat(F.lit("int "), old, F.lit(" (void) { return "), old, F.lit("(2); }")))
    got = t.rename_generated(code, want)
    line = F.when(size == 1, "x // I12 I1 I12 i3 I4x").when(size == 2, F.concat(F.lit("I9 // I"), F.col("p_size"))).otherwise("I5")
    defined = F.when(size == 1, "int x;").otherwise(F.concat(F.lit("int g(int); int "), old, F.lit(" (int (*h)(void))\n{")))
    return p.select("p_partkey", got["code"].alias("code"), got["count"].alias("renamed"), t.line_labels(line).alias("labels"), t.squeeze(F.concat(F.lit(" int\t"), old, F.lit(" { }\n"))).alias("squeezed"), t.function_name(defined, F.lit("other")).alias("name"))


@query(
    "q72_codes",
    """
    SELECT event_id, CASE event_type WHEN 'click' THEN 'closed_llm_auth_error' WHEN 'view' THEN 'closed_llm_rate_limit' WHEN 'error' THEN 'closed_llm_timeout' WHEN 'purchase' THEN 'closed_llm_api_error' ELSE 'closed_llm_invalid_response' END AS reason,
        right(props || event_type, 9) AS tail, CASE WHEN event_id % 3 = 0 THEN 'att' WHEN event_id % 3 = 1 THEN 'intel' WHEN event_id % 2 = 0 THEN 'att' ELSE 'intel' END AS syntax,
        'sym' || (event_id % 100) || CASE WHEN event_id % 4 = 1 THEN '+0x8' ELSE '' END AS symbol, CASE event_id % 5 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 4 ELSE 8 END AS width,
        CASE event_id % 6 WHEN 0 THEN 'void' WHEN 1 THEN 'pointer' WHEN 2 THEN 'unsupported_float' WHEN 3 THEN 'unsupported_aggregate' WHEN 4 THEN 'pointer' ELSE 'integer' END AS kind
    FROM events
    """,
)
def codes(spark, sf_dir):
    """Reason codes of error names, ends of logs, syntaxes, symbols of relocations, widths of moves, kinds of types."""
    e, i = read_table(spark, sf_dir, "events"), F.col("event_id")
    error = F.when(F.col("event_type") == "click", "PermissionDeniedError").when(F.col("event_type") == "view", "RateLimitError").when(F.col("event_type") == "error", "APITimeoutError").when(F.col("event_type") == "purchase", "BadRequestError").otherwise("KeyError")
    line = F.when((i % 3 == 2) & (i % 2 == 0), "mov %eax, %ebx").otherwise("mov eax, ebx")
    asked = F.when(i % 3 == 0, "GNU AT&T").when(i % 3 == 1, "Intel").otherwise("auto")
    symbol = F.concat(F.lit("sym"), i % 100, F.when(i % 4 == 0, "-0x4").when(i % 4 == 1, "+0x8").otherwise(""))
    moves = F.element_at(F.array(*(F.lit(x) for x in ("movb", "movw.s", "movl", "movq", "lea"))), (1 + i % 5).cast("int"))
    kinds = F.element_at(F.array(*(F.lit(x) for x in (" void ", "const  char *", "long double", "struct s", "int[4]", "unsigned long"))), (1 + i % 6).cast("int"))
    return e.select("event_id", t.error_reason(error).alias("reason"), t.tail(F.concat("props", "event_type"), 9).alias("tail"), t.line_syntax(line, asked).alias("syntax"), t.relocation_symbol(symbol).alias("symbol"), t.access_width(moves).alias("width"), t.type_kind(kinds).alias("kind"))


@query(
    "q73_dependencies",
    """
    WITH u AS (SELECT DISTINCT o_custkey % 300 AS k FROM orders), d AS (SELECT DISTINCT user_id % 300 AS k FROM events)
    SELECT 's' || u.k AS name, d.k IS NOT NULL AS direct, CASE WHEN u.k < 20 THEN 'runtime' WHEN u.k < 40 THEN 'stub' ELSE 'unknown' END AS kind FROM u LEFT JOIN d USING (k)
    """,
)
def dependencies(spark, sf_dir):
    """Undefined symbols by the list that has them, and whether the target refers to them itself."""
    name = lambda k: F.concat(F.lit("s"), F.col(k) % 300).alias("name")
    undefined, direct = read_table(spark, sf_dir, "orders").select(name("o_custkey")).distinct(), read_table(spark, sf_dir, "events").select(name("user_id"))
    return j.classify_dependencies(undefined, direct, {"runtime": [f"s{i}" for i in range(20)], "stub": [f"s{i}" for i in range(10, 40)]})


@query(
    "q74_probe_results",
    """
    WITH p AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS position FROM events)
    SELECT user_id, event_type AS probe, count(*) AS n, count(*) FILTER (WHERE round(value) % 2 = 0) AS even FROM p JOIN (SELECT event_id, value FROM events) USING (event_id) GROUP BY 1, 2
    """,
)
def probe_results(spark, sf_dir):
    """Probes and their results joined by position within each user."""
    from pyspark.sql import Window

    e = read_table(spark, sf_dir, "events").withColumn("position", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")))
    both = j.zip_rows(e.select("user_id", "position", F.col("event_type").alias("probe")), e.select("user_id", "position", "value"), ["user_id"], "position")
    return both.groupBy("user_id", "probe").agg(F.count("*").alias("n"), F.count_if(F.round("value") % 2 == 0).alias("even"))


@query(
    "q75_capability",
    """
    WITH x AS (SELECT o_orderkey, o_custkey % 4 AS objects, o_orderkey % 5 AS reg, 20000 - o_custkey % 7000 AS size, o_orderpriority AS p FROM orders),
    y AS (SELECT o_orderkey, p, list_sort(list_filter([CASE WHEN reg = 4 THEN 'unsupported_argument_slot' END, CASE WHEN objects > 0 AND size > 16384 THEN 'object_size_exceeds_limit' END,
        CASE WHEN p = '5-LOW' THEN 'unsupported_relation:near' END, CASE WHEN p = '4-NOT SPECIFIED' THEN 'unsupported_unknown_external_dependency:mystery' END], lambda z: z IS NOT NULL)) AS reasons FROM x)
    SELECT o_orderkey, CASE WHEN len(reasons) > 0 THEN 'unsupported' WHEN p = '1-URGENT' THEN 'supported_with_stub' ELSE 'supported' END AS status, reasons FROM y
    """,
)
def capability(spark, sf_dir):
    """Whether the contracts that orders stand for can be run, and why not."""
    o, p = read_table(spark, sf_dir, "orders"), F.col("o_orderpriority")
    size = (20000 - F.col("o_custkey") % 7000).cast("int")
    objects = F.transform(F.slice(F.array(F.lit("a"), F.lit("b"), F.lit("c")), 1, (F.col("o_custkey") % 4).cast("int")), lambda x: F.struct(x.alias("object_id"), size.alias("min_size")))
    register = F.when(F.col("o_orderkey") % 5 == 4, "XMM0").otherwise("RDI")
    relations = F.when(p == "5-LOW", F.array(F.struct(F.lit("near").alias("kind")))).otherwise(F.array(F.struct(F.lit("no_alias").alias("kind"))))
    wanted = F.when(p == "4-NOT SPECIFIED", F.array(F.lit("mystery"), F.lit("memcpy"))).when(p == "1-URGENT", F.array(F.lit("puts"))).otherwise(F.array(F.lit("memcpy")))
    contract = F.struct(F.array(F.struct(register.alias("register"))).alias("arguments"), objects.alias("objects"), relations.alias("relations"), wanted.alias("dependencies"))
    rows = o.select("o_orderkey", contract.alias("k"))
    got = c.capability(F.col("k"), ["memcpy"], ["puts"])
    return rows.select("o_orderkey", got["status"].alias("status"), got["reasons"].alias("reasons"))


@query(
    "q76_truth",
    """
    WITH x AS (SELECT p_partkey, p_size, p_size % 5 AS n FROM part), y AS (SELECT *, CASE WHEN n = 0 THEN [] WHEN n = 1 THEN ['integer'] WHEN n = 2 THEN ['pointer', 'integer'] WHEN n = 3 THEN ['pointer', 'pointer', 'unsupported_float'] ELSE ['integer', 'integer', 'integer', 'integer'] END AS kinds FROM x),
    c AS (SELECT p_partkey, n, kinds, CASE WHEN p_size % 2 = 0 THEN 'integer' ELSE 'void' END AS ret FROM y)
    SELECT p_partkey, kinds AS argument_kinds, ret AS return_kind, list_filter([CASE WHEN n = 4 THEN 'more_than_three_arguments' END, CASE WHEN n = 3 THEN 'multiple_independent_pointer_objects' END, CASE WHEN n = 3 THEN 'unsupported_argument_abi_class' END], lambda z: z IS NOT NULL) AS unsupported,
        CASE WHEN n = 2 AND ret = 'integer' THEN 0 WHEN n = 2 THEN 1 WHEN n = 1 AND ret = 'integer' THEN 2 ELSE -1 END AS hit_rank, n = 2 AND ret = 'integer' AS top1, n = 2 AND ret = 'void' AS return_only_error
    FROM c
    """,
)
def truths(spark, sf_dir):
    """What signatures ask for, and at which rank three fixed candidates match them."""
    p, k = read_table(spark, sf_dir, "part"), F.col("p_size") % 5
    text = lambda *x: F.array(*(F.lit(v) for v in x))
    arguments = F.when(k == 0, F.array().cast("array<string>")).when(k == 1, text("int")).when(k == 2, text("char *", "size_t")).when(k == 3, text("int *", "char[3]", "double")).otherwise(text("int", "int", "long", "char"))
    truth = c.truth(F.concat(F.when(F.col("p_size") % 2 == 0, text("int")).otherwise(text("void")), arguments))
    rows = p.select("p_partkey", truth.alias("t")).select("p_partkey", "t.*")
    guess = [(["pointer", "integer"], "integer"), (["pointer", "integer"], "void"), (["integer"], "integer")]
    guesses = F.array(*(F.struct(F.lit(i).alias("rank"), text(*kinds).alias("argument_kinds"), F.lit(ret).alias("return_kind")) for i, (kinds, ret) in enumerate(guess)))
    hits = c.hit_ranks(p.select("p_partkey", F.inline(guesses)), rows, "p_partkey", "rank")
    return rows.join(hits, "p_partkey").select("p_partkey", "argument_kinds", "return_kind", "unsupported", F.coalesce("hit_rank", F.lit(-1)).alias("hit_rank"), "top1", "return_only_error")


OBSERVED = """
    x AS (SELECT event_id, user_id, event_type, value, lag(event_type) OVER w AS type0, lag(value) OVER w AS value0, lag(event_id) OVER w AS id0 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
"""


@query(
    "q77_compared_observations",
    f"""
    WITH {OBSERVED}
    SELECT event_id, list_filter([CASE WHEN type0 <> event_type THEN 'process_status' END, CASE WHEN type0 = event_type AND event_type = 'signal' THEN 'signal' END, CASE WHEN floor(value) % 4 <> floor(value0) % 4 THEN 'return' END,
        CASE WHEN event_id % 3 <> id0 % 3 THEN 'memory' END, CASE WHEN event_id % 2 <> id0 % 2 THEN 'external_event' END], lambda z: z IS NOT NULL) AS kinds,
        CASE WHEN event_type = 'error' THEN 'void_or_unknown' WHEN event_type = 'click' AND event_id % 2 = 0 THEN 'pointer_outside_known_object' ELSE 'none' END AS reason,
        CASE WHEN event_type = 'error' OR event_type = 'click' AND event_id % 2 = 0 THEN -1 WHEN event_type = 'click' THEN event_id % 5 ELSE floor(value)::BIGINT END AS shown
    FROM x WHERE id0 IS NOT NULL
    """,
)
def compared_observations(spark, sf_dir):
    """In what the observations of neighbouring events of a user differ, and what their return value is worth."""
    from pyspark.sql import Window

    w, i = Window.partitionBy("user_id").orderBy("event_id"), F.col("event_id")
    seen = F.struct(
        F.col("event_type").alias("status"), F.lit(None).cast("int").alias("signal"), F.lit(None).cast("string").alias("fault_address_class"), F.lit(None).cast("int").alias("relative_offset"),
        (F.floor("value") % 4).alias("return_value"), F.create_map(F.lit("o"), (i % 3).cast("string")).alias("objects"), F.create_map(F.lit("g"), i.cast("string")).alias("globals"), F.array((i % 2).cast("string")).alias("external_events"),
    )
    e = read_table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", seen.alias("now")).withColumn("before", F.lag("now").over(w)).where("before IS NOT NULL")
    points = F.col("event_type") == "click"
    value = r.normalized_observation(F.when(F.col("event_type") == "error", "signal").otherwise("returned"), F.when(points, "pointer").otherwise("integer"), F.floor("value"), F.when(points & (i % 2 == 1), "o"), i % 5)
    return e.select("event_id", a.compare_observations("before", "now", F.lit(True), F.lit(False)).alias("kinds"), F.coalesce(value["reason"], F.lit("none")).alias("reason"), F.coalesce(value["value"], F.lit(-1)).alias("shown"))


@query(
    "q78_merged_objects",
    """
    WITH x AS (SELECT c_custkey, c_custkey % 4 AS k, 1 + c_custkey % 9 AS s, c_nationkey AS g FROM customer)
    SELECT c_custkey, CASE k WHEN 0 THEN 3 WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE 3 END AS objects, CASE k WHEN 0 THEN s WHEN 1 THEN greatest(s, 5) WHEN 2 THEN greatest(s, 5, g) ELSE s END::INT AS size,
        CASE WHEN k = 2 THEN ['no_alias_conflict'] WHEN k = 3 THEN ['nonzero_fixed_offset_alias'] ELSE [] END AS errors
    FROM x
    """,
)
def merged_objects(spark, sf_dir):
    """Objects that relations make one, per customer: how many are left, the first one's size, what is wrong."""
    k = F.col("c_custkey") % 4
    thing = lambda name, size: F.struct(F.lit(name).alias("object_id"), size.cast("int").alias("min_size"), F.lit(1).alias("alignment"))
    relation = lambda kind, left, right, offset=None: F.struct(F.lit(kind).alias("kind"), F.lit(left).alias("left"), F.lit(right).alias("right"), F.lit(offset).cast("int").alias("offset"))
    objects = F.array(thing("a", 1 + F.col("c_custkey") % 9), thing("b", F.lit(5)), thing("c", F.col("c_nationkey")))
    relations = F.when(k == 0, F.array(relation("no_alias", "a", "b"))).when(k == 1, F.array(relation("must_alias", "b", "a"))).when(k == 2, F.array(relation("must_alias", "b", "c"), relation("fixed_offset_alias", "a", "b", 0), relation("no_alias", "a", "c"))).otherwise(F.array(relation("fixed_offset_alias", "a", "b", 4)))
    rows = read_table(spark, sf_dir, "customer").select("c_custkey", objects.alias("o"), relations.alias("r"))
    got = r.merged_objects(F.col("o"), F.col("r"))
    return rows.select("c_custkey", F.size(got["objects"]).alias("objects"), got["objects"][0]["min_size"].alias("size"), got["errors"].alias("errors"))


@query(
    "q79_replay",
    """
    SELECT CASE WHEN o_orderkey % 10 = 0 THEN 'missing' WHEN o_orderkey % 10 = 1 THEN 'unexpected' WHEN o_orderkey % 10 = 2 THEN 'changed' ELSE 'match' END AS state, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2
    """,
)
def replay(spark, sf_dir):
    """Whether a replay gave what was frozen: some rows gone, some new, some changed, all with other timings."""
    o, i = read_table(spark, sf_dir, "orders"), F.col("o_orderkey")
    row = lambda price, time: o.select("o_orderkey", price.alias("price"), "o_orderstatus", time.alias("elapsed"))
    frozen = row(F.col("o_totalprice"), F.lit(1)).where(i % 10 != 1)
    again = row(F.when(i % 10 == 2, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")), F.lit(2)).where(i % 10 != 0)
    return a.replay(frozen, again, ["o_orderkey"], ["elapsed"]).join(o.select("o_orderkey", "o_orderpriority"), "o_orderkey").groupBy("state", "o_orderpriority").agg(F.count("*").alias("n"))


@query(
    "q80_metadata_metrics",
    """
    WITH x AS (SELECT user_id, event_id % 5 > 0 AS has, event_id % 9 AS tests, CASE WHEN event_id % 4 > 0 THEN event_id % 7 END AS executions, event_id % 3 = 0 AS frozen FROM events)
    SELECT user_id, count(*) AS total, count(*) FILTER (WHERE has) AS tests_eligible, coalesce(sum(tests) FILTER (WHERE has), 0)::DOUBLE AS tests_sum, coalesce(max(tests) FILTER (WHERE has), -1)::DOUBLE AS tests_max,
        count(executions) FILTER (WHERE has) AS executions_eligible, coalesce(sum(executions) FILTER (WHERE has), 0)::DOUBLE AS executions_sum, count(*) FILTER (WHERE has) AS frozen_eligible, (count(*) FILTER (WHERE has AND frozen))::DOUBLE AS frozen_sum
    FROM x GROUP BY user_id
    """,
)
def metadata_metrics(spark, sf_dir):
    """Numbers and flags of runs' metadata per user; a run without metadata has no value."""
    i = F.col("event_id")
    number = {"generated_tests": i % 9, "executions": F.when(i % 4 > 0, i % 7), "counterexamples": F.lit(0), "repair_iterations": F.lit(0)}
    flag = {"harness_frozen": i % 3 == 0, "candidate_compile": F.lit(True), "candidate_link": F.lit(None).cast("boolean"), "differential_pass": F.lit(False)}
    metadata = F.when(i % 5 > 0, F.struct(*(v.alias(k) for k, v in {**number, **flag}.items())))
    rows = read_table(spark, sf_dir, "events").select("user_id", metadata.alias("metadata"))
    rows = m.with_metrics(rows, m.METADATA, None)
    out = rows.groupBy("user_id").agg(F.count("*").alias("total"), *(v.alias(f"{x.name}_{k}") for x in m.METADATA if x.name in ("generated_tests", "executions", "harness_frozen") for k, v in m.metadata_aggregates(x.name).items()))
    short = lambda of, name: [F.col(f"{of}_{k}").alias(f"{name}_{k}") for k in ("eligible", "sum")]
    return out.select("user_id", "total", *short("generated_tests", "tests"), F.coalesce("generated_tests_max", F.lit(-1.0)).alias("tests_max"), *short("executions", "executions"), *short("harness_frozen", "frozen"))


@query(
    "q81_public_requests",
    """
    SELECT doc_id, '' AS assembly, CASE WHEN doc_id % 3 = 0 THEN 'none' ELSE lang END AS pseudocode, CASE WHEN doc_id % 3 = 0 THEN 'pseudocode_missing' WHEN length(trim(source)) = 0 THEN 'source_missing' ELSE 'none' END AS reason FROM documents
    """,
)
def public_requests(spark, sf_dir):
    """Documents as requests of a backend that may see pseudocode only, and the first input that is missing."""
    d = read_table(spark, sf_dir, "documents")
    rows = d.select("doc_id", "source", F.struct(F.col("text"), F.lit("intel").alias("syntax")).alias("assembly"), F.when(F.col("doc_id") % 3 > 0, F.col("lang")).alias("pseudocode"), F.struct("text").alias("private_payload"))
    out = sel.public_request(rows, ["pseudocode"])
    return out.select("doc_id", F.col("assembly.text").alias("assembly"), F.coalesce("pseudocode", F.lit("none")).alias("pseudocode"), F.coalesce(sel.missing_input({"pseudocode": F.col("pseudocode"), "source": F.col("source")}), F.lit("none")).alias("reason"))


@query(
    "q82_matches",
    """
    WITH f AS (SELECT o_custkey, min(o_orderkey) AS first, max(o_orderkey) AS last FROM orders GROUP BY 1)
    SELECT c_custkey, coalesce(a.o_totalprice, -1) AS first_price, coalesce(b.o_orderstatus, '-') AS last_status, CASE WHEN f.first IS NULL THEN 'left' ELSE 'both' END AS side
    FROM customer LEFT JOIN f ON c_custkey = o_custkey LEFT JOIN orders a ON a.o_orderkey = f.first LEFT JOIN orders b ON b.o_orderkey = f.last
    """,
)
def matches(spark, sf_dir):
    """The first order and the last of each customer, and customers that only one of the two tables has."""
    customers, o = read_table(spark, sf_dir, "customer").select("c_custkey"), read_table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey")
    first = j.first_match(customers, o.select("c_custkey", "o_orderkey", "o_totalprice"), ["c_custkey"], "o_orderkey")
    last = j.keep_last(o.select("c_custkey", "o_orderkey", "o_orderstatus"), ["c_custkey"], "o_orderkey").select("c_custkey", "o_orderstatus")
    lone = j.set_difference(customers, o.join(customers, "c_custkey", "left_semi"), ["c_custkey"])
    out = first.join(last, "c_custkey", "left").join(lone, "c_custkey", "left")
    return out.select("c_custkey", F.coalesce("o_totalprice", F.lit(-1.0)).alias("first_price"), F.coalesce("o_orderstatus", F.lit("-")).alias("last_status"), F.coalesce("side", F.lit("both")).alias("side"))


@query(
    "q83_bytes",
    """
    WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_partkey % 4 AS k, (l_suppkey % 6)::INT AS n, l_quantity::INT AS q FROM lineitem)
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN n = 0 THEN '' WHEN k = 0 THEN repeat('00', n) WHEN k = 1 THEN repeat('a5', n) WHEN k = 2 THEN 'ff' || repeat('00', n - 1) ELSE repeat('00', n - 1) || 'ff' END AS pattern,
        CASE WHEN k = 3 THEN -1 ELSE n END AS bytes, q % 7 - 1 >= 0 AND q % 7 - 1 < q % 11 AND q % 11 <= n AS inside
    FROM x
    """,
)
def byte_patterns(spark, sf_dir):
    """Byte patterns by kind and length, the bytes of a hex text, and ranges that lie within a size."""
    rows, k, size, q = read_table(spark, sf_dir, "lineitem"), F.col("l_partkey") % 4, F.col("l_suppkey") % 6, F.col("l_quantity").cast("int")
    kind = F.element_at(F.array(*(F.lit(x) for x in ("zero", "repeat_a5", "pulse_start", "pulse_end"))), (1 + k).cast("int"))
    pattern = n.byte_pattern(kind, size)
    text = F.when(k == 3, F.concat(pattern, F.lit("0"))).otherwise(pattern)
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", pattern.alias("pattern"), F.coalesce(F.length(n.hex_bytes(text)), F.lit(-1)).alias("bytes"), n.range_ok(q % 7 - 1, q % 11, size).alias("inside"))


@query(
    "q84_symbols",
    """
    WITH s AS (SELECT o_custkey AS object, 'f' || (o_orderkey % 3) AS name, CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 5 = 0 THEN '.data' ELSE '.text' END AS section, CASE o_orderstatus WHEN 'F' THEN 'FUNC' WHEN 'O' THEN 'OBJECT' ELSE 'NOTYPE' END AS type,
        CASE WHEN o_orderkey % 2 = 0 THEN 'GLOBAL' ELSE 'LOCAL' END AS bind, o_orderkey % 100 AS size, o_orderkey AS position FROM orders),
    t AS (SELECT *, row_number() OVER (PARTITION BY object ORDER BY type = 'FUNC' DESC, bind = 'GLOBAL' DESC, size DESC, position) AS r FROM s WHERE section IS NOT NULL AND type IN ('FUNC', 'NOTYPE') AND name = 'f' || (object % 3)),
    g AS (SELECT object, count(*) AS objects FROM s WHERE section = '.data' AND type = 'OBJECT' AND (bind = 'GLOBAL' OR name = 'f1') GROUP BY 1)
    SELECT c_custkey AS object, coalesce(t.position, -1) AS target, coalesce(g.objects, 0) AS objects FROM customer LEFT JOIN t ON t.object = c_custkey AND t.r = 1 LEFT JOIN g ON g.object = c_custkey
    """,
)
def symbols(spark, sf_dir):
    """The target symbol of each object and how many of its global objects are visible or referenced."""
    i = F.col("o_orderkey")
    rows = read_table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("object"), F.concat(F.lit("f"), i % 3).alias("name"), F.when(i % 7 == 0, None).when(i % 5 == 0, ".data").otherwise(".text").alias("section"),
        F.when(F.col("o_orderstatus") == "F", "FUNC").when(F.col("o_orderstatus") == "O", "OBJECT").otherwise("NOTYPE").alias("type"), F.when(i % 2 == 0, "GLOBAL").otherwise("LOCAL").alias("bind"), (i % 100).alias("size"), i.alias("position"),
    )
    objects = read_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("object"))
    target = c.target_symbol(rows, objects.select("object", F.concat(F.lit("f"), F.col("object") % 3).alias("name")), "object").select("object", F.col("position").alias("target"))
    found = c.global_objects(rows, objects.select("object", F.lit("f1").alias("name")), "object").groupBy("object").agg(F.count("*").alias("objects"))
    return objects.join(target, "object", "left").join(found, "object", "left").select("object", F.coalesce("target", F.lit(-1)).alias("target"), F.coalesce("objects", F.lit(0)).alias("objects"))


@query(
    "q85_aligned_chunks",
    """
    WITH x AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL), y AS (SELECT doc_id, list_transform(lines, lambda l: regexp_replace(l, '\\s+', '', 'g')) AS b, len(lines) AS n FROM x)
    SELECT doc_id, CASE WHEN n < 2 THEN -1 ELSE coalesce(list_position(list_transform(range(1, n), lambda i: b[i:i + 1] = b[n - 1:n]), true), 0)::INT - 1 END AS start FROM y
    """,
)
def aligned_chunks(spark, sf_dir):
    """Where the last two lines of every document first stand in it, white space aside."""
    d = read_table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.split("text", "\n").alias("lines"))
    chunk = F.when(F.size("lines") < 2, F.array().cast("array<string>")).otherwise(F.transform(F.slice("lines", -2, 2), lambda x: F.regexp_replace(x, " ", "  ")))
    return d.select("doc_id", s.align(chunk, F.col("lines")).alias("start"))


@query(
    "q86_provenance",
    """
    SELECT lang AS dataset_id, 'selection.json' AS path, 'h' AS content_hash, count(*) AS entries, min(doc_id) AS first FROM documents GROUP BY lang
    """,
)
def provenance(spark, sf_dir):
    """Entries that a manifest selects per dataset, and the first of each."""
    d = read_table(spark, sf_dir, "documents").withColumnRenamed("lang", "dataset_id")
    first = s.first_mention(d, ["dataset_id"], "doc_id", "doc_id").select("dataset_id", F.col("doc_id").alias("first"))
    return r.provenance(d, "dataset_id", "selection.json", "h").join(first, "dataset_id")


@query(
    "q87_contract_violations",
    """
    WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_partkey % 4 AS slot, l_suppkey % 4 AS more, l_discount AS d, l_returnflag AS f FROM lineitem)
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, list_filter([CASE WHEN slot = 1 THEN 'duplicate_slot' END, CASE WHEN slot > 1 THEN 'slots_not_ascending' END, CASE WHEN more = 3 THEN 'too_many_objects' END, CASE WHEN more >= 2 THEN 'duplicate_object' END,
        CASE WHEN more = 0 THEN 'unknown_object_reference' END, CASE WHEN more > 0 THEN 'object_without_register' END, CASE WHEN f = 'N' THEN 'unknown_relation' END, CASE WHEN f = 'R' THEN 'nonzero_alias_offset' END, CASE WHEN d > 0.05 THEN 'confidence_out_of_range' END], lambda z: z IS NOT NULL) AS broken
    FROM x
    """,
)
def contract_violations(spark, sf_dir):
    """What is wrong with the contracts that line items stand for."""
    rows, more = read_table(spark, sf_dir, "lineitem"), F.col("l_suppkey") % 4
    argument = lambda slot, register, ref, confidence: F.struct(slot.cast("int").alias("slot"), F.lit(register).alias("register"), F.lit(ref).alias("object_ref"), confidence.alias("confidence"))
    arguments = F.array(argument(F.col("l_partkey") % 4, "RDI", "o1", F.lit(0.5)), argument(F.lit(1), "RSI", None, F.when(F.col("l_discount") > 0.05, 1.5).otherwise(1.0)))
    thing = lambda name, register: F.struct(F.lit(name).alias("object_id"), F.lit(register).alias("argument_slot"), F.lit(1).alias("min_size"))
    objects = F.slice(F.array(thing("o1", "RCX"), thing("o1", "RDI"), thing("o2", "RDI"), thing("o3", "RDI")), 1, F.when(more == 3, 4).otherwise(more).cast("int"))
    relation = F.when(F.col("l_returnflag") == "N", F.struct(F.lit("near").alias("kind"), F.lit(0).alias("offset"))).when(F.col("l_returnflag") == "R", F.struct(F.lit("fixed_offset_alias").alias("kind"), F.lit(8).alias("offset"))).otherwise(F.struct(F.lit("no_alias").alias("kind"), F.lit(0).alias("offset")))
    keyed = rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.struct(arguments.alias("arguments"), objects.alias("objects"), F.array(relation).alias("relations")).alias("k"))
    return keyed.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", c.violations(F.col("k")).alias("broken"))


@query(
    "q88_typed_data",
    """
    WITH x AS (SELECT event_id, user_id, event_id % 3 AS k FROM events)
    SELECT event_id, CASE k WHEN 0 THEN user_id::VARCHAR WHEN 1 THEN '[' || (user_id % 256) || ', ' || (user_id // 256 % 256) || ']' ELSE 'Not Found L' || event_id || '!' END AS shown FROM x
    """,
)
def typed_data(spark, sf_dir):
    """Numbers decoded at labels of read-only data: a word, two bytes, and a label that is not there."""
    k, user = F.col("event_id") % 3, F.col("user_id").cast("int")
    little = F.concat(*(F.lpad(F.lower(F.hex(F.shiftright(user, 8 * b).bitwiseAND(255))), 2, "0") for b in range(4)))
    rows = read_table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("ffff"), little).alias("data"), F.lit(4096).cast("long").alias("base"), F.when(k < 2, F.lit(4098)).cast("long").alias("at"), F.concat(F.lit("L"), "event_id").alias("label"), F.when(k == 1, "u8[2]").otherwise("u32").alias("kind"))
    return rows.select("event_id", t.decode_rodata("data", "base", "at", "label", "kind").alias("shown"))
