"""Queries over rounds, input cases, repairs, and files that Spark derives from the tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyrail.operators import cases as c
from tallyrail.operators import repairs as rp
from tallyrail.operators import replays as rl
from tallyrail.operators import retrieval as rt
from tallyrail.operators import rounds as rd
from tallyrail.plans.catalog import query
from tallyrail.session import read_table, scratch
from tallyrail.sources import arrays, arrow, readers, snapshots
from tallyrail.streaming import moves


@query(
    "q56_json_array",
    """
    SELECT o_orderkey, o_custkey, o_orderpriority, round(o_totalprice * 100)::BIGINT AS cents, row_number() OVER (ORDER BY o_orderkey) - 1 AS position FROM orders
    """,
)
def json_array(spark, sf_dir):
    """Orders written as JSON arrays and read back by split, numbered over all files."""
    path = f"{scratch(spark)}/orders"
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"))
    arrays.write_array(orders, F.to_json(F.struct("*")), path, ["o_orderkey"])
    rows = arrays.read_array(spark, path, "o_orderkey long, o_custkey long, o_orderpriority string, cents long")
    sizes, before = {r["file"]: r["n"] for r in rows.groupBy("file").agg(F.count("*").alias("n")).collect()}, {}
    for file in sorted(sizes):  # a row per file
        before[file] = sum(sizes[f] for f in before)
    offset = F.create_map(*(F.lit(x) for pair in before.items() for x in pair))[F.col("file")] if before else F.lit(0)
    return rows.select("e.*", (F.col("ordinal") + offset).cast("long").alias("position"))


@query(
    "q57_hash_tree",
    """
    WITH l0 AS (SELECT row_number() OVER (ORDER BY path) - 1 AS node, 1 AS files, sha256(path || ':' || sha256(html)) AS digest FROM (SELECT printf('%012d', page_id) || ' ' || url AS path, html FROM pages)),
    l1 AS (SELECT node // 16 AS node, sum(files) AS files, sha256(string_agg(digest, chr(10) ORDER BY node)) AS digest FROM l0 GROUP BY 1),
    l2 AS (SELECT node // 16 AS node, sum(files) AS files, sha256(string_agg(digest, chr(10) ORDER BY node)) AS digest FROM l1 WHERE (SELECT count(*) FROM l1) > 1 GROUP BY 1),
    l3 AS (SELECT node // 16 AS node, sum(files) AS files, sha256(string_agg(digest, chr(10) ORDER BY node)) AS digest FROM l2 WHERE (SELECT count(*) FROM l2) > 1 GROUP BY 1),
    l4 AS (SELECT node // 16 AS node, sum(files) AS files, sha256(string_agg(digest, chr(10) ORDER BY node)) AS digest FROM l3 WHERE (SELECT count(*) FROM l3) > 1 GROUP BY 1),
    l5 AS (SELECT node // 16 AS node, sum(files) AS files, sha256(string_agg(digest, chr(10) ORDER BY node)) AS digest FROM l4 WHERE (SELECT count(*) FROM l4) > 1 GROUP BY 1),
    l6 AS (SELECT node // 16 AS node, sum(files) AS files, sha256(string_agg(digest, chr(10) ORDER BY node)) AS digest FROM l5 WHERE (SELECT count(*) FROM l5) > 1 GROUP BY 1)
    SELECT 1 AS level, node, files::BIGINT AS files, digest FROM l1 UNION ALL SELECT 2, node, files::BIGINT, digest FROM l2 UNION ALL SELECT 3, node, files::BIGINT, digest FROM l3
    UNION ALL SELECT 4, node, files::BIGINT, digest FROM l4 UNION ALL SELECT 5, node, files::BIGINT, digest FROM l5 UNION ALL SELECT 6, node, files::BIGINT, digest FROM l6
    """,
)
def hash_tree(spark, sf_dir):
    """All levels of the hash tree over the pages as files, sixteen to a node."""
    pages = read_table(spark, sf_dir, "pages")
    files = pages.select(F.format_string("%012d %s", "page_id", "url").alias("path"), F.col("html").cast("binary").alias("content"))
    return readers.hash_tree(files, scratch(spark), 16)


def _inputs(orders):
    """An input per order, and whether it fails: the order's own numbers as registers and bytes."""
    size = (4 + 2 * (F.col("o_orderkey") % 3)).cast("int")
    content = F.when(F.col("o_orderkey") % 4 == 0, F.array_join(F.array_repeat(F.lit("00"), size), "")).otherwise(F.substr(F.sha2(F.col("o_orderkey").cast("string"), 256), F.lit(1), 2 * size))
    number = lambda v: F.struct(v.cast("long").alias("value"), F.lit(None).cast("string").alias("object_ref"))
    gpr = F.create_map(F.lit("RDI"), number(F.col("o_custkey") % 3), F.lit("RDX"), number(F.dayofmonth("o_orderdate") % 2), F.lit("RSI"), F.struct(F.lit(None).cast("long").alias("value"), F.lit("obj").alias("object_ref")))
    thing = F.struct(size.alias("size"), content.alias("bytes_hex"), F.when(F.col("o_orderstatus") == "F", "left").otherwise("right").alias("placement"), F.lit(4).alias("min_size"))
    return orders.select("o_orderkey", F.concat(F.lit("c"), F.col("o_custkey") % 10).alias("contract_id"), F.col("o_custkey").alias("seed"), gpr.alias("gpr"), F.create_map(F.lit("obj"), thing).alias("objects"))


def _fails(gpr, objects):
    """Whether an input shows the fault: the second integer is set, and the object starts with a byte or is placed left."""
    thing = objects["obj"]
    return (gpr["RDX"]["value"] != 0) & (~thing["bytes_hex"].startswith("00") | (thing["placement"] == "left"))


#: Orders whose inputs and verdicts a task sorts in its memory.
ORDERS_A_TASK = 200_000


@query(
    "q58_minimized",
    """
    WITH o AS (SELECT o_orderkey, 'c' || (o_custkey % 10) AS contract, o_custkey AS seed, o_custkey % 3 AS rdi, day(o_orderdate) % 2 AS rdx, 4 + 2 * (o_orderkey % 3) AS size, o_orderstatus = 'F' AS lefty,
        CASE WHEN o_orderkey % 4 = 0 THEN repeat('00', 4 + 2 * (o_orderkey % 3)) ELSE substr(sha256(o_orderkey::VARCHAR), 1, 2 * (4 + 2 * (o_orderkey % 3))) END AS b FROM orders),
    f AS (SELECT *, regexp_matches(b, '[^0]') AS has_some FROM o WHERE rdx <> 0 AND (NOT starts_with(b, '00') OR lefty)),
    r AS (SELECT *, CASE WHEN lefty AND has_some THEN repeat('00', 4) ELSE substr(b, 1, 8) END AS bytes_hex, CASE WHEN lefty THEN 'left' ELSE 'right' END AS placement FROM f),
    -- Placing right fails still only if the bytes were kept and start with one that is set, which a left object's are not.
    t AS (SELECT *, '{"contract_id":"' || contract || '","globals":{},"gpr":{"RDI":0,"RDX":' || rdx || ',"RSI":{"object_ref":"obj"}},"objects":{"obj":{"bytes_hex":"' || bytes_hex
        || '","placement":"' || placement || '","size":4}},"schema_version":1,"seed":' || seed || ',"virtual_read_bytes":""}' AS txt FROM r)
    SELECT o_orderkey, 0 AS rdi, rdx, 4 AS size, bytes_hex, placement, (rdi <> 0)::INT + 1 + has_some::INT + (size > 4)::INT + lefty::INT AS attempts,
        (rdi <> 0)::INT + (has_some AND lefty)::INT + (size > 4)::INT AS kept, sha256(txt) AS input_hash FROM t
    """,
)
def minimized(spark, sf_dir):
    """Failing inputs of all orders made simpler, verdicts from a table of what was observed."""
    orders = read_table(spark, sf_dir, "orders")
    # Inputs and verdicts are made of orders that are partitioned by their key already: only these few columns are shuffled.
    ways = max(int(spark.conf.get("spark.sql.shuffle.partitions")), orders.count() // ORDERS_A_TASK + 1)
    cases = _inputs(orders.select("o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus").repartition(ways, "o_orderkey"))
    cases = cases.where(_fails(F.col("gpr"), F.col("objects")))
    # What was observed: every input that some of the five simplifications lead to.
    some = cases
    changed = (("zero_integer", "RDI"), ("zero_integer", "RDX"), ("zero_object", "obj"), ("shrink_object", "obj"), ("normalize_placement", "obj"))
    for kind, name in changed:
        step = F.struct(F.lit(kind).alias("kind"), F.lit(name).alias("name"))
        gpr, objects = rd.simpler(step, F.col("gpr"), F.col("objects"))
        now, then = F.struct("gpr", "objects"), F.struct(gpr.alias("gpr"), objects.alias("objects"))
        both = F.explode(F.when(rd.changes(step, F.col("gpr"), F.col("objects")), F.array(now, then)).otherwise(F.array(now)))
        some = some.withColumn("_x", both).withColumns({"gpr": F.col("_x.gpr"), "objects": F.col("_x.objects")}).drop("_x")
    verdicts = some.select("o_orderkey", rd.input_hash().alias("input_hash"), _fails(F.col("gpr"), F.col("objects")).alias("fails"))
    same = cases.dropna(subset=["o_orderkey"]).groupBy("o_orderkey").count().agg(F.max("count")).first()[0] or 0  # 1 where keys are unique
    got = rd.minimized(cases, verdicts, ["o_orderkey"], scratch(spark), most=same * 2 ** len(changed))
    thing = F.col("objects")["obj"]
    return got.select(
        "o_orderkey", F.col("gpr")["RDI"]["value"].alias("rdi"), F.col("gpr")["RDX"]["value"].alias("rdx"), thing["size"].alias("size"), thing["bytes_hex"].alias("bytes_hex"), thing["placement"].alias("placement"),
        F.size("log").alias("attempts"), F.size(F.filter("log", lambda x: x["kept"])).alias("kept"), rd.input_hash().alias("input_hash"),
    )


@query(
    "q59_probe_rounds",
    """
    WITH k AS (SELECT DISTINCT user_id, 14 + user_id % 5 AS budget, 0.70 + 0.07 * (user_id % 4) AS risk_limit FROM events),
    e AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
    t AS (SELECT e.*, (n - 1) // 4 + 1 AS round, budget, risk_limit, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) = 1 AS news FROM e JOIN k USING (user_id) WHERE n <= budget),
    r AS (SELECT user_id, g.round, any_value(budget) AS budget, any_value(risk_limit) AS risk_limit, count(event_id) AS e, count(*) FILTER (WHERE event_type = 'error') AS f, count(*) FILTER (WHERE news) AS s
          FROM (SELECT user_id, unnest(range(1, 9)) AS round, budget, risk_limit FROM k) g LEFT JOIN (SELECT user_id, round, event_id, event_type, news FROM t) USING (user_id, round) GROUP BY ALL),
    u AS (SELECT user_id, round, budget, risk_limit, sum(e) OVER w AS executed, sum(f) OVER w AS failures, sum(s) OVER w AS signatures, round - coalesce(max(CASE WHEN s > 0 THEN round END) OVER w, 0) AS quiet
          FROM r WINDOW w AS (PARTITION BY user_id ORDER BY round ROWS UNBOUNDED PRECEDING)),
    p AS (SELECT *, failures / executed::DOUBLE AS x, 1.959963984540054 * 1.959963984540054 AS z2 FROM u),
    b AS (SELECT *, least(1.0, (x + z2 / (2 * executed::DOUBLE)) / (1 + z2 / executed::DOUBLE) + 1.959963984540054 * sqrt(x * (1 - x) / executed::DOUBLE + z2 / (4 * executed::DOUBLE * executed::DOUBLE)) / (1 + z2 / executed::DOUBLE)) AS high FROM p),
    s AS (SELECT *, CASE WHEN executed >= budget THEN 'budget_exhausted' WHEN high > risk_limit THEN 'risk_limit_exceeded' WHEN quiet >= 2 THEN 'no_new_information' WHEN round = 8 THEN 'round_limit' END AS stop_reason FROM b)
    SELECT user_id, round AS rounds, executed::BIGINT AS executed, failures::BIGINT AS failures, signatures::BIGINT AS signatures, stop_reason
    FROM s WHERE stop_reason IS NOT NULL QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY round) = 1
    """,
)
def probe_rounds(spark, sf_dir):
    """Probing of every user's events in rounds of four, until budget, risk or want of news ends it."""
    events = read_table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    user = F.col("user_id")
    keys = events.select("user_id").distinct().select("user_id", (14 + user % 5).alias("budget"), F.expr("CAST(0.70 + 0.07 * (user_id % 4) AS DOUBLE)").alias("risk_limit"))
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    seen = events.select("user_id", (F.floor((n - 1) / 4) + 1).alias("round"), F.col("event_id").alias("ordinal"), F.col("event_type").alias("signature"), (F.col("event_type") == "error").alias("fails"))
    return rd.probe_rounds(keys, seen, "user_id", scratch(spark), rounds=8)


@query(
    "q60_input_cases",
    """
    WITH o AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity::INT AS q, l_returnflag AS f, l_linestatus AS s FROM lineitem),
    v AS (SELECT *, q % 9 - 1 AS len, 1 + l_partkey % 6 AS size, substr(sha256(l_suppkey::VARCHAR), 1, (2 * (1 + l_partkey % 6) + (CASE WHEN l_suppkey % 11 = 0 THEN 1 WHEN l_suppkey % 13 = 0 THEN 2 ELSE 0 END))::INT) AS b FROM o)
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, list_filter([
        CASE WHEN f = 'N' AND s = 'F' THEN 'other_contract' END,
        CASE WHEN l_partkey % 17 = 0 THEN 'missing_register:RDX' END,
        CASE WHEN l_partkey % 17 <> 0 AND l_partkey % 19 = 0 THEN 'other_object:RDX' END,
        CASE WHEN size < 2 THEN 'size_below_least:a' END,
        CASE WHEN length(b) % 2 = 1 THEN 'bytes_not_hexadecimal:a' END,
        CASE WHEN length(b) % 2 = 0 AND length(b) <> 2 * size THEN 'bytes_of_other_length:a' END,
        CASE WHEN f = 'R' AND l_suppkey % 7 = 0 THEN 'unknown_placement:a' END,
        CASE WHEN l_partkey % 17 <> 0 AND l_partkey % 19 = 0 THEN 'missing_object:z' WHEN l_partkey % 17 <> 0 AND l_suppkey % 5 <> 0 AND l_suppkey % 3 = 0 THEN 'missing_object:b' END,
        CASE WHEN len < 0 OR len > size THEN 'length_not_within:a' END,
        CASE WHEN l_partkey % 17 <> 0 AND l_partkey % 19 <> 0 AND l_suppkey % 5 = 0 THEN 'null_on_one_side:no_alias' END,
        CASE WHEN f = 'A' AND l_suppkey % 23 = 0 THEN 'globals_given' END], lambda x: x IS NOT NULL) AS errors
    FROM v
    """,
)
def input_cases(spark, sf_dir):
    """Cases made of line items against one contract of a length, and two objects that must not be one."""
    part, supp, flag = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_returnflag")
    contract = F.expr(f"""CAST(named_struct('contract_id', 'k', 'arguments', array(named_struct('slot', 'RDI', 'kind', 'integer', 'object_ref', CAST(NULL AS STRING)),
        named_struct('slot', 'RSI', 'kind', 'pointer', 'object_ref', 'a'), named_struct('slot', 'RDX', 'kind', 'pointer', 'object_ref', 'b')),
        'objects', array(named_struct('object_id', 'a', 'min_size', 2), named_struct('object_id', 'b', 'min_size', 1)),
        'relations', array(named_struct('kind', 'length_within', 'left', CAST(NULL AS STRING), 'right', CAST(NULL AS STRING), 'offset', CAST(NULL AS INT), 'length_slot', 'rdi', 'object_ref', 'a'),
        named_struct('kind', 'no_alias', 'left', 'a', 'right', 'b', 'offset', CAST(NULL AS INT), 'length_slot', CAST(NULL AS STRING), 'object_ref', CAST(NULL AS STRING)))) AS {c.CONTRACT})""")
    size = (1 + part % 6).cast("int")
    extra = F.when(supp % 11 == 0, 1).when(supp % 13 == 0, 2).otherwise(0)
    register = lambda value, ref, null: F.struct(value.cast("long").alias("value"), ref.cast("string").alias("object_ref"), null.cast("boolean").alias("is_null"))
    no = F.lit(None)
    null_b = supp % 5 == 0
    rdx = F.when(part % 19 == 0, register(no, F.lit("z"), F.lit(False))).when(null_b, register(no, no, F.lit(True))).otherwise(register(no, F.lit("b"), F.lit(False)))
    gpr = F.map_concat(
        F.create_map(F.lit("RDI"), register(F.col("l_quantity").cast("int") % 9 - 1, no, F.lit(False)), F.lit("RSI"), register(no, F.lit("a"), F.lit(False))),
        F.when(part % 17 == 0, F.create_map().cast("map<string,struct<value:bigint,object_ref:string,is_null:boolean>>")).otherwise(F.create_map(F.lit("RDX"), rdx)),
    )
    thing = lambda size, content, placement: F.struct(size.alias("size"), content.alias("bytes_hex"), placement.alias("placement"))
    first = F.create_map(F.lit("a"), thing(size, F.substr(F.sha2(supp.cast("string"), 256), F.lit(1), (2 * size + extra).cast("int")), F.when((flag == "R") & (supp % 7 == 0), "middle").otherwise("left")))
    second = F.when(supp % 3 == 0, F.create_map().cast("map<string,struct<size:int,bytes_hex:string,placement:string>>")).otherwise(F.create_map(F.lit("b"), thing(F.lit(1), F.lit("ff"), F.lit("right"))))
    case = F.struct(
        F.lit(1).alias("schema_version"), F.when((flag == "N") & (F.col("l_linestatus") == "F"), "x").otherwise("k").alias("contract_id"), gpr.alias("gpr"), F.map_concat(first, second).alias("objects"),
        F.when((flag == "A") & (supp % 23 == 0), F.create_map(F.lit("g"), F.lit("1"))).alias("globals"), F.lit(0).cast("long").alias("seed"), F.lit("").alias("virtual_read_bytes"),
    )
    rows = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", contract.alias("k"), case.alias("c"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", c.case_errors(F.col("k"), F.col("c")).alias("errors"))


@query(
    "q61_diagnosed_declarations",
    """
    WITH d AS (SELECT o_custkey AS file, o_orderkey % 500 * 7 AS first_line, o_orderkey % 500 * 7 + o_orderkey % 90 AS last_line, o_orderkey FROM orders),
    l AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_partkey % (SELECT 1 + max(o_custkey) FROM orders) AS file, l_suppkey * 31 % 3600 AS line FROM lineitem),
    m AS (SELECT l.*, d.o_orderkey, row_number() OVER (PARTITION BY l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey ORDER BY d.last_line - d.first_line, -d.first_line, d.o_orderkey) AS r
          FROM l JOIN d ON l.file = d.file AND l.line BETWEEN d.first_line AND d.last_line)
    SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey, l.line, coalesce(d.first_line, -1) AS first_line, coalesce(d.last_line, -1) AS last_line
    FROM l LEFT JOIN m ON m.r = 1 AND (m.l_orderkey, m.l_linenumber, m.l_partkey, m.l_suppkey) = (l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey) LEFT JOIN d ON d.o_orderkey = m.o_orderkey
    """,
)
def diagnosed_declarations(spark, sf_dir):
    """The innermost declaration that holds the line of each diagnostic, files being customers."""
    o = read_table(spark, sf_dir, "orders")
    first = F.col("o_orderkey") % 500 * 7
    declarations = o.select(F.lit(0).alias("sample"), F.col("o_custkey").alias("file"), first.alias("first_line"), (first + F.col("o_orderkey") % 90).alias("last_line"))
    files = o.agg(F.max("o_custkey")).first()[0] + 1
    line = read_table(spark, sf_dir, "lineitem").select(F.lit(0).alias("sample"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.col("l_partkey") % files).alias("file"), (F.col("l_suppkey") * 31 % 3600).alias("line"))
    return rp.declared_at(line, declarations, ["sample"]).drop("sample", "file").na.fill(-1, ["first_line", "last_line"])


@query(
    "q62_repairs",
    """
    WITH p AS (SELECT p_partkey, replace(p_name, ' ', '_') || '_' || (p_partkey % 50) AS name, p_size, p_type, CASE WHEN p_partkey % 4 = 0 THEN ' extern int ' || replace(p_name, ' ', '_') || '_' || (p_partkey % 50) || '; '
        WHEN p_partkey % 4 = 1 THEN 'extern int other;' END AS declaration FROM part),
    s AS (SELECT *, 'void f' || (p_partkey % 20) || '(void) { ' || name || ' = 1; }' AS source, CASE WHEN p_size % 3 = 0 THEN 'error: ''' || name || ''' undeclared' WHEN p_size % 3 = 1 THEN 'error: use of undeclared identifier ''' || name || '''' ELSE 'error: expected expression' END AS diagnostics FROM p),
    r AS (SELECT *, declaration IS NOT NULL AND p_partkey % 4 = 0 AND p_size % 3 < 2 AS declares FROM s),
    a AS (SELECT p_partkey, CASE WHEN declares THEN 0 WHEN p_type = 'ECONOMY' THEN 1 ELSE 1 END AS repairer, CASE WHEN declares THEN trim(declaration) || chr(10) || source WHEN p_type = 'ECONOMY' THEN 'typedef int t;' || chr(10) || source ELSE '' END AS revised,
        NOT declares AND p_type <> 'ECONOMY' AS abstain, source FROM r),
    k AS (SELECT *, CASE WHEN NOT abstain THEN sha256(revised) END AS revision FROM a)
    SELECT p_partkey, repairer, abstain, revision, CASE WHEN abstain THEN 'abstained' WHEN p_partkey % 10 = 0 THEN 'duplicate' ELSE 'new' END AS state FROM k
    """,
)
def repairs(spark, sf_dir):
    """The first repair that does not abstain for a candidate of each part, with those that were tried before."""
    p = read_table(spark, sf_dir, "part")
    name = F.concat(F.replace(F.col("p_name"), F.lit(" "), F.lit("_")), F.lit("_"), F.col("p_partkey") % 50)
    key = F.col("p_partkey")
    declaration = F.when(key % 4 == 0, F.concat(F.lit(" extern int "), name, F.lit("; "))).when(key % 4 == 1, "extern int other;")
    said = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("error: '"), name, F.lit("' undeclared"))).when(F.col("p_size") % 3 == 1, F.concat(F.lit("error: use of undeclared identifier '"), name, F.lit("'"))).otherwise("error: expected expression")
    rows = p.select("p_partkey", "p_type", F.concat(F.lit("void f"), key % 20, F.lit("(void) { "), name, F.lit(" = 1; }")).alias("source"), said.alias("diagnostics"), F.array(F.struct(name.alias("name"), declaration.alias("public_c_declaration"))).alias("facts"))
    text = lambda *x: F.array(*(F.lit(t) for t in x))
    other = F.struct(F.concat(F.lit("typedef int t;\n"), F.col("source")).alias("revised_source"), text("typedef").alias("rationale_codes"), text("given").alias("evidence_ids"), text("head").alias("changed_regions"), F.lit(False).alias("abstain")).cast(rp.ANSWER)
    model = F.when(F.col("p_type") == "ECONOMY", other).otherwise(rp.abstained("no_answer"))
    answers = rows.select("p_partkey", rp.first_answer(rp.declaring(F.col("source"), F.col("diagnostics"), F.col("facts")), model).alias("x")).select("p_partkey", "x.repairer", "x.answer")
    tried = answers.where((key % 10 == 0) & ~F.col("answer.abstain")).select("p_partkey", F.sha2("answer.revised_source", 256).alias("revision"))
    return rp.fresh(answers, tried, ["p_partkey"]).select("p_partkey", "repairer", F.col("answer.abstain").alias("abstain"), "revision", "state")


@query("q63_arrow_folder", "SELECT doc_id, lang, n_chars, sha256(text) AS text_hash FROM documents WHERE lang IN ('de', 'es', 'fr')")
def arrow_folder(spark, sf_dir):
    """Documents written as an Arrow folder and read back by record batches, three languages kept by the reader."""
    path = f"{scratch(spark)}/documents"
    arrow.write_folder(read_table(spark, sf_dir, "documents"), path)
    rows = arrow.read_folder(spark, path, ["doc_id", "lang", "n_chars", "text"], {"lang": ["de", "es", "fr"]})
    return rows.select("doc_id", "lang", "n_chars", F.sha2("text", 256).alias("text_hash"))


@query(
    "q64_snapshot_rewrite",
    """
    SELECT doc_id, version, CASE WHEN version = 2 AND lang = 'fr' THEN NULL ELSE lang END AS lang, sha256(CASE WHEN version = 2 THEN upper(lang) || text ELSE text END) AS text_hash
    FROM documents, (VALUES (1), (2)) AS v(version) WHERE version = 1 OR doc_id % 3 <> 0
    """,
)
def snapshot_rewrite(spark, sf_dir):
    """Documents before and after a rewrite, read from both snapshots; a writer that began before it is refused."""
    table = snapshots.SnapshotTable(spark, f"{scratch(spark)}/documents")
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    table.commit(table.stage(docs))
    late = table.stage(docs.where("doc_id < 10"), 1)
    table.rewrite(lambda d: d.where("doc_id % 3 <> 0").select("doc_id", F.when(F.col("lang") != "fr", F.col("lang")).alias("lang"), F.concat(F.upper("lang"), "text").alias("text")))
    try:
        table.commit(late)
        raise AssertionError("a stale snapshot was committed")
    except snapshots.Conflict:
        pass
    parts = [table.read(v).select("doc_id", F.lit(v).alias("version"), "lang", F.sha2("text", 256).alias("text_hash")) for v in (1, 2)]
    return parts[0].unionByName(parts[1])


@query(
    "q65_replayed_records",
    """
    WITH e AS (SELECT user_id, event_type, event_id, value, (props->>'k')::INT AS k FROM events)
    SELECT user_id, event_type AS purpose, count(*) AS probes, count(*) FILTER (WHERE event_id % 7 <> 0) AS executed, count(*) FILTER (WHERE event_id % 7 <> 0 AND value > 20) AS valid,
        count(*) FILTER (WHERE event_id % 5 <> 0 AND event_id % 4 > 1) AS repeated, sum(k)::BIGINT AS k, count(*) FILTER (WHERE event_id % 3 = 0) AS unsafe FROM e GROUP BY 1, 2
    """,
)
def replayed_records(spark, sf_dir):
    """Frozen records of events read back as VARIANT and joined with what was observed, per user and purpose."""
    e, i = read_table(spark, sf_dir, "events"), F.col("event_id")
    # Some records lack the repetition, some have it as a word, and only some say that they are unsafe.
    record = F.concat(
        F.lit('{"probe_id":"'), i, F.lit('","purpose":"'), "event_type", F.lit('"'), F.when(i % 5 == 0, F.lit("")).when(i % 11 == 0, F.concat(F.lit(',"repetition":"'), i % 4, F.lit('"'))).otherwise(F.concat(F.lit(',"repetition":'), i % 4)),
        F.when(i % 3 == 0, F.lit(',"expected_safe":false')).otherwise(""), F.lit(',"input_case":'), "props", F.lit("}"),
    )
    probes = rl.rehydrated(e.select("user_id", record.alias("line")), "line", ["user_id"]).withColumn("event_id", F.col("probe_id").cast("long"))
    seen = e.where(i % 7 != 0).select("event_id", F.when(F.col("value") > 20, "returned").otherwise("signal").alias("status"))
    more = probes.groupBy("user_id", "purpose").agg(F.count_if(F.col("repetition") > 1).alias("repeated"), F.sum(F.try_variant_get("input_case", "$.k", "bigint")).alias("k"), F.count_if(~F.col("expected_safe")).alias("unsafe"))
    return rl.batch_counts(probes, seen, ["event_id"], ["user_id", "purpose"]).join(more, ["user_id", "purpose"])


@query("q66_indexed_neighbours")
def indexed_neighbours(spark, sf_dir):
    """The three nearest other vectors of every fiftieth vector by an index of inverted lists over all vectors."""
    base, path = read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), f"{scratch(spark)}/lists"
    found = rt.build_index(base, path)
    return rt.nearest_indexed(spark.read.parquet(path), found, base.where("id % 50 = 0"), 3, probes=max(8, len(found) // 2), itself=False)


@query(
    "q67_moves",
    """
    WITH RECURSIVE s AS (SELECT ['static_inferred', 'capability_checked', 'probed', 'frozen', 'ambiguous', 'retryable_rejected', 'unverified'] AS names),
    legal AS (SELECT unnest(['initial>static_inferred', 'initial>failed', 'static_inferred>capability_checked', 'static_inferred>failed', 'capability_checked>probed', 'capability_checked>retryable_unsupported', 'capability_checked>unverified',
        'capability_checked>failed', 'probed>frozen', 'probed>retryable_rejected', 'probed>ambiguous', 'probed>budget_exhausted', 'probed>unidentifiable_from_binary', 'probed>failed', 'probed>unverified', 'probed>behavioral_equivalence_class',
        'retryable_rejected>capability_checked', 'retryable_rejected>probed', 'retryable_rejected>budget_exhausted', 'retryable_rejected>unverified', 'retryable_rejected>failed', 'retryable_unsupported>capability_checked',
        'retryable_unsupported>unverified', 'retryable_unsupported>failed', 'ambiguous>probed', 'ambiguous>behavioral_equivalence_class', 'ambiguous>unidentifiable_from_binary', 'ambiguous>budget_exhausted', 'ambiguous>unverified', 'ambiguous>failed']) AS edge),
    e AS (SELECT user_id, event_id, names[1 + (event_id * 5 + floor(value)::INT) % 7] AS target, row_number() OVER (PARTITION BY user_id ORDER BY ts, names[1 + (event_id * 5 + floor(value)::INT) % 7]) AS n FROM events, s),
    f AS (SELECT user_id, 0::BIGINT AS n, NULL::VARCHAR AS source, 'initial' AS state, NULL::VARCHAR AS target, NULL::VARCHAR AS verdict, 0 AS round FROM (SELECT DISTINCT user_id FROM events)
      UNION ALL
      SELECT f.user_id, e.n, f.state, CASE WHEN l.edge IS NOT NULL THEN e.target ELSE f.state END, e.target, CASE WHEN l.edge IS NOT NULL THEN 'legal' ELSE 'illegal' END, f.round + (l.edge IS NOT NULL AND e.target = 'probed')::INT
      FROM f JOIN e ON e.user_id = f.user_id AND e.n = f.n + 1 LEFT JOIN legal l ON l.edge = f.state || '>' || e.target)
    SELECT user_id::VARCHAR AS key, source, target, verdict, round, count(*) AS n FROM f WHERE f.n > 0 GROUP BY ALL
    """,
)
def fold_moves(spark, sf_dir):
    """Moves that the events of every user ask for, each legal from the state reached or refused."""
    names = F.array(*(F.lit(x) for x in ("static_inferred", "capability_checked", "probed", "frozen", "ambiguous", "retryable_rejected", "unverified")))
    target = F.element_at(names, (1 + (F.col("event_id") * 5 + F.floor("value")) % 7).cast("int"))
    rows = read_table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("ts").alias("at"), target.alias("target"))
    return moves.folded(rows).groupBy("key", "source", "target", "verdict", "round").agg(F.count("*").alias("n"))
