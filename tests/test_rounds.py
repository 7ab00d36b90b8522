"""Rounds, input cases, repairs, snapshots, files by split, the index and the state machine against plain loops."""

import json
import os
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyrail.operators import cases, repairs, replays, retrieval, rounds, validation
from tallyrail.plans import own
from tallyrail.session import scratch
from tallyrail.sources import arrays, arrow, readers, snapshots
from tallyrail.streaming import moves


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    spark.conf.set("spark.sql.files.openCostInBytes", "20")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def made(rng, depth=0):
    k = rng.randrange(7)
    if k == 0:
        return "".join(rng.choices('a,b"\\[]{}é:\n', k=rng.randrange(30)))
    if k == 2 and depth < 4:
        return [made(rng, depth + 1) for _ in range(rng.randrange(4))]
    if k == 3 and depth < 4:
        return {rng.choice(["samples", "x,", '"samples":[', "k"]): made(rng, depth + 1) for _ in range(rng.randrange(4))}
    return [1, 2, [3, 4]] if k == 5 else [None, "plain, text", 7][k % 3]


@pytest.mark.parametrize("form", ["array", "member", "among members"])
def test_json_arrays_by_split(spark, tmp_path, small_splits, form):
    rng = random.Random(form)
    for n in (0, 1, 5, 80):
        items = [made(rng) for _ in range(n)]
        whole = {"array": items, "member": {"samples": items}, "among members": {"meta": {"samples": [1, 2], "y": [1, [2]]}, "s,": '"samples": [1,2]', "samples": items, "after": {"samples": [7, 8], "z": [1, {"q": [5, 6]}]}}}[form]
        path = tmp_path / f"{n}.json"
        path.write_text(json.dumps(whole, indent=1 if n == 5 else None, ensure_ascii=n == 80))
        got = sorted(arrays.elements(spark, str(path), None if form == "array" else "samples").collect(), key=lambda r: r["ordinal"])
        assert [json.loads(r["text"]) for r in got] == items and [r["ordinal"] for r in got] == list(range(n))
    assert arrays.fragments(spark, str(path)).rdd.getNumPartitions() > 3


def test_json_arrays_of_several_files_and_broken_ones(spark, tmp_path, small_splits):
    rows = spark.range(100).select(F.col("id"), F.concat(F.lit("a,]["), "id").alias("t"))
    arrays.write_array(rows, F.to_json(F.struct("*")), f"{tmp_path}/a", ["id"])
    got = arrays.read_array(spark, f"{tmp_path}/a", "id long, t string").orderBy("file", "ordinal").select("e.*").collect()
    assert [tuple(r) for r in got] == [(i, f"a,][{i}") for i in range(100)]
    (tmp_path / "b.json").write_text('[{"id": 1}, {"id": }]')
    with pytest.raises(Exception, match="MALFORMED|malformed"):
        arrays.read_array(spark, f"{tmp_path}/b.json", "id long").collect()


def test_limit_of_a_flat_dataset_over_splits(spark, tmp_path, small_splits):
    path = tmp_path / "flat.json"
    path.write_text(json.dumps({"samples": [{"sample_id": f"s{i}", "optimization": f"O{i % 2}", "assembly": {"v": "ret, 1"}} for i in range(60)]}))
    got = readers.flat_dataset(spark, str(path), "v", levels=["O1"], limit=20).collect()
    assert [r["sample_id"] for r in got] == [f"s{i}" for i in range(1, 41, 2)]


def test_hash_trees(spark):
    files = spark.range(300).select(F.format_string("f%05d", "id").alias("path"), F.col("id").cast("string").cast("binary").alias("content"))
    trees = [sorted(map(tuple, readers.hash_tree(files.repartition(n), scratch(spark), 8).collect())) for n in (1, 7)]
    assert trees[0] == trees[1] and [sum(1 for t in trees[0] if t[0] == level) for level in (1, 2, 3)] == [38, 5, 1] and trees[0][-1][2] == 300
    roots = {readers.fingerprint(f, scratch(spark), 8).first()["fingerprint"] for f in (files, files.where("id <> 7"), files.limit(1), files.limit(0))}
    assert len(roots) == 4 and trees[0][-1][3] in roots
    few = files.where("id < 3")
    assert readers.bundle_digest(few, ["f00000", "f00002"]) != readers.bundle_digest(few, ["f00002", "f00000"])
    with pytest.raises(ValueError, match="missing"):
        readers.bundle_digest(few, ["f00009"])


# Minimised inputs


def plain_minimized(case, fails, attempts=8):
    """The definition, one input at a time."""
    gpr, objects, log = dict(case["gpr"]), {k: dict(v) for k, v in case["objects"].items()}, []

    def attempt(name, new_gpr, new_objects):
        nonlocal gpr, objects
        if len(log) >= attempts or (new_gpr, new_objects) == (gpr, objects):
            return
        kept = fails(new_gpr, new_objects)
        log.append((name, kept))
        if kept:
            gpr, objects = new_gpr, new_objects

    for slot in sorted(gpr):
        if isinstance(gpr[slot], int) and gpr[slot]:
            attempt(f"zero_integer:{slot}", {**gpr, slot: 0}, objects)
    for name in sorted(objects):
        o = objects[name]
        attempt(f"zero_object:{name}", gpr, {**objects, name: {**o, "bytes_hex": "00" * o["size"]}})
        o = objects[name]
        if o["size"] > o["min_size"]:
            attempt(f"shrink_object:{name}", gpr, {**objects, name: {**o, "size": o["min_size"], "bytes_hex": o["bytes_hex"][: 2 * o["min_size"]]}})
        o = objects[name]
        attempt(f"normalize_placement:{name}", gpr, {**objects, name: {**o, "placement": "right"}})
    return gpr, objects, log


def test_minimized_inputs_equal_a_plain_loop(spark):
    rng = random.Random(5)
    tried, made_cases, wanted = [], [], {}

    def text(gpr, objects, key):
        shown = {s: v if isinstance(v, int) else {"object_ref": v} if v else {"null": True} for s, v in gpr.items()}
        things = {n: {k: o[k] for k in ("size", "bytes_hex", "placement")} for n, o in objects.items()}
        return json.dumps({"schema_version": 1, "contract_id": 'c"é', "gpr": shown, "objects": things, "globals": {}, "seed": key, "virtual_read_bytes": ""}, ensure_ascii=False, sort_keys=True, separators=(",", ":"))

    import hashlib

    digest = lambda *a: hashlib.sha256(text(*a).encode()).hexdigest()
    for key in range(60):
        gpr = {"RDI": rng.randrange(3), "RSI": rng.choice(["o1", None]), "RDX": -rng.randrange(3)}
        objects = {f"o{i}": {"size": (n := rng.randrange(1, 4)), "bytes_hex": rng.choice(["00" * n, "0a" * n]), "placement": rng.choice(["left", "right"]), "min_size": 1} for i in range(rng.randrange(3))}
        salt = rng.random()

        def fails(g, o, key=key, salt=salt):
            verdict = random.Random(f"{salt}{text(g, o, key)}").random() < 0.6
            tried.append((key, digest(g, o, key), verdict))
            return verdict

        most = 8
        g, o, log = plain_minimized({"gpr": gpr, "objects": objects}, fails, most)
        wanted[key] = (digest(g, o, key), log)
        made_cases.append((key, 'c"é', key, {s: (v, None) if isinstance(v, int) else (None, v) for s, v in gpr.items()}, {n: (x["size"], x["bytes_hex"], x["placement"], x["min_size"]) for n, x in objects.items()}))
    df = spark.createDataFrame(made_cases, f"k int, contract_id string, seed long, gpr map<string,{rounds.REGISTER}>, objects map<string,{rounds.OBJECT}>")
    verdicts = spark.createDataFrame(tried, "k int, input_hash string, fails boolean")
    got = rounds.minimized(df, verdicts, ["k"], scratch(spark), 8).withColumn("h", rounds.input_hash()).collect()
    assert {r["k"]: (r["h"], [(x["step"], x["kept"]) for x in r["log"]]) for r in got} == wanted and len(got) == 60
    few = rounds.minimized(df, verdicts, ["k"], scratch(spark), 2).collect()
    assert len(few) == 60 and {len(r["log"]) for r in few} <= {0, 1, 2} and all([(x["step"], x["kept"]) for x in r["log"]] == wanted[r["k"]][1][:2] for r in few)


def on_disk(spark):
    """Files of shuffles, spills and the checkpoint folder, with their sizes."""
    files = {f: os.path.getsize(f) for d, _, names in os.walk(spark.conf.get("spark.checkpoint.dir").removeprefix("file://")) for f in (f"{d}/{n}" for n in names)}
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return files | {(f := blocks.apply(i)).getPath(): f.length() for i in range(blocks.length())}


def test_minimized_inputs_write_less_than_four_times_their_table(spark, tmp_path):
    orders = "/root/testdata/sf0.01/orders.parquet"
    before = on_disk(spark)
    own.QUERIES["q58_minimized"](spark, os.path.dirname(orders)).write.parquet(f"{tmp_path}/out")
    new = {f: n for f, n in on_disk(spark).items() if f not in before}
    assert new and sum(new.values()) < 4 * os.path.getsize(orders)


def test_keys_of_many_verdicts_are_joined_by_attempt(spark, monkeypatch):
    run = lambda: sorted(map(tuple, own.QUERIES["q58_minimized"](spark, "/root/testdata/sf0.001").collect()))
    wanted, by_rounds, large = run(), rounds._by_rounds, []
    monkeypatch.setattr(rounds, "MOST_VERDICTS", 4)
    monkeypatch.setattr(rounds, "_by_rounds", lambda cases, *more: large.append(cases.count()) or by_rounds(cases, *more))
    assert run() == wanted and 0 < large[0] < len(wanted)


def test_minimized_inputs_of_a_key_of_many_orders(spark, tmp_path, monkeypatch):
    key = F.when(F.col("o_orderkey") < 900, 1).otherwise(F.col("o_orderkey")).cast("long")
    spark.read.parquet("/root/testdata/sf0.001/orders.parquet").withColumn("o_orderkey", key).write.parquet(f"{tmp_path}/orders.parquet")
    by_rounds, large = rounds._by_rounds, []
    monkeypatch.setattr(rounds, "_by_rounds", lambda cases, *more: large.append(cases.count()) or by_rounds(cases, *more))
    got = own.QUERIES["q58_minimized"](spark, str(tmp_path))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    want = con.sql(f"SELECT {', '.join(got.columns)} FROM ({own.ORACLE['q58_minimized']})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want) and 0 < large[0] < len(want)


@pytest.mark.parametrize("most", [0, 1000])
def test_verdicts_that_settle_nothing(spark, monkeypatch, most):
    monkeypatch.setattr(rounds, "MOST_VERDICTS", most)
    kind = f"k int, contract_id string, seed long, gpr map<string,{rounds.REGISTER}>, objects map<string,{rounds.OBJECT}>"
    row = lambda k, value: (k, "c", 1, {"RDI": (value, None)}, {})
    h = spark.createDataFrame([row(0, 0)], kind).select(rounds.input_hash()).first()[0]
    verdicts = [(0, h, True), (1, h.upper(), True), (2, h, None), (2, h, False), (3, h, False), (3, h, True), (3, h, True), (4, None, True), (4, "x", True), (None, h, True)]
    cases = spark.createDataFrame([row(k, 7) for k in (0, 1, 2, 3, 4, 5, None)] + [(6, "c", 1, None, {})], kind)
    got = rounds.minimized(cases, spark.createDataFrame(verdicts, "k int, input_hash string, fails boolean"), ["k"], scratch(spark)).collect()
    assert {r["k"]: [x["kept"] for x in r["log"]] for r in got} == {0: [True], 1: [False], 2: [False], 3: [True], 4: [False], 5: [False], None: [False], 6: []} and len(got) == 8


# Probe rounds


def plain_rounds(budget, limit, by_round, rounds_):
    left, executed, failures, seen, quiet, z2 = budget, 0, 0, set(), 0, 1.959963984540054**2
    if left <= 0:
        return 0, 0, 0, 0, "budget_exhausted"
    for turn in range(1, rounds_ + 1):
        taken = by_round.get(turn, [])[:left]
        news = {s for s, _ in taken} - seen
        seen |= news
        left, executed, failures, quiet = left - len(taken), executed + len(taken), failures + sum(f for _, f in taken), 0 if news else quiet + 1
        if left <= 0:
            return turn, executed, failures, len(seen), "budget_exhausted"
        if executed:
            p, n = failures / executed, executed
            high = min(1.0, (p + z2 / (2 * n)) / (1 + z2 / n) + z2**0.5 * (p * (1 - p) / n + z2 / (4 * n * n)) ** 0.5 / (1 + z2 / n))
            if high > limit:
                return turn, executed, failures, len(seen), "risk_limit_exceeded"
        if quiet >= 2:
            return turn, executed, failures, len(seen), "no_new_information"
    return rounds_, executed, failures, len(seen), "round_limit"


def test_probe_rounds_equal_a_plain_loop(spark):
    rng = random.Random(8)
    keys, rows, wanted = [], [], {}
    for key in range(80):
        budget, limit = rng.randrange(0, 25), rng.choice([0.6, 0.8, 0.95, 1.0])
        by_round = {t: [(rng.choice("abcdefgh"[: rng.randrange(1, 9)]), rng.random() < 0.3) for _ in range(rng.randrange(5))] for t in range(1, 8) if rng.random() < 0.8}
        keys.append((key, budget, limit))
        rows += [(key, t, i, s, f) for t, found in by_round.items() for i, (s, f) in enumerate(found)]
        wanted[key] = plain_rounds(budget, limit, by_round, 6)
    got = rounds.probe_rounds(spark.createDataFrame(keys, "k int, budget int, risk_limit double"), spark.createDataFrame(rows, "k int, round int, ordinal int, signature string, fails boolean"), "k", scratch(spark), 6)
    assert {r["k"]: tuple(r)[1:] for r in got.collect()} == wanted
    assert {w[-1] for w in wanted.values()} == {"budget_exhausted", "risk_limit_exceeded", "no_new_information", "round_limit"}
    with pytest.raises(Exception, match="more executions"):
        rounds.probe_rounds(spark.createDataFrame([(1, 1001, 1.0)], "k int, budget int, risk_limit double"), spark.createDataFrame([], "k int, round int, ordinal int, signature string, fails boolean"), "k", scratch(spark))


def test_reasons_to_stop(spark):
    rows = [(0, 0.9, 0.5, 2), (1, 0.9, 0.5, 2), (1, 0.5, 0.5, 2), (1, 0.5, 0.5, 1), (1, None, 0.5, 0)]
    df = spark.createDataFrame(rows, "b int, r double, l double, n int")
    assert [r[0] for r in df.select(validation.stop_probing(*(F.col(c) for c in "brln"))).collect()] == ["budget_exhausted", "risk_limit_exceeded", "no_new_information", None, None]


# Input cases

CONTRACT = ("c", [("RDI", "integer", None), ("RSI", "pointer", "a"), ("RDX", "pointer", "b")], [("a", 2), ("b", 1)], [("length_within", None, None, None, "rdi", "a"), ("no_alias", "a", "b", None, None, None)])
GOOD = (1, "c", {"RDI": (2, None, False), "RSI": (None, "a", False), "RDX": (None, "b", None)}, {"a": (2, "0aff", "left"), "b": (1, "00", None)}, {}, 5, "")


@pytest.mark.parametrize(
    ("change", "errors"),
    [
        ({}, []),
        ({0: 2, 1: "d"}, ["unknown_schema_version", "other_contract"]),
        ({2: {"RSI": (1, None, None)}}, ["missing_register:RDI", "not_a_reference:RSI", "missing_register:RDX"]),
        ({2: {**GOOD[2], "RDI": (None, "a", None)}}, ["not_an_integer:RDI"]),
        ({2: {**GOOD[2], "RSI": (None, "b", None)}}, ["other_object:RSI"]),
        ({2: {**GOOD[2], "RDX": (None, None, True)}}, ["null_on_one_side:no_alias"]),
        ({2: {**GOOD[2], "RDI": (3, None, None)}}, ["length_not_within:a"]),
        ({2: {**GOOD[2], "RDI": (-1, None, None)}}, ["length_not_within:a"]),
        ({3: {"a": (1, "0a", "middle"), "b": (1, "0", "left")}, 2: {**GOOD[2], "RDI": (0, None, None)}}, ["size_below_least:a", "unknown_placement:a", "bytes_not_hexadecimal:b"]),
        ({3: {"a": (2, "0a", "left")}}, ["bytes_of_other_length:a", "missing_object:b"]),
        ({3: {**GOOD[3], "x": (0, "", "left"), "y": (16 * 1024 + 1, "", "left")}}, ["unknown_object:x", "size_out_of_range:x", "unknown_object:y", "size_out_of_range:y", "bytes_of_other_length:y", "too_many_objects"]),
        ({4: {"g": "1"}, 6: "abc"}, ["globals_given", "stream_not_hexadecimal"]),
    ],
)
def test_input_cases(spark, change, errors):
    case = tuple(change.get(i, v) for i, v in enumerate(GOOD))
    df = spark.createDataFrame([(CONTRACT, case)], f"k {cases.CONTRACT}, c {cases.CASE}")
    assert df.select(cases.case_errors(F.col("k"), F.col("c"))).first()[0] == errors


def test_relations_and_default_cases(spark):
    relation = lambda kind, offset=None: (*CONTRACT[:3], [(kind, "a", "b", offset, None, None)])
    shared = ("c", [("RDI", "pointer", "a"), ("RSI", "pointer", "a")], [("a", 3)], [("must_alias", "a", "a", None, None, None)])
    df = spark.createDataFrame([(k, GOOD) for k in (relation("must_alias"), relation("fixed_offset_alias", 4), relation("fixed_offset_alias", 0))], f"k {cases.CONTRACT}, c {cases.CASE}")
    assert [r[0] for r in df.select(cases.case_errors(F.col("k"), F.col("c"))).collect()] == [["objects_not_shared:must_alias"], ["offset_not_zero:fixed_offset_alias"], ["objects_not_shared:fixed_offset_alias"]]
    plain = spark.createDataFrame([(CONTRACT,), (shared,), (("e", [], [], []),)], f"k {cases.CONTRACT}").select("k", cases.default_case(F.col("k"), F.lit(9)).alias("c"))
    got = plain.select("c", cases.case_errors(F.col("k"), F.col("c")).alias("e")).collect()
    assert [r["e"] for r in got] == [[], [], []] and got[0]["c"]["objects"]["a"]["bytes_hex"] == "0000" and got[0]["c"]["gpr"]["RDI"]["value"] == 0 and got[1]["c"]["gpr"]["RSI"]["object_ref"] == "a" and got[2]["c"]["seed"] == 9


# Repairs


def test_innermost_declarations(spark):
    rng = random.Random(2)
    declared = [(f, (a := rng.randrange(400)), a + rng.randrange(200), f"d{i}") for i, f in enumerate(rng.choices("xy", k=150))]
    diagnosed = [(i, rng.choice("xyz"), rng.randrange(650)) for i in range(300)]
    got = repairs.declared_at(spark.createDataFrame([(1, *d) for d in diagnosed], "s int, i int, file string, line int"), spark.createDataFrame([(1, *d) for d in declared], "s int, file string, first_line int, last_line int, name string"), ["s"])
    want = {}
    for i, file, line in diagnosed:
        held = [(b - a, -a, n) for f, a, b, n in declared if f == file and a <= line <= b]
        want[i] = {n for w, s, n in held if (w, s) == min(held)[:2]} if held else {None}
    rows = got.collect()
    assert len(rows) == 300 and all(r["name"] in want[r["i"]] for r in rows)


def test_first_repair_that_does_not_abstain(spark):
    facts = "array<struct<name:string,public_c_declaration:string>>"
    rows = [
        (1, "int f;", "x: 'g' undeclared; ‘h’ undeclared", [("g", "extern int old;"), ("g", " extern int g; "), ("h", "extern int k;"), ("z", "extern int z;")]),
        (2, "extern int g; int f;", "'g' undeclared", [("g", "extern int g;")]),
        (3, "int f;", "nothing", []),
    ]
    df = spark.createDataFrame(rows, f"k int, s string, d string, f {facts}")
    declared = repairs.declaring(F.col("s"), F.col("d"), F.col("f"))
    other = F.when(F.col("k") == 2, F.struct(F.lit("int other;").alias("revised_source"), F.array(F.lit("r")).alias("rationale_codes"), F.array(F.lit("e")).alias("evidence_ids"), F.array(F.lit("c")).alias("changed_regions"), F.lit(False).alias("abstain")).cast(repairs.ANSWER)).otherwise(repairs.abstained("no_answer"))
    got = {r["k"]: r["x"] for r in df.select("k", repairs.first_answer(declared, other).alias("x")).collect()}
    assert got[1]["repairer"] == 0 and got[1]["answer"]["revised_source"] == "extern int g;\nint f;" and got[1]["answer"]["evidence_ids"] == ["compile:undefined_global:g"]
    assert (got[2]["repairer"], got[2]["answer"]["revised_source"]) == (1, "int other;") and got[3]["answer"]["rationale_codes"] == ["no_answer"]
    answers = [(1, 0, ("a", ["r"], ["e"], ["c"], False)), (1, 1, ("a", ["r"], ["e"], ["c"], False)), (1, 2, ("b", ["r"], ["e"], ["c"], False)), (1, 3, ("", ["r"], [], [], True)), (1, 4, ("x", ["r"], [], ["c"], False)), (1, 5, ("", ["r"], [], ["c"], True))]
    a = spark.createDataFrame(answers, f"k int, repairer int, answer {repairs.ANSWER}")
    tried = spark.createDataFrame([(1, "b"), (2, "a")], "k int, t string").select("k", F.sha2("t", 256).alias("revision"))
    assert [r["state"] for r in repairs.fresh(a, tried, ["k"]).orderBy("repairer").collect()] == ["new", "duplicate", "duplicate", "abstained", "invalid", "invalid"]


# Files


def test_arrow_folders(spark, tmp_path):
    rows = spark.range(0, 40_000, 1, 3).select(F.col("id"), F.concat(F.lit("O"), F.col("id") % 4).alias("opt"), F.when(F.col("id") % 2 == 0, "c").otherwise("cpp").alias("language"), F.col("id").alias("index"))
    for form in ("stream", "file"):
        assert arrow.write_folder(rows, f"{tmp_path}/{form}/humaneval", form) == 40_000
        whole = arrow.read_folder(spark, f"{tmp_path}/{form}/humaneval")
        assert whole.rdd.getNumPartitions() == 3 and [r[0] for r in whole.orderBy(arrow.PLACE).select("id").limit(5).collect()] == [0, 1, 2, 3, 4]
        part = arrow.read_folder(spark, f"{tmp_path}/{form}/humaneval", ["opt"], {"opt": ["O1"], "language": ["cpp"]})
        assert part.columns == ["opt", arrow.PLACE] and part.count() == 10_000
        arrow.write_folder(rows.where("id < 10"), f"{tmp_path}/{form}/mbpp", form)
        paths = {s: f"{tmp_path}/{form}/{s}" for s in ("mbpp", "humaneval")}
        got = readers.split_tables(spark, paths, levels=["O2"], languages=["c"], limit=4, form="arrow").collect()
        assert [(r["split"], r["id"]) for r in got] == [("mbpp", 2), ("mbpp", 6), ("humaneval", 2), ("humaneval", 6)]
    with pytest.raises(Exception, match="no Arrow files"):
        (tmp_path / "none").mkdir()
        arrow.read_folder(spark, f"{tmp_path}/none").collect()
    with pytest.raises(Exception, match="do not have"):
        arrow.read_folder(spark, f"{tmp_path}/file/mbpp", ["other"]).collect()


def test_snapshots(spark, tmp_path):
    table = snapshots.SnapshotTable(spark, f"file://{tmp_path}/t")
    with pytest.raises(ValueError, match="no version"):
        table.read()
    assert table.commit(table.stage(spark.range(10))) == 1
    old = table.read()
    # Two writers that began at the same version: one of them is told.
    a, b = table.stage(spark.range(5)), table.stage(spark.range(7))
    assert table.commit(a) == 2
    with pytest.raises(snapshots.Conflict):
        table.commit(b)
    assert table.read().count() == 5 and old.count() == 10 and table.read(1).count() == 10
    # A writer that died before its manifest, and one that died in the middle of it, leave nothing that is read.
    table.stage(spark.range(3))
    (tmp_path / "t" / "versions" / ".x.part").write_text('{"version": 3, "da')
    assert table.versions() == [1, 2] and table.read().count() == 5 and len(table.orphans()) == 2
    assert table.vacuum(3600) == [] and len(table.vacuum(0)) == 2 and table.orphans() == []
    # A rewrite that loses takes the newer snapshot the next time.
    calls = []

    def change(rows):
        if not calls:
            table.commit(table.stage(spark.range(100, 103), 2))
        calls.append(1)
        return rows.selectExpr("id + 1 AS id")

    assert table.rewrite(change) == 4 and len(calls) == 2 and sorted(r[0] for r in table.read().collect()) == [101, 102, 103]
    with pytest.raises(snapshots.Conflict):
        table.rewrite(lambda d: (table.commit(table.stage(spark.range(1))), d)[1], attempts=2)


def test_replayed_records(spark):
    lines = [('{"probe_id":"p","repetition":2,"input_case":{"gpr":{"RDI":1},"more":[1,{"x":2}]}}',), ('{"repetition":"3","expected_safe":null,"purpose":7}',), ("{}",)]
    got = replays.rehydrated(spark.createDataFrame(lines, "l string"), "l", []).withColumn("case", F.to_json("input_case")).drop("input_case").collect()
    assert [tuple(r) for r in got] == [("p", "", 2, "", True, '{"gpr":{"RDI":1},"more":[1,{"x":2}]}'), ("", "", 3, "7", True, None), ("", "", 0, "", True, None)]
    with pytest.raises(Exception, match="MALFORMED|malformed"):
        replays.rehydrated(spark.createDataFrame([("{",)], "l string"), "l", []).collect()


def test_recall_of_the_index(spark, tmp_path):
    base = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    found = retrieval.build_index(base, f"{tmp_path}/lists")
    index, queries = spark.read.parquet(f"{tmp_path}/lists"), base.where("id % 50 = 0")
    exact = retrieval.nearest(base, queries, "l2", 3, itself=False)
    shares = {p: retrieval.recall(retrieval.nearest_indexed(index, found, queries, 3, p, itself=False), exact) for p in (max(8, len(found) // 2), len(found))}
    assert index.count() == base.count() and shares[len(found)] == 1.0 and min(shares.values()) >= 0.9
    rng = np.random.default_rng(0)
    near = [(i, (rng.normal(size=8) + 20 * (i % 12)).tolist()) for i in range(2000)]
    df = spark.createDataFrame(near, "id long, vector array<double>")
    found = retrieval.build_index(df, f"{tmp_path}/more", 24)
    got = retrieval.nearest_indexed(spark.read.parquet(f"{tmp_path}/more"), found, df.where("id % 50 = 0"), 5, 4)
    assert retrieval.recall(got, retrieval.nearest(df, df.where("id % 50 = 0"), "l2", 5)) >= 0.95
    with pytest.raises(ValueError, match="no vectors"):
        retrieval.build_index(df.limit(0), f"{tmp_path}/empty")


# The state machine


def plain_moves(rows):
    out, legal = [], moves.legal()
    for key in {r[0] for r in rows}:
        state, round_ = "initial", 0
        for _, at, target in sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[2])):
            ok = target in legal.get(state, ())
            round_ += ok and target == "probed"
            out.append((key, at, state, target, "legal" if ok else "illegal", round_))
            state = target if ok else state
    return sorted(out)


def test_state_machine_as_stream_and_as_fold(spark, tmp_path):
    import datetime

    rng, names = random.Random(3), sorted({t for ts in moves.legal().values() for t in ts})
    start = datetime.datetime(2024, 1, 1)
    rows = [(f"k{rng.randrange(12)}", start + datetime.timedelta(seconds=i), rng.choice([*names, "capability_checked", "probed", "static_inferred"])) for i in range(400)]
    schema = "key string, at timestamp, target string"
    want = plain_moves(rows)
    take = lambda df: sorted((r["key"], r["at"], r["source"], r["target"], r["verdict"], r["round"]) for r in df.collect())
    assert take(moves.folded(spark.createDataFrame(rows, schema))) == want
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for i in range(0, 400, 100):  # a file per batch, in order
            spark.createDataFrame(rows[i : i + 100], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        moves.split(moves.machine(stream), f"{tmp_path}/legal", f"{tmp_path}/other", f"{tmp_path}/c").awaitTermination()
        legal, other = (spark.read.parquet(f"{tmp_path}/{n}") for n in ("legal", "other"))
        assert take(legal.unionByName(other)) == want and {r["verdict"] for r in other.collect()} == {"illegal"}
        # Keys that do not move any more are given up once the watermark is far enough.
        spark.createDataFrame([("quiet", start, "static_inferred"), ("done", start, "failed")], schema).coalesce(1).write.parquet(f"{tmp_path}/idle")
        for minutes in (10, 20, 30):
            spark.createDataFrame([("busy", start + datetime.timedelta(minutes=minutes), "static_inferred")], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/idle")
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/idle")
        moves.split(moves.machine(stream, "1 second", 60_000), f"{tmp_path}/legal2", f"{tmp_path}/other2", f"{tmp_path}/c2").awaitTermination()
        gone = {(r["key"], r["source"]) for r in spark.read.parquet(f"{tmp_path}/other2").where("verdict = 'expired'").collect()}
        assert ("quiet", "static_inferred") in gone and "done" not in {k for k, _ in gone}
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_lines_by_split(spark, tmp_path, small_splits):
    texts = {"a.txt": "".join(f"line {i}\n" if i % 5 else "  \n" for i in range(300)), "b.txt": "\n".join(f"more {i}" for i in range(50))}
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    got = readers.numbered_lines(spark, str(tmp_path))
    assert got.rdd.getNumPartitions() > 3
    rows = {}
    for r in got.collect():
        rows.setdefault(r["file"].rsplit("/", 1)[1], {})[r["line"]] = r["text"]
    assert rows == {name: dict(enumerate(text.splitlines())) for name, text in texts.items()}
    want = [x for text in texts.values() for x in text.splitlines() if x.strip()]
    base = readers.knowledge_base(spark, str(tmp_path))
    assert [tuple(r) for r in base.orderBy("id").collect()] == list(enumerate(want))
    (tmp_path / "empty").mkdir()
    (tmp_path / "empty" / "x.txt").write_text("")
    assert readers.knowledge_base(spark, str(tmp_path / "empty")).count() == 0


def test_baselines(spark):
    """A sample whose files fit its manifest holds all checks; without its files few hold; without a manifest there is no entry."""
    import hashlib

    from tallyrail.functions.keys import canonical
    from tallyrail.operators import baselines

    digest = lambda value: hashlib.sha256(canonical(value).encode()).hexdigest()
    core = {"schema_version": "v2", "status": "frozen", "mutation_after_freeze_allowed": False, "contract_id": "k", "contract_hash": "h", "probe_plan_hash": digest([{"b": 1, "a": "é"}]), "holdout_probe_plan_hash": digest([]), "observation_policy_hash": digest({"x": [1, 2]}), "exploration_probe_count": 1, "holdout_probe_count": 0, "probe_count": 1}
    harness = json.dumps(core | {"content_hash": digest(core)}, indent=1)
    schema = "sample_id string, " + ", ".join(f"{a} string" for a in baselines.ARTIFACTS) + ", selected_hash string, runner_sha256 string"
    good = ("a", harness, '{"harness_frozen": true, "contract_selection_status": "audit_accepted_frozen"}', '{"contract_id": "k"}', '{"x":[1,2]}', '{"b": 1, "a": "é"}\n', None, '{"o": 1}\n', "", "h", "r")
    rows = [good, ("b", harness, *[None] * 9), ("c", *[None] * 10)]
    found = baselines.entries(spark.createDataFrame(rows, schema), "v2")
    got = {r["sample_id"]: r for r in found.collect()}
    assert set(got) == {"a", "b"} and got["a"]["valid"] and len(got["a"]["checks"]) == 17 and all(got["a"]["checks"].values())
    assert {k for k, ok in got["b"]["checks"].items() if ok} == {"manifest_content_hash", "manifest_v2", "status_frozen", "mutation_forbidden", "holdout_probe_plan_hash", "holdout_probe_count", "exploration_observation_count", "holdout_observation_count"}
    total = baselines.summary(found).first()
    assert (total["frozen_harnesses"], total["valid_frozen_harnesses"], total["invalid_frozen_harnesses"]) == (2, 1, 1) and total["failure_reason_counts"]["original_runner_present"] == 1
    assert {r["sample_id"]: r["exploration_plan"] for r in baselines.plan_checks(found).collect()} == {"a": True, "b": False}
    assert baselines.summary(found.limit(0)).first()["frozen_harnesses"] == 0


def test_levels_that_were_not_asked(spark):
    from tallyrail.operators import protocols

    df = spark.createDataFrame([([], None, 0), (None, [], 3), ([], ["x", "y", "z"], 4)], "a array<string>, b array<string>, n int")
    got = [tuple(r[0]) for r in df.select(protocols.gated_levels([("one", F.col("a"), F.lit(1)), ("two", F.col("b"), F.col("n"))])).collect()]
    assert got == [(False, "two", "two: not checked", 0.5), (False, "one", "one: not checked", 0.0), (False, "two", "two: x; y and 1 more", 0.625)]
