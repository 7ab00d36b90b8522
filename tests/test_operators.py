"""Operators on small tables, with the figures that the evaluation framework's own tests pin."""

import pytest
from pyspark.sql import functions as F

from tallyrail.operators import audit, cache, joins, metrics, retrieval, selection, sequences
from tallyrail.sources import writers

RESULT = "dataset_id string, backend_id string, split string, language string, optimization string, protocol_id string, protocol_version string, decompile_success boolean, recompilable boolean, behavioral_pass boolean, reason string, capabilities array<string>"


def results(spark, *rows):
    return spark.createDataFrame([("d", "b", "s", "c", *r) for r in rows], RESULT)


def test_summary_counts_every_row(spark):
    caps = ["candidate_compile", "fixture_link", "behavior"]
    df = results(spark, ("O0", None, None, True, True, True, "", caps), ("O1", "p", "1", True, False, False, "compile_error", caps))
    out = metrics.summarize(metrics.with_metrics(df), ["dataset_id"]).first()
    assert out["total"] == 2 and out["behavioral_pass_rate"] == 0.5 and out["failure_reasons"] == {"compile_error": 1, "pass": 1}
    by = metrics.summarize(metrics.with_metrics(df), list(metrics.BY_LEVEL)).collect()
    assert [r["protocol_id"] for r in by] == ["p", "unknown"]


def test_capability_gates_a_metric(spark):
    df = results(spark, ("O0", "p", "1", True, True, True, None, ["candidate_compile"]))
    out = metrics.summarize(metrics.with_metrics(df), ["dataset_id"]).first()
    assert out["recompilable_eligible"] == 0 and out["recompilable_rate"] == 0.0 and out["decompile_success_passed"] == 1


def test_selection(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id int, h string")
    good = spark.createDataFrame([(1, "a"), (3, "c")], "id int, h string")
    assert selection.selected(docs, good, ["id"], ["h"]).count() == 2
    for bad in ([(1, "x")], [(9, "a")], [(1, "a"), (1, "a")]):
        with pytest.raises(ValueError):
            selection.selected(docs, spark.createDataFrame(bad, "id int, h string"), ["id"], ["h"])
    assert selection.matrix(docs, spark.createDataFrame([("x",), ("y",)], "backend string")).count() == 6


def test_chunks(spark):
    bounds = lambda n: [tuple(r) for r in spark.range(1).select(sequences.chunk_bounds(F.lit(n), 5, 2).alias("c")).first()["c"]]
    assert bounds(0) == [] and bounds(5) == [(0, 5)] and bounds(6) == [(0, 5), (3, 6)] and bounds(8) == [(0, 5), (3, 8)]
    with pytest.raises(ValueError):
        sequences.chunk_bounds(F.lit(1), 2, 2)


def test_labels_and_alignment(spark):
    df = spark.createDataFrame([(1, 0, ["I1"]), (1, 1, ["I2"]), (2, 0, ["I1"])], "line int, chunk int, labels array<string>")
    got = {r["line"]: r for r in sequences.merge_labels(df, ["line"], "chunk", "labels", "union").collect()}
    assert got[1]["labels"] == ["I1", "I2"] and got[1]["conflict"] and not got[2]["conflict"]
    with pytest.raises(Exception):
        sequences.merge_labels(df, ["line"], "chunk", "labels", "fail").collect()
    a = F.array(F.lit("a b"), F.lit("c"))
    r = F.array(F.lit("x"), F.lit("ab"), F.lit(" c"))
    assert spark.range(1).select(sequences.align(a, r)).first()[0] == 1


def test_islands_and_stagnation(spark):
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate("aabbba")], "k int, i int, v string")
    assert [(r["v"], r["n"]) for r in sequences.islands(df, ["k"], ["i"], "v").orderBy("run").collect()] == [("a", 2), ("b", 3), ("a", 1)]
    assert sequences.stagnant(df, ["k"], ["i"], "v", 3).count() == 1 and sequences.stagnant(df, ["k"], ["i"], "v", 4).count() == 0


def test_audit(spark):
    row = lambda c, total, valid=1.0: ("s", c, 10, 10, valid, 1.0, 0.5, 1.0, 0.5, total)
    schema = "sample string, contract_id string, observations int, safe_observations int, valid double, stable double, effect double, boundary double, simple double, total double"
    decide = lambda *rows: audit.audit(spark.createDataFrame(list(rows), schema), ["sample"]).first()
    assert decide(row("a", 0.9), row("b", 0.8))["selected"] == "a"
    near = decide(row("a", 0.9), row("b", 0.88))
    assert near["decision"] == "ambiguous" and near["competitors"] == 2
    assert decide(row("a", 0.9, 0.5))["reasons"] == ["valid_below_threshold"]
    assert decide(row("z", 0.95, 0.5), row("a", 0.7))["selected"] == "a"


def test_differences(spark):
    o = "struct<status:string,signal:int,fault_address_class:string,relative_offset:int,return_value:string,objects:map<string,string>,globals:map<string,string>,external_events:array<string>>"
    a = ("returned", None, None, None, "1", {"o": "00"}, {"g": "1"}, ["e"])
    b = ("returned", None, None, None, "2", {"o": "01"}, {"g": "2"}, [])
    c = ("signal", 11, "x", 1, "1", {"o": "00"}, {"g": "1"}, ["e"])
    df = spark.createDataFrame([(a, b), (a, c), (a, a)], f"a {o}, b {o}")
    got = [r[0] for r in df.select(audit.compare_observations("a", "b", F.lit(True), F.lit(False))).collect()]
    assert got == [["return", "memory", "external_event"], ["process_status"], []]


def test_edges_and_replay(spark):
    edges = audit.edge_table(spark)
    moves = spark.createDataFrame([("probed", "unverified", 1), ("frozen", "probed", 2)], "source string, target string, n int")
    assert [r["source"] for r in audit.illegal_moves(moves, edges).collect()] == ["frozen"]
    a = spark.createDataFrame([(1, "x", 5), (2, "y", 5), (3, "z", 1)], "k int, v string, elapsed_us int")
    b = spark.createDataFrame([(1, "x", 9), (2, "q", 5), (4, "z", 1)], "k int, v string, elapsed_us int")
    assert {r["k"]: r["state"] for r in audit.replay(a, b, ["k"], ["elapsed_us"]).collect()} == {1: "match", 2: "changed", 3: "missing", 4: "unexpected"}


def test_slot_scores(spark):
    df = spark.createDataFrame([(1, ["pointer", "integer"], ["pointer", "integer", "pointer"])], "g int, f array<string>, t array<string>")
    got = metrics.slot_scores(df, ["g"], "f", "t", "pointer").first()
    assert (got["tp"], got["fp"], got["fn"], got["precision"], got["recall"]) == (1, 0, 1, 1.0, 0.5)


def test_cache_is_write_once(spark, tmp_path):
    path = f"file://{tmp_path}/cache"
    rows = lambda v, e: spark.createDataFrame([("k1", v, e)], "key string, code string, elapsed_seconds double")
    assert cache.save(rows("a", 1.0), path, "key") == 1
    assert cache.save(rows("a", 2.0), path, "key") == 0
    with pytest.raises(ValueError):
        cache.save(rows("b", 1.0), path, "key")
    wanted = spark.createDataFrame([("k1",), ("k2",)], "key string")
    assert {r["key"]: r["generation_hit"] for r in cache.lookup(wanted, spark.read.parquet(path), "key", "generation").collect()} == {"k1": True, "k2": False}


def test_joins(spark):
    rel = spark.createDataFrame([(".text", 3), (".text", 9), (".data", 3)], "section string, offset int")
    sym = spark.createDataFrame([(".text", 2, 4)], "section string, start int, size int")
    assert joins.relocations_for_symbol(rel, sym).count() == 1
    a, b = spark.createDataFrame([(1, 0, "x")], "k int, p int, v string"), spark.createDataFrame([(1, 0, "o"), (1, 1, "o")], "k int, p int, w string")
    with pytest.raises(Exception):
        joins.zip_rows(a, b, ["k"], "p").collect()
    assert joins.set_difference(a, b.withColumn("k", F.lit(2)), ["k"]).count() == 2


def test_nearest_ties_and_zero(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0])], "id long, vector array<double>")
    q = spark.createDataFrame([(10, [1.0, 0.0]), (11, [0.0, 0.0])], "id long, vector array<double>")
    assert {(r["query"], r["neighbour"]) for r in retrieval.nearest(v, q, "cosine").collect()} == {(10, 1), (11, 1)}
    assert retrieval.nearest(v.limit(0), q).count() == 0 and retrieval.nearest(v, q.limit(0)).count() == 0


def test_manifest_detects_tampering(spark):
    m = writers.frozen_manifest(spark.createDataFrame([(2, "b"), (1, "a")], "id int, v string"), "v1")
    assert writers.verify_manifest(m, "v1") == []
    m["entries"][0]["v"] = "z"
    assert writers.verify_manifest(m, "v2") == ["content_hash", "schema"]
