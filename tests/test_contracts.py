"""Contracts, constraint tables and derived paths on literals."""

import pytest
from pyspark.sql import functions as F

from tallyrail.operators import contracts as c
from tallyrail.operators import sequences, validation

CONTRACT = "c struct<arguments:array<struct<slot:int,register:string,object_ref:string,confidence:double>>,objects:array<struct<object_id:string,argument_slot:string,min_size:int>>,relations:array<struct<kind:string,offset:int>>,dependencies:array<string>>"


def test_truth_and_hits(spark):
    df = spark.createDataFrame([("a", ["int", "char *", "double"]), ("b", ["void"]), ("c", None)], "s string, sig array<string>")
    got = {r["s"]: r["t"] for r in df.select("s", c.truth(F.col("sig")).alias("t")).collect()}
    assert got["a"]["argument_kinds"] == ["pointer", "unsupported_float"] and got["a"]["unsupported"] == ["unsupported_argument_abi_class"]
    assert got["b"]["return_kind"] == "void" and got["b"]["argument_kinds"] == [] and got["c"] is None
    kinds = "s string, rank int, argument_kinds array<string>, return_kind string"
    found = spark.createDataFrame([("a", 0, ["integer"], "void"), ("a", 1, ["pointer"], "void"), ("b", 0, ["integer"], "integer")], kinds)
    true = spark.createDataFrame([("a", ["pointer"], "void"), ("b", ["integer"], "void"), ("z", [], "void")], "s string, argument_kinds array<string>, return_kind string")
    hits = {r["s"]: r for r in c.hit_ranks(found, true, "s", "rank").collect()}
    assert hits["a"]["hit_rank"] == 1 and not hits["a"]["top1"] and hits["b"]["return_only_error"] and hits["z"]["candidates"] == 0


def test_violations_and_capability(spark):
    good = ([(0, "RDI", "o", 0.5), (1, "RSI", None, 1.0)], [("o", "RDI", 8)], [("no_alias", 0)], ["strlen"])
    bad = ([(1, "RDI", "q", 2.0), (1, "XMM0", None, 1.0)], [("o", "RDX", 99999)], [("odd", 0), ("fixed_offset_alias", 4)], ["mystery"])
    df = spark.createDataFrame([(good,), (bad,)], CONTRACT)
    rows = df.select(c.violations(F.col("c")).alias("v"), c.capability(F.col("c"), ["strlen"], ["puts"]).alias("k")).collect()
    assert rows[0]["v"] == [] and rows[0]["k"]["status"] == "supported"
    assert rows[1]["v"] == ["duplicate_slot", "unknown_object_reference", "object_without_register", "unknown_relation", "nonzero_alias_offset", "confidence_out_of_range"]
    assert rows[1]["k"]["reasons"] == ["object_size_exceeds_limit", "unsupported_argument_slot", "unsupported_relation:odd", "unsupported_unknown_external_dependency:mystery"]


def test_symbols(spark):
    rows = [(1, "f", ".text", "NOTYPE", "GLOBAL", 9, 0), (1, "f", ".text", "FUNC", "LOCAL", 4, 1), (1, "f", None, "FUNC", "GLOBAL", 4, 2), (1, "g", ".data", "OBJECT", "LOCAL", 4, 3), (1, "h", ".bss", "OBJECT", "WEAK", 4, 4)]
    s = spark.createDataFrame(rows, "file int, name string, section string, type string, bind string, size long, position int")
    assert c.target_symbol(s, spark.createDataFrame([(1, "f")], "file int, name string"), "file").first()["position"] == 1
    none, g = spark.createDataFrame([], "file int, name string"), spark.createDataFrame([(1, "g")], "file int, name string")
    assert [r["name"] for r in c.global_objects(s, none, "file").collect()] == ["h"] and [r["name"] for r in c.global_objects(s, g, "file").collect()] == ["h", "g"]


def test_validation(spark):
    df = spark.createDataFrame([("g", "O0", 1), ("g", "O0", 2), ("h", "O0", 1), ("h", "O1", 1)], "g string, l string, v int")
    assert sorted(map(tuple, validation.group_errors(df, "g", "l", ["O0", "O1"], ["v"]).collect())) == [("g", "differs:v"), ("g", "missing_level"), ("g", "repeated_level")]
    assert validation.dataset_errors(df, "g", "l", 4, 2, {"O0": 2}) == ["n_O0: 3 instead of 2"]
    with pytest.raises(ValueError):
        validation.prompt("{x} {y}", {"x": F.lit(1)})
    assert spark.range(1).select(validation.prompt("a{x}b", {"x": F.lit(1)})).first()[0] == "a1b"


def test_resolution_paths(spark):
    rows = [("frozen", "accepted", "accepted", False, None), ("unverified", "rejected", None, True, None), ("probed", "ambiguous", None, False, "x"), ("failed", "", None, False, None)]
    df = spark.createDataFrame(rows, "status string, audit string, holdout string, probed boolean, ambiguity string")
    path = validation.resolution_path(*(F.coalesce(F.col(x), F.lit("")) if x in ("audit", "ambiguity") else F.col(x) for x in ("status", "audit", "holdout", "probed", "ambiguity")))
    got = df.select(path.alias("p"))
    tails = [r["p"][4:] for r in got.collect()]
    assert tails == [["frozen"], ["retryable_rejected", "probed", "unverified"], ["ambiguous", "behavioral_equivalence_class", "probed"], ["failed"]]
    counts = {(r["source"], r["target"]): r["n"] for r in sequences.path_transitions(got, "p").collect()}
    assert counts["initial", "static_inferred"] == 4 and counts["probed", "frozen"] == 1
