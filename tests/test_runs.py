"""Records of runs, settings, the command line and the kernels beside them, on literals."""

import json

import pytest
from pyspark.sql import functions as F

from tallyrail import __main__ as cli
from tallyrail import runs
from tallyrail.functions import settings
from tallyrail.functions import text as t
from tallyrail.operators import records


def test_settings(tmp_path):
    good = {"datasets": [{"id": "d", "type": "flat", "path": "x"}], "decompilers": [{"id": "b", "type": "command"}]}
    done = settings.complete(good)
    assert done["executor"]["memory_mb"] == 2048 and done["preflight"]["mode"] == "strict" and done["_config_hash"] == settings.complete(dict(reversed(good.items())))["_config_hash"]
    assert done["metrics"] == ["recompilable", "behavioral_pass"] and done["postprocessors"] == ["markdown_fence"]
    bad = {"datasets": [{"id": "d", "type": "flat"}, {"id": "d", "type": "f", "path": "x", "selection_manifest": "m", "limit": 1, "evaluation_protocol": 3}], "preflight": {"mode": "maybe"}}
    assert settings.problems(bad) == [
        "decompilers: a list with at least one row is needed", "datasets[0].path: no value", "datasets[1].id: 'd' is there twice",
        "datasets[1].evaluation_protocol: int instead of str or dict", "datasets[1].limit: not together with selection_manifest", "preflight.mode: 'maybe' is none of strict, warn, off",
    ]
    # Kinds first: what is no mapping is named, nothing crashes.
    assert settings.problems({**done, "datasets": ["x"]}) == ["datasets[0]: no mapping"]
    assert settings.problems({**done, "preflight": None}) == ["preflight.mode: None is none of strict, warn, off"]
    assert settings.problems(["x"]) == ["the settings are no mapping"] and settings.problems({**done, "metrics": "all"}) == ["metrics: str instead of list"]
    for wrong in (bad, ["x"], None, {**good, "preflight": None}):
        with pytest.raises(ValueError, match="cannot be used"):
            settings.complete(wrong)
    assert settings.resolve_path("a", "/b") == "/b/a" and settings.resolve_path("/a", "/b") == "/a"
    path = tmp_path / "c.json"
    path.write_text(json.dumps(good))
    assert cli.main(["validate-config", "--config", str(path)]) == 0
    path.write_text("[1]")
    assert cli.main(["validate-config", "--config", str(path)]) == 2
    path.write_text("{}")
    assert cli.main(["validate-config", "--config", str(path)]) == 2 and cli.main(["list-plugins"]) == 0


def test_command_line_over_a_run(spark, tmp_path):
    rows = [{"dataset_id": "d", "backend_id": b, "sample_id": f"s{i}", "decompile_success": True, "recompilable": i > 0, "behavioral_pass": i > 1, "reason": None if i > 1 else "compile_failed", "capabilities": ["recompile", "behavioral"]} for i in range(4) for b in ("x", "y")]
    run = tmp_path / "run"
    run.mkdir()
    (run / "results.jsonl").write_text("".join(json.dumps(r) + "\n" for r in rows))
    manifest = tmp_path / "m.json"
    manifest.write_text(json.dumps({"entries": [{"dataset_id": "d", "sample_id": "s1"}, {"dataset_id": "d", "sample_id": "s3"}]}))
    assert runs.report(spark, str(run))["records"] == 8 and spark.read.json(f"{run}/report/by_backend.json").count() == 2
    assert cli.subset(spark, str(run), str(manifest), str(tmp_path / "sub"))["records"] == 4
    manifest.write_text(json.dumps({"entries": [{"dataset_id": "d", "sample_id": "s9"}]}))
    with pytest.raises(ValueError):
        cli.subset(spark, str(run), str(manifest), str(tmp_path / "sub2"))


def test_merged_objects(spark):
    o, rel = "array<struct<object_id:string,min_size:int,alignment:int>>", "array<struct<kind:string,left:string,right:string,offset:int>>"
    objects = [("a", 4, 16), ("b", 8, 1), ("c", 2, 4)]
    cases = [([], 3, []), ([("must_alias", "b", "a", None)], 2, []), ([("fixed_offset_alias", "c", "b", 0), ("must_alias", "a", "b", None), ("no_alias", "a", "c", None)], 1, ["no_alias_conflict"]), ([("fixed_offset_alias", "a", "b", 4)], 3, ["nonzero_fixed_offset_alias"])]
    df = spark.createDataFrame([(objects, c[0]) for c in cases], f"o {o}, r {rel}")
    got = [r[0] for r in df.select(records.merged_objects(F.col("o"), F.col("r"))).collect()]
    assert [(len(g["objects"]), g["errors"]) for g in got] == [c[1:] for c in cases]
    assert tuple(got[1]["objects"][0]) == ("a", 8, 16) and tuple(got[2]["objects"][0]) == ("a", 8, 16)


def test_observations_strategies_and_requests(spark):
    df = spark.createDataFrame([("returned", "integer", 5, None, None), ("returned", "pointer", None, "o1", 8), ("returned", "pointer", 1, "", None), ("signal", "integer", 5, None, None), ("returned", None, 5, None, None)], "s string, k string, rax long, p string, o long")
    got = [tuple(r[0]) for r in df.select(records.normalized_observation(*(F.col(c) for c in "sk"), F.col("rax"), F.col("p"), F.col("o"))).collect()]
    assert got == [(True, "integer", 5, None, None), (True, "object_pointer", 8, "o1", None), (False, "not_comparable", None, None, "pointer_outside_known_object"), (False, None, None, None, "void_or_unknown"), (False, None, None, None, "void_or_unknown")]
    df = spark.createDataFrame([(["audit:effect_below_threshold"],), (["boundary_below_threshold", "stable_below_threshold"],), (["x:stable_below_threshold"],), ([],)], "r array<string>")
    assert [r[0] for r in df.select(records.probe_strategy(F.col("r"))).collect()] == ["effect_boundary", "boundary_pair", "stability_replay", "safe_neighborhood"]
    samples = spark.createDataFrame([(i, "O0" if i % 2 else "O1") for i in range(6)], "ordinal int, optimization string")
    assert records.single_request(samples, "O0", 1, ["ordinal"]).collect()[0]["ordinal"] == 3 and records.single_request(samples, "O0", 9, ["ordinal"]).count() == 0


def test_source_kernels(spark):
    text = ".file x\n.globl f\n.type f, @function\ng:\n ret\n.size g, 1\nf:\n  ret\n  .size f, .-f\nh:\n"
    df = spark.createDataFrame([(text, "f"), (text, "nope"), ("f:\n ret", "f")], "t string, n string")
    assert [r[0] for r in df.select(t.target_assembly(F.col("t"), F.col("n"))).collect()] == [".globl f\n.type f, @function\nf:\n  ret\n  .size f, .-f\n", None, "f:\n ret"]
    df = spark.createDataFrame([("/tmp/a/candidate.o:     file format elf64\nx candidate.o: y\n",)], "t string")
    assert df.select(t.disassembly_header(F.col("t"))).first()[0] == "candidate.o:     file format elf64\nx candidate.o: y\n"
    df = spark.createDataFrame([("a.c:1: error: 'foo' undeclared\nerror: use of undeclared identifier 'bar'\n'foo' undeclared",)], "d string")
    assert df.select(t.undeclared(F.col("d"))).first()[0] == ["bar", "foo"]
    df = spark.createDataFrame([("extern int foo;", "foo"), ("int foo;", "foo"), ("extern int foo; int x;", "foo")], "d string, n string")
    assert [r[0] for r in df.select(t.public_declaration(F.col("d"), F.col("n"))).collect()] == ["extern int foo;", None, None]
    df = spark.createDataFrame([("0100000002000000", 100, 104, "L", "i32"), ("0100000002000000", 100, 100, "L", "u32[2]"), ("01", 100, None, "L", "u8"), ("01", 100, 100, "L", "f64"), ("01", 100, 100, "L", "x9")], "a string, b long, c long, d string, e string")
    assert [r[0] for r in df.select(t.decode_rodata(*(F.col(c) for c in "abcde"))).collect()] == ["2", "[1, 2]", "Not Found L!", "Read L failed!", "Read L failed!"]


def stored(i, level):
    """A sample that breaks no rule."""
    import hashlib

    h = lambda x: hashlib.sha256(x.encode()).hexdigest()
    intel, att, full, io = "run:\n    ret\n.L_1:\n", "run:\n    ret\n", "full", '[{"a":1}]'
    listing = "0 <run>:\n R_X86_64_PC32 x"
    return {
        "sample_id": f"g{i}:{level}", "legacy_name": f"l{i}{level}", "source_group_id": f"g{i}", "function_name": "run", "optimization": level, "source": {"code": "int f;", "code_sha256": h("int f;")},
        "evaluation": {"dependencies": "", "dependencies_sha256": h(""), "executable_wrapper": "w", "executable_wrapper_sha256": h("w"), "io_pairs": io, "io_pair_count": 1, "io_pairs_sha256": h(io), "method": "ground_truth_c_source", "passed": True, "uses_reference_assembly": False, "compiler_flags": [f"-{level}"]},
        "assembly": {"gcc_target_assembly": "t", "gcc_target_assembly_sha256": h("t"), "full_translation_unit_assembly": full, "full_translation_unit_assembly_sha256": h(full), "objdump_intel_with_relocations": listing, "objdump_intel_sha256": h(listing), "objdump_intel_instruction_only": intel, "objdump_intel_instruction_only_sha256": h(intel), "objdump_intel_instruction_only_syntax": "Intel", "objdump_att_instruction_only": att, "objdump_att_instruction_only_sha256": h(att), "objdump_att_instruction_only_syntax": "AT&T"},
        "assembly_validation": {"assembled": True, "linked": True, "behavioral_pass": True, "tests_total": 1, "tests_passed": 1, "validated_full_assembly_sha256": h(full)},
        "decompilation": {"ghidra": {"code": "c", "sha256": h("c"), "producer": "ghidra", "version": "1", "function_name": "run", "input_kind": "target-object", "input_binary_sha256": "0" * 64}}, "binary": {"path": "b", "sha256": "0"},
    }


def test_stored_dataset(spark):
    from tallyrail.operators import validation as v

    good = [stored(i, x) for i in range(2) for x in v.LEVELS]
    df = spark.createDataFrame(good, v.CHECKED)
    assert v.stored_dataset_errors(df, 8, 2, pseudocode=True, passed=df).count() == 0
    assert v.view_counts(df).first().asDict() == {"samples": 8, "instructions": 8, "relocations_merged": 8, "internal_labels_generated": 8, "samples_available": 8}
    bad = [stored(i, x) for i in range(2) for x in v.LEVELS]
    bad[0]["source"]["code"], bad[1]["evaluation"]["passed"], bad[2]["assembly"]["objdump_att_instruction_only_syntax"] = "int g;", None, "Intel"
    bad[3]["assembly_validation"]["tests_passed"], bad[4]["decompilation"]["ghidra"]["input_binary_sha256"], bad[5]["optimization"] = 0, "x", "O0"
    got = {tuple(r) for r in v.stored_dataset_errors(spark.createDataFrame(bad, v.CHECKED), 8, 2, pseudocode=True, passed=df.where("sample_id <> 'g0:O0'")).collect()}
    assert got == {
        ("g0:O0", "source"), ("g0:O1", "evaluation_passed"), ("g0:O2", "att_view_syntax"), ("g0:O3", "assembly_passed"), ("g1:O0", "pseudocode_input_hash"), ("g1:O1", "compiler_flag"),
        ("g1", "missing_level"), ("g1", "repeated_level"), ("dataset", "n_O0: 3 instead of 2"), ("dataset", "n_O1: 1 instead of 2"), ("g0:O0", "not_passed_in_report"),
    }
