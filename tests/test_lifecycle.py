"""A run from samples to reports with plugins, imports, protocols, the gate, deliveries and records from artifacts."""

import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyrail import __main__ as cli
from tallyrail import runs
from tallyrail.functions import settings
from tallyrail.operators import protocols, records, validation
from tallyrail.sources import delivery, readers


def backend():
    """Echoes the assembly in a fence; fails on a sample that says so."""

    def answer(pdf):
        if any("crash" in a["text"] for a in pdf["assembly"]):
            raise RuntimeError("no answer")
        assert "private_payload" not in pdf and set(pdf["pseudocode"]) == {None}
        return pd.DataFrame({"sample_id": pdf["sample_id"], "success": True, "code": ["```c\n" + a["text"] + "\n```" for a in pdf["assembly"]], "reason": None, "detail": None})

    return answer


def evaluator():
    """A candidate passes if it is the sample's own source."""

    def judge(pdf):
        ok = [c == p["code"] for c, p in zip(pdf["code"], pdf["private_payload"], strict=True)]
        return pd.DataFrame({"sample_id": pdf["sample_id"], "compile_pass": True, "link_pass": True, "behavioral_pass": ok, "reason": [None if o else "output_mismatch" for o in ok], "tests_total": 1, "tests_passed": [int(o) for o in ok], "detail": None})

    return judge


@pytest.fixture
def given(spark, tmp_path):
    spark.sparkContext.environment["PYTHONPATH"] = ":".join(filter(None, [str(__file__).rsplit("/", 1)[0], spark.sparkContext.environment.get("PYTHONPATH", "")]))
    row = lambda i, asm: {"sample_id": f"s{i}", "source_group_id": "g", "function_name": "f", "optimization": f"O{i % 2}", "source": {"code": f"int f{i};", "signature": ["int"]}, "assembly": {"v": asm}}
    (tmp_path / "d.json").write_text(json.dumps({"samples": [row(0, "int f0;"), row(1, "int f1;"), row(2, "wrong"), row(3, " ")]}))
    (tmp_path / "e.json").write_text(json.dumps({"samples": [row(0, "crash")]}))
    module = __name__.rsplit(".", 1)[-1]
    raw = {
        "datasets": [{"id": "d", "type": "flat", "path": str(tmp_path / "d.json"), "assembly_view": "v", "evaluator": f"{module}:evaluator", "evaluation_protocol": "json_io"}, {"id": "e", "type": "flat", "path": str(tmp_path / "e.json"), "assembly_view": "v"}],
        "decompilers": [{"id": "b", "type": "plugin", "plugin": f"{module}:backend"}],
        "allowed_modules": [module], "output": {"cache": str(tmp_path / "cache")},
    }
    path = tmp_path / "settings.json"
    path.write_text(json.dumps(raw))
    return str(path)


def test_a_run_from_samples_to_reports(spark, given, tmp_path, capsys):
    run = str(tmp_path / "run")
    assert cli.main(["run", "--config", given, "--run-dir", run]) == 0
    got = {(r["dataset_id"], r["sample_id"]): r for r in readers.run_results(spark, run).collect()}
    assert {k: (r["decompile_success"], r["behavioral_pass"], r["reason"]) for k, r in got.items()} == {
        ("d", "s0"): (True, True, None), ("d", "s1"): (True, True, None), ("d", "s2"): (True, False, "output_mismatch"), ("d", "s3"): (False, False, "assembly_missing"), ("e", "s0"): (False, None, "backend_error"),
    }
    assert json.loads(capsys.readouterr().out)["generations"] == 5 and spark.read.json(f"{run}/report/by_dataset.json").count() == 2
    # Once more on the same run: nothing is asked for again; on a new run the cache answers, and failures are tried again.
    assert cli.main(["generate", "--config", given, "--run-dir", run, "--resume"]) == 0
    assert readers.json_lines(spark, f"{run}/generations.jsonl", runs.GENERATIONS).count() == 5
    full = settings.read(given)
    again = runs.generate(spark, full, str(tmp_path / "run2"))
    assert {(r["sample_id"], r["success"]) for r in again.where("dataset_id = 'd'").collect()} == {("s0", True), ("s1", True), ("s2", True), ("s3", False)}
    assert cli.main(["evaluate", "--config", given, "--run-dir", run]) == 0
    assert cli.main(["validate-dataset", "--config", given]) == 2  # one dataset has no evaluator
    totals = runs.validate(spark, full | {"datasets": full["datasets"][:1]}).orderBy("optimization").collect()
    assert [(r["optimization"], r["total"], r["valid"]) for r in totals] == [("O0", 2, 2), ("O1", 2, 2)]
    capsys.readouterr()
    assert cli.main(["import-run", "--run-dir", run, "--cache-dir", str(tmp_path / "imports")]) == 0
    assert json.loads(capsys.readouterr().out) == {"imported": 3, "skipped": {"backend_config_or_artifact_missing": 2}}
    assert runs.import_run(spark, run, str(tmp_path / "imports"))["imported"] == 3
    assert runs.import_run(spark, run, str(tmp_path / "imports"), ["other"]) == {"imported": 0, "skipped": {"backend_config_or_artifact_missing": 5}}
    assert cli.main(["import-run", "--run-dir", run]) == 2


def test_a_changed_candidate_is_not_imported(spark, tmp_path):
    def write(code):
        (tmp_path / "r").mkdir(exist_ok=True)
        (tmp_path / "r" / "generations.jsonl").write_text(json.dumps({"dataset_id": "d", "backend_id": "b", "sample_id": "s", "success": True, "code": code, "evaluated": True}) + "\n")

    write("a")
    assert runs.import_run(spark, str(tmp_path / "r"), str(tmp_path / "c"))["imported"] == 1
    write("b")
    assert runs.import_run(spark, str(tmp_path / "r"), str(tmp_path / "c")) == {"imported": 0, "skipped": {"cache_conflict_preserved_existing": 1}}
    assert [r["candidate"] for r in spark.read.parquet(f"{tmp_path}/c/imported").collect()] == ["a"]


def test_wrappers_and_exit_codes(spark):
    rows = [('a extern "C"\n{ int x;\n} b extern "C" { y }',), ("no block",), ('extern "C"{x}',), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "w string").select(protocols.rewritten_wrapper(F.col("w"), F.lit("/p$1.c"))).collect()]
    assert got[0]["code"] == 'a extern "C"\n{\n#include "/p$1.c"\n} b extern "C" { y }' and [g["reason"] for g in got] == [None, *["wrapper_rewrite_failed"] * 3]
    codes = [(True, False, 0), (True, False, 3), (True, True, None), (False, None, None), (True, None, None)]
    got = [tuple(r[0]) for r in spark.createDataFrame(codes, "c boolean, t boolean, e int").select(protocols.exit_code_evidence(F.col("c"), F.col("t"), F.col("e"))).collect()]
    assert got == [(True, True, None), (True, False, "test_failed"), (True, False, "test_timeout"), (False, False, "compile_error"), (True, False, "runtime_error")]


def test_json_evidence(spark):
    ok = [("candidate_compile", "passed"), ("fixture_prepare", "passed"), ("fixture_link", "passed")]
    stages = {"good": ok, "slow": [("candidate_compile", "timeout")], "wrap": [*ok[:1], ("fixture_prepare", "error")], "link": [*ok[:2], ("fixture_link", "timeout")], "none": ok, "bad": ok}
    cases = {"good": ["pass", "pass"], "bad": ["pass", "invalid_output", "timeout", "runtime_error", "output_mismatch"], "link": ["pass"], "none": []}
    c = spark.createDataFrame([(k,) for k in [*stages, "lost"]], "k string")
    s = spark.createDataFrame([(k, *x) for k, xs in stages.items() for x in xs], "k string, name string, outcome string")
    t = spark.createDataFrame([(k, i, o) for k, os_ in cases.items() for i, o in enumerate(os_)], "k string, index int, outcome string")
    got = {r["k"]: tuple(r)[1:] for r in protocols.json_evidence(c, s, t, ["k"]).collect()}
    assert got == {
        "good": (True, True, True, None, 2, 2, 0, 0, 0), "slow": (False, False, False, "compile_timeout", 0, 0, 0, 0, 0), "wrap": (True, False, False, "wrapper_rewrite_failed", 0, 0, 0, 0, 0),
        "link": (True, False, False, "link_timeout", 0, 0, 0, 0, 0), "none": (True, True, False, "no_tests", 0, 0, 0, 0, 0), "bad": (True, True, False, "invalid_output", 5, 1, 1, 1, 2), "lost": (False, False, False, "compile_error", 0, 0, 0, 0, 0),
    }


def test_gate_of_a_backend(spark):
    schema = "dataset_id string, sample_id string, source_group_id string, function_name string, optimization string, binary struct<path:string>, pseudocode struct<text:string,view:string>, assembly struct<text:string,view:string>, oracle_context string, compile_context string, metadata string"
    good = ["d", "s", "g", "f", "O0", ("p",), ("code", "v"), ("ret", "w"), None, None, '{"b": 1, "a": {"x": 2}}']
    rows = [good] + [[*good[:i], v, *good[i + 1 :]] for i, v in ((5, None), (6, None), (7, (" ", "w")), (8, "o"), (9, "c"), (10, '{"a": {"IoPairs": 1}}'))]
    got = protocols.gate(spark.createDataFrame(rows, schema))
    assert [r["reason"] for r in got.collect()] == [None, "missing_binary", "missing_pseudocode", "missing_assembly", "private_oracle_exposed", "private_compile_context_exposed", "private_metadata_exposed"]
    assert protocols.gate(spark.createDataFrame(rows[-1:], schema), strict=False).first()["reason"] is None
    audit = got.limit(1).select(protocols.audited_request().alias("a")).first()["a"]
    assert audit["metadata_keys"] == ["a", "b"] and audit["binary"] == "p" and audit["pseudocode_view"] == "v"
    failed = got.where("reason = 'missing_binary'").select(protocols.failure_metadata(F.col("reason"), F.col("detail"), "x_").alias("m")).first()["m"]
    assert (failed["unsupported_reason"], failed["stop_reason"], failed["executions"]) == ("x_missing_binary", "x_missing_binary", 0)
    assert spark.range(1).select(protocols.backend_version(F.lit("v"), F.lit("0123456789abcdef"), F.lit("{}"))).first()[0].startswith("v:impl-0123456789ab:contract-")


RECORDS = [("a", "g1", "O0", ["initial", "static_inferred", "frozen"], True, 3, 1, 0.5, None), ("b", "g1", "O1", ["initial", "failed"], False, None, None, None, ""), ("c", "g2", None, ["initial", "static_inferred"], None, 2, 1, 1.0, "risk|x")]


def test_delivery(spark, tmp_path):
    rows = spark.createDataFrame(RECORDS, delivery.RECORD)
    strata = {r["stratum"]: r for r in delivery.stratified(rows).collect()}
    assert set(strata) == {"overall", "optimization=O0", "optimization=O1", "optimization=unknown", "source_group=g1", "source_group=g2"}
    assert (strata["overall"]["total"], strata["overall"]["frozen_harnesses"], strata["overall"]["terminal_states"], strata["overall"]["executions"]) == (3, 1, 2, 5) and 0 < strata["overall"]["freeze_rate_low"] < 1 / 3 < strata["overall"]["freeze_rate_high"]
    assert {tuple(r) for r in delivery.transitions(rows).collect()} == {("initial", "static_inferred", 2), ("static_inferred", "frozen", 1), ("initial", "failed", 1)}
    run = tmp_path / "run-1"
    (run / "artifacts").mkdir(parents=True)
    (run / "artifacts" / "x.json").write_text("{}")
    first = delivery.deliver(rows, str(run), "trial", {"commit": "c"})
    again = delivery.deliver(rows, str(run), "trial", {"commit": "c"})
    assert first == again and first["sample_count"] == 3 and any(e["path"].endswith("artifacts/x.json") for e in first["entries"]) and first["entries"]
    assert "| failed | unknown | 1 | b |" in spark.read.text(f"{run}/reports/failure_catalog.md").toPandas()["value"].tolist() and "| static_inferred | risk\\|x | 1 | c |" in spark.read.text(f"{run}/reports/failure_catalog.md").toPandas()["value"].tolist()
    (run / "artifacts" / "x.json").write_text("{ }")
    assert delivery.deliver(rows, str(run), "trial", {"commit": "c"})["content_hash"] != first["content_hash"]
    assert delivery.stratified(rows.limit(0)).count() <= 1 and delivery.cost(rows, ["executions"]).first()["executions_mean"] == 5 / 3


def test_records_from_artifacts(spark):
    rows = [("a", "score", '{"x": 1, "more": [1]}'), ("a", "taint", "{broken"), ("b", "score", None), ("b", "taint", '{"t": [1, 2]}'), ("c", "other", "{}")]
    got = {r["k"]: r for r in records.assembled_from_json(spark.createDataFrame(rows, "k string, name string, text string"), {"score": "x int", "taint": "t array<int>"}, ["k"]).collect()}
    assert got["a"]["score"]["x"] == 1 and got["a"]["taint"] is None and got["a"]["broken"] == ["taint"]
    assert got["b"]["score"] is None and got["b"]["taint"]["t"] == [1, 2] and got["b"]["broken"] == [] and got["c"]["score"] is None


def test_holdouts_and_equivalence_classes(spark):
    explored = spark.createDataFrame([(i, "accepted" if i < 6 else "rejected", "k1") for i in range(7)], "s int, decision string, selected string")
    held = spark.createDataFrame([(0, "accepted", "k1"), (1, "rejected", None), (2, "accepted", "k2"), (3, "accepted", "k1"), (4, "accepted", "k1")], "s int, decision string, selected string")
    digests = spark.createDataFrame([(i, "h", "h" if i != 3 else "x") for i in (0, 1, 2, 3, 5)], "s int, committed string, replayed string")
    got = {r["s"]: (r["holdout"], r["reason"]) for r in records.audited_holdouts(explored, held, digests, ["s"]).collect()}
    assert got == {0: ("accepted", None), 1: ("rejected", "holdout_rejected"), 2: ("rejected", "holdout_selected_another_contract"), 3: ("rejected", "holdout_changed_after_commitment"), 4: ("rejected", "holdout_not_committed"), 5: ("rejected", "holdout_not_run")}
    seen = spark.createDataFrame([(1, "k2", "p", "x"), (1, "k1", "p", "x"), (2, "k1", "p", "x"), (2, "k2", "p", "y")], "s int, c string, p string, v string")
    found = records.equivalence_classes(records.discriminate(seen, ["s"], "c", "p", "v"), seen, ["s"], "c").collect()
    assert [(r["s"], r["status"], r["behavioral_contract"], r["source_level_alternatives"], r["safe_probe_count"]) for r in found] == [(1, "unidentifiable_from_binary", "k1", ["k1", "k2"], 1)]


def test_evidence_and_images(spark):
    contract = "struct<evidence_ids:array<string>,return_spec:struct<evidence_ids:array<string>>,arguments:array<struct<evidence_ids:array<string>>>,objects:array<struct<evidence_ids:array<string>>>>"
    rows = [((["b", "a"], (["c"],), [(["a", "d"],), (None,)], None),), ((None, None, [], []),)]
    assert [r[0] for r in spark.createDataFrame(rows, f"k {contract}").select(records.static_evidence(F.col("k"))).collect()] == [["a", "b", "c", "d"], []]
    images = spark.createDataFrame([({"o": ("ff",), "p": (None,)},), (None,)], "m map<string,struct<after_bytes_hex:string>>")
    assert [r[0] for r in images.select(records.after_images(F.col("m"))).collect()] == [{"o": "ff", "p": None}, {}]


def test_stored_counts(spark):
    empty = spark.createDataFrame([], validation.CHECKED)
    zero = {"samples": 0, "instructions": 0, "relocations_merged": 0, "internal_labels_generated": 0, "samples_available": 0}
    assert validation.count_errors(empty, zero) == []
    assert validation.count_errors(empty, {**{k: v for k, v in zero.items() if k != "instructions"}, "samples": 2}) == ["samples: 2 stored, 0 found", "instructions: not stored, 0 found"]


def test_retries_and_embeddings(spark):
    waits, calls = [], []

    def make():
        def answer(pdf):
            calls.append(list(pdf["sample_id"]))
            if len(calls) == 2:
                raise RuntimeError("busy")
            return pd.DataFrame({"sample_id": pdf["sample_id"], "code": ["x" if len(calls) > 3 or s == "a" else " " for s in pdf["sample_id"]]})

        return answer

    from tallyrail.sources import providers

    got = providers.retried(make, "code", 4, 1.0, 1.5, waits.append)()(pd.DataFrame({"sample_id": ["a", "b", "c"]}))
    assert dict(zip(got["sample_id"], got["code"], strict=True)) == {"a": "x", "b": "x", "c": "x"} and calls == [["a", "b", "c"], ["b", "c"], ["b", "c"], ["b", "c"]] and waits == [1.0, 1.5, 1.5]
    calls.clear()
    got = providers.retried(make, "code", 1, sleep=waits.append)()(pd.DataFrame({"sample_id": ["a", "b"]}))
    assert list(got["code"]) == ["x", " "]
    with pytest.raises(RuntimeError):
        providers.retried(make, "code", 1, sleep=waits.append)()(pd.DataFrame({"sample_id": ["a"]}))

    def vectors():
        def answer(pdf):
            if (pdf["text"] == "bad").any():
                raise ValueError("no vector")
            return pd.DataFrame({"id": pdf["id"], "vector": [[float(len(t))] for t in pdf["text"]]})

        return answer

    rows = providers.embed(spark.createDataFrame([(1, "ab"), (2, "bad"), (3, "abc")], "id long, text string").coalesce(1), vectors, batch_size=1)
    assert {r["id"]: (r["vector"], r["reason"]) for r in rows.collect()} == {1: ([2.0], None), 2: (None, "embedding_error"), 3: ([3.0], None)}


def test_evidence_ids_and_phase_reports(spark, tmp_path):
    import hashlib

    from tallyrail.functions.keys import canonical, evidence_id
    from tallyrail.sources import writers

    df = spark.createDataFrame([("s\"1", "c", "h", "p", ["return", "memory"]), ("é", "c", None, "p", None)], "s string, c string, h string, p string, k array<string>")
    want = [hashlib.sha256(canonical({"sample_id": r["s"], "contract_hash": r["c"], "harness_hash": r["h"], "probe_id": r["p"], "difference_kinds": r["k"] or []}).encode()).hexdigest() for r in df.collect()]
    assert [r[0] for r in df.select(evidence_id(*(F.col(c) for c in "schpk"))).collect()] == want
    rows = spark.createDataFrame([("b", "O1", 1), ("a", "O0", 2)], "sample_id string, optimization string, n int")
    summary = rows.groupBy("optimization").agg(F.sum("n").alias("n")).union(rows.agg(F.lit(None).cast("string"), F.sum("n")))
    writers.phase_report(rows, summary, str(tmp_path / "p"))
    assert [tuple(r) for r in spark.read.csv(f"{tmp_path}/p/summary.csv", header=True).collect()] == [("overall", "3"), ("optimization=O0", "2"), ("optimization=O1", "1")]
    assert spark.read.json(f"{tmp_path}/p/records.jsonl").count() == 2
    got = [tuple(r[0]) for r in spark.createDataFrame([("passed",), ("timeout",), (None,)], "o string").select(protocols.object_evidence(F.col("o"))).collect()]
    assert got == [(True, None, None, None, ["candidate_compile"]), (False, None, None, "compile_timeout", ["candidate_compile"]), (False, None, None, "compile_error", ["candidate_compile"])]


def test_baselines_of_a_run(spark, tmp_path, capsys):
    import hashlib

    from tallyrail.functions.keys import canonical

    digest = lambda value: hashlib.sha256(canonical(value).encode()).hexdigest()
    run = tmp_path / "run"
    for name in ("a", "b"):
        d = run / "artifacts" / name
        d.mkdir(parents=True)
        core = {"schema_version": "v2", "status": "frozen", "mutation_after_freeze_allowed": False, "contract_id": "k", "contract_hash": "h", "probe_plan_hash": digest([{"p": 1}]), "holdout_probe_plan_hash": digest([{"p": 2}]), "observation_policy_hash": digest({}), "exploration_probe_count": 1, "holdout_probe_count": 1, "probe_count": 2}
        files = {
            "public_request.json": {"sample_id": name}, "harness_manifest.json": core | {"content_hash": digest(core)}, "metadata.json": {"harness_frozen": True, "contract_selection_status": "audit_accepted_frozen"}, "selected_contract.json": {"contract_id": "k", "content_hash": "h"},
            "observation_policy.json": {}, "probe_plan.jsonl": {"p": 1}, "holdout_probe_plan.jsonl": {"p": 2}, "original_observations.jsonl": {"o": 1}, "holdout_observations.jsonl": {"o": 2}, "original_runner.x": {},
        }
        for file, value in files.items():
            if (name, file) != ("b", "original_runner.x"):
                (d / file).write_text(json.dumps(value))
    (run / "artifacts" / "c").mkdir()
    (run / "artifacts" / "c" / "public_request.json").write_text('{"sample_id": "c"}')
    out = str(tmp_path / "baseline")
    assert cli.main(["create-baseline", "--run-dir", str(run), "--output", out]) == 0
    made = json.loads(capsys.readouterr().out)
    assert (made["frozen_harnesses"], made["valid_frozen_harnesses"], made["failure_reason_counts"]) == (2, 1, {"original_runner_present": 1})
    assert cli.main(["replay-baseline", "--run-dir", str(run), "--baseline", out]) == 0 and json.loads(capsys.readouterr().out) == {"states": {"match": 2}, "equal": True}
    (run / "artifacts" / "a" / "original_observations.jsonl").write_text('{"o": 3}')
    (run / "artifacts" / "b" / "harness_manifest.json").unlink()
    assert cli.main(["replay-baseline", "--run-dir", str(run), "--baseline", out]) == 0 and json.loads(capsys.readouterr().out) == {"states": {"changed": 1, "missing": 1}, "equal": False}
    broken = json.loads(spark.read.text(out, wholetext=True).first()["value"]) | {"frozen_harnesses": 3}
    (tmp_path / "broken.json").write_text(json.dumps(broken))
    assert cli.main(["replay-baseline", "--run-dir", str(run), "--baseline", str(tmp_path / "broken.json")]) == 2
