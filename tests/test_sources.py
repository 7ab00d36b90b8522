"""Readers, providers and the stream on files of a temporary folder."""

import json

import pytest
from pyspark.sql import functions as F

from tallyrail.sources import providers, readers, writers
from tallyrail.streaming import results as stream

ROW = {"sample_id": "d:s:0:O0", "source_group_id": "d:s:0", "function_name": "f", "optimization": "O0", "source_metadata": {"language": "c"}, "source": {"code": "int f(){}", "signature": ["int"]}, "assembly": {"intel_view": "ret"}, "decompilation": {"g": {"code": "x"}}}


def test_flat_dataset(spark, tmp_path):
    path = tmp_path / "flat.json"
    path.write_text(json.dumps({"samples": [ROW, {**ROW, "sample_id": "b", "optimization": "O1"}, {**ROW, "sample_id": "c"}]}))
    got = readers.flat_dataset(spark, str(path), "intel_view", "g", ["O0"], 1).collect()
    assert [r["sample_id"] for r in got] == ["d:s:0:O0"] and got[0]["assembly"]["syntax"] == "intel"


def test_split_tables(spark, tmp_path):
    for s in ("humaneval", "mbpp"):
        spark.createDataFrame([(0, "O0", "c"), (1, "O1", "cpp")], "index long, opt string, language string").write.parquet(f"{tmp_path}/{s}")
    paths = {s: f"{tmp_path}/{s}" for s in ("humaneval", "mbpp")}
    assert [(r["split"], r["index"]) for r in readers.split_tables(spark, paths, limit=3).orderBy("split", "index").collect()] == [("humaneval", 0), ("humaneval", 1), ("mbpp", 0)]
    with pytest.raises(ValueError):
        readers.split_tables(spark, {"github": "x"})


def test_json_lines(spark, tmp_path):
    schema = "a int"
    assert readers.json_lines(spark, f"{tmp_path}/none.jsonl", schema).count() == 0
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n')
    assert readers.json_lines(spark, f"{tmp_path}/x.jsonl", schema).count() == 2
    (tmp_path / "y.jsonl").write_text('{"a": 1}\n{"a"\n')
    assert readers.json_lines(spark, f"{tmp_path}/y.jsonl", schema, tolerant=True).count() == 0
    with pytest.raises(Exception):
        readers.json_lines(spark, f"{tmp_path}/y.jsonl", schema).collect()


def test_trees_and_inventories(spark, tmp_path):
    for d in ("a", "b"):
        (tmp_path / "t" / d).mkdir(parents=True)
        (tmp_path / "t" / d / "public.json").write_text(d)
    (tmp_path / "t" / "a" / "meta.json").write_text("m")
    got = readers.artifact_tree(spark, f"{tmp_path}/t", "public.json", {"meta": "meta.json"}).collect()
    assert [(r["public"], r["meta"]) for r in got] == [("a", "m"), ("b", None)]
    files = readers.binary_files(spark, f"{tmp_path}/t", "*.json")
    assert readers.inventory(files, "meta.json").count() == 2 and len(readers.fingerprint(files, str(tmp_path / 'tree')).first()[0]) == 64
    (tmp_path / "kb.txt").write_text("one\n\n two\n")
    assert [tuple(r) for r in readers.knowledge_base(spark, f"{tmp_path}/kb.txt").orderBy("id").collect()] == [(0, "one"), (1, " two")]


def test_providers(spark):
    requests = spark.createDataFrame([("a",), ("b",)], "sample_id string").coalesce(1)

    def make():
        def answer(pdf):
            if "b" in set(pdf["sample_id"]):
                raise RuntimeError
            return pdf.assign(success=True, code="x", reason=None)

        return answer

    assert {r["sample_id"]: r["reason"] for r in providers.generate(requests, make, 1).collect()} == {"a": None, "b": "backend_error"}
    assert providers.case_outcomes([]) == (0, 0, "no_tests") and providers.case_outcomes([True, False, None]) == (3, 1, "test_mismatch")
    with pytest.raises(ValueError):
        providers.load("os:system", ("tallyrail",))


def test_report_files(spark, tmp_path):
    df = spark.createDataFrame([("O0", 1, {"pass": 1})], "optimization string, total int, reasons map<string,int>")
    writers.write_report({"overall": df}, str(tmp_path / "r"))
    assert spark.read.csv(f"{tmp_path}/r/overall.csv", header=True).columns == ["optimization", "total"]
    assert [r["line"] for r in writers.failure_catalog(df, ["optimization", "total"]).collect()][-1] == "| O0 | 1 |"


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("event_id", "event_type", "value")
    events.repartition(3).write.parquet(f"{tmp_path}/in")
    ok = F.coalesce(F.col("value") > 50, F.lit(False))
    source = stream.read_stream(spark, f"{tmp_path}/in", events.schema, files=1)
    stream.upsert_totals(source, ["event_type"], ok, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination(120)
    want = events.groupBy("event_type").agg(F.count("*").alias("total"), F.count_if(ok).alias("passed"))
    assert sorted(map(tuple, stream.latest(spark, f"{tmp_path}/out").collect())) == sorted(map(tuple, want.collect()))


def test_compiled_functions(spark):
    rows = [("p", "f", "a.o", "-O2", "C", "#x", 1), ("p", "f", "a.o", None, None, None, 2), ("p", "g", "a.o", "O1", "c++", None, 3), ("q", "h", "gone.o", "O1", "c", None, 4), ("q", "", "a.o", "O1", "c", None, 5)]
    df = spark.createDataFrame(rows, readers.COMPILED)
    binaries = spark.createDataFrame([("a.o",), ("b.o",)], "path string")
    listings = spark.createDataFrame([("a.o", "f", "f: ret"), ("a.o", "g", "g: ret"), ("gone.o", "h", "x"), ("a.o", "k", "")], "path string, function_name string, text string")
    got = readers.compiled_functions(df, "d", binaries, listings).orderBy("sample_id").collect()
    assert [r["sample_id"] for r in got] == ["d:p:f:O0", "d:p:f:O2", "d:p:g:O1"] and got[2]["compile_context"]["compiler"] == "clang++" and got[1]["language"] == "c"
    assert readers.compiled_functions(df, "d", binaries, listings, levels=["O2"], limit=1).first()["addr"] == 1
