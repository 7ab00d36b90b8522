"""Column functions on small literals."""

from pyspark.sql import functions as F

from tallyrail.functions import keys as k
from tallyrail.functions import numbers as n
from tallyrail.functions import text as t


def one(spark, column, **values):
    df = spark.range(1).select(*(F.lit(v).alias(c) for c, v in values.items()))
    return df.select(column.alias("x")).first()["x"]


def test_fences(spark):
    text = "text\n```c\nint FUN_123(void){return 1;}\n``` and ```\nx\n```"
    got = one(spark, t.markdown_fence(F.col("c")), c=text)
    assert (got["code"], got["blocks"]) == ("int FUN_123(void){return 1;}", 2)
    assert one(spark, t.markdown_fence(F.col("c")), c="  plain \n")["code"] == "plain"
    assert one(spark, t.markdown_fence(F.col("c")), c="```c\nab\n``` ```c\ncd\n```")["code"] == "ab"  # first on a tie
    assert one(spark, t.last_fence(F.col("c")), c="```c\nab\n``` ```c\ncd\n```") == "cd"
    got = one(spark, t.candidate_code(F.col("c")), c="```python\nlonger block\n```\n```c\nint x;\n```")
    assert (got["code"], got["policy"]) == ("int x;", "longest_c_fence")
    assert one(spark, t.candidate_code(F.col("c")), c="```rust\nfn\n```")["policy"] == "longest_fence"
    assert one(spark, t.candidate_code(F.col("c")), c=" ")["policy"] == "empty"
    assert one(spark, t.drop_answer_prefix(F.col("c")), c=" Output: int x;") == "int x;"


def test_rename(spark):
    got = one(spark, t.rename_target(F.col("c"), F.col("n")), c="int FUN_12a(int x){return FUN_12a(x)+FUN_12ab;}", n="target$1")
    assert (got["code"], got["count"]) == ("int target$1(int x){return target$1(x)+FUN_12ab;}", 2)
    assert one(spark, t.rename_target(F.col("c"), F.col("n")), c="int main(){}", n="t")["count"] == 0
    got = one(spark, t.rename_generated(F.col("c"), F.col("n")), c="int *foo(int a){return foo(a);}", n="bar")
    assert (got["code"], got["count"]) == ("int *bar(int a){return bar(a);}", 2)


def test_typedefs_and_dependencies(spark):
    got = one(spark, t.prepend_used(F.col("c")), c="undefined4 target(undefined8 value){}")
    assert got["added"] == 2 and got["code"].startswith("typedef unsigned int undefined4;\ntypedef unsigned long long undefined8;\n\nundefined4")
    assert one(spark, t.prepend_used(F.col("c")), c="typedef int byte; byte b;")["added"] == 0
    assert "printf" not in one(spark, t.sanitize_dependencies(F.col("c"), True), c="int printf(const char*, ...);\ntypedef int bool;\nint y;")
    assert one(spark, t.externalize(F.col("c"), F.lit("f")), c="static inline int f(int a){static int b;}") == "  int f(int a){static int b;}"


def test_names_lines_labels(spark):
    assert one(spark, t.safe_name(F.col("c")), c="..a b/c?") == "a_b_c"
    assert one(spark, t.safe_name(F.col("c")), c="...") == "sample"
    assert one(spark, t.body_lines(F.col("c")), c="int f(){\n a=1;\n }\n return a;\n}") == 2
    assert one(spark, t.line_labels(F.col("c")), c="x = 1; // I3, I1 I3") == ["I1", "I3"]
    assert one(spark, t.relocation_symbol(F.col("c")), c="puts-0x4") == "puts"
    assert one(spark, t.access_width(F.col("c")), c="movl.s") == 4
    assert one(spark, t.type_kind(F.col("c")), c="const  char *") == "pointer"
    assert one(spark, t.type_kind(F.col("c")), c="struct s") == "unsupported_aggregate"
    assert one(spark, t.error_reason(F.col("c")), c="RateLimitError") == "closed_llm_rate_limit"
    assert one(spark, t.security_reasons(F.col("c")), c='#include <x>\nint main(){system("/bin/sh");}') == ["forbidden_path_literal", "forbidden_preprocessor_directive", "forbidden_system_or_process_call"]
    assert one(spark, t.normalize_pseudocode(F.col("c")), c="_DWORD x = 0xFFu; // c\n/* d */") == "uint32_t x = 255u; \n"


def test_postprocess(spark):
    df = spark.createDataFrame([("```c\nundefined4 FUN_1(){}\n```", "f")], "code string, name string")
    row = t.postprocess(df, "code", "name", ["markdown_fence", "rename_target", "compat_types"]).first()
    assert row["actions"] == ["markdown_fence", "rename_target", "compat_types"] and "undefined4 f()" in row["code"]


def test_numbers(spark):
    low, high = one(spark, n.wilson(F.lit(8), F.lit(10)))
    assert abs(low - 0.490162) < 1e-5 and abs(high - 0.943318) < 1e-5
    assert one(spark, n.wilson(F.lit(0), F.lit(0)))["low"] is None
    assert one(spark, n.rate(F.lit(0), F.lit(0))) == 0.0 and one(spark, n.rate(F.lit(0), F.lit(0), None)) is None
    a, b = F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(0.0))
    assert one(spark, n.cosine_distance(a, b)) == 1.0 and one(spark, n.l2_squared(a, b)) == 1.0
    assert [tuple(r) for r in one(spark, n.changed_ranges(F.col("a"), F.col("b")), a="00112233", b="ff11aabb")] == [(0, 1), (2, 4)]
    assert one(spark, n.byte_pattern(F.col("k"), F.lit(3)), k="pulse_end") == "0000ff"
    assert one(spark, n.hex_bytes(F.col("h")), h="0g") is None
    assert one(spark, n.seed31(F.col("s")), s="x") == int.from_bytes(__import__("hashlib").sha256(b"x").digest()[:4]) & 0x7FFFFFFF
    assert not n.strict_equal(True, 1) and not n.strict_equal(1, 1.0) and n.strict_equal([{"a": 1.0}], [{"a": 1.0 + 1e-12}])
    assert not n.strict_equal(float("nan"), float("nan"))
    assert one(spark, n.backoff(1.0, 5.0, 4)) == [1.0, 2.0, 4.0, 5.0]


def test_keys(spark):
    assert one(spark, k.canonical_json(F.col("j")), j='{"b": 1, "a": [1.0, "é"]}') == '{"a":[1.0,"é"],"b":1}'
    assert one(spark, k.find_private(F.col("j")), j='{"x": [{"expectedOutput": 1}], "io_pairs": {"test_a": 2}}') == ["metadata.io_pairs", "metadata.io_pairs.test_a", "metadata.x[0].expectedOutput"]
    assert k.merge({"a": {"b": 1}}, {"a": {"c": 2}}) == {"a": {"b": 1, "c": 2}}
    assert k.redact_value({"api_key": "x", "n": [{"Password": 1}]}) == {"api_key": "***REDACTED***", "n": [{"Password": "***REDACTED***"}]}
    assert k.backend_settings({"a": {"token": 1}, "b": {}, "batch_size": 3, "c": 1}) == {"b": {}, "c": 1}
    keys = lambda backend: one(spark, k.layered_keys(F.lit("r"), F.lit(backend), F.lit("p"), F.lit(None).cast("string")))
    assert keys("b1")["generation"] != keys("b2")["generation"] and keys(None) == keys("")
