"""Input cases against contracts: every broken rule by name, and the default case of a contract."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyrail.operators.contracts import MAX_OBJECT, MAX_OBJECTS

CONTRACT = (
    "struct<contract_id:string,arguments:array<struct<slot:string,kind:string,object_ref:string>>,objects:array<struct<object_id:string,min_size:int>>,"
    "relations:array<struct<kind:string,left:string,right:string,offset:int,length_slot:string,object_ref:string>>>"
)
#: A register holds a number, a reference to an object, or, with ``is_null``, no object.
CASE = (
    "struct<schema_version:int,contract_id:string,gpr:map<string,struct<value:bigint,object_ref:string,is_null:boolean>>,"
    "objects:map<string,struct<size:int,bytes_hex:string,placement:string>>,globals:map<string,string>,seed:bigint,virtual_read_bytes:string>"
)
HEX = "^([0-9A-Fa-f]{2})*$"


def _when(rule: Column, code: str, name: Column | None = None) -> Column:
    """The code of a broken rule, with what breaks it; null while it holds."""
    text = F.lit(code) if name is None else F.concat(F.lit(f"{code}:"), F.coalesce(name, F.lit("")))
    return F.when(F.coalesce(rule, F.lit(False)), text)


def _each(items: Column, rules) -> Column:
    """The broken rules of every element of an array, in order."""
    return F.flatten(F.transform(F.coalesce(items, F.array()), lambda x: F.array_compact(F.array(*rules(x)))))


def case_errors(contract: Column, case: Column) -> Column:
    """array<string>: which rules an input case breaks against its contract, in order; empty if it can be run.

    Registers first, then objects, references, relations and the rest. A contract's
    objects are known by ``object_id`` and its relations name them; a case's
    registers name objects too. All names of a case are looked up, none is assumed.
    """
    c, k = case, contract
    known = F.transform(k["objects"], lambda o: o["object_id"])
    given = F.coalesce(c["objects"], F.create_map().cast("map<string,struct<size:int,bytes_hex:string,placement:string>>"))
    register = lambda slot: F.try_element_at(c["gpr"], slot)
    is_null = lambda r: F.coalesce(r["is_null"], F.lit(False))

    def argument(a: Column) -> tuple[Column, ...]:
        r, integer = register(a["slot"]), a["kind"] == "integer"
        there = r.isNotNull()
        return (
            _when(~there, "missing_register", a["slot"]),
            _when(there & integer & r["value"].isNull(), "not_an_integer", a["slot"]),
            _when(there & ~integer & r["object_ref"].isNull() & ~is_null(r), "not_a_reference", a["slot"]),
            _when(there & ~integer & ~is_null(r) & (r["object_ref"] != a["object_ref"]), "other_object", a["slot"]),
        )

    def thing(name: Column) -> tuple[Column, ...]:
        o = given[name]
        spec = F.try_element_at(F.filter(k["objects"], lambda x: x["object_id"] == name), F.lit(1))
        hexadecimal = F.coalesce(o["bytes_hex"], F.lit("")).rlike(HEX)
        return (
            _when(~F.array_contains(known, name), "unknown_object", name),
            _when(~F.coalesce(o["size"], F.lit(0)).between(1, MAX_OBJECT), "size_out_of_range", name),
            _when(F.coalesce(o["size"], F.lit(0)) < spec["min_size"], "size_below_least", name),
            _when(~hexadecimal, "bytes_not_hexadecimal", name),
            _when(hexadecimal & (F.length(F.coalesce(o["bytes_hex"], F.lit(""))) != 2 * F.coalesce(o["size"], F.lit(0))), "bytes_of_other_length", name),
            _when(~F.coalesce(o["placement"], F.lit("right")).isin("left", "right"), "unknown_placement", name),
        )

    def reference(a: Column) -> tuple[Column, ...]:
        r = register(a["slot"])
        return (_when((a["kind"] == "pointer") & ~is_null(r) & ~F.map_contains_key(given, r["object_ref"]), "missing_object", r["object_ref"]),)

    def relation(x: Column) -> tuple[Column, ...]:
        slot = lambda name: F.try_element_at(F.transform(F.filter(k["arguments"], lambda a: (a["kind"] == "pointer") & (a["object_ref"] == name)), lambda a: a["slot"]), F.lit(1))
        left, right = register(slot(x["left"])), register(slot(x["right"]))
        length, pair = register(F.upper(x["length_slot"]))["value"], x["kind"] != "length_within"
        both = pair & ~is_null(left) & ~is_null(right)
        shared = x["left"] == x["right"]
        return (
            _when((x["kind"] == "length_within") & ((length < 0) | (length > F.try_element_at(given, x["object_ref"])["size"])), "length_not_within", x["object_ref"]),
            _when(pair & (is_null(left) != is_null(right)), "null_on_one_side", x["kind"]),
            _when(both & (x["kind"] == "must_alias") & ~shared, "objects_not_shared", x["kind"]),
            _when(both & (x["kind"] == "fixed_offset_alias") & (x["offset"] != 0), "offset_not_zero", x["kind"]),
            _when(both & (x["kind"] == "fixed_offset_alias") & (x["offset"] == 0) & ~shared, "objects_not_shared", x["kind"]),
            _when(both & (x["kind"] == "no_alias") & shared, "objects_shared", x["kind"]),
        )

    whole = F.array_compact(F.array(
        _when(F.coalesce(c["schema_version"], F.lit(1)) != 1, "unknown_schema_version"),
        _when(~c["contract_id"].eqNullSafe(k["contract_id"]), "other_contract"),
    ))
    rest = F.array_compact(F.array(
        _when(F.size(given) > MAX_OBJECTS, "too_many_objects"),
        _when(F.size(F.coalesce(c["globals"], F.create_map().cast("map<string,string>"))) > 0, "globals_given"),
        _when(~F.coalesce(c["virtual_read_bytes"], F.lit("")).rlike(HEX), "stream_not_hexadecimal"),
    ))
    return F.concat(whole, _each(k["arguments"], argument), _each(F.array_sort(F.map_keys(given)), thing), _each(k["arguments"], reference), _each(k["relations"], relation), rest)


def default_case(contract: Column, seed: Column) -> Column:
    """The plainest case of a contract (CASE): integers 0, pointers to their object, objects of least size, zeroed and placed right."""
    pointed = F.array_sort(F.array_distinct(F.transform(F.filter(contract["arguments"], lambda a: a["kind"] == "pointer"), lambda a: a["object_ref"])))
    register = lambda a: F.struct(F.when(a["kind"] == "integer", F.lit(0)).cast("long").alias("value"), F.when(a["kind"] == "pointer", a["object_ref"]).alias("object_ref"), F.lit(False).alias("is_null"))
    size = lambda name: F.try_element_at(F.filter(contract["objects"], lambda o: o["object_id"] == name), F.lit(1))["min_size"]
    thing = lambda name: F.struct(size(name).alias("size"), F.array_join(F.array_repeat(F.lit("00"), size(name)), "").alias("bytes_hex"), F.lit("right").alias("placement"))
    return F.struct(
        F.lit(1).alias("schema_version"), contract["contract_id"].alias("contract_id"),
        F.map_from_entries(F.transform(contract["arguments"], lambda a: F.struct(a["slot"], register(a)))).alias("gpr"),
        F.map_from_entries(F.transform(pointed, lambda n: F.struct(n, thing(n)))).alias("objects"),
        F.create_map().cast("map<string,string>").alias("globals"), seed.cast("long").alias("seed"), F.lit("").alias("virtual_read_bytes"),
    ).cast(CASE)


def resolved(samples: DataFrame, known: DataFrame) -> DataFrame:
    """Samples (sample_id, function_name) with the contract and the inputs that are known for them.

    ``known`` has ``scope`` (sample or function), ``name``, ``contract`` (CONTRACT) and
    ``inputs`` (array of CASE, may be null). A sample's own entry goes before its
    function's; without inputs the contract's default case is the one. ``reason`` is
    ``unsupported_missing_known_contract`` where there is no entry, and ``errors`` has
    the broken rules of every input.
    """
    entry = F.struct("contract", "inputs")
    of = lambda scope, name: known.where(F.col("scope") == scope).groupBy(F.col("name").alias(name)).agg(F.first(entry).alias(f"_{scope}"))
    rows = samples.join(of("sample", "sample_id"), "sample_id", "left").join(of("function", "function_name"), "function_name", "left").withColumn("_k", F.coalesce("_sample", "_function"))
    given = F.coalesce(F.col("_k.inputs"), F.array().cast(f"array<{CASE}>"))
    default = F.when(F.col("_k").isNotNull(), F.array(default_case(F.col("_k.contract"), F.lit(0))))
    out = rows.withColumns({"contract": F.col("_k.contract"), "inputs": F.when(F.size(given) > 0, given).otherwise(default)})
    errors = F.transform("inputs", lambda x: case_errors(F.col("contract"), x))
    return out.withColumns({"errors": errors, "reason": F.when(F.col("_k").isNull(), "unsupported_missing_known_contract")}).select(*samples.columns, "contract", "inputs", "errors", "reason")
