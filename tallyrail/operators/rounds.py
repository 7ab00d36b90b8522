"""Inputs made simpler while they fail, and bounded rounds of probing until a reason to stop.

The state of every key is a row. Inputs are folded over their steps with the verdicts of
their key; in rounds, the active rows go one step further with what an observation table
says, and are written before the next round reads them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyrail.functions.numbers import wilson
from tallyrail.operators.validation import stop_probing
from tallyrail.session import stored

REGISTER = "struct<value:bigint,object_ref:string>"
OBJECT = "struct<size:int,bytes_hex:string,placement:string,min_size:int>"
STEP = "struct<kind:string,name:string>"
ATTEMPT = "struct<step:string,kept:boolean,input_hash:string>"


def _quoted(c: Column) -> Column:
    """A JSON string."""
    return F.btrim(F.to_json(F.array(c)), F.lit("[]"))


def input_text(contract: Column, registers: Column, objects: Column, seed: Column) -> Column:
    """Canonical JSON of an input: keys in order, no white space. A register is a number, a reference to an object, or null."""
    value = lambda r: F.when(r["value"].isNotNull(), r["value"].cast("string")).when(r["object_ref"].isNotNull(), F.concat(F.lit('{"object_ref":'), _quoted(r["object_ref"]), F.lit("}"))).otherwise('{"null":true}')
    entry = lambda m, show: F.array_join(F.transform(F.sort_array(F.map_keys(m)), lambda k: F.concat(_quoted(k), F.lit(":"), show(m[k]))), ",")
    thing = lambda o: F.concat(F.lit('{"bytes_hex":"'), o["bytes_hex"], F.lit('","placement":"'), o["placement"], F.lit('","size":'), o["size"].cast("string"), F.lit("}"))
    return F.concat(
        F.lit('{"contract_id":'), _quoted(contract), F.lit(',"globals":{},"gpr":{'), entry(registers, value), F.lit('},"objects":{'), entry(objects, thing),
        F.lit('},"schema_version":1,"seed":'), seed.cast("string"), F.lit(',"virtual_read_bytes":""}'),
    )


def input_hash(contract: str = "contract_id", registers: str = "gpr", objects: str = "objects", seed: str = "seed") -> Column:
    """SHA-256 of an input's canonical JSON."""
    return F.sha2(input_text(F.col(contract), F.col(registers), F.col(objects), F.col(seed)), 256)


def steps(registers: Column, objects: Column) -> Column:
    """array<struct<kind, name>>: the simplifications that an input may take, in order."""
    zero = F.transform(F.sort_array(F.map_keys(registers)), lambda k: F.struct(F.lit("zero_integer").alias("kind"), k.alias("name")))
    each = F.transform(F.sort_array(F.map_keys(objects)), lambda k: F.array(*(F.struct(F.lit(kind).alias("kind"), k.alias("name")) for kind in ("zero_object", "shrink_object", "normalize_placement"))))
    return F.concat(zero, F.flatten(each)).cast(f"array<{STEP}>")


def changes(step: Column, registers: Column, objects: Column) -> Column:
    """Whether a step would make the input another one."""
    thing = F.try_element_at(objects, step["name"])
    number = F.try_element_at(registers, step["name"])["value"]
    return F.coalesce(
        F.when(step["kind"] == "zero_integer", number != 0)
        .when(step["kind"] == "zero_object", thing["bytes_hex"].rlike("[^0]"))
        .when(step["kind"] == "shrink_object", thing["size"] > thing["min_size"])
        .otherwise(thing["placement"] != "right"),
        F.lit(False),
    )


def simpler(step: Column, registers: Column, objects: Column) -> tuple[Column, Column]:
    """Registers and objects after a step."""
    number = F.transform_values(registers, lambda k, r: F.struct(F.when((step["kind"] == "zero_integer") & (k == step["name"]), F.lit(0)).otherwise(r["value"]).cast("long").alias("value"), r["object_ref"].alias("object_ref")))

    def thing(k: Column, o: Column) -> Column:
        is_ = lambda kind: (step["kind"] == kind) & (k == step["name"])
        size = F.when(is_("shrink_object"), o["min_size"]).otherwise(o["size"])
        content = F.when(is_("zero_object"), F.regexp_replace(o["bytes_hex"], ".", "0")).when(is_("shrink_object"), F.substr(o["bytes_hex"], F.lit(1), 2 * o["min_size"])).otherwise(o["bytes_hex"])
        return F.struct(size.alias("size"), content.alias("bytes_hex"), F.when(is_("normalize_placement"), "right").otherwise(o["placement"]).alias("placement"), o["min_size"].alias("min_size"))

    return number, F.transform_values(objects, thing)


def folded(cases: DataFrame, known: str, attempts: int = 8) -> DataFrame:
    """Every input made simpler step by step while it still fails, row by row.

    ``cases`` as in ``minimized``, and in the column ``known`` the digests (binary) of
    the key's failing inputs. A fold over the steps: nothing is shuffled or written.
    """
    gpr, objects, log = F.col("gpr").cast(f"map<string,{REGISTER}>"), F.col("objects").cast(f"map<string,{OBJECT}>"), F.array().cast(f"array<{ATTEMPT}>")
    begun = lambda gpr, objects, log: F.struct(gpr.alias("gpr"), objects.alias("objects"), log.alias("log"))
    with_ = lambda x, f: F.element_at(F.transform(F.array(x), f), 1)  # noqa: E731  # evaluates x once

    def attempt(now: Column, step: Column) -> Column:
        def judged(x: Column) -> Column:
            kept = F.coalesce(F.array_contains(known, F.unhex(x["input_hash"])), F.lit(False))
            entry = F.struct(F.concat_ws(":", step["kind"], step["name"]).alias("step"), kept.alias("kept"), x["input_hash"].alias("input_hash"))
            return with_(entry, lambda e: begun(F.when(e["kept"], x["gpr"]).otherwise(now["gpr"]), F.when(e["kept"], x["objects"]).otherwise(now["objects"]), F.array_append(now["log"], e)))

        def hashed(x: Column) -> Column:
            text = input_text(F.col("contract_id"), x["gpr"], x["objects"], F.col("seed"))
            return with_(F.struct(x["gpr"].alias("gpr"), x["objects"].alias("objects"), F.sha2(text, 256).alias("input_hash")), judged)

        new = simpler(step, now["gpr"], now["objects"])
        tried = with_(F.struct(new[0].alias("gpr"), new[1].alias("objects")), hashed)
        return F.when((F.size(now["log"]) < attempts) & changes(step, now["gpr"], now["objects"]), tried).otherwise(now)

    out = F.aggregate(F.coalesce(steps(gpr, objects), F.array().cast(f"array<{STEP}>")), begun(gpr, objects, log), attempt)
    rest = [c for c in cases.columns if c not in ("gpr", "objects", known)]
    return cases.select(*rest, out.alias("_out")).select(*rest, "_out.gpr", "_out.objects", "_out.log")


def _by_rounds(cases: DataFrame, failing: DataFrame, key: list[str], path: str, attempts: int) -> DataFrame:
    """``minimized`` by a join with the digests of failing inputs for each attempt: no key's digests stand together."""
    known = stored(failing.distinct().withColumn("_fails", F.lit(True)), f"{path}/known")
    columns = [*key, "contract_id", "seed", "gpr", "objects", "_steps", "_at", "log"]
    state = cases.select(*key, "contract_id", "seed", F.col("gpr").cast(f"map<string,{REGISTER}>"), F.col("objects").cast(f"map<string,{OBJECT}>"))
    state = state.withColumns({"_steps": steps(F.col("gpr"), F.col("objects")), "_at": F.lit(0), "log": F.array().cast(f"array<{ATTEMPT}>")})
    done = []
    for turn in range(attempts + 1):
        # The next step that changes the input, from the place reached.
        numbered = F.transform("_steps", lambda s, i: F.struct(i.alias("i"), s.alias("step")))
        coming = F.filter(numbered, lambda x: (x["i"] >= F.col("_at")) & changes(x["step"], F.col("gpr"), F.col("objects")))
        state = stored(state.withColumn("_next", F.try_element_at(coming, F.lit(1))), f"{path}/round-{turn}")
        done.append(state.where(F.col("_next").isNull() if turn < attempts else F.lit(True)).select(*key, "contract_id", "seed", "gpr", "objects", "log"))
        state = state.where("_next IS NOT NULL")
        if turn == attempts or state.isEmpty():
            break
        gpr, objects = simpler(F.col("_next.step"), F.col("gpr"), F.col("objects"))
        tried = state.withColumns({"_gpr": gpr, "_objects": objects}).withColumn("input_hash", input_hash(registers="_gpr", objects="_objects")).withColumn("_digest", F.unhex("input_hash"))
        judged = tried.join(known, [*key, "_digest"], "left").withColumn("_kept", F.coalesce("_fails", F.lit(False)))
        entry = F.struct(F.concat_ws(":", "_next.step.kind", "_next.step.name").alias("step"), F.col("_kept").alias("kept"), F.col("input_hash"))
        state = judged.withColumns({
            "gpr": F.when(F.col("_kept"), F.col("_gpr")).otherwise(F.col("gpr")), "objects": F.when(F.col("_kept"), F.col("_objects")).otherwise(F.col("objects")),
            "_at": F.col("_next.i") + 1, "log": F.array_append("log", entry),
        }).select(*columns)
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


#: Failing verdicts of a key that stand together in a row; keys of more are joined attempt by attempt.
MOST_VERDICTS = 1000


def minimized(cases: DataFrame, verdicts: DataFrame, key: list[str], path: str, attempts: int = 8, most: int | None = None) -> DataFrame:
    """Every failing input made simpler step by step while it still fails, for all keys at once.

    ``cases`` has the key, contract_id, seed, ``gpr`` (map of REGISTER) and ``objects``
    (map of OBJECT); ``verdicts`` has the key, ``input_hash`` and ``fails``, and an
    input that it does not have does not fail. Integers are set to zero, objects
    zeroed, shrunk to their least size and placed right; a step that changes nothing
    is no attempt, and there are ``attempts`` at most. Returns the cases with
    ``log`` (step, kept, input_hash). The result is diagnostic: it changes no verdict.

    Failing verdicts meet their key's inputs in one join, as digests of 32 bytes; it
    shuffles nothing if both tables are partitioned by the key. Keys of more than
    MOST_VERDICTS are joined by key and digest, once for each attempt, under ``path``.
    They are counted unless ``most``, the verdicts that a key has at most, is known.
    """
    cases = cases.select(*key, "contract_id", "seed", "gpr", "objects")
    failing = verdicts.where("fails").dropna(subset=key)
    large = None
    if most is None or most > MOST_VERDICTS:
        large = stored(failing.groupBy(*key).count().where(F.col("count") > MOST_VERDICTS).select(*key), f"{path}/large")
    # Nothing but a SHA-256 in lower case equals an input's; a null is in no set and joins with nothing.
    failing = failing.select(*key, F.when(F.col("input_hash").rlike("^[0-9a-f]{64}$"), F.unhex("input_hash")).alias("_digest"))

    def together(cases: DataFrame, failing: DataFrame) -> DataFrame:
        known = failing.groupBy(*key).agg(F.collect_set("_digest").alias("_known"))
        return folded(cases.join(known.hint("merge"), key, "left"), "_known", attempts)  # merged: verdicts outnumber inputs, whatever their table's size says

    if large is None or large.isEmpty():
        return together(cases, failing)
    rest = together(cases.join(large, key, "left_anti"), failing.join(large, key, "left_anti"))
    return rest.unionByName(_by_rounds(cases.join(large, key, "left_semi"), failing.join(large, key, "left_semi"), key, path, attempts))


#: Executions that a key may have at most; a round sorts no more rows of a key.
MOST_EXECUTIONS = 1000


def probe_rounds(keys: DataFrame, observations: DataFrame, key: str, path: str, rounds: int = 32) -> DataFrame:
    """Probing of all keys until each has a reason to stop.

    ``keys`` has the key, ``budget`` (executions, MOST_EXECUTIONS at most) and
    ``risk_limit``; ``observations`` has the key, ``round`` (from 1), ``ordinal``,
    ``signature`` and ``fails``. A round takes a key's observations of that number
    in order, as many as its budget has left. News are signatures that the key has
    not shown before; a round without observations has none. Probing stops when the
    budget is spent, when the Wilson bound of the failures is over the limit, after
    two rounds without news, or at last with ``round_limit``. Returns key, rounds,
    executed, failures, signatures, stop_reason.
    """
    state = keys.select(key, F.col("budget").cast("long").alias("left"), F.col("risk_limit").cast("double").alias("risk_limit"))
    too_much = F.when(F.col("left") > MOST_EXECUTIONS, F.raise_error(F.lit("a budget of more executions than a key may have"))).otherwise(F.col("left"))
    state = state.withColumn("left", too_much).withColumns({"rounds": F.lit(0).cast("long"), "executed": F.lit(0).cast("long"), "failures": F.lit(0).cast("long"), "signatures": F.lit(0).cast("long"), "quiet": F.lit(0).cast("long")})
    state = state.withColumn("stop_reason", F.when(F.col("left") <= 0, "budget_exhausted"))
    seen, done = [], []
    names = state.columns
    for turn in range(rounds + 1):
        state = stored(state, f"{path}/state-{turn}")
        last = F.lit(turn == rounds)
        done.append(state.where(F.col("stop_reason").isNotNull() | last).withColumn("stop_reason", F.coalesce("stop_reason", F.lit("round_limit"))))
        active = state.where("stop_reason IS NULL")
        if turn == rounds or active.isEmpty():
            break
        order = Window.partitionBy(key).orderBy("ordinal")
        mine = observations.where(F.col("round") == turn + 1).withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= MOST_EXECUTIONS)
        taken = stored(mine.join(active.select(key, "left"), key).where(F.col("_n") <= F.col("left")).select(key, "signature", "fails"), f"{path}/taken-{turn}")
        news = taken.select(key, "signature").distinct()
        for before in seen:
            news = news.join(before, [key, "signature"], "left_anti")
        seen.append(stored(news, f"{path}/seen-{turn}"))
        counted = taken.groupBy(key).agg(F.count("*").alias("_e"), F.count_if("fails").alias("_f")).join(seen[-1].groupBy(key).agg(F.count("*").alias("_s")), key, "left")
        state = active.join(counted, key, "left").na.fill(0, ["_e", "_f", "_s"])
        state = state.withColumns({
            "left": F.col("left") - F.col("_e"), "rounds": F.col("rounds") + 1, "executed": F.col("executed") + F.col("_e"), "failures": F.col("failures") + F.col("_f"),
            "signatures": F.col("signatures") + F.col("_s"), "quiet": F.when(F.col("_s") > 0, F.lit(0)).otherwise(F.col("quiet") + 1),
        })
        bound = wilson(F.col("failures"), F.col("executed"))["high"]
        state = state.withColumn("stop_reason", stop_probing(F.col("left"), bound, F.col("risk_limit"), F.col("quiet"))).select(*names)
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out.select(key, "rounds", "executed", "failures", "signatures", "stop_reason")
