"""Scans: flat JSON datasets, split tables, labelled rows, JSON lines, artifact trees, manifests, documents by line."""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyrail.functions import text as tx
from tallyrail.operators.cache import exists
from tallyrail.operators.validation import prompt
from tallyrail.session import stored
from tallyrail.sources import arrays, arrow

FLAT = (
    "struct<sample_id:string,source_group_id:string,function_name:string,optimization:string,source_type:string,"
    "source_metadata:struct<language:string>,source:struct<code:string,signature:array<string>>,assembly:map<string,string>,"
    "decompilation:map<string,struct<code:string,producer:string,version:string,sha256:string>>,"
    "binary:struct<path:string,sha256:string,format:string,architecture:string>,"
    "evaluation:struct<dependencies:string,executable_wrapper:string,function_head_used_by_wrapper:string>>"
)
LABELLED = ("task_id string, type string, c_func string, c_test string, asm_labeled string, address_mapping map<string,struct<addr:bigint>>, rodata_addr bigint, rodata_data string")
RESULTS = (
    "dataset_id string, backend_id string, sample_id string, protocol_id string, protocol_version string, split string, language string, optimization string, "
    "decompile_success boolean, recompilable boolean, behavioral_pass boolean, reason string, capabilities array<string>, metrics map<string,double>"
)


#: Neighbours that make a node of a hash tree; lines that are numbered together.
FAN, LINES = 1024, 100_000


def flat_dataset(spark: SparkSession, path: str, view: str, pseudocode: str | None = None, levels: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """Samples of one JSON document in file order: one assembly view, optionally one pseudocode view, level filter, ordered limit."""
    rows = arrays.read_array(spark, path, FLAT, "samples").select("file", "ordinal", F.col("e").alias("s"))
    if levels:
        rows = rows.where(F.col("s.optimization").isin(*levels))
    out = rows.select(
        "file", "ordinal", "s.sample_id", "s.source_group_id", "s.function_name", "s.optimization",
        F.coalesce("s.source_metadata.language", F.lit("c")).alias("language"),
        F.struct(F.try_element_at("s.assembly", F.lit(view)).alias("text"), F.lit("intel" if "intel" in view.lower() else "att").alias("syntax"), F.lit(view).alias("view")).alias("assembly"),
        F.try_element_at("s.decompilation", F.lit(pseudocode or "")).alias("pseudocode"), "s.binary", F.col("s.source.signature").alias("signature"),
        F.struct("s.source.code", "s.evaluation").alias("private_payload"),
        F.sha2(F.to_json("s"), 256).alias("content_hash"),
    )
    return out.orderBy("file", "ordinal").limit(limit).drop("file") if limit is not None else out.drop("file")


def split_tables(spark: SparkSession, paths: dict[str, str], levels: list[str] | None = None, languages: list[str] | None = None, limit: int | None = None, form: str = "parquet") -> DataFrame:
    """Samples of split tables, in the order of the splits and of ``index`` or, in Arrow folders, of their rows; the limit holds across splits.

    ``form`` is ``parquet``, or ``arrow`` for folders of Arrow files, whose reader
    drops the rows of other levels and languages itself.
    """
    allowed = {"humaneval", "mbpp"}
    if bad := set(paths) - allowed:
        raise ValueError(f"unknown splits {sorted(bad)}; known are {sorted(allowed)}")
    keep = {c: v for c, v in (("opt", levels), ("language", languages)) if v}

    def table(path: str) -> DataFrame:
        if form == "arrow":
            return arrow.read_folder(spark, path, keep=keep).withColumnRenamed(arrow.PLACE, "_place")
        return spark.read.parquet(path).where(reduce(Column.__and__, [F.col(c).isin(*v) for c, v in keep.items()], F.lit(True))).withColumn("_place", F.col("index"))

    out = reduce(DataFrame.unionByName, [table(p).withColumn("split", F.lit(s)).withColumn("_split", F.lit(i)) for i, (s, p) in enumerate(paths.items())])
    if limit is not None:
        out = out.orderBy("_split", "_place", "opt").limit(limit)
    return out.drop("_split", "_place")


def labelled_rows(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Rows that have a source and labelled assembly, includes apart from code, function name by its definition; then the limit."""
    rows = arrays.read_array(spark, path, LABELLED).select("file", "ordinal", "e.*")
    has = lambda c: F.coalesce(F.trim(c) != "", F.lit(False))
    rows = rows.where(has("c_func") & has("asm_labeled"))
    if limit is not None:
        rows = rows.orderBy("file", "ordinal").limit(limit)
    rows = rows.drop("file")
    split = tx.includes(F.col("c_func"))
    return rows.withColumns({"includes": split["includes"], "code": split["rest"], "function_name": tx.function_name(F.col("c_func"), F.lit("func0"))})


#: Columns of a compiled-functions table: a row per function of a binary.
COMPILED = "project string, file string, path string, opt string, language string, include string, addr bigint"


def compiled_functions(rows: DataFrame, dataset: str, binaries: DataFrame, listings: DataFrame, levels: list[str] | None = None, languages: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """Samples of a table of compiled functions (COMPILED): those whose binary is there and has a listing of the function.

    ``binaries`` has the paths that exist, ``listings`` (path, function_name, text)
    what a disassembling provider gave; an empty text is none. The level may be
    written with a dash and is O0 where it is missing, the language C. The limit
    is by project, function and level.
    """
    level = F.regexp_replace(F.coalesce("opt", F.lit("O0")), "^-+", "")
    base = rows.select(
        F.coalesce("project", F.lit("unknown")).alias("project"), F.coalesce("file", F.lit("")).alias("function_name"), F.coalesce("path", F.lit("")).alias("path"),
        level.alias("optimization"), F.lower(F.coalesce("language", F.lit("c"))).alias("language"), F.coalesce("include", F.lit("")).alias("prelude"), "addr", F.sha2(F.to_json(F.struct("*")), 256).alias("content_hash"),
    ).where("function_name <> ''")
    base = base.where(F.col("optimization").isin(*levels)) if levels else base
    base = base.where(F.col("language").isin(*languages)) if languages else base
    found = base.join(binaries.select("path").distinct(), "path", "left_semi").join(listings.where("text <> ''").select("path", "function_name", F.col("text").alias("listing")), ["path", "function_name"])
    group = F.concat_ws(":", F.lit(dataset), "project", "function_name")
    cpp = F.col("language").isin("cpp", "c++", "cxx")
    out = found.select(
        F.concat_ws(":", group, "optimization").alias("sample_id"), group.alias("source_group_id"), "project", "function_name", "language", "optimization",
        F.struct(F.col("listing").alias("text"), F.lit("att").alias("syntax")).alias("assembly"), F.struct("path", F.lit("elf").alias("format"), F.lit("x86_64").alias("architecture")).alias("binary"),
        F.struct(F.when(cpp, "clang++").otherwise("clang").alias("compiler"), "prelude").alias("compile_context"), "addr", "content_hash",
    )
    return out.orderBy("project", "function_name", "optimization").limit(limit) if limit is not None else out


def json_lines(spark: SparkSession, path: str, schema: str, tolerant: bool = False) -> DataFrame:
    """JSON lines under a schema; a missing path is empty and blank lines are skipped.

    Broken lines are an error; ``tolerant`` makes a table with any broken line empty instead.
    """
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    if not tolerant:
        return spark.read.schema(schema).json(path, mode="FAILFAST")
    rows = spark.read.schema(f"{schema}, _corrupt_record string").json(path, mode="PERMISSIVE")
    return spark.createDataFrame([], schema) if rows.where("_corrupt_record IS NOT NULL").head(1) else rows.drop("_corrupt_record")


def run_results(spark: SparkSession, run_dir: str, schema: str = RESULTS) -> DataFrame:
    """A run's results, or its generations where there are none, with ``record_source``."""
    name = "results" if exists(spark, f"{run_dir}/results.jsonl") else "generations"
    return json_lines(spark, f"{run_dir}/{name}.jsonl", schema).withColumn("record_source", F.lit(name))


def artifact_tree(spark: SparkSession, root: str, anchor: str, siblings: dict[str, str]) -> DataFrame:
    """Directories that hold ``anchor``, with the text of sibling files (null where missing), in order."""
    parent = F.regexp_replace(F.input_file_name(), "/[^/]*$", "")

    def files(pattern: str, name: str) -> DataFrame:
        read = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).option("ignoreMissingFiles", "true")
        return read.text(root, wholetext=True).select(parent.alias("directory"), F.col("value").alias(name))

    out = files(anchor, "public")
    for name, pattern in siblings.items():
        out = out.join(files(pattern, name), "directory", "left")
    return out.orderBy("directory")


#: Files of a frozen sample's folder, by the column that has their text.
FROZEN = {
    "harness": "harness_manifest.json", "metadata": "metadata.json", "selected": "selected_contract.json", "policy": "observation_policy.json", "exploration_probes": "probe_plan.jsonl",
    "holdout_probes": "holdout_probe_plan.jsonl", "exploration_observations": "original_observations.jsonl", "holdout_observations": "holdout_observations.jsonl",
}


def frozen_artifacts(spark: SparkSession, root: str, anchor: str = "public_request.json", runner: str = "original_runner.x") -> DataFrame:
    """Frozen samples below ``root``, a folder each, as ``baselines.entries`` takes them: sample_id of the public request, texts, the selected contract's hash, the runner's digest."""
    rows = artifact_tree(spark, root, anchor, FROZEN)
    runners = binary_files(spark, root, runner).select(F.regexp_replace("path", "/[^/]*$", "").alias("directory"), F.sha2("content", 256).alias("runner_sha256"))
    contract = F.get_json_object("selected", "$.content_hash")
    plain = F.regexp_replace("directory", "^file:/+", "/")
    return rows.withColumn("_d", plain).join(runners.withColumn("_d", F.regexp_replace("directory", "^file:/+", "/")).drop("directory"), "_d", "left").select(
        F.get_json_object("public", "$.sample_id").alias("sample_id"), *FROZEN, contract.alias("selected_hash"), "runner_sha256"
    )


def precomputed(requests: DataFrame, manifest: DataFrame, files: DataFrame, pattern: str = "{sample_id}.c", root: str = "") -> DataFrame:
    """Stored outputs of requests: ``code`` and, where there is none, ``reason``.

    ``manifest`` (sample_id, code, path, ordinal) names a sample's code or the path of
    its file, the last of several rows counting; without either the path is
    ``pattern`` with the request's columns filled in, sample_id made safe for a file.
    ``files`` has path and content; a path that is not absolute is below ``root``.
    """
    fields = {c: tx.safe_name(F.col(c)) if c == "sample_id" else F.col(c) for c in requests.columns}
    last = manifest.groupBy("sample_id").agg(F.max_by(F.struct("code", "path"), "ordinal").alias("_m"))
    named = F.coalesce("_m.path", prompt(pattern, fields))
    place = F.when(named.startswith("/") | named.contains("://"), named).otherwise(F.concat(F.lit(f"{root.rstrip('/')}/" if root else ""), named))
    rows = requests.join(last, "sample_id", "left").withColumn("_path", place)
    found = files.select(F.col("path").alias("_path"), F.col("content").cast("string").alias("_content"))
    out = rows.join(found, "_path", "left").withColumn("code", F.coalesce("_m.code", "_content"))
    reason = F.when(F.col("code").isNull(), "precomputed_output_missing").when(F.trim("code") == "", "decompile_empty_output")
    return out.select(*requests.columns, "code", reason.alias("reason"))


def stored_pseudocode(code: Column) -> Column:
    """struct<success, code, reason> of a stored text; null and blank are missing."""
    blank = code.isNull() | (F.trim(code) == "")
    return F.struct((~blank).alias("success"), F.when(~blank, code).alias("code"), F.when(blank, "pseudocode_missing").alias("reason"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line, text: the lines of text files, numbered from 0 in each file, read by several tasks.

    A split's lines come in order from one task; the splits' sizes, a row for each,
    give every split the number of its first line.
    """
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("value").alias("text"), F.monotonically_increasing_id().alias("at"))
    before, of = {}, {}
    for r in rows.groupBy("file", "start").agg(F.min("at").alias("first"), F.count("*").alias("n")).orderBy("file", "start").collect():
        before[f"{r['start']} {r['file']}"] = of.get(r["file"], 0) - r["first"]
        of[r["file"]] = of.get(r["file"], 0) + r["n"]
    if not before:
        return spark.createDataFrame([], "file string, line long, text string")
    offsets = F.create_map(*(F.lit(x) for pair in before.items() for x in pair))
    return rows.select("file", (F.col("at") + offsets[F.concat_ws(" ", F.col("start").cast("string"), "file")]).alias("line"), "text")


def knowledge_base(spark: SparkSession, path: str) -> DataFrame:
    """Non-blank lines of text files as documents, numbered from 0 in the files' order, by ranges of lines."""
    lines = numbered_lines(spark, path).where(F.trim("text") != "").withColumn("_range", F.floor(F.col("line") / LINES))
    key = F.concat_ws(" ", F.col("_range").cast("string"), "file")
    before, total = {}, 0
    for r in lines.groupBy("file", "_range").agg(F.count("*").alias("n")).orderBy("file", "_range").collect():  # a row per LINES lines
        before[f"{r['_range']} {r['file']}"], total = total, total + r["n"]
    offsets = F.create_map(*(F.lit(x) for pair in before.items() for x in pair))[key] if before else F.lit(0)
    place = F.row_number().over(Window.partitionBy("file", "_range").orderBy("line")) - 1
    return lines.select((place + offsets).cast("long").alias("id"), "text")


def binary_files(spark: SparkSession, path: str, pattern: str = "*.o") -> DataFrame:
    """Files with their content, for the ELF reader and for digests."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)


def inventory(files: DataFrame, without: str | None = None) -> DataFrame:
    """Path, size and SHA-256 of files in order; the manifest itself is left out."""
    rows = files.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))
    return (rows if without is None else rows.where(~F.col("path").endswith(without))).orderBy("path")


def hash_tree(files: DataFrame, path: str, fan: int = FAN) -> DataFrame:
    """level, node, files, digest: a tree of digests over the files in order of their path.

    A file's digest is that of its path and its content's digest. The files are
    numbered over ordered ranges; ``fan`` neighbours make a node of the next level,
    until one is left. No row or task has more than ``fan`` digests together, and the
    tree is the same for any partitioning. ``path`` is a folder for its levels.
    """
    leaves = files.select("path", F.sha2(F.concat_ws(":", "path", F.sha2("content", 256)), 256).alias("digest"))
    ordered = leaves.repartitionByRange("path").sortWithinPartitions("path").withColumn("at", F.monotonically_increasing_id())
    level = stored(ordered.select("at", "digest"), f"{path}/leaves")
    part = F.shiftright("at", 33)
    before, total = {}, 0
    for r in level.groupBy(part.alias("p")).agg(F.count("*").alias("n")).orderBy("p").collect():  # a row per range
        before[r["p"]], total = total, total + r["n"]
    if not total:
        return files.sparkSession.createDataFrame([(0, 0, 0, hashlib.sha256(b"").hexdigest())], "level int, node long, files long, digest string")
    offsets = F.create_map(*(F.lit(x) for pair in before.items() for x in pair))
    level = level.select((offsets[part] + F.col("at").bitwiseAND((1 << 33) - 1)).alias("node"), F.lit(1).cast("long").alias("files"), "digest")
    levels, number = [], 0
    while total > 1 or not levels:
        number, total = number + 1, -(-total // fan)
        digests = F.transform(F.array_sort(F.collect_list(F.struct("node", "digest"))), lambda x: x["digest"])
        level = level.groupBy(F.floor(F.col("node") / fan).alias("parent")).agg(F.sum("files").alias("files"), F.sha2(F.array_join(digests, "\n"), 256).alias("digest"))
        level = stored(level.select(F.lit(number).alias("level"), F.col("parent").alias("node"), "files", "digest"), f"{path}/level-{number}")
        levels.append(level)
    return reduce(DataFrame.unionByName, levels)


def fingerprint(files: DataFrame, path: str, fan: int = FAN) -> DataFrame:
    """One digest of a directory and its number of files: the root of its hash tree."""
    return hash_tree(files, path, fan).orderBy(F.desc("level")).limit(1).select(F.col("digest").alias("fingerprint"), "files")


def bundle_digest(files: DataFrame, names: list[str]) -> str:
    """SHA-256 over the names and contents of a stated few files, in the order of ``names``; a missing file is an error.

    The files pass through the driver: a bundle of many or large files takes ``fingerprint``.
    """
    found = {r["path"].rsplit("/", 1)[-1]: bytes(r["content"]) for r in files.where(F.regexp_extract("path", "[^/]*$", 0).isin(names)).collect()}
    if missing := [n for n in names if n not in found]:
        raise ValueError(f"files that are missing: {missing}")
    digest = hashlib.sha256()
    for n in names:
        digest.update(n.encode())
        digest.update(found[n])
    return digest.hexdigest()
