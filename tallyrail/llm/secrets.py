"""Secret scans over an incremental ledger of content-addressed text versions.

Every (path, version) row is addressed by the SHA-256 of its text. The ledger
keeps, for each pair of blob and rule version, whether it was scanned and what
was found; a scan visits only pairs that the ledger does not hold, and ``history``
joins the findings back to every path that has ever carried the blob. A rule whose
version changes makes its pairs unseen again; the others stay valid.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyrail.llm.common import join_spread, latest_number, parts, shared_dir, written

#: Fixed patterns of the three base kinds, in their order; the part that must reach the least length.
BASE = (
    ("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A, 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 0, 24),
)
#: Further kinds that the ledger's default rules add.
MORE = (
    ("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", 0, 0, 1),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 0, 1),
    ("hub", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 0, 1),
)
#: A text without any of these has no match of the rule; a plain search is much faster than the pattern.
NEEDS = {"assign": ("passw", "secret", "token", "apikey", "api_key"), "access": ("AKIA",), "pem": ("-----BEGIN ",), "jwt": ("eyJ",), "hub": ("gh",)}


@dataclass(frozen=True)
class Rule:
    """One kind of secret: its name, version, compiled pattern and the least length of a group of it."""

    kind: str
    version: str
    pattern: re.Pattern = field(repr=False)
    group: int = 0
    least: int = 1
    needs: tuple[str, ...] = ()

    def spans(self, text: str, lowered: str) -> list[tuple[int, int]]:
        """Leftmost non-overlapping matches, those with a too short group dropped afterwards."""
        inside = lowered if self.pattern.flags & re.I else text
        if self.needs and not any(n in inside for n in self.needs):
            return []
        return [m.span() for m in self.pattern.finditer(text) if m.end(self.group) - m.start(self.group) >= self.least]


RULES = tuple(Rule(k, "1", re.compile(p, f), g, n, NEEDS.get(k, ())) for k, p, f, g, n in (*BASE, *MORE))
FINDING = "blob binary, rules array<string>, found map<string,array<struct<start:int,end:int>>>"


def scan_text(text: str | None, rules: tuple[Rule, ...] = RULES) -> dict[str, list[tuple[int, int]]]:
    """Spans by kind of one text; offsets are code points, ends exclusive. A null text is empty."""
    text = text or ""
    lowered = text.lower()
    return {r.kind: r.spans(text, lowered) for r in rules}


def _blob():
    return F.unhex(F.sha2("text", 256)).alias("blob")


class BlobLedger:
    """Tables below ``path``, one of each per scan: ``versions`` (path, version, blob) and ``findings`` by blob and rule versions.

    Null texts are the empty blob. Repeated rows and equal texts share a blob.
    An empty table leaves the findings as they are. Other columns are ignored. A
    scan counts once its ``state`` is written, after its tables; a ledger opened
    on a path goes on from the last one and writes over none.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.runs = latest_number(spark, self.path, "state") + 1

    def scan(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", version: str = "1", rules: tuple[Rule, ...] = RULES) -> DataFrame:
        """Record ``docs`` as a version of their paths, scan what is unseen, return findings by path.

        The result has one row per row of ``docs``: path, blob and ``found``, the
        spans by kind of the rules that match it (null where none does).
        """
        n = self.runs
        rows = docs.select(F.col(id_col).alias("path"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
        versions = written(rows.select("path", F.lit(version).alias("version"), _blob()), f"{self.path}/versions-{n}")
        marks = {f"{r.kind}@{r.version}": r for r in rules}
        # A blob is read from one of the paths that carry it, found again by path and digest.
        todo = versions.groupBy("blob").agg(F.min("path").alias("path")).withColumn("todo", F.array(*(F.lit(m) for m in marks)))
        if n:
            held = self.findings().select("blob", F.explode("rules").alias("mark")).groupBy("blob").agg(F.collect_set("mark").alias("held"))
            todo = todo.join(held, "blob", "left").withColumn("todo", F.array_except("todo", F.coalesce("held", F.array().cast("array<string>")))).where(F.size("todo") > 0)
        todo = todo.select("blob", "path", "todo").alias("t")
        here = rows.select("path", "text", _blob()).alias("r")
        same = (F.col("r.blob") == F.col("t.blob")) & F.col("r.path").eqNullSafe(F.col("t.path"))
        texts = here.join(todo.hint("shuffle_hash"), same).select("r.blob", "r.text", "t.todo")

        def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in parts(batches):
                out = []
                for blob, text, todo in zip(pdf["blob"], pdf["text"], pdf["todo"], strict=True):
                    lowered = text.lower()
                    spans = {marks[m].kind: marks[m].spans(text, lowered) for m in todo}
                    out.append((blob, list(todo), {k: [{"start": a, "end": b} for a, b in v] for k, v in spans.items() if v}))
                yield pd.DataFrame(out, columns=["blob", "rules", "found"])

        texts.mapInPandas(look, FINDING).dropDuplicates(["blob"]).write.mode("overwrite").parquet(f"{self.path}/findings-{n}")
        self.spark.range(1).coalesce(1).write.mode("error").parquet(f"{self.path}/state-{n}")
        self.runs = n + 1
        return self._found(versions.drop("version"), rules)

    def history(self, rules: tuple[Rule, ...] = RULES) -> DataFrame:
        """Every path, version and blob that the ledger has ever recorded, with ``found`` under the given rules."""
        return self._found(self.versions(), rules)

    def _found(self, versions: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
        """``versions`` with the spans by kind that the current versions of the rules found in their blobs."""
        current = F.filter("rules", lambda m: m.isin(*(f"{r.kind}@{r.version}" for r in rules)))
        found = self.findings().where(F.size("found") > 0).select("blob", F.explode(current).alias("mark"), "found")
        found = found.select("blob", F.substring_index("mark", "@", 1).alias("kind"), F.try_element_at("found", F.substring_index("mark", "@", 1)).alias("spans")).where("spans IS NOT NULL")
        found = found.groupBy("blob").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("kind", "spans")))).alias("found"))
        return join_spread(versions, found, "blob", versions.groupBy("blob").agg(F.count("*").alias("n")), "path", "left")

    def versions(self) -> DataFrame:
        """Paths, versions and blobs that the ledger holds: a row that an earlier scan has recorded counts there only, so that a repeated scan adds none."""
        each = reduce(DataFrame.unionByName, (self.spark.read.parquet(f"{self.path}/versions-{i}").withColumn("scan", F.lit(i)) for i in range(self.runs)))
        counted = each.groupBy("path", "version", "blob", "scan").agg(F.count("*").alias("n"))
        first = counted.groupBy("path", "version", "blob").agg(F.min_by("n", "scan").alias("n"))
        return first.select("path", "version", "blob", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("_")).drop("_")

    def findings(self) -> DataFrame:
        """All rows of findings that the ledger holds: blob, rule versions of that scan, spans by kind."""
        return self.spark.read.schema(FINDING).parquet(*(f"{self.path}/findings-{i}" for i in range(self.runs)))


def spans_of(found, kinds: tuple[str, ...]):
    """Column: ``kind:start:end`` of all spans by start, then kind as listed, comma-joined."""

    def of(i: int, kind: str):
        none = F.array().cast("array<struct<start:int,end:int>>")
        text = lambda s: F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["end"].cast("string"))
        return F.transform(F.coalesce(F.try_element_at(found, F.lit(kind)), none), lambda s: F.struct(s["start"].alias("start"), F.lit(i).alias("i"), text(s).alias("t")))

    each = [of(i, k) for i, k in enumerate(kinds)]
    return F.array_join(F.transform(F.array_sort(F.concat(*each)), lambda x: x["t"]), ",")


def secret_report(found: DataFrame) -> DataFrame:
    """Per row of a ledger's scan: counts of the base kinds, the digest of their spans, all spans."""
    base = tuple(k for k, *_ in BASE)
    count = lambda k: F.coalesce(F.size(F.try_element_at("found", F.lit(k))), F.lit(0)).cast("long")
    return found.select(
        F.col("path").alias("doc_id"),
        *(count(k).alias(f"n_{k}") for k in base),
        F.sha2(spans_of(F.col("found"), base), 256).alias("base_sha256"),
        spans_of(F.col("found"), tuple(r.kind for r in RULES)).alias("spans"),
    )


def scan_secrets(docs: DataFrame, ledger_path: str | None = None) -> DataFrame:
    """Scan ``docs`` into a ledger (a new one in the shared folder by default) and report per document."""
    spark = docs.sparkSession
    return secret_report(BlobLedger(spark, ledger_path or shared_dir(spark)).scan(docs))
