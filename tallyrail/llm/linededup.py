"""Reversible line deduplication: sharded cuckoo filters over exact reference counts.

The index keeps, for every long line (by a 128-bit digest of its key), which
documents hold it: signed rows in runs, plus for an insertion and minus for a
deletion, the last run's sign being the one that holds. A line that enough
documents hold is repeated; a change counts anew only the lines that it names.
The repeated lines are also kept in cuckoo filters, one per shard of the digests,
to which keys are added and from which they are taken away as documents come and
go. Cleaning asks the filters first, so that only lines which may be repeated
meet the exact counts.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyrail.llm.common import latest_number, mix, parts, shared_dir, unused, written

MIN_CHARS, MIN_DOCS = 40, 5
_SPACE = " \t\n\x0b\x0c\r"
#: Repeated lines that a shard aims at; lines of a shard that one task reads.
SHARD_KEYS, SHARD_LINES = 50_000, 4_000_000
#: Bytes of all filters up to which a copy goes to every task; beyond, lines go to their shard's filter.
FILTER_BYTES = 32 << 20
#: Runs after which they are merged into one.
RUNS = 8
SLOTS, KICKS = 4, 500
KEYS = "k1 long, k2 long, doc_id long"
RUN = KEYS + ", sign int, run int"
REPEATED = "k1 long, k2 long, n_docs long, last long"
FILTERS = "shard int, data binary"
STATE = "runs array<string>, repeated string, filters string, shards int, lines long"


def line_key(line: str) -> bytes | None:
    """A line's key as UTF-8, or None if it has too few code points: white space stripped at both ends, A-Z lower-cased."""
    key = line.strip(_SPACE)
    return key.encode("utf-8", "surrogatepass").lower() if len(key) >= MIN_CHARS else None


def digest(key: bytes) -> tuple[int, int]:
    """The key's 128-bit digest as two signed numbers."""
    return struct.unpack("<qq", xxhash.xxh3_128_digest(key))


class CuckooFilter:
    """Set of 64-bit keys by 16-bit fingerprints in two possible buckets of four slots; keys can be taken out again."""

    def __init__(self, buckets: int):
        self.table = np.zeros((buckets, SLOTS), np.uint16)

    @classmethod
    def sized(cls, keys: int) -> CuckooFilter:
        """Room for ``keys`` at a load of at most three quarters; the number of buckets is a power of two."""
        return cls(1 << max(2, int(np.ceil(np.log2(max(1, keys) / (SLOTS * 0.75))))))

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h = mix(keys.astype(np.int64).view(np.uint64))
        mark = (h >> np.uint64(48)).astype(np.uint16)
        mark[mark == 0] = 1
        first = (h & np.uint64(len(self.table) - 1)).astype(np.int64)
        return mark, first, self._other(first, mark)

    def _other(self, bucket: np.ndarray, mark: np.ndarray) -> np.ndarray:
        return bucket ^ (mix(mark.astype(np.uint64)) & np.uint64(len(self.table) - 1)).astype(np.int64)

    def contains(self, keys: np.ndarray) -> np.ndarray:
        """Whether each key may be in the set; a key that is in it is never denied."""
        mark, a, b = self._places(keys)
        return (self.table[a] == mark[:, None]).any(1) | (self.table[b] == mark[:, None]).any(1)

    def insert(self, keys: np.ndarray) -> bool:
        """Put keys in; False if there is no room, the filter then being unfit."""
        mark, a, b = self._places(keys)
        rng = np.random.default_rng(7)
        for m, i, j in zip(mark, a.tolist(), b.tolist(), strict=True):
            for at in (i, j):
                free = np.flatnonzero(self.table[at] == 0)
                if len(free):
                    self.table[at, free[0]] = m
                    break
            else:
                at = (i, j)[int(rng.integers(2))]
                for _ in range(KICKS):
                    slot = int(rng.integers(SLOTS))
                    m, self.table[at, slot] = self.table[at, slot], m
                    at = int(self._other(np.array([at]), np.array([m], np.uint16))[0])
                    free = np.flatnonzero(self.table[at] == 0)
                    if len(free):
                        self.table[at, free[0]] = m
                        break
                else:
                    return False
        return True

    def delete(self, keys: np.ndarray) -> None:
        """Take out keys that were put in."""
        for m, i, j in zip(*(x.tolist() for x in self._places(keys)), strict=True):
            for at in (i, j):
                slots = np.flatnonzero(self.table[at] == m)
                if len(slots):
                    self.table[at, slots[0]] = 0
                    break

    def dump(self) -> bytes:
        return self.table.tobytes()

    @classmethod
    def load(cls, data: bytes) -> CuckooFilter:
        out = cls(1)
        out.table = np.frombuffer(data, np.uint16).reshape(-1, SLOTS).copy()
        return out


def _keys(docs: DataFrame, ask=None) -> DataFrame:
    """(k1, k2, doc_id): each row's long lines, once a row, of documents with an id; ``ask`` says which keys to keep."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keep = ask() if ask else None
        for pdf in parts(batches):
            out = []
            for doc_id, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                found = {digest(k) for line in text.split("\n") if (k := line_key(line)) is not None}
                out.extend((*d, doc_id) for d in found)
            rows = pd.DataFrame(out, columns=["k1", "k2", "doc_id"], dtype=np.int64)
            yield rows[keep(rows)] if keep else rows

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id IS NOT NULL AND text IS NOT NULL")
    return rows.mapInPandas(run, KEYS)


def _ask_sorted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The lines that their shard's filter may hold, from rows sorted so that a shard's filter comes before its lines."""
    at, cuckoo = None, None
    for pdf in batches:
        for key, rows in pdf.groupby(["shard", "salt"], sort=False):
            if key != at:
                at, cuckoo = key, None
            held = rows.loc[rows["side"] == 0, "data"]
            if len(held):
                cuckoo = CuckooFilter.load(bytes(held.iloc[0]))
            lines = rows[rows["side"] == 1]
            if cuckoo is not None and len(lines):
                yield lines.loc[cuckoo.contains(lines["k1"].to_numpy()), ["k1", "k2", "doc_id"]]


class LineIndex:
    """The index below ``path``. ``insert`` and ``delete`` take documents; ``clean`` drops repeated lines of documents.

    A document is its doc_id; deleting one takes the text that was inserted.
    Inserting what is held, or deleting what is not, changes nothing, so that a
    change can be tried again. A change is there once its state is written, after
    everything else; opening a path goes on from the last state, and what is
    written is never written over.
    """

    def __init__(self, spark: SparkSession, path: str, shards: int | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        self.number = latest_number(spark, self.path, "state")
        self.state = {"runs": [], "repeated": None, "filters": None, "shards": shards, "lines": 0}
        if self.number >= 0:
            self.state = spark.read.schema(STATE).parquet(f"{self.path}/state-{self.number}").first().asDict()

    def insert(self, docs: DataFrame) -> None:
        self._change(docs, 1)

    def delete(self, docs: DataFrame) -> None:
        self._change(docs, -1)

    def counts(self) -> DataFrame:
        """Exact counts of repeated lines: k1, k2, n_docs, last (the largest doc_id that holds the line)."""
        if not self.state["repeated"]:
            return self.spark.createDataFrame([], REPEATED)
        return self._table("repeated", REPEATED)

    def _table(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/{self.state[name]}")

    def _runs(self, names: list[str]) -> DataFrame:
        return self.spark.read.schema(RUN).parquet(*(f"{self.path}/{r}" for r in names))

    def _change(self, docs: DataFrame, sign: int) -> None:
        n, held = self.number + 1, self.state
        rows = _keys(docs).distinct().select("*", F.lit(sign).alias("sign"), F.lit(n).alias("run"))
        run = written(rows, f"{self.path}/run-{n}")
        runs = [*held["runs"], f"run-{n}"]
        live = run.where("sign > 0")
        if held["runs"]:
            # Only lines that the change names are counted anew.
            named = run.select("k1", "k2").distinct()
            live = self._live(self._runs(runs).join(named, ["k1", "k2"], "left_semi"))
        now = live.groupBy("k1", "k2").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("last")).where(F.col("n_docs") >= MIN_DOCS)
        if held["runs"]:
            now = self.counts().join(named, ["k1", "k2"], "left_anti").unionByName(now)
        now = written(now, f"{self.path}/repeated-{n}")
        size = now.count()
        shards = held["shards"] or max(1, -(-size // SHARD_KEYS))
        anew = not held["filters"] or size > 2 * shards * SHARD_KEYS
        if anew and held["filters"]:
            shards = -(-size // SHARD_KEYS)
        written(self._filters(now, shards, anew), f"{self.path}/filters-{n}")
        if len(runs) > RUNS:
            written(self._live(self._runs(runs)).select("k1", "k2", "doc_id", F.lit(1).alias("sign"), F.lit(n).alias("run")), f"{self.path}/merged-{n}")
            runs = [f"merged-{n}"]
        state = {"runs": runs, "repeated": f"repeated-{n}", "filters": f"filters-{n}", "shards": shards, "lines": held["lines"] + run.count()}
        self.spark.createDataFrame([tuple(state.values())], STATE).coalesce(1).write.mode("error").parquet(f"{self.path}/state-{n}")
        self.number, self.state = n, state

    @staticmethod
    def _live(rows: DataFrame) -> DataFrame:
        return rows.groupBy("k1", "k2", "doc_id").agg(F.max_by("sign", "run").alias("sign")).where("sign > 0")

    def _filters(self, now: DataFrame, shards: int, anew: bool) -> DataFrame:
        """The shards' filters of the repeated lines ``now``, changed from those held or built anew."""
        keys = now.select("k1", "k2")
        if anew:
            kinds = keys.withColumn("kind", F.lit("add"))
        else:
            old = self.counts().select("k1", "k2")
            same = keys.join(old, ["k1", "k2"], "left_semi").withColumn("kind", F.lit("keep"))
            kinds = same.union(keys.join(old, ["k1", "k2"], "left_anti").withColumn("kind", F.lit("add"))).union(old.join(keys, ["k1", "k2"], "left_anti").withColumn("kind", F.lit("drop")))
        rows = kinds.select(F.pmod("k2", F.lit(shards)).cast("int").alias("shard"), "k1", "kind", F.lit(None).cast("binary").alias("data"))
        if not anew:
            rows = rows.union(self._table("filters", FILTERS).select("shard", F.lit(0).cast("long"), F.lit("filter"), "data"))

        def build(pdf: pd.DataFrame) -> pd.DataFrame:
            pick = lambda *kinds: pdf.loc[pdf["kind"].isin(kinds), "k1"].to_numpy(np.int64)
            stored = pdf.loc[pdf["kind"] == "filter", "data"]
            cuckoo, ready = (CuckooFilter.load(bytes(stored.iloc[0])), True) if len(stored) else (None, False)
            if ready:
                cuckoo.delete(pick("drop"))
                ready = cuckoo.insert(pick("add"))
            size = len(pick("keep", "add"))
            while not ready:  # no filter yet, or no room: anew from the exact counts
                cuckoo = CuckooFilter.sized(size)
                ready, size = cuckoo.insert(pick("keep", "add")), 2 * size
            return pd.DataFrame({"shard": [int(pdf["shard"].iloc[0])], "data": [cuckoo.dump()]})

        # A shard has about SHARD_KEYS distinct repeated lines, twice that at most, however many documents hold them.
        return rows.groupBy("shard").applyInPandas(build, FILTERS)

    def candidates(self, docs: DataFrame) -> DataFrame:
        """(k1, k2, doc_id): the lines of ``docs`` that the filters may hold. A small set of filters is asked where lines are
        read; of a larger one each filter is asked by the tasks that its shard's lines go to, several for a shard of many.
        """
        filters, shards = self._table("filters", FILTERS), self.state["shards"]
        if (filters.agg(F.sum(F.length("data"))).first()[0] or 0) <= FILTER_BYTES:
            shared = self.spark.sparkContext.broadcast({r["shard"]: bytes(r["data"]) for r in filters.collect()})

            def ask():
                held = {s: CuckooFilter.load(d) for s, d in shared.value.items()}

                def keep(rows: pd.DataFrame) -> np.ndarray:
                    k1, shard = rows["k1"].to_numpy(), np.mod(rows["k2"].to_numpy(), shards)
                    may = np.zeros(len(rows), bool)
                    for s, cuckoo in held.items():
                        at = np.flatnonzero(shard == s)
                        may[at] = cuckoo.contains(k1[at])
                    return may

                return keep

            return _keys(docs, ask)
        salts = max(1, -(-self.state["lines"] // (shards * SHARD_LINES)))
        lines = _keys(docs).select(F.pmod("k2", F.lit(shards)).cast("int").alias("shard"), F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int").alias("salt"), F.lit(1).alias("side"), "k1", "k2", "doc_id", F.lit(None).cast("binary").alias("data"))
        copies = filters.select("shard", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), F.lit(0).alias("side"), *(F.lit(0).cast("long").alias(c) for c in ("k1", "k2", "doc_id")), "data")
        return lines.union(copies).repartition("shard", "salt").sortWithinPartitions("shard", "salt", "side").mapInPandas(_ask_sorted, KEYS)

    def drops(self, docs: DataFrame) -> DataFrame:
        """(doc_id, drop): digests of the lines that each document loses; documents that lose none are left out."""
        lost = self.candidates(docs).join(self.counts().select("k1", "k2", "last"), ["k1", "k2"]).where("doc_id <> last")
        return lost.groupBy("doc_id").agg(F.collect_set(F.struct("k1", "k2")).alias("drop"))

    def clean(self, docs: DataFrame, report: bool = True) -> DataFrame:
        """``docs`` with the kept ``text``; other columns as they are. ``report`` adds ``n_lines`` and ``n_dropped``.

        A null or empty text is one empty line and stays as it is. Columns of the
        report's names are replaced by it, and kept without one.
        """
        added = ["n_lines", "n_dropped"] if report else []
        names = [c for c in docs.columns if c.lower() not in added]
        docs = docs.select(*(F.col(f"`{c}`") for c in names))
        if self.number < 0:
            raise ValueError("the index has no documents")
        of, drop, kept = (unused(names, c) for c in ("_of", "_drop", "_kept"))
        drops = self.drops(docs).select(F.col("doc_id").alias(of), F.col("drop").alias(drop))

        @F.pandas_udf("struct<text:string,n_lines:long,n_dropped:long>")
        def strip(text: pd.Series, drop: pd.Series) -> pd.DataFrame:
            out = []
            for t, d in zip(text, drop, strict=True):
                if d is None or t is None:
                    out.append((t, 1 if t is None else t.count("\n") + 1, 0))
                    continue
                gone = {(x["k1"], x["k2"]) for x in d}
                lines = t.split("\n")
                keep = [x for x in lines if (k := line_key(x)) is None or digest(k) not in gone]
                out.append(("\n".join(keep), len(lines), len(lines) - len(keep)))
            return pd.DataFrame(out, columns=["text", "n_lines", "n_dropped"])

        joined = docs.join(drops, F.col("doc_id").cast("long") == F.col(of), "left").withColumn(kept, strip("text", drop))
        return joined.select(*(F.col(f"{kept}.text").alias(c) if c.lower() == "text" else F.col(f"`{c}`") for c in names), *(f"{kept}.{c}" for c in added))


def dedup_lines(docs: DataFrame, path: str | None = None, report: bool = True) -> DataFrame:
    """Insert all ``docs`` into a new index and clean them.

    Lines whose key has 40 code points or more and that five documents or more
    hold go, except from the document of the largest doc_id. Rows without doc_id
    neither count nor lose lines; rows of one doc_id are one document. ``report``
    adds ``n_lines`` and ``n_dropped``, in place of columns of these names; all
    other columns stay, whatever their names. An empty table gives no rows.
    """
    index = LineIndex(docs.sparkSession, path or shared_dir(docs.sparkSession))
    if index.number >= 0:
        raise ValueError(f"{index.path} holds an index already; open it by LineIndex")
    index.insert(docs)
    return index.clean(docs, report)


def line_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped and the SHA-256 of the kept text per row of ``docs``."""
    cleaned = dedup_lines(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    return cleaned.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


ORACLE = """
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                  generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
h AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.*, h.key IS NOT NULL AND k.doc_id <> h.last AS gone FROM k LEFT JOIN h USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
