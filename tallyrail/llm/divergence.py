"""Source divergence audit: each (lang, source) group against its peers and its language.

Words are counted by group, the terms of enough documents of a language are kept,
and a group's counts become vectors cut into blocks of terms. Groups sit in seats.
A seat's vectors of a block stay in their partition while the compressed vectors
of other seats come by in the rounds of a tournament (circle method): every seat
meets one other in a round, and a meeting gives the differences of all groups of
the one and the other in both directions. A block's best terms of a group are
ranked where the block is, and only those are ranked over all blocks.

Null text, lang and source are ''. Rows of one doc_id count each. Groups without
terms have all their pairs; languages without kept terms have pairs of value 0 and
no terms. An empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyrail.llm.common import shared_dir, written

#: A term is kept in a language if so many of its documents have it; the terms ranked for a group; what is added to a count.
LEAST_DOCS, TOP, ADDED = 30, 50, 5
SCALE = 1_000_000_000
#: Entries of a block's vector, seats of a language at most, groups in a seat at least.
BLOCK_TERMS, SEATS, SEAT_GROUPS = 1 << 14, 64, 4
#: Groups that are few enough to be handed to all tasks.
FEW = 10_000
#: Words of all groups that a task counts before it hands them on: a memory bound.
HELD = 400_000

#: ASCII letters lower-cased, other ASCII characters blank; bytes of longer characters stay.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(text: bytes | None) -> list[bytes]:
    """The terms of a UTF-8 text: runs of ASCII letters and non-ASCII characters, A-Z lower-cased."""
    return (text or b"").translate(_FOLD).split()


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents with it); a row of term null for each group, n 0."""
    schema = "lang string, source string, term string, n long, docs long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple[str, str], list] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for (lang, source), (occurs, holds, rows) in groups.items():
                terms = list(occurs)
                for at in range(0, len(terms), 50_000):
                    part = terms[at : at + 50_000]
                    yield batch(lang, source, [t.decode("utf-8", "replace") for t in part], [occurs[t] for t in part], [holds[t] for t in part])
                yield batch(lang, source, [None], [0], [rows])
            groups.clear()

        def batch(lang: str, source: str, terms: list, n: list, docs: list) -> pa.RecordBatch:
            arrays = [pa.array([lang] * len(terms), pa.string()), pa.array([source] * len(terms), pa.string()), pa.array(terms, pa.string()), pa.array(n, pa.int64()), pa.array(docs, pa.int64())]
            return pa.RecordBatch.from_arrays(arrays, ["lang", "source", "term", "n", "docs"])

        for rows in batches:
            for text, lang, source in zip(*(rows.column(i).to_pylist() for i in range(3)), strict=True):
                group = groups.setdefault((lang, source), [Counter(), Counter(), 0])
                words = terms_of(text)
                group[0].update(words)
                group[1].update(set(words))
                group[2] += 1
            if sum(len(g[0]) for g in groups.values()) > HELD:
                yield from out()
        yield from out()

    named = docs.select(F.col("text").cast("string").cast("binary").alias("text"), *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")))
    return named.mapInArrow(run, schema).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def scaled(count: np.ndarray, total: int) -> np.ndarray:
    """1 + floor(SCALE * count / total) for counts up to ``total``, by long division in steps of a thousand: exact below 9e15."""
    quotient, rest = np.zeros_like(count), count
    for _ in range(3):
        step = rest * 1000
        quotient, rest = quotient * 1000 + step // total, step % total
    return quotient + 1


def packed(groups: list[tuple[str, int, int, np.ndarray, np.ndarray]]) -> bytes:
    """The vectors of a seat's groups in a block, compressed: names, totals, term ids and counts."""
    names = [g[0].encode("utf-8", "surrogatepass") for g in groups]
    head = np.array([len(groups), *(x for g, name in zip(groups, names, strict=True) for x in (g[1], g[2], len(g[3]), len(name)))], "<i8")
    ids = np.concatenate([np.diff(g[3], prepend=0) for g in groups]) if groups else np.empty(0, np.int64)
    counts = np.concatenate([g[4] for g in groups]) if groups else np.empty(0, np.int64)
    return zlib.compress(head.tobytes() + ids.astype("<i8").tobytes() + counts.astype("<i8").tobytes() + b"".join(names), 1)


def unpacked(payload: bytes) -> list[tuple[str, int, int, np.ndarray, np.ndarray]]:
    """What ``packed`` was given."""
    raw = zlib.decompress(payload)
    k = int(np.frombuffer(raw, "<i8", 1)[0])
    head = np.frombuffer(raw, "<i8", 4 * k, 8).reshape(k, 4)
    total = int(head[:, 2].sum())
    at = 8 + 32 * k
    ids, counts = np.frombuffer(raw, "<i8", total, at), np.frombuffer(raw, "<i8", total, at + 8 * total)
    cuts, name, out = np.concatenate(([0], np.cumsum(head[:, 2]))), at + 16 * total, []
    for i in range(k):
        n, v, _, size = (int(x) for x in head[i])
        out.append((raw[name : name + size].decode("utf-8", "surrogatepass"), n, v, np.cumsum(ids[cuts[i] : cuts[i + 1]]), counts[cuts[i] : cuts[i + 1]]))
        name += size
    return out


def meeting(here: list, there: list, block: int) -> Iterator[tuple[str, str, int]]:
    """(source, peer, value) of all groups of two seats in a block, both ways; of one seat with itself if ``there`` is ``here``.

    Over the terms of any of them the differences are summed less that of two
    absent terms; block 0 adds that of all kept terms, so that blocks sum up.
    """
    both = here if there is here else here + there
    every = np.unique(np.concatenate([g[3] for g in both]))
    shares, absent = np.empty((len(both), len(every)), np.int64), []
    for i, (_, n, v, ids, counts) in enumerate(both):
        total = n + ADDED * v
        if not total:  # no term is kept in the language
            absent.append(0)
            continue
        dense = np.full(len(every), ADDED, np.int64)
        dense[np.searchsorted(every, ids)] += counts
        shares[i] = scaled(dense, total)
        absent.append(int(scaled(np.array([ADDED], np.int64), total)[0]))
    for i in range(len(here)):
        for j in range(i + 1 if there is here else len(here), len(both)):
            plain = abs(absent[i] - absent[j])
            value = int(np.abs(shares[i] - shares[j]).sum()) - plain * len(every) if len(every) else 0
            value += plain * both[i][2] if block == 0 else 0
            yield both[i][0], both[j][0], value
            yield both[j][0], both[i][0], value


_PAIRS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("value", pa.int64())])


def met(rows: DataFrame) -> DataFrame:
    """lang, source, item, value of the meetings of ``here`` and ``there``, a block's part of each; ``there`` null is a seat by itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, block, here, there in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                mine = unpacked(here)
                found = list(meeting(mine, mine if there is None else unpacked(there), block))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), *(pa.array(x, t.type) for x, t in zip(zip(*found, strict=True), list(_PAIRS)[1:], strict=True))], schema=_PAIRS)

    return rows.select("lang", "block", "here", "there").mapInArrow(run, "lang string, source string, item string, value long")


def partner(seat: Column, seats: Column, turn: int) -> Column:
    """Whom a seat meets in a round of the circle method; ``seats`` is even, the last seat stays while the others turn."""
    last = seats - 1
    other = F.pmod(F.lit(turn) - seat, last)
    return F.when(seat == last, F.pmod(F.lit(turn) * (seats / 2).cast("long"), last)).when(other == seat, last).otherwise(other)


def bundles(vectors: DataFrame) -> DataFrame:
    """lang, block, seat, seats, payload: the vectors of a seat's groups, compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            payloads = []
            for members in batch.column(4).to_pylist():
                groups = []
                for m in sorted(members, key=lambda m: m["source"]):
                    ids, counts = np.array(m["ids"], np.int64), np.array(m["counts"], np.int64)
                    order = np.argsort(ids)
                    groups.append((m["source"], m["n"], m["v"], ids[order], counts[order]))
                payloads.append(packed(groups))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), pa.array(payloads, pa.binary())], ["lang", "block", "seat", "seats", "payload"])

    member = F.struct("source", F.col("total").alias("n"), F.col("kept").alias("v"), F.col("entries.id").alias("ids"), F.col("entries.n").alias("counts"))
    grouped = vectors.groupBy("lang", "block", "seat", "seats").agg(F.collect_list(member).alias("members"))
    return grouped.mapInArrow(run, "lang string, block int, seat long, seats long, payload binary")


def audit(docs: DataFrame) -> DataFrame:
    """lang, source, part (`pair`, `term`), item, value, rank for every (lang, source) group of ``docs``."""
    spark = docs.sparkSession
    path = shared_dir(spark)
    counts = written(term_counts(docs), f"{path}/counts")
    kept = counts.where("term IS NOT NULL").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("all")).where(F.col("docs") >= LEAST_DOCS)
    kept = written(kept.select("lang", "term", "all", F.monotonically_increasing_id().alias("id")), f"{path}/kept")
    langs = kept.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("all").alias("lang_total"))
    named = counts.where("term IS NULL").select("lang", "source")
    terms, sources = langs.agg(F.max("kept")).first()[0] or 0, named.groupBy("lang").count().agg(F.max("count")).first()[0] or 0
    blocks, in_seat = max(1, -(-terms // BLOCK_TERMS)), max(SEAT_GROUPS, -(-sources // SEATS))

    # A group's vector in a block is a row, empty where it has none of the block's terms.
    entry = F.struct("id", "n", "all", "term")
    found = counts.join(kept, ["lang", "term"]).select("lang", "source", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"), entry.alias("entry"))
    every = named.select("lang", "source", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(None).cast(found.schema["entry"].dataType).alias("entry"))
    vectors = written(found.unionByName(every).groupBy("lang", "source", "block").agg(F.collect_list("entry").alias("entries")), f"{path}/vectors")

    seated = Window.partitionBy("lang").orderBy("source")
    totals = vectors.groupBy("lang", "source").agg(F.sum(F.aggregate("entries.n", F.lit(0).cast("long"), lambda a, x: a + x)).alias("total"))
    groups = totals.withColumn("seat", F.floor((F.row_number().over(seated) - 1) / in_seat)).join(langs, "lang", "left").na.fill(0, ["kept", "lang_total"])
    most = groups.groupBy("lang").agg((2 * F.ceil((F.max("seat") + 1) / 2)).alias("seats"))
    groups = written(groups.join(most, "lang"), f"{path}/groups")
    # A row per group: handed to all tasks while there are few, joined by shuffle otherwise.
    vectors = vectors.join(F.broadcast(groups) if groups.count() <= FEW else groups, ["lang", "source"])

    table = written(bundles(vectors), f"{path}/bundles")
    turns = max(0, (groups.agg(F.max("seats")).first()[0] or 0) - 1)
    tables = [f"{path}/own"]
    met(table.select("lang", "block", F.col("payload").alias("here"), F.lit(None).cast("binary").alias("there"))).write.parquet(tables[0])
    ways = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    residents = table.select("lang", "block", "seat", F.col("payload").alias("here")).repartition(ways, "lang", "block", "seat").persist(StorageLevel.DISK_ONLY)
    for turn in range(turns):
        to = partner(F.col("seat"), F.col("seats"), turn)
        # Of two that meet, the one whose number fits the round's parity is visited.
        visits = F.when((F.col("seat") + to + turn) % 2 == 0, F.col("seat") > to).otherwise(F.col("seat") < to)
        visitors = table.where((F.lit(turn) < F.col("seats") - 1) & visits).select("lang", "block", to.cast("long").alias("seat"), F.col("payload").alias("there"))
        tables.append(f"{path}/round-{turn}")
        met(residents.join(visitors.repartition(ways, "lang", "block", "seat"), ["lang", "block", "seat"])).write.parquet(tables[-1])
    residents.unpersist()
    schema = "lang string, source string, item string, value long"
    pairs = spark.read.schema(schema).parquet(*tables).groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).withColumn("part", F.lit("pair"))
    everyone = ranked(pairs)

    # A block's best terms first, then the best of these.
    gains = F.expr(f"""transform(entries, e -> named_struct(
        'less', -((CAST({SCALE} AS DECIMAL(38,0)) * (e.n + {ADDED})) div (total + {ADDED} * kept) - (CAST({SCALE} AS DECIMAL(38,0)) * (e.all + {ADDED})) div (lang_total + {ADDED} * kept)),
        'item', e.term))""")
    best = F.slice(F.array_sort(F.filter(gains, lambda e: e["less"] < 0)), 1, TOP)
    terms = vectors.select("lang", "source", F.explode(best).alias("e")).select("lang", "source", "e.item", (-F.col("e.less")).alias("value"), F.lit("term").alias("part"))
    return everyone.unionByName(ranked(terms).where(F.col("rank") <= TOP))


def ranked(rows: DataFrame) -> DataFrame:
    """The rows with their rank within their group: value descending, item ascending by its UTF-8 bytes."""
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.col("item"))
    return rows.select("lang", "source", "part", "item", "value", F.row_number().over(order).alias("rank"))


ORACLE = r"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
w AS (SELECT lang, source, unnest(words) AS term FROM d),
kept AS (SELECT lang, term FROM (SELECT lang, unnest(list_distinct(words)) AS term FROM d) GROUP BY lang, term HAVING count(*) >= 30),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
n AS (SELECT lang, source, coalesce(sum(c.n), 0)::HUGEINT AS total FROM g LEFT JOIN c USING (lang, source) GROUP BY lang, source),
p AS (SELECT n.lang, n.source, kept.term, coalesce(c.n, 0) AS cnt,
             1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (n.total + 5 * v.v) AS p
      FROM n JOIN kept ON kept.lang = n.lang JOIN v ON v.lang = n.lang
      LEFT JOIN c ON c.lang = n.lang AND c.source = n.source AND c.term = kept.term),
l AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(n) + 5)) // (sum(sum(n)) OVER (PARTITION BY lang) + 5 * any_value(v)) AS q
      FROM c JOIN v USING (lang) GROUP BY lang, term),
pv AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
       FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(pv.value, 0)::BIGINT AS value
          FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN pv ON pv.lang = a.lang AND pv.source = a.source AND pv.item = b.source),
terms AS (SELECT p.lang, p.source, 'term' AS part, p.term AS item, (p.p - l.q)::BIGINT AS value
          FROM p JOIN l ON p.lang = l.lang AND p.term = l.term WHERE p.cnt > 0 AND p.p > l.q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank
      FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 50
"""
