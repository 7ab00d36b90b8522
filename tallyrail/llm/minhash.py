"""Near-duplicate documents by SuperMinHash, banding, verification and union-find."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyrail.llm.common import hashed, join_spread, mix, parts, shared_dir, words_of, written

WORDS = 5
BANDS, ROWS = 48, 5
SLOTS = BANDS * ROWS
_ODD = mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)
_SEED = mix(np.arange(1001, 1001 + 2 * SLOTS, dtype=np.uint64))


def shingle_set(words: np.ndarray) -> np.ndarray:
    """Sorted distinct hashes of the five-word runs of hashed words; of fewer words, the whole sequence as one; of none, empty."""
    n = len(words)
    if n == 0:
        return words
    if n < WORDS:
        return mix((words * _ODD[:n]).sum(keepdims=True, dtype=np.uint64) + _ODD[10 + n])
    total = words[: n - WORDS + 1] * _ODD[0]
    for j in range(1, WORDS):
        total = total + words[j : n - WORDS + 1 + j] * _ODD[j]
    return np.unique(mix(total))


def super_minhash(sets: list[np.ndarray]) -> np.ndarray:
    """SuperMinHash signatures (one row of SLOTS values per set) of non-empty sets of hashes.

    In round j an element puts the value j plus a random fraction into the slot
    that its own random permutation has at place j; a slot keeps the least value.
    The permutations are drawn step by step (Fisher-Yates). Values of later
    rounds are larger than all of earlier ones, so a set is finished as soon as
    every slot is filled: large sets after a round or two.
    """
    out = np.full((len(sets), SLOTS), np.iinfo(np.uint64).max, np.uint64)
    flat, e = out.reshape(-1), np.concatenate(sets)
    doc = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    places = None
    for j in range(SLOTS):
        draw = mix(e ^ _SEED[2 * j + 1])
        k = j + (((draw >> np.uint64(32)) * np.uint64(SLOTS - j)) >> np.uint64(32)).astype(np.int64)
        if places is None:
            slot = k
        else:
            row = np.arange(len(e))
            slot = places[row, k].astype(np.int64)
            places[row, k] = places[row, j]
        value = (mix(e ^ _SEED[2 * j]) >> np.uint64(8)) | np.uint64(j << 56 if j < 256 else 0)
        np.minimum.at(flat, doc * SLOTS + slot, value)
        open_docs = (out == np.iinfo(np.uint64).max).any(1)
        if not open_docs.any():
            break
        keep = open_docs[doc]
        if places is None:
            e, doc, k = e[keep], doc[keep], k[keep]
            places = np.tile(np.arange(SLOTS, dtype=np.uint8), (len(e), 1))
            places[np.arange(len(e)), k] = 0
        elif not keep.all():
            e, doc, places = e[keep], doc[keep], places[keep]
    return out


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """A 64-bit key per band: equal for two sets if the band's slots are, and different between bands."""
    s = mix(signatures).reshape(-1, BANDS, ROWS)
    return mix((s * _ODD[:ROWS]).sum(2, dtype=np.uint64) + _SEED[:BANDS])


#: Estimates below this are no candidates: over four deviations of an estimate from 240 slots under the threshold.
ESTIMATE = 0.62
#: Rows of one side that a comparing task holds (the other side streams by), and rows of the other side in a unit.
HELD, STREAMED = 64, 1024
#: Linked nodes that a task unites at a time.
UNITED = 1_000_000
PROFILE = "doc_id long, n_shingles long, d1 long, d2 long, bands array<long>, sketch binary"


def _ints(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    return [struct.unpack("<qq", xxhash.xxh3_128_digest(s.tobytes())) for s in sets]


def profiles(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: set size, 128-bit digest of its shingle set, band keys and an 8-bit sketch of its signature."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts(batches):
            yield from _blocks(pdf["doc_id"].astype("Int64").tolist(), pdf["text"])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, PROFILE)


def _blocks(ids: list, texts, elements: int = 50_000) -> Iterator[pd.DataFrame]:
    rows: list[tuple] = []
    held = 0

    def done() -> pd.DataFrame:
        nonlocal rows, held
        full = [i for i, (_, s) in enumerate(rows) if len(s)]
        sets = [rows[i][1] for i in full]
        signs = super_minhash(sets) if sets else np.empty((0, SLOTS), np.uint64)
        keys, sketch, digests = band_keys(signs).astype(np.int64), mix(signs).astype(np.uint8), _ints(sets)
        out = [[None if i is pd.NA else i, len(s), None, None, None, None] for i, s in rows]
        for j, i in enumerate(full):
            out[i][2:] = [*digests[j], keys[j], sketch[j].tobytes()]
        rows, held = [], 0
        pdf = pd.DataFrame(out, columns=[c.split()[0] for c in PROFILE.split(", ")])
        for c in ("doc_id", "d1", "d2"):
            pdf[c] = pd.array([None if v is None else int(v) for v in pdf[c].astype(object).where(pdf[c].notna(), None)], "Int64")
        return pdf

    for i, text in zip(ids, texts, strict=True):
        s = shingle_set(hashed(words_of(text)))
        rows.append((i, s))
        held += len(s)
        if held >= elements:
            yield done()
    if rows:
        yield done()


def _units(pairs: Iterator[pd.DataFrame], columns: list[str]) -> Iterator[tuple[pd.DataFrame, pd.DataFrame]]:
    """(held rows, a batch of streamed rows) of each unit, from batches sorted by unit with held rows first."""
    current, held = None, []
    for pdf in pairs:
        cut = np.flatnonzero((pdf[columns].to_numpy()[1:] != pdf[columns].to_numpy()[:-1]).any(1)) + 1 if len(pdf) else []
        for part in np.split(np.arange(len(pdf)), cut):
            if not len(part):
                continue
            rows = pdf.iloc[part]
            key = tuple(rows[columns].iloc[0])
            if key != current:
                current, held = key, []
            left, right = rows[rows["side"] == 0], rows[rows["side"] == 1]
            if len(left):
                held.append(left)
            if len(right) and held:
                held = [pd.concat(held)] if len(held) > 1 else held
                yield held[0], right


def compare_sets(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of sorted distinct sets, one row per right set, by postings of the left ones."""
    elements = np.concatenate(left)
    order = np.argsort(elements, kind="stable")
    elements, owner = elements[order], np.repeat(np.arange(len(left)), [len(s) for s in left])[order]
    out = np.zeros((len(right), len(left)), np.int64)
    for i, s in enumerate(right):
        lo, hi = np.searchsorted(elements, s, "left"), np.searchsorted(elements, s, "right")
        n = hi - lo
        if total := int(n.sum()):
            at = np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(total)
            out[i] = np.bincount(owner[at], minlength=len(left))
    return out


def _verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links (a, b) whose full sets have 100 * intersection >= 75 * union, for the units of the input."""
    read = lambda column: [np.frombuffer(bytes(s), np.uint64) for s in column]
    for held, rows in _units(batches, ["u1", "u2", "u3"]):
        left, right = read(held["shingles"]), read(rows["shingles"])
        both = compare_sets(left, right)
        union = np.array([len(s) for s in right])[:, None] + np.array([len(s) for s in left]) - both
        i, j = np.nonzero(100 * both >= 75 * union)
        a, b = held["node"].to_numpy()[j], rows["node"].to_numpy()[i]
        keep = a != b
        if keep.any():
            yield pd.DataFrame({"a": a[keep], "b": b[keep]})


def _stacked(sketches: pd.Series) -> np.ndarray:
    """The sketches of a column, a row each."""
    return np.frombuffer(b"".join(sketches), np.uint8).reshape(-1, SLOTS)


def _meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows of each unit that have a candidate on the other side, in another component.

    A pair counts in the first band whose key it shares, so that it is not taken up
    again in the buckets of other bands. Sketches can agree in a band whose keys differ.
    """
    for held, rows in _units(batches, ["u1", "u2", "u3"]):
        left = _stacked(held["sketch"])
        seen = np.zeros(len(held), bool)
        for at in range(0, len(rows), 256):
            part = rows.iloc[at : at + 256]
            right = _stacked(part["sketch"])
            same = right[:, None, :] == left[None]
            near = same.mean(2) >= ESTIMATE
            near &= part["component"].to_numpy()[:, None] != held["component"].to_numpy()
            n, m = part["n"].to_numpy()[:, None], held["n"].to_numpy()
            near &= 100 * np.minimum(n, m) >= 75 * np.maximum(n, m)
            i, j = np.nonzero(near)
            if len(i):
                keys = np.stack(part["bands"].to_numpy())[i] == np.stack(held["bands"].to_numpy())[j]
                first = keys.argmax(1) == part["band"].to_numpy()[i]
                i, j = i[first], j[first]
                seen[j] = True
                hit = part.iloc[np.unique(i)]
                yield hit[["u1", "u2", "u3", "side", "node"]]
        hit = held[seen]
        if len(hit):
            yield hit[["u1", "u2", "u3", "side", "node"]]


UNIT = "u1 long, u2 int, u3 int, side int, node long"


def _by_unit(rows: DataFrame) -> DataFrame:
    # By number: comparing costs time by the rows, so partitions are not to be joined by their bytes.
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "u1", "u2", "u3").sortWithinPartitions("u1", "u2", "u3", "side")


def _united(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Union-find over a partition's links: each node that is not its tree's smallest, with that node.

    With UNITED nodes at hand their trees are given out and forgotten; trees of
    several such parts are joined by the rounds that follow.
    """
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (up := parent.get(top, top)) != top:
            top = up
        while x != top:
            parent[x], x = top, parent.get(x, x)
        return top

    def stars() -> pd.DataFrame:
        nodes = [x for x in parent if root(x) != x]
        return pd.DataFrame({"a": nodes, "b": [parent[x] for x in nodes]}, dtype="int64")

    for pdf in parts(batches):
        for a, b in zip(pdf["a"].tolist(), pdf["b"].tolist(), strict=True):
            a, b = root(a), root(b)
            parent.setdefault(min(a, b), min(a, b))
            parent[max(a, b)] = min(a, b)
        if len(parent) >= UNITED:
            yield stars()
            parent.clear()
    yield stars()


def components(links: DataFrame, path: str) -> DataFrame:
    """(node, component) of every node of ``links`` (a, b): the smallest node reachable.

    A partition's links are first united among themselves, which leaves a star a
    tree. Then each round takes the least label among a node and its neighbours,
    and the label of that label; a round's labels are a written table. A node of
    many links, and a label of many nodes, are split in the joins.
    """
    links = links.select("a", "b").mapInPandas(_united, "a long, b long")
    both = written(links.select("a", "b").union(links.select("b", "a")).distinct(), f"{path}/links")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")), f"{path}/labels-0")
    degrees = written(both.groupBy("b").agg(F.count("*").alias("n")), f"{path}/degrees")
    for i in range(1, 200):
        near = join_spread(both, labels.select(F.col("node").alias("b"), "component"), "b", degrees, "a").groupBy("a").agg(F.min("component").alias("near"))
        step = written(labels.join(near, labels.node == near.a).select("node", "component", F.least("component", "near").alias("next")), f"{path}/near-{i}")
        jump = labels.select(F.col("node").alias("next"), F.col("component").alias("further"))
        step = join_spread(step, jump, "next", step.groupBy("next").agg(F.count("*").alias("n")), "node", "left")
        step = written(step.select("node", "component", F.least("next", F.coalesce("further", "next")).alias("next")), f"{path}/labels-{i}")
        changed = step.where("next < component").limit(1).count()
        labels = step.select("node", F.col("next").alias("component"))
        if not changed:
            return labels
    raise RuntimeError("components did not settle")


def near_duplicates(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id and kept, by links of similarity 0.75 or more.

    Documents with equal shingle sets are one node. Nodes that share a band's key
    meet in its bucket: first all with the bucket's smallest node, then, where a
    bucket still holds several components, those outside its largest one with all
    others, block by block, by the sketches and then on full sets. No pairs of a
    bucket are written out, and members of one component are not compared again.

    A null or empty text has the empty set and is linked with nothing. Rows with
    one doc_id are one document. A row without doc_id gets its set size, no
    component, and is kept; it links nothing. An empty table gives no rows.
    """
    spark = docs.sparkSession
    path = path or shared_dir(spark)
    rows = written(profiles(docs), f"{path}/profiles")
    full = rows.where("doc_id IS NOT NULL AND n_shingles > 0")
    nodes = full.groupBy("d1", "d2").agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    nodes = written(nodes, f"{path}/nodes")
    members = nodes.select("node", F.posexplode("bands").alias("band", "key"))
    shared = members.groupBy("key").agg(F.min("node").alias("lead"), F.max("node").alias("last"), F.count("*").alias("size")).where("size > 1 AND lead < last")
    shared = written(shared.select("key", "lead", "size"), f"{path}/shared")
    members = written(join_spread(members, shared, "key", shared.select("key", F.col("size").alias("n")), "node"), f"{path}/members")
    suspects = members.select("node").distinct()

    def to_sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts(batches):
            yield pd.DataFrame({"node": pdf["node"], "shingles": [shingle_set(hashed(words_of(t))).tobytes() for t in pdf["text"]]})

    texts = docs.select(F.col("doc_id").cast("long").alias("node"), "text").join(suspects.hint("shuffle_hash"), "node")
    sets = written(texts.mapInPandas(to_sets, "node long, shingles binary"), f"{path}/sets")
    sketches = nodes.select("node", "n", "sketch")
    keyed = nodes.select("node", "n", "sketch", "bands")

    @F.pandas_udf("boolean")
    def close(x: pd.Series, y: pd.Series) -> pd.Series:
        same = _stacked(x) == _stacked(y)
        return pd.Series(same.mean(1) >= ESTIMATE, dtype=bool)

    def verified(units: DataFrame, name: str) -> DataFrame:
        found = _by_unit(units.hint("shuffle_hash").join(sets, "node").select("u1", "u2", "u3", "side", "node", "shingles")).mapInPandas(_verify, "a long, b long")
        return written(found.distinct(), f"{path}/{name}")

    star = written(members.where("node <> lead").select("lead", "node").distinct(), f"{path}/meets")
    per_lead = lambda rows: rows.groupBy("lead").agg(F.count("*").alias("n"))
    left = sketches.select(F.col("node").alias("lead"), F.col("n").alias("m"), F.col("sketch").alias("other"))
    sizes = F.least("n", "m") * 100 >= F.greatest("n", "m") * 75
    star = join_spread(star.join(sketches, "node"), left, "lead", per_lead(star), "node").where(sizes).where(close("sketch", "other")).select("lead", "node").distinct()
    star = written(star, f"{path}/star")
    counts = written(per_lead(star), f"{path}/per-lead")
    chunks = counts.select("lead", F.ceil(F.col("n") / STREAMED).cast("int").alias("chunks"))
    star = join_spread(star, chunks, "lead", counts, "node").withColumn("u2", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    ends = star.select("lead", "u2").distinct().select(F.col("lead").alias("u1"), "u2", F.lit(0).alias("u3"), F.lit(0).alias("side"), F.col("lead").alias("node"))
    units = star.select(F.col("lead").alias("u1"), "u2", F.lit(0).alias("u3"), F.lit(1).alias("side"), "node").union(ends)
    links = verified(units, "links-1")
    labels = components(links, f"{path}/first")

    known = members.select("key", "band", "node").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    known = written(known, f"{path}/known")
    shares = known.groupBy("key", "component").agg(F.count("*").alias("c"))
    mixed = shares.groupBy("key").agg(F.max_by("component", F.struct("c", -F.col("component"))).alias("main"), F.max("c").alias("most"), F.sum("c").alias("size"), F.count("*").alias("parts")).where("parts > 1")
    mixed = mixed.select("key", "main", F.ceil((F.col("size") - F.col("most")) / HELD).cast("int").alias("blocks"), F.ceil(F.col("size") / STREAMED).cast("int").alias("chunks"))
    rest = join_spread(known, mixed, "key", shared.select("key", F.col("size").alias("n")), "node")
    number = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    outside = rest.where("component <> main").select(F.col("key").alias("u1"), number("blocks").alias("u2"), all_of("chunks").alias("u3"), F.lit(0).alias("side"), "node", "component", "band")
    others = rest.select(F.col("key").alias("u1"), number("chunks").alias("u3"), all_of("blocks").alias("u2"), F.lit(1).alias("side"), "node", "component", "band")
    meeting = outside.unionByName(others).join(keyed, "node").select("u1", "u2", "u3", "side", "node", "component", "band", "n", "sketch", "bands")
    units = written(_by_unit(meeting).mapInPandas(_meet, UNIT).distinct(), f"{path}/meeting")
    more = verified(units, "links-2")
    if not more.isEmpty():
        labels = components(written(links.union(more), f"{path}/links"), f"{path}/last")

    digests = F.struct("d1", "d2").alias("d")
    named = nodes.select(digests, F.col("node").alias("at")).join(labels, F.col("at") == F.col("node"), "left").select("d", F.coalesce("component", "at").alias("component"))
    # Rows of one doc_id with different texts share the smallest component of their sets.
    copies = rows.select("doc_id", "n_shingles", digests)
    out = join_spread(copies, named, "d", copies.groupBy("d").agg(F.count("*").alias("n")), "doc_id", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
        ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS sh FROM w),
n AS (SELECT doc_id, len(sh) AS n FROM s), e AS (SELECT doc_id, unnest(sh) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * c >= 75 * (x.n + y.n - c)),
g AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS node, doc_id AS comp FROM n UNION SELECT g.b, r.comp FROM r JOIN g ON r.node = g.a)
SELECT n.doc_id, n.n::BIGINT AS n_shingles, c.comp AS component_id, n.doc_id = c.comp AS kept
FROM n JOIN (SELECT node, min(comp) AS comp FROM r GROUP BY 1) c ON n.doc_id = c.node
"""
