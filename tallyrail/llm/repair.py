"""Token ids in grammar-compressed shards: Re-Pair with rules and expansion lengths.

Documents are dealt by ranges of doc_id and sorted, so shards follow doc_id. A
shard's ids are compressed by Re-Pair: the frequent pairs of adjacent symbols
are counted over the whole shard and replaced by new symbols, round by round,
until no pair is frequent or the 16-bit symbols are used up.
One round replaces many pairs at once, chosen by falling count so that no two
can overlap (a symbol is used as a left part or as a right part, never both).
Pairs do not cross documents, so any document can be decoded alone; the
expansion lengths find the symbol that holds a given token position.

File format of a shard, little-endian: magic ``RPG1``; five uint32: base symbols,
rules, documents, sequence length, null ids; uint32 pairs of the rules; uint32
expansion lengths of the rules; int64 doc ids; uint8 null flags; uint32 ends of
the documents in the sequence; uint32 token counts; the sequence as uint16.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyrail.llm.common import parts, shared_dir, written
from tallyrail.llm.tokens import tokenizer

MAGIC = b"RPG1"
END_ID = 2
#: Tokens of a shard, the pairs replaced in a round, and the least count of a pair worth a rule.
SHARD_TOKENS, PAIRS, LEAST = 1 << 20, 4096, 24
SHARD = "part int, shard int, n_docs int, n_tokens long, data binary"


@dataclass
class Shard:
    """A decoded header with the compressed sequence."""

    base: int
    rules: np.ndarray
    lengths: np.ndarray
    doc_ids: np.ndarray
    nulls: np.ndarray
    ends: np.ndarray
    counts: np.ndarray
    seq: np.ndarray


def _choose(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs' codes those to replace in this round, most frequent first and free of overlap, and all other frequent ones."""
    codes = np.sort(codes)
    first = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1]))) if len(codes) else np.empty(0, np.int64)
    count = np.diff(np.append(first, len(codes)))
    keep = count >= LEAST
    found, count = codes[first[keep]], count[keep]
    order = np.argsort(-count, kind="stable")
    lefts: set[int] = set()
    rights: set[int] = set()
    out: list[int] = []
    for code in found[order].tolist():
        a, b = code >> 16, code & 0xFFFF
        if a in rights or b in lefts or (a == b and (a in lefts or b in rights)):
            continue
        lefts.add(a)
        rights.add(b)
        out.append(code)
        if len(out) == PAIRS:
            break
    chosen = np.array(out, np.uint32)
    return chosen, np.setdiff1d(found, chosen, assume_unique=True)


def compress(ids: np.ndarray, ends: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Re-Pair of ``ids`` (documents end before ``ends``): rules as pairs, the sequence, the documents' ends in it.

    All pairs are counted once. Later only those are counted anew that can be
    frequent: pairs with a symbol of the round before, and the frequent pairs
    that were not replaced; all other counts have only fallen since.
    """
    seq = ids.astype(np.uint16)
    last = np.zeros(len(seq), bool)
    last[ends[ends > 0] - 1] = True
    rules: list[np.ndarray] = []
    top = base
    at, flags = np.flatnonzero(~last), np.zeros(1 << 16, np.uint8)
    while len(at) and top < 0xFFFF:
        codes = (seq[at].astype(np.uint32) << np.uint32(16)) | seq[at + 1]
        chosen, others = _choose(codes)
        if not len(chosen):
            break
        if len(chosen) > 0xFFFF - top:
            others, chosen = chosen[:0], chosen[: 0xFFFF - top]
        # Numbers of the left and right parts, and a table from both to the pair's new symbol; most positions fail the left part.
        left, right = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int32)
        lefts, rights = np.unique(chosen >> 16), np.unique(chosen & 0xFFFF)
        left[lefts], right[rights] = np.arange(1, len(lefts) + 1), np.arange(1, len(rights) + 1)
        table = np.zeros((len(lefts) + 1) * (len(rights) + 1), np.uint16)
        table[left[chosen >> 16] * (len(rights) + 1) + right[chosen & 0xFFFF]] = np.arange(top, top + len(chosen))
        a = np.take(left, codes >> 16, mode="clip")
        some = np.flatnonzero(a)
        new = table[a[some] * (len(rights) + 1) + np.take(right, codes[some] & 0xFFFF, mode="clip")]
        hit = np.flatnonzero(new)
        at, new = at[some[hit]], new[hit]
        if len(at) > 1:  # runs of one symbol: every other position
            first = np.concatenate(([True], np.diff(at) != 1))
            start = np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))
            even = (np.arange(len(at)) - start) % 2 == 0
            at, new = np.compress(even, at), np.compress(even, new)
        seq[at] = new
        last[at] = last[at + 1]
        keep = np.ones(len(seq), bool)
        keep[at + 1] = False
        seq, last = np.compress(keep, seq), np.compress(keep, last)
        rules.append(np.stack((chosen >> 16, chosen & 0xFFFF), 1))
        # Marks: a symbol of this round, a left and a right part of a frequent pair that stays.
        flags[:] = 0
        flags[top : top + len(chosen)] = 1
        flags[others >> 16] |= 2
        flags[others & 0xFFFF] |= 4
        top += len(chosen)
        mark = np.take(flags, seq, mode="clip")
        near = ((mark[:-1] | mark[1:]) & 1).view(bool)
        if len(others):
            near |= (mark[:-1] & (mark[1:] >> 1) & 2) > 0
        at = np.flatnonzero(near & ~last[:-1])
    empty = np.diff(np.concatenate(([0], ends))) == 0
    new_ends = np.zeros(len(ends), np.int64)
    new_ends[~empty] = np.flatnonzero(last) + 1
    return np.concatenate(rules) if rules else np.empty((0, 2), np.uint32), seq, np.maximum.accumulate(new_ends) if len(ends) else new_ends


def expansion_lengths(rules: np.ndarray, base: int) -> np.ndarray:
    """Tokens that every rule stands for; a rule names only symbols before it."""
    out = np.zeros(len(rules), np.uint32)
    for i, (a, b) in enumerate(rules.tolist()):
        out[i] = (1 if a < base else out[a - base]) + (1 if b < base else out[b - base])
    return out


def dump(doc_ids: list, docs: list[np.ndarray], base: int) -> bytes:
    """The file of a shard; ids must be below ``base``, at most 2^16 - 1."""
    counts = np.array([len(d) for d in docs], np.uint32)
    ids = np.concatenate(docs) if docs else np.empty(0, np.int32)
    rules, seq, ends = compress(ids, np.cumsum(counts, dtype=np.int64), base)
    nulls = np.array([d is None for d in doc_ids], np.uint8)
    head = np.array([base, len(rules), len(docs), len(seq), int(nulls.sum())], "<u4")
    parts = (head, rules.astype("<u4"), expansion_lengths(rules, base).astype("<u4"), np.array([d or 0 for d in doc_ids], "<i8"), nulls, ends.astype("<u4"), counts.astype("<u4"), seq.astype("<u2"))
    return MAGIC + b"".join(p.tobytes() for p in parts)


def load(data: bytes) -> Shard:
    """Read a shard's file; a wrong magic or length is an error."""
    if data[:4] != MAGIC:
        raise ValueError("not a shard of this format")
    at = 4

    def take(kind: str, n: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(data, kind, n, at)
        at += out.nbytes
        return out

    base, n_rules, n_docs, n_seq, _ = take("<u4", 5).tolist()
    rules = take("<u4", 2 * n_rules).reshape(-1, 2)
    shard = Shard(base, rules, take("<u4", n_rules), take("<i8", n_docs), take("u1", n_docs), take("<u4", n_docs), take("<u4", n_docs), take("<u2", n_seq))
    if at != len(data):
        raise ValueError("the shard is cut short or has more than its header says")
    return shard


def expand(shard: Shard, start: int = 0, end: int | None = None) -> np.ndarray:
    """Token ids of the sequence's symbols from ``start`` to ``end``."""
    seq = shard.seq[start:end].astype(np.int64)
    size = np.concatenate((np.ones(shard.base, np.int64), shard.lengths.astype(np.int64)))
    begin = np.concatenate((np.arange(shard.base), shard.base + np.concatenate(([0], np.cumsum(shard.lengths, dtype=np.int64)[:-1])))) if len(shard.lengths) else np.arange(shard.base)
    flat = np.empty(shard.base + int(shard.lengths.sum()), np.int32)
    flat[: shard.base] = np.arange(shard.base)
    for i, (a, b) in enumerate(shard.rules.tolist()):
        o, m = begin[shard.base + i], size[a]
        flat[o : o + m] = flat[begin[a] : begin[a] + m]
        flat[o + m : o + m + size[b]] = flat[begin[b] : begin[b] + size[b]]
    length = size[seq]
    at = np.repeat(begin[seq] - np.concatenate(([0], np.cumsum(length)[:-1])), length) + np.arange(int(length.sum())) if len(seq) else np.empty(0, np.int64)
    return flat[at]


def document(shard: Shard, i: int) -> np.ndarray:
    """The ids of the shard's document ``i``, decoded alone."""
    return expand(shard, int(shard.ends[i - 1]) if i else 0, int(shard.ends[i]))


def token_at(shard: Shard, i: int, position: int) -> int:
    """The id at ``position`` of document ``i``, found by the expansion lengths without decoding the document."""
    if not 0 <= position < shard.counts[i]:
        raise IndexError(position)
    start = int(shard.ends[i - 1]) if i else 0
    size = lambda s: 1 if s < shard.base else int(shard.lengths[s - shard.base])
    for symbol in shard.seq[start : int(shard.ends[i])].tolist():
        if position < size(symbol):
            break
        position -= size(symbol)
    while symbol >= shard.base:
        a, b = shard.rules[symbol - shard.base].tolist()
        symbol, position = (a, position) if position < size(a) else (b, position - size(a))
    return symbol


def write_shards(docs: DataFrame, path: str, vocabulary: str = "word_bpe_49k.json", end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Encode, compress and write all documents in ascending doc_id to ``path``; returns the table of shards."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("tie"))
    rows = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tok, part, n = tokenizer(vocabulary), TaskContext.get().partitionId(), 0
        base = tok.full.get_vocab_size()
        ids: list = []
        encoded: list[np.ndarray] = []
        held = 0

        def shard() -> pd.DataFrame:
            nonlocal ids, encoded, held, n
            row = pd.DataFrame([(part, n, len(ids), held, dump(ids, encoded, base))], columns=[c.split()[0] for c in SHARD.split(", ")])
            ids, encoded, held, n = [], [], 0, n + 1
            return row

        for pdf in parts(batches):
            for doc_id, of_text in zip(pdf["doc_id"].astype("Int64"), tok.encode_all(pdf["text"].tolist()), strict=True):
                ids.append(None if doc_id is pd.NA else int(doc_id))
                encoded.append(np.append(of_text, np.int32(end_id)))
                held += len(encoded[-1])
                if held >= shard_tokens:
                    yield shard()
        if ids:
            yield shard()

    return written(rows.mapInPandas(encode, SHARD), path)


def read_shards(shards: DataFrame) -> DataFrame:
    """Documents decoded from their shards: doc_id, start, n_tokens, ids_crc32."""

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts(batches, 8):
            for part, n, data in zip(pdf["part"], pdf["shard"], pdf["data"], strict=True):
                shard = load(bytes(data))
                flat = expand(shard).astype("<u4")
                ends = np.cumsum(shard.counts, dtype=np.int64)
                if len(flat) != (ends[-1] if len(ends) else 0):
                    raise ValueError("the shard's token counts do not fit its ids")
                starts = ends - shard.counts
                crc = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                out = pd.DataFrame({"part": part, "shard": n, "doc_id": pd.array(shard.doc_ids, "Int64"), "within": starts, "n_tokens": shard.counts.astype(np.int64), "ids_crc32": crc})
                out.loc[shard.nulls == 1, "doc_id"] = pd.NA
                yield out
    docs = shards.select("part", "shard", "data").mapInPandas(decode, "part int, shard int, doc_id long, within long, n_tokens long, ids_crc32 long")
    sizes = shards.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = sizes.select("part", before(Window.orderBy("part")).alias("base"))  # a row per partition
    each = shards.select("part", "shard", F.col("n_tokens").alias("n")).withColumn("ahead", before(Window.partitionBy("part").orderBy("shard")))
    offsets = each.join(bases, "part").select("part", "shard", (F.col("base") + F.col("ahead")).alias("offset"))
    return docs.join(offsets, ["part", "shard"]).select("doc_id", (F.col("offset") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")


def token_files(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Write all documents' ids and return what the files hold.

    A null or empty text is its end id alone; repeated rows are written each, in
    the order of their text's hash; null ids come first. An empty table gives no row.
    """
    return read_shards(write_shards(docs, path or f"{shared_dir(docs.sparkSession)}/shards"))
