"""Packing of documents into windows by Karmarkar-Karp multiway differencing.

A document's ids that fill whole windows are cut off as windows of their own;
what is left over is packed whole with its neighbours. A block of leftovers is
split into k windows by differencing: partial partitions start as one leftover
each, and the two with the largest spread are merged with opposing imbalances (the
largest sum of one with the smallest of the other) until one is left. k starts at
the least count that could hold the block and rises by one whenever a window
exceeds the capacity; as every leftover fits a window, no leftover is ever cut. No
rows move between partitions.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyrail.llm.common import parts
from tallyrail.llm.tokens import tokenizer

CAPACITY = 2048
END_ID = 1
#: Windows that a block of leftovers aims at; bounds a block's memory. Larger blocks have less padding and cost more.
BLOCK_WINDOWS = 192


def difference(sizes: list[int], k: int) -> list[list[int]]:
    """Split items into ``k`` groups of near-equal sums by Karmarkar-Karp differencing.

    A partial partition is a list of (sum, items) in descending order without
    its empty groups, and its spread is the largest sum less the smallest (zero
    while any group is empty). Ties go by the items' order, so equal input gives
    equal groups. Returns the item positions of every group, empty ones included.
    """
    if not sizes:
        return [[] for _ in range(k)]
    heap = [(-s, i, [(s, [i])]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    n = len(sizes)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        # Largest of a meets smallest of b; while there are empty groups, they are the smallest.
        over = max(0, len(a) + len(b) - k)
        cut_a, cut_b = len(a) - over, len(b) - over
        merged = a[:cut_a] + b[:cut_b] + [(x[0] + y[0], x[1] + y[1]) for x, y in zip(a[cut_a:], reversed(b[cut_b:]), strict=True)]
        merged.sort(key=lambda g: -g[0])
        spread = merged[0][0] - (merged[-1][0] if len(merged) == k else 0)
        heapq.heappush(heap, (-spread, n, merged))
        n += 1
    groups = [items for _, items in heap[0][2]]
    return groups + [[] for _ in range(k - len(groups))]


def windows_of(sizes: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Windows of whole items, none above ``capacity``, as the items' positions; an item above it is an error.

    The count starts at the least possible one: what the sum takes, or the items of
    which no two fit together. It rises while a window is too full, at most to one
    window per item.
    """
    if max(sizes) > capacity:
        raise ValueError("an item is larger than a window")
    for k in range(max(-(-sum(sizes) // capacity), sum(2 * s > capacity for s in sizes)), len(sizes)):
        groups = difference(sizes, k)
        if max(sum(sizes[i] for i in g) for g in groups) <= capacity:
            return [g for g in groups if g]
    return [[i] for i in range(len(sizes))]


def pack_documents(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", end_id: int = END_ID, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents with the sequence and offset that each has; ``with_ids`` adds the ids.

    A null or empty text is its end id alone. Repeated rows are packed each;
    a null doc_id stays null. An empty table gives no piece. Sequence ids are
    unique, not gapless: the partition's number times 2^33 plus a count.
    """
    fields = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    if with_ids:
        fields += ", ids array<int>"
    names = [f.split()[0] for f in fields.split(", ")]

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tok, seq = tokenizer(vocabulary), TaskContext.get().partitionId() << 33
        out: list[tuple] = []
        block: list[tuple] = []
        held = 0

        def piece(doc_id, ids, start, length, total, seq, offset) -> tuple:
            part = ids[start : start + length]
            row = (doc_id, start, length, zlib.crc32(part.astype("<u4").tobytes()), total, seq, offset)
            return (*row, part.tolist()) if with_ids else row

        def flush() -> None:
            nonlocal block, held, seq
            for window in windows_of([len(b[1]) - b[2] for b in block], capacity) if block else []:
                offset = 0
                for i in window:
                    doc_id, ids, base = block[i]
                    out.append(piece(doc_id, ids, base, len(ids) - base, len(ids), seq, offset))
                    offset += len(ids) - base
                seq += 1
            block, held = [], 0

        def rows() -> pd.DataFrame:
            nonlocal out
            done, out = out, []
            pdf = pd.DataFrame(done, columns=names)
            pdf["doc_id"] = pdf["doc_id"].astype("Int64")
            return pdf

        for pdf in parts(batches):
            for doc_id, ids in zip(pdf["doc_id"].astype("Int64"), tok.encode_all(pdf["text"].tolist()), strict=True):
                doc_id = None if doc_id is pd.NA else int(doc_id)
                ids = np.append(ids, np.int32(end_id))
                whole = len(ids) // capacity * capacity
                for start in range(0, whole, capacity):
                    out.append(piece(doc_id, ids, start, capacity, len(ids), seq, 0))
                    seq += 1
                if whole < len(ids):
                    block.append((doc_id, ids, whole))
                    held += len(ids) - whole
                if held >= BLOCK_WINDOWS * capacity:
                    flush()
                if len(out) >= 5000:
                    yield rows()
        flush()
        yield rows()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(pack, fields)
