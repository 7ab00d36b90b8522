"""JSON arrays in files of any size, read by several tasks.

Spark's text reader splits a file at commas, so a split starts at a whole
fragment. A first pass gives, for each split, what a scan from its start does to
the state (inside a string or not, depth), for both states that it may start in;
the splits' summaries, put in order, give every split its true state and the
number of elements before it. A second pass cuts the splits at the commas between
elements; only an element that spans splits is put together from its parts.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_ESCAPE = re.compile(rb"\\.", re.S)
_SUMMARY = "file string, start long, inside boolean, change int, commas map<int,long>, low int, opens int, low_after int, commas_before long, toggles boolean"


def _opening(field: str) -> re.Pattern:
    return re.compile(rb'"' + re.escape(field.encode()) + rb'"\s*:\s*\[')


def fragments(spark: SparkSession, path: str) -> DataFrame:
    """file, start, value: the text of the files between commas, in order within a split."""
    read = spark.read.option("lineSep", ",").text(path)
    return read.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("value"))


@dataclass
class Scan:
    """A scan over the text of a split, from a state."""

    inside: bool
    depth: int

    def step(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Depth after every byte, and whether it is outside of strings; the scan goes on behind ``data``."""
        raw = np.frombuffer(_ESCAPE.sub(b"xx", data), np.uint8)
        quotes = np.cumsum(raw == 34)
        outside = (quotes + self.inside) % 2 == 0
        turn = ((raw == 91) | (raw == 123)).astype(np.int32) - ((raw == 93) | (raw == 125))
        depth = self.depth + np.cumsum(np.where(outside, turn, 0))
        if len(raw):
            self.inside, self.depth = bool((quotes[-1] + self.inside) % 2), int(depth[-1])
        return depth, outside


def _by_split(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, bytes]]:
    """(file, start, text) of the parts of each split as they come, every fragment with the comma behind it."""
    for batch in batches:
        files, starts, values = (batch.column(i).to_pylist() for i in range(3))
        at = 0
        for i in range(1, len(files) + 1):
            if i == len(files) or (files[i], starts[i]) != (files[at], starts[at]):
                yield files[at], starts[at], b"".join(v + b"," for v in values[at:i])
                at = i


def summaries(rows: DataFrame, field: str | None) -> DataFrame:
    """Of each split and each state that it may start in: the depth's change and least value, commas by depth, and where ``field`` opens its array."""
    opening = None if field is None else _opening(field)
    schema = pa.schema([("file", pa.string()), ("start", pa.int64()), ("inside", pa.bool_()), ("change", pa.int32()), ("commas", pa.map_(pa.int32(), pa.int64())), ("low", pa.int32()), ("opens", pa.int32()), ("low_after", pa.int32()), ("commas_before", pa.int64()), ("toggles", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{"file": key[0], "start": key[1], **h, "commas": list(h["commas"].items()), "change": scan.depth, "toggles": scan.inside != h["inside"]} for scan, h in held], schema)

        for file, start, data in _by_split(batches):
            if (file, start) != key:
                if key is not None:
                    yield out()
                key = (file, start)
                held = [(Scan(inside, 0), {"inside": inside, "commas": Counter(), "low": 0, "opens": None, "low_after": None, "commas_before": None}) for inside in (False, True)]
            hits = [m.end() - 1 for m in opening.finditer(data)] if opening else []
            comma = np.frombuffer(data, np.uint8) == 44
            for scan, h in held:
                depth, outside = scan.step(data)
                hit = min((i for i in hits if outside[i]), key=lambda i: (depth[i], i), default=None)
                # The member of the outermost object is the one that opens least deep.
                if hit is not None and (h["opens"] is None or depth[hit] < h["opens"]):
                    d = int(depth[hit])
                    h |= {"opens": d, "low_after": int(depth[hit:].min()), "commas_before": h["commas"][d] + int((comma & outside & (depth == d))[:hit].sum())}
                elif h["opens"] is not None:
                    h["low_after"] = min(h["low_after"], int(depth.min()))
                at, n = np.unique(depth[comma & outside], return_counts=True)
                h["commas"].update(dict(zip(at.tolist(), n.tolist(), strict=True)))
                h["low"] = min(h["low"], int(depth.min()))
        if key is not None:
            yield out()

    return rows.mapInArrow(run, _SUMMARY)


@dataclass
class Plan:
    """How a split starts: in a string or not, its depth, and the ordinal of the element that it starts in or with."""

    inside: bool
    depth: int
    ordinal: int


def planned(found: list, field: str | None) -> dict[tuple[str, int], Plan]:
    """The start of every split that holds elements, from the summaries: two rows per split, not more."""
    by: dict[str, dict[int, dict[bool, object]]] = {}
    for r in found:
        by.setdefault(r["file"], {}).setdefault(r["start"], {})[r["inside"]] = r
    out, level = {}, 1 if field is None else 2
    for file, splits in by.items():
        inside, depth, ordinal, opened, closed = False, 0, 0, field is None, False
        for start in sorted(splits):
            r = splits[start][inside]
            first = not opened and r["opens"] is not None and r["opens"] + depth == level
            if (opened or first) and not closed:
                out[file, start] = Plan(inside, depth, ordinal)
                ordinal += r["commas"].get(level - depth, 0) - (r["commas_before"] if first else 0)
                closed = field is not None and (r["low_after"] if first else r["low"]) + depth < level
                opened = True
            inside, depth = inside ^ r["toggles"], depth + r["change"]
    return out


def pieces(rows: DataFrame, plan: dict[tuple[str, int], Plan], field: str | None) -> DataFrame:
    """file, ordinal, start, whole, text: the parts of elements that each split has; ``whole`` if both ends are in it."""
    shared = rows.sparkSession.sparkContext.broadcast(plan)
    level = 1 if field is None else 2
    opening = re.compile(rb"\[") if field is None else _opening(field)
    schema = pa.schema([("file", pa.string()), ("ordinal", pa.int64()), ("start", pa.int64()), ("whole", pa.bool_()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan, key, state = shared.value, None, None

        def out(done: list[tuple[int, bool, bytes]]) -> Iterator[pa.RecordBatch]:
            if done:
                yield pa.RecordBatch.from_pylist([{"file": key[0], "ordinal": o, "start": key[1], "whole": w, "text": t.decode("utf-8", "replace")} for o, w, t in done], schema)

        def rest() -> Iterator[pa.RecordBatch]:
            # What stands at a split's end goes on in the next one.
            if state is not None and state["held"]:
                yield from out([(state["ordinal"], False, state["held"])])

        for file, start, data in _by_split(batches):
            if (file, start) != key:
                yield from rest()
                key, p = (file, start), plan.get((file, start))
                state = p and {"scan": Scan(p.inside, p.depth), "ordinal": p.ordinal, "in": p.depth >= level, "cut": p.depth >= level, "ended": False, "held": b""}
            if state is None or state["ended"]:
                continue
            depth, outside = state["scan"].step(data)
            at = 0
            if not state["in"]:
                hit = next((m.end() - 1 for m in opening.finditer(data) if outside[m.end() - 1] and depth[m.end() - 1] == level), None)
                if hit is None:
                    continue
                state["in"], at = True, hit + 1
            ends = np.flatnonzero((depth < level) & outside)
            ends = ends[ends >= at]
            stop = int(ends[0]) if len(ends) else len(data)
            cuts = np.flatnonzero((np.frombuffer(data, np.uint8) == 44) & outside & (depth == level))
            done = []
            for cut in [*cuts[(cuts >= at) & (cuts < stop)].tolist(), *ends[:1].tolist()]:
                done.append((state["ordinal"], not state["cut"], state["held"] + data[at:cut]))
                state |= {"ordinal": state["ordinal"] + 1, "cut": False, "held": b""}
                at = cut + 1
            state["ended"] = len(ends) > 0
            state["held"] += b"" if state["ended"] else data[at:]
            yield from out(done)
        yield from rest()

    return rows.mapInArrow(run, "file string, ordinal long, start long, whole boolean, text string")


def elements(spark: SparkSession, path: str, field: str | None = None) -> DataFrame:
    """file, ordinal, text: the elements of the JSON arrays of the files at ``path``, numbered from 0 in each file.

    Without ``field`` a file is an array; with it the file is an object and the
    array is its member ``field``. An empty array has no rows; an element's text is
    as in the file, without the white space around it.
    """
    rows = fragments(spark, path)
    found = pieces(rows, planned(summaries(rows, field).collect(), field), field)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "text"))), lambda x: x["text"]), "")
    cut = found.where("NOT whole").groupBy("file", "ordinal").agg(joined.alias("text"))
    out = found.where("whole").select("file", "ordinal", "text").unionByName(cut)
    return out.withColumn("text", F.regexp_replace("text", r"^\s+|\s+$", "")).where("text <> ''")


def read_array(spark: SparkSession, path: str, schema: str | StructType, field: str | None = None) -> DataFrame:
    """file, ordinal, and ``e``, the element under ``schema``; an element that is no JSON is an error."""
    return elements(spark, path, field).select("file", "ordinal", F.from_json("text", schema, {"mode": "FAILFAST"}).alias("e"))


def write_array(rows: DataFrame, element: Column, path: str, order: list[str]) -> None:
    """JSON arrays, a file per partition, files and elements in the order of ``order``."""
    texts = rows.repartitionByRange(*order).sortWithinPartitions(*order).select(element.alias("value"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = "["
        for batch in batches:
            for value in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([before + value])], ["value"])
                before = ","
        yield pa.RecordBatch.from_arrays([pa.array(["[]" if before == "[" else "]"])], ["value"])

    texts.mapInArrow(run, "value string").write.mode("overwrite").text(path)
