"""A resolution's state machine over a stream of moves, equal to the fold over a table of them."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from tallyrail.operators.audit import ADDED, EDGES, TERMINAL

START = "initial"
#: What a move gives: the state before, the state asked for, whether it was legal, how often the key has been probed since.
MOVED = "key string, at timestamp, source string, target string, verdict string, round int"


def legal() -> dict[str, set[str]]:
    """States that may follow each state."""
    return {s: {*EDGES.get(s, ()), *ADDED.get(s, ())} for s in {*EDGES, *ADDED}}


class Machine(StatefulProcessor):
    """Per key the state reached and the round. An illegal move changes neither; an idle key that is not at its end is given up."""

    def __init__(self, idle_ms: int | None):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.edges = handle, legal()
        self.reached = handle.getValueState("reached", "state string, round int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  Spark's names
        state, round_ = self.reached.get() if self.reached.exists() else (START, 0)
        out, moves = [], pd.concat(list(rows)).sort_values(["at", "target"])
        for at, target in zip(moves["at"], moves["target"], strict=True):
            ok = target in self.edges.get(state, ())
            round_ += ok and target == "probed"
            out.append((key[0], at, state, target, "legal" if ok else "illegal", round_))
            state = target if ok else state
        self.reached.update((state, int(round_)))
        if self.idle_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            if state not in TERMINAL:
                self.handle.registerTimer(int(moves["at"].max().timestamp() * 1000) + self.idle_ms)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in MOVED.split(", ")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  Spark's names
        state, round_ = self.reached.get()
        self.reached.update(("failed", round_))
        yield pd.DataFrame([(key[0], pd.Timestamp(expiredTimerInfo.getExpiryTimeInMs(), unit="ms"), state, "failed", "expired", round_)], columns=[c.split()[0] for c in MOVED.split(", ")])

    def close(self) -> None:
        pass


def machine(stream: DataFrame, late: str = "0 seconds", idle_ms: int | None = None) -> DataFrame:
    """Moves (key, at, target) with their verdicts (MOVED). The session's state store must be RocksDB.

    Moves of a key are taken in order of their time within a batch. With ``idle_ms``
    a key is given up when the watermark is so far beyond its last move.
    """
    rows = stream.select(F.col("key").cast("string").alias("key"), "at", "target").withWatermark("at", late)
    return rows.groupBy("key").transformWithStateInPandas(Machine(idle_ms), MOVED, "Append", "EventTime" if idle_ms is not None else "None")


def split(moved: DataFrame, legal_path: str, other_path: str, checkpoint: str) -> StreamingQuery:
    """Write legal moves to one table and the others to another; a repeated batch replaces what it wrote."""

    def both(batch: DataFrame, epoch: int) -> None:
        held = batch.persist()
        held.where("verdict = 'legal'").write.mode("overwrite").parquet(f"{legal_path}/batch={epoch}")
        held.where("verdict <> 'legal'").write.mode("overwrite").parquet(f"{other_path}/batch={epoch}")
        held.unpersist()

    return moved.writeStream.foreachBatch(both).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def folded(moves: DataFrame) -> DataFrame:
    """The same verdicts (MOVED) over a table: a fold over each key's moves in order of time, then of the state asked for."""
    edges = F.create_map(*(F.lit(x) for s, ts in legal().items() for x in (f"{s}", ",".join(sorted(ts)))))
    ordered = F.array_sort(F.collect_list(F.struct("at", "target")))
    may = lambda s, t: F.coalesce(F.array_contains(F.split(F.try_element_at(edges, s), ","), t), F.lit(False))

    def step(acc: Column, m: Column) -> Column:
        ok = may(acc["state"], m["target"])
        round_ = acc["round"] + F.when(ok & (m["target"] == "probed"), 1).otherwise(0)
        row = F.struct(m["at"].alias("at"), acc["state"].alias("source"), m["target"].alias("target"), F.when(ok, "legal").otherwise("illegal").alias("verdict"), round_.alias("round"))
        return F.struct(F.when(ok, m["target"]).otherwise(acc["state"]).alias("state"), round_.alias("round"), F.array_append(acc["rows"], row).alias("rows"))

    none = F.array().cast("array<struct<at:timestamp,source:string,target:string,verdict:string,round:int>>")
    start = F.struct(F.lit(START).alias("state"), F.lit(0).alias("round"), none.alias("rows"))
    return moves.groupBy(F.col("key").cast("string").alias("key")).agg(F.aggregate(ordered, start, step, lambda acc: acc["rows"]).alias("r")).select("key", F.inline("r"))
