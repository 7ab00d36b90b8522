"""Multi-party perspective rotation: a dialogue rendered once for every participant.

In a participant's rendering that speaker is the assistant, the others are named
users and system turns stay system turns; the mask marks what is to be learned,
the assistant's text and its end mark. The result has a row per turn and
perspective with the turn's place in the rendering, so a dialogue of any length
is never held in one row or task: places come from sums over blocks of turns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Turn numbers that make a block of the running sums.
BLOCK = 64
START, END = "<|im_start|>", "<|im_end|>"
SYSTEM = "system"
UNKNOWN = "unknown"


def _head(role: Column, speaker: Column) -> Column:
    as_role = F.when(role == SYSTEM, F.lit(SYSTEM)).when(role == speaker, F.lit("assistant")).otherwise(F.concat(F.lit("user name="), role))
    return F.concat(F.lit(START), as_role, F.lit("\n"))


def rotate(turns: DataFrame) -> DataFrame:
    """Rows (conv_id, speaker, position, turn, role, rendered, start, end, mask_start, mask_end).

    ``speaker`` is the participant who is the assistant; ``start`` and ``end``
    are code points in that rendering, and the mask is empty (both at ``end``)
    on other speakers' turns. Turns go by turn, role, text, nulls first; equal
    rows are kept, each with its own place. A null text is empty, a null role is
    ``unknown``; turns without conv_id are one dialogue. A dialogue of system
    turns alone has no participant and no row, nor has an empty table. Extra
    columns are ignored.
    """
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit(UNKNOWN)).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce(F.floor(F.col("turn") / BLOCK).cast("long"), F.lit(-(2**62))).alias("block"),
    )
    speakers = rows.where(F.col("role") != SYSTEM).groupBy(F.col("conv_id").alias("c"), F.col("role").alias("speaker")).agg(F.lit(1).alias("one")).drop("one")
    seen = rows.join(speakers, F.col("conv_id").eqNullSafe(F.col("c"))).drop("c")
    tail = F.concat("text", F.lit(END + "\n"))
    seen = seen.withColumn("head", F.length(_head(F.col("role"), F.col("speaker")))).withColumn("size", (F.col("head") + F.length(tail)).cast("long"))
    key = ["conv_id", "speaker"]
    blocks = seen.groupBy(*key, "block").agg(F.count("*").alias("n"), F.sum("size").alias("chars"))
    ahead = Window.partitionBy(*key).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(
        F.col("conv_id").alias("c"), F.col("speaker").alias("s"), F.col("block").alias("b"),
        F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("rows_ahead"),
        F.coalesce(F.sum("chars").over(ahead), F.lit(0)).alias("chars_ahead"),
    )
    here = Window.partitionBy(*key, "block").orderBy("turn", "role", "text")
    placed = seen.withColumn("rank", F.row_number().over(here)).withColumn("upto", F.sum("size").over(here.rowsBetween(Window.unboundedPreceding, 0)))
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("speaker") == F.col("s")) & (F.col("block") == F.col("b"))
    end = F.col("chars_ahead") + F.col("upto")
    mine = F.col("role") == F.col("speaker")
    out = placed.join(blocks, same).select(
        *key, (F.col("rows_ahead") + F.col("rank") - 1).cast("long").alias("position"), "turn", "role",
        F.concat(_head(F.col("role"), F.col("speaker")), tail).alias("rendered"),
        (end - F.col("size")).alias("start"), end.alias("end"),
        F.when(mine, end - F.col("size") + F.col("head")).otherwise(end).alias("mask_start"),
        F.when(mine, end - 1).otherwise(end).alias("mask_end"),
    )
    return out


ORACLE = """
WITH t AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations),
s AS (SELECT DISTINCT conv_id, role AS speaker FROM t WHERE role <> 'system'),
r AS (SELECT t.conv_id, s.speaker, t.turn, t.role, t.text,
        '<|im_start|>' || CASE WHEN t.role = 'system' THEN 'system' WHEN t.role = s.speaker THEN 'assistant'
          ELSE 'user name=' || t.role END || chr(10) AS head, t.text || '<|im_end|>' || chr(10) AS tail
      FROM t JOIN s ON t.conv_id IS NOT DISTINCT FROM s.conv_id),
p AS (SELECT *, row_number() OVER w - 1 AS position, sum(length(head) + length(tail)) OVER w AS upto
      FROM r WINDOW w AS (PARTITION BY conv_id, speaker ORDER BY turn NULLS FIRST, role, text
                          ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT conv_id, speaker, position, turn, role, head || tail AS rendered,
  (upto - length(head) - length(tail))::BIGINT AS start, upto::BIGINT AS "end",
  CASE WHEN role = speaker THEN upto - length(tail) ELSE upto END::BIGINT AS mask_start,
  CASE WHEN role = speaker THEN upto - 1 ELSE upto END::BIGINT AS mask_end
FROM p
"""
