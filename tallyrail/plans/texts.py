"""Text queries: code extraction, renaming, declarations, names, lines and chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyrail.functions import text as t
from tallyrail.operators import sequences as s
from tallyrail.plans.catalog import query
from tallyrail.session import read_table


@query(
    "q12_fence_extract",
    """
    WITH w AS (SELECT conv_id, turn, 'x' || chr(10) || '```c' || chr(10) || text || chr(10) || '```' || chr(10) || '```' || chr(10) || role || ': ' || role || chr(10) || '```' || chr(10) AS r FROM conversations WHERE text IS NOT NULL AND role IS NOT NULL),
    b AS (SELECT *, regexp_extract_all(r, '(?is)```(?:c|cpp|c\\+\\+)?\\s*\\n?(.*?)```', 1) AS blocks FROM w)
    SELECT conv_id, turn, len(blocks) AS blocks, sha256(trim(CASE WHEN length(blocks[2]) > length(blocks[1]) THEN blocks[2] ELSE blocks[1] END, ' ' || chr(9) || chr(10) || chr(13))) AS code_hash FROM b
    """.replace("\\\\", "\\"),
)
def fence_extract(spark, sf_dir):
    """The longest fenced block of a transcript that holds the whole text and a note, the first on a tie."""
    c = read_table(spark, sf_dir, "conversations").where("text IS NOT NULL AND role IS NOT NULL").select("conv_id", "turn", "text", "role")
    made = F.concat(F.lit("x\n```c\n"), "text", F.lit("\n```\n```\n"), "role", F.lit(": "), "role", F.lit("\n```\n"))
    got = t.markdown_fence(made)
    return c.select("conv_id", "turn", got["blocks"].alias("blocks"), F.sha2(got["code"], 256).alias("code_hash"))


@query(
    "q13_rename_whole_word",
    """
    WITH p AS (SELECT doc_id, text, regexp_replace(text, '(^|[^\\p{L}\\p{M}\\p{N}_])the($|[^\\p{L}\\p{M}\\p{N}_])', '\\1' || chr(1) || '\\2', 'g') AS once FROM documents),
    r AS (SELECT doc_id, regexp_replace(once, '(^|[^\\p{L}\\p{M}\\p{N}_])the($|[^\\p{L}\\p{M}\\p{N}_])', '\\1' || chr(1) || '\\2', 'g') AS twice FROM p)
    SELECT doc_id, sha256(replace(twice, chr(1), 'FUN_1')) AS code_hash, length(twice) - length(replace(twice, chr(1), '')) AS n_replaced FROM r
    """,
)
def rename_word(spark, sf_dir):
    """Whole-word renaming and its count, in all texts; letters with accents are parts of words."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    got = t.rename_word(F.col("text"), F.lit("the"), F.lit("FUN_1"))
    return docs.select("doc_id", F.sha2(got["code"], 256).alias("code_hash"), got["count"].cast("long").alias("n_replaced"))


@query(
    "q14_prepend_used",
    """
    WITH u AS (SELECT doc_id, list_filter(['the', 'der', 'que'], lambda w: regexp_matches(text, '(^|[^\\p{L}\\p{N}_])' || w || '($|[^\\p{L}\\p{N}_])')) AS used FROM documents)
    SELECT doc_id, len(used) AS added, array_to_string(used, ',') AS used FROM u
    """,
)
def prepend_used(spark, sf_dir):
    """Which declared names a text uses."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    used = F.array_compact(F.array(*(F.when(F.col("text").rlike(rf"(?U)\b{w}\b"), F.lit(w)) for w in ("the", "der", "que"))))
    added = t.prepend_used(F.col("text"), tuple((w, f"typedef int {w};") for w in ("the", "der", "que")))["added"]
    return docs.select("doc_id", added.cast("long").alias("added"), F.array_join(used, ",").alias("used"))


@query(
    "q15_safe_name",
    """
    SELECT page_id, coalesce(nullif(regexp_replace(regexp_replace(url, '[^A-Za-z0-9_.-]+', '_', 'g'), '^[._]+|[._]+$', '', 'g'), ''), 'sample') AS name FROM pages
    """,
)
def safe_name(spark, sf_dir):
    """File-safe names of addresses."""
    return read_table(spark, sf_dir, "pages").select("page_id", t.safe_name(F.col("url")).alias("name"))


@query(
    "q16_body_lines",
    """
    SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda x: length(trim(x, ' ' || chr(9) || chr(13))) >= 3)) AS n_lines FROM documents
    """,
)
def body_lines(spark, sf_dir):
    """Meaningful lines of a body."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.select("doc_id", t.body_lines(F.concat(F.lit("{"), F.col("text"))).cast("long").alias("n_lines"))


@query(
    "q17_chunk_overlap",
    """
    WITH n AS (SELECT doc_id, len(string_split(text, chr(10))) AS n FROM documents),
    c AS (SELECT doc_id, n, unnest(generate_series(0, greatest(0, n - 2 - 1), 6)) AS s FROM n)
    SELECT doc_id, s AS chunk_start, least(s + 8, n) AS chunk_end FROM c
    """,
)
def chunk_overlap(spark, sf_dir):
    """Chunks of eight lines that overlap by two."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", F.size(F.split("text", "\n")).alias("n"))
    rows = docs.select("doc_id", F.inline(s.chunk_bounds(F.col("n"), 8, 2)))
    return rows.select("doc_id", F.col("start").cast("long").alias("chunk_start"), F.col("end").cast("long").alias("chunk_end"))
