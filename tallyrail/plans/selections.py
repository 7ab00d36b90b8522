"""Selection queries: exact semi-joins, resume, matrices, completeness, samples and limits."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyrail.operators import selection as sel
from tallyrail.plans.catalog import query
from tallyrail.session import read_table


@query(
    "q05_exact_selection",
    """
    WITH m AS (SELECT doc_id, source, CASE WHEN doc_id % 35 = 0 THEN 'other' ELSE lang END AS lang FROM documents WHERE substr(sha256(doc_id::VARCHAR), 1, 1) IN ('0', '1', '2')
               UNION ALL SELECT -1, 'none', 'none')
    SELECT m.doc_id, m.source, m.lang, array_to_string(CASE WHEN d.doc_id IS NULL THEN ['missing'] ELSE list_filter([CASE WHEN m.source IS DISTINCT FROM d.source THEN 'source' END,
           CASE WHEN m.lang IS DISTINCT FROM d.lang THEN 'lang' END], lambda x: x IS NOT NULL) END, ',') AS mismatched
    FROM m LEFT JOIN documents d ON m.doc_id = d.doc_id
    """,
)
def exact_selection(spark, sf_dir):
    """A manifest against the samples: which rows are missing or differ, and where."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    chosen = docs.where(F.substring(F.sha2(F.col("doc_id").cast("string"), 256), 1, 1).isin("0", "1", "2"))
    manifest = chosen.withColumn("lang", F.when(F.col("doc_id") % 35 == 0, "other").otherwise(F.col("lang")))
    manifest = manifest.union(spark.createDataFrame([(-1, "none", "none")], manifest.schema))
    out = sel.select_exact(docs, manifest, ["doc_id"], ["source", "lang"])
    return out.withColumn("mismatched", F.array_join("mismatched", ","))


@query("q06_resume_antijoin", "SELECT doc_id, source FROM documents ANTI JOIN labels USING (doc_id)")
def resume(spark, sf_dir):
    """Samples that have no result yet."""
    return sel.pending(read_table(spark, sf_dir, "documents").select("doc_id", "source"), read_table(spark, sf_dir, "labels"), ["doc_id"])


@query(
    "q07_matrix",
    """
    SELECT s.source, b.event_type FROM (SELECT DISTINCT source FROM documents) s CROSS JOIN (SELECT DISTINCT event_type FROM events) b
    WHERE NOT EXISTS (SELECT 1 FROM events e WHERE 'src' || (e.user_id % 20) = s.source AND e.event_type = b.event_type AND e.value > 250)
    """,
)
def matrix(spark, sf_dir):
    """Every dataset with every backend, less the pairs that are done."""
    events = read_table(spark, sf_dir, "events").select("user_id", "event_type", "value")
    pairs = sel.matrix(read_table(spark, sf_dir, "documents").select("source").distinct(), events.select("event_type").distinct())
    done = events.where("value > 250").select(F.concat(F.lit("src"), (F.col("user_id") % 20).cast("string")).alias("source"), "event_type")
    return sel.pending(pairs, done, ["source", "event_type"])


@query(
    "q08_subset_complete",
    """
    WITH r AS (SELECT doc_id, source, lang AS backend FROM documents WHERE doc_id % 3 > 0), s AS (SELECT doc_id, source FROM documents WHERE doc_id % 7 = 0),
    e AS (SELECT s.source, s.doc_id, b.backend FROM s JOIN (SELECT DISTINCT source, backend FROM r) b USING (source))
    SELECT source, count(*) AS missing FROM (SELECT source, doc_id, backend FROM e EXCEPT SELECT source, doc_id, backend FROM r) GROUP BY source
    """,
)
def subset_complete(spark, sf_dir):
    """Results that a selection needs and a run does not have, by dataset."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    results = docs.where("doc_id % 3 > 0").withColumnRenamed("lang", "backend")
    missing = sel.missing_pairs(results, docs.where("doc_id % 7 = 0"), "source", "doc_id", "backend")
    return missing.groupBy("source").agg(F.count("*").alias("missing"))


@query(
    "q09_stratified_round_robin",
    """
    WITH t AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256('42' || chr(0) || doc_id), doc_id) AS turn FROM documents)
    SELECT doc_id, lang, turn FROM t ORDER BY turn, lang LIMIT 25
    """,
)
def stratified(spark, sf_dir):
    """A sample of 25 that takes turns between strata, in each by a seeded hash."""
    return sel.round_robin(read_table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id", ["lang"], 25, 42)


@query(
    "q10_ordered_limit",
    "SELECT lang, doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS n FROM documents WHERE source <> 'src0') WHERE n <= 5",
)
def ordered_limit(spark, sf_dir):
    """The first rows in scan order after the filter, by language."""
    docs = read_table(spark, sf_dir, "documents").select("lang", "doc_id", "source").where("source <> 'src0'")
    return sel.first_rows(docs, 5, [F.col("doc_id")], ["lang"])


@query(
    "q11_complete_groups",
    """
    WITH g AS (SELECT l_partkey, l_returnflag FROM lineitem),
    c AS (SELECT l_partkey, count(*) AS n_rows, list_sort(list(DISTINCT l_returnflag)) AS members FROM g GROUP BY 1)
    SELECT l_partkey, n_rows, array_to_string(members, ',') AS members,
      array_to_string(list_filter([CASE WHEN len(members) < 3 THEN 'missing_level' END, CASE WHEN n_rows > len(members) THEN 'duplicate_level' END], lambda x: x IS NOT NULL), ',') AS reasons FROM c
    """,
)
def complete_groups(spark, sf_dir):
    """Groups with the levels they have, and why one is left out."""
    out = sel.complete_groups(read_table(spark, sf_dir, "lineitem").select("l_partkey", "l_returnflag"), "l_partkey", "l_returnflag", ["A", "N", "R"])
    return out.select("l_partkey", "n_rows", F.array_join("members", ",").alias("members"), F.array_join("reasons", ",").alias("reasons"))
