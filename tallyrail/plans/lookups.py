"""Lookup queries: nearest neighbours, keys, caches, range joins and private fields."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyrail.functions import keys as k
from tallyrail.functions import numbers as n
from tallyrail.operators import cache, joins, retrieval
from tallyrail.plans.catalog import query
from tallyrail.session import read_table


def vectors(spark, sf_dir):
    return read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


@query(
    "q31_nearest_l2",
    """
    WITH q AS (SELECT * FROM embeddings WHERE vec_id % 50 = 0),
    d AS (SELECT q.vec_id AS query, b.vec_id AS neighbour, round(list_sum(list_transform(list_zip(q.embedding, b.embedding), lambda x: (x[1]::DOUBLE - x[2]::DOUBLE) * (x[1]::DOUBLE - x[2]::DOUBLE))), 6) AS distance
          FROM q JOIN embeddings b ON q.vec_id <> b.vec_id)
    SELECT query, neighbour, distance FROM d QUALIFY row_number() OVER (PARTITION BY query ORDER BY distance, neighbour) = 1
    """,
)
def nearest_l2(spark, sf_dir):
    """The nearest other vector of each stated query, by squared Euclidean distance."""
    v = vectors(spark, sf_dir)
    return retrieval.nearest(v, v.where("id % 50 = 0"), "l2", 1, 6, itself=False).drop("rank")


@query(
    "q32_nearest_cosine",
    """
    WITH q AS (SELECT * FROM embeddings WHERE vec_id % 50 = 0),
    d AS (SELECT q.vec_id AS query, b.vec_id AS neighbour, list_sum(list_transform(list_zip(q.embedding, b.embedding), lambda x: x[1]::DOUBLE * x[2]::DOUBLE)) AS ab,
            sqrt(list_sum(list_transform(q.embedding, lambda x: x::DOUBLE * x::DOUBLE)) * list_sum(list_transform(b.embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS nn
          FROM q JOIN embeddings b ON q.vec_id <> b.vec_id),
    c AS (SELECT query, neighbour, round(CASE WHEN nn = 0 THEN 1.0 ELSE 1 - ab / nn END, 6) AS distance FROM d)
    SELECT query, neighbour, distance, row_number() OVER (PARTITION BY query ORDER BY distance, neighbour)::INTEGER AS "rank" FROM c QUALIFY "rank" <= 3
    """,
)
def nearest_cosine(spark, sf_dir):
    """The three nearest other vectors of each stated query, by cosine distance."""
    v = vectors(spark, sf_dir)
    return retrieval.nearest(v, v.where("id % 50 = 0"), "cosine", 3, 6, itself=False)


@query(
    "q33_keys",
    """
    WITH g AS (SELECT doc_id, sha256('generation' || chr(10) || lang || ':' || source || chr(10) || 'b1') AS g FROM documents),
    c AS (SELECT *, sha256('candidate' || chr(10) || g || chr(10) || 'p1') AS c FROM g)
    SELECT doc_id, g AS generation_key, c AS candidate_key, sha256('evaluation' || chr(10) || c || chr(10) || '') AS evaluation_key FROM c
    """,
)
def layered_keys(spark, sf_dir):
    """Chained content keys of three layers."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    key = k.layered_keys(F.concat_ws(":", "lang", "source"), F.lit("b1"), F.lit("p1"), F.lit(None).cast("string"))
    return docs.select("doc_id", key["generation"].alias("generation_key"), key["candidate"].alias("candidate_key"), key["evaluation"].alias("evaluation_key"))


@query(
    "q34_cache_lookup",
    """
    SELECT CASE WHEN l.doc_id IS NULL THEN 'new' WHEN l.quality IS NOT DISTINCT FROM CASE WHEN d.doc_id % 4 = 0 THEN 0 ELSE 1 END THEN 'same' ELSE 'conflict' END AS state, count(*) AS n
    FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1
    """,
)
def cache_lookup(spark, sf_dir):
    """New, same and conflicting rows of a write-once cache."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 4 == 0, 0).otherwise(1).alias("quality"))
    return cache.classify(docs, read_table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id").groupBy("state").agg(F.count("*").alias("n"))


@query(
    "q35_range_join",
    """
    SELECT o_orderkey, l_linenumber, date_diff('day', o_orderdate, l_shipdate) AS days FROM orders JOIN lineitem
    ON o_orderkey = l_orderkey AND l_shipdate >= o_orderdate AND l_shipdate < o_orderdate + INTERVAL 30 DAY
    """,
)
def range_join(spark, sf_dir):
    """Line items shipped within 30 days of their order: equality on the key, a half-open range on the date."""
    o = read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderdate").alias("start"), (F.col("o_orderdate") + F.expr("INTERVAL 30 DAYS")).alias("end"))
    li = read_table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key"), "l_linenumber", F.col("l_shipdate").alias("at"))
    out = joins.in_range(li, o, ["key"], "at", "start", "end")
    return out.select(F.col("key").alias("o_orderkey"), "l_linenumber", F.date_diff("at", "start").cast("long").alias("days"))


@query(
    "q36_privacy_scan",
    """
    WITH e AS (SELECT unnest(json_keys(props)) AS name FROM events WHERE props IS NOT NULL
               UNION ALL SELECT unnest(['expectedOutput', 'io_pairs', 'kind', 'Reference-Source', 'apiKey']) FROM events WHERE event_id < 10)
    SELECT name, regexp_replace(lower(regexp_replace(name, '([a-z0-9])([A-Z])', '\\1_\\2', 'g')), '[^a-z0-9]+', '_', 'g') AS normal,
      normal IN ('io_pairs', 'expected_output', 'reference_source') OR regexp_matches(normal, '^(reference|ground_truth|expected|oracle|test)_') AS private,
      regexp_matches(name, '(?i)api[_-]?key|token|password|secret') AS masked, count(*) AS n FROM e GROUP BY ALL
    """,
)
def privacy_scan(spark, sf_dir):
    """Field names in open payloads, with those that are private or masked."""
    events = read_table(spark, sf_dir, "events")
    names = events.where("props IS NOT NULL").select(F.explode(F.json_object_keys("props")).alias("name"))
    more = events.where("event_id < 10").select(F.explode(F.array(*(F.lit(x) for x in ("expectedOutput", "io_pairs", "kind", "Reference-Source", "apiKey")))).alias("name"))
    c = F.col("name")
    return names.union(more).groupBy("name").agg(F.count("*").alias("n")).select("name", k.normal_key(c).alias("normal"), k.is_private(c).alias("private"), c.rlike(k.SECRET).alias("masked"), "n")


@query(
    "q37_seeds",
    """
    SELECT doc_id, ('0x' || substr(sha256(doc_id || ':seed'), 1, 8))::BIGINT & 2147483647 AS seed31 FROM documents
    """,
)
def seeds(spark, sf_dir):
    """Derived seeds of 31 bits."""
    return read_table(spark, sf_dir, "documents").select("doc_id", n.seed31(F.concat(F.col("doc_id").cast("string"), F.lit(":seed"))).alias("seed31"))
