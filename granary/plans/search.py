"""Queries on the knowledge table: embeddings by label as domains, documents as contents."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.operators import store

from .common import table


def knowledge(spark, d):
    e = table(spark, d, "embeddings")
    return e.select(F.lpad(F.col("vec_id").cast("string"), 8, "0").alias("id"), F.concat(F.lit("u"), (F.col("vec_id") % 3).cast("string")).alias("user_id"), F.concat(F.lit("d"), F.col("label").cast("string")).alias("domain_id"), F.lit("f.txt").alias("filename"), F.concat(F.lit("content of "), F.col("vec_id").cast("string")).alias("content"), "embedding")


def _query(spark, d):
    return [float(x) for x in table(spark, d, "embeddings").orderBy("vec_id").first()["embedding"]]


def vector_topk(spark, d):
    return store.search(knowledge(spark, d), _query(spark, d), "u0", top_k=10).select("id", F.round("score", 6).alias("score"))


def scoped_search(spark, d):
    k = knowledge(spark, d)
    return store.search(k, _query(spark, d), "u1", "d3", 5, "l2").select("id", F.round("score", 5).alias("score"))


def vector_topk_batch(spark, d):
    k = knowledge(spark, d)
    q = k.where("cast(id as bigint) % 50 = 0").select(F.col("id").alias("query_id"), "user_id", "domain_id", F.col("embedding").alias("vector"))
    return store.search_batch(k, q, 5, "inner").select("query_id", "rank", "id", F.round("score", 5).alias("score"))


def search_json(spark, d):
    hits = store.search(knowledge(spark, d), _query(spark, d), "u0", top_k=3).withColumn("score", F.round("score", 6))
    return store.search_json(hits)


def keyword_search(spark, d):
    docs = table(spark, d, "documents").withColumnRenamed("text", "content")
    return store.keyword_search(docs, F.lit("License")).select("doc_id")


def dedupe_hash(spark, d):
    docs = table(spark, d, "documents").select(F.lit("u").alias("user_id"), F.col("lang").alias("domain_id"), F.col("text").alias("content"), "doc_id")
    once = store.dedupe(docs.withColumn("content_hash", store.content_hash(F.col("domain_id"), F.col("content"))), F.col("doc_id"))
    return once.select("domain_id", "content_hash", "doc_id")


def meta_merge(spark, d):
    o = table(spark, d, "orders")
    caller = F.create_map(F.lit("user_id"), F.lit("u1"), F.lit("filename"), F.lit("x"), F.lit("k"), F.lit("caller"))
    reader = F.when(F.col("o_orderkey") % 2 == 0, F.create_map(F.lit("filename"), F.lit("y"), F.lit("k"), F.lit("reader"))).otherwise(F.create_map(F.lit("sheet"), F.lit("S")))
    m = store.merge_metadata(caller, reader)
    return o.select("o_orderkey", F.array_join(F.array_sort(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ",").alias("meta"))


def store_upsert(spark, d):
    old = table(spark, d, "orders").where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("id"), F.lit("old").alias("content"), F.lit(0).alias("seq"))
    new = table(spark, d, "orders").where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("id"), F.explode(F.array(F.lit(1), F.lit(2))).alias("seq")).withColumn("content", F.concat(F.lit("new"), F.col("seq").cast("string")))
    return store.upsert(old, new.select("id", "content", "seq"))


def store_delete(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.col("lang").alias("domain_id"), F.col("source").alias("filename"))
    return store.delete(docs, domain_id="en", filename="src1")


QUERIES = {f.__name__: f for f in (vector_topk, scoped_search, vector_topk_batch, search_json, keyword_search, dedupe_hash, meta_merge, store_upsert, store_delete)}
_K = "k AS (SELECT lpad(vec_id::VARCHAR, 8, '0') AS id, 'u' || vec_id % 3 AS user_id, 'd' || label AS domain_id, embedding::DOUBLE[] AS e, vec_id FROM embeddings), q AS (SELECT e AS v FROM k ORDER BY vec_id LIMIT 1)"
ORACLE = {
    "vector_topk": f"WITH {_K} SELECT id, round(s, 6) AS score FROM (SELECT id, list_cosine_similarity(e, v) AS s FROM k, q WHERE user_id = 'u0') ORDER BY s DESC, id LIMIT 10",
    "scoped_search": f"WITH {_K} SELECT id, round(-s, 5) AS score FROM (SELECT id, list_distance(e, v) AS s FROM k, q WHERE user_id = 'u1' AND domain_id = 'd3') ORDER BY s, id LIMIT 5",
    "vector_topk_batch": f"WITH {_K} SELECT query_id, rank::INTEGER AS rank, id, round(s, 5) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS rank FROM (SELECT a.id AS query_id, b.id, list_inner_product(b.e, a.e) AS s FROM k a JOIN k b USING (user_id, domain_id) WHERE a.vec_id % 50 = 0)) WHERE rank <= 5",
    "search_json": f"WITH {_K} SELECT to_json({{'chunks': list({{'id': id, 'domain_id': domain_id, 'excerpt': 'content of ' || vec_id, 'score': round(s, 6), 'filename': 'f.txt'}} ORDER BY s DESC, id)}})::VARCHAR AS json FROM (SELECT *, list_cosine_similarity(e, v) AS s FROM k, q WHERE user_id = 'u0' ORDER BY s DESC, id LIMIT 3)",
    "keyword_search": "SELECT doc_id FROM documents WHERE contains(lower(text), 'license')",
    "dedupe_hash": "SELECT lang AS domain_id, md5(lang || ':' || text) AS content_hash, max(doc_id) AS doc_id FROM documents GROUP BY ALL",
    "meta_merge": "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'filename=x,k=reader,user_id=u1' ELSE 'filename=x,k=caller,sheet=S,user_id=u1' END AS meta FROM orders",
    "store_upsert": "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'new2' ELSE 'old' END AS content, CASE WHEN o_orderkey % 3 = 0 THEN 2 ELSE 0 END AS seq FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 = 0",
    "store_delete": "SELECT doc_id, lang AS domain_id, source AS filename FROM documents WHERE NOT (lang = 'en' AND source = 'src1')",
}
