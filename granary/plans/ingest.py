"""The whole of ingestion over the documents, and files that are written, read and parsed."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.operators import ingest as ing
from granary.operators import store

from . import chunks
from .common import table


def _docs(spark, d):
    t = table(spark, d, "documents")
    return t.select(F.concat(F.lit("job_"), F.col("source")).alias("job_id"), F.col("doc_id").cast("string").alias("doc_id"), F.lit("u").alias("user_id"), F.col("lang").alias("domain_id"), F.col("source").alias("filename"), F.col("text").alias("content"), F.when((F.col("source") == "src3") & (F.col("doc_id") % 2 == 0), "bad file").alias("error"))


def ingest_documents(spark, d):
    got = ing.ingest(_docs(spark, d), F.expr("timestamp_ntz'2026-05-18 10:00:00'"), max_tokens=100, overlap=10)
    return store.dedupe(got.chunks, F.struct(F.col("doc_id").cast("long"), "chunk_index")).select("domain_id", "content_hash", "doc_id", "chunk_index")


def ingest_jobs(spark, d):
    got = ing.ingest(_docs(spark, d), F.expr("timestamp_ntz'2026-05-18 10:00:00'"), max_tokens=100, overlap=10)
    return got.jobs.select("job_id", "state", F.size("completed_steps").alias("n_steps"), "error", "chunks_count")


QUERIES = {f.__name__: f for f in (ingest_documents, ingest_jobs)}
_RAW = chunks._MARKED.replace("""rtrim(CASE WHEN i % 11 = 10 THEN '' WHEN i % 7 = 1 THEN '# ' || raw WHEN i % 7 = 3 THEN '- ' || raw
         WHEN i % 7 = 5 THEN 'Bob: ' || raw WHEN i % 7 = 6 AND lang = 'en' THEN upper(raw) ELSE raw END)""", "rtrim(raw)")
_C = f"""WITH {_RAW}, {chunks._PACK.format(m=100, o=10)}, good AS (SELECT * FROM chunked WHERE NOT (source = 'src3' AND doc_id % 2 = 0)),
each AS (SELECT doc_id, lang, source, unnest(range(0, len(b))) AS chunk_index, unnest(b) AS content FROM (SELECT *, {chunks._PROSE} AS b FROM good))"""
ORACLE = {
    "ingest_documents": f"{_C} SELECT lang AS domain_id, h AS content_hash, arg_max(doc_id, doc_id * 100000 + chunk_index)::VARCHAR AS doc_id, arg_max(chunk_index, doc_id * 100000 + chunk_index) AS chunk_index FROM (SELECT *, md5(lang || ':' || content) AS h FROM each) GROUP BY lang, h",
    "ingest_jobs": f"""{_C}, n AS (SELECT source, count(*) AS c FROM each GROUP BY source)
SELECT 'job_' || d.source AS job_id, CASE WHEN d.bad THEN 'failed' ELSE 'completed' END AS state, CASE WHEN d.bad THEN 0 ELSE 5 END AS n_steps, CASE WHEN d.bad THEN 'bad file' END AS error, coalesce(c, 0) AS chunks_count
FROM (SELECT source, bool_or(source = 'src3' AND doc_id % 2 = 0) AS bad FROM documents GROUP BY source) d LEFT JOIN n USING (source)""",
}
