"""Streaming queries: the tables' files as streams that are processed to their end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.operators.work import work_dir
from granary.streaming import ingest

from . import chunks
from . import ingest as batch


def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    path = f"{sf_dir}/{name}.parquet"
    return ingest.read_files(spark, path + "*" if _is_file(spark, path) else path, spark.read.parquet(path).schema)


def _is_file(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isFile()


def _result(spark, stream, work, mode="append"):
    ingest.run_available(stream, f"{work}/checkpoint", path=f"{work}/out", mode=mode)
    return spark.read.schema(stream.schema).parquet(f"{work}/out")


def stream_ingest(spark, d):
    docs = _stream(spark, d, "documents").withColumn("domain_id", F.col("lang"))
    return _result(spark, ingest.chunk_stream(docs).select("doc_id", "chunk_index", "content_hash"), work_dir(spark, "stream"))


def stream_dedupe(spark, d):
    docs = _stream(spark, d, "documents").select(F.lit("u").alias("user_id"), F.col("lang").alias("domain_id"), F.md5("text").alias("content_hash"), F.lit("2026-01-01").cast("timestamp").alias("at"))
    return _result(spark, ingest.dedupe_stream(docs, "at").select("domain_id", "content_hash"), work_dir(spark, "stream"))


def stream_windows(spark, d):
    events = _stream(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    work = work_dir(spark, "stream")
    ingest.run_available(ingest.windowed_counts(events), f"{work}/checkpoint", each=lambda b, i: b.write.mode("overwrite").parquet(f"{work}/out"), mode="complete")
    return spark.read.schema("start timestamp, event_type string, n long").parquet(f"{work}/out")


QUERIES = {f.__name__: f for f in (stream_ingest, stream_dedupe, stream_windows)}
ORACLE = {
    "stream_ingest": f"""WITH {batch._RAW}, {chunks._PACK.format(m=400, o=40)}, each AS (SELECT doc_id, lang, unnest(range(0, len(cs))) AS chunk_index, unnest(cs) AS content FROM chunked)
SELECT doc_id, chunk_index, md5(lang || ':' || content) AS content_hash FROM each""",
    "stream_windows": "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL",
    "stream_dedupe": "SELECT DISTINCT lang AS domain_id, md5(text) AS content_hash FROM documents",
}
