"""Streams: files that arrive are chunked and upserted; repeated contents go once; windows of events with late data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.operators import chunking, store


def read_files(spark: SparkSession, folder: str, schema, fmt: str = "parquet", per_trigger: int = 16) -> DataFrame:
    """A stream of the files that stand in a folder and come to it; a glob selects among them."""
    return spark.readStream.schema(schema).format(fmt).option("maxFilesPerTrigger", per_trigger).load(folder)


def chunk_stream(docs: DataFrame, text: str = "text", key: str = "doc_id", domain: str = "domain_id") -> DataFrame:
    """Chunks with their hashes: stateless, so it runs in any output mode."""
    out = docs.select("*", F.posexplode(chunking.structured_chunks(F.col(text))).alias("chunk_index", "content"))
    return out.withColumn("content_hash", store.content_hash(F.col(domain), F.col("content"))).withColumn("id", F.concat_ws("_", F.col(key).cast("string"), F.col("chunk_index").cast("string")))


def dedupe_stream(chunks: DataFrame, at: str, delay: str = "1 hour", keys: tuple[str, ...] = ("user_id", "domain_id", "content_hash")) -> DataFrame:
    """The first row of each key within the watermark's delay; older state is dropped."""
    return chunks.withWatermark(at, delay).dropDuplicatesWithinWatermark(list(keys))


def windowed_counts(events: DataFrame, at: str = "ts", kind: str = "event_type", width: str = "1 hour", delay: str = "2 hours") -> DataFrame:
    w = F.window(F.col(at), width)
    out = events.withWatermark(at, delay).groupBy(w, kind).agg(F.count("*").alias("n"))
    return out.select(F.col("window")["start"].alias("start"), kind, "n")


def upsert_to(target: store.KnowledgeStore):
    """For foreachBatch: a batch is written once, whether or not it is tried again, as its ids don't change."""

    def write(batch: DataFrame, epoch: int) -> None:
        if not batch.isEmpty():
            target.upsert(batch.withColumn("seq", F.lit(epoch).cast("long")))

    return write


def run_available(stream: DataFrame, checkpoint: str, path: str | None = None, each=None, mode: str = "append"):
    """Process what there is and stop: into Parquet files at path, or by a function of each batch."""
    w = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    q = (w.foreachBatch(each) if each else w.format("parquet").option("path", path)).start()
    q.awaitTermination()
    return q
