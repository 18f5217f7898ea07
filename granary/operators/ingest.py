"""Ingestion as one lazy plan: documents, dates, chunks, vectors, and the rows that a store and a job log get."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions import text as tx

from . import chunking, grounding, jobs, store


def hashed_vector(text: Column, size: int = 16) -> Column:
    """A stand-in for a model: counts of words by hash, as a unit vector; nulls for a text without words."""
    w = F.transform(tx.words(F.lower(text)), lambda x: F.pmod(F.xxhash64(x), F.lit(size)))
    counts = tx.bind(w, lambda b: F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.size(F.filter(b, lambda x: x == i)).cast("double")))
    return tx.bind(counts, lambda c: tx.bind(F.sqrt(store.dot(c, c)), lambda norm: F.transform(c, lambda x: (x / F.nullif(norm, F.lit(0.0))).cast("float"))))


@dataclass
class Ingested:
    payload: DataFrame
    documents: DataFrame
    chunks: DataFrame
    jobs: DataFrame


def ingest(docs: DataFrame, ref: Column, mode: str = "auto", embed=hashed_vector, max_tokens: int = chunking.MAX_TOKENS, overlap: int = chunking.OVERLAP, save=lambda df: df) -> Ingested:
    """save: makes a table of files of the chunks, where they are read more than once. docs: job_id, doc_id, user_id, domain_id, filename, content, error, and for tables block_type, headings,
    table_columns, table_rows, table_label. Rows with an error fail their job and go no further."""
    optional = {"block_type": "string", "headings": "array<string>", "table_columns": "array<string>", "table_rows": "array<map<string,string>>", "table_label": "string", "error": "string"}
    docs = docs.withColumns({c: F.lit(None).cast(t) for c, t in optional.items() if c not in docs.columns})
    good = docs.where("error is null")
    grounded = grounding.ground(good.withColumn("__ref", ref), "content", "__ref", mode).withColumn("event_at", F.get("groundings", F.lit(0))["resolved"])
    grounded = grounded.withColumn("content", F.col("grounded")).drop("grounded", "__ref")
    chunks = chunking.chunk_documents(grounded, max_tokens, overlap).select("job_id", "doc_id", "user_id", "domain_id", "filename", "event_at", "chunk_index", F.col("chunk").alias("content"))
    chunks = save(store.with_ids(chunks).withColumn("embedding", embed(F.col("content"))))
    counts = chunks.groupBy("job_id").agg(F.count("*").alias("chunks_count"))
    state = F.when(F.max("error").isNotNull(), "failed").otherwise("completed")
    done = F.when(F.max("error").isNull(), F.array(*[F.lit(s) for s in jobs.STEPS])).otherwise(F.array().cast("array<string>"))
    log = docs.groupBy("job_id").agg(state.alias("state"), done.alias("completed_steps"), F.max("error").alias("error")).join(counts, "job_id", "left").withColumn("chunks_count", F.coalesce("chunks_count", F.lit(0).cast("long")))
    return Ingested(good.select("job_id", "doc_id", "content"), grounded, chunks, log)
