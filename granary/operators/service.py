"""Ingestion and tracing with their state in tables: what an application calls."""

from __future__ import annotations

import uuid
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.sources import files as sources
from granary.sources.blobs import BlobStore

from . import ingest as ing
from . import jobs, retrieval, store, structured, work

JOBS = "job_id string, state string, completed_steps array<string>, error string, chunks_count long, seq long"
TRACES = {
    "runs": "run_id string, user_id string, input string, output string, seq long",
    "tools": "run_id string, name string, args string, result string, seq long",
    "retrievals": "run_id string, query string, n_chunks long, chunks array<string>, seq long",
    "answers": "run_id string, answer string, seq long",
}


def now() -> int:
    return int(datetime.now(timezone.utc).timestamp() * 1_000_000)


class Log:
    """An append-only table in a folder of Parquet files."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path, schema

    def append(self, rows: DataFrame) -> None:
        rows.select(*[f.name for f in self.spark.createDataFrame([], self.schema).schema]).write.mode("append").parquet(self.path)

    def read(self) -> DataFrame:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p):
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(self.path)


class Pipeline:
    """read, ground, chunk, embed and upsert for batches of documents or files; jobs are rows of a log.

    A batch is one plan, worked out once: its chunks are written on the way, the store and the job log read them. A job
    that fails leaves nothing half stored, and a batch that is tried again writes the same ids. readers: loaders for
    what only injected functions can read, by kind (pdf, audio, image)."""

    def __init__(self, spark: SparkSession, folder: str, embed=ing.hashed_vector, max_tokens: int = 400, overlap: int = 40, readers: dict | None = None):
        self.spark, self.embed, self.max_tokens, self.overlap, self.readers = spark, embed, max_tokens, overlap, readers or {}
        self.store = store.KnowledgeStore(spark, f"{folder}/knowledge")
        self.log = Log(spark, f"{folder}/jobs", JOBS)
        self.blobs = BlobStore(spark, f"{folder}/files")
        self.files = Files(spark, f"{folder}/registry", self.store, self.blobs)

    def submit(self, docs: DataFrame, ref: Column, mode: str = "auto") -> None:
        """docs as ingest() takes them, of one job or of many."""
        seq, work_at = F.lit(now()), []

        def save(df: DataFrame) -> DataFrame:
            work_at.append(work.work_dir(self.spark, "chunks"))
            return work.written(df, work_at[-1])

        self.log.append(docs.select("job_id").distinct().select("job_id", F.lit("processing").alias("state"), F.array(F.lit("read")).alias("completed_steps"), F.lit(None).cast("string").alias("error"), F.lit(0).cast("long").alias("chunks_count"), seq.alias("seq")))
        try:
            got = ing.ingest(docs, ref, mode, self.embed, self.max_tokens, self.overlap, save)
            meta = F.create_map(F.lit("job_id"), F.col("job_id"), F.lit("event_at"), F.date_format("event_at", "yyyy-MM-dd"))
            done = got.jobs.where("state = 'completed'").select("job_id")
            self.store.upsert(got.chunks.join(done, "job_id", "left_semi").select("id", "user_id", "domain_id", "filename", "content", "embedding", meta.alias("metadata"), seq.alias("seq")), staged=True)
            self.log.append(got.jobs.withColumn("seq", F.lit(now())))
        except Exception as e:
            self.fail(docs.select("job_id").distinct(), str(e))
            raise
        finally:
            for path in work_at:
                work.remove(self.spark, path)

    def fail(self, jobs_: DataFrame, error: str) -> None:
        self.log.append(jobs_.select("job_id", F.lit("failed").alias("state"), F.array().cast("array<string>").alias("completed_steps"), F.lit(error[:500]).alias("error"), F.lit(0).cast("long").alias("chunks_count"), F.lit(now()).alias("seq")))

    def submit_file(self, raw: bytes | str, filename: str, user_id: str, domain_id: str = "", ref: Column | None = None, mode: str = "auto") -> str:
        """Keeps a file, reads it by its extension, ingests it and returns the job's id; what went wrong is in its
        status. The registry has a row for each file whose job completed."""
        job = f"job_{uuid.uuid4().hex[:8]}"
        mine = self.spark.createDataFrame([(job,)], "job_id string")
        try:
            key = self.blobs.save(user_id, job, filename, raw.encode() if isinstance(raw, str) else raw)
            found = sources.documents(sources.binary_files(self.spark, self.blobs.resolve(key)), self.readers)
            docs = found.withColumns({"job_id": F.lit(job), "user_id": F.lit(user_id), "domain_id": F.lit(domain_id), "filename": F.lit(filename)})
            self.submit(docs, ref if ref is not None else F.current_timestamp().cast("timestamp_ntz"), mode)
            status = self.status(job)
            if status["state"] == "completed":
                self.files.add(job, user_id, domain_id, filename, sources.kind_of(filename), key, status["chunks_count"])
        except Exception as e:  # noqa: BLE001
            if not self.jobs().where((F.col("job_id") == job) & (F.col("state") == "failed")).limit(1).count():
                self.fail(mine, str(e))
        return job

    def jobs(self) -> DataFrame:
        return jobs.latest(self.log.read(), "job_id", "seq")

    def status(self, job_id: str) -> dict:
        row = self.jobs().where(F.col("job_id") == job_id).first()
        if row is None:
            raise KeyError(job_id)
        return row.asDict()


FILES = "file_id string, user_id string, domain_id string, filename string, source_type string, blob string, chunks_count long, tables array<string>, status string, seq long"


class Files:
    """The registry of files as a log, of which the newest row counts. Deleting a file takes its chunks, tables and
    bytes with it."""

    def __init__(self, spark: SparkSession, path: str, knowledge: store.KnowledgeStore, blobs: BlobStore):
        self.spark, self.knowledge, self.blobs = spark, knowledge, blobs
        self.log = Log(spark, path, FILES)

    def add(self, file_id: str, user_id: str, domain_id: str, filename: str, source_type: str, blob: str | None, chunks_count: int = 0, tables: list[str] | None = None) -> None:
        self.log.append(self.spark.createDataFrame([(file_id, user_id, domain_id, filename, source_type, blob, chunks_count, tables or [], "completed", now())], FILES))

    def update(self, file_id: str, **values) -> None:
        """A new row with other values; KeyError for an unknown file."""
        row = self.list().where(F.col("file_id") == file_id).first()
        if row is None:
            raise KeyError(file_id)
        self.log.append(self.spark.createDataFrame([tuple((row.asDict() | values | {"seq": now()}).values())], FILES))

    def list(self, source_types: str = "") -> DataFrame:
        newest = jobs.latest(self.log.read(), "file_id", "seq").where("status <> 'deleted'")
        return retrieval.of_source_types(newest, source_types)

    def delete(self, file_id: str) -> None:
        row = self.list().where(F.col("file_id") == file_id).first()
        if row is None:
            raise KeyError(file_id)
        self.knowledge.delete(user_id=row.user_id, domain_id=row.domain_id, filename=row.filename)
        for name in row.tables or []:
            structured.drop_table(self.spark, name)
        if row.blob:
            self.blobs.delete(row.blob)
        self.update(file_id, status="deleted")


class Tracker:
    """An application's jobs step by step, with steps of its own after the pipeline's: an event log that is folded."""

    EVENTS = "job_id string, step string, state string, error string, seq long"

    def __init__(self, spark: SparkSession, path: str, steps: tuple[str, ...] = (*jobs.STEPS, "annotate")):
        self.spark, self.steps, self.log = spark, steps, Log(spark, path, self.EVENTS)

    def _add(self, job: str, step: str | None, state: str, error: str | None = None) -> None:
        self.log.append(self.spark.createDataFrame([(job, step, state, error, now())], self.EVENTS))

    def new(self) -> str:
        job = f"job_{uuid.uuid4().hex[:8]}"
        self._add(job, None, "pending")
        return job

    def set_step(self, job: str, step: str) -> None:
        if step not in self.steps:
            raise ValueError(f"no step {step}")
        self._add(job, step, "processing")

    def finish(self, job: str, error: str | None = None) -> None:
        self._add(job, None, "failed" if error else "completed", error)

    def get(self, job: str) -> dict:
        row = jobs.fold_jobs(self.log.read().where(F.col("job_id") == job)).first()
        if row is None:
            raise KeyError(job)
        return row.asDict()


class Tracer:
    """Runs and what belongs to them, as four logs; a run's output is a second row of it. Calls for a run that isn't
    known are kept, and show in no run. Rows wait until there are `most` of them, a run completes or runs are read."""

    def __init__(self, spark: SparkSession, folder: str, most: int = 500):
        self.spark, self.most = spark, most
        self.logs = {name: Log(spark, f"{folder}/{name}", schema) for name, schema in TRACES.items()}
        self.waiting: dict[str, list[tuple]] = {name: [] for name in TRACES}

    def _add(self, log: str, *values) -> None:
        self.waiting[log].append((*values, now()))
        if sum(map(len, self.waiting.values())) >= self.most:
            self.flush()

    def flush(self) -> None:
        for name, rows in self.waiting.items():
            if rows:
                self.logs[name].append(self.spark.createDataFrame(rows, TRACES[name]).coalesce(1))
                rows.clear()

    def start_run(self, user_id: str, text: str) -> str:
        run_id = uuid.uuid4().hex
        self._add("runs", run_id, user_id, text, None)
        return run_id

    def log_tool_call(self, run_id: str, name: str, args: str, result: str) -> None:
        self._add("tools", run_id, name, args, result)

    def log_retrieval(self, run_id: str, query: str, chunks: list[str]) -> None:
        self._add("retrievals", run_id, query, len(chunks), chunks)

    def log_answer(self, run_id: str, answer: str) -> None:
        self._add("answers", run_id, answer)

    def complete_run(self, run_id: str, output: str) -> None:
        self._add("runs", run_id, None, None, output)
        self.flush()

    def _folded(self) -> DataFrame:
        self.flush()
        first = lambda c: F.first(c, ignorenulls=True).alias(c)
        return self.logs["runs"].read().groupBy("run_id").agg(first("user_id"), first("input"), first("output"), F.min("seq").alias("seq")).where("user_id is not null")

    def runs(self) -> DataFrame:
        return jobs.trace_runs(self._folded().drop("seq"), *(self.logs[x].read() for x in ("tools", "retrievals", "answers")))

    def spans(self) -> DataFrame:
        return jobs.trace_spans(self._folded(), *(self.logs[x].read() for x in ("tools", "retrievals", "answers")))
