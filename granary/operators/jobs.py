"""Jobs, files, memories and traces as append-only logs, and the views that the newest rows make."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions import text as tx

#: Steps and states of a job, extensions by reader, labels and icons of sources.
STEPS = ["read", "ground", "chunk", "embed", "upsert"]
STATES = ["pending", "processing", "completed", "failed"]
READERS = {
    ".xlsx": "spreadsheet", ".xls": "spreadsheet", ".xlsm": "spreadsheet", ".csv": "spreadsheet", ".tsv": "spreadsheet",
    ".txt": "text", ".md": "text", ".pdf": "pdf",
    ".mp3": "audio", ".m4a": "audio", ".wav": "audio", ".ogg": "audio", ".flac": "audio", ".webm": "audio",
    ".jpg": "image", ".jpeg": "image", ".png": "image", ".gif": "image", ".webp": "image", ".heic": "image", ".heif": "image",
}
STRUCTURED = [".csv", ".tsv", ".xlsx", ".xls"]
ROUTED_IMAGES = [".jpg", ".jpeg", ".png", ".webp", ".gif"]
LABELS = {
    ".xlsx": "Excel", ".xls": "Excel", ".xlsm": "Excel", ".csv": "CSV", ".tsv": "TSV", ".mp3": "Audio", ".m4a": "Audio", ".wav": "Audio", ".ogg": "Audio", ".flac": "Audio",
    ".jpg": "Image", ".jpeg": "Image", ".png": "Image", ".webp": "Image", ".pdf": "PDF", ".txt": "Text", ".md": "Markdown",
}
ICONS = {"spreadsheet": "📊", "image": "🖼️", "audio": "🎵", "structured": "🗄️", "text": "📄"}


def lookup(values: dict, key: Column, default: str | None) -> Column:
    found = F.try_element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key)
    return found if default is None else F.coalesce(found, F.lit(default))


def reader_of(filename: Column) -> Column:
    """The reader for a file's extension; null for an unknown one, whose job fails."""
    return lookup(READERS, tx.suffix(filename), None)


def is_spreadsheet(filename: Column) -> Column:
    return tx.suffix(filename).isin([e for e, r in READERS.items() if r == "spreadsheet"])


def route(filename: Column, mode: Column) -> Column:
    """image, structured or document; null where the mode is unknown or doesn't take the file."""
    ext = tx.suffix(filename)
    return F.when(ext.isin(ROUTED_IMAGES), "image").when((mode == "structured") & ext.isin(STRUCTURED), "structured").when(mode == "semantic", "document")


def file_label(filename: Column) -> Column:
    return lookup(LABELS, tx.suffix(filename), "Document")


def icon(source: Column) -> Column:
    return lookup(ICONS, source, "📄")


def latest(log: DataFrame, key: str, order: str) -> DataFrame:
    """Each key's newest row; a row without change keeps its place in the log only."""
    return log.groupBy(key).agg(F.max_by(F.struct(*log.columns), order).alias("__r")).select("__r.*")


def fold_jobs(events: DataFrame, order: str = "seq") -> DataFrame:
    """Events (job_id, step, state, error, seq) folded into jobs: state, current_step (none once it ended), the
    completed steps in order, error. A failed job keeps what it had completed. The first step begins a new attempt, of
    which the last counts; a step that begins again counts once. A job's log is never in one place: its newest rows
    are, one for each step."""
    row = F.struct(order, "step", "state", "error")
    began = F.col("step").isNotNull() & (F.col("state") == "processing")
    each = events.groupBy("job_id", "step").agg(F.max_by(row, order).alias("last"), F.max(F.when(began, F.col(order))).alias("began"))
    first = F.max(F.when(F.col("step") == STEPS[0], F.col("began")))
    steps = F.array_sort(F.collect_list(F.when(F.col("began").isNotNull(), F.struct("began", "step"))))
    j = each.groupBy("job_id").agg(F.max_by("last", F.col("last")[order]).alias("last"), first.alias("first"), steps.alias("steps"))
    last = F.col("last")
    began = F.transform(F.filter("steps", lambda x: F.col("first").isNull() | (x["began"] >= F.col("first"))), lambda x: x["step"])
    done = F.when(last["state"] == "completed", began).otherwise(F.slice(began, 1, F.greatest(F.size(began) - 1, F.lit(0))))
    current = F.when(last["state"] == "processing", F.element_at(began, -1))
    return j.select("job_id", last["state"].alias("state"), current.alias("current_step"), done.alias("completed_steps"), last["error"].alias("error"))


def without(files: DataFrame, gone: DataFrame, key: str = "file_id") -> DataFrame:
    """Rows of files (their own, their tables', their chunks') less those of files that are gone."""
    return files.join(gone.select(key).distinct(), key, "left_anti")


def step_status(step: Column, completed: Column, current: Column, state: Column) -> Column:
    """done, active, failed or pending; a failed job without a current step failed at the one after its last."""
    names = F.array(*[F.lit(s) for s in STEPS])
    at = F.array_position(names, F.element_at(completed, -1))
    failed_at = F.when(F.size(completed) > 0, at).otherwise(F.lit(0).cast("long")) + 1
    return (
        F.when(F.array_contains(completed, step), "done")
        .when(current == step, F.when(state == "failed", "failed").otherwise("active"))
        .when((state == "failed") & (F.array_position(names, step) == failed_at), "failed")
        .otherwise("pending")
    )


def orphans(files: DataFrame, jobs: DataFrame) -> DataFrame:
    """Files whose job failed while it read: their rows and blobs can go."""
    return files.join(jobs.where((F.col("state") == "failed") & (F.size("completed_steps") == 0)).select("job_id"), "job_id", "left_semi")


def source_ref(kind: Column, ident: Column, text: Column) -> Column:
    """A typed citation: what it cites and at most 300 characters of it."""
    ok = kind.isin("episodic", "knowledge", "data", "web")
    return F.when(ok, F.struct(kind.alias("source_type"), ident.alias("id"), F.substring(text, 1, 300).alias("excerpt")))


def trace_runs(runs: DataFrame, tools: DataFrame, retrievals: DataFrame, answers: DataFrame) -> DataFrame:
    """Runs with the counts of their children; children of unknown runs are left out."""
    t = tools.groupBy("run_id").agg(F.count("*").alias("n_tools"))
    r = retrievals.groupBy("run_id").agg(F.count("*").alias("n_retrievals"), F.sum("n_chunks").alias("n_chunks"))
    a = answers.groupBy("run_id").agg(F.max("answer").alias("answer"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return runs.join(t, "run_id", "left").join(r, "run_id", "left").join(a, "run_id", "left").select(*runs.columns, *[zero(c) for c in ("n_tools", "n_retrievals", "n_chunks")], "answer")


def trace_spans(runs: DataFrame, tools: DataFrame, retrievals: DataFrame, answers: DataFrame) -> DataFrame:
    """trace_id, span_id, parent_id, kind, name, input, output, seq: a root span for each run and a child for each call
    in it, under ids that sending again doesn't change. Calls of unknown runs are dropped."""
    ident = lambda *c: F.substring(F.sha2(F.concat_ws("/", *c), 256), 1, 16)
    text = lambda c: F.col(c).cast("string")
    root = ident(F.lit("run"), text("run_id"))
    out = runs.select(text("run_id").alias("trace_id"), root.alias("span_id"), F.lit(None).cast("string").alias("parent_id"), F.lit("run").alias("kind"), F.lit("run").alias("name"), "input", "output", "seq")
    for kind, calls, name, given, got in (("tool", tools, "name", "args", "result"), ("retriever", retrievals, None, "query", None), ("generation", answers, None, None, "answer")):
        known = calls.join(runs.select("run_id"), "run_id", "left_semi")
        value = lambda c: F.lit(None).cast("string") if c is None else text(c)
        result = F.to_json("chunks") if kind == "retriever" else value(got)
        span = ident(F.lit(kind), text("run_id"), text("seq"), F.coalesce(value(name), F.lit("")))
        out = out.unionByName(known.select(text("run_id").alias("trace_id"), span.alias("span_id"), root.alias("parent_id"), F.lit(kind).alias("kind"), (F.lit(kind) if name is None else text(name)).alias("name"), value(given).alias("input"), result.alias("output"), "seq"))
    return out


def page_of(df: DataFrame, order: list, page: int, size: int = 20) -> DataFrame:
    return df.orderBy(*order).offset(page * size).limit(size)


def payload(docs: DataFrame) -> DataFrame:
    """job_id, payload: what was read, as it was before dates were resolved; dates as ISO strings."""
    one = F.struct(F.col("doc_id").alias("id"), "source_type", "source_name", "content", "metadata")
    # by id alone, nulls last: maps have no order
    before = lambda a, b: F.when(a["id"] < b["id"], -1).when(a["id"] > b["id"], 1).when(a["id"].isNull() & b["id"].isNotNull(), 1).when(a["id"].isNotNull() & b["id"].isNull(), -1).otherwise(0)
    return docs.groupBy("job_id").agg(F.array_sort(F.collect_list(one), before).alias("payload"))


def preview(docs: DataFrame) -> DataFrame:
    """job_id, n_blocks, blocks: the first 400 characters of each."""
    each = F.array_sort(F.collect_list(F.struct("doc_id", F.substring("content", 1, 400).alias("content"))))
    return docs.groupBy("job_id").agg(F.count("*").alias("n_blocks"), F.transform(each, lambda x: x["content"]).alias("blocks"))
