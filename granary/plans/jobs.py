"""Queries on jobs, files and traces: events as a job log, orders and lineitem as runs and their children."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from granary.functions import text as tx
from granary.operators import jobs as jb
from granary.operators import retrieval as rt

from .common import table

_EXT = [*jb.READERS, ".exe", ""]


def _events(spark, d):
    """All events, as attempts of four: three steps and an end. A job's first attempt has what is left over, and breaks
    off. Every third job's attempts end with a sign of life only."""
    e = table(spark, d, "events")
    job = Window.partitionBy("user_id")
    n, over = F.row_number().over(job.orderBy("event_id")), F.count("*").over(job) % 4
    e = e.select(F.col("user_id").alias("job_id"), "event_id", n.alias("n"), over.alias("over"))
    at = F.when(F.col("n") <= F.col("over"), F.col("n")).otherwise((F.col("n") - F.col("over") - 1) % 4 + 1)
    e = e.select("job_id", "event_id", at.cast("int").alias("at"))
    step = F.when(F.col("at") <= 3, F.element_at(F.array(*[F.lit(s) for s in jb.STEPS]), F.col("at")))
    state = F.when((F.col("at") == 4) & (F.col("job_id") % 3 == 0), "failed").when((F.col("at") == 4) & (F.col("job_id") % 3 == 1), "completed").otherwise("processing")
    return e.select("job_id", step.alias("step"), state.alias("state"), F.when(state == "failed", "boom").alias("error"), F.col("event_id").alias("seq"))


def job_latest(spark, d):
    return jb.fold_jobs(_events(spark, d)).select("job_id", "state", "current_step", F.array_join("completed_steps", ",").alias("steps"), "error")


def job_step_status(spark, d):
    j = jb.fold_jobs(_events(spark, d)).withColumn("step", F.explode(F.array(*[F.lit(s) for s in jb.STEPS])))
    return j.select("job_id", "step", jb.step_status(F.col("step"), F.col("completed_steps"), F.col("current_step"), F.col("state")).alias("status"))


def _files(spark, d):
    o = table(spark, d, "orders")
    ext = F.element_at(F.array(*[F.lit(e) for e in _EXT]), (F.col("o_orderkey") % len(_EXT) + 1).cast("int"))
    name = F.concat(F.lit("dir.d/File "), F.col("o_orderkey").cast("string"), F.when(F.col("o_orderkey") % 2 == 0, F.upper(ext)).otherwise(ext))
    return o.select("o_orderkey", name.alias("filename"), F.element_at(F.array(F.lit("structured"), F.lit("semantic"), F.lit("auto")), (F.col("o_custkey") % 3 + 1).cast("int")).alias("mode"), "o_orderdate", "o_custkey")


def ingest_route(spark, d):
    f = _files(spark, d)
    return f.select("o_orderkey", jb.reader_of(F.col("filename")).alias("reader"), jb.route(F.col("filename"), F.col("mode")).alias("route"), jb.file_label(F.col("filename")).alias("label"), jb.is_spreadsheet(F.col("filename")).alias("is_sheet"), tx.stem(F.col("filename")).alias("stem"))


def file_registry(spark, d):
    log = _files(spark, d).select(F.col("o_custkey").alias("id"), "filename", F.col("o_orderkey").alias("seq"))
    return jb.latest(log, "id", "seq")


def file_listing(spark, d):
    f = _files(spark, d).where(jb.reader_of(F.col("filename")).isin("text", "pdf"))
    return jb.page_of(f.select("o_orderkey", "filename", "o_orderdate"), [F.desc("o_orderdate"), "o_orderkey"], 2).select("o_orderkey", "filename")


def trace_lineage(spark, d):
    runs = table(spark, d, "orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_custkey").alias("user_id"))
    li = table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "run_id")
    answers = runs.where("run_id % 4 = 0").select("run_id", F.concat(F.lit("a"), F.col("run_id").cast("string")).alias("answer"))
    return jb.trace_runs(runs, li.where("l_linenumber % 2 = 0"), li.where("l_linenumber % 2 = 1").select("run_id", F.col("l_linenumber").alias("n_chunks")), answers)


def source_refs(spark, d):
    doc = table(spark, d, "documents")
    kind = F.element_at(F.array(F.lit("episodic"), F.lit("knowledge"), F.lit("data"), F.lit("web"), F.lit("other")), (F.col("doc_id") % 5 + 1).cast("int"))
    ref = jb.source_ref(kind, F.col("doc_id").cast("string"), F.col("text"))
    return doc.select("doc_id", ref["source_type"].alias("source_type"), F.md5(ref["excerpt"]).alias("excerpt_md5"))


def memory_cards(spark, d):
    doc = table(spark, d, "documents")
    return jb.page_of(doc.select("doc_id", tx.ellipsis(F.col("text"), 240).alias("card"), jb.icon(F.when(F.col("doc_id") % 2 == 0, "audio").otherwise("x")).alias("icon")), ["doc_id"], 1)


def trace_spans(spark, d):
    o, li = table(spark, d, "orders"), table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "run_id")
    runs = o.where("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("run_id"), F.lit("in").alias("input"), F.col("o_orderstatus").alias("output"), F.col("o_orderkey").alias("seq"))
    tools = li.select("run_id", F.concat(F.lit("tool"), (F.col("l_linenumber") % 2).cast("string")).alias("name"), F.lit("{}").alias("args"), F.lit("[]").alias("result"), F.col("l_linenumber").alias("seq"))
    asked = li.where("l_linenumber = 1").select("run_id", F.lit("q").alias("query"), F.array(F.lit("c1"), F.lit("c2")).alias("chunks"), "l_linenumber").withColumnRenamed("l_linenumber", "seq")
    said = o.where("o_orderkey % 4 = 0").select(F.col("o_orderkey").alias("run_id"), F.lit("a").alias("answer"), F.lit(9).alias("seq"))
    return jb.trace_spans(runs, tools, asked, said).select("trace_id", "span_id", "parent_id", "kind", "name", "output")


def _docs(spark, d):
    t = table(spark, d, "documents")
    return t.select(F.col("source").alias("job_id"), "doc_id", F.lit("text").alias("source_type"), F.col("source").alias("source_name"), F.col("text").alias("content"), F.create_map(F.lit("lang"), F.col("lang")).alias("metadata"))


def job_payload(spark, d):
    p = jb.payload(_docs(spark, d))
    return p.select("job_id", F.size("payload").alias("n_documents"), F.md5(F.array_join(F.transform("payload", lambda x: F.concat(x["id"].cast("string"), F.lit(":"), x["metadata"]["lang"], F.lit(":"), F.md5(x["content"]))), ",")).alias("payload_md5"))


def job_preview(spark, d):
    return jb.preview(_docs(spark, d)).select("job_id", "n_blocks", F.md5(F.array_join("blocks", "|")).alias("blocks_md5"))


def source_types(spark, d):
    f = _files(spark, d).withColumn("source_type", jb.reader_of(F.col("filename")))
    return rt.of_source_types(f, "text,pdf,,Audio").select("o_orderkey", "source_type")


def registry_cascade(spark, d):
    f = _files(spark, d).select("o_orderkey", F.col("o_custkey").alias("file_id"))
    gone = table(spark, d, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("file_id"))
    return jb.without(f, gone).select("o_orderkey")


QUERIES = {f.__name__: f for f in (job_latest, job_step_status, ingest_route, file_registry, file_listing, trace_lineage, source_refs, memory_cards, trace_spans, job_payload, job_preview, source_types, registry_cascade)}
_J = """e AS (SELECT user_id AS job_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events), c AS (SELECT job_id, least(max(n), 4) AS n FROM e GROUP BY job_id),
j AS (SELECT job_id, CASE WHEN n = 4 AND job_id % 3 = 0 THEN 'failed' WHEN n = 4 AND job_id % 3 = 1 THEN 'completed' ELSE 'processing' END AS state, least(n, 3) AS p FROM c),
k AS (SELECT *, CASE WHEN state = 'completed' THEN p ELSE p - 1 END AS done FROM j)"""
_S = "['read', 'ground', 'chunk', 'embed', 'upsert']"
_F = f"""f AS (SELECT o_orderkey, o_custkey, o_orderdate, e, 'dir.d/File ' || o_orderkey || CASE WHEN o_orderkey % 2 = 0 THEN upper(e) ELSE e END AS filename, ['structured', 'semantic', 'auto'][o_custkey % 3 + 1] AS mode
 FROM (SELECT *, {_EXT!r}[o_orderkey % {len(_EXT)} + 1] AS e FROM orders))"""
_CASE = lambda values, default: "CASE e " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in values.items()) + f" ELSE {default} END"
ORACLE = {
    "job_latest": f"WITH {_J} SELECT job_id, state, CASE WHEN state = 'processing' THEN {_S}[p] END AS current_step, array_to_string({_S}[1:done], ',') AS steps, CASE WHEN state = 'failed' THEN 'boom' END AS error FROM k",
    "job_step_status": f"WITH {_J} SELECT job_id, {_S}[i] AS step, CASE WHEN i <= done THEN 'done' WHEN i = done + 1 AND state = 'failed' THEN 'failed' WHEN i = p AND state = 'processing' THEN 'active' ELSE 'pending' END AS status FROM k, range(1, 6) t(i)",
    "ingest_route": f"""WITH {_F} SELECT o_orderkey, {_CASE(jb.READERS, 'NULL')} AS reader, CASE WHEN e IN ('.jpg', '.jpeg', '.png', '.webp', '.gif') THEN 'image' WHEN mode = 'structured' AND e IN ('.csv', '.tsv', '.xlsx', '.xls') THEN 'structured' WHEN mode = 'semantic' THEN 'document' END AS route,
 {_CASE(jb.LABELS, "'Document'")} AS label, e IN ('.xlsx', '.xls', '.xlsm', '.csv', '.tsv') AS is_sheet, 'File ' || o_orderkey AS stem FROM f""",
    "file_registry": f"WITH {_F} SELECT o_custkey AS id, arg_max(filename, o_orderkey) AS filename, max(o_orderkey) AS seq FROM f GROUP BY o_custkey",
    "file_listing": f"WITH {_F} SELECT o_orderkey, filename FROM f WHERE e IN ('.txt', '.md', '.pdf') ORDER BY o_orderdate DESC, o_orderkey LIMIT 20 OFFSET 40",
    "trace_lineage": """SELECT o_orderkey AS run_id, o_custkey AS user_id, count(*) FILTER (l_linenumber % 2 = 0) AS n_tools, count(*) FILTER (l_linenumber % 2 = 1) AS n_retrievals, coalesce(sum(l_linenumber) FILTER (l_linenumber % 2 = 1), 0)::BIGINT AS n_chunks,
 CASE WHEN o_orderkey % 4 = 0 THEN 'a' || o_orderkey END AS answer FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_custkey""",
    "source_refs": "SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'episodic' WHEN 1 THEN 'knowledge' WHEN 2 THEN 'data' WHEN 3 THEN 'web' END AS source_type, CASE WHEN doc_id % 5 < 4 THEN md5(left(text, 300)) END AS excerpt_md5 FROM documents",
    "trace_spans": """WITH r AS (SELECT o_orderkey AS id, o_orderstatus AS s, substr(sha256('run/' || o_orderkey), 1, 16) AS root FROM orders WHERE o_orderkey % 3 <> 0), t AS (SELECT * FROM lineitem JOIN r ON l_orderkey = id)
SELECT id::VARCHAR AS trace_id, root AS span_id, NULL AS parent_id, 'run' AS kind, 'run' AS name, s AS output FROM r
UNION ALL SELECT id::VARCHAR, substr(sha256('tool/' || id || '/' || l_linenumber || '/tool' || l_linenumber % 2), 1, 16), root, 'tool', 'tool' || l_linenumber % 2, '[]' FROM t
UNION ALL SELECT id::VARCHAR, substr(sha256('retriever/' || id || '/1/'), 1, 16), root, 'retriever', 'retriever', '["c1","c2"]' FROM t WHERE l_linenumber = 1
UNION ALL SELECT id::VARCHAR, substr(sha256('generation/' || id || '/9/'), 1, 16), root, 'generation', 'generation', 'a' FROM r WHERE id % 4 = 0""",
    "job_payload": "SELECT source AS job_id, count(*)::INTEGER AS n_documents, md5(string_agg(doc_id || ':' || lang || ':' || md5(text), ',' ORDER BY doc_id)) AS payload_md5 FROM documents GROUP BY source",
    "job_preview": "SELECT source AS job_id, count(*) AS n_blocks, md5(string_agg(left(text, 400), '|' ORDER BY doc_id)) AS blocks_md5 FROM documents GROUP BY source",
    "source_types": f"WITH {_F} SELECT o_orderkey, CASE WHEN e = '.pdf' THEN 'pdf' ELSE 'text' END AS source_type FROM f WHERE e IN ('.txt', '.md', '.pdf')",
    "registry_cascade": "SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0)",
    "memory_cards": "SELECT doc_id, CASE WHEN length(text) > 240 THEN left(text, 240) || '…' ELSE text END AS card, CASE WHEN doc_id % 2 = 0 THEN '🎵' ELSE '📄' END AS icon FROM documents ORDER BY doc_id LIMIT 20 OFFSET 20",
}
