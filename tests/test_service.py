from datetime import datetime

import pytest
from pyspark.sql import functions as F

from granary.operators.service import Pipeline, Tracer
from granary.sources.blobs import BlobStore
from granary.streaming import ingest as stream

def ref():
    return F.lit(datetime(2026, 5, 18, 10)).cast("timestamp_ntz")


def docs(spark, rows):
    return spark.createDataFrame(rows, "job_id string, doc_id string, user_id string, domain_id string, filename string, content string, error string")


def test_pipeline(spark, tmp_path):
    p = Pipeline(spark, str(tmp_path), max_tokens=5, overlap=1)
    batch = docs(spark, [("j1", "d1", "u", "d", "f", "I ran yesterday\n# Head\nmore text", None), ("j1", "d2", "u", "d", "f", "", None), ("j2", "d3", "u", "d", "g", None, "can't be read")])
    p.submit(batch, ref())
    assert p.status("j1")["state"] == "completed" and p.status("j1")["completed_steps"] == ["read", "ground", "chunk", "embed", "upsert"]
    assert p.status("j2")["state"] == "failed" and p.status("j2")["error"] == "can't be read"
    with pytest.raises(KeyError):
        p.status("nobody's")
    stored = p.store.read()
    assert stored.where(F.contains("content", F.lit("2026-05-17 [yesterday]"))).count() == 1
    n = stored.count()
    p.submit(batch, ref())
    assert p.store.read().count() == n and p.status("j1")["chunks_count"] >= 2
    with pytest.raises(ValueError):
        p.submit(docs(spark, [("j3", "d", "", "d", "f", "x", None)]), ref())
    assert p.status("j3")["state"] == "failed"


def test_tracer(spark, tmp_path):
    t = Tracer(spark, str(tmp_path))
    assert t.runs().count() == 0
    a, b = t.start_run("u", "hello"), t.start_run("u", "again")
    t.log_tool_call(a, "sql", "{}", "[]")
    t.log_retrieval(a, "q", ["c1", "c2"])
    t.log_answer(a, "42")
    t.log_tool_call("unknown", "sql", "{}", "[]")
    t.complete_run(a, "done")
    got = {r.run_id: r for r in t.runs().collect()}
    assert set(got) == {a, b} and got[a].output == "done" and (got[a].n_tools, got[a].n_chunks, got[a].answer) == (1, 2, "42")
    assert got[b].output is None and got[b].n_tools == 0


def test_blobs(spark, tmp_path):
    s = BlobStore(spark, str(tmp_path))
    key = s.save("u1", "f1", "../x.csv", b"a,b")
    assert spark.read.format("binaryFile").load(s.resolve(key)).first()["content"] == b"a,b" and key.startswith("u1/")
    assert s.delete(key) and s.resolve(key) is None and not s.delete(key)
    with pytest.raises(ValueError):
        s.save("", "f", "n", b"")


def test_streams(spark, tmp_path):
    rows = [("u", "d", str(i % 3), "text %d" % (i % 3), datetime(2026, 1, 1)) for i in range(9)]
    spark.createDataFrame(rows, "user_id string, domain_id string, doc_id string, text string, at timestamp").repartition(3).write.parquet(str(tmp_path / "in"))
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    chunks = stream.chunk_stream(stream.read_files(spark, str(tmp_path / "in"), schema, per_trigger=1))
    stream.run_available(stream.dedupe_stream(chunks, "at"), str(tmp_path / "c1"), path=str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3
    p = Pipeline(spark, str(tmp_path / "p"))
    full = chunks.select("id", "user_id", "domain_id", F.lit("f").alias("filename"), "content", F.array(F.lit(1.0)).cast("array<float>").alias("embedding"), F.create_map().cast("map<string,string>").alias("metadata"))
    stream.run_available(full, str(tmp_path / "c2"), each=stream.upsert_to(p.store))
    assert p.store.read().count() == 3
