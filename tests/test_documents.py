import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from granary.operators import chunking, ingest, jobs, models, pdf, retrieval, structured
from granary.operators import pages as pg
from granary.operators.grounding import EpisodicStore, MemoryWriter
from granary.operators.service import Pipeline, Tracer, Tracker
from granary.operators.store import KnowledgeStore
from granary.sources import datasource, files

def ref():
    return F.lit(datetime(2026, 5, 18, 10)).cast("timestamp_ntz")


SCHEMA = "id string, user_id string, domain_id string, filename string, content string, embedding array<float>, metadata map<string,string>, seq long"


def rows(spark, *data):
    return spark.createDataFrame([(i, u, "d", f"f{i}", c, [1.0, float(n)], {"page_number": "3"}, n) for n, (i, u, c) in enumerate(data)], SCHEMA)


# --- pages ---------------------------------------------------------------------------------------


def word(x0, top, text, width=20.0, height=10.0):
    return (float(x0), float(x0 + width), float(top), float(top + height), text)


def _reader():
    def load():
        return lambda raw: json.loads(raw)

    return load  # not a function of this module, which workers can't import


#: A stand-in for a reader of PDF files: JSON of the pages.
load_pages = _reader()


FILE = [
    {"text": "3 Terms\nall of this\nis text", "words": []},
    {"text": "x", "words": [word(10, 80, "Unit"), word(32, 80, "price"), word(110, 80, "Qty"), word(10, 110, "7"), word(5, 200, "3.1 Payment")],
     "tables": [{"box": (0, 100, 200, 140), "cells": [[" 7 ", None], ["8", "2"]], "columns": [(0, 100), (100, 200)]}, {"box": (0, 300, 9, 310), "cells": [["", None]]}]},
    {"text": "", "words": [word(10, 50, "Name"), word(100, 50, "Size"), word(10, 70, "nut"), word(98, 70, "M4"), word(122, 71, "steel"), word(10, 300, "ANNEX"), word(10, 320, "one line")]},
    {"text": "\n\nplain note\n\n\n\nother note", "words": [word(10, 10, "plain")]},
]


def frame(spark, pages=FILE, name="f"):
    raw = json.dumps(pages).encode()
    df = spark.createDataFrame([(f"/x/{name}.pdf", bytearray(raw), ".pdf")], "path string, content binary, extension string")
    return files.read_pages(df, load_pages)


def test_pages_to_documents(spark):
    got = pdf.documents(pdf.blocks(frame(spark))).orderBy("page_no", "block_no").collect()
    assert [(r.page_no, r.block_type, r.headings) for r in got] == [
        (1, "text", ["3 Terms"]), (2, "table", ["3 Terms"]), (2, "note", ["3 Terms", "3.1 Payment"]), (3, "table", ["3 Terms", "3.1 Payment"]), (3, "note", ["ANNEX"]), (4, "note", ["ANNEX"]), (4, "note", ["ANNEX"]),
    ]
    assert got[0].content == "### Text (page 1)\n3 Terms\nall of this\nis text"
    assert got[1].table_columns == ["Unit price", "Qty"] and got[1].table_rows == [{"Unit price": "7", "Qty": ""}, {"Unit price": "8", "Qty": "2"}] and got[1].table_label == "3 Terms"
    assert got[2].content == "### Note (page 2)\nUnit price Qty\n3.1 Payment"
    assert got[3].content == "### Table (page 3)\n| Name | Size |\n| --- | --- |\n| nut | M4 steel |"
    assert got[4].content == "### Note (page 3)\nANNEX\none line" and [r.content[-10:] for r in got[5:]] == ["plain note", "other note"]
    assert len({r.doc_id for r in got}) == 7
    tables = pdf.extract_tables(pdf.blocks(frame(spark))).orderBy("page_no").collect()
    assert [(r.page_no, r.headers) for r in tables] == [(2, ["Unit price", "Qty"]), (3, ["Name", "Size"])]


def test_tables_in_arrays_are_those_of_flat_words(spark):
    """Two ways to the same tables: expressions in a page's row, and joins of words."""
    import random

    rng = random.Random(4)
    pages = [{"words": [word(rng.choice([10, 60, 120, 200, 215]), 12 * rng.randrange(30) + rng.randrange(4), f"w{i}", rng.choice([10, 20, 30])) for i in range(rng.randrange(60))]} for _ in range(25)]
    p = frame(spark, pages)
    arrays = p.select("page_no", F.inline(pdf.shown_tables(pdf.sorted_words(F.col("words"))))).collect()
    flat = pg.stream_tables(p.select("page_no", F.inline("words")), ["page_no"]).collect()
    key = lambda r: (r.page_no, r.top, r.x0, r.x1, r.bottom, [[c for c in row] for row in r.cells])
    assert sorted(map(key, arrays)) == sorted(map(key, flat)) and len(flat) > 10


def test_headings_of_any_depth(spark):
    lines = ["1.1.1.1.1.1.1.1.1.1 Deep one", "text", "2 Next", "2.1 Sub", "21 Not one"]
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(lines)] + [(None, 0, "3 Other"), (None, 1, "x")], "d int, i int, text string")
    got = {(r.d, r.i): r.path for r in pg.with_heading_path(df, ["d"], ["i"]).collect()}
    assert got[1, 0] == got[1, 1] == [lines[0]] and got[1, 4] == ["2 Next", "2.1 Sub"] and got[None, 1] == ["3 Other"]
    assert spark.createDataFrame([(lines,)], "l array<string>").select(pg.heading_path(F.col("l"))).first()[0] == got[1, 4]


def test_files_of_all_kinds(spark, tmp_path):
    (tmp_path / "a.txt").write_text("met Ann yesterday")
    (tmp_path / "b.csv").write_text(datasource.SAMPLE_CSV)
    (tmp_path / "c.pdf").write_bytes(json.dumps(FILE).encode())
    (tmp_path / "d.pdf").write_bytes(b"no pages")
    (tmp_path / "e.pdf").write_bytes(json.dumps([{"text": "", "words": [word(1, 1, "scan")]}, {"text": "\n"}]).encode())
    (tmp_path / "f.mp3").write_bytes(b"sound")
    (tmp_path / "g.exe").write_bytes(b"?")
    (tmp_path / "h.xlsx").write_bytes(b"no zip")
    found = files.binary_files(spark, str(tmp_path))
    got = files.documents(found, {"pdf": load_pages, "audio": lambda: lambda raw, ext: raw.decode() + ext}).collect()
    by = {}
    for r in got:
        by.setdefault(r.file_id[-5:], []).append(r)
    assert {k: len(v) for k, v in by.items()} == {"a.txt": 1, "b.csv": 1, "c.pdf": 7, "d.pdf": 1, "f.mp3": 1, "g.exe": 1, ".xlsx"[-5:]: 1}
    assert by["b.csv"][0].table_columns == ["date", "category", "item", "amount"] and by["b.csv"][0].table_rows[0]["item"] == "bread" and len(by["b.csv"][0].table_rows) == 5
    assert by["f.mp3"][0].content == "sound.mp3" and by["g.exe"][0].error == "no reader for .exe" and "Error" in by["d.pdf"][0].error and by[".xlsx"][0].error
    assert all(r.doc_id and r.content for v in by.values() for r in v if not r.error)


def test_data_source(spark, tmp_path):
    datasource.register(spark)
    (tmp_path / "b.csv").write_text(datasource.SAMPLE_CSV)
    (tmp_path / "c.xlsx").write_bytes(b"bad")
    got = spark.read.format("granary").option("path", str(tmp_path)).load()
    assert got.where("error is null").count() == 24 and got.where("error is not null").count() == 1


# --- store and retrieval -------------------------------------------------------------------------


def test_store_writes_only_what_it_touches(spark, tmp_path):
    s = KnowledgeStore(spark, str(tmp_path / "k"))
    assert s.read().count() == 0
    s.upsert(rows(spark, ("a", "u1", "one"), ("b", "u2", "two"), ("b", "u2", "two again")))
    before = s._newest()[1]
    s.upsert(rows(spark, ("a", "u1", "new"), ("c", "u1", "more")))
    after = s._newest()[1]
    assert {b for b in after if after[b] != before[b]} == {s.bucket("u1")} and s.bucket("u1") != s.bucket("u2")
    assert {(r.id, r.content) for r in s.read().collect()} == {("a", "new"), ("b", "two again"), ("c", "more")}
    assert {r.id for r in s.read("u1").collect()} == {"a", "c"} and s.read("nobody").count() == 0
    s.delete(user_id="u2")
    assert {r.id for r in s.read().collect()} == {"a", "c"} and set(s._newest()[1]) == {s.bucket("u1")}
    s.delete(id="nothing")
    with pytest.raises(ValueError):
        s.upsert(rows(spark, ("x", "", "no user")))
    with pytest.raises(ValueError):
        s.search([1.0, 0.0], "")
    assert [r.id for r in s.search([0.0, 1.0], "u1", top_k=1).collect()] == ["c"]


def test_a_failed_write_is_no_version(spark, tmp_path):
    s = KnowledgeStore(spark, str(tmp_path / "k"))
    s.upsert(rows(spark, ("a", "u1", "one")))
    broken = F.udf(lambda x: 1 / 0, "string")
    with pytest.raises(Exception, match="ZeroDivision|division"):
        s.upsert(rows(spark, ("b", "u1", "two")).withColumn("content", broken("content")))
    with pytest.raises(Exception, match="ZeroDivision|division"):
        s._replace([s.bucket("u1")], lambda before: before.withColumn("content", broken("content")))
    s.upsert(rows(spark, ("b", "u1", "two")))
    assert {r.id for r in s.read().collect()} == {"a", "b"}
    # a version that another writer left half written is passed over, its number too
    (tmp_path / "k" / "versions" / "9.json").write_text('{"1": ')
    s.upsert(rows(spark, ("c", "u1", "three")))
    assert {r.id for r in s.read().collect()} == {"a", "b", "c"} and s._numbers()[-1] == 10
    s.vacuum()
    assert s.read().count() == 3 and len(s._names("segments")) <= 2


def test_two_writers(spark, tmp_path):
    a, b = (KnowledgeStore(spark, str(tmp_path / "k")) for _ in range(2))
    a.upsert(rows(spark, ("a", "u1", "one")))
    seen = []

    def late(before):
        if not seen:  # the other one is faster
            seen.append(1)
            b.upsert(rows(spark, ("b", "u1", "two")))
        return before.unionByName(before.withColumn("id", F.lit("c")).limit(1))

    a._replace([a.bucket("u1")], late)
    assert sorted(r.id for r in a.read().collect()) == ["a", "b", "c"]


def test_retrieval(spark, tmp_path):
    p = Pipeline(spark, str(tmp_path), max_tokens=20, overlap=2)
    docs = [("j", "d1", "u", "dom", "a.txt", "apples and pears grow on trees", None), ("j", "d2", "u", "dom2", "b.txt", "the train leaves at noon", None), ("j", "d3", "v", "dom", "c.txt", "apples of another user", None)]
    p.submit(spark.createDataFrame(docs, "job_id string, doc_id string, user_id string, domain_id string, filename string, content string, error string"), ref())
    k = retrieval.Knowledge(spark, p.store, ingest.hashed_vector, 2)
    got = k.retrieve("apples and pears grow on trees", "u").collect()
    assert got[0].name == "a.txt" and got[0].score == pytest.approx(1.0) and len(got) == 2 and got[0].score > got[1].score
    assert [r.name for r in k.retrieve("apples", filters={"user_id": "u", "domain_id": "dom2"}).collect()] == ["b.txt"]
    assert [r.name for r in k.retrieve("apples", "u", filters={"filename": "b.txt"}).collect()] == ["b.txt"]
    with pytest.raises(ValueError):
        k.retrieve("x", "u", filters={"colour": "red"})
    with pytest.raises(ValueError):
        k.retrieve("x")
    hits = json.loads(k.search_tool("v", retrieval.DETAILS)("apples"))["chunks"]
    assert [h["filename"] for h in hits] == ["c.txt"] and 0 < hits[0]["score"] <= 1 and "table_label" not in hits[0]
    assert json.loads(k.search_tool("nobody")("apples")) == {"chunks": []}
    assert k.valid_filters() == {"domain_id", "filename"} and "domain_id" in k.context()


def test_submitted_files(spark, tmp_path):
    p = Pipeline(spark, str(tmp_path / "p"), max_tokens=30, overlap=2, readers={"pdf": load_pages})
    note = p.submit_file("I met Ann yesterday", "note.txt", "u", "d", ref())
    sheet = p.submit_file(datasource.SAMPLE_CSV, "x.CSV", "u", "d", ref())
    paper = p.submit_file(json.dumps(FILE).encode(), "p.pdf", "u", "d", ref())
    bad, unknown, nobody = p.submit_file(b"?", "q.pdf", "u", "d", ref()), p.submit_file(b"?", "q.zip", "u", "d", ref()), p.submit_file(b"x", "q.txt", "", "d", ref())
    assert [p.status(j)["state"] for j in (note, sheet, paper, bad, unknown, nobody)] == ["completed"] * 3 + ["failed"] * 3
    assert p.status(unknown)["error"] == "no reader for .zip" and p.status(sheet)["chunks_count"] == 6 and note.startswith("job_")
    assert p.store.read("u").where(F.contains("content", F.lit("2026-05-17 [yesterday]"))).count() == 1
    assert {r.filename: r.source_type for r in p.files.list().collect()} == {"note.txt": "text", "x.CSV": "spreadsheet", "p.pdf": "pdf"}
    assert [r.filename for r in p.files.list("text,pdf ").collect()] == ["note.txt"]
    p.files.update(sheet, tables=["sd_d_x"])
    structured.create_table(spark.createDataFrame([("1",)], "a string"), "sd_d_x", [("a", "a", "BIGINT")])
    p.files.delete(sheet)
    assert not spark.catalog.tableExists("sd_d_x") and p.store.read("u").where("filename = 'x.CSV'").count() == 0 and p.files.list().count() == 2
    with pytest.raises(KeyError):
        p.files.delete(sheet)


def test_a_batch_is_worked_out_once(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    def counted(x):
        calls.add(1)
        return x

    p = Pipeline(spark, str(tmp_path), embed=lambda c: F.array(F.length(F.udf(counted, "string")(c)).cast("float")))
    p.submit(spark.createDataFrame([("j", str(i), "u", "d", "f", f"text {i}", None) for i in range(8)], "job_id string, doc_id string, user_id string, domain_id string, filename string, content string, error string"), ref())
    assert p.store.read().count() == 8 and calls.value == 8


def test_episodic_and_memories(spark, tmp_path):
    e = EpisodicStore(KnowledgeStore(spark, str(tmp_path / "k")), ingest.hashed_vector)
    e.upsert(spark.createDataFrame([("u", "saw Bob yesterday", 1), ("u", "likes tea", 2)], "user string, text string, seq long"), ref())
    v = retrieval.Knowledge(spark, e.store, ingest.hashed_vector).vector("saw Bob 2026-05-17 [yesterday]")
    first = e.search(v, "u").collect()[0]
    assert first.content == "saw Bob 2026-05-17 [yesterday]" and first.metadata == {"event_at": "2026-05-17"}
    e.delete(first.id, "u")
    assert [r.content for r in e.search(v, "u").collect()] == ["likes tea"]

    class Inner:
        other = 5

        def upsert_memories(self, df):
            return df.collect()

    w = MemoryWriter(Inner(), ref())
    got = w.upsert_user_memory(spark.createDataFrame([("met her yesterday", ["x"])], "memory string, topics array<string>"))
    assert got[0].memory == "met her 2026-05-17 [yesterday]" and got[0].topics == ["x", "event_at:2026-05-17"] and w.other == 5


def test_table_tools(spark, tmp_path):
    structured.create_table(spark.createDataFrame([("1", "2026-01-01"), ("2", "2026-01-02")], "a string, b string"), "sd_abcdefgh_t", [("a", "a", "BIGINT"), ("b", "b", "DATE")])
    notes = spark.createDataFrame([("sd_abcdefgh_t", "two rows")], "table_name string, description string")
    try:
        row = structured.catalogue(spark, "sd_abcdefgh_", notes).first()
        assert (row.table_name, row.n_columns, row.n_rows, row.description) == ("sd_abcdefgh_t", 2, 2, "two rows") and [tuple(c) for c in row.columns] == [("a", "BIGINT"), ("b", "DATE")]
        tools = retrieval.table_tools(spark, "abcdefghij", notes)
        assert json.loads(tools["list_tables"]()) == {"tables": [{"name": "sd_abcdefgh_t", "rows": 2, "description": "two rows"}]}
        assert json.loads(tools["describe_table"]("sd_abcdefgh_t"))["columns"][1] == {"name": "b", "type": "DATE"}
        assert "no table" in json.loads(tools["describe_table"]("other"))["error"] and "error" in json.loads(tools["query_tables"]("select nonsense"))
        assert json.loads(tools["query_tables"]("select sum(a) as s from sd_abcdefgh_t;")) == {"rows": [{"s": 3}]}
    finally:
        structured.drop_table(spark, "sd_abcdefgh_t")
    for name in ("sd_other_t", "sd_abcdefgh_t; drop table x", ""):
        with pytest.raises(ValueError):
            structured.guarded(name, "abcdefghij")


# --- traces, jobs, models ------------------------------------------------------------------------


def test_spans_and_batched_traces(spark, tmp_path):
    t = Tracer(spark, str(tmp_path))
    run = t.start_run("u", "hello")
    t.log_tool_call(run, "sql", "{}", "[]")
    t.log_retrieval(run, "q", ["c1", "c2"])
    t.log_tool_call("unknown", "sql", "{}", "[]")
    assert not any(t.logs["runs"].read().limit(1).collect())  # rows wait
    t.log_answer(run, "42")
    t.complete_run(run, "done")
    assert len(list((tmp_path / "tools").glob("*.parquet"))) == 1
    spans = t.spans().collect()
    root = [s for s in spans if s.parent_id is None]
    assert len(root) == 1 and root[0].output == "done" and {s.parent_id for s in spans} == {None, root[0].span_id}
    assert sorted(s.kind for s in spans) == ["generation", "retriever", "run", "tool"] and len({s.span_id for s in spans}) == 4
    assert [s.output for s in spans if s.kind == "retriever"] == ['["c1","c2"]']


def test_tracker(spark, tmp_path):
    t = Tracker(spark, str(tmp_path))
    job = t.new()
    assert t.get(job)["state"] == "pending"
    for step in ("read", "upsert", "annotate"):
        t.set_step(job, step)
    assert t.get(job)["current_step"] == "annotate" and t.get(job)["completed_steps"] == ["read", "upsert"]
    t.finish(job)
    assert t.get(job)["completed_steps"] == ["read", "upsert", "annotate"] and t.get(job)["state"] == "completed"
    with pytest.raises(ValueError):
        t.set_step(job, "dance")
    with pytest.raises(KeyError):
        t.get("nobody's")


def test_models(spark):
    def load():
        def f(prompt):
            if "bad" in prompt:
                raise RuntimeError("no answer")
            return '{"who": "Ann", "n": [1, 2]}' if "json" in prompt else "plain"

        return f

    df = spark.createDataFrame([(1, "json"), (2, "bad"), (3, "x"), (4, None)], "i int, t string")
    got = {r.i: r.facts for r in models.extract_facts(df, "t", load).collect()}
    assert got == {1: {"who": "Ann", "n": "[1, 2]"}, 2: {}, 3: {}, 4: {}}
    errors = {r.i: r.answer_error for r in models.answers(df, F.col("t"), load).collect()}
    assert errors == {1: None, 2: "RuntimeError: no answer", 3: None, 4: None}
    with pytest.raises(ValueError):
        models.backend({"local": load}, "remote")
    assert models.backend({"local": load}, "local") is load
    assert spark.range(1).select(models.joined_segments(F.array(F.lit(" a "), F.lit(" "), F.lit("b")))).first()[0] == "a b"


def test_registry_rows_of_deleted_files(spark):
    chunks = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "file_id string, n int")
    assert {r.n for r in jobs.without(chunks, spark.createDataFrame([("a",)], "file_id string")).collect()} == {2, 3}


# --- chunks --------------------------------------------------------------------------------------


def test_packing_like_a_loop(spark):
    """Chunks by a plain loop over blocks that joins and splits texts again."""
    import random

    rng = random.Random(8)

    def loop(found, most, overlap, similar, threshold=0.75):
        done, cur = [], None
        for b, s in zip(found, similar):
            if cur is None:
                cur = b
            elif s < threshold or len(cur.split()) + len(b.split()) > most:
                done.append(cur)
                tail = cur.split()[-overlap:] if overlap else []
                cur = " ".join([*tail, b])
            else:
                cur = f"{cur} {b}"
        return done + ([cur] if cur is not None else [])

    cases = []
    for i in range(120):
        found = [" ".join(f"w{rng.randrange(99)}" for _ in range(rng.choice([1, 2, 5, 12]))) for _ in range(rng.randrange(12))]
        cases.append((i, found, [rng.choice([0.1, 0.9, 0.8]) for _ in found]))
    df = spark.createDataFrame(cases, "i int, found array<string>, s array<double>")
    for most, overlap in ((10, 3), (6, 5), (8, 0)):
        got = {r.i: (r.a, r.b) for r in df.select("i", chunking.pack_blocks(F.col("found"), most, overlap).alias("a"), chunking.pack_blocks(F.col("found"), most, overlap, F.col("s")).alias("b")).collect()}
        for i, found, s in cases:
            assert got[i] == (loop(found, most, overlap, [1.0] * len(found)), loop(found, most, overlap, s)), (found, most, overlap)
