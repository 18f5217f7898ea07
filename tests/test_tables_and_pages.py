import io
import zipfile

import pytest
from pyspark.sql import functions as F

from granary.functions import text as tx
from granary.operators import grids as gr
from granary.operators import jobs as jb
from granary.operators import pages as pg
from granary.operators import store
from granary.operators import structured as st
from granary.sources import files as fs


def cells(spark, *sheets):
    rows = [(str(f), 0, "Sheet1", r, c, v, False, None) for f, sheet in enumerate(sheets) for r, line in enumerate(sheet) for c, v in enumerate(line) if v]
    return spark.createDataFrame(rows, fs.CELLS).drop("merged", "error")


PEOPLE = [["Name", "Age", "City"], ["Alice", "30", "NY"], ["Bob", "25", "LA"], ["Carol", "41", "SF"]]
PROFILE = [["Name", "Alice"], ["Age", "30"], ["City", "NY"], ["Job", ""]]


def test_sheets(spark):
    c = cells(spark, PEOPLE, PROFILE, [["just a note"]], [*PEOPLE, [], [], *PEOPLE], [["a", "", "b"]])
    b = gr.parse(c)
    kinds = {(r.file_id, r.block_index): (r.block_type, r.confidence) for r in b.collect()}
    assert kinds[("0", 0)] == ("table", 1.0) and kinds[("1", 0)] == ("kv_pair", 1.0) and kinds[("2", 0)] == ("note", 0.8)
    assert [k for k in kinds if k[0] == "3"] and kinds[("3", 1)] == ("table", 1.0)
    assert kinds[("4", 0)] == ("note", 0.8)  # one blank column doesn't split
    content = {(r.file_id, r.block_index): r.content for r in gr.render(b, c).collect()}
    assert content[("0", 0)] == "### Table (rows 1-4, cols A-C)\n| Name | Age | City |\n| --- | --- | --- |\n| Alice | 30 | NY |\n| Bob | 25 | LA |\n| Carol | 41 | SF |"
    assert content[("1", 0)] == "### Key-Value (rows 1-4, cols A-B)\n- Name: Alice\n- Age: 30\n- City: NY\n- Job: "
    assert content[("2", 0)] == "### Note (rows 1-1, cols A-A)\njust a note"
    docs = gr.documents(b, c).collect()
    assert len({d.doc_id for d in docs}) == len(docs) == 6 and {d.source_type for d in docs} == {"spreadsheet"}
    t = {r.file_id: (r.headers, r.rows) for r in gr.tables_of(b, c).where("block_index = 0").collect()}
    assert t["0"] == (["Name", "Age", "City"], PEOPLE[1:])


def test_header_names_clash(spark):
    c = cells(spark, [["A", "A", "A_1", ""], ["1", "2", "3", "4"], ["5", "6", "7", "8"]])
    r = gr.table_rows(gr.parse(c), c).orderBy("row_index").collect()
    assert r[0].headers == ["A", "A_1", "A_1", "col_3"] and r[0].fields == {"A": "1", "A_1": "3", "col_3": "4"}


def test_empty_grid(spark):
    c = cells(spark, [])
    assert gr.render(gr.parse(c), c).count() == 0


def workbook():
    sheet = """<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>
<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>Day</t></is></c><c r="C1" t="str"><f>1</f><v>Ok</v></c></row>
<row r="2"><c r="A2"><v>3</v></c><c r="B2" s="1"><v>45000</v></c><c r="C2" t="b"><v>1</v></c></row>
<row r="3"><c r="A3"><v>2.50</v></c><c r="B3" s="1"><v>45000.5</v></c><c r="C3"/></row></sheetData><mergeCells><mergeCell ref="A2:A4"/></mergeCells></worksheet>"""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="Sales" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", '<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><si><r><t>Mon</t></r><r><t>th</t></r></si></sst>')
        z.writestr("xl/styles.xml", '<styleSheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>')
        z.writestr("xl/worksheets/sheet1.xml", sheet)
    return out.getvalue()


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("Näme;Age\n\n Zoë ;3".encode("latin-1"))
    (tmp_path / "b.TSV").write_text("x\ty")
    (tmp_path / "c.xlsx").write_bytes(workbook())
    (tmp_path / "d.xls").write_bytes(b"not a workbook")
    (tmp_path / "e.md").write_bytes(b"# T\n\xffx")
    files = fs.binary_files(spark, str(tmp_path))
    got = fs.read_cells(files.where("extension <> '.md'")).collect()
    by = {}
    for r in got:
        by.setdefault(r.file_id[-5:].lstrip("/"), []).append((r.row, r.col, r.value, r.merged))
    assert by["a.csv"] == [(0, 0, "Näme", False), (0, 1, "Age", False), (2, 0, "Zoë", False), (2, 1, "3", False)]
    assert by["b.TSV"] == [(0, 0, "x", False), (0, 1, "y", False)]
    assert by[".xlsx"] == [
        (0, 0, "Month", False), (0, 1, "Day", False), (0, 2, "Ok", False), (1, 0, "3", False), (1, 1, "2023-03-15 00:00:00", False), (1, 2, "True", False),
        (2, 0, "3", True), (2, 1, "2023-03-15 12:00:00", False), (3, 0, "3", True),
    ]
    assert [r.error is not None for r in got if r.file_id.endswith("d.xls")] == [True]
    assert fs.read_texts(files).first()["content"] == "# T\n�x"
    media = fs.read_media(files.withColumn("extension", F.lit(".mp3")), "audio", lambda: lambda raw, ext: f"{len(raw)} bytes").collect()
    assert len(media) == 5 and all(m.content.endswith("bytes") for m in media)
    answers = spark.createDataFrame([('{"ocr_text": "hi"}',), ("plain",), (None,)], "a string")
    assert [r[0] for r in answers.select(fs.ocr_text(F.col("a"))).collect()] == ["hi", "plain", None]


@pytest.mark.parametrize(("name", "safe"), [("Unit Price", "unit_price"), ("($)", "col"), ("x" * 50, "x" * 40), ("Preço", "pre_o"), ("", "col")])
def test_safe_names(spark, name, safe):
    assert spark.createDataFrame([(name,)], "n string").select(tx.safe_name(F.col("n"))).first()[0] == safe


@pytest.mark.parametrize(
    ("values", "kind"),
    [(["1", "2", "1.5"], "NUMERIC"), (["1", "-2", "1_000"], "BIGINT"), (["2026-05-01"], "DATE"), (["2026-05-01 10:30"], "TIMESTAMPTZ"), (["true"], "TEXT"), ([], "TEXT"), (["", ""], "TEXT"), (["2024-13-45"], "DATE"), (["nan", "1e5", ".5", "5."], "NUMERIC"), (["1d"], "TEXT")],
)
def test_types(spark, values, kind):
    assert spark.createDataFrame([(v,) for v in values], "v string").agg(st.inferred(F.col("v"))).first()[0] == kind


def test_type_changes_are_all_or_none(spark):
    df = spark.createDataFrame([("1", "x"), (None, "2")], "a string, b string")
    assert [r.a for r in st.change_types(df, {"a": "BIGINT", "zz": "DATE", "b": "WHAT"}).collect()] == [1, None]
    with pytest.raises(ValueError, match="b"):
        st.change_types(df, {"a": "BIGINT", "b": "BIGINT"})


def test_letters(spark):
    df = spark.createDataFrame([(i,) for i in (0, 25, 26, 51, 52, 701, 702, 16383)], "i int")
    assert [r[0] for r in df.select(tx.column_letter(F.col("i"))).collect()] == ["A", "Z", "AA", "AZ", "BA", "ZZ", "AAA", "XFD"]


@pytest.mark.parametrize(
    ("lines", "path"),
    [
        (["3 Terms", "3.1 Payment", "3.2 Delivery"], ["3 Terms", "3.2 Delivery"]), (["3 Terms", "4 References"], ["4 References"]), (["20 Final Provisions", "21 Should Be Rejected"], ["20 Final Provisions"]),
        (["III. Background"], ["III. Background"]), (["1. Introduction", "BILLING"], ["BILLING"]), (["INVOICE", "PAYMENT TERMS"], ["PAYMENT TERMS"]), (["A B C D E", "Q T Y", "NOTE.", "ABC12345", "INV-1001", "REF99", "89 Pacific Ave", "", "  "], []),
    ],
)
def test_headings(spark, lines, path):
    df = spark.createDataFrame([(lines,)], "l array<string>")
    assert df.select(pg.heading_path(F.col("l"))).first()[0] == path
    each = spark.createDataFrame([(1, i, x) for i, x in enumerate(lines)], "d int, i int, text string")
    assert pg.with_heading_path(each, ["d"], ["i"]).orderBy(F.desc("i")).first()["path"] == path


def test_header_rows_and_records(spark):
    df = spark.createDataFrame([([["Item", "Qty", "3"], ["a", "1"], ["", " "]],)], "c array<array<string>>")
    assert df.select(pg.is_header_row(F.array(F.lit("Item"), F.lit("12"), F.lit("3")))).first()[0] is False
    r = df.select(pg.table_records(F.col("c")).alias("r")).first()["r"]
    assert r.headers == ["Item", "Qty", "3"] and r.rows == [["a", "1", ""]]
    r = df.select(pg.table_records(F.col("c"), F.array(F.lit("x"), F.lit("x"), F.lit(""))).alias("r")).first()["r"]
    assert r.headers == ["x", "x_1", "col_2"] and len(r.rows) == 2


def test_stream_table(spark):
    rows = [(1, float(x), float(x + 30), float(t), float(t + 10), f"{t}:{x}") for t in (0, 20, 40, 200) for x in (0, 100, 200)] + [(1, 0.0, 30.0, 400.0, 410.0, "alone")]
    w = spark.createDataFrame(rows, "page int, x0 double, x1 double, top double, bottom double, text string")
    t = pg.stream_tables(w, ["page"]).collect()
    assert len(t) == 1 and t[0].cells == [[f"{y}:{x}" for x in (0, 100, 200)] for y in (0, 20, 40)]
    assert {r.text for r in pg.outside_tables(w, pg.stream_tables(w, ["page"]), ["page"]).collect()} == {"200:0", "200:100", "200:200", "alone"}


def test_store(spark, tmp_path):
    s = store.KnowledgeStore(spark, str(tmp_path / "k"))
    assert s.read().count() == 0
    row = lambda user, text, seq, vec: (None, user, "d", "f", text, vec, {}, seq)
    schema = "id string, user_id string, domain_id string, filename string, content string, embedding array<float>, metadata map<string,string>, seq long"
    s.upsert(spark.createDataFrame([row("u", "a", 1, [1.0, 0.0]), row("u", "a", 2, [1.0, 0.0]), row("v", "a", 1, [1.0, 0.0]), row("u", "b", 1, [0.0, 1.0])], schema))
    assert s.read().count() == 3
    s.upsert(spark.createDataFrame([row("u", "a", 3, [1.0, 1.0])], schema))
    assert s.read().count() == 3 and s.read().where("user_id = 'u' and content = 'a'").first()["seq"] == 3
    assert [r.content for r in s.search([1.0, 0.0], "u", top_k=2).collect()] == ["a", "b"]
    with pytest.raises(ValueError):
        s.search([1.0], "")
    with pytest.raises(ValueError):
        s.upsert(spark.createDataFrame([row("", "x", 1, [0.0])], schema))
    s.delete(user_id="u", domain_id="d")
    assert [r.user_id for r in s.read().collect()] == ["v"]


def test_job_steps(spark):
    df = spark.createDataFrame([(["read"], None, "failed"), ([], None, "failed"), (["read"], "ground", "processing"), (jb.STEPS, None, "completed")], "c array<string>, n string, s string")
    got = [[r[0] for r in df.select(jb.step_status(F.lit(step), F.col("c"), F.col("n"), F.col("s"))).collect()] for step in ("read", "ground", "chunk")]
    assert got == [["done", "failed", "done", "done"], ["failed", "pending", "active", "done"], ["pending", "pending", "pending", "done"]]
