"""Queries on pages as documents: a customer's orders are the pages of a file. Every fourth page has a ruled table, half
of those with headers above it; every fourth one has a table without rulings; every third has no text."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from granary.operators import pages as pg
from granary.operators import pdf

from .common import table


def _pages(spark, d):
    o = table(spark, d, "orders")
    n = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    k = F.col("o_orderkey")
    p = o.select(F.col("o_custkey").alias("file_id"), n.alias("page_no"), k.alias("k"), "o_orderstatus")
    text = F.when(F.col("k") % 3 == 0, F.concat(F.col("page_no").cast("string"), F.lit(" Terms\nsome plain text\nand more of it"))).when(F.col("k") % 3 == 1, F.concat(F.lit("A note of order "), F.col("k").cast("string"))).otherwise("")
    return p.withColumn("text", text)


def _with_layout(spark, d):
    """Pages with words and ruled tables, as a reader gives them."""
    p = _pages(spark, d)
    row = lambda *c: F.array(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in c])
    cells = F.array(row(" Key ", "Status"), row(F.col("k"), F.col("o_orderstatus")), row("", " "))
    columns = F.array(*[F.struct(F.lit(a).alias("x0"), F.lit(a + 100.0).alias("x1")) for a in (0.0, 100.0)])
    ruled = F.struct(*[F.lit(v).alias(c) for c, v in (("x0", 0.0), ("top", 100.0), ("x1", 200.0), ("bottom", 140.0))], cells.alias("cells"), columns.alias("columns"))

    def word(x0, top, text, width=28.0):
        x0, top = (F.lit(v) if isinstance(v, float) else v for v in (x0, top))
        return F.struct(x0.alias("x0"), (x0 + width).alias("x1"), top.alias("top"), (top + 10).alias("bottom"), (F.lit(text) if isinstance(text, str) else text).alias("text"))

    lines = F.transform(F.when(F.col("text") != "", F.split("text", "\n")).otherwise(F.array().cast("array<string>")), lambda line, i: F.transform(F.split(line, " "), lambda w, j: word(j * 30.0 + 10, i * 20.0 + 200, w)))
    inner = F.array(word(10.0, 110.0, "Key"), word(110.0, 110.0, "Status"))
    above = F.array(word(10.0, 80.0, "Order"), word(45.0, 80.0, "Key"), word(110.0, 80.0, "State"))
    stream = F.array(word(10.0, 300.0, F.concat(F.lit("a"), F.col("k").cast("string"))), word(100.0, 300.0, "b"), word(10.0, 320.0, "c"), word(100.0, 320.0, "d"))
    own = F.when(F.col("k") % 8 == 0, F.concat(inner, above)).when(F.col("k") % 4 == 0, inner).when(F.col("k") % 4 == 1, stream).otherwise(F.slice(inner, 1, 0))
    return p.select("file_id", "page_no", "text", F.concat(own, F.flatten(lines)).alias("words"), F.when(F.col("k") % 4 == 0, F.array(ruled)).alias("tables"))


def pdf_documents(spark, d):
    docs = pdf.documents(pdf.blocks(_with_layout(spark, d)))
    return docs.select("file_id", "page_no", "block_no", "block_type", "content", F.array_join("headings", " > ").alias("headings"), "table_label")


def pdf_tables(spark, d):
    t = pdf.extract_tables(pdf.blocks(_with_layout(spark, d)))
    return t.select("file_id", "page_no", F.array_join("headers", ",").alias("headers"), F.array_join(F.transform("rows", lambda r: F.array_join(r, "/")), ",").alias("rows"))


def _flat(p):
    words = p.select("file_id", "page_no", F.inline("words"))
    ruled = p.select("file_id", "page_no", F.posexplode("tables").alias("table", "t")).select("file_id", "page_no", "table", "t.*")
    return words, ruled


def outside_tables(spark, d):
    p = _with_layout(spark, d)
    words, ruled = _flat(p)
    shown = pg.stream_tables(words.join(ruled.select("file_id", "page_no"), ["file_id", "page_no"], "left_anti"), ["file_id", "page_no"])
    boxes = ruled.select("file_id", "page_no", "x0", "top", "x1", "bottom").unionByName(shown.select("file_id", "page_no", "x0", "top", "x1", "bottom"))
    return pg.outside_tables(words, boxes, ["file_id", "page_no"]).groupBy("file_id", "page_no").agg(F.count("*").alias("n_words"), F.max("text").alias("last_word"), F.min("top").alias("top"))


def headers_above(spark, d):
    words, r = _flat(_with_layout(spark, d))
    columns = r.select("file_id", "page_no", "table", F.col("top").alias("table_top"), F.posexplode("columns").alias("column", "c")).select("file_id", "page_no", "table", "table_top", "column", "c.x0", "c.x1")
    return pg.headers_above(words.join(r.select("file_id", "page_no", "table"), ["file_id", "page_no"]), columns, ["file_id", "page_no", "table"]).select("file_id", "page_no", F.array_join("headers", ",").alias("headers"))


QUERIES = {f.__name__: f for f in (pdf_documents, pdf_tables, outside_tables, headers_above)}
_P = """p AS (SELECT o_custkey AS file_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS page_no, o_orderkey AS k, o_orderstatus AS s FROM orders),
q AS (SELECT *, CASE k % 3 WHEN 0 THEN page_no || E' Terms\\nsome plain text\\nand more of it' WHEN 1 THEN 'A note of order ' || k ELSE '' END AS own,
  CASE WHEN k % 8 = 0 THEN 'Order Key State' ELSE '' END AS above, k % 4 < 2 AS has_table FROM p),
r AS (SELECT *, trim(above || CASE WHEN above <> '' AND own <> '' THEN E'\\n' ELSE '' END || own, E'\\n') AS text,
  CASE WHEN k % 3 = 0 AND page_no <= 20 THEN page_no || ' Terms' END AS head FROM q),
h AS (SELECT *, coalesce(last_value(head IGNORE NULLS) OVER (PARTITION BY file_id ORDER BY page_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
  coalesce(last_value(head IGNORE NULLS) OVER (PARTITION BY file_id ORDER BY page_no ROWS UNBOUNDED PRECEDING), '') AS after FROM r),
t AS (SELECT *, CASE WHEN k % 8 = 0 THEN ['Order Key', 'State'] WHEN k % 4 = 0 THEN ['Key', 'Status'] ELSE ['a' || k, 'b'] END AS headers,
  CASE WHEN k % 8 = 0 THEN [['Key', 'Status'], [k::VARCHAR, s]] WHEN k % 4 = 0 THEN [[k::VARCHAR, s]] ELSE [['c', 'd']] END AS rows FROM h WHERE has_table)"""
ORACLE = {
    "pdf_documents": f"""WITH {_P}
SELECT file_id, page_no, 0 AS block_no, 'table' AS block_type, '### Table (page ' || page_no || E')\\n| ' || array_to_string(headers, ' | ') || E' |\\n| --- | --- |\\n' || array_to_string(list_transform(rows, lambda x: '| ' || array_to_string(x, ' | ') || ' |'), E'\\n') AS content,
  before AS headings, nullif(before, '') AS table_label FROM t
UNION ALL SELECT file_id, page_no, CASE WHEN has_table THEN 1 ELSE 0 END, CASE WHEN len(string_split(text, E'\\n')) >= 3 THEN 'text' ELSE 'note' END,
  '### ' || CASE WHEN len(string_split(text, E'\\n')) >= 3 THEN 'Text' ELSE 'Note' END || ' (page ' || page_no || E')\\n' || text, after, NULL FROM h WHERE text <> ''""",
    "pdf_tables": f"WITH {_P} SELECT file_id, page_no, array_to_string(headers, ',') AS headers, array_to_string(list_transform(rows, lambda x: array_to_string(x, '/')), ',') AS rows FROM t",
    "outside_tables": f"""WITH {_P}, w AS (SELECT file_id, page_no, unnest(string_split(above, ' ')) AS w, 80.0::DOUBLE AS top FROM r WHERE above <> ''
UNION ALL SELECT file_id, page_no, unnest(string_split(line, ' ')), 200.0::DOUBLE + 20 * i FROM (SELECT file_id, page_no, unnest(string_split(own, E'\\n')) AS line, unnest(range(0, len(string_split(own, E'\\n')))) AS i FROM r WHERE own <> ''))
SELECT file_id, page_no, count(*) AS n_words, max(w) AS last_word, min(top) AS top FROM w GROUP BY ALL""",
    "headers_above": f"WITH {_P} SELECT file_id, page_no, 'Order Key,State' AS headers FROM p WHERE k % 8 = 0",
}
