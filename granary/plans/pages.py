"""Queries on page layout: events as words on pages, placed by arithmetic; headings made of orders. A page holds so many
events, and the number of pages grows with them: each 10,000 events fill 50 pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.functions import text as tx
from granary.operators import pages as pg

from .common import table


def words(spark, d):
    e = table(spark, d, "events")
    x0 = (F.col("event_id") * 37 % 500).cast("double")
    top = F.expr("cast(event_id div 50 % 40 * 20 as double)")
    return e.select("event_id", F.expr("event_id div 10000 * 50 + event_id % 50").alias("page"), F.expr("event_id div 50 % 40").alias("band"), x0.alias("x0"), (x0 + 20).alias("x1"), top.alias("top"), (top + 10).alias("bottom"), F.col("event_type").alias("text"))


def cell_split(spark, d):
    return pg.split_cells(words(spark, d), ["page", "band"], ["x0", "event_id"]).select("page", "band", "cell", "center", "text")


def row_group(spark, d):
    rows = words(spark, d).groupBy("page", (F.col("event_id") % 23).alias("r")).agg(F.min("x0").alias("top"), (F.min("x0") + 3).alias("bottom"))
    return pg.group_rows(rows, ["page"], ["top", "r"]).select("page", "r", "table")


def center_cluster(spark, d):
    w = words(spark, d).select("page", F.col("x0").alias("center"))
    return pg.cluster_centers(w, ["page"]).select("page", "column", F.round("at", 6).alias("at"))


def nearest_column(spark, d):
    w = words(spark, d)
    columns = pg.cluster_centers(w.select("page", F.col("x0").alias("center")), ["page"])
    return pg.nearest_column(w.select("page", "event_id", F.col("x0").alias("center")), columns, ["page"]).select("event_id", "column")


def band_words(spark, d):
    w = words(spark, d).withColumns({"page": F.expr("event_id div 400"), "top": (F.col("event_id") * 7 % 97).cast("double")}).drop("band")
    return pg.bands(w, ["page"]).select("event_id", "band")


def stream_tables(spark, d):
    # a page is 40 rows of three words
    x0, top = F.expr("cast(event_id % 3 * 100 as double)"), F.expr("cast(event_id div 3 % 40 * 20 as double)")
    w = words(spark, d).drop("band").withColumns({"page": F.expr("event_id div 120"), "x0": x0, "x1": x0 + 30, "top": top, "bottom": top + 10})
    return pg.stream_tables(w, ["page"]).select("page", "table", F.size("cells").alias("n_rows"), F.size(F.get("cells", F.lit(0))).alias("n_columns"))


def header_rows(spark, d):
    o = table(spark, d, "orders")
    cells = F.array("o_orderstatus", F.concat(F.lit("$"), F.col("o_orderkey").cast("string")), F.when(F.col("o_orderkey") % 2 == 0, "(1,200)").otherwise("Qty"), F.when(F.col("o_orderkey") % 3 == 0, "").otherwise("15%"))
    return o.select("o_orderkey", pg.is_header_row(cells).alias("is_header"))


def table_records(spark, d):
    n = table(spark, d, "nation").groupBy("n_regionkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: F.array(x["n_nationkey"].cast("string"), x["n_name"])).alias("cells"))
    head = F.array(F.array(F.lit("Key"), F.lit("Key"), F.lit("")))
    r = pg.table_records(F.concat(F.when(F.col("n_regionkey") % 2 == 0, head).otherwise(F.array().cast("array<array<string>>")), "cells"))
    return n.select("n_regionkey", F.array_join(r["headers"], ",").alias("headers"), F.array_join(F.transform(r["rows"], lambda x: F.array_join(x, "/")), ",").alias("rows"))


def page_text_blocks(spark, d):
    t = table(spark, d, "documents").select("doc_id", F.regexp_replace("text", r"\. ", ".\n\n").alias("t"))
    return t.select("doc_id", F.posexplode(pg.text_blocks(F.col("t"))).alias("pos", "b")).select("doc_id", "pos", "b.kind", "b.text")


def _lines(spark, d):
    o = table(spark, d, "orders")
    n = (F.col("o_orderkey") % 4 + 1).cast("int")
    number = F.array_join(F.slice(F.array(*[((F.col("o_orderkey") % (5 + i)) + 1).cast("string") for i in range(4)]), F.lit(1), n), ".")
    return o.select("o_custkey", "o_orderkey", F.when(F.col("o_orderkey") % 7 == 0, "plain text here").otherwise(F.concat(number, F.lit(" Terms"))).alias("text"), n.alias("depth"))


def heading_path_by_line(spark, d):
    return pg.with_heading_path(_lines(spark, d), ["o_custkey"], ["o_orderkey"]).select("o_orderkey", F.array_join("path", " > ").alias("path"))


def heading_stack(spark, d):
    each = _lines(spark, d).groupBy("o_custkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "text"))), lambda x: x["text"]).alias("l"))
    return each.select("o_custkey", F.array_join(pg.heading_path(F.col("l")), " > ").alias("path"))


def all_caps(spark, d):
    c = table(spark, d, "customer")
    line = F.when(F.col("c_custkey") % 4 == 0, F.col("c_mktsegment")).when(F.col("c_custkey") % 4 == 1, F.concat("c_mktsegment", F.lit("."))).when(F.col("c_custkey") % 4 == 2, F.concat(F.lit("REF"), F.col("c_custkey").cast("string"))).otherwise(F.concat("c_mktsegment", F.lit(" A B C TERMS")))
    return c.select("c_custkey", pg.is_caps_heading(line).alias("is_heading"))


QUERIES = {f.__name__: f for f in (cell_split, row_group, center_cluster, nearest_column, band_words, stream_tables, header_rows, table_records, page_text_blocks, heading_path_by_line, heading_stack, all_caps)}
_W = "w AS (SELECT event_id, event_id // 10000 * 50 + event_id % 50 AS page, event_id // 50 % 40 AS band, (event_id * 37 % 500)::DOUBLE AS x0, (event_id * 37 % 500)::DOUBLE + 20 AS x1, event_type AS text FROM events)"
_CL = "ch AS (SELECT page, x0, CASE WHEN x0 - lag(x0) OVER (PARTITION BY page ORDER BY x0) > 40 THEN 1 ELSE 0 END AS nw FROM w), k AS (SELECT page, x0, sum(nw) OVER (PARTITION BY page ORDER BY x0 RANGE UNBOUNDED PRECEDING)::INTEGER AS \"column\" FROM ch), cc AS (SELECT page, \"column\", avg(x0) AS mid FROM k GROUP BY ALL)"
_L = """l AS (SELECT o_custkey, o_orderkey, (o_orderkey % 4 + 1)::INTEGER AS depth, o_orderkey % 7 <> 0 AS head, array_to_string([o_orderkey % 5 + 1, o_orderkey % 6 + 1, o_orderkey % 7 + 1, o_orderkey % 8 + 1][1:(o_orderkey % 4 + 1)::INTEGER], '.') || ' Terms' AS t FROM orders)"""
ORACLE = {
    "cell_split": f"""WITH {_W}, g AS (SELECT *, sum(nw) OVER (PARTITION BY page, band ORDER BY x0, event_id) AS cell FROM (SELECT *, CASE WHEN x0 - lag(x1) OVER (PARTITION BY page, band ORDER BY x0, event_id) > 15 THEN 1 ELSE 0 END AS nw FROM w))
SELECT page, band, cell::INTEGER AS cell, (first(x0 ORDER BY x0, event_id) + last(x1 ORDER BY x0, event_id)) / 2 AS center, string_agg(text, ' ' ORDER BY x0, event_id) AS text FROM g GROUP BY ALL""",
    "row_group": f"""WITH {_W}, r AS (SELECT page, event_id % 23 AS r, min(x0) AS top, min(x0) + 3 AS bottom FROM w GROUP BY ALL)
SELECT page, r, sum(nw) OVER (PARTITION BY page ORDER BY top, r)::INTEGER AS "table" FROM (SELECT *, CASE WHEN top - lag(bottom) OVER (PARTITION BY page ORDER BY top, r) > 48 THEN 1 ELSE 0 END AS nw FROM r)""",
    "center_cluster": f'WITH {_W}, {_CL} SELECT page, "column", round(mid, 6) AS "at" FROM cc',
    "nearest_column": f'WITH {_W}, {_CL} SELECT event_id, "column" FROM (SELECT event_id, "column", row_number() OVER (PARTITION BY event_id ORDER BY abs(mid - x0), "column") AS n FROM w JOIN cc USING (page)) WHERE n = 1',
    # a band's first word is the highest that is more than 6 below the first word of the band above
    "band_words": """WITH RECURSIVE w AS (SELECT event_id, event_id // 400 AS page, (event_id * 7 % 97)::DOUBLE AS top FROM events),
a AS (SELECT page, min(top) AS top, 0 AS band FROM w GROUP BY page UNION ALL SELECT page, min(low) AS top, min(band) + 1 AS band FROM (SELECT a.page, a.band, w.top AS low FROM a JOIN w ON w.page = a.page AND w.top > a.top + 6) GROUP BY page)
SELECT event_id, max(band)::INTEGER AS band FROM w JOIN a ON a.page = w.page AND a.top <= w.top GROUP BY event_id""",
    # rows of a page are too near to each other to be two tables
    "stream_tables": """WITH r AS (SELECT event_id // 120 AS page, event_id // 3 % 40 AS r, count(*) AS n FROM events GROUP BY ALL HAVING count(*) >= 2)
SELECT page, 0 AS "table", count(*)::INTEGER AS n_rows, max(n)::INTEGER AS n_columns FROM r GROUP BY page HAVING count(*) >= 2""",
    "header_rows": "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN CASE WHEN o_orderkey % 3 = 0 THEN false ELSE false END ELSE CASE WHEN o_orderkey % 3 = 0 THEN true ELSE false END END AS is_header FROM orders",
    "table_records": """SELECT n_regionkey, CASE WHEN n_regionkey % 2 = 0 THEN 'Key,Key_1,col_2' ELSE 'col_0,col_1' END AS headers, string_agg(n_nationkey || '/' || n_name || CASE WHEN n_regionkey % 2 = 0 THEN '/' ELSE '' END, ',' ORDER BY n_nationkey) AS rows FROM nation GROUP BY n_regionkey""",
    "page_text_blocks": """SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INTEGER AS pos, CASE WHEN len(string_split(p, chr(10))) >= 3 THEN 'text' ELSE 'note' END AS kind, p AS text
FROM (SELECT doc_id, i, trim(p, E' \\n\\t') AS p FROM (SELECT doc_id, unnest(ps) AS p, unnest(range(0, len(ps))) AS i FROM (SELECT doc_id, string_split_regex(replace(text, '. ', E'.\\n\\n'), '\\n{2,}') AS ps FROM documents))) WHERE p <> ''""",
    "heading_path_by_line": f"""WITH {_L} SELECT x.o_orderkey, coalesce(string_agg(y.t, ' > ' ORDER BY y.depth, y.o_orderkey) FILTER (y.t IS NOT NULL), '') AS path FROM l x LEFT JOIN (SELECT * FROM l WHERE head) y ON x.o_custkey = y.o_custkey AND y.o_orderkey <= x.o_orderkey
 AND NOT EXISTS (SELECT 1 FROM l z WHERE z.head AND z.o_custkey = y.o_custkey AND z.o_orderkey > y.o_orderkey AND z.o_orderkey <= x.o_orderkey AND z.depth <= y.depth) GROUP BY x.o_orderkey""",
    "heading_stack": f"""WITH {_L}, live AS (SELECT * FROM l y WHERE head AND NOT EXISTS (SELECT 1 FROM l z WHERE z.head AND z.o_custkey = y.o_custkey AND z.o_orderkey > y.o_orderkey AND z.depth <= y.depth))
SELECT c.o_custkey, coalesce(string_agg(t, ' > ' ORDER BY depth) FILTER (t IS NOT NULL), '') AS path FROM (SELECT DISTINCT o_custkey FROM orders) c LEFT JOIN live USING (o_custkey) GROUP BY c.o_custkey""",
    "all_caps": "SELECT c_custkey, c_custkey % 4 = 0 AS is_heading FROM customer",
}
