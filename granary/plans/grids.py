"""Queries on sheets: suppliers laid out as cells by arithmetic, in the SQL as well. Block b of 12 suppliers starts at
row 8 b: a 3 x 4 table with a repeated header, 6 pairs, or a note of 2 x 6, in turn; some cells are left out."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.functions import text as tx
from granary.operators import grids as gr

from .common import table


def cells(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), "s_name").withColumn("b", F.expr("cast(k div 12 as int)")).withColumn("j", F.expr("cast(k % 12 as int)"))
    kind = F.col("b") % 3
    row = F.col("b") * 8 + F.when(kind == 0, F.expr("j div 3")).when(kind == 1, F.expr("j div 2")).otherwise(F.expr("j div 6")).cast("int")
    col = F.when(kind == 0, F.col("j") % 3).when(kind == 1, F.col("j") % 2).otherwise(F.col("j") % 6)
    value = F.when((kind == 0) & (F.col("j") < 3), F.concat(F.lit("H"), (F.col("j") % 2).cast("string"))).otherwise(F.col("s_name"))
    out = s.select((F.col("b") % 2).alias("file_id"), F.lit(0).alias("sheet_idx"), F.lit("S").alias("sheet_name"), row.alias("row"), col.alias("col"), value.alias("value"), kind.alias("kind"), "j")
    return out.where("not (kind = 0 and j = 7) and not (kind = 1 and j = 5)").drop("kind", "j")


def _parsed(spark, d):
    c = cells(spark, d)
    return gr.parse(c), c


def grid_blocks(spark, d):
    return _parsed(spark, d)[0].select("file_id", "block_index", "block_type", "top_row", "left_col", "bottom_row", "right_col", F.round("confidence", 6).alias("confidence"))


def table_rows(spark, d):
    return gr.table_rows(*_parsed(spark, d)).select("file_id", "block_index", "row_index", F.array_join("headers", ",").alias("headers"), F.array_join("values", ",").alias("vals"))


def kv_items(spark, d):
    return gr.kv_items(*_parsed(spark, d)).select("file_id", "block_index", "key", "value")


def notes(spark, d):
    return gr.notes(*_parsed(spark, d))


def block_markdown(spark, d):
    return gr.render(*_parsed(spark, d)).select("file_id", "block_index", "content")


def merge_expand(spark, d):
    n = table(spark, d, "nation")
    c = n.select(F.lit(1).alias("file_id"), F.lit(0).alias("sheet_idx"), F.lit("N").alias("sheet_name"), (F.col("n_nationkey") * 3).alias("row"), F.lit(0).alias("col"), F.col("n_name").alias("value"))
    m = n.where("n_nationkey % 2 = 0").select(F.lit(1).alias("file_id"), F.lit(0).alias("sheet_idx"), (F.col("n_nationkey") * 3).alias("top"), F.lit(0).alias("left"), (F.col("n_nationkey") * 3 + 1).alias("bottom"), F.lit(2).alias("right"))
    return gr.expand_merges(c, m).select("row", "col", "value", "merged")


def col_letters(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("i"), tx.column_letter(F.col("o_orderkey")).alias("letter"))


def header_dedupe(spark, d):
    h = table(spark, d, "orders").groupBy("o_custkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderstatus"))), lambda x: x["o_orderstatus"]).alias("h"))
    return h.select("o_custkey", F.array_join(gr.distinct_headers(F.col("h")), ",").alias("headers"))


QUERIES = {f.__name__: f for f in (grid_blocks, table_rows, kv_items, notes, block_markdown, merge_expand, col_letters, header_dedupe)}
_C = """k AS (SELECT (s_suppkey // 12)::INTEGER AS b, (s_suppkey % 12)::INTEGER AS j, s_name FROM supplier), c AS (
 SELECT b, b % 2 AS file_id, b % 3 AS kind, j, b * 8 + CASE b % 3 WHEN 0 THEN j // 3 WHEN 1 THEN j // 2 ELSE j // 6 END AS r, CASE b % 3 WHEN 0 THEN j % 3 WHEN 1 THEN j % 2 ELSE j % 6 END AS col,
 CASE WHEN b % 3 = 0 AND j < 3 THEN 'H' || j % 2 ELSE s_name END AS v FROM k WHERE NOT (b % 3 = 0 AND j = 7) AND NOT (b % 3 = 1 AND j = 5)),
x AS (SELECT b, file_id, min(r) AS t, max(r) AS bo, min(col) AS l, max(col) AS ri, count(*) AS n FROM c GROUP BY ALL),
f AS (SELECT b, r, count(*) AS n, min(col) AS fc FROM c GROUP BY ALL),
s AS (SELECT x.*, head, sd, ks FROM x JOIN (SELECT b, max(f.n / (ri - l + 1)) FILTER (r = t) AS head, coalesce(stddev_samp(f.n / (ri - l + 1)) FILTER (r > t), 0) AS sd, count(*) FILTER (fc = l) / max(bo - t + 1) AS ks FROM x JOIN f USING (b) GROUP BY b) USING (b)),
y AS (SELECT *, (row_number() OVER (PARTITION BY file_id ORDER BY t, l) - 1) AS block_index, CASE WHEN ri - l >= 2 AND bo - t >= 2 AND head >= 0.6 AND sd < 0.3 THEN 'table'
 WHEN ri - l = 1 AND bo - t >= 1 AND ks >= 0.8 THEN 'kv_pair' ELSE 'note' END AS block_type FROM s),
rows AS (SELECT y.b, y.file_id, block_index, z.r AS r, string_agg(coalesce(v, ''), ',' ORDER BY g) AS vals, string_agg(coalesce(v, ''), ' | ' ORDER BY g) AS bars, max(CASE WHEN v IS NOT NULL THEN 1 END) AS has
 FROM y, range(0, 3) q(g), range(0, 1000) z(r) LEFT JOIN c ON c.b = y.b AND c.r = z.r AND c.col = q.g WHERE block_type = 'table' AND z.r > t AND z.r <= bo AND g <= ri - l GROUP BY ALL),
tr AS (SELECT *, row_number() OVER (PARTITION BY b ORDER BY r) - 1 AS row_index FROM rows WHERE has = 1),
hd AS (SELECT b, 'H0,H1' || CASE WHEN ri - l = 2 THEN ',H0_1' ELSE '' END AS headers FROM y WHERE block_type = 'table')"""
_KV = "SELECT y.file_id, block_index, a.r, a.v AS key, coalesce(z.v, '') AS value FROM y JOIN c a ON a.b = y.b AND a.col = l LEFT JOIN c z ON z.b = y.b AND z.r = a.r AND z.col = l + 1 WHERE block_type = 'kv_pair'"
_NOTE = "SELECT y.file_id, block_index, string_agg(v, ' ' ORDER BY r, col) AS text FROM y JOIN c USING (b) WHERE block_type = 'note' GROUP BY ALL"
_LETTER = lambda i: f"(chr((65 + {i})::INTEGER))"
ORACLE = {
    "grid_blocks": f"""WITH {_C} SELECT file_id, block_index, block_type, t AS top_row, l AS left_col, bo AS bottom_row, ri AS right_col, round(CASE block_type WHEN 'table' THEN 1.0 - CASE WHEN head < 0.7 THEN 0.1 ELSE 0 END - CASE WHEN sd > 0.2 THEN 0.1 ELSE 0 END
 WHEN 'kv_pair' THEN CASE WHEN ks >= 0.9 THEN 1.0 ELSE 0.9 END ELSE 0.8 END, 6)::DOUBLE AS confidence FROM y""",
    "table_rows": f"WITH {_C} SELECT file_id, block_index, row_index, headers, vals FROM tr JOIN hd USING (b)",
    "kv_items": f"WITH {_C} SELECT file_id, block_index, key, value FROM ({_KV})",
    "notes": f"WITH {_C} {_NOTE}",
    "block_markdown": f"""WITH {_C}, body AS (
 SELECT file_id, block_index, '| ' || replace(any_value(headers), ',', ' | ') || ' |' || chr(10) || '| --- | --- | --- |' || chr(10) || string_agg('| ' || bars || ' |', chr(10) ORDER BY r) AS body FROM tr JOIN hd USING (b) GROUP BY ALL
 UNION ALL SELECT file_id, block_index, string_agg('- ' || key || ': ' || value, chr(10) ORDER BY r) FROM ({_KV}) GROUP BY ALL UNION ALL {_NOTE})
SELECT file_id, block_index, '### ' || CASE block_type WHEN 'table' THEN 'Table' WHEN 'kv_pair' THEN 'Key-Value' ELSE 'Note' END || ' (rows ' || t + 1 || '-' || bo + 1 || ', cols ' || chr((65 + l)::INTEGER) || '-' || chr((65 + ri)::INTEGER) || ')' || chr(10) || body AS content
FROM y JOIN body USING (file_id, block_index)""",
    "merge_expand": "SELECT (n_nationkey * 3 + r)::INTEGER AS row, c::INTEGER AS col, n_name AS value, r > 0 OR c > 0 AS merged FROM nation, range(0, 2) a(r), range(0, 3) b(c) WHERE n_nationkey % 2 = 0 UNION ALL SELECT n_nationkey * 3, 0, n_name, false FROM nation WHERE n_nationkey % 2 = 1",
    "col_letters": f"""SELECT o_orderkey AS i, CASE WHEN o_orderkey < 26 THEN {_LETTER('o_orderkey')} WHEN o_orderkey < 702 THEN {_LETTER('(o_orderkey // 26 - 1)')} || {_LETTER('o_orderkey % 26')}
 ELSE {_LETTER('((o_orderkey // 26 - 1) // 26 - 1)')} || {_LETTER('(o_orderkey // 26 - 1) % 26')} || {_LETTER('o_orderkey % 26')} END AS letter FROM orders WHERE o_orderkey <= 16000""",
    "header_dedupe": "SELECT o_custkey, string_agg(CASE WHEN n = 1 THEN o_orderstatus ELSE o_orderstatus || '_' || n - 1 END, ',' ORDER BY o_orderkey) AS headers FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey) AS n FROM orders) GROUP BY o_custkey",
}
