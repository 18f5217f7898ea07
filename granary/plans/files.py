"""Queries on files: rows of the tables as the bytes of sheets and texts, read as files are."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.sources import files

from .common import table


def _sheets(spark, d):
    """A CSV file for each region."""
    n = table(spark, d, "nation")
    line = F.concat_ws(",", F.col("n_nationkey").cast("string"), "n_name", F.concat(F.lit("region "), F.col("n_regionkey").cast("string")))
    each = F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", line.alias("line")))), lambda x: x["line"])
    f = n.groupBy("n_regionkey").agg(each.alias("lines"))
    content = F.concat(F.lit("Key,Name,Region\n"), F.array_join("lines", "\n"), F.lit("\n"))
    return f.select(F.concat(F.lit("in/r"), F.col("n_regionkey").cast("string"), F.lit(".csv")).alias("path"), content.cast("binary").alias("content"), F.lit(".csv").alias("extension"))


def _texts(spark, d):
    t = table(spark, d, "documents")
    return t.select(F.concat(F.lit("in/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.col("text").cast("binary").alias("content"), F.lit(".txt").alias("extension"))


def csv_cells(spark, d):
    return files.read_cells(_sheets(spark, d)).select("file_id", "sheet_name", "row", "col", "value")


def text_files(spark, d):
    return files.read_texts(_texts(spark, d)).select("file_id", "source_type", "source_name", F.md5("content").alias("content_md5"))


def file_documents(spark, d):
    docs = files.documents(_sheets(spark, d).unionByName(_texts(spark, d)))
    return docs.select("file_id", "source_type", "block_type", F.md5("content").alias("content_md5"), F.array_join("table_columns", ",").alias("columns"), F.size("table_rows").alias("n_rows"), "error")


QUERIES = {f.__name__: f for f in (csv_cells, text_files, file_documents)}
_N = "n AS (SELECT 'in/r' || n_regionkey || '.csv' AS file_id, n_regionkey AS r, n_nationkey AS k, n_name AS name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS i FROM nation)"
ORACLE = {
    "csv_cells": f"""WITH {_N}, c AS (SELECT file_id, i, unnest([k::VARCHAR, name, 'region ' || r]) AS value, unnest([0, 1, 2]) AS col FROM n
UNION ALL SELECT DISTINCT file_id, 0, unnest(['Key', 'Name', 'Region']), unnest([0, 1, 2]) FROM n)
SELECT file_id, 'Sheet1' AS sheet_name, i::INTEGER AS row, col::INTEGER AS col, value FROM c""",
    "text_files": "SELECT 'in/' || doc_id || '.txt' AS file_id, 'text' AS source_type, doc_id || '.txt' AS source_name, md5(text) AS content_md5 FROM documents",
    "file_documents": f"""WITH {_N}
SELECT file_id, 'spreadsheet' AS source_type, 'table' AS block_type,
  md5('### Table (rows 1-' || count(*) + 1 || E', cols A-C)\\n| Key | Name | Region |\\n| --- | --- | --- |\\n' || string_agg('| ' || k || ' | ' || name || ' | region ' || r || ' |', E'\\n' ORDER BY i)) AS content_md5,
  'Key,Name,Region' AS columns, count(*)::INTEGER AS n_rows, NULL::VARCHAR AS error FROM n GROUP BY file_id
UNION ALL SELECT 'in/' || doc_id || '.txt', 'text', NULL, md5(text), NULL, NULL, NULL FROM documents""",
}
