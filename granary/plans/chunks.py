"""Chunking queries. Raw documents hold no headings or bullets, so some lines get them by number, in the SQL as well."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.functions import text as tx
from granary.operators import chunking as ck

from .common import table

def marked_lines():
    return F.transform(
        tx.lines(F.col("text")),
        lambda line, i: F.when(i % 11 == 10, F.lit(""))
        .when(i % 7 == 1, F.concat(F.lit("# "), line))
        .when(i % 7 == 3, F.concat(F.lit("- "), line))
        .when(i % 7 == 5, F.concat(F.lit("Bob: "), line))
        .when((i % 7 == 6) & (F.col("lang") == "en"), tx.upper_each(line))
        .otherwise(line),
    )


def marked(spark, d):
    return table(spark, d, "documents").select("doc_id", "lang", "source", F.array_join(marked_lines(), "\n").alias("text"))


def chunk_window(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", F.posexplode(ck.window_chunks(F.col("text"))).alias("chunk_index", "content"))


def chunk_window_stats(spark, d):
    docs = table(spark, d, "documents").select("lang", F.explode(ck.window_chunks(F.col("text"), 100, 10)).alias("content"))
    once = docs.select("lang", F.md5("content").alias("h"), tx.token_count(F.col("content")).alias("n"))
    return once.groupBy("lang").agg(F.count("*").alias("n_chunks"), F.countDistinct("h").alias("n_distinct"), F.sum("n").alias("n_tokens"), F.max("n").alias("longest"))


def block_split(spark, d):
    return marked(spark, d).select("doc_id", F.posexplode(ck.blocks(F.col("text"))).alias("block_index", "block"))


def chunk_structured(spark, d):
    return marked(spark, d).select("doc_id", F.posexplode(ck.structured_chunks(F.col("text"), 100, 10)).alias("chunk_index", "content"))


def chunk_prose(spark, d):
    heads = F.array(F.col("source"), tx.upper_each(F.col("lang")))
    return marked(spark, d).select("doc_id", F.posexplode(ck.prose_chunks(F.col("text"), heads, 60, 8)).alias("chunk_index", "content"))


def nation_tables(spark, d):
    nation, region = table(spark, d, "nation"), table(spark, d, "region")
    rows = nation.groupBy("n_regionkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: F.create_map(F.lit("Key"), x["n_nationkey"].cast("string"), F.lit("Name"), x["n_name"])).alias("table_rows"))
    return region.join(rows, region["r_regionkey"] == rows["n_regionkey"]).select(
        "r_regionkey", F.lit("table").alias("block_type"), F.lit("").alias("content"), F.array(F.lit("Atlas"), F.col("r_name")).alias("headings"), F.array(F.lit("Key"), F.lit("Name"), F.lit("Note")).alias("table_columns"), "table_rows", F.concat(F.lit("Nations of "), F.col("r_name")).alias("table_label")
    )


def chunk_table(spark, d):
    t = nation_tables(spark, d)
    chunks = ck.table_chunks(F.col("table_columns"), F.col("table_rows"), F.col("headings"), F.col("table_label"))
    return t.select("r_regionkey", F.posexplode(chunks).alias("chunk_index", "content"))


def chunk_dispatch(spark, d):
    tables = nation_tables(spark, d).withColumn("id", F.concat(F.lit("t"), F.col("r_regionkey").cast("string")))
    docs = marked(spark, d).select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), F.lit("text").alias("block_type"), F.col("text").alias("content"), F.array(F.col("source")).alias("headings"))
    both = docs.unionByName(tables.drop("r_regionkey"), allowMissingColumns=True)
    return ck.chunk_documents(both, 100, 10).select("id", "block_type", "chunk_index", F.md5("chunk").alias("chunk_md5"))


def chunk_strategy(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    return ck.chunk_column(docs, "text", "window", max_tokens=50, overlap=5).select("chunk_id", "chunk_index", F.md5("chunk").alias("chunk_md5"))


QUERIES = {f.__name__: f for f in (chunk_strategy, chunk_window, chunk_window_stats, block_split, chunk_structured, chunk_prose, chunk_table, chunk_dispatch)}

WINDOWS = """
SELECT {cols}, unnest(list_filter(list_transform(range(0, CASE WHEN len(w) < {m} THEN 1 ELSE (len(w) - {m}) // {s} + 2 END),
       lambda i: array_to_string(w[i * {s} + 1 : i * {s} + {m}], ' ')), lambda x: x <> '')) AS content,
       unnest(range(0, CASE WHEN len(w) < {m} THEN 1 ELSE (len(w) - {m}) // {s} + 2 END)) AS chunk_index
FROM (SELECT *, regexp_extract_all(text, '\\S+') AS w FROM documents) WHERE len(w) > 0
"""
_MARKED = """
lines AS (
  SELECT doc_id, lang, source, unnest(string_split(regexp_replace(text, '\\n$', ''), chr(10))) AS raw, unnest(range(0, len(string_split(regexp_replace(text, '\\n$', ''), chr(10))))) AS i FROM documents
), marked AS (
  SELECT doc_id, lang, source, i, rtrim(CASE WHEN i % 11 = 10 THEN '' WHEN i % 7 = 1 THEN '# ' || raw WHEN i % 7 = 3 THEN '- ' || raw
         WHEN i % 7 = 5 THEN 'Bob: ' || raw WHEN i % 7 = 6 AND lang = 'en' THEN upper(raw) ELSE raw END) AS line FROM lines
), classed AS (
  SELECT *, CASE WHEN trim(line) = '' THEN 'blank'
    WHEN regexp_matches(line, '^#{1,6}\\s+') OR (upper(line) = line AND lower(line) <> line) OR regexp_matches(line, '^([-*•]|\\d+\\.\\s+)')
      OR regexp_matches(line, '^[A-Za-z][A-Za-z0-9 _-]{0,32}:\\s+') THEN 'alone' ELSE 'prose' END AS kind FROM marked
), islands AS (
  SELECT *, sum(CASE WHEN kind <> 'prose' OR before IS NULL OR before <> 'prose' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS island
  FROM (SELECT *, lag(kind) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM classed)
), blocks AS (
  SELECT doc_id, lang, source, island, string_agg(trim(line), ' ' ORDER BY i) AS block FROM islands WHERE kind <> 'blank' GROUP BY ALL
), listed AS (
  SELECT d.doc_id, d.lang, d.source, coalesce(list(block ORDER BY island) FILTER (block IS NOT NULL), []) AS bs FROM documents d LEFT JOIN blocks b ON d.doc_id = b.doc_id GROUP BY ALL
)"""
_PACK = """
packed AS (
  SELECT doc_id, lang, source, list_reduce(list_prepend({{'done': []::VARCHAR[], 'open': NULL::VARCHAR}}, list_transform(bs, lambda b: {{'done': []::VARCHAR[], 'open': b}})),
    lambda acc, x: CASE WHEN acc.open IS NULL THEN {{'done': acc.done, 'open': x.open}}
      WHEN len(regexp_extract_all(acc.open, '\\S+')) + len(regexp_extract_all(x.open, '\\S+')) > {m}
        THEN {{'done': list_append(acc.done, acc.open), 'open': array_to_string(regexp_extract_all(acc.open, '\\S+')[-{o}:], ' ') || ' ' || x.open}}
      ELSE {{'done': acc.done, 'open': acc.open || ' ' || x.open}} END) AS r FROM listed
), chunked AS (SELECT doc_id, lang, source, CASE WHEN r.open IS NULL THEN r.done ELSE list_append(r.done, r.open) END AS cs FROM packed)"""
_TABLE = """
SELECT r_regionkey, unnest(range(0, len(rs) + 1)) AS chunk_index, unnest(list_prepend(p || ' — columns: Key, Name, Note — ' || len(rs) || CASE WHEN len(rs) = 1 THEN ' row' ELSE ' rows' END,
       list_transform(rs, lambda x: p || ' — ' || x))) AS content
FROM (SELECT r_regionkey, 'Atlas > ' || r_name || ' — Nations of ' || r_name AS p, list('Key: ' || n_nationkey || ', Name: ' || n_name || ', Note: ' ORDER BY n_nationkey, n_name) AS rs
      FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_regionkey, r_name)"""
_PROSE = "CASE WHEN len(cs) = 0 THEN [''] ELSE cs END"

ORACLE = {
    "chunk_strategy": f"SELECT doc_id || '_' || chunk_index AS chunk_id, chunk_index, md5(content) AS chunk_md5 FROM ({WINDOWS.format(cols='doc_id', m=50, s=45)})",
    "chunk_window": WINDOWS.format(cols="doc_id", m=400, s=360),
    "chunk_window_stats": f"SELECT lang, count(*) AS n_chunks, count(DISTINCT md5(content)) AS n_distinct, sum(len(regexp_extract_all(content, '\\S+')))::BIGINT AS n_tokens, max(len(regexp_extract_all(content, '\\S+'))) AS longest FROM ({WINDOWS.format(cols='lang', m=100, s=90)}) GROUP BY lang",
    "block_split": f"WITH {_MARKED} SELECT doc_id, unnest(range(0, len(bs))) AS block_index, unnest(bs) AS block FROM listed",
    "chunk_structured": f"WITH {_MARKED}, {_PACK.format(m=100, o=10)} SELECT doc_id, unnest(range(0, len(cs))) AS chunk_index, unnest(cs) AS content FROM chunked",
    "chunk_prose": f"""WITH {_MARKED}, {_PACK.format(m=60, o=8)}
SELECT doc_id, unnest(range(0, len(b))) AS chunk_index, unnest(list_transform(b, lambda c: CASE WHEN trim(c) IN (source, upper(lang)) THEN c ELSE '[' || source || ' > ' || upper(lang) || '] ' || c END)) AS content
FROM (SELECT *, {_PROSE} AS b FROM chunked)""",
    "chunk_table": _TABLE,
    "chunk_dispatch": f"""WITH {_MARKED}, {_PACK.format(m=100, o=10)}
SELECT 'd' || doc_id AS id, 'text' AS block_type, chunk_index, md5(content) AS chunk_md5 FROM (SELECT doc_id, unnest(range(0, len(b))) AS chunk_index, unnest(list_transform(b, lambda c: CASE WHEN trim(c) = source THEN c ELSE '[' || source || '] ' || c END)) AS content FROM (SELECT *, {_PROSE} AS b FROM chunked))
UNION ALL SELECT 't' || r_regionkey, 'table', chunk_index, md5(content) FROM ({_TABLE})""",
}
