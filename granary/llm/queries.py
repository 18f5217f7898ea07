"""The queries of the training-data operators, as the driver runs them, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, hash_forest, html_text, id_store, language_model, mixing, ngram_join, span_dedup, toxicity, url_filter
from .common import Scratch, remainder, table


#: The share of all tokens to keep, and the power that tempers the margins' own shares into targets.
MIX_BUDGET, MIX_POWER = 0.8, 0.7


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return mixing.mix(docs, MIX_BUDGET, MIX_POWER).select("doc_id", "source", "lang", "topic", "n_tokens", "weight", "probability", "selected")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document and test item that it holds."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    hits = decontaminate.with_hits(docs, table(spark, sf_dir, "benchmark")).select("doc_id", F.explode("hits").alias("h"))
    return hits.select("doc_id", "h.item_id", "h.distance", "h.end")


def op6_span_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_dedup.dedup(table(spark, sf_dir, "documents"))


def op7_hash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hash_forest.search(table(spark, sf_dir, "embeddings"), lambda key: key % 20 == 0, k=20)


TOKENIZER, END_ID = "word_bpe_49k.json", 1


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def op8_id_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = Scratch(spark).path()
    id_store.write_store(table(spark, sf_dir, "documents"), folder, tokenizer_path(), END_ID)
    return id_store.read_digests(spark, folder)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.where(remainder("doc_id", 5) != 0))
    scored = toxicity.with_toxicity(docs.select("doc_id", "text"), model)
    best = F.array_max(F.transform("passages", lambda p: p["bits"]))
    return scored.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", "predicted", F.size("passages").alias("n_passages"), best.alias("best_bits"))


def op1_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score(table(spark, sf_dir, "documents"))


#: (verdict, host, path); and hosts that are blocked where no rule fits.
URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
LISTED_HOSTS = [f"{name}.example.{end}" for name in ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm") for end in ("com", "net", "org")]


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge(pages, LISTED_HOSTS, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


_BLOCKED = " OR ".join(f"host = '{h}' OR ends_with(host, '.{h}')" for h in LISTED_HOSTS)
_FIT = lambda h, p: f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
_BY_LENGTH = sorted(URL_RULES, key=lambda r: -len(r[1]) - len(r[2]))
OP2_SQL = f"""
WITH cut AS (
  SELECT page_id, CASE WHEN instr(coalesce(url, ''), '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut
)
SELECT page_id, host, path,
       CASE {" ".join(f"WHEN {_FIT(h, p)} THEN '{h}{p}'" for _, h, p in _BY_LENGTH)} END AS rule,
       CASE {" ".join(f"WHEN {_FIT(h, p)} THEN '{v}'" for v, h, p in _BY_LENGTH)} WHEN {_BLOCKED} THEN 'block' ELSE 'allow' END AS verdict
FROM parts
"""


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_text.extract(pages, html_text.fit(pages)).select("page_id", "url", "text", "n_chars")


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "class_id")


QUERIES = {"op1_language_model": op1_language_model, "op2_url_filter": op2_url_filter, "op3_html_text": op3_html_text, "op4_mixing": op4_mixing, "op5_decontaminate": op5_decontaminate, "op6_span_dedup": op6_span_dedup, "op7_hash_forest": op7_hash_forest, "op8_id_store": op8_id_store, "op9_toxicity": op9_toxicity, "op10_ngram_join": op10_ngram_join}
OP10_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT doc_id, list_sort(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
         ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i : i + 4], ' '))) END) AS ss FROM w
), c AS (
  SELECT ss, min(doc_id) AS id, len(ss) AS n FROM s WHERE len(ss) > 0 GROUP BY ss
), e AS (
  SELECT id, n, unnest(ss) AS g FROM c
), links AS (
  SELECT a.id AS a, b.id AS b FROM e a JOIN e b ON a.g = b.g AND a.id < b.id GROUP BY a.id, b.id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), ways AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
  SELECT id AS a, id AS b FROM c UNION SELECT reach.a, ways.b FROM reach JOIN ways ON reach.b = ways.a
), least AS (
  SELECT a AS id, min(b) AS component_id FROM reach GROUP BY a
)
SELECT s.doc_id, len(s.ss) AS n_shingles, coalesce(component_id, s.doc_id) AS component_id, coalesce(c.id, s.doc_id) AS class_id
FROM s LEFT JOIN c ON s.ss = c.ss LEFT JOIN least ON least.id = c.id
"""
ORACLE = {"op2_url_filter": OP2_SQL, "op10_ngram_join": OP10_SQL}
