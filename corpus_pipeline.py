"""From raw documents to token ids: the stages of a training corpus, each a function of (spark, docs, sf_dir).

Every stage works on all rows that the one before kept, and its decisions take effect. All but the last return the
columns of docs as they came, whatever their names. A null text is an empty one; rows with a null doc_id take part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm import decontaminate, id_store, mixing, ngram_join, toxicity
from granary.llm.common import Carried, Scratch, remainder, table, text_column
from granary.llm.queries import END_ID, MIX_BUDGET, MIX_POWER, tokenizer_path

#: SQL can't express these stages; tests hold them against brute force.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. It learns from the labelled rows with a remainder other than 0."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").where(remainder("doc_id", 5) != 0))
    c = Carried(docs)
    return c.back(toxicity.with_toxicity(c.df, model, c.at("text")).where("predicted = 0"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest doc_id stays (null ones come last), of equal rows
    one. Documents without words are linked with nothing, and all stay."""
    groups = ngram_join.components(docs)
    named = lambda key: F.coalesce(key.cast("long").cast("string"), F.lit(""))
    first = groups.where("is_first and n_shingles > 0").select(named(F.col("doc_id")).alias("id"), F.col("text_hash").alias("th")).distinct()
    c = Carried(docs)
    text = text_column(c.at("text"))
    has_words = text.rlike(r"[^\x20\x09-\x0D]")
    rows = c.df.where(has_words).withColumn("id", named(F.col(c.at("doc_id")))).withColumn("th", F.xxhash64(text))
    kept = rows.join(first, ["id", "th"], "left_semi").dropDuplicates(["id", "th"])
    return c.back(kept).union(c.back(c.df.where(~has_words)))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, up to its error budget, go."""
    c = Carried(docs)
    return c.back(decontaminate.with_hits(c.df, table(spark, sf_dir, "benchmark"), c.at("text")).where(F.size("hits") == 0))


def sample_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled by probabilities that fit the margins' target shares."""
    c = Carried(docs)
    columns = {name: c.at(of) for name, of in (("key", "doc_id"), ("text", "text"), ("source", "source"), ("lang", "lang"))}
    return c.back(mixing.mix(c.df, MIX_BUDGET, MIX_POWER, **columns).where("selected"))


def write_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of what was written to a content-addressed store, read back from it."""
    folder = Scratch(spark).path()
    id_store.write_store(docs, folder, tokenizer_path(), END_ID)
    return id_store.read_digests(spark, folder)


STAGES = [
    ("toxicity", drop_toxic),
    ("near duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", sample_mix),
    ("token ids", write_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark)
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = scratch.save(docs)
    return docs
