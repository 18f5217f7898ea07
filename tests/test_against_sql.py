"""Queries over small tables in which Spark and DuckDB might differ, held against their SQL."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from granary.functions import text as tx

duckdb = pytest.importorskip("duckdb")

#: The seventh line of an English text is put in upper case by the queries.
LINE = "straße und ὀδύνη é ÿ ß"
DOCUMENTS = [
    (1, "one\ntwo\nthree\nfour\nfive\nsix\n" + LINE + "\neight", "en", "a"),
    (2, "one\ntwo\nthree\nfour\nfive\nsix\n" + "Maß und große Straße" + "\neight ß", "en", "a"),
    (3, "one\ntwo\nthree\nfour\nfive\nsix\n" + LINE + "\neight", "de", "a"),
    (4, " ".join(f"w{i}" for i in range(90)) + "\n" * 6 + "weiß " * 30 + "\nend", "en", "b"),
    (5, "", "en", "b"),
]


def differences(spark, path, name):
    """Rows that only one side has."""
    spark.createDataFrame(DOCUMENTS, "doc_id long, text string, lang string, source string").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(0, "EUROPE")], "r_regionkey int, r_name string").write.parquet(f"{path}/region.parquet")
    spark.createDataFrame([(7, "GERMANY", 0)], "n_nationkey int, n_name string, n_regionkey int").write.parquet(f"{path}/nation.parquet")
    con = duckdb.connect()
    for t in ("documents", "region", "nation"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}/{t}.parquet/*.parquet')")
    sql = con.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in sql.description]
    want = sorted(sql.fetchall())
    got = sorted(tuple(r) for r in entry.queries()[name](spark, str(path)).select(columns).collect())
    assert want
    return [x for x in got if x not in want], [x for x in want if x not in got], len(got) - len(want)


def test_capitals_of_all_characters(spark):
    """by single characters, whatever their code."""
    codes = [i for i in range(1, 0x110000) if not 0xD800 <= i < 0xE000]
    want = dict(duckdb.sql("SELECT i, upper(chr(i::INTEGER)) FROM range(1, 1114112) q(i) WHERE i NOT BETWEEN 55296 AND 57343").fetchall())
    some = [i for i in codes if i < 0x3000 or want[i] != chr(i) or chr(i).upper() != chr(i)]
    got = spark.createDataFrame([(i, chr(i)) for i in some], "i int, c string").select("i", tx.upper_each(F.col("c")).alias("u")).collect()
    assert [(r.i, r.u) for r in got if r.u != want[r.i]] == []


def test_chunk_dispatch(spark, tmp_path):
    """an upper-case line with ß."""
    assert differences(spark, tmp_path, "chunk_dispatch") == ([], [], 0)


def test_block_split(spark, tmp_path):
    """an upper-case line with ß."""
    assert differences(spark, tmp_path, "block_split") == ([], [], 0)


def test_chunk_prose(spark, tmp_path):
    """an upper-case line with ß."""
    assert differences(spark, tmp_path, "chunk_prose") == ([], [], 0)


def test_chunk_structured(spark, tmp_path):
    """an upper-case line with ß."""
    assert differences(spark, tmp_path, "chunk_structured") == ([], [], 0)
