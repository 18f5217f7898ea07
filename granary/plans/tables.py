"""Queries on typed tables: the columns of driver tables as strings."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.functions import text as tx
from granary.operators import structured as st

from .common import table

_HEADS = ["Unit Price", "($)", "x" * 50, "Preço", "Price ($)", "Price (€)", "A-b C", "__id__", "Name"]


def safe_names(spark, d):
    part = table(spark, d, "part").select("p_partkey", tx.safe_name(F.concat("p_brand", F.lit(" "), "p_type", F.lit(" ("), F.col("p_size").cast("string"), F.lit(")"))).alias("name"))
    return part


def unique_names(spark, d):
    return st.unique_names(spark, _HEADS)


def infer_types(spark, d):
    li = table(spark, d, "lineitem").withColumn("mixed", F.when(F.col("l_linenumber") == 1, "1.5").otherwise(F.col("l_linenumber").cast("string"))).withColumn("day", F.date_format("l_shipdate", "yyyy-MM-dd")).withColumn("at", F.date_format("l_shipdate", "yyyy-MM-dd HH:mm")).withColumn("none", F.lit(""))
    cols = ["l_orderkey", "l_quantity", "l_returnflag", "mixed", "day", "at", "none"]
    rows = li.select("l_linenumber", "l_partkey", "l_suppkey", *[F.col(c).cast("string").alias(c) for c in cols])
    return st.infer_types(rows, F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), cols).select("column", "name", "type")


def structured_load(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("Key"), F.when(F.col("o_orderkey") % 7 == 0, " ").otherwise(F.col("o_totalprice").cast("string")).alias("Total"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("Day"), F.concat(F.lit(" "), "o_orderstatus").alias("Status"))
    return st.load(rows, [("Key", "key", "BIGINT"), ("Total", "total", "NUMERIC"), ("Day", "day", "DATE"), ("Status", "status", "TEXT")]).drop("_row_id")


def type_change(spark, d):
    rows = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("k"), "c_name", F.col("c_acctbal").cast("string").alias("b"))
    return st.misfits(rows, {"k": "BIGINT", "c_name": "NUMERIC", "b": "NUMERIC"})


def sample_rows(spark, d):
    return st.sample_rows(table(spark, d, "nation").withColumn("n_name", F.when(F.col("n_nationkey") != 2, F.col("n_name"))).withColumn("_row_id", F.lit("x")), F.col("n_nationkey"))


def table_names(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.concat(F.lit("dom-"), F.col("p_size").cast("string"), F.lit("-abcdefgh")).alias("domain"), F.concat("p_name", F.lit(".v1.csv")).alias("file"))
    name = st.table_name(F.col("domain"), F.col("file"))
    return p.select("p_partkey", name.alias("table_name"), st.table_label(F.col("domain"), name).alias("label"))


def wire_types(spark, d):
    names = [*st.WIRE_TYPES, "jsonb", "uuid"]
    o = table(spark, d, "orders").select("o_orderkey", F.element_at(F.array(*[F.lit(x) for x in names]), (F.col("o_orderkey") % len(names) + 1).cast("int")).alias("data_type"))
    return o.groupBy(st.wire_type(F.col("data_type")).alias("wire_type")).agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (safe_names, unique_names, infer_types, structured_load, type_change, sample_rows, table_names, wire_types)}
_SAFE = "coalesce(nullif(trim(left(regexp_replace(lower({0}), '[^a-z0-9_]', '_', 'g'), 40), '_'), ''), 'col')"
_KIND = """CASE WHEN bool_and(regexp_matches(v, '^\\s*[+-]?\\d+(_\\d+)*\\s*$')) THEN 'BIGINT' WHEN bool_and(regexp_matches(v, '(?i)^\\s*[+-]?(\\d*\\.?\\d+(e[+-]?\\d+)?|\\d+\\.|inf|infinity|nan)\\s*$')) THEN 'NUMERIC'
 WHEN bool_and(regexp_matches(v, '^\\d{4}-\\d{2}-\\d{2}[ T]\\d{2}:\\d{2}(:\\d{2})?$')) THEN 'TIMESTAMPTZ' WHEN bool_and(regexp_matches(v, '^\\d{4}-\\d{2}-\\d{2}$')) THEN 'DATE' ELSE 'TEXT' END"""
_NAMES = [*st.WIRE_TYPES, "jsonb", "uuid"]
ORACLE = {
    "safe_names": f"SELECT p_partkey, {_SAFE.format('''p_brand || ' ' || p_type || ' (' || p_size || ')' ''')} AS name FROM part",
    "unique_names": "SELECT position::INTEGER AS position, \"column\", CASE WHEN n = 0 THEN s ELSE s || '_' || n END AS name FROM (SELECT *, row_number() OVER (PARTITION BY s ORDER BY position) - 1 AS n FROM (SELECT *, "
    + _SAFE.format('"column"') + " AS s FROM (VALUES " + ", ".join(f"({i}, '{h}')" for i, h in enumerate(_HEADS)) + ") t(position, \"column\")))",
    "infer_types": f"""WITH f AS (SELECT l_orderkey::VARCHAR AS l_orderkey, l_quantity::VARCHAR AS l_quantity, l_returnflag, CASE WHEN l_linenumber = 1 THEN '1.5' ELSE l_linenumber::VARCHAR END AS mixed,
 strftime(l_shipdate, '%Y-%m-%d') AS day, strftime(l_shipdate, '%Y-%m-%d %H:%M') AS at, '' AS none FROM lineitem ORDER BY l_orderkey::VARCHAR, l_linenumber, l_partkey, l_suppkey LIMIT 100),
 l AS (UNPIVOT f ON COLUMNS(*) INTO NAME c VALUE x) SELECT c AS "column", {_SAFE.format('c')} AS name, {_KIND} AS type FROM (SELECT c, nullif(x, '') AS v FROM l) GROUP BY c""",
    "structured_load": "SELECT o_orderkey AS key, CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS total, o_orderdate::DATE AS day, o_orderstatus AS status FROM orders",
    "type_change": "SELECT unnest(['b', 'c_name', 'k']) AS \"column\", unnest(['NUMERIC', 'NUMERIC', 'BIGINT']) AS type, unnest([0, (SELECT count(*) FROM customer WHERE try_cast(c_name AS DOUBLE) IS NULL), 0]) AS lost",
    "sample_rows": "SELECT n_nationkey::VARCHAR AS n_nationkey, CASE WHEN n_nationkey <> 2 THEN n_name ELSE '' END AS n_name, n_regionkey::VARCHAR AS n_regionkey FROM nation ORDER BY nation.n_nationkey LIMIT 5",
    "table_names": f"""SELECT p_partkey, 'sd_' || left(dom, 8) || '_' || l AS table_name, l AS label FROM (SELECT p_partkey, 'dom-' || p_size || '-abcdefgh' AS dom, left({_SAFE.format("p_name || '.v1'")}, 32) AS l FROM part)""",
    "wire_types": "SELECT w AS wire_type, count(*) AS n FROM (SELECT CASE o_orderkey % " + str(len(_NAMES)) + " " + " ".join(f"WHEN {i} THEN '{st.WIRE_TYPES.get(n, 'TEXT')}'" for i, n in enumerate(_NAMES)) + " END AS w FROM orders) GROUP BY w",
}
