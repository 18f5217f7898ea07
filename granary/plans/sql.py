"""The relational surface: SQL text over the tables, as an agent would send it. One text serves both engines."""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

SQL = {
    "sql_join_inner": "SELECT o_orderkey, c_name, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'",
    "sql_join_left": "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'F' GROUP BY c_custkey",
    "sql_join_right": "SELECT s_suppkey, n_name FROM nation RIGHT JOIN supplier ON n_nationkey = s_nationkey AND n_regionkey = 1",
    "sql_join_full": "SELECT c.k AS k, c.a AS a, s.b AS b FROM (SELECT c_nationkey AS k, count(*) AS a FROM customer WHERE c_custkey % 7 = 0 GROUP BY c_nationkey) c FULL JOIN (SELECT s_nationkey AS k, count(*) AS b FROM supplier GROUP BY s_nationkey) s ON c.k = s.k",
    "sql_join_semi": "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)",
    "sql_join_anti": "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')",
    "sql_join_cross": "SELECT r_name, n_name FROM region CROSS JOIN nation WHERE r_regionkey < n_nationkey",
    "sql_join_theta": "SELECT p_partkey, s_suppkey FROM part JOIN supplier ON p_size = s_suppkey % 50 AND p_retailprice > s_acctbal",
    "sql_agg_group": "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS q, round(avg(l_discount), 6) AS d, min(l_shipdate) AS first_day, max(l_tax) AS tax FROM lineitem GROUP BY l_returnflag, l_linestatus",
    "sql_agg_distinct": "SELECT o_orderstatus, count(DISTINCT o_custkey) AS n FROM orders GROUP BY o_orderstatus",
    "sql_agg_rollup": "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)",
    "sql_agg_cube": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)",
    "sql_agg_sets": "SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer GROUP BY GROUPING SETS ((c_mktsegment), (c_nationkey), ())",
    "sql_agg_filter": "SELECT o_custkey, count(*) FILTER (WHERE o_orderstatus = 'O') AS n_open FROM orders GROUP BY o_custkey HAVING count(*) > 5",
    "sql_window_rank": "SELECT o_custkey, o_orderkey, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderdate) AS r, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderdate) AS dr, ntile(3) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS t FROM orders",
    "sql_window_lag": "SELECT o_orderkey, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS before, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS after FROM orders",
    "sql_window_frame": "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS moving FROM events",
    "sql_set_union": "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier",
    "sql_set_intersect": "SELECT p_size AS k FROM part WHERE p_partkey % 3 = 0 INTERSECT SELECT p_size FROM part WHERE p_partkey % 5 = 0",
    "sql_set_except": "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'",
    "sql_topk": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10",
    "sql_subquery": "SELECT p_partkey FROM part p WHERE p_retailprice > (SELECT avg(p_retailprice) FROM part q WHERE q.p_brand = p.p_brand)",
    "sql_pricing_summary": "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS charge, count(*) AS n FROM lineitem WHERE l_shipdate <= DATE '1998-09-02' GROUP BY l_returnflag, l_linestatus",
    "sql_shipping_priority": "SELECT l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, o_orderdate FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE c_mktsegment = 'BUILDING' GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, o_orderdate, l_orderkey LIMIT 10",
    "sql_nation_volume": "SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY n_name",
}


def register(spark: SparkSession, sf_dir: str, names: tuple[str, ...] = TABLES) -> None:
    for name in names:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)


def run_sql(spark: SparkSession, text: str, timeout: float | None = None, args: dict | None = None) -> DataFrame | list:
    """The result of a SQL text; with a timeout its rows, or TimeoutError after so many seconds, its jobs cancelled."""
    if timeout is None:
        return spark.sql(text, args) if args else spark.sql(text)
    tag = f"sql-{threading.get_ident()}-{id(text)}"
    late = threading.Event()

    def stop() -> None:
        late.set()
        spark.interruptTag(tag)

    timer = threading.Timer(timeout, stop)
    spark.addTag(tag)
    timer.start()
    try:
        return (spark.sql(text, args) if args else spark.sql(text)).collect()
    except Exception as e:
        if late.is_set():
            raise TimeoutError(f"the query took more than {timeout} s") from e
        raise
    finally:
        timer.cancel()
        spark.removeTag(tag)


def _query(name: str):
    used = tuple(t for t in TABLES if f" {t} " in f"{SQL[name]} ".replace(")", " ").replace(",", " "))

    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        register(spark, sf_dir, used)
        return spark.sql(SQL[name])

    return f


QUERIES = {name: _query(name) for name in SQL}
ORACLE = dict(SQL)
