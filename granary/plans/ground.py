"""Queries on relative dates. The tables hold none, so sentences are made of orders, in the SQL as well."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.operators import grounding as g

from .common import table

_SIMPLE = [(e, unit, step) for (unit, step), spellings in g.PERIODS.items() for e in spellings]
_DAYS = [(f"{w} {d}", step, i, 0.95) for w, step in g.WHICH.items() for d, i in g.DAYS.items()] + [(d, None, i, 0.8) for d, i in g.DAYS.items()]


def _pick(values: list[str], at):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (at % len(values) + 1).cast("int"))


def _orders(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_custkey", F.col("o_orderdate").alias("ref"))


def ground_simple(spark, d):
    o = _orders(spark, d).withColumn("text", F.concat(F.lit("Report of "), _pick([e for e, *_ in _SIMPLE], F.col("o_orderkey")), F.lit(", as agreed.")))
    return g.ground(o, "text", "ref", "personal").select("o_orderkey", "grounded", F.get("groundings", F.lit(0))["resolved"].alias("resolved"), F.get("groundings", F.lit(0))["confidence"].alias("confidence"), F.size("groundings").alias("n"))


def ground_weekday(spark, d):
    o = _orders(spark, d).withColumn("text", F.concat(F.lit("Visit: "), _pick([e for e, *_ in _DAYS], F.col("o_orderkey")), F.lit(".")))
    return g.ground(o, "text", "ref", "personal").select("o_orderkey", "grounded", F.get("groundings", F.lit(0))["resolved"].alias("resolved"), F.get("groundings", F.lit(0))["confidence"].alias("confidence"))


def _two(spark, d):
    o = _orders(spark, d)
    who = F.when(F.col("o_orderkey") % 2 == 0, "I saw").otherwise("They saw")
    return o.withColumn("text", F.concat(who, F.lit(" it yesterday. The shop opens "), _pick([e for e, *_ in _DAYS], F.col("o_custkey")), F.lit("!")))


def ground_personal(spark, d):
    out = g.ground(_two(spark, d), "text", "ref", "personal")
    return out.select("o_orderkey", "grounded", F.array_join(F.transform("groundings", lambda x: x["start"].cast("string")), ",").alias("starts"))


def ground_auto(spark, d):
    out = g.ground(_two(spark, d), "text", "ref", F.when(F.col("o_orderkey") % 5 == 0, "document").otherwise("auto"))
    return out.select("o_orderkey", "grounded", F.round(F.aggregate("groundings", F.lit(0.0), lambda a, x: a + x["confidence"]), 6).alias("confidence"))


def iso_event_at(spark, d):
    o = _orders(spark, d)
    bad = F.when(F.col("o_orderkey") % 3 == 0, "2024-13-45 or ").otherwise("")
    text = F.concat(F.lit("dated "), bad, F.date_format("ref", "yyyy-MM-dd"), F.lit(" and 1999-01-01"))
    return o.select("o_orderkey", g.first_iso_date(text).alias("event_day"))


def topics_update(spark, d):
    o = _orders(spark, d).withColumn("topics", F.array(F.lit("a"), F.lit("event_at:2020-01-01"), F.concat(F.lit("t"), (F.col("o_orderkey") % 4).cast("string"))))
    day = F.when(F.col("o_orderkey") % 3 > 0, F.to_date("ref"))
    return o.select("o_orderkey", F.array_join(g.with_event_topic(F.col("topics"), day), ",").alias("topics"))


def memory_ground(spark, d):
    o = _orders(spark, d).withColumn("memory", F.when(F.col("o_orderkey") % 3 == 0, "Note of 2020-01-01: met Bob yesterday").when(F.col("o_orderkey") % 3 == 1, "Born 2021-05-06").otherwise("Likes tea")).withColumn("topics", F.array(F.lit("x")))
    return g.ground_memories(o, "memory", "topics", "ref").select("o_orderkey", "memory", F.array_join("topics", ",").alias("topics"))


def conversations_ground(spark, d):
    c = table(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", F.concat("text", F.lit(" I did that last week")).alias("text"), F.expr("timestamp_ntz'2026-05-18 10:00:00'").alias("ref"))
    return g.ground(c, "text", "ref", "auto").select("conv_id", "turn", F.md5("grounded").alias("grounded_md5"), F.get("groundings", F.lit(0))["resolved"].alias("event_at"))


def episodes(spark, d):
    o = _orders(spark, d).withColumn("text", F.when(F.col("o_orderkey") % 2 == 0, "They came next month.").otherwise("Nothing to say.")).withColumn("user", F.concat(F.lit("u"), (F.col("o_custkey") % 9).cast("string")))
    return g.episodes(o, "text", "ref", "user").select("o_orderkey", "user_id", "content", "event_at")


def temporal_lexicon(spark, d):
    rows = [(e, *m) for e, m in g.meanings().items()]
    return spark.createDataFrame(rows, f"expression string, {g.MEANING}").groupBy("unit", "step", "weekday").agg(F.count("*").alias("n"), F.max(F.length("expression")).alias("longest"), F.min("confidence").alias("confidence"))


QUERIES = {f.__name__: f for f in (ground_simple, ground_weekday, ground_personal, ground_auto, iso_event_at, topics_update, memory_ground, conversations_ground, episodes, temporal_lexicon)}

_V = lambda rows: ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else "NULL" if x is None else str(x) for x in (i, *r)) + ")" for i, r in enumerate(rows))
_O = "SELECT o_orderkey, o_custkey, o_orderdate AS ref, o_orderdate::DATE AS day, (isodow(o_orderdate) - 1)::INTEGER AS wd FROM orders"
_SIMPLE_DATE = """CASE k WHEN 'instant' THEN ref WHEN 'day' THEN day + s::INTEGER WHEN 'week' THEN date_trunc('week', ref) + to_days(7 * s::INTEGER)
 WHEN 'month' THEN date_trunc('month', ref) + to_months(s::INTEGER) ELSE date_trunc('year', ref) + to_years(s::INTEGER) END"""
_DAY_DATE = """day + (CASE WHEN kind = -1 THEN -(CASE WHEN (wd - i + 7) % 7 = 0 THEN 7 ELSE (wd - i + 7) % 7 END)
 WHEN kind = 1 THEN (CASE WHEN (i - wd + 7) % 7 = 0 THEN 7 ELSE (i - wd + 7) % 7 END) WHEN kind = 0 THEN i - wd ELSE -((wd - i + 7) % 7) END)::INTEGER"""
_YMD = "strftime({}, '%Y-%m-%d')"
_TWO = f"""SELECT *, CASE WHEN o_orderkey % 2 = 0 THEN 'I saw it ' ELSE 'They saw it ' END AS who, {_YMD.format('day - 1')} AS y, {_YMD.format(f'({_DAY_DATE})::TIMESTAMP')} AS w
 FROM ({_O}) o JOIN (VALUES {_V(_DAYS)}) v(j, e, kind, i, c) ON o.o_custkey % {len(_DAYS)} = v.j"""

ORACLE = {
    "ground_simple": f"""SELECT o_orderkey, 'Report of ' || {_YMD.format('resolved')} || ' [' || e || '], as agreed.' AS grounded, resolved, 1.0::DOUBLE AS confidence, 1 AS n
FROM (SELECT o_orderkey, e, ({_SIMPLE_DATE})::TIMESTAMP AS resolved FROM ({_O}) o JOIN (VALUES {_V(_SIMPLE)}) v(j, e, k, s) ON o.o_orderkey % {len(_SIMPLE)} = v.j)""",
    "ground_weekday": f"""SELECT o_orderkey, 'Visit: ' || {_YMD.format('resolved')} || ' [' || e || '].' AS grounded, resolved, c::DOUBLE AS confidence
FROM (SELECT o_orderkey, e, c, ({_DAY_DATE})::TIMESTAMP AS resolved FROM ({_O}) o JOIN (VALUES {_V(_DAYS)}) v(j, e, kind, i, c) ON o.o_orderkey % {len(_DAYS)} = v.j)""",
    "ground_personal": f"SELECT o_orderkey, who || y || ' [yesterday]. The shop opens ' || w || ' [' || e || ']!' AS grounded, len(who) || ',' || len(who) + 26 AS starts FROM ({_TWO})",
    "ground_auto": f"""SELECT o_orderkey, who || CASE WHEN o_orderkey % 5 <> 0 AND o_orderkey % 2 = 0 THEN y || ' [yesterday]' ELSE 'yesterday' END || '. The shop opens ' || e || '!' AS grounded,
 CASE WHEN o_orderkey % 5 <> 0 AND o_orderkey % 2 = 0 THEN 0.9 ELSE 0.0 END::DOUBLE AS confidence FROM ({_TWO})""",
    "iso_event_at": "SELECT o_orderkey, o_orderdate::DATE AS event_day FROM orders",
    "topics_update": "SELECT o_orderkey, CASE WHEN o_orderkey % 3 > 0 THEN 'a,t' || o_orderkey % 4 || ',event_at:' || strftime(o_orderdate, '%Y-%m-%d') ELSE 'a,event_at:2020-01-01,t' || o_orderkey % 4 END AS topics FROM orders",
    "memory_ground": f"""SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'Note of 2020-01-01: met Bob ' || y || ' [yesterday]' WHEN 1 THEN 'Born 2021-05-06' ELSE 'Likes tea' END AS memory,
 CASE o_orderkey % 3 WHEN 0 THEN 'x,event_at:' || y WHEN 1 THEN 'x,event_at:2021-05-06' ELSE 'x' END AS topics FROM (SELECT o_orderkey, {_YMD.format('o_orderdate::DATE - 1')} AS y FROM orders)""",
    "conversations_ground": "SELECT conv_id, turn, md5(text || ' I did that 2026-05-11 [last week]') AS grounded_md5, TIMESTAMP '2026-05-11 00:00:00' AS event_at FROM conversations WHERE role = 'user'",
    "episodes": f"""SELECT o_orderkey, 'u' || o_custkey % 9 AS user_id, CASE WHEN o_orderkey % 2 = 0 THEN 'They came ' || {_YMD.format("m")} || ' [next month].' ELSE 'Nothing to say.' END AS content,
 CASE WHEN o_orderkey % 2 = 0 THEN m END AS event_at FROM (SELECT o_orderkey, o_custkey, (date_trunc('month', o_orderdate) + INTERVAL 1 MONTH)::TIMESTAMP AS m FROM orders)""",
    "temporal_lexicon": f"""SELECT k AS unit, s::INTEGER AS step, i::INTEGER AS weekday, count(*) AS n, max(len(e)) AS longest, min(c)::DOUBLE AS confidence FROM (SELECT e, k, s, NULL AS i, 1.0 AS c FROM (VALUES {_V(_SIMPLE)}) v(j, e, k, s)
UNION ALL SELECT e, 'weekday', kind, i, c FROM (VALUES {_V(_DAYS)}) v(j, e, kind, i, c)) GROUP BY ALL""",
}
