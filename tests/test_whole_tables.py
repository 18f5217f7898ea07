"""Queries over small tables in which a part that is left out would show."""

import hashlib

from pyspark.sql import functions as F

from granary.functions import text as tx
from granary.operators import jobs as jb
from granary.plans import grids, jobs, pages, search


def folder(path, **tables):
    for name, df in tables.items():
        df.write.parquet(f"{path}/{name}.parquet")
    return str(path)


def test_whole_texts_are_hashed(spark, tmp_path):
    same = "the same first forty characters of text, "
    rows = [(1, same + "one", "en"), (2, same + "two", "en"), (3, same + "one", "en"), (4, same + "one", "de"), (5, "", "en")]
    d = folder(tmp_path, documents=spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    want = {}
    for i, text, lang in rows:
        want[lang, hashlib.md5(f"{lang}:{text}".encode()).hexdigest()] = i
    assert {(r.domain_id, r.content_hash): r.doc_id for r in search.dedupe_hash(spark, d).collect()} == want


def events(spark, n):
    return spark.range(n).selectExpr("id as event_id", "cast(id % 7 as bigint) as user_id", "timestamp_ntz'2026-01-01' as ts", "'click' as event_type", "1.0D as value", "'{}' as props")


def test_all_events_are_on_pages(spark, tmp_path):
    n = 1200
    d = folder(tmp_path, events=events(spark, n))
    centers = {}
    for i in range(n):
        centers.setdefault(i % 50, set()).add(i * 37 % 500)
    want = {(p, c, float(x)) for p, xs in centers.items() for c, x in enumerate(sorted(xs))}  # 50 points apart
    assert {tuple(r) for r in pages.center_cluster(spark, d).collect()} == want
    column = {(p, x): c for p, c, x in want}
    assert {tuple(r) for r in pages.nearest_column(spark, d).collect()} == {(i, column[i % 50, float(i * 37 % 500)]) for i in range(n)}
    assert {r.event_id for r in pages.band_words(spark, d).collect()} == set(range(n))
    got = pages.stream_tables(spark, d).collect()
    assert sum(r.n_rows * r.n_columns for r in got) == n and {r.page for r in got} == set(range(n // 120))


def letters(i):
    out, i = "", i + 1
    while i:
        i, r = divmod(i - 1, 26)
        out = chr(65 + r) + out
    return out


def test_letters_of_all_orders(spark, tmp_path):
    keys = [0, 25, 26, 701, 702, 16_000, 16_001, 18_277, 18_278, 475_253, 475_254, 10**12, 2**63 - 1]
    d = folder(tmp_path, orders=spark.createDataFrame([(k,) for k in keys], "o_orderkey long"))
    assert {r.i: r.letter for r in grids.col_letters(spark, d).collect()} == {k: letters(k) for k in keys}
    odd = spark.createDataFrame([(-1,), (None,)], "i int")
    assert [r[0] for r in odd.select(tx.column_letter(F.col("i"))).collect()] == [None, None]


def test_queries_grow_with_the_table(spark, tmp_path):
    rows = [(i, [float(i % 7), 1.0], i % 2) for i in range(260)]
    d = folder(tmp_path, embeddings=spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"))
    got = search.vector_topk_batch(spark, d).collect()
    assert {int(r.query_id) for r in got} == {0, 50, 100, 150, 200, 250}
    for q in (0, 50, 250):
        scope = [(-(x[0] * rows[q][1][0] + 1), i) for i, x, label in rows if (i % 3, label) == (q % 3, q % 2)]
        assert [(int(r.id), r.score) for r in sorted((r for r in got if int(r.query_id) == q), key=lambda r: r.rank)] == [(i, -s) for s, i in sorted(scope)[:5]]


def test_whole_job_logs_are_folded(spark, tmp_path):
    d = folder(tmp_path, events=events(spark, 100))
    assert jobs._events(spark, d).count() == 100
    got = {r.job_id: r for r in jobs.job_latest(spark, d).collect()}
    for j in range(7):
        state = ("failed", "completed", "processing")[j % 3]
        want = (state, "chunk" if state == "processing" else None, "read,ground,chunk" if state == "completed" else "read,ground", "boom" if state == "failed" else None)
        assert tuple(got[j])[1:] == want


def test_last_attempt_of_a_job_counts(spark):
    go = lambda job, seq, step: (job, step, "processing", None, seq)
    log = [go(1, 1, "read"), go(1, 2, "ground"), go(1, 3, "chunk"), (1, None, "failed", "boom", 4), go(1, 5, "read"), go(1, 6, "ground")]
    log += [go(2, 1, "read"), go(2, 2, "ground"), (2, None, "failed", "boom", 3), go(2, 4, "ground"), (2, None, "completed", None, 5)]
    log += [go(3, 2, "own step"), go(3, 1, "other step"), (4, None, "pending", None, 1)]
    df = spark.createDataFrame(log, "job_id long, step string, state string, error string, seq long")
    got = {r.job_id: tuple(r)[1:] for r in jb.fold_jobs(df).collect()}
    assert got == {1: ("processing", "ground", ["read"], None), 2: ("completed", None, ["read", "ground"], None), 3: ("processing", "own step", ["other step"], None), 4: ("pending", None, [], None)}
