import random

from pyspark.sql import functions as F

import corpus_pipeline as cp
from granary.llm import decontaminate, mixing, toxicity
from granary.llm.queries import MIX_BUDGET, MIX_POWER, ORACLE, QUERIES

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def make(spark, folder):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(500)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    item = "which planet is known as the red one among the eight of them"
    rows = [[i, text(rng.randint(20, 90)), "en", f"s{i % 4}"] for i in range(300)]
    for i in range(0, 300, 6):
        rows[i][1] += " vile nasty foul vile"
    rows += [[1000, rows[1][1], "en", "s1"], [1001, rows[2][1] + " w1", "en", "s1"], [1002, text(30) + " " + item.upper() + " " + text(20), "de", "s2"], [1003, None, None, None], [1004, "", "en", ""], [None, "nobody's text", "en", "s1"], rows[5]]
    spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], COLUMNS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 6 == 0)) for i in range(300)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def test_stages(spark, tmp_path):
    d = make(spark, str(tmp_path / "t"))
    docs = spark.read.parquet(f"{d}/documents.parquet")
    kept = {}
    for i, (name, stage) in enumerate(cp.STAGES):
        out = stage(spark, docs, d)
        if i < len(cp.STAGES) - 1:
            assert out.columns == docs.columns
        before = docs
        out.write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        kept[name] = sorted((r.doc_id for r in docs.select("doc_id").collect()), key=lambda x: (x is None, x))
        if name == "mixing":
            want = mixing.mix(before, MIX_BUDGET, MIX_POWER).where("selected").select("doc_id").collect()
            assert len(want) == len(kept[name]) and 0 < len(kept[name]) < before.count()
    toxic = set(range(0, 300, 6))
    assert not toxic & set(kept["toxicity"]) and len(kept["toxicity"]) == 307 - 50
    gone = set(kept["toxicity"]) - set(kept["near duplicates"])
    assert gone == {1000, 1001} and len(kept["near duplicates"]) == 307 - 50 - 3
    assert set(kept["near duplicates"]) - set(kept["decontamination"]) == {1002} and None in kept["decontamination"]
    assert kept["token ids"] == kept["mixing"]
    rows = docs.orderBy("start").collect()
    assert [r.start for r in rows] == [sum(x.n_tokens for x in rows[:i]) for i in range(len(rows))]


CLASHES = {"score": "mine", "Predicted": "p", "hits": 7, "weight": "w", "topic": "x", "n_tokens": "y", "a.b": 1, "__h": "h", "t": "t", "th": "th", "_c0": "c", "block": "b", "key": "k"}


def test_clashing_columns_come_through(spark, tmp_path):
    d = make(spark, str(tmp_path / "t"))
    plain = spark.read.parquet(f"{d}/documents.parquet")
    docs = plain.withColumns({c: F.lit(v) for c, v in CLASHES.items()})
    for _, stage in cp.STAGES[:-1]:
        want = sorted(r.doc_id or -1 for r in stage(spark, plain, d).collect())
        out = stage(spark, docs, d)
        assert out.schema == docs.schema or [(f.name, f.dataType) for f in out.schema] == [(f.name, f.dataType) for f in docs.schema]
        rows = out.collect()
        assert sorted(r.doc_id or -1 for r in rows) == want
        assert {tuple(r[c] for c in CLASHES) for r in rows} == {tuple(CLASHES.values())}


def test_near_duplicates_without_keys(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(None, text), (None, text), (4, text.replace("w3 ", "x ")), (4, text.replace("w3 ", "x ")), (None, "other words"), (None, ""), (None, None), (9, " "), (9, " ")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], COLUMNS)
    got = cp.drop_near_duplicates(spark, docs, "").collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in got) == sorted([(4, rows[2][1]), (0, "other words"), (0, ""), (0, ""), (9, " "), (9, " ")])


def test_run_is_its_stages(spark, tmp_path):
    d = make(spark, str(tmp_path / "t"))
    assert cp.run(spark, d).count() > 100


def test_queries_are_registered():
    assert sorted({int(q[2:].split("_")[0]) for q in QUERIES}) == list(range(1, 11)) and set(ORACLE) <= set(QUERIES)
    assert cp.ORACLE_SQL is None and len(cp.STAGES) == 5
    assert decontaminate.RATE < 0.1 and toxicity.MAX_LABELLED
