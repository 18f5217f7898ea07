import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from granary.llm import hash_forest, html_text, mixing, toxicity, url_filter
from granary.llm import components as cc
from granary.llm import common as cm

# --- urls ----------------------------------------------------------------------------------------


def test_cascade_is_exact_over_its_universe(spark):
    rng = random.Random(1)
    keys = [f"host{i}.example.org" for i in range(3000)]
    listed = set(rng.sample(keys, 150)) | {"not.in.the.corpus"}
    universe = spark.createDataFrame([(k,) for k in keys], "key string")
    given = spark.createDataFrame([(k,) for k in listed], "key string")
    (cascade,) = url_filter.build_cascades(universe, given, cm.Scratch(spark))
    got = {r.key for r in universe.where(cascade.contains(F.col("key"))).collect()}
    assert got == listed & set(keys) and len(cascade.levels) > 1
    assert sum(level.bits for level in cascade.levels) < 3000 * 8
    parts = url_filter.build_cascades(universe, given, cm.Scratch(spark), max_bits=1000)
    n = len(parts)
    got = {r.key for i, part in enumerate(parts) for r in universe.where(url_filter.range_of(F.col("key"), n) == i).where(part.contains(F.col("key"))).collect()}
    assert n > 1 and got == listed & set(keys)


def test_urls_without_host_are_allowed_whatever_the_list(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "no scheme"), (4, "http:///path"), (5, "http://a.x/"), (6, "http://b.x./")], "page_id long, URL string")
    for n in range(12):
        for bits in (url_filter.MAX_BITS, 300):
            listed = [f"h{n}{i}.x" for i in range(n)] + ["a.x", ""]
            got = {r.page_id: r.verdict for r in url_filter.judge(df, listed, [], max_bits=bits).collect()} if n < 3 or bits > 300 else None
            assert got is None or got == {1: "allow", 2: "allow", 3: "allow", 4: "allow", 5: "block", 6: "allow"}


def test_judging(spark):
    rules = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
    urls = [
        ("http://a.NET/x", "a.net", "/x", "net/", "block"), ("https://example.net/en/?q", "example.net", "/en/", "example.net/en/", "allow"), ("http://net", "net", "", None, "allow"),
        ("x://w.example.com/de/a#b", "w.example.com", "/de/a", "example.com/de/", "block"), ("http://badexample.com/de/", "badexample.com", "/de/", None, "allow"), (None, "", "", None, "allow"),
        ("no scheme", "", "", None, "allow"), ("", "", "", None, "allow"), ("http://bad.io?x=/", "bad.io", "", None, "block"), ("http://sub.bad.io/", "sub.bad.io", "/", None, "block"), ("http://notbad.io/", "notbad.io", "/", None, "allow"),
        ("http://bad.io/", "bad.io", "/", None, "block"), ("http://bad.io/", "bad.io", "/", None, "block"), ("http://b.org/fr/://", "b.org", "/fr/://", "org/fr/", "allow"),
    ]
    df = spark.createDataFrame([(i, u[0], "clash", "clash", True) for i, u in enumerate(urls)], "page_id long, url string, host string, verdict string, listed boolean")
    as_frame = spark.createDataFrame([("BAD.io", 1), ("other.io", 2), (None, 3)], "`a.b` string, n int")
    for bits, listed in ((url_filter.MAX_BITS, ["BAD.io", "other.io"]), (300, ["BAD.io", "other.io"]), (url_filter.MAX_BITS, as_frame)):  # one cascade, ranges of keys
        got = sorted(url_filter.judge(df, listed, rules, max_bits=bits).select("page_id", "host", "path", "rule", "verdict").collect())
        assert [tuple(r)[1:] for r in got] == [u[1:] for u in urls]
    assert url_filter.judge(df.limit(0), ["bad.io"], rules).count() == 0
    assert url_filter.judge(df, [], rules).where("verdict = 'block'").count() == 2


# --- html ----------------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>Some title words</title><script>var a = "</p>";</script></head><body><nav><ul><li><a href="/a">Menu entry</a></li></ul></nav>
<div class="ad">Buy this now or never</div><article><h1>Head &amp; title</h1><p>First  para
graph &copy;<br>line.<p><b>Second</b> one<script>x("<p>")</script><form>Name <input></form><ul><li>point</li></ul></p><div id="comments"><p>Nice article, thanks a lot</p></div></article>
<footer>&copy; all rights reserved by someone</footer></body></html>"""
TEXT = "Head & title\n\nFirst para graph © line.\n\nSecond one\n\npoint"


def test_main_text(spark):
    pages = spark.createDataFrame([(1, PAGE, "clash"), (2, None, ""), (3, "", ""), (4, "<nav>only a menu</nav>", ""), (5, PAGE[:-20], ""), (6, PAGE, "")], "page_id long, html string, text string")
    model = html_text.fit(pages)
    got = {r.page_id: (r.text, r.n_chars) for r in html_text.extract(pages, model).collect()}
    assert got[1] == got[5] == got[6] == (TEXT, len(TEXT)) and got[2] == got[3] == got[4] == ("", 0)
    assert html_text.extract(pages.limit(0), html_text.fit(pages.limit(0))).count() == 0
    assert html_text.main_text("<p>plain words</p>", html_text.PageModel()) == "plain words"
    assert html_text.main_text("a &lt;b&gt; <", html_text.PageModel()) == "a <b> <"
    assert html_text.main_text("<p>" * 3000 + "deep", html_text.PageModel()) == ("deep" if html_text.PageModel().of_tag("p") * 3000 < 0 else "")


def test_best_region_like_its_definition():
    rng = np.random.default_rng(3)
    for _ in range(400):
        x = rng.integers(-4, 4, rng.integers(0, 14)).tolist()
        every = [(sum(x[a:b]), a, b) for a in range(len(x)) for b in range(a + 1, len(x) + 1)]
        first, end = html_text.best_region(x)
        best = max((s for s, *_ in every), default=0)
        assert sum(x[first:end]) == max(best, 0) and (first, end) == ((0, 0) if best <= 0 else (first, end))
        assert best <= 0 or end == min(b for s, a, b in every if s == best)


def test_main_text_is_the_best_region_of_its_tokens(spark):
    model = html_text.fit(spark.createDataFrame([(PAGE,)], "html string"))
    for page in (PAGE, PAGE.replace("article", "div"), "<p>a b<nav>c</nav><p>d"):
        tokens = html_text.parse(page)
        scores = html_text.token_scores(tokens, model)
        sums = {(a, b): sum(scores[a:b]) for a in range(len(scores)) for b in range(a, len(scores) + 1)}
        first, end = html_text.best_region(scores)
        assert sums[first, end] == pytest.approx(max(sums.values()))
        inside = " ".join(v for k, _, v, _, never in tokens[first:end] if k == "text" and not never).split()
        assert html_text.main_text(page, model).split() == inside


def test_marks_say_nothing_of_most_of_a_page():
    model = html_text.PageModel()
    words = " ".join(f"word{i}" for i in range(60))
    for page in (f'<div class="shared notice related"><p>{words}</p></div>', f'<nav>menu</nav><article class="widget"><p>{words}</p></article><p>other words here</p>', f'<div id="share"><main><p>{words}</p></main></div>'):
        assert html_text.main_text(page, model).startswith(words)
    assert html_text.main_text(f'<p>{words}</p><div class="share"><p>tell your friends</p></div>', model) == words


def test_stray_end_tags_take_time_in_proportion():
    began = time.time()
    assert html_text.main_text("<div>" * 40_000 + "</b>" * 40_000 + "x", html_text.PageModel()) in ("", "x")
    assert time.time() - began < 5


def test_html_with_clashing_columns(spark):
    got = html_text.extract(spark.createDataFrame([(1, PAGE, "a", 2, "b")], "page_id long, html string, Text string, N_CHARS int, `a.b` string"), html_text.PageModel())
    assert got.columns == ["page_id", "a.b", "text", "n_chars"] and got.first()["a.b"] == "b"


# --- mixing --------------------------------------------------------------------------------------


def docs(spark, n=400):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(["sun", "moon", "tax", "law", "goal", "ball"]) for _ in range(rng.randint(1, 60))), rng.choice(["en", "de", None]), rng.choice(["a", "a", "a", "b", None])) for i in range(n)]
    rows += [(n, None, "en", "a"), (n + 1, "", "xx", "zz"), (n + 2, rows[0][1], "en", "a"), (None, "sun", "en", "a")]
    return spark.createDataFrame([(*r, 1.0, True) for r in rows], "doc_id long, text string, lang string, source string, weight double, selected boolean")


def test_margins_are_met(spark):
    d = docs(spark)
    targets = {"source": {"a": 0.5, "b": 0.3, "\0": 0.2}}
    got = mixing.mix(d, 0.5, 0.5, targets).toPandas()
    assert len(got) == d.count() and got.probability.between(0, 1).all()
    share = (got.n_tokens * got.weight).groupby(got.source.fillna("\0")).sum() / (got.n_tokens * got.weight).sum()
    assert share["a"] == pytest.approx(0.5, abs=1e-6) and share["b"] == pytest.approx(0.3, abs=1e-6)
    assert (got.n_tokens * got.probability).sum() == pytest.approx(0.5 * got.n_tokens.sum())
    expected = (got.n_tokens * got.probability).groupby(got.source.fillna("\0")).sum() / (got.n_tokens * got.probability).sum()
    assert expected["a"] == pytest.approx(0.5, abs=1e-6) and expected["b"] == pytest.approx(0.3, abs=1e-6)
    again = mixing.mix(d.repartition(5), 0.5, 0.5, targets).toPandas()
    key = ["doc_id", "source", "n_tokens", "selected"]
    assert sorted(map(str, got[key].values.tolist())) == sorted(map(str, again[key].values.tolist()))
    assert 0.35 < got.n_tokens[got.selected].sum() / got.n_tokens.sum() < 0.65


def brute_shares(got, column):
    p = got.n_tokens * got.probability
    names = ["\0" if v is None or v != v else str(v) for v in got[column].tolist()]
    return {n: p[[x == n for x in names]].sum() / p.sum() for n in set(names)}


def test_expected_shares_are_those_reported(spark):
    d = docs(spark)
    for budget, targets in ((0.4, None), (0.9, {"source": {"a": 0.1, "b": 0.6, "\0": 0.3}, "lang": {"en": 0.9, "de": 0.05, "\0": 0.05}})):
        out, report = mixing.mix_with_report(d, budget, 0.5, targets)
        got, lines = out.toPandas(), report.collect()
        for r in lines:
            assert brute_shares(got, r.margin).get(r.value, 0.0) == pytest.approx(r.expected, abs=1e-9)
            assert r.reached == (abs(r.asked - r.expected) <= 1e-3) and r.target <= r.asked + 1e-9 or r.target > r.asked
        for r in lines:  # no value is asked for more than it has
            if r.margin == "source":
                own = got.n_tokens[[("\0" if x is None or x != x else x) == r.value for x in got.source.tolist()]].sum()
                assert r.target * budget * got.n_tokens.sum() <= own + 1e-6
        if targets is None:
            assert all(r.expected == pytest.approx(r.target, abs=1e-6) for r in lines)
        else:
            assert not all(r.reached for r in lines)


def test_reachable_by_definition():
    rng = np.random.default_rng(1)
    for _ in range(200):
        own, share = rng.uniform(0, 9, 6), rng.uniform(0, 1, 6) * (rng.uniform(0, 1, 6) < 0.8)
        if share.sum() == 0:
            continue
        share /= share.sum()
        budget = rng.uniform(0, 1) * own.sum()
        got = mixing.reachable(own, share, budget)
        assert got.sum() == pytest.approx(budget) and (got <= own + 1e-9).all()
        left = (share > 0) & (got < own - 1e-9)
        if left.any():  # those that aren't all taken share the rest in proportion
            assert np.ptp(got[left] / share[left]) < 1e-9 and (got[share > 0] <= (got[left] / share[left]).max() * share[share > 0] + 1e-9).all()


def test_raking_by_brute_force():
    rng = np.random.default_rng(4)
    tokens = rng.uniform(1, 9, 24)
    values = [[str(i % 2) for i in range(24)], [str(i // 2 % 3) for i in range(24)], [str(i // 6) for i in range(24)]]
    targets = [{"0": 0.35, "1": 0.65}, None, None]
    p, report = mixing.rake(values, tokens, targets, 0.9, 0.6)
    assert (p >= 0).all() and (p <= 1).all() and (p * tokens).sum() == pytest.approx(0.6 * tokens.sum())
    for margin, value, asked, target, expected in report:
        v = values[mixing.MARGINS.index(margin)]
        assert sum(x * t for x, t, y in zip(p, tokens, v) if y == value) / (0.6 * tokens.sum()) == pytest.approx(expected)
        assert expected == pytest.approx(target, abs=1e-7) and target == pytest.approx(asked, abs=1e-7)
    # uncapped cells are products of one factor a value: the raked solution, not another with the same margins
    x = np.log(p[p < 1])
    design = np.array([[v == name for v, names in zip((values[0][i], values[1][i], values[2][i]), ("01", "012", "0123")) for name in names] for i in np.flatnonzero(p < 1)], float)
    fit = design @ np.linalg.lstsq(design, x, rcond=None)[0]
    assert np.abs(fit - x).max() < 1e-6


def test_raking_as_a_frame_agrees(spark):
    rng = np.random.default_rng(6)
    rows = [(s, x, t, float(rng.integers(0, 50))) for s in "abc" for x in "xy" for t in "uv"]
    cells = spark.createDataFrame(rows, "s string, l string, t string, tokens double")
    for targets, budget in (([{"a": 0.2, "b": 0.5, "c": 0.3}, None, None], 0.5), ([None, {"x": 0.9}, None], 0.8)):
        scratch = cm.Scratch(spark)
        out, report = mixing.rake_frame(scratch.save(cells), ["s", "l", "t"], targets, 0.5, budget, scratch)
        p, lines = mixing.rake([[r[j] for r in rows] for j in range(3)], np.array([r[3] for r in rows]), targets, 0.5, budget)
        got = {r[:3]: r.probability for r in out.select("s", "l", "t", "probability").collect()}
        assert all(got[r[:3]] == pytest.approx(a, abs=1e-6) for r, a in zip(rows, p))
        assert sorted((r[0], r[1]) + tuple(round(x, 5) for x in r[2:5]) for r in report.collect()) == sorted((r[0], r[1]) + tuple(round(x, 5) for x in r[2:]) for r in lines)


def test_mixing_over_many_cells(spark):
    d = docs(spark, 120).withColumn("topic", F.col("doc_id") % 3)
    a, b = (mixing.mix(d, 0.5, 0.8, topic="topic", max_cells=m) for m in (1000, 1))
    assert a.columns == b.columns
    one, two = (sorted(map(str, x.select("doc_id", "n_tokens", F.round("probability", 6).alias("p"), "selected").collect())) for x in (a, b))
    assert one == two


def test_mixing_without_rows(spark):
    assert mixing.mix(docs(spark).limit(0), 0.5).count() == 0
    assert mixing.mix(docs(spark), 0.0).where("selected").count() == 0
    assert mixing.mix(docs(spark), 1.0).where("not selected").count() == 0
    with pytest.raises(ValueError, match="no column words"):
        mixing.mix(docs(spark), 0.5, text="words")
    clash = docs(spark, 40).withColumnRenamed("weight", "Weight").withColumn("a.b", F.lit(1)).withColumn("_c0", F.lit("x")).withColumn("t", F.lit("y"))
    got = mixing.mix(clash, 0.5)
    assert got.columns == ["doc_id", "text", "lang", "source", "a.b", "_c0", "t", "n_tokens", "topic", "weight", "probability", "selected"]
    assert {(r["a.b"], r["_c0"], r["t"]) for r in got.collect()} == {(1, "x", "y")}


# --- neighbours ----------------------------------------------------------------------------------


def test_neighbours(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(600, 16)) + 2 * rng.normal(size=(6, 16))[np.arange(600) % 6]
    x[100:130] = x[99]  # equal vectors
    rows = [(i, v.tolist(), "clash") for i, v in enumerate(x)]
    odd = [(700, None, ""), (720, [0.0] * 16, ""), (740, [float("nan")] + [1.0] * 15, ""), (760, [None] + [1.0] * 15, ""), (780, [1.0], ""), (None, [1.0] * 16, ""), (800, [float("inf")] * 16, "")]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, score string")
    got = hash_forest.search(df, lambda k: k % 20 == 0, 10, shard=200, query_block=7).collect()
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(by) == set(range(0, 600, 20))
    hit = 0
    for q, found in by.items():
        s = (x * x[q]).sum(1)
        s[q] = -np.inf
        want = np.lexsort((np.arange(600), -s))[:10]
        found.sort()
        assert [f[0] for f in found] == list(range(1, 11)) and all(abs(s[v] - y) < 1e-12 for _, v, y in found)
        hit += len({v for _, v, _ in found} & set(want.tolist()))
        assert [(-y, v) for _, v, y in found] == sorted((-y, v) for _, v, y in found)  # ties go to the smaller id
    assert hit >= 0.9 * 10 * len(by)


def test_neighbours_with_repeated_ids(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 8))
    ids = np.concatenate((np.repeat(np.arange(100), 3), np.full(60, 7), 40 + np.arange(40) % 4))  # 7 and 40 to 43 often
    x[300:360] = x[0] * 3 + 0.01 * x[300:360]  # near a query
    x[381:] = x[380]  # equal rows: ids 40 to 43
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<double>")
    want = []
    for j in np.flatnonzero(ids % 20 == 0):
        s = (x * x[j]).sum(1)
        near = [i for i in np.lexsort((ids, -s)) if i != j][:20]  # every row but the query's own
        want += [(int(ids[j]), n, int(ids[i]), round(float(s[i]), 9)) for n, i in enumerate(near, 1)]
    for shard in (8192, 150):
        got = hash_forest.search(df, lambda k: k % 20 == 0, 20, share=1e9, shard=shard).collect()
        assert sorted((r.query_id, r.rank, r.vec_id, round(r.score, 9)) for r in got) == sorted(want)
    few = hash_forest.search(df, lambda k: k % 20 == 0, 20, share=0.0).groupBy("query_id").count().collect()
    assert {r.query_id: r["count"] for r in few} == {q: 20 * int((ids == q).sum()) for q in range(0, 100, 20)}


def test_few_neighbours(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (20, [1.0, 1.0]), (20, [1.0, 1.0])], "vec_id long, embedding array<float>")
    got = sorted(map(tuple, hash_forest.search(df, lambda k: k % 20 == 0).collect()))
    assert got == sorted([(0, 1, 20, 1.0), (0, 2, 20, 1.0), (0, 3, 1, 0.0)] + 2 * [(20, 1, 20, 2.0), (20, 2, 0, 1.0), (20, 3, 1, 1.0)])
    assert hash_forest.search(df.limit(0), lambda k: k % 20 == 0).count() == 0


def test_vectors_of_each_length_are_an_index_of_their_own(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 1.0]), (2, [2.0]), (20, [3.0]), (40, [1.0, 1.0, 1.0])], "Vec_ID long, embedding array<double>")
    got = sorted(map(tuple, hash_forest.search(df, lambda k: k % 20 == 0).collect()))
    assert got == [(0, 1, 1, 0.5), (20, 1, 2, 6.0)]


def test_recall_on_the_given_table(spark):
    e = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = e.select("vec_id", "embedding").toPandas()
    ids, x = rows.vec_id.to_numpy(), np.array(rows.embedding.tolist(), dtype=float)
    got = hash_forest.search(e, lambda k: k % 20 == 0).toPandas().groupby("query_id").vec_id.apply(set)
    hit = n = 0
    for j in np.flatnonzero(ids % 20 == 0):
        s = (x * x[j]).sum(1)
        s[j] = -np.inf
        want = ids[np.lexsort((ids, -s))[:20]]
        hit, n = hit + len(got[ids[j]] & set(want.tolist())), n + 20
    assert hit >= 0.9 * n


# --- toxicity ------------------------------------------------------------------------------------


def brute_segments(s):
    """Maximal scoring segments by their definition: the best one, then those left and right of it."""
    if not len(s) or max(s) <= 0:
        return []
    run = np.concatenate(([0], np.cumsum(s)))
    a, b = max(((a, b) for a in range(len(s)) for b in range(a + 1, len(s) + 1)), key=lambda p: (run[p[1]] - run[p[0]], -(p[1] - p[0])))
    return brute_segments(s[:a]) + [(a, b, run[b] - run[a])] + [(x + b, y + b, v) for x, y, v in brute_segments(s[b:])]


def test_segments_like_their_definition():
    rng = np.random.default_rng(6)
    for _ in range(300):
        s = rng.normal(-0.4, 1, rng.integers(0, 30))
        assert [(a, b, round(v, 6)) for a, b, v in toxicity.segments(s)] == [(a, b, round(v, 6)) for a, b, v in brute_segments(s)]


def test_toxicity_on_held_out_texts(spark):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(400)]
    rows, labels = [], []
    for i in range(900):
        w = [rng.choice(words) for _ in range(rng.randint(5, 120))]
        bad = i % 6 == 0
        if bad:
            for _ in range(3):
                w.insert(rng.randrange(len(w) + 1), rng.choice(["vile", "nasty", "Foul"]))
        rows.append((i, " ".join(w), "clash"))
        labels.append((i, int(bad)))
    rows += [(5000, None, ""), (5001, "", ""), (None, "vile nasty foul vile", ""), (3, rows[3][1], "")]
    docs_ = spark.createDataFrame(rows, "doc_id long, text string, score string")
    lab = spark.createDataFrame([*labels, (None, 1), (7, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs_, lab.where(cm.remainder("doc_id", 5) != 0))
    got = toxicity.with_toxicity(docs_, model).withColumn("held", cm.remainder("doc_id", 5) == 0).collect()
    truth = dict(labels)
    held = [r for r in got if r.held and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    empty = [r for r in got if r.doc_id in (5000, 5001)]
    assert len(empty) == 2 and all(not r.passages and r.predicted == 0 for r in empty)
    assert [r.predicted for r in got if r.doc_id is None] == [1]
    assert toxicity.with_toxicity(docs_.limit(0), model).count() == 0
    clash = docs_.withColumnRenamed("score", "Score").withColumn("a.b", F.lit(1)).withColumn("Passages", F.lit(2))
    again = toxicity.with_toxicity(clash, model)
    assert again.columns == ["doc_id", "text", "a.b", "score", "predicted", "passages"]
    assert sorted(r.score for r in again.collect()) == sorted(r.score for r in got)
    none = toxicity.fit(docs_, lab.limit(0))
    assert {r.predicted for r in toxicity.with_toxicity(docs_, none).collect()} == {0}


# --- components ----------------------------------------------------------------------------------


def test_components(spark):
    links = [(1, 2), (2, 3), (3, 3), (10, 11), (11, 10), (None, 5)] + [(100 + i, 101 + i) for i in range(60)]
    got = {r.id: r.label for r in cc.connected_components(spark.createDataFrame(links, "a long, b long"), cm.Scratch(spark)).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 10: 10, 11: 10} | {100 + i: 100 for i in range(61)}
    assert cc.connected_components(spark.createDataFrame([], "a long, b long"), cm.Scratch(spark)).count() == 0


def test_lookup_deals_the_rows_of_hot_keys(spark):
    scratch = cm.Scratch(spark)
    rows = spark.range(12_000).select(F.when(F.col("id") < 10_000, 1).when(F.col("id") < 11_000, F.col("id")).alias("k"), F.col("id").alias("x"))
    right = spark.createDataFrame([(1, "one"), (10_500, "other")], "k long, y string")
    saved = scratch.save(rows)
    out = cm.lookup(saved, right, "k")
    assert sorted(map(tuple, out.select("k", "x", "y").collect()), key=str) == sorted(map(tuple, rows.join(right, "k", "left").select("k", "x", "y").collect()), key=str)
    assert cm.lookup(saved, right, "k", "inner").count() == 10_001
    settings = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "200"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        sizes = [r.n for r in cm.lookup(saved, right, "k").groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert max(sizes) < 4_500  # twenty parts of the hot key's 10,000, of which some may meet


def test_no_machine_local_folder_on_a_cluster():
    class Conf:
        def get(self, *_):
            return None

    class Session:
        conf = Conf()

        class sparkContext:
            master = "spark://somewhere:7077"
            getConf = staticmethod(Conf)

    with pytest.raises(ValueError, match="checkpoint"):
        cm.shared_dir(Session)
    Session.sparkContext.master = "local-cluster[2,1,1024]"
    with pytest.raises(ValueError, match="checkpoint"):
        cm.shared_dir(Session)
